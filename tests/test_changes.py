"""Journals against a replay, removals against loops."""

import random

import pytest
from pyspark.sql import functions as F

from kinloom.operators import journal as J
from kinloom.operators import removal as R

JOURNAL = "change long, at int, record string, field string, op string, value string, undone long"


def replay(rows, until):
    rows = sorted((r for r in rows if r[1] is not None and r[1] <= until and r[2] is not None), key=lambda r: (r[1], r[0]))
    undos, off = {}, set()
    for change, _, _, _, op, _, undone in rows:
        if op == J.UNDO and undone is not None:
            undos[change] = undone
    for change in sorted(undos, reverse=True):  # an undo takes back only what is before it
        if change not in off:
            off.add(undos[change])
    state = {}
    for change, at, record, field, op, value, _ in rows:
        if change in off or op == J.UNDO:
            continue
        if op == J.REMOVE:
            state = {k: v for k, v in state.items() if k[0] != record}
        else:
            state[record, field] = (value, at, change)
    return sorted((*k, *v) for k, v in state.items())


def changes(seed, n=150):
    draw = random.Random(seed)
    rows = []
    for c in range(1, n):
        op = draw.choice((J.SET,) * 6 + (J.REMOVE, J.UNDO, J.UNDO))
        undone = draw.randrange(1, c) if op == J.UNDO and c > 1 else None
        rows.append((c, c // 3, draw.choice("abcd"), draw.choice("xyz") if op == J.SET else None, op, draw.choice("123") if op == J.SET else None, undone))
    return rows + [(900, None, "a", "x", J.SET, "9", None), (901, 1, None, "x", J.SET, "9", None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_states_equal_a_replay(spark, seed):
    rows = changes(seed)
    journal = spark.createDataFrame(rows, JOURNAL).repartition(4)
    for until in (0, 20, 49):
        got = sorted(map(str, map(tuple, J.state_at(journal, F.lit(until)).collect())))
        assert got == sorted(map(str, replay(rows, until))) and (until == 0 or len(got) > 3)
    short = J.compacted(journal, F.lit(30))
    assert short.count() <= len(rows)
    assert sorted(map(str, map(tuple, J.state_at(short, F.lit(49)).collect()))) == sorted(map(str, replay(rows, 49)))


def test_removal_follows_the_keys(spark):
    parents = spark.createDataFrame([(1, "go"), (2, "stay"), (3, "go"), (None, "go")], "id int, what string")
    children = spark.createDataFrame([(10, 1), (11, 1), (12, 2), (13, None), (14, 3)], "id int, parent int")
    marks = spark.createDataFrame([(10, 100), (12, 101), (11, 102)], "child int, id int")
    notes = spark.createDataFrame([(1, "n"), (2, "m"), (14, "k")], "about int, text string")
    locks = spark.createDataFrame([(10,), (10,), (12,), (14,)], "child int")
    keys = [R.ForeignKey("marks", "child", "children", "id"), R.ForeignKey("children", "parent", "parents", "id"), R.ForeignKey("notes", "about", "parents", "id", R.SET_NULL), R.ForeignKey("locks", "child", "children", "id", R.RESTRICT)]
    tables = {"parents": parents, "children": children, "marks": marks, "notes": notes, "locks": locks}
    gone, left, blockers = R.discard(tables, keys, "parents", F.col("what") == "go")
    rows = lambda df: sorted(map(str, map(tuple, df.collect())))
    assert rows(gone["children"]) == ["(10, 1)", "(11, 1)", "(14, 3)"] and rows(gone["marks"]) == ["(10, 100)", "(11, 102)"]
    assert rows(left["parents"]) == ["(2, 'stay')"] and rows(left["children"]) == ["(12, 2)", "(13, None)"] and rows(left["notes"]) == ["(14, 'k')", "(2, 'm')", "(None, 'n')"]
    assert rows(blockers) == ["('locks', 'child', 'children', '10', 2)", "('locks', 'child', 'children', '14', 1)"] and left["locks"].count() == 4
    with pytest.raises(ValueError):
        R.discard(tables, [*keys, R.ForeignKey("parents", "id", "marks", "id")], "parents", F.lit(True))
