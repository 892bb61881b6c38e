"""Form periods against a fold."""

import random

import pytest
from pyspark.sql import functions as F

from kinloom.operators import periods as P
from kinloom.plans import registers


def plain(rows):
    """register -> periods, page after page."""
    out = []
    for register in {r[0] for r in rows}:
        own = sorted((r[1:] for r in rows if r[0] == register), key=lambda r: r[0])
        found = []
        for page, columns in own:
            key = [" ".join((c or "").lower().split()).strip(" .:-") for c in columns or []]
            inside = lambda a, b: bool(a) and any(b[i : i + len(a)] == a for i in range(len(b) - len(a) + 1))
            if key and found and (inside(key, found[-1][1]) or inside(found[-1][1], key)):
                found[-1][1] = max(found[-1][1], key, key=len)
            elif key:
                found.append([page, key])
        for k, (first, key) in enumerate(found):
            pages = [p for p, _ in own if p >= first and (k + 1 == len(found) or p < found[k + 1][0])]
            out.append((register, k + 1, first, pages[-1], len(pages), key))
    return sorted(map(str, out))


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_periods_equal_a_fold(spark, block):
    draw = random.Random(block)
    forms = [["Nr.", "Name", "Vater", "Mutter", "Tag"], ["name", "VATER"], ["Nr", "Name"], ["Ort:", "Zeuge"], ["Zeuge"], ["a", "b", "a", "b", "c"], ["a", "b", "c"], ["Mutter ", "Tag"]]
    rows = []
    for register, n in (("big", 200), ("small", 9), (None, 40)):
        now = 0
        for p in range(n):
            now = draw.randrange(len(forms)) if draw.random() < 0.2 else now
            columns = draw.choice((None, [], forms[now], forms[now][:2], forms[now][1:], forms[now]))
            rows.append((register, 10 * p + 3, columns))
    rows += [("unread", 1, None), ("unread", 2, [])]
    got = P.form_periods(spark.createDataFrame(rows, "register string, page long, columns array<string>").repartition(4), "register", "page", "columns", block=block).collect()
    assert len(got) > 30
    assert sorted(map(str, map(tuple, got))) == plain(rows)


def test_a_rich_header_passes_through_poor_blocks(spark):
    rows = [("r", 0, ["a", "b", "c"])] + [("r", p, ["a"] if p % 2 else ["c"]) for p in range(1, 30)]
    got = P.form_periods(spark.createDataFrame(rows, "register string, page long, columns array<string>"), "register", "page", "columns", block=4).collect()
    assert [tuple(r) for r in got] == [("r", 1, 0, 29, 30, ["a", "b", "c"])]


def test_query_equals_a_fold(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in registers.header_pages(spark, sf).collect()]
    assert sorted(map(str, map(tuple, registers.header_periods(spark, sf).collect()))) == plain(rows)
    assert P.form_periods(registers.header_pages(spark, sf).where(F.lit(False)), "register", "page", "columns").count() == 0
