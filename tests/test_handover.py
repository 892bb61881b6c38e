"""The handover against one loop over the entries."""

import random

import pytest

from kinloom.operators import handover as H
from kinloom.plans import parish

ROLE_SEX = {"father": "M", "groom": "M", "mother": "F", "bride": "F"}


def key(name):
    return " ".join(str(name or "").replace("/", " ").lower().split())


def parts(role, value, given):
    if value and not given:
        words = value.split()
        if role in ("child", "mother") and len(words) == 1 and "/" not in value:
            return value.strip(), None
        if "/" in value:
            before, between, after = (value.split("/") + ["", ""])[:3]
            return " ".join((before + " " + after).split()) or None, " ".join(between.split()) or None
        return (" ".join(words[:-1]) or None, words[-1]) if len(words) > 1 else (None, words[0])
    return given or None, value or None


def plain(said, plan, persons, families):
    """Entry by entry, each sees what the earlier ones made."""
    names, couples = dict(persons), [dict(zip(("family", "husband", "wife", "own"), f)) for f in families]
    people, out, children = [], [], set()
    next_person, next_family = max(names, default=0), max((f["family"] for f in couples), default=0)
    entries = {}
    for entry, place, role, value, given, sex, person in said:
        entries.setdefault((place, entry), {})[role] = (value, given, sex, person)
    for (_, entry), roles in sorted(entries.items()):
        value = lambda r: roles.get(r, (None,) * 4)
        heir = parts(plan.head, *value(plan.head)[:2])[1]
        have, again = {}, {}
        for _, couple in plan.children:
            a, b = key(value(couple[0])[0]), key(value(couple[1])[0])
            match = next((f for f in couples if a and b and f["own"] and f["husband"] and f["wife"] and key(names[f["husband"]]) == a and key(names[f["wife"]]) == b), None)
            if match and couple not in again:
                again[couple] = match
                have[couple[0]], have[couple[1]] = match["husband"], match["wife"]
        ids = {}
        for role in plan.roles:
            text, given, sex, person = value(role)
            if not text and person is None:
                continue
            g, s = parts(role, text, given)
            inherited, s = s is None and heir is not None, s or heir
            told = H.SEX.get(sex.strip().lower()) if sex else next((x for r, x in ROLE_SEX.items() if role == r or role.endswith("_" + r)), None)
            state = "reused" if role in have else "linked" if person is not None else "created"
            if state == "created":
                next_person += 1
                names[next_person] = " ".join(x for x in (g, s) if x)
                person = next_person
            ids[role] = have.get(role, person)
            people.append((entry, role, ids[role], state, g, s, told, inherited))
        made = {}
        for k, couple in enumerate(plan.couples):
            a, b = ids.get(couple[0]), ids.get(couple[1])
            if couple in again:
                family, state = again[couple], "reused"
            elif not a and not b:
                continue
            else:
                family = next((f for f in couples if a and b and f["husband"] == a and f["wife"] == b), None)
                state = "found" if family else "created"
                if not family:
                    next_family += 1
                    family = {"family": next_family, "husband": a, "wife": b, "own": True}
                    couples.append(family)
            made[couple] = family
            out.append((entry, k, family["family"], state, family["husband"], family["wife"]))
        children |= {(made[couple]["family"], ids[role]) for role, couple in plan.children if role in ids and couple in made}
    return people, out, children


SAID = "entry long, ord long, role string, value string, given string, sex string, person long"


def generated(plan, seed, n):
    draw = random.Random(seed)
    persons = [(k, draw.choice(("Hans Roth", "Anna Roth", "Regina", "Georg /von der Au/", "Maria Koch"))) for k in range(1, 13)]
    families = [(1, 1, 2, False), (2, 3, 4, True), (3, 5, None, True), (4, 7, 8, False)]
    said = []
    for e in range(n):
        for role in plan.roles:
            if draw.random() < 0.12:
                continue
            male = role.endswith("father") or role in ("groom", "child")
            value = draw.choice(("Hans Roth", "Hans  ROTH", "Roth", "Georg /von der Au/", "Jörg Koch", None) if male else ("Anna", "Anna Roth", "anna roth", "Regina", "Maria Koch", "Maria Agnes"))
            given = "Peter" if draw.random() < 0.1 else None
            person = draw.randint(1, 12) if draw.random() < 0.1 else draw.choice((1, 3, 7) if male else (2, 4, 8)) if draw.random() < 0.35 else None
            said.append((1000 - e, 3 * e + 7, role, value, given, draw.choice((None, None, None, "Knabe", " W ", "?")), person))
    return said, persons, families


@pytest.mark.parametrize("plan", [H.BAPTISM, H.MARRIAGE])
@pytest.mark.parametrize("seed", [1, 2])
def test_handover_equals_a_loop(spark, plan, seed):
    said, persons, families = generated(plan, seed, 50)
    stock = spark.createDataFrame(persons, "person long, name string"), spark.createDataFrame(families, "family long, husband long, wife long, own boolean")
    got = H.handover(spark.createDataFrame(said, SAID).repartition(3), plan, *stock)
    want = plain(said, plan, persons, families)
    assert {"created", "reused"} <= {f[3] for f in want[1]} and sum(p[7] for p in want[0]) > 3
    for frame, rows in zip(got, want):
        assert sorted(map(str, map(tuple, frame.collect()))) == sorted(map(str, rows))


def test_chains_of_inheriting_entries(spark):
    """Whether the third entry creates hangs on the second, and that on the first."""
    said = []
    for e, (father, mother) in enumerate([("Hans Roth", "Anna"), ("Hans Roth", "Anna Roth"), ("Hans Roth", "Anna"), ("Hans Roth", "Anna Roth"), ("Georg Koch", "Eva"), ("Georg Koch", "Eva Koch")], 1):
        said += [(e, e, "father", father, None, None, None), (e, e, "mother", mother, None, None, None), (e, e, "child", "Jakob", None, "knabe", None)]
    empty = spark.createDataFrame([], "person long, name string"), spark.createDataFrame([], "family long, husband long, wife long, own boolean")
    people, couples, children = (f.collect() for f in H.handover(spark.createDataFrame(said, SAID), H.BAPTISM, *empty))
    assert sorted((c["entry"], c["state"], c["family"]) for c in couples) == [(1, "created", 1), (2, "reused", 1), (3, "created", 2), (4, "reused", 1), (5, "created", 3), (6, "reused", 3)]
    assert {p["surname"] for p in people if p["role"] == "child" and p["entry"] < 5} == {"Roth"} and len(children) == 6


def test_query_equals_a_loop(spark):
    said, persons, families = (f.collect() for f in parish.handover_tables(spark, "/root/testdata/sf0.001"))
    want = plain([tuple(r) for r in said], H.BAPTISM, [tuple(r) for r in persons], [tuple(r) for r in families])[1]
    got = parish.handover(spark, "/root/testdata/sf0.001").collect()
    assert {f[3] for f in want} == {"created", "found", "reused"}
    assert sorted(map(str, map(tuple, got))) == sorted(str((f[0], f[2], f[3], f[4], f[5])) for f in want)


def test_parts_and_sexes(spark):
    rows = [("child", "Georg", None, None), ("mother", "Anna /von der Au/", None, None), ("father", "Roth", None, None), ("father", "Roth", "Hans", None), ("groom", None, "Hans", "w"), ("bride", "Eva Maria Koch", None, "?"), ("child", None, None, " Tochter ")]
    frame = spark.createDataFrame(rows, "role string, value string, given string, sex string")
    from pyspark.sql import functions as F

    got = frame.select(H.name_parts(F.col("role"), F.col("value"), F.col("given")).alias("p"), H.role_sex(F.col("role"), F.col("sex")).alias("s")).collect()
    assert [(*r["p"], r["s"]) for r in got] == [("Georg", None, None), ("Anna", "von der Au", "F"), (None, "Roth", "M"), ("Hans", "Roth", "M"), ("Hans", None, "F"), ("Eva Maria", "Koch", None), (None, None, "F")]
    assert frame.limit(1).select(H.full_name_key(F.lit("  Hans  /von der AU/ "))).first()[0] == "hans von der au"


def test_entry_rows_are_shuffled_few_times(spark):
    """2,000 entries of three roles: what is not linked is not looked up, and decided couples are not joined again."""
    said = [(k, k, role, value, None, None, None) for k in range(2000) for role, value in (("father", f"Hans Roth{k % 50}"), ("mother", f"Eva Koch{k % 50}"), ("child", "Anna"))]
    stock = spark.createDataFrame([], "person long, name string"), spark.createDataFrame([], "family long, husband long, wife long, own boolean")
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: store.stageList(None, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")())
    before = {stages().apply(k).stageId() for k in range(stages().size())}
    got = H.handover(spark.createDataFrame(said, SAID).repartition(3).localCheckpoint(), H.BAPTISM, *stock)[1].groupBy("state").count().collect()
    assert {r["state"]: r["count"] for r in got} == {"created": 50, "reused": 1950}
    now = stages()
    moved = sum(s.shuffleWriteRecords() for s in map(now.apply, range(now.size())) if s.stageId() not in before)
    assert moved < 40_000
