"""Dates as they are stated, and the rules on cases that the tables do not hold."""

from pyspark.sql import functions as F

from kinloom.functions.dates import stated_date
from kinloom.operators import audit

DATES = {
    "3 MAY 1750": (1750, 5, 3), "ABT 1750": (1750, None, None), "MAY 1750": (1750, 5, None), "bet 3 may 1740 and 5 JUN 1745": (1740, 5, 3), "um 1780": (1780, None, None), "999": None, "2100": None, "1750": (1750, None, None),
    "3. MAY 1750": (1750, 5, None), "X5 MAY 1750": (1750, 5, 5), "12345": None, "123 MAY 1750": (1750, 5, None), "MAYOR 1750": (1750, None, None), "  7 XYZ 1750": (1750, None, 7), "": None, None: None,
    "1750 3 MAY": (1750, 5, None), "A1750": None, "3 MAY": None,
}
PERSON, FAMILY, CHILD, EVENT = "id long, surn string, sex string, more string", "id long, husband long, wife long", "family long, person long", "id long, person long, family long, kind string, date string"


def test_stated_dates(spark):
    rows = spark.createDataFrame([(k,) for k in DATES], "t string").select("t", stated_date(F.col("t")).alias("d")).collect()
    assert {r["t"]: tuple(r["d"]) if r["d"] else None for r in rows} == DATES


def found(spark, persons, families, children, events, **limits):
    rows = audit.register_audit(spark.createDataFrame(persons, PERSON), spark.createDataFrame(families, FAMILY), spark.createDataFrame(children, CHILD), spark.createDataFrame(events, EVENT), limits).collect()
    return [(r["rule"], r["person"], r["family"], r["child"]) for r in rows if r["rule"] not in ("sex_unknown", "unconnected")]


def test_rules_on_cases(spark):
    persons = [(i, "Koch", "M", None) for i in range(1, 8)]
    events = [
        (1, 1, None, "BIRT", None), (2, 1, None, "BIRT", "1 MAY 1700"),  # the first event has no date and hides the second
        (3, 2, None, "BIRT", "5 MAY 1700"), (4, 2, None, "DEAT", "MAY 1700"), (5, 2, None, "BURI", "4 MAY 1700"),  # of one month: not earlier
        (6, 3, None, "CHR", "1 JAN 1720"), (7, 4, None, "BIRT", "2 OCT 1720"), (8, 5, None, "BIRT", "2 OCT 1720"), (9, 6, None, "BIRT", "1 APR 1721"),
        (10, None, 10, "MARR", "1716"), (11, 2, None, "DEAT", "1650"), (12, 9, None, "BIRT", "1500"),
    ]
    families = [(10, 2, 1), (11, 2, 99)]
    children = [(10, 3), (10, 4), (10, 5), (10, 6), (10, 77), (12, 7)]
    late = [("child_long_after_father_died", 2, 10, k) for k in (3, 4, 5, 6)]
    # 3 to 4: nine months; 4 and 5: twins; 5 to 6: six months.
    alike = [("marriage_after_death", 2, 10, None), ("married_young", 2, 10, None), ("short_gap", None, 10, 6), *late]
    assert set(found(spark, persons, families, children, events)) == {*alike, ("same_surname", None, 10, None)}
    # A wife who is not among the persons has no name and no dates; a bound can be set.
    assert set(found(spark, persons, [(10, 2, 99)], children, events, marriage_min=16, children_max_father=4)) == {*alike[:1], *alike[2:], ("many_children", 2, 10, None)}


def test_empty_tables(spark):
    assert found(spark, [], [], [], []) == []
