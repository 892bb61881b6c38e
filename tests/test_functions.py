"""Promises of the text and date functions, one row each."""

import datetime
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinloom.functions import dates as D
from kinloom.functions import text as T


def one(spark, values, expression):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(expression(F.col("x"))).collect()]


def test_fold(spark):
    assert one(spark, ["Müller", "MÜLLER", " Weiß ", None], T.fold) == ["muller", "muller", "weiss", None]
    assert one(spark, ["Hanß  Roth"], T.fold_spaces) == ["hanss roth"]
    assert one(spark, ["Bäcker", "Roth"], T.fold_class) == ["baker", "rot"]
    assert one(spark, ["Weiß"], T.fold_vocab) == ["weiß"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="abzÄÖÜäöüßéèçñÊ aA", max_size=8), min_size=20, max_size=40))
def test_fold_equals_its_model(spark, words):
    model = lambda s: "".join(c for c in unicodedata.normalize("NFD", s.lower().strip(" ")) if unicodedata.category(c) != "Mn").replace("ß", "ss")
    assert one(spark, words, T.fold) == [model(w) for w in words]


@pytest.mark.parametrize(
    "book, some", [("Kochin", {"koch", "kochin"}), ("Kauffmännin", {"kauffmann"}), ("Fallerin", {"faller", "fallere", "fallerer"}), ("geb. Rothin", {"roth"})]
)
def test_candidates(spark, book, some):
    assert some <= set(one(spark, [book], T.name_candidates)[0])


def test_person_line(spark):
    lines = ["Christian Andreas Selger, Bürger und Weingärtner in Haberschlacht", "Catharina Friderika geb. Kochin von Haberschlacht", "Johann Georg Müller, Bauer", "weiland Hans Roth Bauer allhier", ""]
    a, b, c, d, e = one(spark, lines, T.person_line)
    assert (a["name"], a["job"], a["place"]) == ("Christian Andreas Selger", "Bürger und Weingärtner", "Haberschlacht")
    assert (b["born"], b["place"], b["name"]) == ("Kochin", "Haberschlacht", "Catharina Friderika")
    assert (c["place"], c["job"]) == (None, "Bauer")
    assert (d["remark"], d["name"], d["job"], d["place"]) == ("verstorben", "Hans Roth", "Bauer", "allhier")
    assert e["name"] is None


def test_split_name(spark):
    got = one(spark, ["Johann Georg Kröneck", "Johann Michael /von der Au/", "Roth", ""], T.split_name)
    assert [(x["given"], x["surname"]) for x in got] == [("Johann Georg", "Kröneck"), ("Johann Michael", "von der Au"), (None, "Roth"), (None, None)]


def test_given_names(spark):
    df = spark.createDataFrame([("Hans", "Johannes"), ("Anna Maria", "Maria"), ("Jacob", "Georg"), ("", "Georg"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(T.given_names_match(F.col("a"), F.col("b"))).collect()] == [True, True, False, False, False]


def test_similarity(spark):
    from difflib import SequenceMatcher

    df = spark.createDataFrame([("koch", "kochin"), ("a", None)], "a string, b string")
    assert [r[0] for r in df.select(T.similarity("a", "b")).collect()] == [SequenceMatcher(None, "koch", "kochin").ratio(), None]


def test_parse_date(spark):
    got = one(spark, ["23 FEB 1778", "23.02.1778", "9. Januar 1808", "FEB 1778", "1778", "um 1801 herum", "nie", None], D.parse_date)
    assert [x and (x["y"], x["m"], x["d"]) for x in got] == [(1778, 2, 23), (1778, 2, 23), (1808, 1, 9), (1778, 2, None), (1778, None, None), (1801, None, None), None, None]


def test_record_date(spark):
    got = one(spark, ["16.02.1808", "16. Februar 1808", "den 3ten May 1801", "ABT 1800", "(schon)", "?", ""], D.to_record_date)
    assert got == ["16 FEB 1808", "16 FEB 1808", "3 MAY 1801", "ABT 1800", "(schon)", "(?)", ""]


@pytest.mark.parametrize(
    "note, date",
    [("† 4.te Februar 1808", "4 FEB 1808"), ("gest. 3. 7ber 1811", "3 SEP 1811"), ("+ 12.3.09", "12 MAR 1809"), ("† 5. 8ber", "5 OCT 1820"), ("copul. 3. Mai 1830", None), ("4. Mai 1808", None), ("† 1833", "1833"), ("gestorben 2. Xber 1799", "2 DEC 1799")],
)
def test_death_note(spark, note, date):
    assert one(spark, [note], lambda c: D.death_note(c, F.lit(1820))) == [date]


def test_birth_from_age(spark):
    df = spark.createDataFrame([("31.03.1808", "53 Jahre, 1 Monat, 10 Tage"), ("31.03.1808", "65 Jahre"), ("1808", "65 Jahre"), ("31.03.1808", "alt"), ("05.01.1800", "3 Tage")], "ref string, age string")
    got = [r[0] for r in df.select(D.birth_from_age(D.parse_date(F.col("ref")), F.col("age"))).collect()]
    day = datetime.date(1755, 2, 28) - datetime.timedelta(10)
    assert [x and ((x["date"]["y"], x["date"]["m"], x["date"]["d"]), x["exact"]) for x in got] == [((day.year, day.month, day.day), True), ((1743, 3, 28), False), ((1743, None, None), False), None, ((1800, 1, 2), True)]


def test_middles_equal_sorted_lists(spark):
    import random

    from kinloom.operators import windows

    draw = random.Random(5)
    rows = [(draw.choice(("a", "a", "a", "b", None)), draw.choice((None, 1.5, 2.0, draw.random()))) for _ in range(500)] + [("one", 3.0), ("two", 1.0), ("two", 4.0), ("none", None)]
    got = {r["k"]: (r["n"], r["lower"], r["upper"]) for r in windows.middles(spark.createDataFrame(rows, "k string, v double").repartition(5), "k", "v").collect()}
    want = {}
    for k in {k for k, _ in rows}:
        values = sorted(v for x, v in rows if x == k and v is not None)
        if values:
            want[k] = (len(values), values[(len(values) - 1) // 2], values[len(values) // 2])
    assert got == want
