"""GEDCOM 7: export, declared extension tags, findings against a walk over the lines."""

import pytest

from kinloom.sources import gedcom7 as G
from kinloom.sources import record_writers as W

SHAPE = "source string, seq long, xref string, typ string, raw string"


@pytest.fixture(scope="module")
def tables(spark):
    make = spark.createDataFrame
    persons = make([(1, "@I1@", "Johann Roth", "Johann", "Roth", "M"), (2, "@I2@", "Anna Koch", "Anna", "Koch", "w"), (3, None, None, "Eva", "Roth", "F"), (4, None, None, None, None, None)], "id long, xref string, name string, givn string, surn string, sex string")
    families = make([(1, "@F1@", 1, 2), (2, None, None, 3)], "id long, xref string, husband long, wife long")
    children = make([(1, 3)], "family long, person long")
    forms = make([(3, "kb", "Eva /Rothin/"), (3, "rufname", "Evchen")], "person long, kind string, value string")
    events = make(
        [(1, 3, None, "BIRT", "16. Februar 1808", "Oldtown", None, "p. 3"), (2, 3, None, "OCCU", None, None, "weaver", None), (3, 3, None, "OCCU", None, None, None, None), (4, 3, None, "DEAT", "vor Ostern", None, "stillborn", None), (5, None, 2, "MARR", None, None, None, "@home\nnext")],
        "id long, person long, family long, kind string, date string, place string, value string, page string",
    )
    attributes = make([(1, 3, None, "RESI", "Oldtown", 1), (2, 3, None, "BIRT.NOTE", "early", 1), (3, 3, None, "_KB_NAME", "x", 1), (4, None, 2, "NOTE", "n", 1), (5, 3, None, "BURI", "at dawn", 2)], "id long, person long, family long, tag string, value string, sort int")
    return W.with_xrefs(persons, "I"), W.with_xrefs(families, "F"), children, forms, events, attributes


def test_export(tables):
    rows = G.export7(*tables, note="Book of Oldtown").orderBy("part", "seq").collect()
    got = {r["xref"] or r["typ"]: r["raw"].split("\n") for r in rows}
    assert got["HEAD"] == [
        "0 HEAD", "1 GEDC", "2 VERS 7.0", "1 SCHMA", "2 TAG _BERUF_KB https://example.org/tags/_beruf_kb", "2 TAG _KB_NAME https://example.org/tags/_kb_name",
        "2 TAG _RUFNAME https://example.org/tags/_rufname", "1 SOUR kinloom", "2 NAME kinloom", "1 NOTE Book of Oldtown",
    ]
    assert got["@I3@"] == [
        "0 @I3@ INDI", "1 NAME Eva /Roth/", "2 GIVN Eva", "2 SURN Roth", "2 _KB_NAME Eva /Rothin/", "2 _RUFNAME Evchen", "1 SEX F", "1 BIRT", "2 DATE 16 FEB 1808", "2 PLAC Oldtown", "2 NOTE p. 3", "2 NOTE early",
        "1 _BERUF_KB weaver", "1 DEAT", "2 NOTE stillborn", "2 DATE", "3 PHRASE vor Ostern", "1 RESI", "2 PLAC Oldtown", "1 BURI", "2 NOTE at dawn", "1 FAMC @F1@", "1 FAMS @F2@",
    ]
    assert got["@I2@"][:4] == ["0 @I2@ INDI", "1 NAME Anna /Koch/", "2 GIVN Anna", "2 SURN Koch"] and "1 SEX w" not in got["@I2@"]
    assert got["@I4@"] == ["0 @I4@ INDI", "1 NAME"]
    assert got["@F2@"] == ["0 @F2@ FAM", "1 WIFE @I3@", "1 MARR", "2 NOTE @@home", "3 CONT next", "1 NOTE n"]
    assert [r["typ"] for r in rows] == ["HEAD", *["INDI"] * 4, *["FAM"] * 2, "TRLR"]


def numbered(spark, rows):
    return spark.createDataFrame([("s", i, r["xref"], r["typ"], r["raw"]) for i, r in enumerate(rows)], SHAPE)


def test_an_export_has_no_findings_and_the_older_form_has(spark, tables):
    rows = G.export7(*tables).orderBy("part", "seq").collect()
    assert G.validate(numbered(spark, rows)).collect() == []
    made = W.rewritten(*tables).orderBy("part", "seq").collect()
    old = spark.createDataFrame([("s", i, r["xref"], r["raw"].split(" ", 2)[-1].split("\n")[0] if r["xref"] else r["raw"].split("\n")[0][2:], r["raw"]) for i, r in enumerate(made)], SHAPE)
    got = {r["cause"]: (r["n"], r["example"]) for r in G.validate(old).collect()}
    assert got.pop("not a line") == (1, "")  # the older writer does not continue a value on a second line
    assert got == {
        "extension tag _KB_NAME is not declared in HEAD.SCHMA": (1, "INDI @I3@ > NAME > _KB_NAME"), "extension tag _RUFNAME is not declared in HEAD.SCHMA": (1, "INDI @I3@ > NAME > _RUFNAME"),
        "extension tag _BERUF_KB is not declared in HEAD.SCHMA": (1, "INDI @I3@ > _BERUF_KB"), "DEAT has text; only Y or nothing is allowed": (1, "INDI @I3@ > DEAT"), "BURI has text; only Y or nothing is allowed": (1, "INDI @I3@ > BURI"),
        "GEDC is missing": (1, "HEAD"),
    }


CASES = [
    ("0 @I1@ INDI\n1 NAME A\n3 GIVN B\n1 SEX M", "level jumps", "GIVN"),
    ("0 @I1@ INDI\n1 GIVN B", "GIVN has no place here", "INDI @I1@ > GIVN"),
    ("0 @I1@ INDI\n1 SEX M\n1 SEX F", "more than one SEX", "INDI @I1@"),
    ("0 @I1@ INDI\n1 FAMS Roth", "FAMS needs a pointer", "INDI @I1@ > FAMS"),
    ("0 @I1@ INDI\n1 FAMS @F9@", "pointer without a record", "INDI @I1@ > FAMS"),
    ("0 @I1@ INDI\n1 FAMS @I1@", "FAMS points at a record of another kind", "INDI @I1@ > FAMS"),
    ("0 @I1@ INDI\n1 NAME @I1@", "NAME has a pointer and needs text", "INDI @I1@ > NAME"),
    ("0 @I1@ INDI\n1 EVEN x", "TYPE is missing", "INDI @I1@ > EVEN"),
    ("0 @I1@ INDI\n1 BIRT\n2 PLAC x\n3 MAP y\n4 LATI N1\n4 LONG E1", "MAP has a value and may have none", "INDI @I1@ > BIRT > PLAC > MAP"),
    ("0 @I1@ INDI\n1 @X@ SEX M", "id below a record", "INDI @I1@ > SEX"),
    ("0 @I1@ INDI\n1 SEX M\nrubbish", "not a line", ""),
    ("0 @S1@ SNOTE text\n1 CONT more\n1 CONC more", "CONC has no place here", "SNOTE @S1@ > CONC"),
    ("0 @X1@ _OWN a", "extension tag _OWN is not declared in HEAD.SCHMA", "_OWN @X1@"),
]


def test_each_cause(spark):
    rows = []
    for k, (text, _, _) in enumerate(CASES):
        first = text.split("\n")[0].split(" ")
        rows += [(str(k), 1, None, "HEAD", "0 HEAD\n1 GEDC\n2 VERS 7.0"), (str(k), 2, first[1], first[2], text), (str(k), 3, None, "TRLR", "0 TRLR")]
    got = G.validate(spark.createDataFrame(rows, SHAPE)).collect()
    assert sorted((int(r["source"]), r["cause"], r["n"], r["example"]) for r in got) == [(k, cause, 1, example) for k, (_, cause, example) in enumerate(CASES)]


def test_clean_structures_and_the_ends_of_a_file(spark):
    head = "0 HEAD\n1 GEDC\n2 VERS 7.0\n1 SCHMA\n2 TAG _OWN http://a"
    person = "0 @I1@ INDI\n1 BIRT Y\n2 DATE\n3 PHRASE x\n2 _OWN y\n3 SEX nobody asks\n1 ASSO @VOID@\n2 ROLE OTHER\n1 NOTE a\n2 CONT b\n1 SOUR @S1@\n2 DATA\n3 DATE 1 JAN 1800\n3 TEXT x"
    clean = [("s", 1, None, "HEAD", head), ("s", 2, "@I1@", "INDI", person), ("s", 3, "@S1@", "SOUR", "0 @S1@ SOUR\n1 TITL Book"), ("s", 4, None, "TRLR", "0 TRLR")]
    odd = [("o", *r[1:]) for r in clean[1:3]] + [("o", 5, "@I1@", "INDI", "0 @I1@ INDI"), ("t", 1, None, None, "")]
    got = {(r["source"], r["cause"]) for r in G.validate(spark.createDataFrame(clean + odd, SHAPE)).collect()}
    ends = {(s, c) for s in "ot" for c in ("the file does not start with HEAD", "the file does not end with TRLR")}
    assert got == ends | {("o", "id of two records"), ("o", "extension tag _OWN is not declared in HEAD.SCHMA"), ("t", "not a line")}
    assert G.validate(spark.createDataFrame([], SHAPE)).collect() == []


def test_lines_without_a_finding_are_not_shuffled(spark):
    """200 records with 60 events of three lines each: 36,200 lines, of which only the doubled one and the pointers are looked up."""
    body = "\n".join(["0 @I{}@ INDI", *["1 BIRT\n2 DATE 1 JAN 1800\n2 PLAC x"] * 60, "1 SEX M", "1 SEX F", "1 SEX M", "1 FAMS @F1@"])
    rows = [("s", 0, None, "HEAD", "0 HEAD\n1 GEDC\n2 VERS 7.0"), *[("s", k, f"@I{k}@", "INDI", body.format(k)) for k in range(1, 201)], ("s", 201, "@F1@", "FAM", "0 @F1@ FAM"), ("s", 202, None, "TRLR", "0 TRLR")]
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: store.stageList(None, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")())
    before = {stages().apply(k).stageId() for k in range(stages().size())}
    got = {(r["cause"], r["n"], r["example"]) for r in G.validate(spark.createDataFrame(rows, SHAPE)).collect()}
    assert got == {("more than one SEX", 200, "INDI @I1@")}
    now = stages()
    assert sum(s.shuffleWriteRecords() for s in map(now.apply, range(now.size())) if s.stageId() not in before) < 3000
