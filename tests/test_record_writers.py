"""Writers of line records: single records, continued files, bytes, excerpts."""

import pytest

from kinloom.sources import record_writers as W
from kinloom.sources.line_records import read_records

TEMPLATE = """0 HEAD
1 CHAR UTF-8
0 @I1@ INDI
1 NAME Johann /Roth/
1 FAMS @F1@
0 @I2@ INDI
1 NAME Anna /Koch/
1 BIRT
2 DATE 1750
2 SOUR @S1@
3 PAGE 4
1 FAMS @F1@
0 @F1@ FAM
1 HUSB @I1@
1 WIFE @I2@
0 @S1@ SOUR
1 TITL Book
1 REPO @R1@
0 @R1@ REPO
1 NAME Archive
0 TRLR
"""


@pytest.fixture(scope="module")
def tables(spark):
    make = spark.createDataFrame
    persons = make([(1, "@I1@", "Johann Roth", "Johann", "Roth", "M"), (2, "@I2@", "Anna Koch", "Anna", "Koch", "F"), (3, None, None, "Eva", "Roth", "F"), (4, None, "Only Name", None, None, None)], "id long, xref string, name string, givn string, surn string, sex string")
    families = make([(1, "@F1@", 1, 2), (2, None, None, 3)], "id long, xref string, husband long, wife long")
    children = make([(1, 3)], "family long, person long")
    forms = make([(3, "kb", "Eva /Rothin/"), (3, "rufname", "Evchen"), (3, "variante", "x")], "person long, kind string, value string")
    events = make([(2, 3, None, "OCCU", None, None, "weaver", None), (1, 3, None, "BIRT", "16. Februar 1808", "Oldtown", None, "p. 3"), (3, None, 2, "MARR", "?", None, "y", None)], "id long, person long, family long, kind string, date string, place string, value string, page string")
    attributes = make([(1, 3, None, "RESI", "Oldtown", 1), (2, 3, None, "BIRT.NOTE", "early", 1), (3, 3, None, "_KB_NAME", "x", 1), (4, None, 2, "NOTE", "n", 1)], "id long, person long, family long, tag string, value string, sort int")
    return W.with_xrefs(persons, "I"), W.with_xrefs(families, "F"), children, forms, events, attributes


def test_person_and_family_records(tables):
    persons, families, children, forms, events, attributes = tables
    got = {r["xref"]: r["raw"] for r in W.person_records(*tables).collect()}
    assert got["@I3@"].split("\n") == [
        "0 @I3@ INDI", "1 NAME Eva /Roth/", "2 GIVN Eva", "2 SURN Roth", "2 _KB_NAME Eva /Rothin/", "2 _RUFNAME Evchen", "1 SEX F", "1 BIRT", "2 DATE 16 FEB 1808", "2 PLAC Oldtown",
        "2 NOTE p. 3", "2 NOTE early", "1 _BERUF_KB weaver", "1 RESI", "2 PLAC Oldtown", "1 FAMC @F1@", "1 FAMS @F2@",
    ]
    assert got["@I4@"] == "0 @I4@ INDI\n1 NAME Only Name"
    family = {r["xref"]: r["raw"] for r in W.family_records(persons, families, children, events, attributes).collect()}
    assert family["@F1@"] == "0 @F1@ FAM\n1 HUSB @I1@\n1 WIFE @I2@\n1 CHIL @I3@"
    assert family["@F2@"] == "0 @F2@ FAM\n1 WIFE @I3@\n1 MARR\n2 DATE (?)\n1 NOTE n"


def test_continued_file(spark, tables, tmp_path):
    (tmp_path / "a.txt").write_text(TEMPLATE)
    template = read_records(spark, str(tmp_path)).select("seq", "xref", "typ", "raw")
    rows = W.continued(template, *tables).orderBy("part", "seq").collect()
    assert [(r["xref"], r["kind"]) for r in rows] == [
        (None, "passed"), ("@I1@", "passed"), ("@I2@", "passed"), ("@F1@", "extended"), ("@S1@", "passed"), ("@R1@", "passed"), ("@I3@", "person"), ("@I4@", "person"), ("@F2@", "family"), (None, "trailer"),
    ]
    assert rows[3]["raw"].endswith("1 WIFE @I2@\n1 CHIL @I3@")
    text = "\n".join(r["raw"] for r in rows) + "\n"
    assert all(line in text.split("\n") for line in TEMPLATE.split("\n"))
    # A second run over its own result changes nothing.
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "a.txt").write_text(text)
    again = W.continued(read_records(spark, str(tmp_path / "b")).select("seq", "xref", "typ", "raw"), *tables).collect()
    assert {r["kind"] for r in again} == {"passed", "trailer"}
    assert W.dead_pointers(read_records(spark, str(tmp_path / "b"))).count() == 0
    alone = W.rewritten(*tables).orderBy("part", "seq").collect()
    assert [r["xref"] for r in alone] == [None, "@I1@", "@I2@", "@I3@", "@I4@", "@F1@", "@F2@", None] and alone[-1]["raw"] == "0 TRLR"


@pytest.mark.parametrize("mark", ["", "\ufeff"])
@pytest.mark.parametrize("eol", ["\n", "\r\n"])
@pytest.mark.parametrize("last", [True, False])
def test_unchanged_files_are_identical(spark, tmp_path, mark, eol, last):
    text = TEMPLATE if last else TEMPLATE.rstrip("\n")
    (tmp_path / "a.txt").write_bytes((mark + text.replace("\n", eol)).encode())
    r = W.unchanged(spark, str(tmp_path)).collect()
    assert [(x["identical"], x["first_difference"]) for x in r] == [(True, None)]


def test_half_bytes_are_no_line_end(spark, tmp_path):
    """A blank before a letter of the bytes D0 A3 reads 20D0A3 in hexadecimal digits."""
    (tmp_path / "a.txt").write_bytes("0 HEAD\n1 NOTE \u0423\n0 TRLR\n".encode())
    assert [r["eol"] for r in W.file_properties(spark, str(tmp_path)).collect()] == ["lf"]
    assert [(r["identical"], r["first_difference"]) for r in W.unchanged(spark, str(tmp_path)).collect()] == [(True, None)]


def test_excerpt_leaves_the_parents_out(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 HEAD\n0 @I1@ INDI\n1 FAMC @F1@\n0 @I2@ INDI\n1 FAMS @F1@\n0 @F1@ FAM\n1 HUSB @I2@\n1 CHIL @I1@\n0 TRLR\n")
    records = read_records(spark, str(tmp_path))
    got = {r["xref"] or r["typ"]: r["raw"] for r in W.excerpt(records, spark.createDataFrame([("@I1@",)], "xref string")).collect()}
    assert got == {"HEAD": "0 HEAD", "@I1@": "0 @I1@ INDI", "TRLR": "0 TRLR"}


def test_first_difference(spark, tmp_path):
    mixed = TEMPLATE.replace("\n", "\r\n", 3).encode()  # both line ends in one file cannot be kept
    (tmp_path / "a.txt").write_bytes(mixed)
    r = W.unchanged(spark, str(tmp_path)).collect()[0]
    written = TEMPLATE.replace("\n", "\r\n").encode()
    assert not r["identical"] and r["first_difference"] == next(i for i, (a, b) in enumerate(zip(mixed, written)) if a != b)


def test_excerpt(spark, tmp_path):
    more = TEMPLATE.replace("0 @S1@", "0 @I9@ INDI\n1 NAME Other /Person/\n1 FAMC @F8@\n2 PEDI birth\n2 NOTE below\n1 SEX M\n0 @F8@ FAM\n1 HUSB @I1@\n1 CHIL @I7@\n0 @S1@")
    (tmp_path / "a.txt").write_text(more)
    records = read_records(spark, str(tmp_path))
    wanted = spark.createDataFrame([("@I2@",)], "xref string")
    got = {r["xref"] or r["typ"]: r["raw"] for r in W.excerpt(records, wanted).collect()}
    assert set(got) == {"HEAD", "TRLR", "@I1@", "@I2@", "@F1@", "@S1@", "@R1@"}
    assert got["@I2@"] == "0 @I2@ INDI\n1 NAME Anna /Koch/\n1 BIRT\n2 DATE 1750\n2 SOUR @S1@\n3 PAGE 4\n1 FAMS @F1@"
    got = {r["xref"] or r["typ"]: r["raw"] for r in W.excerpt(records, spark.createDataFrame([("@I9@",)], "xref string")).collect()}
    assert got["@I9@"] == "0 @I9@ INDI\n1 NAME Other /Person/\n1 SEX M", "a pointer to a family that does not hold the person is cut with its lines"
    assert W.dead_pointers(records).collect()[0]["target"] == "@I7@"
