from kinloom.sources import register_tables as tables
from kinloom.sources.line_records import read_records

TEXT = """0 HEAD
0 @I1@ INDI
1 NAME Anna Maria /Example/
2 GIVN Anna Maria
2 _KB_NAME Anna /Exampel/
2 _RUFNAME Anna
1 NAME Anna /Beispiel/
1 SEX F
1 BIRT
2 DATE ABT 12 MAR 1778
2 PLAC Oldtown
2 SOUR @S1@
3 PAGE p. 4
1 OCCU weaver
0 @I2@ INDI
1 NAME Johann /Muster/
2 SURN Muster
0 @I1@ INDI
1 NAME Other /Person/
0 INDI
1 NAME No Id
0 @I3@ INDI
0 @F1@ FAM
1 HUSB @I2@
1 WIFE @I1@
1 CHIL @I3@
1 CHIL @I3@
1 CHIL @I9@
1 MARR
2 DATE 1799
0 TRLR
"""


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_tables(spark, tmp_path):
    (tmp_path / "a.txt").write_text(TEXT)
    parts = tables.blocks(read_records(spark, str(tmp_path))).cache()
    people = tables.persons(parts)
    assert rows(people, "xref", "name", "givn", "surn", "sex") == sorted(
        [
            ("@I1@", "Anna Maria Example", "Anna Maria", "Example", "F"), ("@I2@", "Johann Muster", "Johann", "Muster", None),
            ("@I3@", None, None, None, None), (None, "No Id", "No Id", None, None),
        ],
        key=str,
    )
    forms = rows(tables.name_forms(parts).where("xref = '@I1@'"), "kind", "value")
    assert forms == [
        ("kb", "Anna /Exampel/"), ("rufname", "Anna"), ("surn", "Beispiel"), ("surn", "Exampel"), ("surn", "Example"), ("surn", "Person"), ("variante", "Anna /Beispiel/"),
    ]
    assert rows(tables.families(parts, people), "xref", "husband", "wife") == [("@F1@", "@I2@", "@I1@")]
    assert rows(tables.children(parts, people), "family", "person") == [("@F1@", "@I3@")]
    assert rows(tables.events(parts), "person", "family", "kind", "date", "year", "exact", "place", "value", "page") == sorted(
        [
            ("@I1@", None, "BIRT", "ABT 12 MAR 1778", 1778, False, "Oldtown", None, "p. 4"), ("@I1@", None, "OCCU", None, None, True, None, "weaver", None),
            (None, "@F1@", "MARR", "1799", 1799, True, None, None, None),
        ],
        key=str,
    )


def test_no_records(spark, tmp_path):
    (tmp_path / "a.txt").write_text("")
    parts = tables.blocks(read_records(spark, str(tmp_path)))
    people = tables.persons(parts)
    assert [d.count() for d in (people, tables.name_forms(parts), tables.families(parts, people), tables.children(parts, people), tables.events(parts))] == [0] * 5
