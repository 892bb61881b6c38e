from pathlib import Path

from kinloom.sources.line_records import read_records, record_lines, write_records

BODY = "0 HEAD\n1 CHAR UTF-8\n0 @I1@ INDI\n1 NAME Anna /Example/\n2 GIVN Anna\n0 @F1@ FAM\n1 WIFE @I1@\n0 TRLR\n"


def test_records_round_trip(spark, tmp_path):
    many = BODY + "".join(f"0 @N{i}@ NOTE\n1 CONT line {i}\n" for i in range(3000))
    cases = [(BODY, False), (BODY, True), (BODY.replace("\n", "\r\n"), True), (many, False), ("stray\n0 HEAD\n", False)]
    for k, (text, mark) in enumerate(cases):
        folder = tmp_path / str(k)
        folder.mkdir()
        whole = ("\ufeff" if mark else "") + text
        (folder / "a.txt").write_bytes(whole.encode())
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")  # several splits
        try:
            records = read_records(spark, str(folder))
            rows = records.orderBy("seq").collect()
            write_records(records, str(folder / "out"), mark)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert "".join(r["raw"] + "\n" for r in rows) == text
        written = b"".join(p.read_bytes() for p in sorted(Path(folder / "out").glob("part-*")))
        assert written == whole.encode()


def test_heads_and_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text(BODY)
    records = read_records(spark, str(tmp_path))
    assert [(r["seq"], r["xref"], r["typ"]) for r in records.orderBy("seq").collect()] == [(1, None, "HEAD"), (2, "@I1@", "INDI"), (3, "@F1@", "FAM"), (4, None, "TRLR")]
    lines = record_lines(records).where("seq = 2").orderBy("n").collect()
    assert [(r["level"], r["xref"], r["tag"], r["value"]) for r in lines] == [(0, "@I1@", "INDI", None), (1, None, "NAME", "Anna /Example/"), (2, None, "GIVN", "Anna")]


def test_empty_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("")
    assert read_records(spark, str(tmp_path)).count() == 0
