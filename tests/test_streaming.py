import json

from kinloom.streaming import pages


def page(folder, name, value, book=None):
    field = {"wert": value, "kb": book, "zuversicht": 0.9} if book else value
    (folder / name).write_text(json.dumps({"eintraege": [{"lfd_nr": "11", "jahr": 1808, "felder": {"child": field}}]}, indent=1))


def run(spark, tmp_path):
    stream = pages.read_pages(spark, str(tmp_path / "in") + "/*")
    query = pages.write_readings(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert query.awaitTermination(60)
    return sorted((r["page"], r["number"], r["year"], r["field"], r["value"], r["book_form"]) for r in pages.current(spark, str(tmp_path / "out")).collect())


def test_pages_are_read_once_and_replaced(spark, tmp_path):
    first, second = tmp_path / "in" / "1", tmp_path / "in" / "2"
    first.mkdir(parents=True)
    page(first, "a.json", "Anna", "Annam")
    page(first, "b.json", "Johann")
    (first / "c.json").write_text('{"eintraege": []}')
    (first / "d.json").write_text("no page")
    assert run(spark, tmp_path) == [("a.json", "11", 1808, "child", "Anna", "Annam"), ("b.json", "11", 1808, "child", "Johann", None)]
    second.mkdir()
    page(second, "b.json", "Johannes")
    assert run(spark, tmp_path)[1] == ("b.json", "11", 1808, "child", "Johannes", None)
    assert len(list((tmp_path / "out").glob("batch=*"))) == 2


LINES = [
    "2026-08-17T10:00:00 1.2.3.4(anna) GET /api/x?y 200",
    "2026-08-17T10:09:59 1.2.3.4(anna) GET /api/x 404",
    "2026-08-17T10:10:00 1.2.3.4(anna) GET /api/x 200",
    "2026-08-17T12:00:00 1.2.3.4(anna) POST /api/z 200",
    "no access line",
    "2026-99-99T12:00:00 1.2.3.4 GET /api/x 200",
]


def test_access_windows_and_sessions(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.log").write_text("\n".join(LINES))
    still = pages.access_rows(spark.read.text(str(tmp_path / "log")))
    expected = [("10:00", "/api/x", 2, 1), ("10:10", "/api/x", 1, 0), ("12:00", "/api/z", 1, 0)]
    seen = lambda df: sorted((r["start"].strftime("%H:%M"), r["path"], r["n_requests"], r["n_errors"]) for r in df.collect())
    assert seen(pages.window_counts(still)) == expected
    assert sorted((r["user"], r["start"].hour, r["n_requests"]) for r in pages.sessions(still).collect()) == [("anna", 10, 3), ("anna", 12, 1)]
    stream = pages.window_counts(pages.access_rows(spark.readStream.text(str(tmp_path / "log"))))
    query = stream.writeStream.format("memory").queryName("access_counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert seen(spark.table("access_counts")) == expected
