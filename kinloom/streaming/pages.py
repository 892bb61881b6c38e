"""Streams of page readings and of access lines.

Page readings arrive as one JSON file a page. Each micro-batch is written into a folder of its own number, in overwrite
mode, so a batch that is repeated after a failure replaces itself; ``current`` takes the newest reading of each
field. Access lines are counted in event-time windows and sessions behind a watermark.

Defined results: files that are no JSON, and pages without entries, give no rows; a field may be an object or a bare value;
lines that are no access lines are left out; lines later than the watermark are dropped by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Fixed names of the page format; fields stay text, since they are objects or bare values.
PAGE_SCHEMA = "eintraege array<struct<lfd_nr: string, jahr: int, band: string, felder: map<string, string>>>"
#: Fixed form of an access line: time, address(user), method, path, status.
ACCESS = r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d) ([^ (]+)(?:\(([^)]*)\))? ([A-Z]+) ([^ ?]+)\S* (\d{3})$"
KEY = ("page", "number", "field")


def readings(pages: DataFrame) -> DataFrame:
    """``page, number, year, field, value, book_form, confidence``: one row per field of each entry; ``page`` is the file."""
    entries = pages.select(F.col("_metadata.file_name").alias("page"), F.col("_metadata.file_modification_time").alias("read_at"), F.explode("eintraege").alias("e"))
    fields = entries.select("page", "read_at", F.col("e.lfd_nr").alias("number"), F.col("e.jahr").alias("year"), F.explode("e.felder").alias("field", "raw"))
    part = lambda name: F.get_json_object("raw", f"$.{name}")
    bare = F.when(~F.col("raw").startswith("{"), F.col("raw"))
    return fields.select(
        *KEY, "year", "read_at", F.coalesce(bare, part("wert")).alias("value"), part("kb").alias("book_form"), part("zuversicht").cast("double").alias("confidence")
    )


def read_pages(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """The readings of a folder as a stream; a page that is read again must come under a new path."""
    pages = spark.readStream.schema(PAGE_SCHEMA).option("multiLine", True).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return readings(pages)


def write_readings(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write all readings that are there, a folder ``batch=N`` for each micro-batch, then stop."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str) -> DataFrame:
    """The newest reading of each field; within a batch that of the file modified last."""
    newest = Window.partitionBy(*KEY).orderBy(F.col("batch").desc(), F.col("read_at").desc(), F.col("value").asc_nulls_last())
    return spark.read.parquet(target).withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") == 1).drop("_rank", "batch", "read_at")


def access_rows(lines: DataFrame) -> DataFrame:
    """``ts, address, user, method, path, status`` of a column ``value`` of access lines."""
    part = lambda k: F.nullif(F.regexp_extract("value", ACCESS, k), F.lit(""))
    return lines.where(F.col("value").rlike(ACCESS)).select(
        F.try_to_timestamp(part(1), F.lit("yyyy-MM-dd'T'HH:mm:ss")).alias("ts"), part(2).alias("address"), part(3).alias("user"), part(4).alias("method"),
        part(5).alias("path"), part(6).cast("int").alias("status"),
    ).where(F.col("ts").isNotNull())


def window_counts(rows: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """``start, path, n_requests, n_errors`` in tumbling windows."""
    counts = rows.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "path").agg(F.count("*").alias("n_requests"), F.count_if(F.col("status") >= 400).alias("n_errors"))
    return counts.select(F.col("w.start").alias("start"), "path", "n_requests", "n_errors")


def sessions(rows: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """``address, user, start, end, n_requests`` of visits without a pause of ``gap``."""
    visits = rows.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "address", "user").agg(F.count("*").alias("n_requests"))
    return visits.select("address", "user", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_requests")
