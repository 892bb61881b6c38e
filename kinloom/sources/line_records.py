"""Line-record files: every line is ``level [@id@] TAG [value]``, a record starts at level 0.

Reading keeps each record's lines as they stand, carriage returns included, so writing unchanged records gives the
same lines. Spark's text reader drops a byte order mark; ``write_records(mark=True)`` puts it back. The writer ends
every file with a line end. Files are read in splits. The number of a record is the number of
record starts in the earlier splits of its file, summed by split, plus those before it in its own split; so no
task holds more than a split, and a record may run over the end of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_START = r"^0(?: |\r|$)"
_HEAD = r"^0 (?:(@[^@]+@) )?([^ \r\n]+)"
_LINE = r"^[ ]*([0-9]+) (?:(@[^@]+@) )?([^ \r]+)(?: ([^\r]*))?"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``source, block, pos, line``: ordered by block and pos within a source; an empty file has no lines."""
    rows = spark.read.text(path, lineSep="\n")
    return rows.select(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"),
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``source, seq, xref, typ, raw``: one row per record, ``seq`` from 1 within a source.

    Lines before the first level-0 line form record 0, which has no ``typ``.
    """
    lines = read_lines(spark, path).withColumn("starts", F.col("line").rlike(_START).cast("bigint"))
    blocks = lines.groupBy("source", "block").agg(F.sum("starts").alias("n"))
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("source", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("own", F.sum("starts").over(inside)).join(offsets, ["source", "block"]).withColumn("seq", F.col("before") + F.col("own"))
    text = F.sort_array(F.collect_list(F.struct("block", "pos", "line")))
    records = numbered.groupBy("source", "seq").agg(F.array_join(F.transform(text, lambda x: x["line"]), "\n").alias("raw"))
    part = lambda k: F.nullif(F.regexp_extract("raw", _HEAD, k), F.lit(""))
    return records.select("source", "seq", part(1).alias("xref"), part(2).alias("typ"), "raw")


def record_lines(records: DataFrame) -> DataFrame:
    """``source, seq, n, level, xref, tag, value`` of every line; lines that are none have null in the last four."""
    lines = records.select("source", "seq", F.posexplode(F.split("raw", "\n")).alias("n", "line"))
    part = lambda k: F.nullif(F.regexp_extract("line", _LINE, k), F.lit(""))
    return lines.select("source", "seq", "n", part(1).cast("int").alias("level"), part(2).alias("xref"), part(3).alias("tag"), part(4).alias("value"))


def write_records(records: DataFrame, path: str, mark: bool = False) -> None:
    """The records in order of source and seq as text; the part files in order of their names are the file.

    ``mark``: the first record of each source starts with a byte order mark.
    """
    if mark:
        records = records.withColumn("raw", F.when(F.col("seq") == 1, F.concat(F.lit("\ufeff"), "raw")).otherwise(F.col("raw")))
    records.repartitionByRange("source", "seq").sortWithinPartitions("source", "seq").select("raw").write.text(path, lineSep="\n")
