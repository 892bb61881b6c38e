"""Window operators: chronology, neighbours, best against runner-up, clusters, periods, as-of lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed


def chronology(df: DataFrame, key: list[str], order: list[Column], value: str) -> DataFrame:
    """Add the value before and after each row of its group: ``before``, ``after``."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("before", F.lag(value).over(w)).withColumn("after", F.lead(value).over(w))


def refuted(df: DataFrame, value: str) -> DataFrame:
    """Rows whose value lies outside the interval of its neighbours."""
    return df.where((F.col(value) < F.col("before")) | (F.col(value) > F.col("after")))


def first_per(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def best_against_second(df: DataFrame, key: list[str], score: str, tie: list[Column], lead: int = 2) -> DataFrame:
    """The best candidate of each group with ``ambiguous``: the runner-up is within ``lead`` points."""
    w = Window.partitionBy(*key).orderBy(F.col(score).desc(), *tie)
    return (
        df.withColumn("_rn", F.row_number().over(w)).withColumn("second", F.lead(score).over(w)).where("_rn = 1").drop("_rn")
        .withColumn("ambiguous", F.coalesce(F.col(score) <= F.col("second") + lead, F.lit(False)))
    )


def line_clusters(df: DataFrame, key: list[str], value: str, tolerance: float) -> DataFrame:
    """Clusters of sorted values whose distance to the last member is at most ``tolerance``: one row per cluster."""
    w = Window.partitionBy(*key).orderBy(value)
    new = F.when(F.col(value) - F.lag(value).over(w) <= tolerance, 0).otherwise(1)
    marked = df.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*key, "cluster").agg(F.count("*").alias("n"), F.min(value).alias("first"), F.max(value).alias("last"), F.avg(value).alias("middle"))


def periods(df: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Runs of equal values in order: one row per run."""
    w = Window.partitionBy(*key).orderBy(order)
    new = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & F.lag(order).over(w).isNotNull(), 0).otherwise(1)
    marked = df.withColumn("_new", new).withColumn("period", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*key, "period", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str) -> DataFrame:
    """For each left row the right ``value`` of the latest ``right_time`` that is not later.

    Both sides are put into one ordered stream per key and the last right value is carried forward:
    one shuffle and no pairs, however many rows a key has on either side.
    """
    names = left.columns
    stream = left.select("*", F.lit(None).cast(right.schema[right_time].dataType).alias("_rt"), F.lit(None).cast(right.schema[value].dataType).alias("_rv"), F.lit(1).alias("_side"), F.col(left_time).alias("_t")).unionByName(
        right.select(*[F.lit(None).cast(left.schema[c].dataType).alias(c) if c != key else F.col(key) for c in names], F.col(right_time).alias("_rt"), F.col(value).alias("_rv"), F.lit(0).alias("_side"), F.col(right_time).alias("_t"))
    )
    w = Window.partitionBy(key).orderBy("_t", "_side", F.col("_rv").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    held = stream.withColumn("as_of", F.last(F.when(F.col("_side") == 0, F.struct("_rt", "_rv")), ignorenulls=True).over(w))
    return held.where("_side = 1").select(*names, F.col("as_of._rt").alias("as_of_time"), F.col("as_of._rv").alias("as_of_value"))


def middles(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key, n, lower, upper``: the two middle values of each key (the same one for an odd number); nulls do not count.

    Exact ranks without a list of a key's values: equal values are counted together, the counts are dealt into ranges of key
    and value, sums per key and range tell the range of a middle, and only that range is summed value by value. A key may so hold all rows.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("_key"), F.col(value).alias("_value")).agg(F.count("*").alias("_c"))
    dealt = checkpointed(counts.repartitionByRange("_key", "_value").withColumn("_range", F.spark_partition_id()))
    up = Window.partitionBy("_key").orderBy("_range")  # a row for each range that the key is in
    sums = dealt.groupBy("_key", "_range").agg(F.sum("_c").alias("_rows")).withColumn("_before", F.sum("_rows").over(up) - F.col("_rows")).withColumn("n", F.sum("_rows").over(Window.partitionBy("_key")))
    wanted = F.explode(F.array(F.floor((F.col("n") - 1) / 2) + 1, F.floor(F.col("n") / 2) + 1))
    place = sums.withColumn("_want", wanted).where((F.col("_before") < F.col("_want")) & (F.col("_want") <= F.col("_before") + F.col("_rows"))).distinct()
    place = place.select(F.col("_key").alias("_k"), F.col("_range").alias("_r"), "_before", "_want", "n")
    inside = Window.partitionBy("_range", "_key", "_want").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    near = dealt.join(place, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_range") == F.col("_r"))).withColumn("_upto", F.col("_before") + F.sum("_c").over(inside))
    found = near.where((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_c") < F.col("_want")))
    return found.groupBy("_key").agg(F.first("n").alias("n"), F.min("_value").alias("lower"), F.max("_value").alias("upper")).withColumnRenamed("_key", key)


def rmse(a: Column, b: Column) -> Column:
    """Root mean squared difference of two vectors."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2))), F.lit(0.0), lambda s, x: s + x) / F.size(a))


def leading_int(c: Column) -> Column:
    """The whole number that a text begins with; 0 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"^\s*([+-]?\d+)", 1), F.lit("")).try_cast("int"), F.lit(0))
