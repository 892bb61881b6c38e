"""Mixing sources to target weights (operator 4).

Every document gets a hash-random key. Keys are cut into equal ranges ("buckets") whose number
follows the row count of the source, so a bucket holds about ``BUCKET_ROWS`` documents however hot its source is. Word counts are
summed by (source, bucket) with map-side combining; a prefix sum over those sums finds, for each
source, the single bucket in which its budget ends. Only the documents of these cut buckets are
sorted and prefix-summed one by one; all others are taken whole or not at all by comparing their
bucket with the cut. Where a target exceeds the source's size, whole epochs come first.

Defined results: null text has size 0, null source is a source of its own (after all others), rows
with equal ids and texts are separate rows, very long texts are counted whole, an empty table gives an empty result,
columns named in ``keep`` pass through, others do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, read

#: Documents in a bucket, on average.
BUCKET_ROWS = 2000
#: Neighbouring buckets that are summed together first, so a prefix sum runs over rows / (BUCKET_ROWS * GROUP_BUCKETS) sums.
GROUP_BUCKETS = 1024
#: Most sources whose plans are broadcast.
BROADCAST_SOURCES = 10_000
#: Weights of the sources in code point order, repeated.
WEIGHTS = (3, 1, 2)
#: Share of all words that the mix takes, and the most often that a source is repeated.
SHARE, MAX_EPOCHS = 1.5, 2.0
_KEY_SPACE = 1 << 60


def hash_key(*columns: Column) -> Column:
    """A uniform 60-bit key from md5, the same in every run and in other SQL engines."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("mix"), *parts)), 1, 15), 16, 10).cast("bigint")


def word_count(column: str = "text") -> Column:
    """Number of words of the whole text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to one row per source (``source``, ``source_size``).

    The level L with sum(min(most * size, L * weight)) = share * sum(size) is the fixed point of
    capping sources and sharing the excess by weight. Sources are ranked by the level at which they
    reach their cap; prefix sums over that ranking give L in closed form. The windows run over one
    row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rn") - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = (
        sources.withColumn("rn", F.row_number().over(by_name))
        .withColumn("weight", pick)
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("level", F.col("cap") / F.col("weight"))
    )
    up = Window.orderBy("level", "rn").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = (
        weighed.withColumn("capped", F.coalesce(F.sum("cap").over(up), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(up), F.lit(0.0)))
        .withColumn("goal", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("reach", (F.col("goal") - F.col("capped")) / F.col("weight_left"))
    )
    # The first source whose own level is not below the common level fixes that level.
    common = F.min(F.when(F.col("reach") <= F.col("level"), F.struct("level", "rn", "reach"))).over(everything)["reach"]
    return (
        ranked.withColumn("common", common)
        .withColumn("target", F.least("cap", F.coalesce(F.col("common") * F.col("weight"), F.col("cap"))))
        .select("source", "source_size", "n_rows", "target")
    )


def _ending(sums: DataFrame, by: str, *others: str) -> DataFrame:
    """The row of each source in which its ``rest`` ends, with the sum ``before`` it; rows are in order of ``by``."""
    before = Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    ends = (F.col("before") <= F.col("rest")) & (F.col("before") + F.col("size") > F.col("rest"))
    found = sums.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).where(ends)
    return found.groupBy("source").agg(F.min(F.struct(by, "before", *others)).alias("c")).select("source", "c.*")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken`` and the columns of ``keep``.

    ``taken`` counts the words of the document that the mix takes, repeats included. The last
    document of a source's budget is taken in part, so that a source's taken words equal its target
    rounded to whole words.
    """
    keyed = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(text_col).alias("size"),
        hash_key(F.col(id_col), F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("key"),
        *[F.col(k).alias(f"keep_{k}") for k in keep],
    )
    base = cut(keyed.select("doc_id", "source", "size", "key"))  # texts are not written here, they are read again at the end
    sources = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    plan = cut(
        source_targets(sources)
        .withColumn("budget", F.round("target").cast("bigint"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint"))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
        .withColumn("n_buckets", F.ceil(F.col("n_rows") / F.lit(BUCKET_ROWS)).cast("bigint"))
    )
    bucket = F.floor(F.col("key").cast("double") / F.lit(float(_KEY_SPACE)) * F.col("n_buckets")).cast("bigint")
    # One row per source; sent to all tasks only where their number is checked to be small, so texts need no shuffle.
    sent = F.broadcast if plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else (lambda rows: rows)
    placing = lambda rows: rows.join(sent(plan.withColumnRenamed("source", "plan_source")), F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source").withColumn("bucket", bucket)
    sums = cut(placing(base).groupBy("source", "bucket").agg(F.sum("size").alias("size"), F.first("rest").alias("rest")).withColumn("group", F.floor(F.col("bucket") / F.lit(GROUP_BUCKETS))))
    # Two levels of prefix sums: over groups of buckets, then over the buckets of the one group in which the budget ends.
    in_group = _ending(sums.groupBy("source", "group").agg(F.sum("size").alias("size"), F.first("rest").alias("rest")), "group").select(
        F.col("source").alias("g_source"), F.col("group").alias("g_group"), F.col("before").alias("g_before")
    )
    inner = sums.join(in_group, F.col("source").eqNullSafe(F.col("g_source")) & (F.col("group") == F.col("g_group"))).withColumn("rest", F.col("rest") - F.col("g_before"))
    cuts = cut(_ending(inner, "bucket", "g_before").select(F.col("source").alias("cut_source"), F.col("bucket").alias("cut_bucket"), (F.col("before") + F.col("g_before")).alias("cut_before")))
    rows = placing(keyed if keep else base)
    placed = rows.join(sent(cuts), F.col("source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source")
    out = [F.col(c) for c in ("doc_id", "source", "size", "source_size", "target")]
    kept = [F.col(f"keep_{k}").alias(k) for k in keep if k not in ("doc_id", "source", "size")]
    whole = F.col("epochs") * F.col("size")
    at_cut = F.col("bucket").eqNullSafe(F.col("cut_bucket"))
    # Without a cut bucket the rest is 0 or the source is taken whole in the last epoch.
    plain = placed.where(~at_cut).withColumn(
        "taken", whole + F.when(F.col("bucket") < F.col("cut_bucket"), F.col("size")).otherwise(F.lit(0))
    )
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("cut_before") - F.coalesce(F.sum("size").over(inside), F.lit(0))
    edge = placed.where(at_cut).withColumn("taken", whole + F.greatest(F.lit(0), F.least(F.col("size"), left)))
    return plain.select(*out, F.col("taken").cast("bigint"), *kept).unionByName(edge.select(*out, F.col("taken").cast("bigint"), *kept))


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    """The mix of all ``documents``."""
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: DuckDB's form of the same mix: the plain prefix sum over every document of a source.
OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         ('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS key
  FROM documents),
s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rn FROM d GROUP BY source),
w AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, rn, CAST([3, 1, 2][(rn - 1) % 3 + 1] AS DOUBLE) AS weight,
             2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, cap / weight AS level FROM w),
r AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
                 - coalesce(sum(cap) OVER (ORDER BY level, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY level, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS reach FROM l),
c AS (SELECT arg_min(reach, (level, rn)) AS common FROM r WHERE reach <= level),
t AS (SELECT source, source_size, least(cap, coalesce(common * weight, cap)) AS target FROM r, c),
p AS (SELECT *, CAST(round(target) AS BIGINT) AS budget FROM t),
q AS (SELECT d.doc_id, d.size, p.source_size, p.target,
             CASE WHEN p.source_size > 0 THEN p.budget // p.source_size ELSE 0 END AS epochs, p.budget,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM q
"""
