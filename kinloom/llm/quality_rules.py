"""Quality rules with a hashed n-gram log-likelihood ratio (operator 8, DataFrame functions only).

Base rules count words, characters, symbols, repeated lines and repeated three-word windows of the
whole text. The method hashes the words and word pairs of a text into ``BUCKETS`` buckets and
compares two multinomials over the buckets: a trusted target (all documents labelled
as good) and the raw corpus (all documents). A document's score is the sum of
log(p_target / p_raw) over its n-grams divided by their number; it is kept if the score is at least
``THRESHOLD``, every document by the same fixed rule.

Documents meet the good ids in a shuffled join; the ids are repeated ``SALTS`` times, so rows that share an id
(or have none) are dealt over several tasks. The bucket counts come from one pass with map-side combining (at most ``BUCKETS`` rows per task are
shuffled). The bucket weights, a fixed number of them, then become one literal array, so scoring is
a narrow projection without any shuffle.

Defined results: null text counts as no words, an empty table gives an empty result, rows with equal
ids stay separate rows, very long texts are read whole, a score equal to the threshold is kept, no usable labels give
weights of 0 (the base rules alone decide). Further columns pass through ``apply_rules`` untouched; a column that
bears the name of a result (``COLUMNS``) gives way to it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, WORD, read, text_of

#: Hash buckets of the multinomials; the scoring literal has this many numbers.
BUCKETS = 1 << 14
#: Parts into which the rows of one id are dealt where documents meet their labels.
SALTS = 8
#: Least length-normalised log-likelihood ratio of a kept document.
THRESHOLD = -0.05
#: Additive smoothing of the bucket counts.
SMOOTHING = 1.0
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a computed array that later lambdas index: a one-row generator keeps it from being inlined there."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _shift(kind: str, value: Column, bits: Column) -> Column:
    return F.call_function(kind, value, bits)


def with_hashes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``_h``, the 64-bit hashes of the words in order."""
    words = F.array_remove(F.split(text_of(text_col), BLANK), "")
    return _held(docs, "_h", F.transform(words, lambda x: F.xxhash64(x)))


def base_counts(hashed: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the base counts to rows that have ``_h``.

    Windows are compared by their hashes. Only a text in which some window occurs twice sorts its
    windows: hash and position are packed into one number, neighbours in that order are compared by
    the full hash, and the words under all repeated windows are counted once.
    """
    text = text_of(text_col)
    window = lambda i: F.xxhash64(F.get("_h", i), F.get("_h", i + 1), F.get("_h", i + 2))
    windows = F.when(F.size("_h") >= 4, F.transform(F.sequence(F.lit(0), F.size("_h") - 3), window)).otherwise(F.array().cast("array<bigint>"))
    bits = F.length(F.bin(F.size("_t").cast("bigint"))).cast("int")
    packed = F.transform(F.sequence(F.lit(0), F.size("_t") - 1), lambda i: _shift("shiftleft", F.get("_t", i), F.col("_bits")).bitwiseOR(i.cast("bigint")))
    repeated = F.size(F.array_distinct("_t")) < F.size("_t")
    place = lambda x: (x - _shift("shiftleft", _shift("shiftright", x, F.col("_bits")), F.col("_bits"))).cast("int")
    same = lambda x, y: (F.get("_t", place(x)) == F.get("_t", place(y))).eqNullSafe(F.lit(True))
    twice = F.filter(
        "_sorted", lambda x, j: same(x, F.when(j > 0, F.get("_sorted", j - 1))) | same(x, F.get("_sorted", j + 1))
    )
    under = F.flatten(F.transform(twice, lambda x: F.array(place(x), place(x) + 1, place(x) + 2)))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    out = (
        hashed.withColumn("n_words", F.size("_h").cast("bigint"))
        .withColumn("word_chars", F.char_length(F.regexp_replace(text, BLANK, "")).cast("bigint"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint"))
    )
    out = _held(out, "_lines", lines).withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint")).drop("_lines")
    out = _held(out, "_t", windows).withColumn("_bits", bits)
    out = _held(out, "_sorted", F.when(repeated, F.sort_array(packed)))
    return (
        out.withColumn("n_repeat_words", F.when(F.col("_sorted").isNull(), F.lit(0)).otherwise(F.size(F.array_distinct(under))).cast("bigint"))
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT))
        .drop("_t", "_bits", "_sorted")
    )


def _bucket(*hashes: Column) -> Column:
    return F.pmod(hashes[0] if len(hashes) == 1 else F.xxhash64(*hashes), F.lit(BUCKETS)).cast("int")


def ngram_buckets() -> Column:
    """Bucket numbers of all words and all pairs of neighbouring words, from ``_h``."""
    single = F.transform("_h", lambda x: _bucket(x))
    pair = F.transform(F.sequence(F.lit(0), F.size("_h") - 2), lambda i: _bucket(F.get("_h", i), F.get("_h", i + 1)))
    return F.concat(single, F.when(F.size("_h") >= 2, pair).otherwise(F.array().cast("array<int>")))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The ids of all documents labelled as good."""
    return labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def bucket_weights(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """log(p_target / p_raw) of every bucket, rounded to four decimals; all 0 without trusted documents."""
    trusted = trusted_ids(labels).select(F.col("doc_id").alias("_trusted"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_part"))
    dealt = docs.select(F.col(id_col).alias("_id"), F.col(text_col)).withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    flagged = dealt.join(trusted.hint("shuffle_hash"), (F.col("_id") == F.col("_trusted")) & (F.col("_salt") == F.col("_part")), "left")
    grams = with_hashes(flagged, text_col).select(F.col("_trusted").isNotNull().alias("good"), F.explode(ngram_buckets()).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("good").alias("good"))
    full = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").na.fill(0)
    rows = {r["bucket"]: (r["raw"], r["good"]) for r in full.collect()}  # BUCKETS rows, a fixed number
    raw_all = sum(r for r, _ in rows.values()) + SMOOTHING * BUCKETS
    good_sum = sum(g for _, g in rows.values())
    if not good_sum:
        return [0.0] * BUCKETS
    good_all = good_sum + SMOOTHING * BUCKETS
    return [round(math.log((rows[b][1] + SMOOTHING) / good_all) - math.log((rows[b][0] + SMOOTHING) / raw_all), 4) for b in range(BUCKETS)]


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns of ``docs`` with ``COLUMNS`` added."""
    weights = bucket_weights(docs, labels, id_col, text_col)
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<double>")  # folded to one literal
    single = F.aggregate("_h", F.lit(0.0), lambda acc, x: acc + F.get(table, _bucket(x)))
    pair = F.aggregate(F.sequence(F.lit(0), F.size("_h") - 2), F.lit(0.0), lambda acc, i: acc + F.get(table, _bucket(F.get("_h", i), F.get("_h", i + 1))))
    n_grams = F.greatest(F.col("n_words") * 2 - 1, F.lit(1))
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # no column can clash with those in between
    text_col, docs = at[text_col], docs.select(*[F.col(f"`{c}`").alias(n) for c, n in at.items()])
    judged = (
        base_counts(with_hashes(docs, text_col), text_col)
        .withColumn("score", F.round((single + F.when(F.size("_h") >= 2, pair).otherwise(F.lit(0.0))) / n_grams, 6))
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold)))
    )
    return judged.select(*[F.col(n).alias(c) for c, n in at.items() if c not in COLUMNS], *COLUMNS)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document."""
    out = apply_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", *COLUMNS)
