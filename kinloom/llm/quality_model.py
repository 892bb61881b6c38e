"""Quality scores from pairwise preferences (operator 5).

A document is described by a few ratios of its whole text. Preference pairs put a good labelled document before
a bad one; the Bradley-Terry model P(good beats bad) = sigmoid(w . (x_good - x_bad)) is a logistic
regression without intercept on feature differences, fitted by Spark ML. The cut is the quantile
of the training scores that best separates the labels; scores are moved so that the cut lies at ``CUT``.

The fit uses a bounded sample of labelled rows, at most ``SAMPLE_ROWS`` of each label in the order of
a hash of the id, and never held-out rows. Scoring is one narrow pass over all documents.

Defined results: null and empty texts have all features 0 and get the score that follows; without
both labels every score is ``CUT``; repeated rows are scored each; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import math
import operator
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, read, text_of

SAMPLE_ROWS, PAIRS_PER_ROW, CUT = 8000, 4, 0.3
_SYMBOL = re.compile(r"[^\w\s]")
_MARK = re.compile(r"[#*$%&|<>!]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile(r"[0-9]")
FEATURES = ("length", "word_length", "symbols", "marks", "upper", "digits", "distinct", "repeats", "dup_lines", "short")


def features(text: str) -> list[float]:
    """Ratios of the whole text, each between 0 and about 1."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, chars = len(words), len(text) + 20  # a capital and a full stop are not much of a short text
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        min(math.log1p(n) / 10, 1.0),
        min(sum(map(len, words)) / n / 20, 2.0),
        math.sqrt(len(_SYMBOL.findall(text)) / chars),
        math.sqrt(len(_MARK.findall(text)) / chars),
        math.sqrt(len(_UPPER.findall(text)) / chars),
        math.sqrt(len(_DIGIT.findall(text)) / chars),
        math.log(len(set(words))) / math.log(n) if n > 1 else 1.0,
        sum(map(operator.eq, words, words[1:])) / n,
        1 - len(set(lines)) / len(lines),
        1.0 if n < 50 else 0.0,
    ]


def with_features(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` and ``x array<double>`` of every row."""
    rows = docs.select(*keep, text_of(text_col).alias("_text"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([features(t.as_py()) for t in batch.column("_text")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], x], names=[*keep, "x"])

    return rows.mapInArrow(work, f"{head}, x array<double>")


def held_out(doc_id: Column) -> Column:
    """Whether a row belongs to the fold that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, bound: int = SAMPLE_ROWS) -> DataFrame:
    """``quality, rank, x`` of at most ``bound`` labelled rows of each label."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", "quality").distinct()
    part = lambda q: usable.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    sample = part(0).unionByName(part(1)).withColumnRenamed("doc_id", "_label_id")
    known = docs.join(F.broadcast(sample), F.col(id_col) == F.col("_label_id"))  # at most 2 * bound rows
    return cut(with_features(known.select("_label_id", "quality", text_col), text_col, ["_label_id", "quality"]))


def fit(rows: DataFrame) -> tuple[list[float], float]:
    """(weights, cut on the scores) of the Bradley-Terry model."""
    spark = rows.sparkSession
    sample = rows.select("quality", "x", "_label_id").orderBy("quality", F.xxhash64("_label_id"), "_label_id").toPandas()  # bounded
    x = np.array(sample["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    good, bad = x[sample["quality"] == 1], x[sample["quality"] == 0]
    if not len(good) or not len(bad):
        return [0.0] * len(FEATURES), 0.0
    draw = np.random.default_rng(5)
    n = PAIRS_PER_ROW * max(len(good), len(bad))
    i, j = draw.integers(0, len(good), n), np.arange(n) % len(bad)
    difference = good[i] - bad[j]
    sign = np.where(np.arange(n) % 2 == 0, 1.0, -1.0)  # either order of a pair says the same
    pairs = spark.createDataFrame(
        pa.table({"label": (sign > 0).astype(float), "x": pa.array((difference * sign[:, None]).tolist(), pa.list_(pa.float64()))})
    ).select("label", array_to_vector("x").alias("features"))
    model = LogisticRegression(fitIntercept=False, regParam=1e-4, maxIter=100).fit(cut(pairs))
    weights = model.coefficients.toArray()
    scores, quality = x @ weights, sample["quality"].to_numpy()
    levels = np.unique(np.quantile(scores, np.linspace(0, 1, 1001)))
    middle = (levels[1:] + levels[:-1]) / 2 if len(levels) > 1 else levels
    right = [((scores >= m) & (quality == 1)).sum() / len(good) + ((scores < m) & (quality == 0)).sum() / len(bad) for m in middle]
    best = np.flatnonzero(np.array(right) >= max(right) - 1e-12)
    return weights.tolist(), float(middle[best].mean()) if best[-1] - best[0] == len(best) - 1 else float(middle[best[0]])


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    weights, middle = fit(training_rows(docs, labels, id_col, text_col))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    raw = F.aggregate(F.zip_with("x", F.array(*[F.lit(w) for w in weights]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    margin = raw - F.lit(middle) + F.lit(math.log(CUT / (1 - CUT)))
    probability = 1 / (1 + F.exp(-margin))
    return with_features(base, "text", ["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), probability.alias("score"), (probability >= CUT).cast("int").alias("predicted")
    )


def op5_quality_model(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
