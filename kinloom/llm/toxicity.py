"""Toxicity scores by a classifier with counterfactual regularisation (operator 11).

A document is described by how often its words have each feature: the words themselves and their beginnings of
``BEGINNINGS`` letters, in lower case; a feature's value grows with the logarithm of its share of the words, so one insult counts
in a short text and a stem that a long text holds by chance hardly does. Features that labelled toxic texts hold significantly more often (a share ``RATIO``
times as large and a log-likelihood ratio of at least ``EVIDENCE``) enter a logistic regression.

Counterfactuals: in every sampled text that names a group of people (``IDENTITY_TERMS``), the term is swapped for each of
the next ``SWAPS`` terms of its kind, and the loss adds ``PENALTY`` times the squared change of the
score. A term that only happens to stand in toxic texts so gets the weight of its kind as a whole, which neutral mentions hold near 0,
while words that insult keep theirs. Both labels weigh the same in the fit; scores are moved so that even odds lie at ``CUT``.

The fit uses a bounded sample of labelled rows, at most ``SAMPLE_ROWS`` of each label in the order of a hash of the id, and never
held-out rows; at most ``FEATURES`` features (the most significant) enter the model, which is broadcast. Scoring is one narrow pass
over the whole texts of all documents.

Defined results: null and empty texts have no features and get the score that follows; without both labels every
score is 0; rows labelled both ways count for both; repeated rows are scored each; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, read, text_of

SAMPLE_ROWS, FEATURES, CUT = 4000, 4096, 0.3
BEGINNINGS, EVIDENCE, RATIO = range(3, 10), 15.0, 2.0
PENALTY, SWAPS, RIDGE, ROUNDS = 10.0, 3, 1e-4, 400
PER_WORDS, PRIOR_WORDS = 300, 20
#: Words whose features a task remembers.
MEMORY = 400_000
_WORD = re.compile(r"\w+")

#: Terms for groups of people, by kind and language; a term is swapped within its line.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"),
    ("muslims", "jews", "christians", "hindus", "buddhists", "atheists"), ("muslim", "jewish", "christian", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "bisexual", "transgender", "straight", "queer"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("immigrants", "refugees", "foreigners", "natives"), ("disabled", "deaf", "blind", "elderly", "young"),
    ("frauen", "männer", "mädchen", "jungen"), ("muslime", "juden", "christen", "hindus", "buddhisten", "atheisten"),
    ("ausländer", "flüchtlinge", "einwanderer", "einheimische"),
    ("femmes", "hommes", "filles", "garçons"), ("musulmans", "juifs", "chrétiens", "hindous", "bouddhistes", "athées"),
    ("étrangers", "réfugiés", "immigrés"),
    ("mujeres", "hombres", "chicas", "chicos"), ("musulmanes", "judíos", "cristianos", "hindúes", "budistas", "ateos"),
    ("extranjeros", "refugiados", "inmigrantes"),
)


def swaps(terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> dict[str, tuple[str, ...]]:
    """The other terms of each term's kind, from the next one on."""
    return {t: line[k + 1 :] + line[:k] for line in terms for k, t in enumerate(line)}


def word_features(word: str) -> list[str]:
    """The word and its beginnings (``x*``)."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def value(count: int, n_words: int) -> float:
    """What a feature counts that ``count`` of a text's words have."""
    return math.log1p(PER_WORDS * count / (n_words + PRIOR_WORDS))


def held_out(doc_id: Column) -> Column:
    """Whether a row belongs to the fold that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, bound: int = SAMPLE_ROWS) -> DataFrame:
    """``_label_id, toxic, text`` of at most ``bound`` labelled rows of each label."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", "toxic").distinct()
    part = lambda y: usable.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    sample = part(0).unionByName(part(1)).withColumnRenamed("doc_id", "_label_id")
    known = docs.join(F.broadcast(sample), F.col(id_col) == F.col("_label_id"))  # at most 2 * bound rows
    return cut(known.select("_label_id", "toxic", text_of(text_col).alias("text")))


def feature_counts(rows: DataFrame) -> DataFrame:
    """``feature, n_toxic, n_clean``: in how many sampled texts of each label a feature is."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for batch in batches:
            for y, text in zip(batch.column("toxic").to_pylist(), batch.column("text")):
                counts[y].update({f for w in set(words_of(text.as_py())) for f in word_features(w)})
        every = list(counts[0].keys() | counts[1].keys())
        for at in range(0, len(every), 10_000):
            part = every[at : at + 10_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.string()), pa.array([counts[1][f] for f in part], pa.int64()), pa.array([counts[0][f] for f in part], pa.int64())], names=["feature", "n_toxic", "n_clean"]
            )

    parts = rows.select("toxic", "text").mapInArrow(work, "feature string, n_toxic bigint, n_clean bigint")
    return parts.groupBy("feature").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))


def chosen_features(counts: DataFrame, n_toxic: int, n_clean: int, bound: int = FEATURES) -> list[str]:
    """The features that toxic texts hold significantly more often, the most significant first."""
    a, b = F.col("n_toxic"), F.col("n_clean")
    expected = (a + b) / (n_toxic + n_clean)
    part = lambda seen, n: F.when(seen > 0, seen * F.log(seen / (expected * n))).otherwise(0.0)
    evidence = 2 * (part(a, n_toxic) + part(b, n_clean))
    found = counts.where(a * n_clean >= RATIO * b * n_toxic).withColumn("evidence", evidence).where(F.col("evidence") >= EVIDENCE)
    return [r["feature"] for r in found.orderBy(F.desc("evidence"), "feature").limit(bound).collect()]  # bounded


def sample_matrix(rows: DataFrame, features: list[str], terms: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``_row, toxic, swapped, has, value``: the chosen features of each sampled text with their values, and of its
    counterfactuals (``swapped`` > 0, the number of the text's swap; ``_row`` tells the texts apart)."""
    place = {f: k for k, f in enumerate(features)}
    terms = swaps() if terms is None else terms

    def valued(words: Counter, n: int) -> tuple[list[int], list[float]]:
        counts = Counter()
        for w, k in words.items():
            for f in word_features(w):
                if f in place:
                    counts[place[f]] += k
        return sorted(counts), [value(counts[f], n) for f in sorted(counts)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, y, text in zip(batch.column("_row").to_pylist(), batch.column("toxic").to_pylist(), batch.column("text")):
                words = Counter(words_of(text.as_py()))
                n = words.total()
                out.append((row, y, 0, *valued(words, n)))
                named = [w for w in words if w in terms]
                for k in range(SWAPS if named else 0):
                    other = Counter({w: c for w, c in words.items() if w not in terms})
                    for w in named:
                        other[terms[w][k % len(terms[w])]] += words[w]
                    out.append((row, y, k + 1, *valued(other, n)))
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["_row", "toxic", "swapped", "has", "value"])

    ready = rows.select(F.concat_ws(":", "_label_id", "toxic", F.sha2("text", 256)).alias("_row"), F.col("toxic").cast("int"), "text")
    return ready.mapInArrow(work, "_row string, toxic int, swapped int, has array<int>, value array<double>")


def fit_weights(sample: pa.Table, n_features: int, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """(weights, intercept) of the logistic loss with equal weight of both labels, ridge and counterfactual penalty."""
    toxic, swapped = sample.column("toxic").to_numpy(), sample.column("swapped").to_numpy()
    lists = sample.column("has").combine_chunks()
    row, col = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
    values = sample.column("value").combine_chunks().flatten().to_numpy()
    n = len(toxic)
    score = lambda w: np.bincount(row, weights=w[col] * values, minlength=n)
    back = lambda g: np.bincount(col, weights=g[row] * values, minlength=n_features)
    real = swapped == 0
    texts: dict[str, int] = {}
    for k in np.flatnonzero(real).tolist():
        texts[sample.column("_row")[k].as_py()] = k
    other = np.flatnonzero(~real)
    origin = np.array([texts[sample.column("_row")[k].as_py()] for k in other.tolist()], dtype=np.int64)
    weight = np.where(real, np.where(toxic == 1, 0.5 / max(1, (real & (toxic == 1)).sum()), 0.5 / max(1, (real & (toxic == 0)).sum())), 0.0)
    w, bias = np.zeros(n_features), 0.0
    # Adagrad's scaled steps; the problem is convex and small.
    sum_w, sum_b = np.full(n_features, 1e-12), 1e-12
    for _ in range(ROUNDS):
        s = score(w)
        slope = weight * (1 / (1 + np.exp(-np.clip(s + bias, -50, 50))) - toxic)
        change = np.zeros(n)
        if len(other):
            d = 2 * penalty / len(other) * (s[other] - s[origin])
            change[other] += d
            np.add.at(change, origin, -d)
        g_w, g_b = back(slope + change) + RIDGE * w, slope.sum()
        sum_w, sum_b = sum_w + g_w**2, sum_b + g_b**2
        w, bias = w - 0.3 * g_w / np.sqrt(sum_w), bias - 0.3 * g_b / math.sqrt(sum_b)
    return w, bias


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", penalty: float = PENALTY, terms: dict[str, tuple[str, ...]] | None = None) -> tuple[dict[str, float], float]:
    """(weight of each feature, sum of weights at even odds); no features where one of the labels is missing."""
    rows = training_rows(docs, labels, id_col, text_col)
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return {}, math.inf
    features = chosen_features(feature_counts(rows), n[1], n[0])
    if not features:
        return {}, math.inf
    sample = sample_matrix(rows, features, terms).toArrow()  # bounded: texts of the sample, chosen features only
    weights, bias = fit_weights(sample, len(features), penalty)
    model = {f: float(w) for f, w in zip(features, weights)}
    return model, -bias


def score(docs: DataFrame, model: dict[str, float], middle: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_text"))
    names = list(model)
    weights, place = np.array([model[f] for f in names]), {f: k for k, f in enumerate(names)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, tuple[int, ...]] = {}

        def places(word: str) -> tuple[int, ...]:
            if len(memory) >= MEMORY:
                memory.clear()
            found = memory[word] = tuple(place[f] for f in word_features(word) if f in place)
            return found

        for batch in batches:
            margins = []
            for text in batch.column("_text"):
                words, counts = words_of(text.as_py()), {}
                for w in words:
                    found = memory.get(w)
                    if found is None:
                        found = places(w)
                    for f in found:
                        counts[f] = counts.get(f, 0) + 1
                margins.append(math.fsum(weights[f] * value(k, len(words)) for f, k in counts.items()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(margins, pa.float64())], names=["doc_id", "_margin"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    margin = F.col("_margin") - F.lit(middle) + F.lit(math.log(CUT / (1 - CUT)))
    probability = 1 / (1 + F.exp(-margin)) if math.isfinite(middle) else F.lit(0.0)
    scored = rows.mapInArrow(work, f"doc_id {kind}, _margin double").withColumn("score", probability)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op11_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    docs = read(spark, sf_dir, "documents")
    model, middle = train(docs, read(spark, sf_dir, "labels"))
    return score(docs, model, middle)
