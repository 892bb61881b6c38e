"""Periodic runs of words against a plain search."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinloom.llm import runs

SF_DIR = "/root/testdata/sf0.001"


def plain_runs(words):
    """Every stretch of one period that no neighbour extends, with its smallest period."""
    n, least = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            least.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in least.items() if e - s >= max(6, 4 * q))


def plain_looped(words, doc_id):
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def sequences():
    draw = random.Random(7)
    yield from ([], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 7, ["a", "b"] * 3, ["a", "b"] * 4, ["x"] + ["a", "b"] * 4 + ["a"], ["a"] * 200)
    for _ in range(300):
        letters = draw.choice((1, 2, 2, 3, 8))
        out = []
        while len(out) < draw.choice((10, 40, 150, 400)):
            stretch = [str(draw.randrange(letters)) for _ in range(draw.choice((1, 2, 3, 5, 9, 17, 33)))]
            out += stretch * draw.choice((1, 1, 2, 4, 5, 12))
            if draw.random() < 0.5:
                out += stretch[: draw.randrange(len(stretch) + 1)]
        yield out


@pytest.mark.parametrize("append", [1, 5, 64, 1 << 16])
def test_runs_equal_a_plain_search(append, monkeypatch):
    monkeypatch.setattr(runs, "APPEND", append)
    cases = list(sequences())
    cases = cases if append > 1 else cases[:60]
    assert sum(len(plain_runs(w)) for w in cases) > 50
    for words in cases:
        assert runs.runs_of_texts([words]) == [plain_runs(words)], words
    assert runs.runs_of_texts(cases) == [plain_runs(w) for w in cases]


def test_catchers_report_a_square_as_soon_as_it_is_there():
    draw = np.random.default_rng(3)
    words = np.concatenate([draw.integers(100, 10_000, 50), np.tile(draw.integers(0, 50, 13), 9), draw.integers(100, 10_000, 40)])
    catchers, seen = runs.Catchers(len(words)), []
    for w in words:
        catchers.append(np.array([w]))
        seen.append(catchers.runs())
    assert seen[-1] == [(50, 117, 13)]
    first = next(k for k, s in enumerate(seen) if s)
    assert first <= 50 + 5 * 13 and seen[first][0][::2] == (50, 13)
    assert not catchers.open


def test_equal_sums_of_different_words_report_nothing(monkeypatch):
    monkeypatch.setattr(runs, "_mixed", lambda x: np.zeros(len(x), dtype=np.uint64))  # all sums are equal
    for words in list(sequences())[:40]:
        assert runs.runs_of_texts([words]) == [plain_runs(words)]


def test_long_texts_take_little_time():
    words = ["a", "b", "c"] * 100_000 + [str(i) for i in range(100_000)] + ["z"] * 200_000
    assert runs.runs_of_texts([words]) == [[(0, 300_000, 3), (400_000, 200_000, 1)]]


def plain_row(doc_id, text):
    words = plain_looped([w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w], doc_id)
    found = plain_runs(words)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    return (doc_id, len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], digest("".join(f"{s},{n},{q}\n" for s, n, q in found)), digest(kept))


def columns(r):
    return tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"))


def test_query_equals_a_plain_search(spark):
    docs = [r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: columns(r) for r in runs.op13_word_runs(spark, SF_DIR).collect()}
    assert len(got) == len(docs)
    short = [d for d in docs if len(d["text"] or "") < 12_000]
    assert len(short) > 150 and sum(got[d["doc_id"]][1] > 0 for d in short) > 5
    for d in short:
        assert got[d["doc_id"]] == plain_row(*d), d["doc_id"]


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(runs, "READ_CHARS", 50)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b " * 5), (4, "a b " * 5), (None, "x " * 9), (5, "ü ü " * 7 + "q"), (6, "é"), (7, "w " * 3000)]
    docs = spark.createDataFrame([(*r, 9, 9) for r in rows], "doc_id long, text string, runs int, collapsed int")
    got = runs.detect(docs).collect()
    assert sorted((str(r["doc_id"]), [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got) == sorted(
        [("1", [], ""), ("2", [], ""), ("3", [], ""), ("4", [(0, 10, 2)], "a b"), ("4", [(0, 10, 2)], "a b"), ("None", [(0, 9, 1)], "x"), ("5", [(0, 7, 1)], "ü ü q"), ("6", [], "é"), ("7", [(0, 3000, 1)], "w")]
    )
    assert runs.detect(docs.where(F.lit(False))).count() == 0
