"""Periodic runs of words by online dyadic square catching (operator 13).

Words are appended from left to right. As soon as an aligned block of 2^k words and its successor are complete, a
catcher of level k watches over the pair: each appended word advances its suffix comparison, which asks whether the last
2^(k+1) words equal the pair. The catcher lives for distances q with 2^k <= q < 2^(k+1), so each level has one catcher
for each place. Equal pairs at such a distance overlap or touch, so all words from the pair to the copy repeat
with distance q: a square is caught. It is extended to the left once and to the right as words come, until it
breaks; caught squares inside a stretch that is already known are the same run and merge into it. A stretch of at
least four periods holds a pair of blocks and its copy for the level of its period, so none is missed.

Comparisons use prefix sums of random word numbers (one subtraction for any length); every caught square is then compared
word by word, so equal sums of different words report nothing. Appending a stretch of words advances all catchers of a
level in one vector operation; what is carried from one append to the next is the text so far and the open squares.

A text is the work of one task, in time n log n and some 40 bytes a word; documents are never shuffled.

Defined results: null and empty texts have no words and no runs; repeated rows are read each; very long texts are read
whole; an empty table gives no rows; further columns are ignored. For the query a null id counts as an empty decimal.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, read, text_of

#: Shortest run in words and in periods; catchers see all runs of four periods and more.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words appended at once, and characters of texts that are read at once.
APPEND, READ_CHARS = 1 << 16, 1 << 20
_WORD = re.compile(WORD)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(numbers: np.ndarray) -> np.ndarray:
    """Random 64-bit numbers, one for each word number."""
    x = numbers.astype(np.uint64) * _ODD + np.uint64(0xD1B54A32D192ED03)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Catchers:
    """Squares of a growing sequence of word numbers."""

    def __init__(self, room: int) -> None:
        self.words = np.empty(room, dtype=np.int64)
        self.sums = np.zeros(room + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(room, _ODD)]).astype(np.uint64), dtype=np.uint64)
        self.n = 0
        self.squares: list[list[int]] = []  # start, end, period
        self.open: list[list[int]] = []  # those that reach the last word

    def append(self, words: np.ndarray, longest: int | None = None) -> None:
        """Append words; ``longest`` bounds the runs that are asked for, where the words end earlier than the room."""
        for at in range(0, len(words), APPEND):
            self._append(words[at : at + APPEND], longest if longest is not None else len(self.words))

    def _append(self, words: np.ndarray, longest: int) -> None:
        begin, self.n = self.n, self.n + len(words)
        self.words[begin : self.n] = words
        with np.errstate(over="ignore"):
            self.sums[begin + 1 : self.n + 1] = self.sums[begin] + np.cumsum(_mixed(words) * self.powers[begin : self.n], dtype=np.uint64)
        for square in self.open:
            square[1] += self._equal_on(square[1], square[2])
        self.open = [s for s in self.open if s[1] == self.n]
        level = 0
        while LEAST_PERIODS << level <= min(longest, self.n):
            self._advance(level, begin)
            level += 1

    def _advance(self, level: int, begin: int) -> None:
        """All suffix comparisons of a level that end in the words from ``begin`` on."""
        block, pair = 1 << level, 2 << level
        first = max(begin - pair + 1, block)
        if first > self.n - pair:
            return
        starts = np.arange(first, self.n - pair + 1)
        blocks = ((starts >> level) - 1) << level
        with np.errstate(over="ignore"):
            tail = self.sums[first + pair : self.n + 1] - self.sums[first : self.n - pair + 1]
            own = self.sums[blocks + pair] - self.sums[blocks]
            own *= self.powers[starts - blocks]
        hits = np.flatnonzero(tail == own)
        if not len(hits):
            return
        starts, blocks = starts[hits], blocks[hits]
        fresh = ~self._known(blocks, starts + pair, pair)
        starts, blocks = starts[fresh], blocks[fresh]
        periods = starts - blocks
        order = np.lexsort((blocks, periods))
        start, end = 0, 0
        for b, q in zip(blocks[order].tolist(), periods[order].tolist()):
            if start <= b and b + q + pair <= end:
                continue  # the same square, caught by the next pair of blocks
            length = self._equal_on(b + q, q)
            if length < pair:
                continue  # different words with equal sums
            start, end = b - self._equal_back(b, q), b + q + length
            square = [start, end, q]
            self.squares.append(square)
            if end == self.n:
                self.open.append(square)

    def _known(self, starts: np.ndarray, ends: np.ndarray, pair: int) -> np.ndarray:
        """Which stretches lie inside a square of a period below ``pair`` that was caught before.

        Such a stretch is as long as both periods together, so it repeats with a divisor of both: it is that square.
        """
        known = np.array([s for s in self.squares if s[2] < pair])
        if not len(known):
            return np.zeros(len(starts), dtype=bool)
        known = known[np.argsort(known[:, 0], kind="stable")]
        reach = np.maximum.accumulate(known[:, 1])
        at = np.searchsorted(known[:, 0], starts, side="right") - 1
        return (at >= 0) & (reach[np.maximum(at, 0)] >= ends)

    def _equal_on(self, at: int, distance: int) -> int:
        """How many words from ``at`` on equal the word ``distance`` before."""
        total, step = 0, 64
        while at < self.n:
            step = min(step, self.n - at)
            differ = self.words[at : at + step] != self.words[at - distance : at - distance + step]
            if (k := int(differ.argmax())) or differ[0]:
                return total + k
            total, at, step = total + step, at + step, step * 2
        return total

    def _equal_back(self, at: int, distance: int) -> int:
        """How many words before ``at`` equal the word ``distance`` after."""
        total, step = 0, 64
        while at > 0:
            step = min(step, at)
            differ = (self.words[at - step : at] != self.words[at - step + distance : at + distance])[::-1]
            if (k := int(differ.argmax())) or differ[0]:
                return total + k
            total, at, step = total + step, at - step, step * 2
        return total

    def runs(self) -> list[tuple[int, int, int]]:
        """``start, length, period`` of the runs so far, by start and period."""
        least: dict[tuple[int, int], int] = {}
        for start, end, period in self.squares:
            least[start, end] = min(period, least.get((start, end), period))
        found = [(start, end - start, q) for (start, end), q in least.items() if end - start >= max(LEAST_WORDS, LEAST_PERIODS * q)]
        return sorted(found, key=lambda r: (r[0], r[2]))


def runs_of_texts(texts: list[list[str]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words; the lists share the catchers, with a word of its own after each."""
    numbers: dict[str, int] = defaultdict(itertools.count().__next__)
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))  # levels end with the longest text that can need them
    catchers = Catchers(sum(map(len, texts)) + len(texts))
    begins, waiting, size, longest = [], [], 0, 0
    for k, i in enumerate(order):
        begins.append(catchers.n + size)
        longest, size = longest or len(texts[i]), size + len(texts[i]) + 1
        waiting.append(np.fromiter(map(numbers.__getitem__, texts[i]), dtype=np.int64, count=len(texts[i])))
        waiting.append(np.array([-1 - k], dtype=np.int64))
        if size >= APPEND or k == len(order) - 1:
            catchers.append(np.concatenate(waiting), longest)
            waiting, size, longest = [], 0, 0
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    at = np.array(begins)
    for start, length, period in catchers.runs():
        k = int(np.searchsorted(at, start, side="right")) - 1
        out[order[k]].append((start - begins[k], length, period))
    return out


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return list(itertools.compress(words, keep.tolist()))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prepare: Callable[[list[str], object], list[str]] | None = None) -> DataFrame:
    """``doc_id, n_words, runs array<struct<start, length, period>>, collapsed`` of every row.

    ``prepare`` may change a text's words, given with its id, before they are read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def read_group(ids: list, texts: list[str]) -> tuple[list, list, list]:
        words = [_WORD.findall(t) for t in texts]
        if prepare is not None:
            words = [prepare(w, i) for w, i in zip(words, ids)]
        runs = runs_of_texts(words)
        found = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
        return [len(w) for w in words], found, [" ".join(collapsed(w, r)) for w, r in zip(words, runs)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum([len(x) if (x := t.as_buffer()) is not None else 0 for t in batch.column("_text")])
            at = 0
            while at < batch.num_rows:
                past = sizes[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(sizes, past + READ_CHARS, side="right")))
                part = batch.slice(at, end - at)
                n, found, texts = read_group(part.column("doc_id").to_pylist(), part.column("_text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(found, kind), pa.array(texts, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"]
                )
                at = end

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {id_type}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def looped(words: list[str], doc_id: object) -> list[str]:
    """The contract's change: in every tenth document by hash the words from one place on repeat a stretch."""
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def strongest(runs):
    """The run with most periods, compared as fractions; the first of equals, null without runs."""
    longer = lambda best, x: x["length"] * best["period"] > best["length"] * x["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, x: F.when(longer(best, x), x).otherwise(best))


def op13_word_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of all documents, after the contract's change, with digests of the runs and of the collapsed texts."""
    found = detect(read(spark, sf_dir, "documents"), prepare=looped).withColumn("best", strongest(F.col("runs")))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
