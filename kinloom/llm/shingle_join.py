"""N-gram Jaccard join with signature trees (operator 6).

Documents are sets of hashed word shingles; two documents link when
100 * |A and B| >= percent * |A or B|. The join is exact and runs in five steps.

1. One pass gives each document its set size and a 128-bit digest of its set (documents with equal
   sets are one class from here on), and counts shingles in a sketch of ``SKETCH`` counters. The sketch has a fixed
   size and only orders shingles from rare to frequent; any order gives the same links.
2. The rarest shingles of a set, as many as two linked sets cannot both miss, route it into signature trees: one tree for
   each shingle. The first shingle that two linked sets share brings them into one tree, where they share no more
   than what follows it in both (the reach).
3. A tree node holds the OR of the token bitmaps below it, its size range, its slack (tokens that share a bit) and its
   largest reach. Two nodes can hold a link only if the bits they share with the slack, and the reach, come up to the overlap that the
   sizes demand. Rows are leaves of ``LEAF``, ``FAN`` nodes make a node of the next level; two traversals at once go
   down from the root into the surviving pairs of nodes only. Trees are built twice: inside each task before the shuffle, so that a
   group of near copies leaves a task as one node however large it is, and again where the nodes of a tree meet.
   Surviving pairs of rows become candidate edges, but only where earlier edges do not connect them already. The tree of a shingle
   of very many documents is split into trees of pairs of its parts.
4. Connected components of the candidate edges confine all links.
5. Inside a component the real sets are compared. Small components are packed together; large ones are cut into blocks by size and
   hash, each compared within itself and with a few pivots of the component. Only documents that are then
   not yet connected with the largest part of their component meet the others of suitable size: first as marks of ``MARK``
   counters, whose common part is at least the overlap, then, where a pair can still link, with their sets.

Every step writes spanning edges, so no group is ever expanded into its pairs.

Defined results: null or empty text has an empty set and links with nothing; a document with fewer words
than a shingle has one shingle, its whole sequence; repeated rows each get a result; rows of one id with
different texts are each linked by their own text, and texts with the same smallest id share a component; a
null id links with nothing; very long texts are hashed whole, in one task each; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, read, text_of
from .graph import components

WORDS, PERCENT = 5, 80
SKETCH, SKETCH_PARTS = 1 << 20, 64
#: Bits of a node's bitmap; sets above ``BITMAP_SIZE`` shingles would fill it and have none.
BITS, BITMAP_SIZE = 128, 512
#: Rows that a task collects before it builds nodes, classes it remembers, words whose hashes it keeps.
HELD, SEEN, WORD_HASHES = 100_000, 200_000, 200_000
#: Rows of a leaf, children of a node, pairs of leaves compared at once, rows of a tree of a frequent shingle.
LEAF, FAN, PAIRS, TREE_ROWS = 32, 8, 64, 100_000
#: Documents of a block, shingles of a block, pivots of a large component.
BLOCK_DOCS, BLOCK_SHINGLES, PIVOTS = 256, 400_000, 4
#: Places of the bitmap of candidates' ids, a fixed 2 MB; an id that shares its place with a candidate only costs a shuffled text.
PLACES = 1 << 24
#: Counters of a set's mark, documents whose marks meet in one group.
MARK, MARK_DOCS = 1024, 2048
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class _Hashes(dict):
    """Word -> 64-bit hash, with a bound on its size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORD_HASHES:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, words: int, hashes: _Hashes) -> np.ndarray:
    """Sorted distinct shingle hashes of the whole text; ASCII letters are lower-cased."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    if len(tokens) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(tokens), seed=len(tokens))], dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    n = len(tokens) - words + 1
    total = np.zeros(n, dtype=np.uint64)
    for k in range(words):
        total = total * _MIX[0] + h[k : k + n]
    return np.unique(_mixed(total))


def mark(own: np.ndarray) -> bytes:
    """Shingles of each of ``MARK`` classes, 255 at most; those beyond are the slack of :func:`overlap_bounds`."""
    counts = np.bincount(((own >> np.uint64(20)) & np.uint64(MARK - 1)).astype(np.int64), minlength=MARK)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def overlap_bounds(one: np.ndarray, size: int, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The largest overlap that a set of this mark and size can have with each of the others."""
    common = np.minimum(others, one).sum(axis=1, dtype=np.int32)
    slack = sizes - others.sum(axis=1, dtype=np.int32)
    return common + np.minimum(slack, size - int(one.sum(dtype=np.int64)))


def _digest(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def _packed(counters: np.ndarray) -> bytes:
    """Counters as compressed bytes: a task with few texts leaves most of them 0."""
    return zlib.compress(np.minimum(counters, 2**31).astype(np.uint32).tobytes(), 1)


def _unpacked(counters: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(counters), dtype=np.uint32)


def _bytes(column: pa.Array) -> Iterator[bytes]:
    return (x.as_py() or b"" for x in column.cast(pa.binary()))


# Step 1 ------------------------------------------------------------------------------------------


def signatures(docs: DataFrame, words: int) -> tuple[DataFrame, np.ndarray]:
    """(``doc_id, text_key, n, h`` of every row, the counters of the sketch)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counters = _Hashes(), np.zeros(SKETCH, dtype=np.int64)
        schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.binary()), ("n", pa.int64()), ("h", pa.binary()), ("part", pa.int32()), ("counts", pa.binary())])
        for batch in batches:
            sizes, digests = [], []
            for text in _bytes(batch.column(2)):
                own = shingles(text, words, hashes)
                sizes.append(len(own))
                digests.append(_digest(own) if len(own) else None)
                counters += np.bincount((own & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) if len(own) > SKETCH // 8 else 0
                if len(own) <= SKETCH // 8:
                    np.add.at(counters, (own & np.uint64(SKETCH - 1)).astype(np.int64), 1)
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema)
        for part, counts in enumerate(np.split(counters, SKETCH_PARTS)):
            row = {"doc_id": None, "text_key": None, "n": None, "h": None, "part": part, "counts": _packed(counts)}
            yield pa.RecordBatch.from_pylist([row], schema=schema)

    both = cut(docs.select("doc_id", "text_key", text_of("text").cast("binary").alias("text")).mapInArrow(work, "doc_id bigint, text_key binary, n bigint, h binary, part int, counts binary"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}  # SKETCH counters at most, however many rows come
        for batch in batches:
            for part, x in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                total = totals.setdefault(part, np.zeros(SKETCH // SKETCH_PARTS, dtype=np.uint64))
                total += _unpacked(x)
        rows = [{"part": k, "counts": _packed(v)} for k, v in totals.items()]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("part", pa.int32()), ("counts", pa.binary())]))

    # Two rounds: the rows of a part, one from each task, are first added up in many places.
    counts = both.where(F.col("part").isNotNull()).select("part", "counts")
    salt = F.pmod(F.spark_partition_id(), F.lit(8))
    partly = counts.repartition("part", salt).mapInArrow(add, "part int, counts binary")
    summed = partly.repartition("part").mapInArrow(add, "part int, counts binary")
    counters = np.zeros(SKETCH, dtype=np.uint32)
    step = SKETCH // SKETCH_PARTS
    for r in summed.collect():  # SKETCH counters, a fixed number
        counters[r["part"] * step : (r["part"] + 1) * step] = _unpacked(r["counts"])
    return both.where(F.col("part").isNull()).select("doc_id", "text_key", "n", "h"), counters


# Steps 2 and 3 -----------------------------------------------------------------------------------

#: Columns of tree nodes: tree, head, bitmap, least and largest set size packed into one number, slack and reach into another.
#: In memory these are eight rows of an array: tree, head, two bitmap words, slack, least size, largest size, reach.
NODE = "key bigint, node bigint, b0 bigint, b1 bigint, sizes bigint, reach bigint"
_COMBINE = ((2, np.bitwise_or), (3, np.bitwise_or), (4, np.maximum), (5, np.minimum), (6, np.maximum), (7, np.maximum))


def routes(own: np.ndarray, node: int, counts: np.ndarray, percent: int, floor: int = 0) -> np.ndarray:
    """Node rows of one document, one for each shingle of its prefix: its rarest shingles by (counter, hash).

    Two linked sets share a shingle, and the first one that they share lies in both prefixes. In the tree of that
    shingle the two can share no more than what follows it: the reach. A shingle whose counter exceeds ``floor`` by
    ``m * TREE_ROWS`` has m * (m + 1) / 2 trees, one for each pair of m parts, so no tree outgrows a task.
    """
    n = len(own)
    prefix = n - -(-n * percent // 100) + 1
    order = np.argsort(counts, kind="stable")[:prefix]  # ``own`` is sorted, so ties are in order of the hash
    rows = np.empty((8, prefix), dtype=np.int64)
    rows[0] = own[order].view(np.int64)
    rows[1] = node
    if n <= BITMAP_SIZE:
        bits = np.zeros(BITS, dtype=np.uint8)
        bits[((own >> np.uint64(40)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
        words = np.packbits(bits).view(np.int64)
        rows[2], rows[3], rows[4] = words[0], words[1], n - int(bits.sum())
    else:  # nearly all bits would be set
        rows[2], rows[3], rows[4] = -1, -1, n
    rows[5] = rows[6] = n
    rows[7] = n - np.arange(prefix)
    parts = (counts[order].astype(np.int64) - floor) // TREE_ROWS
    if not (parts > 1).any():
        return rows
    out = [rows[:, parts <= 1]]
    for k in np.flatnonzero(parts > 1):
        m = int(parts[k])
        other = np.arange(m)
        mine = node % m
        copies = np.repeat(rows[:, k : k + 1], m, axis=1)
        pair = np.minimum(other, mine) * m + np.maximum(other, mine) + 1
        copies[0] = _mixed(copies[0].view(np.uint64) + pair.astype(np.uint64) * _MIX[0]).view(np.int64)
        out.append(copies)
    return np.concatenate(out, axis=1)


def _can_link(rows: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether the nodes at ``i`` and ``j`` may hold a link: the largest possible overlap against what their sizes demand."""
    ones = lambda k: np.bitwise_count((rows[k, i] & rows[k, j]).view(np.uint64)).astype(np.int64)
    most = np.minimum(ones(2) + ones(3) + np.minimum(rows[4, i], rows[4, j]), np.minimum(rows[7, i], rows[7, j]))
    enough = (100 + percent) * most >= percent * (rows[5, i] + rows[5, j])
    return enough & (100 * rows[6, i] >= percent * rows[5, j]) & (100 * rows[6, j] >= percent * rows[5, i])


def _combined(rows: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """One node for each run of rows that starts at ``begin``: OR of the bitmaps, widest ranges; the first row is the head."""
    up = rows[:, begin].copy()
    for k, combine in _COMBINE:
        up[k] = combine.reduceat(rows[k], begin)
    return up


class Trees:
    """The signature trees of node rows: joined pairs are candidate edges, joined rows share a label.

    Rows are in order of (tree, size, reach). ``LEAF`` neighbours form a leaf, ``FAN`` nodes a node of the next level,
    up to one root. ``compared`` counts the pairs of rows and of nodes that were looked at.
    """

    def __init__(self, rows: np.ndarray, percent: int):
        rows = rows[:, np.lexsort((rows[1], rows[0]))]
        if rows.shape[1]:  # rows of one class in one tree
            rows = _combined(rows, np.flatnonzero(np.concatenate([[True], (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])])))
        self.rows = rows[:, np.lexsort((rows[7], rows[5], rows[0]))]
        self.percent, self.edges, self.compared = percent, [], 0
        n = self.rows.shape[1]
        self.label = np.arange(n)
        if not n:
            return
        begin = np.flatnonzero(np.concatenate([[True], self.rows[0, 1:] != self.rows[0, :-1]]))
        size = np.diff(np.append(begin, n))
        place = np.arange(n) - np.repeat(begin, size)
        after = np.minimum(LEAF - 1 - place % LEAF, np.repeat(size, size) - 1 - place)  # rows that follow in the leaf
        at, distance = np.flatnonzero(after >= 1), 1
        while len(at):
            self._compare(at, at + distance)
            distance += 1
            at = at[after[at] >= distance]
        for t in np.flatnonzero(size > LEAF):
            self._descend(int(begin[t]), int(begin[t] + size[t]))

    def _compare(self, i: np.ndarray, j: np.ndarray) -> None:
        apart = self.label[i] != self.label[j]
        i, j = i[apart], j[apart]
        self.compared += len(i)
        keep = _can_link(self.rows, i, j, self.percent)
        i, j = i[keep], j[keep]
        if not len(i):
            return
        # One edge joins two labels, however many pairs of their rows survive.
        a, b = self.label[i], self.label[j]
        _, one = np.unique(np.minimum(a, b) * len(self.label) + np.maximum(a, b), return_index=True)
        i, j = i[one], j[one]
        self.edges.append(np.stack([self.rows[1, i], self.rows[1, j]]))
        while True:
            a, b = self.label[i], self.label[j]
            if (a == b).all():
                return
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while True:
                further = self.label[self.label]
                if (further == self.label).all():
                    break
                self.label = further

    def _descend(self, start: int, end: int) -> None:
        """Dual traversal of one tree from its root down to pairs of leaves."""
        leaf = np.arange(start, end, LEAF)
        levels, spans = [_combined(self.rows[:, start:end], leaf - start)], [leaf]
        while levels[-1].shape[1] > 1:
            first = np.arange(0, levels[-1].shape[1], FAN)
            levels.append(_combined(levels[-1], first))
            spans.append(spans[-1][first])

        def settled(level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Pairs of nodes whose rows all have one label."""
            begin = spans[level] - start
            least, most = np.minimum.reduceat(self.label[start:end], begin), np.maximum.reduceat(self.label[start:end], begin)
            return (least[a] == most[a]) & (least[b] == most[b]) & (least[a] == least[b])

        def rows_of(a: np.ndarray, b: np.ndarray) -> None:
            step = np.arange(LEAF)
            i = np.broadcast_to((leaf[a][:, None] + step)[:, :, None], (len(a), LEAF, LEAF)).ravel()
            j = np.broadcast_to((leaf[b][:, None] + step)[:, None, :], (len(a), LEAF, LEAF)).ravel()
            inside = (i < np.repeat(np.minimum(leaf[a] + LEAF, end), LEAF * LEAF)) & (j < np.repeat(np.minimum(leaf[b] + LEAF, end), LEAF * LEAF))
            self._compare(i[inside], j[inside])

        # Neighbouring leaves first: members of a group of near copies mostly meet here, which settles pairs above them.
        near = np.arange(len(leaf) - 1)
        for k in range(0, len(near), PAIRS):
            rows_of(near[k : k + PAIRS], near[k : k + PAIRS] + 1)
        root = np.zeros(1, dtype=np.int64)
        stack = [(len(levels) - 1, root, root)]
        while stack:
            level, a, b = stack.pop()
            self.compared += len(a)
            keep = _can_link(levels[level], a, b, self.percent) & ~settled(level, a, b)
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            if level == 0:
                for k in range(0, len(a), PAIRS):
                    x, y = a[k : k + PAIRS], b[k : k + PAIRS]
                    rest = (y - x > 1) & ~settled(0, x, y)
                    if rest.any():
                        rows_of(x[rest], y[rest])
                continue
            below, step = levels[level - 1].shape[1], np.arange(FAN)
            x = np.broadcast_to((a[:, None] * FAN + step)[:, :, None], (len(a), FAN, FAN)).ravel()
            y = np.broadcast_to((b[:, None] * FAN + step)[:, None, :], (len(a), FAN, FAN)).ravel()
            inside = (x < below) & (y < below) & (x <= y)
            x, y = x[inside], y[inside]
            for k in range(0, len(x), 64 * PAIRS):
                stack.append((level - 1, x[k : k + 64 * PAIRS], y[k : k + 64 * PAIRS]))

    def found(self) -> np.ndarray:
        """Distinct candidate edges between heads."""
        if not self.edges:
            return np.zeros((2, 0), dtype=np.int64)
        both = np.concatenate(self.edges, axis=1)
        both = np.stack([both.max(axis=0), both.min(axis=0)])
        return np.unique(both[:, both[0] != both[1]], axis=1)

    def merged(self) -> np.ndarray:
        """One node for each label: a group of near copies leaves a task as one row a tree."""
        order = np.argsort(self.label, kind="stable")
        own = self.label[order]
        return _combined(self.rows[:, order], np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))) if len(own) else self.rows


_TREE_SCHEMA = pa.schema([(x.split()[0], pa.int64()) for x in NODE.split(", ")])


def _node_batch(rows: np.ndarray) -> pa.RecordBatch:
    """Node rows as a batch; sizes stay below 2**31."""
    columns = (*rows[:4], (rows[5] << 32) | rows[6], (rows[4] << 32) | (rows[7] + 1))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_TREE_SCHEMA)


def _node_rows(batch: pa.RecordBatch) -> np.ndarray:
    key, node, b0, b1, sizes, reach = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
    return np.stack([key, node, b0, b1, reach >> 32, sizes >> 32, sizes & 0xFFFFFFFF, (reach & 0xFFFFFFFF) - 1])


def _edge_rows(edges: np.ndarray) -> np.ndarray:
    """Edges in the form of node rows: marked by a reach below zero."""
    rows = np.zeros((8, edges.shape[1]), dtype=np.int64)
    rows[1], rows[2], rows[7] = edges[0], edges[1], -1
    rows[0] = _mixed(edges[0].astype(np.uint64) ^ (edges[1].astype(np.uint64) << np.uint64(1))).view(np.int64)  # spreads edges over the trees
    return rows


def candidate_edges(docs: DataFrame, counters: np.ndarray, words: int, percent: int) -> DataFrame:
    """``u, v``: candidate edges between classes, named by the first 8 bytes of their digests."""
    sketch = docs.sparkSession.sparkContext.broadcast(counters)
    floor = int(counters.mean())

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = _Hashes(), sketch.value
        held: list[np.ndarray] = []
        seen: set[int] = set()
        size = 0

        def emit() -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(held, axis=1)
            held.clear()
            trees = Trees(rows, percent)
            del rows
            yield _node_batch(trees.merged())
            yield _node_batch(_edge_rows(trees.found()))

        for batch in batches:
            for text in _bytes(batch.column(0)):
                own = shingles(text, words, hashes)
                node = int.from_bytes(_digest(own)[:8], "big", signed=True)
                if not len(own) or node in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                held.append(routes(own, node, counts[(own & np.uint64(SKETCH - 1)).astype(np.int64)], percent, floor))
                size += held[-1].shape[1]
                if size > HELD:
                    yield from emit()
                    size = 0
        if held:
            yield from emit()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

        def settle(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            known = rows[7] < 0
            every = np.concatenate([Trees(rows[:, ~known], percent).found(), rows[1:3, known]], axis=1)
            every = np.unique(every, axis=1) if every.shape[1] else every
            yield pa.RecordBatch.from_arrays([pa.array(every[0]), pa.array(every[1])], schema=schema)

        for batch in batches:
            held.append(_node_rows(batch))
            size += batch.num_rows
            if size > HELD:
                rows = np.concatenate(held, axis=1)
                whole = int(np.searchsorted(rows[0], rows[0, -1]))  # rows come in order of their trees; the last may go on
                if whole:
                    yield from settle(rows[:, :whole])
                held, size = [rows[:, whole:].copy()], rows.shape[1] - whole
                del rows
        if size:
            yield from settle(np.concatenate(held, axis=1))

    nodes = docs.select(text_of("text").cast("binary").alias("text")).mapInArrow(leaves, NODE)
    return nodes.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "u bigint, v bigint")


# Step 5 ------------------------------------------------------------------------------------------


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by incidence matrices over slices of the vocabulary."""
    sizes = [len(x) for x in left + right]
    every = np.concatenate(left + right)
    words, place = np.unique(every, return_inverse=True)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(place, kind="stable")
    place, doc = place[order], doc[order]
    seen = np.bincount(place, minlength=len(words))
    shared = seen[place] > 1
    place, doc = np.cumsum(np.concatenate([[0], np.diff(place[shared]) != 0])) if shared.any() else place[shared], doc[shared]
    total = np.zeros((len(left), len(right)), dtype=np.float32)
    at, n = 0, len(sizes)
    while at < len(place):
        end = int(np.searchsorted(place, place[at] + 4096))
        part = np.zeros((n, 4096), dtype=np.float32)
        part[doc[at:end], place[at:end] - place[at]] = 1
        total += part[: len(left)] @ part[len(left) :].T
        at = end
    return total.astype(np.int64)


def forest(left_ids, right_ids, left, right, percent: int, label: dict) -> list[tuple[int, int]]:
    """Spanning edges of the links between two lists of sets; ``label`` keeps the trees found so far."""
    common = common_counts(left, right)
    a, b = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    i, j = np.nonzero(100 * common >= percent * (a[:, None] + b[None, :] - common))

    def root(x):
        while label.setdefault(x, x) != x:
            label[x] = x = label[label[x]]
        return x

    out = []
    for x, y in zip(np.asarray(left_ids)[i].tolist(), np.asarray(right_ids)[j].tolist()):
        p, q = root(x), root(y)
        if p != q:
            label[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def hashed(batches: Iterator[pa.RecordBatch], words: int, names: list[str], field: str, made) -> Iterator[pa.RecordBatch]:
    """``names``, ``made`` of the set as ``field`` and the set's ``size``; rows whose text has not the set ``want`` go."""
    hashes = _Hashes()
    for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
        keep, values, sizes = [], [], []
        for k, (text, digest) in enumerate(zip(_bytes(batch.column("text")), batch.column("want"))):
            own = shingles(text, words, hashes)
            if _digest(own) == digest.as_py():
                keep.append(k)
                values.append(made(own))
                sizes.append(len(own))
        rest = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([*[rest.column(c) for c in names], pa.array(values, pa.binary()), pa.array(sizes, pa.int64())], names=[*names, field, "size"])


def _sets(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table.column("own")]


_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _edge_table(edges: list[tuple[int, int]]) -> pa.Table:
    return pa.table([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], schema=_EDGES)


def _with_candidates(texts: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """Rows of ``texts`` whose ``column`` may be a ``rep`` of ``ids``, by a bitmap: most others are left out before any shuffle."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(PLACES)) + 1
    bits = ids.select(place("rep").alias("x")).groupBy(F.bitmap_bucket_number("x").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
    at = F.bitmap_bit_position(place(column))
    byte = F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = (F.bitmap_bucket_number(place(column)) == F.col("bucket")) & (F.getbit(byte, (at % 8).cast("int")) == 1)
    return texts.join(F.broadcast(bits), hit, "left_semi")  # PLACES / 32768 rows of 4 KB at most


def verified_links(docs: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """Spanning edges ``u, v`` between the representatives ``rep`` of classes.

    ``members``: ``rep, n, h, component``, the classes of candidate components.
    """
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(100.0 / percent))).cast("int")
    counted = members.groupBy("component").agg(F.count("*").alias("c_docs"), F.sum("n").alias("c_shingles")).where(F.col("c_docs") > 1)
    banded = members.withColumn("band", band)
    per_band = banded.groupBy("component", "band").agg(F.count("*").alias("b_docs"), F.sum("n").alias("b_shingles"))
    large = (F.col("c_docs") > BLOCK_DOCS) | (F.col("c_shingles") > BLOCK_SHINGLES)
    blocks = F.ceil(F.greatest(F.col("b_docs") / F.lit(BLOCK_DOCS), F.col("b_shingles") / F.lit(BLOCK_SHINGLES))).cast("int")
    plan = cut(
        per_band.join(counted, "component")
        .withColumn("large", large)
        .select("component", "band", "large", F.when(F.col("large"), blocks).otherwise(F.lit(1)).alias("n_blocks"))
    )
    placed = cut(
        banded.join(plan, ["component", "band"])
        .withColumn("block", F.pmod(F.xxhash64("h"), F.col("n_blocks")).cast("int"))
        .select("rep", "h", "n", "component", "band", "large", "block")
    )
    pivot = placed.where("large").groupBy("component").agg(F.slice(F.sort_array(F.collect_set(F.when(F.pmod(F.xxhash64("h"), F.lit(64)) == 0, F.col("rep")))), 1, PIVOTS).alias("p"), F.min("rep").alias("first"))
    pivots = pivot.select("component", F.explode(F.array_union("p", F.array("first"))).alias("rep"), F.lit(True).alias("pivot"))
    want = placed.join(pivots, ["component", "rep"], "left").select("rep", F.col("h").alias("want"), "component", "band", "large", "block", F.col("pivot").isNotNull().alias("pivot"))

    texts = docs.select("doc_id", text_of("text").cast("binary").alias("text"))
    # Repeated rows go while the join has the rows of an id together. Texts travel instead of sets: they compress, hashes do not.
    texts = _with_candidates(texts, placed.select("rep"))
    wanted = cut(texts.join(want, texts["doc_id"] == want["rep"]).select("rep", "component", "band", "large", "block", "pivot", "want", "text").distinct())

    # Within components, or blocks of large ones with the pivots of the component.
    homes = plan.where("large").select("component", F.col("band").alias("to_band"), F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("to_block"))
    pivot_rows = (
        wanted.where("pivot").join(homes, "component")
        .where(~((F.col("band") == F.col("to_band")) & (F.col("block") == F.col("to_block"))) & (F.abs(F.col("band") - F.col("to_band")) <= 1))
        .select(F.xxhash64("component", "to_band", "to_block").alias("unit"), "component", "rep", "want", "text")
    )
    small_unit = F.pmod(F.xxhash64("component"), F.lit(1 << 20))  # small components share units by chance only
    own_rows = wanted.select(F.when(F.col("large"), F.xxhash64("component", "band", "block")).otherwise(small_unit).alias("unit"), "component", "rep", "want", "text")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        batches = hashed(batches, words, ["unit", "component", "rep"], "own", np.ndarray.tobytes)

        def settle(table: pa.Table) -> pa.RecordBatch:
            edges: list[tuple[int, int]] = []
            unit, comp = table.column("unit").to_numpy(), table.column("component").to_numpy()
            change = np.flatnonzero(np.concatenate([[True], (unit[1:] != unit[:-1]) | (comp[1:] != comp[:-1])]))
            for a, b in zip(change, [*change[1:], len(unit)]):
                if b - a > 1:
                    part = table.slice(a, b - a)
                    own, ids = _sets(part), part.column("rep").to_numpy()
                    edges += forest(ids, ids, own, own, percent, {})
            return _edge_table(edges).combine_chunks().to_batches(max_chunksize=None)[0] if edges else pa.RecordBatch.from_pylist([], schema=_EDGES)

        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
            unit, comp = held.column("unit").to_numpy(), held.column("component").to_numpy()
            open_from = int(np.flatnonzero((unit == unit[-1]) & (comp == comp[-1]))[0]) if len(unit) else 0
            if open_from:
                yield settle(held.slice(0, open_from))
                held = held.slice(open_from).combine_chunks()
        if held is not None and held.num_rows:
            yield settle(held)

    first = cut(own_rows.unionByName(pivot_rows).repartition("unit").sortWithinPartitions("unit", "component").mapInArrow(within, "u bigint, v bigint"))

    # Large components: who is not yet with the largest part of the component meets the blocks of the others.
    in_large = placed.where("large").select("rep", "component", "band", "block")
    label = components(first).select(F.col("node").alias("rep"), F.col("component").alias("label"))
    labelled = cut(in_large.join(label, "rep", "left").withColumn("label", F.coalesce("label", "rep")))
    main = labelled.groupBy("component", "label").count().groupBy("component").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    tagged = cut(labelled.join(main, "component").withColumn("minor", F.col("label") != F.col("main")))
    parts = cut(
        tagged.groupBy("component", "band").agg(F.count("*").alias("all"), F.count_if("minor").alias("m"))
        .select("component", "band", F.ceil(F.col("all") / F.lit(MARK_DOCS)).cast("int").alias("n_all"), F.ceil(F.col("m") / F.lit(MARK_DOCS)).cast("int").alias("n_left"))
    )
    if parts.where("n_left > 0").isEmpty():
        return first
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    pairs = cut(
        parts.where("n_left > 0").select("component", F.col("band").alias("l_band"), numbers("n_left").alias("i"))
        .join(parts.select("component", F.col("band").alias("r_band"), numbers("n_all").alias("j")), "component")
        .where(F.abs(F.col("l_band") - F.col("r_band")) <= 1)
        .withColumn("unit", F.xxhash64("component", "l_band", "i", "r_band", "j"))
    )
    marks = wanted.where("large").select("rep", "component", "want", "text").mapInArrow(
        lambda batches: hashed(batches, words, ["rep", "component"], "mark", mark), "rep bigint, component bigint, mark binary, size bigint"
    )
    marked = tagged.join(cut(marks), ["rep", "component"]).join(parts, ["component", "band"])
    columns = ["unit", "rep", "component", "band", "block", "label", "minor", "mark", "size"]
    l_marks = (
        marked.where("minor").withColumn("i", F.pmod(F.col("block"), F.col("n_left"))).withColumnRenamed("band", "l_band")
        .join(pairs.select("component", "l_band", "i", "unit"), ["component", "l_band", "i"]).withColumnRenamed("l_band", "band")
        .select(*columns, F.lit(0).alias("side"))
    )
    r_marks = (
        marked.withColumn("j", F.pmod(F.col("block"), F.col("n_all"))).withColumnRenamed("band", "r_band")
        .join(pairs.select("component", "r_band", "j", "unit"), ["component", "r_band", "j"]).withColumnRenamed("r_band", "band")
        .select(*columns, F.lit(1).alias("side"))
    )

    def able(table: pa.Table) -> pa.Table:
        """Rows of the pairs that can link by their marks, each under the two blocks that its pairs lie in."""
        side = table.column("side").to_numpy()
        rep, size, label, minor = (table.column(c).to_numpy() for c in ("rep", "size", "label", "minor"))
        blocks = np.stack([table.column("band").to_numpy(), table.column("block").to_numpy()])
        marks = np.stack([np.frombuffer(x.as_buffer(), dtype=np.uint8) for x in table.column("mark")])
        l, r = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        rows: list[np.ndarray] = []
        for x in l:
            near = (100 * np.minimum(size[r], size[x]) >= percent * np.maximum(size[r], size[x])) & (label[r] != label[x])
            y = r[near & (~minor[r] | (rep[r] > rep[x]))]  # two such documents also meet the other way round
            if not len(y):
                continue
            y = y[(100 + percent) * overlap_bounds(marks[x], int(size[x]), marks[y], size[y]) >= percent * (size[x] + size[y])]
            if len(y):
                meet = np.concatenate([np.repeat(blocks[:, [x]], len(y), axis=1), blocks[:, y]])
                rows += [np.concatenate([meet, np.full((1, len(y)), x)]), np.concatenate([meet, y[None]])]
        every = np.unique(np.concatenate(rows, axis=1), axis=1) if rows else np.zeros((5, 0), dtype=np.int64)
        at = every[4].astype(np.int64)
        names = ["component", "l_band", "l_block", "r_band", "r_block", "rep", "label", "side"]
        return pa.table([table.column("component").take(pa.array(at)), *[pa.array(k.astype(np.int32)) for k in every[:4]], pa.array(rep[at]), pa.array(label[at]), pa.array(side[at])], names=names)

    able_rows = cut(
        l_marks.unionByName(r_marks).groupBy("unit").applyInArrow(able, "component bigint, l_band int, l_block int, r_band int, r_block int, rep bigint, label bigint, side int")
        .select(F.xxhash64("component", "l_band", "l_block", "r_band", "r_block").alias("unit"), "rep", "label", "side").distinct()
    )
    sets = _with_candidates(wanted.where("large").select("rep", "want", "text"), able_rows, "rep").mapInArrow(
        lambda batches: hashed(batches, words, ["rep"], "own", np.ndarray.tobytes), "rep bigint, own binary, size bigint"
    )
    placed_rows = able_rows.join(sets.select("rep", "own"), "rep")

    def across(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        ids, own, label_of = table.column("rep").to_numpy(), _sets(table), table.column("label").to_numpy()
        known = dict(zip(ids.tolist(), label_of.tolist()))
        known.update((x, x) for x in set(label_of.tolist()))
        l, r = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        edges = forest(ids[l], ids[r], [own[k] for k in l], [own[k] for k in r], percent, known) if len(l) and len(r) else []
        return _edge_table(edges)

    second = cut(placed_rows.groupBy("unit").applyInArrow(across, "u bigint, v bigint"))
    return first.unionByName(second)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, text_key: Column | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row: the smallest id reachable by links; ``text_key`` (binary) passes through if given."""
    key = text_key if text_key is not None else F.lit(None).cast("binary")
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), key.alias("text_key"))
    own, counters = signatures(base, words)
    base = base.drop("text_key")
    node = F.conv(F.substring(F.hex("h"), 1, 16), 16, -10).cast("bigint")
    known = own.where(F.col("h").isNotNull() & F.col("doc_id").isNotNull())
    classes = cut(known.groupBy("h").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")).withColumn("node", node))
    confined = components(candidate_edges(base.where(F.col("doc_id").isNotNull()), counters, words, percent)).withColumnRenamed("node", "c_node")
    members = cut(classes.join(confined, F.col("node") == F.col("c_node")).select("rep", "n", "h", "component"))
    links = components(verified_links(base, members, words, percent)).withColumnRenamed("node", "l_node")
    found = cut(
        classes.join(links, F.col("rep") == F.col("l_node"), "left").select(F.col("h").alias("c_h"), F.coalesce("component", "rep").alias("component_id"))
    )
    return own.join(found, F.col("h") == F.col("c_h"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), *(["text_key"] if text_key is not None else [])
    )


def one_per_component(docs: DataFrame, columns: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``columns`` of one row for each component: a row stays if its own text's component has its id.

    Of rows that agree in id and text one stays, the least by the other columns. Rows of one id with different
    texts are judged each by its own text. Rows without an id stay.
    """
    key = lambda: F.unhex(F.md5(text_of(text_col).cast("binary")))
    groups = jaccard_components(docs, id_col, text_col, words, percent, key())
    kept = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_kept_id"), F.col("text_key").alias("_kept_key")).distinct()
    rest = [c for c in columns if c not in (id_col, text_col)]
    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), key().alias("_key"), F.struct(*rest, text_col).alias("_row"))
    chosen = named.join(kept, (F.col("_id") == F.col("_kept_id")) & (F.col("_key") == F.col("_kept_key")), "left_semi").groupBy("_id", "_key").agg(F.min("_row").alias("_row"))
    return chosen.select(*[F.col("_id").alias(c) if c == id_col else F.col("_row")[c].alias(c) for c in columns]).unionByName(docs.where(F.col(id_col).isNull()).select(*columns))


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Components of all documents at three words and a similarity of 0.9."""
    return jaccard_components(read(spark, sf_dir, "documents"), words=3, percent=90)


OP6_SQL = r"""
WITH RECURSIVE
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM d),
c AS (SELECT g2 AS g, min(doc_id) AS rep, count(*) AS k FROM (SELECT doc_id, list_sort(g) AS g2 FROM s WHERE len(g) > 0) GROUP BY g2),
e AS (SELECT rep, len(g) AS n, unnest(g) AS x FROM c),
p AS (SELECT a.rep AS u, b.rep AS v, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb
      FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS (SELECT u, v FROM p WHERE 100 * common >= 90 * (na + nb - common)),
n AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
r AS (SELECT rep AS start, rep AS goal FROM c UNION SELECT r.start, n.v FROM r JOIN n ON r.goal = n.u),
m AS (SELECT start, min(r.goal) AS component_id FROM r GROUP BY start)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN c ON list_sort(s.g) = c.g LEFT JOIN m ON m.start = c.rep
"""
