"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: No more nodes than this can be hot at once, so their table has a fixed size and is sent to every task; nodes with no more
#: neighbours than ``HOT_DEGREE`` are never hot.
HOT_NODES, HOT_DEGREE = 10_000, 64
#: Edges that a task contracts at once.
HELD = 250_000
_PAIR = pa.schema([("key", pa.int64()), ("other", pa.int64())])
_MOVED = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("moved", pa.bool_())])


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same connections as a star around the least node of each component: no more edges than before."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, label = place[: len(u)], place[len(u) :], np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not (label[label] == label).all():
            label = label[label]
    leaf = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[leaf], nodes[label[leaf]]


def _contract(batches: Iterator[pa.RecordBatch], both: bool) -> Iterator[pa.RecordBatch]:
    """Contract the edges of a task in parts of ``HELD``; ``both``: every edge under each of its nodes."""
    held: list[pa.RecordBatch] = []

    def settle() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        x, root = contracted(*(table.column(k).to_numpy() for k in (0, 1)))
        ends = (np.concatenate([x, root]), np.concatenate([root, x])) if both else (x, root)
        return pa.RecordBatch.from_arrays([pa.array(e) for e in ends], schema=_PAIR)

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= HELD:
            yield settle()
            held = []
    if held:
        yield settle()


def _to_least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Link the larger neighbours of each node to its least one; rows are in order of (key, other).

    The first row of a node holds its least neighbour, so nothing but that is kept in memory, however many neighbours follow.
    ``moved`` marks nodes that are neither the least of their neighbours nor linked with a single smaller one.
    """
    last, least = None, None
    for batch in batches:
        key, other = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(key):
            continue
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        first = np.minimum(other[begin], key[begin])
        if last == key[0]:
            first[0] = least
        m = np.repeat(first, np.diff(np.append(begin, len(key))))
        moved = (m < key) & (other != m)
        up = other > key
        last, least = int(key[-1]), int(m[-1])
        yield pa.RecordBatch.from_arrays([pa.array(other[up]), pa.array(m[up]), pa.array(moved[up])], schema=_MOVED)
        if moved[~up].any():
            yield pa.RecordBatch.from_pylist([{"u": None, "v": None, "moved": True}], schema=_MOVED)


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: the least node that each node of ``edges (u, v)`` is connected with.

    Each round has two star steps, each with one shuffle. Dealt by their larger node, edges are contracted to
    stars around the least node that a task can see; then each node, dealt with all its neighbours, links the larger ones to
    the least. No step makes more edges than it gets, and the number of rounds grows with the logarithm of the
    number of nodes. Tasks work on parts of bounded size. The least neighbours
    of hot nodes, at most ``HOT_NODES`` rows, are broadcast, so no task gets all their neighbours. Each round is written to the
    checkpoint folder. Self links are ignored; nodes without another node do not appear.
    """
    pairs = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = pairs.mapInArrow(lambda batches: _contract(batches, False), "key bigint, other bigint").select(F.col("key").alias("u"), F.col("other").alias("v"))
    while True:
        both = now.select("u", "v").repartition("u").mapInArrow(lambda batches: _contract(batches, True), "key bigint, other bigint")
        both = cut(both)
        # The rows of ``both`` hold at most HOT_NODES nodes of a higher degree: their neighbours need no shuffle.
        degree = max(HOT_DEGREE, both.count() // HOT_NODES)
        least = both.groupBy("key").agg(F.min("other").alias("m"), F.count("*").alias("degree")).where(F.col("degree") > degree)
        tagged = both.join(F.broadcast(least.select(F.col("key").alias("hot"), F.least("key", "m").alias("m"))), F.col("key") == F.col("hot"), "left")
        moved = (F.col("m") < F.col("key")) & (F.col("other") != F.col("m"))
        done = tagged.where(F.col("hot").isNotNull()).select(F.when(F.col("other") > F.col("key"), F.col("other")).alias("u"), F.col("m").alias("v"), moved.alias("moved")).where(F.col("u").isNotNull() | F.col("moved"))
        both = tagged.where(F.col("hot").isNull()).select("key", "other")
        linked = both.repartition("key").sortWithinPartitions("key", "other").mapInArrow(_to_least, "u bigint, v bigint, moved boolean")
        now = cut(linked.unionByName(done))
        if now.where("moved").isEmpty():
            break
        now = now.where(F.col("u").isNotNull())
    star = now.select("u", "v").distinct()
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
