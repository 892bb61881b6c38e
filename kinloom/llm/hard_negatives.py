"""Hard negatives by a multiway hyperplane tree with distance ranges (operator 12).

Components become the integers floor(256 * x), and a row's score is its integer product with the anchor. As
2 * score = |a|^2 + |x|^2 - d(a, x)^2, a window of scores is an annulus of distances around the anchor.

The tree: each node has up to ``FAN`` split points, and a row goes to the subtree of the nearest one (the hyperplanes
between the points part them). For each split point i and each sibling subtree j the node stores the least and the largest
distance from point i to a row of subtree j, and for each subtree the range of squared lengths. A query with a window
eliminates subtree j if for some i the distances that the triangle inequality allows, from ``d(i, a)`` and the
annulus, do not meet the stored range. Leaves that remain are searched exactly. Split points are chosen on a bounded
sample of ``SAMPLE_ROWS`` rows; every row is placed in a leaf, and all ranges are taken over all rows, so no answer depends
on the sample.

Two searches use the tree, each in two steps: the anchor's own leaf first gives a bound (the score of the last wanted
row there), then the leaves that the narrower window still reaches. The first search finds the positives, the
second the negatives in the window of each positive.

Leaves of more than ``LEAF_ROWS`` rows are dealt by hash into parts, the anchors that reach a leaf into blocks of ``BLOCK_ANCHORS``;
a unit of work is one part with one block, so no task holds a leaf or all anchors.

Rows of a length of which the sample holds none, or with a component beyond ``LARGE``, are in no tree: they form loose leaves by
length that every anchor of that length searches, and anchors of that kind search every leaf of their length.

Broadcast: the tree. It has at most ``MAX_LEAVES`` leaves and is made of the sample, so it does not grow with the data. Leaf
sizes are at most that many rows, besides one for each length of loose rows (checked before they are broadcast).

Defined results: rows with a null id or label, a null vector, or null or non-finite components take no part; vectors of
different lengths are never compared; rows that carry the anchor's id are not its partners; anchors that are equal in id,
label and vector answer once, other repeated rows are rows of their own; ties go to the smaller id; scores
beyond 2^62 count as 2^62; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, read

FAN, SAMPLE_ROWS, MAX_LEAVES = 12, 16384, 4096
LEAF_ROWS, BLOCK_ANCHORS, BROADCAST_LEAVES = 4096, 1024, 100_000
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Components beyond it are compared as Python numbers and stay out of the tree.
LARGE, _MOST = float(1 << 20), 1 << 62
#: Room for the rounding of distances, as a share of them.
_SLACK = 1e-9


@dataclass
class Node:
    """Split points of a node, its children (a node or the number of a leaf), and what is known of the children's rows."""

    number: int
    points: np.ndarray
    children: list = field(default_factory=list)
    nearest: np.ndarray | None = None  # [i, j]: least distance from point i to a row of child j
    farthest: np.ndarray | None = None
    shortest: np.ndarray | None = None  # [j]: least squared length
    longest: np.ndarray | None = None


def integers(column: pa.Array, dims: int) -> np.ndarray:
    """floor(256 * x) of vectors of one length, as doubles."""
    return np.floor(256 * np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), dims))


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    square = (x**2).sum(axis=1)[:, None] + (points**2).sum(axis=1)[None] - 2 * (x @ points.T)
    return np.sqrt(np.maximum(square, 0))


def split_points(sample: np.ndarray, fan: int) -> np.ndarray:
    """Points far from each other: each next one is the farthest from those before it."""
    chosen = [0]
    gap = distances(sample, sample[:1])[:, 0]
    while len(chosen) < fan and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


class Tree:
    """The trees of all lengths of vectors; numbers of nodes and leaves are unique over them."""

    def __init__(self, samples: dict[int, np.ndarray], total: int, fan: int = FAN, leaf_rows: int = LEAF_ROWS, max_leaves: int = MAX_LEAVES) -> None:
        self.nodes: list[Node] = []
        self.n_leaves = 0
        known = max(1, sum(map(len, samples.values())))
        leaves = min(max_leaves, max(1, -(-2 * total // leaf_rows)))
        self.leaf_sample = max(1, known // leaves)
        self.fan = fan
        self.roots = {dims: self._grow(sample) for dims, sample in samples.items()}

    def _grow(self, sample: np.ndarray):
        points = split_points(sample, min(self.fan, -(-len(sample) // self.leaf_sample))) if len(sample) > self.leaf_sample else sample[:1]
        if len(points) < 2:
            self.n_leaves += 1
            return self.n_leaves - 1
        node = Node(len(self.nodes), points)
        self.nodes.append(node)
        home = distances(sample, points).argmin(axis=1)
        node.children = [self._grow(sample[home == j]) for j in range(len(points))]
        shape = (len(points), len(points))
        node.nearest, node.farthest = np.full(shape, np.inf), np.full(shape, -np.inf)
        node.shortest, node.longest = np.full(len(points), np.inf), np.full(len(points), -np.inf)
        return node

    def place(self, x: np.ndarray, dims: int, learn: bool = False) -> np.ndarray:
        """The leaf of each row; with ``learn`` the ranges on the way take the rows in."""
        out = np.empty(len(x), dtype=np.int64)

        def go(node, at: np.ndarray) -> None:
            if not isinstance(node, Node):
                out[at] = node
                return
            d = distances(x[at], node.points)
            home = d.argmin(axis=1)
            for j, child in enumerate(node.children):
                mine = home == j
                if not mine.any():
                    continue
                if learn:
                    node.nearest[:, j] = np.minimum(node.nearest[:, j], d[mine].min(axis=0))
                    node.farthest[:, j] = np.maximum(node.farthest[:, j], d[mine].max(axis=0))
                    length = (x[at[mine]] ** 2).sum(axis=1)
                    node.shortest[j] = min(node.shortest[j], length.min())
                    node.longest[j] = max(node.longest[j], length.max())
                go(child, at[mine])

        go(self.roots[dims], np.arange(len(x)))
        return out

    def ranges(self) -> pa.RecordBatch:
        """What this copy has learned, a row for each node, split point and child."""
        rows = [
            (node.number, i, j, node.nearest[i, j], node.farthest[i, j], node.shortest[j], node.longest[j])
            for node in self.nodes for j in range(len(node.points)) if node.longest[j] >= 0 for i in range(len(node.points))
        ]
        columns = list(zip(*rows)) if rows else [[]] * 7
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.float64()] * 4)], names=["node", "i", "j", "nearest", "farthest", "shortest", "longest"]
        )

    def learn(self, rows: list) -> None:
        for r in rows:
            node = self.nodes[r["node"]]
            node.nearest[r["i"], r["j"]], node.farthest[r["i"], r["j"]] = r["nearest"], r["farthest"]
            node.shortest[r["j"]], node.longest[r["j"]] = r["shortest"], r["longest"]

    def reached(self, x: np.ndarray, dims: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchors, leaves): the leaves that may hold rows with a score in ``low[a, w]`` to ``high[a, w]`` for some window w of anchor a."""
        anchors, leaves = [], []

        def go(node, at: np.ndarray) -> None:
            if not isinstance(node, Node):
                anchors.append(at)
                leaves.append(np.full(len(at), node))
                return
            d = distances(x[at], node.points)  # [a, i]
            length = (x[at] ** 2).sum(axis=1)[:, None]
            for j, child in enumerate(node.children):
                if node.longest[j] < 0:
                    continue  # no row
                with np.errstate(invalid="ignore"):
                    least = np.sqrt(np.maximum(length + node.shortest[j] - 2 * high[at], 0)) * (1 - _SLACK)  # [a, w]
                    most = np.sqrt(np.maximum(length + node.longest[j] - 2 * low[at], 0)) * (1 + _SLACK)
                none = (low[at] > high[at]) | (length + node.longest[j] - 2 * low[at] < 0)
                under = np.maximum(d[:, :, None] - most[:, None], least[:, None] - d[:, :, None])  # [a, i, w]
                over = d[:, :, None] + most[:, None]
                room = _SLACK * (1 + d[:, :, None])
                out = (under - room > node.farthest[:, j][None, :, None]) | (over + room < node.nearest[:, j][None, :, None])
                alive = (~out.any(axis=1) & ~none).any(axis=1)
                if alive.any():
                    go(child, at[alive])

        go(self.roots[dims], np.arange(len(x)))
        return np.concatenate(anchors or [np.zeros(0, dtype=np.int64)]), np.concatenate(leaves or [np.zeros(0, dtype=np.int64)])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products, within ``_MOST``."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 24:  # every sum is exact in single precision
        return (a.astype(np.float32) @ b.T.astype(np.float32)).astype(np.int64)
    if most < 1 << 53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: [[int(v) for v in r] for r in m]
    return np.array([[max(-_MOST, min(_MOST, sum(map(int.__mul__, p, q)))) for q in whole(b)] for p in whole(a)], dtype=np.int64).reshape(len(a), len(b))


def best(scores: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` highest scores, the earlier first among equals."""
    if len(scores) > top:
        bound = np.partition(scores, len(scores) - top)[len(scores) - top]
        at = np.flatnonzero(scores >= bound)
    else:
        at = np.arange(len(scores))
    return at[np.argsort(-scores[at], kind="stable")][:top]


def search(unit: pa.Table, same: bool, top: int) -> pa.Table:
    """The best rows of a unit for every anchor and window: ``anchor, win, id, score``."""
    side = unit.column("side").to_numpy()
    order = np.lexsort((unit.column("id").to_numpy(), side))
    unit = unit.take(pa.array(order))
    n = int((side == 0).sum())
    ids, labels = unit.column("id").to_numpy()[:n], unit.column("label").to_numpy()[:n]
    dims = int(unit.column("dims")[0].as_py())
    x = integers(unit.column("vector").combine_chunks(), dims)
    asking = unit.slice(n)
    out: list[tuple[list, ...]] = []
    windows = list(zip(asking.column("low").to_pylist(), asking.column("high").to_pylist()))
    for at in range(0, len(asking), 128):
        scores = products(x[n + at : n + at + 128], x[:n])
        for k, row in enumerate(scores, at):
            anchor, label, own = asking.column("anchor")[k].as_py(), asking.column("label")[k].as_py(), asking.column("id")[k].as_py()
            fit = np.flatnonzero(((labels == label) == same) & (ids != own))
            mine = row[fit]
            for w, (low, high) in enumerate(zip(*windows[k])):
                inside = np.flatnonzero((mine >= low) & (mine <= high))
                found = inside[best(mine[inside], top)]
                out.append(([anchor] * len(found), [w] * len(found), ids[fit[found]].tolist(), mine[found].tolist()))
    columns = [[v for part in out for v in part[c]] for c in range(4)]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["anchor", "win", "id", "score"])


def _by_dims(batch: pa.RecordBatch, tree: Tree) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """(length, places, integers or None for loose rows) of the rows of a batch."""
    sizes = batch.column("dims").to_numpy()
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        x = integers(batch.column("vector").take(pa.array(at)), int(d))
        sound = (np.abs(x) <= LARGE).all(axis=1) & (int(d) in tree.roots)
        if sound.any():
            yield int(d), at[sound], x[sound]
        if not sound.all():
            yield int(d), at[~sound], None


def _plant(rows: DataFrame, fan: int, leaf_rows: int) -> Tree:
    """The tree, with ranges over all rows."""
    sample = rows.select("dims", "vector").where(F.col("dims") > 0).orderBy(F.xxhash64("id", "key"), "id").limit(SAMPLE_ROWS).toArrow()  # bounded
    samples = {}
    for d in np.unique(sample.column("dims").to_numpy()):
        x = integers(sample.filter(pc.equal(sample.column("dims"), int(d))).column("vector").combine_chunks(), int(d))
        x = x[(np.abs(x) <= LARGE).all(axis=1)]
        if len(x):
            samples[int(d)] = x
    tree = Tree(samples, rows.count(), fan, leaf_rows)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, _, x in _by_dims(batch, tree):
                if x is not None:
                    tree.place(x, d, learn=True)
        yield tree.ranges()

    learned = (
        rows.select("dims", "vector").mapInArrow(measure, "node bigint, i bigint, j bigint, nearest double, farthest double, shortest double, longest double")
        .groupBy("node", "i", "j").agg(F.min("nearest").alias("nearest"), F.max("farthest").alias("farthest"), F.min("shortest").alias("shortest"), F.max("longest").alias("longest"))
    )
    tree.learn(learned.collect())  # at most MAX_LEAVES * FAN rows, whatever the input
    return tree


def _placed(rows: DataFrame, tree: Tree) -> DataFrame:
    """Add ``leaf``: loose rows get -1 - their length."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = np.empty(batch.num_rows, dtype=np.int64)
            for d, at, x in _by_dims(batch, tree):
                leaf[at] = tree.place(x, d) if x is not None else -1 - d
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(work, f"{schema}, leaf bigint")


def _routes(asking: DataFrame, tree: Tree) -> DataFrame:
    """A row for each anchor and leaf that its windows reach, without the leaf it starts from."""
    fields = [f for f in asking.schema.fields if f.name != "home"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            homes = batch.column("home").to_numpy()
            rest = batch.select([f.name for f in fields])
            for d, at, x in _by_dims(batch, tree):
                if x is None:  # every leaf of this length
                    inner = list(_leaves(tree.roots[d])) if d in tree.roots else []
                    who, leaves = np.repeat(at, len(inner)), np.tile(np.array(inner, dtype=np.int64), len(at))
                else:
                    pad = lambda name, fill: _padded(batch.column(name).take(pa.array(at)), fill)
                    who, leaves = tree.reached(x, d, pad("low", np.inf), pad("high", -np.inf))
                    who = at[who]
                who, leaves = np.concatenate([who, at]), np.concatenate([leaves, np.full(len(at), -1 - d)])
                other = leaves != homes[who]
                who, leaves = who[other], leaves[other]
                for k in range(0, len(who), 4096):
                    yield pa.RecordBatch.from_arrays([*rest.take(pa.array(who[k : k + 4096])).columns, pa.array(leaves[k : k + 4096])], names=[*rest.schema.names, "leaf"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return asking.mapInArrow(work, f"{schema}, leaf bigint")


def _leaves(node) -> Iterator[int]:
    if isinstance(node, Node):
        for child in node.children:
            yield from _leaves(child)
    else:
        yield node


def _padded(column: pa.Array, fill: float) -> np.ndarray:
    """Windows as a matrix; anchors with fewer have empty ones."""
    rows = column.to_pylist()
    out = np.full((len(rows), max([1, *map(len, rows)])), fill)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def _met(visits: DataFrame, rows: DataFrame, sizes: DataFrame, same: bool, top: int, block_anchors: int) -> DataFrame:
    """``anchor, win, id, score``: the best rows of each unit for the anchors that visit its leaf."""
    known = sizes.join(visits.groupBy("leaf").count(), "leaf").select("leaf", "n_parts", F.ceil(F.col("count") / block_anchors).cast("int").alias("n_blocks"))
    known = cut(known)
    small = F.broadcast(known) if known.count() <= BROADCAST_LEAVES else known
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    hashed = lambda n, *c: F.pmod(F.xxhash64(*c), F.col(n)).cast("int")
    kind = rows.schema["vector"].dataType.simpleString()
    there = rows.join(small, "leaf").withColumn("part", hashed("n_parts", "id", "key")).withColumn("block", every("n_blocks"))
    there = there.select("leaf", "part", "block", F.lit(0).alias("side"), F.lit(None).cast("bigint").alias("anchor"), "id", "label", "dims", "vector", F.lit(None).cast("array<bigint>").alias("low"), F.lit(None).cast("array<bigint>").alias("high"))
    come = visits.join(small, "leaf").withColumn("block", hashed("n_blocks", "anchor")).withColumn("part", every("n_parts"))
    come = come.select("leaf", "part", "block", F.lit(1).alias("side"), "anchor", "id", "label", "dims", F.col("vector").cast(kind).alias("vector"), "low", "high")

    def work(table: pa.Table) -> pa.Table:
        sides = table.column("side").to_numpy()
        if sides.all() or not sides.any():  # an empty part or block
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64())], names=["anchor", "win", "id", "score"])
        return search(table, same, top)

    return there.unionByName(come).groupBy("leaf", "part", "block").applyInArrow(work, "anchor bigint, win int, id bigint, score bigint")


def _top(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("anchor", "win").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _two_steps(asking: DataFrame, rows: DataFrame, sizes: DataFrame, tree: Tree, same: bool, top: int, block_anchors: int) -> DataFrame:
    """``anchor, win, id, score, rank`` over all leaves; ``asking`` has the anchors with their home and windows."""
    first = cut(_top(_met(asking.withColumnRenamed("home", "leaf"), rows, sizes, same, top, block_anchors), top))
    # The last wanted score at home is a bound for the other leaves.
    bound = first.where(F.col("rank") == top).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("win", "score"))).alias("bounds"))  # as many as windows
    narrower = F.transform("low", lambda low, w: F.greatest(low, F.coalesce(F.try_element_at("bounds", w), low)))
    others = cut(_routes(asking.join(bound, "anchor", "left").withColumn("low", narrower).drop("bounds"), tree))
    rest = _met(others, rows, sizes, same, top, block_anchors)
    return _top(first.drop("rank").unionByName(rest), top)


def mine(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, fan: int = FAN, leaf_rows: int = LEAF_ROWS, block_anchors: int = BLOCK_ANCHORS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` is a condition on the column ``id``. A negative's score lies between ``low`` and ``high`` per cent of the positive's.
    """
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * 256) < float("inf")))
    rows = (
        vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).cast(kind).alias("vector"))
        .where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
        .withColumn("dims", F.size("vector")).withColumn("key", F.xxhash64("id", "label", "vector"))
    )
    tree = _plant(rows, fan, leaf_rows)
    placed = cut(_placed(rows, tree))
    sizes = cut(placed.groupBy("leaf").count().select("leaf", F.ceil(F.col("count") / leaf_rows).cast("int").alias("n_parts")))
    anchors = placed.where(is_anchor).dropDuplicates(["key", "id", "label"]).withColumnsRenamed({"key": "anchor", "leaf": "home"})
    anchors = cut(anchors.select("anchor", "id", "label", "dims", "vector", "home"))
    whole = lambda v: F.array(F.lit(v).cast("bigint"))
    good = cut(_two_steps(anchors.withColumn("low", whole(-_MOST)).withColumn("high", whole(_MOST)), placed, sizes, tree, True, positives, block_anchors))
    pairs = good.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))).alias("pairs"))  # a handful each
    asking = anchors.join(pairs, "anchor").select("anchor", "id", "label", "dims", "vector", "home", "pairs")
    positive = F.filter("pairs", lambda s: s["positive_score"] >= 0)  # a negative score leaves no window
    lows = F.transform("pairs", lambda s: _share(s["positive_score"], low, True))
    highs = F.transform("pairs", lambda s: _share(s["positive_score"], high, False))
    asking = asking.withColumn("pairs", positive).where(F.size("pairs") > 0).withColumn("low", lows).withColumn("high", highs)
    asking = cut(asking)
    bad = _two_steps(asking.drop("pairs"), placed, sizes, tree, False, negatives, block_anchors)
    named = asking.select("anchor", F.col("id").alias("anchor_id"), F.posexplode("pairs").alias("win", "p"))
    return bad.join(named, ["anchor", "win"]).select(
        "anchor_id", "p.positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "p.positive_score", F.col("score").alias("negative_score")
    )


def _share(score: Column, percent: int, up: bool) -> Column:
    """``percent`` per cent of a score of 0 or more, rounded up or down, without leaving the range of longs."""
    rest = (score % 100) * percent
    rounded = F.ceil(rest / F.lit(100)) if up else F.floor(rest / F.lit(100))
    return F.call_function("div", score, F.lit(100)).cast("bigint") * percent + rounded.cast("bigint")


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor, after the contract's change of labels."""
    vectors = read(spark, sf_dir, "embeddings")
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.withColumn("label", changed), F.col("id") % 100 == 0)


OP12_SQL = r"""
WITH
e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
      CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT id, label, list_transform(v, lambda x: floor(256 * x)) AS v FROM e
      WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.id AS anchor_id, b.id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM s a JOIN s b ON a.id % 100 = 0 AND a.id <> b.id AND len(a.v) = len(b.v)),
g AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS k FROM p WHERE same),
n AS (SELECT g.anchor_id, g.other_id AS positive_id, p.other_id AS negative_id, g.score AS positive_score, p.score AS negative_score,
      row_number() OVER (PARTITION BY g.anchor_id, g.other_id ORDER BY p.score DESC, p.other_id) AS rank
      FROM g JOIN p ON p.anchor_id = g.anchor_id AND NOT p.same AND 30 * g.score <= 100 * p.score AND 100 * p.score <= 90 * g.score WHERE g.k <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
