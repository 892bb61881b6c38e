"""Near-duplicate vectors by a subspace pigeonhole join (operator 9).

Unit vectors x, y have cosine >= t exactly if |x - y|^2 <= 2 - 2t. After a fixed rotation the
dimensions are split into ``BLOCKS`` blocks, and each block gets the share of the squared-distance budget
that its dimensions have of all. If every block exceeded its share the sum would exceed the budget, so each link
lies within the budget of some block. Each block is range-joined: its first coordinate is cut into
strips as wide as the block's radius, and only equal and neighbouring strips meet. Strips are split
into groups of about ``GROUP_ROWS`` rows by hash, and pairs of groups are the units of work, so no task
holds a whole strip. In a unit the candidates of the block are verified with the exact cosine of
the given components in double precision, and a pair counts in the first block that admits it,
hence once. A unit returns counts per vector and a spanning forest of its links, never the pairs.

Equal vectors are collapsed before the join and counted by their number.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing;
vectors of different lengths never link; repeated rows of an id are separate vectors that both carry the id; an empty
table gives no rows; the smallest id represents equal vectors; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, read
from .graph import components

THRESHOLD, BLOCKS, GROUP_ROWS, BROADCAST_STRIPS = 0.9, 4, 4096, 100_000
#: Room for the rounding of the rotated coordinates; the exact cosine decides.
_SLACK = 1e-6


def rotation(dims: int) -> np.ndarray:
    """A fixed orthogonal matrix."""
    return np.linalg.qr(np.random.default_rng(20).standard_normal((dims, dims)))[0]


def block_slices(dims: int, blocks: int) -> list[slice]:
    edges = np.linspace(0, dims, min(blocks, dims) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]


def _unit(column: pa.Array, dims: int) -> np.ndarray:
    x = np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dims)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components leave the range of doubles
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _strips(classes: DataFrame, threshold: float, blocks: int) -> DataFrame:
    """Add ``strips array<int>``: the strip of each block."""
    schema = f"cls bigint, dims int, weight bigint, embedding {classes.schema['embedding'].dataType.simpleString()}, strips array<int>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("dims").to_numpy()
            strips: list = [None] * batch.num_rows
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                turned = _unit(batch.column("embedding").take(pa.array(at)), int(d)) @ rotation(int(d))
                parts = block_slices(int(d), blocks)
                found = np.stack([np.floor(turned[:, s.start] / radius(d, s, threshold)) for s in parts], axis=1).astype(np.int32)
                for i, f in zip(at, found.tolist()):
                    strips[i] = f
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(strips, pa.list_(pa.int32()))], names=[*batch.schema.names, "strips"])

    return classes.mapInArrow(work, schema)


def radius(dims: int, part: slice, threshold: float) -> float:
    """Distance that a block's share of the budget allows."""
    return float(np.sqrt((2 - 2 * threshold) * (part.stop - part.start) / dims) + _SLACK)


def unit_links(rows: pa.Table, threshold: float, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links inside one unit of work: (row ids, summed weights of linked rows, forest from, forest to)."""
    first = np.flatnonzero(rows.column("side").to_numpy() == 0)
    second = np.flatnonzero(rows.column("side").to_numpy() == 1)
    own = bool(rows.column("own")[0].as_py())
    ids, weight = rows.column("cls").to_numpy(), rows.column("weight").to_numpy()
    block, dims = int(rows.column("block")[0].as_py()), int(rows.column("dims")[0].as_py())
    unit = _unit(rows.column("embedding").combine_chunks(), dims)
    parts, turned = block_slices(dims, blocks), unit @ rotation(dims)
    left, right = first, first if own else second
    limit = [radius(dims, s, threshold) ** 2 for s in parts]
    # One product gives all squared distances of the block, in single precision and with room for its rounding.
    own_block = turned[:, parts[block]]
    square = (own_block**2).sum(axis=1, keepdims=True)
    one = np.ones_like(square)
    rows_side = np.hstack([-2 * own_block, square, one]).astype(np.float32)
    cols_side = np.hstack([own_block, one, square]).astype(np.float32)[right].T.copy()
    counts, label = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
    start, end = [], []
    width = -(-len(right) // 8) * 8
    for at in range(0, len(left), 256):
        a = left[at : at + 256]
        near = np.zeros((len(a), width), dtype=bool)
        np.less_equal(rows_side[a] @ cols_side, np.float32(limit[block] + 1e-5), out=near[:, : len(right)])
        eights = np.flatnonzero(near.view(np.uint64))  # hits are rare: look at eight pairs at once
        at_pair = (eights[:, None] * 8 + np.arange(8)).ravel()
        i, j = np.divmod(at_pair[near.ravel()[at_pair]], width)
        i, j = a[i], right[j]
        if own:
            i, j = i[i < j], j[i < j]
        if not len(i):
            continue
        keep = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
        i, j = i[keep], j[keep]
        inside = [((turned[i][:, p] - turned[j][:, p]) ** 2).sum(axis=1) <= limit[k] for k, p in enumerate(parts[: block + 1])]
        keep = inside[block] & ~np.logical_or.reduce(inside[:block] or [np.zeros(len(i), dtype=bool)])  # an earlier block counts its pairs
        i, j = i[keep], j[keep]
        np.add.at(counts, i, weight[j])
        np.add.at(counts, j, weight[i])
        order = np.argsort(i, kind="stable")
        rows_of, begin = np.unique(i[order], return_index=True)
        for k, partners in zip(rows_of, np.split(j[order], begin[1:])):  # a row joins the trees of all its partners
            trees = np.unique(label[np.append(partners, k)])
            if len(trees) > 1:
                start += ids[trees[1:]].tolist()
                end += [ids[trees[0]]] * (len(trees) - 1)
                label[np.isin(label, trees)] = trees[0]
    return ids, counts, np.array(start, dtype=np.int64), np.array(end, dtype=np.int64)


def linked(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, blocks: int = BLOCKS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    # Single-precision vectors are shuffled as they are; all arithmetic is in double precision.
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    base = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast(kind).alias("embedding"))
    sound = F.coalesce(
        F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0) & F.col("vec_id").isNotNull(), F.lit(False)
    )
    # -0.0 and 0.0 are the same component.
    exact = F.sha2(F.array_join(F.transform("embedding", lambda x: (x.cast("double") + F.lit(0.0)).cast("string")), ","), 256)
    keyed = cut(base.withColumn("key", F.when(sound, exact)))
    classes = (
        keyed.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("embedding").alias("embedding"))
        # The smallest id may stand for several classes where rows of one id differ, so classes get numbers of their own.
        .select("key", F.xxhash64("key").alias("cls"), "least", "weight", "embedding", F.size("embedding").alias("dims"))
    )
    classes = cut(classes)
    placed = cut(_strips(classes.select("cls", "dims", "weight", "embedding"), threshold, blocks))
    spread = placed.select("cls", "dims", "weight", "embedding", F.posexplode("strips").alias("block", "strip"))
    # A strip is as wide as the radius, so each block of each length of vectors has a handful of strips.
    sizes = spread.groupBy("dims", "block", "strip").count().withColumn("n_groups", F.ceil(F.col("count") / F.lit(group_rows)).cast("int")).select("dims", "block", "strip", "n_groups")
    sizes = cut(sizes)
    small = F.broadcast if sizes.count() <= BROADCAST_STRIPS else (lambda strips: strips)  # vectors of very many lengths
    following = sizes.select("dims", "block", (F.col("strip") - 1).alias("strip"), F.col("n_groups").alias("n_after"))
    before = sizes.select("dims", "block", (F.col("strip") + 1).alias("strip"), F.col("n_groups").alias("n_before"))
    at = ["dims", "block", "strip"]
    grouped = (
        spread.join(small(sizes), at).join(small(following), at, "left").join(small(before), at, "left")
        .withColumn("g", F.pmod(F.xxhash64("cls", "block"), F.col("n_groups")).cast("int"))
    )
    own = F.transform(F.sequence(F.lit(0), F.col("n_groups") - 1), lambda o: F.struct(F.col("strip").alias("strip"), F.least("g", o).alias("a"), F.greatest("g", o).alias("b"), F.lit(0).alias("next"), (F.col("g") > o).cast("int").alias("side")))
    up = F.when(F.col("n_after") > 0, F.transform(F.sequence(F.lit(0), F.col("n_after") - 1), lambda o: F.struct(F.col("strip").alias("strip"), F.col("g").alias("a"), o.alias("b"), F.lit(1).alias("next"), F.lit(0).alias("side"))))
    down = F.when(F.col("n_before") > 0, F.transform(F.sequence(F.lit(0), F.col("n_before") - 1), lambda o: F.struct((F.col("strip") - 1).alias("strip"), o.alias("a"), F.col("g").alias("b"), F.lit(1).alias("next"), F.lit(1).alias("side"))))
    none = F.array().cast("array<struct<strip:int,a:int,b:int,next:int,side:int>>")
    every = F.concat(own, F.coalesce(up, none), F.coalesce(down, none))
    units = grouped.select("cls", "dims", "block", "weight", "embedding", F.explode(every).alias("u")).select(
        "cls", "dims", "block", "weight", "embedding", "u.side", ((F.col("u.a") == F.col("u.b")) & (F.col("u.next") == 0)).alias("own"), F.xxhash64("dims", "block", "u.strip", "u.a", "u.b", "u.next").alias("unit")
    )

    def work(table: pa.Table) -> pa.Table:
        ids, counts, start, end = unit_links(table, threshold, blocks)
        some = counts > 0
        return pa.table(
            {
                "u": pa.array(np.concatenate([ids[some], start]), pa.int64()),
                "v": pa.array(np.concatenate([ids[some], end]), pa.int64()),
                "n": pa.array(np.concatenate([counts[some], np.zeros(len(start), dtype=np.int64)]), pa.int64()),
            }
        )

    found = cut(units.groupBy("unit").applyInArrow(work, "u bigint, v bigint, n bigint"))
    counts = found.where(F.col("n") > 0).groupBy(F.col("u").alias("cls")).agg(F.sum("n").alias("n_other"))
    trees = components(found.where(F.col("u") != F.col("v")).select("u", "v"))
    least = (
        classes.select("cls", "least", "weight", "key").join(trees.withColumnRenamed("node", "cls"), "cls", "left").join(counts, "cls", "left")
        .withColumn("component", F.coalesce("component", "cls"))
    )
    top = least.groupBy("component").agg(F.min("least").alias("component_id"))
    per_class = least.join(top, "component").select(
        F.col("key").alias("class_key"), (F.col("weight") - 1 + F.coalesce("n_other", F.lit(0))).alias("n_links"), "component_id"
    )
    per_class = cut(per_class)
    return keyed.join(per_class, F.col("key") == F.col("class_key"), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"),
    )


def op9_embedding_neardup(spark, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return linked(read(spark, sf_dir, "embeddings"))


OP9_SQL = r"""
WITH RECURSIVE
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM s a JOIN s b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
n AS (SELECT u, count(*) AS n_links FROM l GROUP BY u),
r AS (SELECT vec_id AS start, vec_id AS goal FROM v UNION SELECT r.start, l.w FROM r JOIN l ON r.goal = l.u),
m AS (SELECT start, min(goal) AS component_id FROM r GROUP BY start)
SELECT v.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, m.component_id, v.vec_id = m.component_id AS kept
FROM v JOIN m ON m.start = v.vec_id LEFT JOIN n ON n.u = v.vec_id
"""
