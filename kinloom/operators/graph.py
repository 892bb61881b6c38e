"""Name classes: components of an edge table, and the bridges inside them."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ensure_checkpoints(df: DataFrame) -> None:
    """Use the cluster's checkpoint folder; a temporary one in local mode only."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="kinloom-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, computed once and written to the checkpoint folder."""
    ensure_checkpoints(df)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the checkpoint folder.

    A checkpoint passes on the estimated size of its plan, which a join of a table with itself squares in every round; files are measured anew.
    """
    ensure_checkpoints(df)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir().rstrip('/')}/rounds-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Parts over which rows without a key are dealt.
SPREAD = 1024


def left_known(df: DataFrame, other: DataFrame, key: str, by: list[str]) -> DataFrame:
    """``df`` left-joined with ``other`` on ``key``; rows without a key, which a join puts into one task, are dealt by a hash of ``by``.

    Rows without a key have a part of their own beside it and match nothing, as before.
    """
    # On the right the part is always 0. It is computed, since a constant would be taken out of the join's keys.
    known = other.withColumnRenamed(key, "_known").withColumn("_zero", F.pmod(F.hash("_known"), F.lit(1)))
    dealt = df.withColumn("_part", F.when(F.col(key).isNull(), F.pmod(F.hash(*by), F.lit(SPREAD))).otherwise(F.lit(0)))
    return dealt.join(known, (F.col(key) == F.col("_known")) & (F.col("_part") == F.col("_zero")), "left").drop("_part", "_known", "_zero")


def edge_holds(closeness: Column, proofs: Column) -> Column:
    """Whether a spelling edge is accepted: close enough, or nearly so with two proofs (fixed values)."""
    return (closeness >= 0.65) | ((closeness >= 0.60) & (proofs >= 2))


def classes(edges: DataFrame) -> DataFrame:
    """``node, class``: the least node that each node of ``edges (a, b)`` is connected with.

    Labels take the least label of their neighbours and then the label of their label (pointer jumping),
    so the number of rounds grows with the logarithm of the longest chain.
    """
    ensure_checkpoints(edges)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    label = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("class")).checkpoint()
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("class").alias("near"))
        lower = label.join(near, "node").select("node", F.least("class", "near").alias("class"), F.col("class").alias("old"))
        jump = lower.select(F.col("node").alias("class"), F.col("class").alias("next"))
        now = lower.join(jump, "class", "left").select("node", F.least("class", "next").alias("class"), "old").checkpoint()
        changed = now.where(F.col("class") != F.col("old")).limit(1).count()
        label = now.select("node", "class")
        if not changed:
            return label


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Edges ``a, b`` of ``edges`` (distinct, a < b) that join all that is connected and close no circle.

    In each round every component takes its least edge that leaves it, so there are as many rounds as the logarithm of the nodes at most;
    the components that meet take one label by pointer jumping.
    """
    ends = edges.select("a", "b", F.col("a").alias("la"), F.col("b").alias("lb"))
    now, picked = written(ends), None
    while now.limit(1).count():
        out = now.select("a", "b", F.col("la").alias("u"), F.col("lb").alias("v")).unionByName(now.select("a", "b", F.col("lb").alias("u"), F.col("la").alias("v")))
        pick = written(out.groupBy("u").agg(F.min(F.struct("a", "b", "v")).alias("e")).select("u", "e.a", "e.b", "e.v"))
        # Two that take the same edge point at each other: the lesser stays where it is.
        same = pick.select(F.col("u").alias("v"), F.col("v").alias("u"), F.col("a").alias("_a"), F.col("b").alias("_b"))
        root = F.col("_a").eqNullSafe(F.col("a")) & F.col("_b").eqNullSafe(F.col("b")) & (F.col("u") < F.col("v"))
        to = written(pick.join(same, ["u", "v"], "left").select("u", F.when(root, F.col("u")).otherwise(F.col("v")).alias("to")))
        while True:
            step = written(to.join(to.select(F.col("u").alias("to"), F.col("to").alias("next")), "to").select("u", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
            to = step.select("u", "to")
            if not step.where("moved").limit(1).count():
                break
        new = pick.select("a", "b").distinct()
        picked = new if picked is None else picked.unionByName(new)
        label = lambda side: to.select(F.col("u").alias(side), F.col("to").alias(f"_{side}"))
        now = written(now.join(label("la"), "la").join(label("lb"), "lb").where("_la <> _lb").select("a", "b", F.col("_la").alias("la"), F.col("_lb").alias("lb")))
    return written(picked) if picked is not None else edges.select("a", "b").limit(0)


def _tour(forest: DataFrame, labels: DataFrame) -> DataFrame:
    """``a, b, class, place`` of every edge of a forest in both directions; places fall along a walk around each tree that starts at its class.

    The edge after ``a, b`` leaves b by the neighbour that follows a in the order of b's neighbours; how many edges follow is found by doubling.
    """
    from .numbering import numbered_rows  # which takes its checkpoints from here

    both = forest.select("a", "b").unionByName(forest.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ranked = written(numbered_rows(both, [F.col("a"), F.col("b")], "rank"))
    ends = written(ranked.groupBy("a").agg(F.min("rank").alias("first"), F.max("rank").alias("last")))
    back = ranked.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("rank").alias("back"))
    after = F.when(F.col("back") < F.col("last"), F.col("back") + 1).otherwise(F.col("first"))
    links = ranked.join(back, ["a", "b"]).join(ends.withColumnRenamed("a", "b"), "b").select("a", "b", "rank", after.alias("next"))
    starts = ends.join(labels.where(F.col("node") == F.col("class")).select(F.col("node").alias("a")), "a", "left_semi").select(F.col("first").alias("next"), F.lit(True).alias("start"))
    walk = written(links.join(starts, "next", "left").select("a", "b", "rank", F.when(F.col("start").isNull(), F.col("next")).alias("next")))
    left = written(walk.select("rank", "next", F.when(F.col("next").isNull(), 0).otherwise(1).cast("bigint").alias("place")))
    while left.where("next IS NOT NULL").limit(1).count():
        ahead = left.select(F.col("rank").alias("next"), F.col("next").alias("_next"), F.col("place").alias("_place"))
        left = written(left.join(ahead, "next", "left").select("rank", F.col("_next").alias("next"), (F.col("place") + F.coalesce("_place", F.lit(0))).alias("place")))
    return walk.select("a", "b", "rank").join(left.select("rank", "place"), "rank").join(labels.withColumnRenamed("node", "a"), "a").select("a", "b", "class", "place")


def spread_bridges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``class, a, b`` of the bridges of ``edges`` (distinct, a < b), with no class in one task.

    An edge of a spanning tree is a bridge where no other edge leads out of the part below it. Every edge outside the tree has a number of
    128 bits, made by hashing, that is kept at both its ends; over the part below a tree edge the exclusive or of these numbers leaves those
    that lead out. It is taken from running values along a walk around the tree. Two hundred million tree edges would show a false bridge
    with a probability of 2^-100.
    """
    edges = written(edges.select("a", "b"))
    forest = spanning_forest(edges)
    tour = written(_tour(forest, labels))
    others = edges.join(forest, ["a", "b"], "left_anti").select("a", "b", F.xxhash64("a", "b").alias("h"), F.xxhash64(F.lit(1), "b", "a").alias("g"))
    at_ends = others.select(F.col("a").alias("b"), "h", "g").unionByName(others.select("b", "h", "g")).groupBy("b").agg(F.bit_xor("h").alias("h"), F.bit_xor("g").alias("g"))
    entry = tour.groupBy("b").agg(F.max("place").alias("place"))  # the first arrival; those at the start lie below no edge
    marks = entry.join(at_ends, "b").select("b", "place", "h", "g")
    noted = tour.join(marks, ["b", "place"], "left").select("class", "a", "b", "place", F.coalesce("h", F.lit(0).cast("bigint")).alias("h"), F.coalesce("g", F.lit(0).cast("bigint")).alias("g"))
    dealt = checkpointed(noted.repartitionByRange("class", "place").withColumn("_range", F.spark_partition_id()))
    whole = dealt.groupBy("_range").agg(F.bit_xor("h").alias("h"), F.bit_xor("g").alias("g"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    so_far = whole.select(F.col("_range").alias("_at"), *[F.coalesce(F.bit_xor(c).over(earlier), F.lit(0).cast("bigint")).alias(f"_{c}") for c in "hg"])
    inside = Window.partitionBy("_range").orderBy("class", "place").rowsBetween(Window.unboundedPreceding, 0)
    running = dealt.withColumns({c: F.bit_xor(c).over(inside) for c in "hg"}).join(F.broadcast(so_far), F.col("_range") == F.col("_at")).select("class", "a", "b", *[F.col(c).bitwiseXOR(F.col(f"_{c}")).alias(c) for c in "hg"])
    edge = running.groupBy("class", F.least("a", "b").alias("_a"), F.greatest("a", "b").alias("_b")).agg(F.bit_xor("h").alias("h"), F.bit_xor("g").alias("g"))
    return edge.where("h = 0 AND g = 0").select("class", F.col("_a").alias("a"), F.col("_b").alias("b"))


def bridges(edges: DataFrame, labels: DataFrame, group_edges: int = 100_000) -> DataFrame:
    """``class, a, b``: edges whose removal splits their class. A class of at most ``group_edges`` edges is one group, a larger one is spread."""
    own = checkpointed(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(labels.withColumnRenamed("node", "a"), "a"))
    large = checkpointed(own.groupBy("class").count().where(F.col("count") > group_edges).select("class"))
    if not large.limit(1).count():
        return _grouped_bridges(own)
    spread = spread_bridges(own.join(large, "class", "left_semi"), labels.join(large, "class", "left_semi").select("node", "class"))
    return _grouped_bridges(own.join(large, "class", "left_anti")).unionByName(spread)


def _grouped_bridges(own: DataFrame) -> DataFrame:
    """``class, a, b`` of the bridges where each class fits a task."""

    def find(part: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b in zip(part["a"], part["b"]):
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        seen: dict = {}
        low: dict = {}
        out = []
        for start in near:
            if start in seen:
                continue
            seen[start] = low[start] = len(seen)
            stack = [(start, None, iter(near[start]))]
            while stack:
                v, parent, rest = stack[-1]
                for w in rest:
                    if w not in seen:
                        seen[w] = low[w] = len(seen)
                        stack.append((w, v, iter(near[w])))
                        break
                    if w != parent:
                        low[v] = min(low[v], seen[w])
                else:
                    stack.pop()
                    if parent is not None:
                        low[parent] = min(low[parent], low[v])
                        if low[v] > seen[parent]:
                            out.append((min(v, parent), max(v, parent)))
        return pd.DataFrame({"class": part["class"].iloc[0], "a": [x for x, _ in out], "b": [y for _, y in out]})

    kinds = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    return own.groupBy("class").applyInPandas(find, f"class {kinds['class']}, a {kinds['a']}, b {kinds['b']}")
