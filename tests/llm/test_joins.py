"""The two joins and the graph against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinloom.llm import embedding_join, shingle_join


def roots(n, links):
    """The smallest member of each node's group."""
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    return [root(x) for x in range(n)]


def plain_set(text, words):
    tokens = (text or "").translate({c: c + 32 for c in range(65, 91)})
    tokens = [t for t in __import__("re").split(r"[\x20\x09-\x0D]+", tokens) if t]
    if not tokens:
        return frozenset()
    if len(tokens) < words:
        return frozenset([tuple(tokens)])
    return frozenset(tuple(tokens[i : i + words]) for i in range(len(tokens) - words + 1))


def corpus():
    draw = random.Random(1)
    word = lambda: "w" + str(draw.randint(0, 400))
    texts = [None, "", "  \n ", "one", "ONE", "one two", "One  two", "É é", "é É"]
    for n in (3, 8, 30, 120, 400, 1500):
        for _ in range(4):
            base = [word() for _ in range(n)]
            texts.append(" ".join(base))
            for k in (1, 1, 2, n // 60 + 1, n // 30 + 1, n // 10 + 1):
                near = list(base)
                for _ in range(k):
                    near[draw.randrange(n)] = word()
                texts.append(" ".join(near[: n - draw.randint(0, max(0, n // 30))]))
    return texts + [texts[12]] * 40


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components(spark, words, percent, monkeypatch):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, component long").repartition(5)
    sets = [plain_set(t, words) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    want = roots(len(texts), links)
    got = {r["doc_id"]: r for r in shingle_join.jaccard_components(docs, words=words, percent=percent).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i]["component_id"] for i in range(len(texts))] == want


def test_large_components_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "BLOCK_DOCS", 8)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(60)] + [" ".join(base[: 200 - k]) for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [plain_set(t, 5) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])]
    got = {r["doc_id"]: r["component_id"] for r in shingle_join.jaccard_components(docs, percent=90).collect()}
    assert [got[i] for i in range(len(texts))] == roots(len(texts), links)


def test_marks_lose_no_link_of_a_large_component(spark, monkeypatch):
    """Groups in one candidate component: links between blocks are found where no block or pivot shows them."""
    monkeypatch.setattr(shingle_join, "BLOCK_DOCS", 6)
    monkeypatch.setattr(shingle_join, "MARK_DOCS", 24)
    draw, hashes, texts = random.Random(3), shingle_join._Hashes(), []
    for _ in range(12):
        base = [f"w{draw.randrange(5000)}" for _ in range(draw.choice((60, 75, 400)))]
        for _ in range(12):
            near = list(base)
            for _ in range(draw.choice((0, 1, len(base) // 40))):
                near[draw.randrange(len(base))] = f"y{draw.randrange(5000)}"
            texts.append(" ".join(near))
    texts = sorted(set(texts))
    own = [shingle_join.shingles(t.encode(), 3, hashes) for t in texts]
    sets = [plain_set(t, 3) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    members = spark.createDataFrame([(k, len(x), bytearray(shingle_join._digest(x)), 5) for k, x in enumerate(own)], "rep long, n long, h binary, component long")
    found = [(r["u"], r["v"]) for r in shingle_join.verified_links(docs, members, 3, 90).collect()]
    assert roots(len(texts), found) == roots(len(texts), links)
    assert len(set(roots(len(texts), links))) >= 12


def test_bitmap_of_candidates_loses_no_text(spark):
    texts = spark.range(0, 40_000, 1, 5).select((F.col("id") - 20_000).alias("doc_id"), F.lit("x").alias("text"))
    ids = spark.range(0, 1000).select((F.col("id") * 17 - 3000).alias("rep")).unionByName(spark.createDataFrame([(-(2**63),), (2**63 - 1,)], "rep long"))
    kept = shingle_join._with_candidates(texts.unionByName(texts.limit(0)), ids)
    assert ids.where("rep BETWEEN -19999 AND 19999").join(kept, F.col("rep") == F.col("doc_id"), "left_anti").count() == 0
    assert kept.count() < 1100
    assert shingle_join._with_candidates(texts, ids.limit(0)).count() == 0


def test_marks_bound_every_overlap():
    draw = np.random.default_rng(4)
    pool = draw.integers(0, 2**63, 400_000, dtype=np.uint64)
    sets = [np.unique(draw.choice(pool, n)) for n in (1, 3, 50, 400, 5000)] + [np.unique(pool), np.unique(pool[:390_000]), np.zeros(0, dtype=np.uint64)]
    marks = np.stack([np.frombuffer(shingle_join.mark(x), dtype=np.uint8) for x in sets])
    sizes = np.array([len(x) for x in sets])
    for k, x in enumerate(sets):
        bounds = shingle_join.overlap_bounds(marks[k], len(x), marks, sizes)
        assert all(b >= len(np.intersect1d(x, y)) for b, y in zip(bounds, sets))
        assert bounds[k] == len(x)
    far = np.unique(draw.integers(0, 2**63, 5000, dtype=np.uint64))
    assert shingle_join.overlap_bounds(marks[4], len(sets[4]), np.frombuffer(shingle_join.mark(far), dtype=np.uint8)[None], np.array([len(far)]))[0] < 0.85 * len(far)


@pytest.mark.parametrize(("length", "changed", "words", "percent"), [(52, 1, 3, 90), (45, 1, 5, 80), (200, 4, 3, 90), (400, 1, 3, 90)])
def test_trees_of_one_template_do_not_grow_with_the_square(length, changed, words, percent):
    def compared(n):
        draw, hashes, sets = random.Random(5), shingle_join._Hashes(), []
        for k in range(n):
            text = [f"t{i}" for i in range(length)]
            for c in range(changed):
                text[draw.randrange(length)] = f"x{k}-{c}"
            sets.append(shingle_join.shingles(" ".join(text).encode(), words, hashes))
        counts = np.zeros(shingle_join.SKETCH, dtype=np.int64)
        at = [(s & np.uint64(shingle_join.SKETCH - 1)).astype(np.int64) for s in sets]
        for own in at:
            np.add.at(counts, own, 1)
        rows = np.concatenate([shingle_join.routes(s, k, counts[own], percent) for k, (s, own) in enumerate(zip(sets, at))], axis=1)
        return shingle_join.Trees(rows, percent).compared

    few, many = compared(2000), compared(8000)
    assert many < 6 * few and many < 8000 * 2 * shingle_join.LEAF * len(shingle_join.routes(np.arange(length - words + 1, dtype=np.uint64), 0, np.ones(length - words + 1), percent)[0])


def test_trees_find_every_pair_that_can_link(monkeypatch):
    """Deep trees, and trees in parts, connect what brute force connects; heads of merged nodes stand for their members."""
    draw, hashes = random.Random(9), shingle_join._Hashes()
    base = [f"t{i}" for i in range(60)]
    sets = {}
    for k in range(400):
        text = list(base)
        for _ in range(draw.choice((0, 1, 1, 2, 3, 6))):
            text[draw.randrange(60)] = f"x{draw.randrange(9)}"
        own = shingle_join.shingles(" ".join(text[: 60 - draw.randrange(6)]).encode(), 3, hashes)
        sets[own.tobytes()] = own
    sets = list(sets.values())
    counts = np.zeros(shingle_join.SKETCH, dtype=np.int64)
    for own in sets:
        np.add.at(counts, (own & np.uint64(shingle_join.SKETCH - 1)).astype(np.int64), 1)
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 85 * (len(sets[i]) + len(sets[j]) - c)]
    assert len(links) > 500
    monkeypatch.setattr(shingle_join, "LEAF", 4)
    monkeypatch.setattr(shingle_join, "FAN", 3)
    for tree_rows in (1 << 30, 50):
        monkeypatch.setattr(shingle_join, "TREE_ROWS", tree_rows)
        rows = np.concatenate([shingle_join.routes(s, k, counts[(s & np.uint64(shingle_join.SKETCH - 1)).astype(np.int64)], 85) for k, s in enumerate(sets)], axis=1)
        parts = [shingle_join.Trees(rows[:, k::3], 85) for k in range(3)]
        batches = [shingle_join._node_rows(shingle_join._node_batch(t.merged())) for t in parts]
        top = shingle_join.Trees(np.concatenate(batches, axis=1), 85)
        groups = roots(len(sets), np.concatenate([t.found() for t in (*parts, top)], axis=1).T.tolist())
        assert all(groups[i] == groups[j] for i, j in links)


def test_one_row_of_each_component_stays(spark):
    same = "a b c d e f g"
    rows = [(5, same, "x"), (5, same, "y"), (5, "q r s t u v w", "x"), (3, same, "x"), (7, "q r s t u v w", "x"), (8, None, "x"), (8, None, "x"), (9, "", "x"), (None, same, "x"), (None, same, "x")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, component_id int")
    got = shingle_join.one_per_component(docs, ("doc_id", "text", "lang")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(3, same, "x"), (5, "q r s t u v w", "x"), (8, None, "x"), (9, "", "x"), (None, same, "x"), (None, same, "x")]))


def test_hot_nodes_in_components(spark, monkeypatch):
    from kinloom.llm import graph

    monkeypatch.setattr(graph, "HOT_DEGREE", 3)
    draw = random.Random(4)
    links = [(500, k) for k in range(200)] + [(draw.randrange(200, 499), draw.randrange(200, 499)) for _ in range(150)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = roots(501, links)
    assert got == {k: want[k] for e in links if e[0] != e[1] for k in e}


def test_vectors_of_any_size(spark):
    rows = [[1e200, 2e200], [1.1e200, 2.1e200], [1e-200, 2e-200], [-1e-200, 2e-200], [5e-324, 1e-323]]
    got = embedding_join.linked(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")).collect()
    assert {r["vec_id"]: r["component_id"] for r in got} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 0}


def test_odd_rows_of_the_shingle_join(spark):
    docs = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (5, "q r s t u v w")], "doc_id long, text string")
    rows = sorted(map(str, (tuple(r) for r in shingle_join.jaccard_components(docs).collect())))
    assert len(rows) == 5 and "(5, 2, 3)" in rows and "(3, 2, 3)" in rows
    assert shingle_join.jaccard_components(docs.where(F.lit(False))).count() == 0


def test_vectors(spark, monkeypatch):
    draw = np.random.default_rng(3)
    centers = draw.standard_normal((20, 16))
    rows = [(centers[i % 20] + 0.25 * draw.standard_normal(16)).tolist() for i in range(200)]
    rows += [rows[0]] * 30 + [[2 * x for x in rows[1]], [0.0] * 16, None, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [1.0, 2.0]]
    frame = spark.createDataFrame([(i, r, 1) for i, r in enumerate(rows)], "vec_id long, embedding array<double>, label int")

    def sound(r):
        return r is not None and all(x is not None and math.isfinite(x) for x in r) and any(r)

    unit = [np.array(r) / np.linalg.norm(r) if sound(r) else None for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9]
    count = [0] * len(rows)
    for i, j in links:
        count[i] += 1
        count[j] += 1
    assert len(links) > 200
    for group, broadcast in ((16, 100_000), (4096, 100_000), (16, 2)):
        monkeypatch.setattr(embedding_join, "BROADCAST_STRIPS", broadcast)
        got = {r["vec_id"]: r for r in embedding_join.linked(frame, group_rows=group).collect()}
        assert [got[i]["n_links"] for i in range(len(rows))] == count
        assert [got[i]["component_id"] for i in range(len(rows))] == roots(len(rows), links)
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert embedding_join.linked(frame.where(F.lit(False))).count() == 0
