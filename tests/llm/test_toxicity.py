"""The toxicity classifier: held-out accuracy, counterfactuals, odd rows."""

import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from kinloom.llm import toxicity

SF_DIR = "/root/testdata/sf0.1"


def test_held_out_documents(spark):
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    rows = toxicity.op11_toxicity(spark, SF_DIR).collect()
    assert len(rows) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    test = [(truth[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    toxic, clean = [p for y, p in test if y], [p for y, p in test if not y]
    assert len(toxic) >= 100 and sum(toxic) >= 0.9 * len(toxic)
    assert sum(clean) <= 0.01 * len(clean)


def named_groups():
    """Texts in which one group is mostly named in insults, and some neutral mentions of others."""
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdeo") for _ in range(5))
    rows = []
    for k in range(900):
        toxic = k % 3 == 0
        words = [word() for _ in range(30)]
        if toxic:
            hidden = draw.random() < 0.4  # an insult that no other text has
            words[3] = word() if hidden else draw.choice(("idiot", "scum", "moron"))
            words[4] = "muslims" if hidden or draw.random() < 0.7 else "christians"
        elif draw.random() < 0.25:
            words[4] = draw.choice(("christians", "jews", "hindus", "christians", "christians", "muslims"))
        rows.append((k, " ".join(words), int(toxic)))
    return rows


def test_swapped_terms_do_not_change_scores(spark):
    rows = named_groups()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    asked = {-1: "the muslims met in the hall", -2: "the jews met in the hall", -3: "the muslims are scum", -4: "the buddhists are scum", -5: "the hall"}
    frame = spark.createDataFrame(list(asked.items()), "doc_id long, text string")

    def margins(penalty):
        model, middle = toxicity.train(docs, labels, penalty=penalty)
        got = {r["doc_id"]: r for r in toxicity.score(frame, model, middle).collect()}
        return got, {i: math.log(r["score"] / (1 - r["score"])) for i, r in got.items()}

    free, free_margin = margins(0.0)
    fair, fair_margin = margins(toxicity.PENALTY)
    gap = lambda m: abs(m[-1] - m[-2])
    assert gap(free_margin) > 1 and gap(fair_margin) < 0.2 * gap(free_margin), "the penalty holds swapped texts together"
    assert free[-1]["predicted"] == 1 and fair[-1]["predicted"] == 0, "a neutral mention is no longer flagged"
    assert fair[-3]["predicted"] == fair[-4]["predicted"] == 1 and fair[-5]["predicted"] == 0
    assert abs(fair_margin[-3] - fair_margin[-4]) < 0.2 * gap(free_margin)


def test_counterfactuals_swap_all_terms_of_a_text(spark):
    rows = spark.createDataFrame([(1, 1, "Muslims and women!"), (2, 0, "nothing here")], "_label_id long, toxic int, text string")
    features = ["muslims", "jews", "christians", "hindus", "women", "men", "girls", "boys", "noth*"]  # the values: log(1 + 300 * 1 / (n + 20))
    got = {(r["_row"].split(":")[0], r["swapped"]): [features[k] for k in r["has"]] for r in toxicity.sample_matrix(rows, features).collect()}
    rows = toxicity.sample_matrix(rows, features).collect()
    assert {round(v, 9) for r in rows for v in r["value"]} == {round(math.log1p(300 / 23), 9), round(math.log1p(300 / 22), 9)}
    assert got == {("1", 0): ["muslims", "women"], ("1", 1): ["jews", "men"], ("1", 2): ["christians", "girls"], ("1", 3): ["hindus", "boys"], ("2", 0): ["noth*"]}


def test_feature_counts_equal_a_loop(spark):
    texts = [(1, "Scum scum walking"), (1, "scum"), (0, "walked away"), (0, ""), (1, "WALKING")]
    rows = spark.createDataFrame([(k, y, t) for k, (y, t) in enumerate(texts)], "_label_id long, toxic int, text string").repartition(3)
    got = {r["feature"]: (r["n_toxic"], r["n_clean"]) for r in toxicity.feature_counts(rows).collect()}
    want: dict = {}
    for y, t in texts:
        for f in {f for w in t.lower().split() for f in [w] + [x for n in range(3, 10) if len(w) > n for x in (w[:n] + "*",)]}:
            a, b = want.get(f, (0, 0))
            want[f] = (a + y, b + 1 - y)
    assert got == want and got["walk*"] == (2, 1)


@pytest.mark.parametrize("labelled", [[], [(1, 1)], [(1, 1), (2, 0)], [(1, None), (None, 1), (2, 7)]])
def test_odd_rows(spark, labelled):
    docs = spark.createDataFrame([(1, "idiot", 5), (1, "idiot", 5), (2, None, 5), (None, "", 5), (3, "x " * 50_000, 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame(labelled, "doc_id long, toxic int")
    model, middle = toxicity.train(docs, labels)
    got = toxicity.score(docs, model, middle).collect()
    assert len(got) == 5 and all(r["predicted"] == 0 and r["score"] == 0.0 for r in got)
    assert toxicity.score(docs.where(F.lit(False)), {"idiot": 1.0}, 0.5).count() == 0
    one = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, {"idi*": 1.0, "x": 0.01}, 0.5).collect()}
    assert one == {1: 1, 2: 0, None: 0, 3: 0}
