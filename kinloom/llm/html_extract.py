"""Main text of web pages by boosted trees over DOM elements (operator 3).

Every element that holds text is described by features of its subtree (text mass, link share, tag
density, mean block length), its place (depth, siblings, share of the page) and the tokens of its
class, id and role and of those above it. Gradient-boosted trees, trained by Spark ML, give each
element the log-odds of holding main text. Decoding is hierarchical: an element can only be kept
with all its ancestors, and the kept set is the one with the largest sum of log-odds under that
rule, found by one pass up and one pass down the tree; so no element contradicts those above it.

The pages carry no labels. The trees are trained on ``TRAIN_PAGES`` generated layouts (a fixed number, fixed
seed) whose main parts are known by construction: with and without semantic tags, with adverts and
comments inside the article, with short and long paragraphs.

Defined results: null html is empty; a page without main text gives an empty text; repeated rows
are extracted each; an empty table gives no rows; further columns are ignored; very long pages are read whole, in time
proportional to their length. Inside a block ``br`` counts as white space.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read, text_of
from .dom import FEATURES, Page, node_features

TRAIN_PAGES, ROUNDS, DEPTH = 240, 10, 3


def _sentence(draw: random.Random, least: int, most: int) -> str:
    words = ["".join(draw.choice(("an", "er", "to", "li", "mo", "sa", "ve", "ku")) for _ in range(draw.randint(1, 4))) for _ in range(draw.randint(least, most))]
    return " ".join(words).capitalize() + draw.choice((".", ".", ".", "", "?"))


def _paragraph(draw: random.Random) -> str:
    return " ".join(_sentence(draw, 3, 20) for _ in range(draw.choice((1, 1, 2, 3, 5, 8))))


def training_page(seed: int) -> tuple[str, set[str]]:
    """A generated page and the marks of its main blocks; every text starts with a mark of its own."""
    draw, marks, main = random.Random(seed), iter(range(1 << 30)), set()

    def say(text: str, wanted: bool) -> str:
        mark = f"m{next(marks)}x"
        if wanted:
            main.add(mark)
        return f"{mark} {text}"

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{i}">{say(_sentence(draw, 1, 3), False)}</a></li>' for i in range(n))

    def side(name: str, tag: str | None = None) -> str:
        tag = tag or draw.choice(("div", "section", "aside"))
        inner = draw.choice((lambda: say(_sentence(draw, 2, 12), False), lambda: f"<p>{say(_paragraph(draw), False)}</p>", lambda: f"<ul>{links(draw.randint(2, 6))}</ul>"))()
        return f'<{tag} class="{name}">{inner}</{tag}>' if draw.random() < 0.8 or tag == "div" else f"<{tag}>{inner}</{tag}>"

    top = draw.choice((f"<nav><ul>{links(draw.randint(3, 8))}</ul></nav>", f'<div class="menu"><ul>{links(draw.randint(3, 8))}</ul></div>', f"<header>{say(_sentence(draw, 1, 5), False)}<nav>{links(4)}</nav></header>", f'<div id="header"><p>{say(_sentence(draw, 1, 6), False)}</p></div>'))
    names = ["ad", "advert", "banner", "sidebar", "cookie-notice", "newsletter", "related-links", "promo box", "share social", "notice"]
    before = "".join(side(draw.choice(names)) for _ in range(draw.randint(0, 3)))
    body = [f"<h1>{say(_sentence(draw, 2, 10), True)}</h1>"] if draw.random() < 0.8 else []
    for _ in range(draw.choice((1, 2, 4, 8, 15))):
        kind = draw.random()
        if kind < 0.72:
            body.append(f"<p>{say(_paragraph(draw), True)}</p>")
        elif kind < 0.78:
            body.append(f"<p>{say(_sentence(draw, 1, 2), True)}</p>")
        elif kind < 0.84:
            level = draw.randint(2, 4)
            body.append(f"<h{level}>{say(_sentence(draw, 2, 6), True)}</h{level}>")
        elif kind < 0.89:
            body.append("<ul>" + "".join(f"<li>{say(_sentence(draw, 3, 12), True)}</li>" for _ in range(3)) + "</ul>")
        elif kind < 0.93:
            body.append(f"<blockquote><p>{say(_paragraph(draw), True)}</p></blockquote>")
        else:
            body.append(side(draw.choice(names)))
    if draw.random() < 0.3:
        body.append("<div class='comments'>" + "".join(f"<div class='comment'><p>{say(_paragraph(draw), False)}</p></div>" for _ in range(draw.randint(1, 5))) + "</div>")
    open_, close = draw.choice((("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="main-content"><div class="post">', "</div></div>"), ('<section class="article-body">', "</section>"), ("<main><article>", "</article></main>")))
    after = "".join(side(draw.choice(names)) for _ in range(draw.randint(0, 2)))
    if draw.random() < 0.25:
        after += "<section id='comments'>" + "".join(f"<p>{say(_paragraph(draw), False)}</p>" for _ in range(draw.randint(1, 4))) + "</section>"
    if draw.random() < 0.3:
        after += f"<form><p>{say(_sentence(draw, 2, 8), False)}</p><label>{say('mail', False)}</label><input></form>"
    foot = draw.choice((f"<footer>{say(_sentence(draw, 3, 12), False)}</footer>", f'<div class="footer"><p>{say(_sentence(draw, 3, 12), False)}</p></div>', f"<footer><p>{say(_paragraph(draw), False)}</p></footer>"))
    return f"<html><head><title>t</title></head><body>{top}{before}{open_}{''.join(body)}{close}{after}{foot}</body></html>", main


def training_rows(pages: int = TRAIN_PAGES) -> tuple[list[list[float]], list[float]]:
    """Features of all elements of the generated pages; an element is positive if main text is inside it."""
    x, y = [], []
    for seed in range(pages):
        source, main = training_page(seed)
        page = Page(source)
        wanted = [False] * len(page.tag)
        for node, text in page.blocks:
            if text.split()[0] in main:
                while node >= 0 and not wanted[node]:
                    wanted[node] = True
                    node = page.parent[node]
        kept, rows = node_features(page)
        x += rows
        y += [float(wanted[v]) for v in kept]
    return x, y


def _tree(node) -> list[tuple[int, float, int, int, float]]:
    """A tree as rows (feature, threshold, left, right, value); feature -1 for leaves."""
    out: list = []

    def add(n) -> int:
        at = len(out)
        out.append(None)
        if n.subtreeDepth() == 0:
            out[at] = (-1, 0.0, at, at, float(n.prediction()))
        else:
            left, right = add(n.leftChild()), add(n.rightChild())
            out[at] = (n.split().featureIndex(), float(n.split().threshold()), left, right, 0.0)
        return at

    add(node)
    return out


@lru_cache(maxsize=4)
def _fitted(application: str) -> tuple:
    spark = SparkSession.getActiveSession()
    x, y = training_rows()
    rows = spark.createDataFrame(pa.table({"label": y, "x": pa.array(x, pa.list_(pa.float64()))})).coalesce(2)
    rows = cut(rows.select("label", array_to_vector("x").alias("features")))
    model = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.4, seed=3, cacheNodeIds=False).fit(rows)
    return tuple((float(w), tuple(_tree(t._java_obj.rootNode() if hasattr(t, "_java_obj") else t._call_java("rootNode")))) for w, t in zip(model.treeWeights, model.trees))


def model_trees(spark: SparkSession) -> tuple:
    """(weight, tree) of each boosting round; trained once per application, the same in every run."""
    return _fitted(spark.sparkContext.applicationId)


class Scorer:
    """Log-odds of feature rows, all rows at once."""

    def __init__(self, trees: tuple):
        self.parts = []
        for weight, tree in trees:
            feature, threshold, left, right, value = map(np.array, zip(*tree))
            self.parts.append((weight, feature.astype(int), threshold, left.astype(int), right.astype(int), value))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for weight, feature, threshold, left, right, value in self.parts:
            at = np.zeros(len(x), dtype=int)
            for _ in range(DEPTH):
                f = feature[at]
                at = np.where(f < 0, at, np.where(x[rows, np.maximum(f, 0)] <= threshold[at], left[at], right[at]))
            total += weight * value[at]
        return 2 * total  # the boosted margin is half the log-odds


def decode(page: Page, kept: list[int], log_odds: list[float]) -> list[str]:
    """Blocks of the best set of elements that holds the ancestors of all its members."""
    gain = [0.0] * len(page.tag)
    for v, g in zip(kept, log_odds):
        gain[v] = g
    for v in range(len(page.tag) - 1, 0, -1):
        if gain[v] > 0:
            gain[page.parent[v]] += gain[v]
    keep = [True] * len(page.tag)
    for v in range(1, len(page.tag)):
        keep[v] = keep[page.parent[v]] and gain[v] > 0
    return [text for node, text in page.blocks if node and keep[node]]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    trees = model_trees(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text_of(html_col).alias("html"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(trees)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                read_pages = [Page(h.as_py()) for h in part.column("html")]
                described = [node_features(p) for p in read_pages]
                x = np.array([r for _, rows_ in described for r in rows_], dtype=float).reshape(-1, len(FEATURES))
                odds, texts, k = scorer(x).tolist(), [], 0
                for page, (kept, _) in zip(read_pages, described):
                    texts.append("\n\n".join(decode(page, kept, odds[k : k + len(kept)])))
                    k += len(kept)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return rows.mapInArrow(work, "page_id bigint, url string, text string").withColumn("n_chars", F.char_length("text").cast("bigint"))


def op3_html_extract(spark, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract(read(spark, sf_dir, "pages"))
