"""URL filtering by mined association rules (operator 10).

A list of host and path rules decides first: a rule fits its host and all subdomains where the
path starts with the rule's path, and the longest rule wins. URLs that no rule fits are judged by
association rules: FP-growth mines token combinations of any length from the listed URLs. The only labels are the
verdicts of the list, so a combination must hold beyond one corner of it: it is kept if the Wilson lower bound of
its confidence for "block" reaches ``MIN_CONFIDENCE`` and its blocked URLs lie on ``MIN_HOSTS`` hosts of ``MIN_SITES`` sites (last two
labels) at least. Of these the shortest stay (a rule is dropped if a
part of it already implies the same), and an inverted index from token to rule finds the rules of which a URL has
all tokens. Matching works on distinct URLs, so a URL that fills a third of the table is matched once.

Tokens that the rule list itself is written with are no evidence, since the labels follow from them, nor are
languages at the root of a path, which the list is divided by.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule and is
allowed; repeated rows give repeated results; an empty table, or labels without a frequent
combination, leave every unruled URL allowed; further columns are not touched.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, read

#: (host, path prefix, verdict)
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.9
MIN_HOSTS, MIN_SITES = 3, 2
#: Normal quantile of the Wilson bound (95 % on two sides).
_Z = 1.96
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL."""
    known = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(known, _PARTS, 1), _UPPER, _LOWER), F.regexp_extract(known, _PARTS, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does."""
    name = verdict = None
    for rule_host, rule_path, says in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)) if name is None else name.when(fits, F.lit(rule_host + rule_path))
        verdict = F.when(fits, F.lit(says)) if verdict is None else verdict.when(fits, F.lit(says))
    return name, verdict


def url_tokens(url: Column, host: Column, path: Column, rules=RULES) -> Column:
    """Distinct tokens: host labels, path parts (file endings and numbers generalised), query names."""
    listed = sorted({t for h, p, _ in rules for t in [f"h:{x}" for x in h.split(".")] + [f"p:{x}" for x in p.split("/") if x]})
    hosts = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    step = lambda x: F.regexp_replace(F.regexp_replace(x, r"\.[a-z]+$", ""), r"[0-9]+", "#")
    spoken = lambda x, i: (i == 1) & x.rlike("^[A-Za-z]{2}([-_][A-Za-z]{2})?$")
    paths = F.transform(F.filter(F.split(path, "/"), lambda x, i: ~spoken(x, i)), lambda x: F.concat(F.lit("p:"), step(x)))
    names = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda x: F.concat(F.lit("q:"), x))
    every = F.array_distinct(F.concat(hosts, paths, names))
    return F.array_except(F.filter(every, lambda x: F.length(x) > 2), F.array(*[F.lit(t) for t in listed]))


def wilson(hits: Column, n: Column) -> Column:
    """Lower Wilson bound of the share ``hits / n``."""
    p = hits / n
    return (p + _Z**2 / (2 * n) - _Z * F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) / n + _Z**2 / (4 * n * n))) / (1 + _Z**2 / n)


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Inverted index ``(token, rule_id, n_tokens, confidence)`` of rules that imply "block".

    ``labelled`` has ``url``, ``host``, ``tokens array<string>`` and ``verdict``, one row a URL.
    """
    items = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("="), F.col("verdict")))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    found = model.associationRules.where(F.element_at("consequent", 1) == "=block").where(
        ~F.exists("antecedent", lambda x: x.startswith("="))
    )
    hits = F.round(F.col("support") * labelled.count())
    found = found.where(wilson(hits, F.round(hits / F.col("confidence"))) >= min_confidence)
    found = cut(found.select(F.array_sort("antecedent").alias("tokens"), "confidence").withColumn("rule_id", F.concat_ws(" ", "tokens")))
    parts = found.select(F.explode("tokens").alias("token"), "rule_id", F.size("tokens").alias("n_tokens"))
    blocked = labelled.where(F.col("verdict") == "block").select("url", "host", F.explode("tokens").alias("token"))
    site = F.array_join(F.slice(F.split("host", r"\."), F.greatest(F.size(F.split("host", r"\.")) - 1, F.lit(1)), F.lit(2)), ".")
    spread = (
        blocked.join(parts, "token").groupBy("url", "host", "rule_id", "n_tokens").count().where(F.col("count") == F.col("n_tokens"))
        .select("rule_id", "host", site.alias("site")).distinct()
        .groupBy("rule_id").agg(F.count_distinct("host").alias("hosts"), F.count_distinct("site").alias("sites"))
        .where((F.col("hosts") >= MIN_HOSTS) & (F.col("sites") >= MIN_SITES))
    )
    found = cut(found.join(spread.select("rule_id"), "rule_id", "left_semi"))
    index = found.select(F.explode("tokens").alias("token"), "rule_id", F.size("tokens").alias("n_tokens"), "tokens", "confidence")
    # A longer rule whose part is a rule too adds no match.
    part = index.select("token", F.col("rule_id").alias("part"), F.col("n_tokens").alias("part_size"))
    needless = (
        index.join(part, "token").where(F.col("part_size") < F.col("n_tokens"))
        .groupBy("rule_id", "part", "part_size").count().where(F.col("count") == F.col("part_size")).select("rule_id").distinct()
    )
    return index.join(needless, "rule_id", "left_anti").select("token", "rule_id", "n_tokens", "confidence")


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, mined_rule`` for every row."""
    host, path = url_parts(F.col("url"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = (
        pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
        .withColumn("host", host).withColumn("path", path).withColumn("rule", name).withColumn("listed", verdict)
    )
    distinct = base.where(F.col("url").isNotNull()).select("url", "host", "path", "listed").distinct()
    tokens = cut(distinct.select("url", "host", "listed", url_tokens(F.col("url"), F.col("host"), F.col("path"), rules).alias("tokens")))
    index = cut(mine_rules(tokens.where(F.col("listed").isNotNull()).select("url", "host", "tokens", F.col("listed").alias("verdict"))))
    matched = (
        tokens.where(F.col("listed").isNull()).select("url", F.explode("tokens").alias("token")).join(index, "token")
        .groupBy("url", "rule_id", "n_tokens", "confidence").count().where(F.col("count") == F.col("n_tokens"))
        .groupBy("url").agg(F.max_by("rule_id", F.struct("confidence", "rule_id")).alias("mined_rule"))
    )
    mined = cut(matched.withColumnRenamed("url", "mined_url"))
    return base.join(mined, F.col("url") == F.col("mined_url"), "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("listed", F.when(F.col("mined_rule").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "mined_rule",
    )


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    """A verdict for every page."""
    return judge(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
