"""Queries on chronology, windows and register metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import windows as W
from ..session import table
from ..operators.numbering import numbered_rows
from .registry import query


@query("chronology", """
SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day,
       lag(CAST(o_orderdate AS DATE)) OVER w AS before, lead(CAST(o_orderdate AS DATE)) OVER w AS after
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def chronology(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    return W.chronology(o, ["o_custkey"], [F.col("o_orderkey")], "day")


@query("chronology_refuted", """
SELECT * FROM (SELECT o_orderkey, c_name, c_mktsegment, CAST(o_orderdate AS DATE) AS day,
       lag(CAST(o_orderdate AS DATE)) OVER w AS before, lead(CAST(o_orderdate AS DATE)) OVER w AS after
FROM orders JOIN customer ON o_custkey = c_custkey WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
WHERE day < before OR day > after""")
def chronology_refuted(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    found = W.refuted(W.chronology(o, ["o_custkey"], [F.col("o_orderkey")], "day"), "day")
    return found.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "c_mktsegment", "day", "before", "after")


@query("sibling_gaps", """
SELECT * FROM (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day,
   lag(CAST(o_orderdate AS DATE)) OVER w AS before,
   CAST((year(o_orderdate) * 12 + month(o_orderdate)) - lag(year(o_orderdate) * 12 + month(o_orderdate)) OVER w AS BIGINT) AS months
   FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey))
WHERE months > 12 OR (months > 0 AND months < 2 AND day <> before)""")
def sibling_gaps(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"))
    w = Window.partitionBy("o_custkey").orderBy("day", "o_orderkey")
    number = F.year("day") * 12 + F.month("day")
    out = o.withColumn("before", F.lag("day").over(w)).withColumn("months", (number - F.lag(number).over(w)).cast("bigint"))
    return out.where("months > 12 OR (months > 0 AND months < 2 AND day <> before)")


@query("first_event", """
SELECT o_custkey, o_orderstatus, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def first_event(spark, sf):
    return W.first_per(table(spark, sf, "orders"), ["o_custkey", "o_orderstatus"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice")


@query("best_vs_second", """
WITH s AS (SELECT o_custkey, o_orderkey, CAST(5 * (o_orderstatus = 'F')::INT + 3 * (o_totalprice > 150000)::INT + 1 * (o_orderpriority LIKE '1%')::INT AS BIGINT) AS points FROM orders),
r AS (SELECT *, row_number() OVER w AS rn, lead(points) OVER w AS second FROM s WINDOW w AS (PARTITION BY o_custkey ORDER BY points DESC, o_orderkey))
SELECT o_custkey, o_orderkey, points, second, coalesce(points <= second + 2, false) AS ambiguous FROM r WHERE rn = 1""")
def best_vs_second(spark, sf):
    o = table(spark, sf, "orders")
    one = lambda c, n: F.when(c, F.lit(n)).otherwise(F.lit(0))
    points = (one(F.col("o_orderstatus") == "F", 5) + one(F.col("o_totalprice") > 150000, 3) + one(F.col("o_orderpriority").startswith("1"), 1)).cast("bigint")
    return W.best_against_second(o.select("o_custkey", "o_orderkey", points.alias("points")), ["o_custkey"], "points", [F.col("o_orderkey")])


@query("line_clusters", """
WITH m AS (SELECT p_brand, p_retailprice, CASE WHEN p_retailprice - lag(p_retailprice) OVER w <= 1.0 THEN 0 ELSE 1 END AS fresh FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice)),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY p_brand ORDER BY p_retailprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cluster FROM m)
SELECT p_brand, CAST(cluster AS BIGINT) AS cluster, count(*) AS n, min(p_retailprice) AS first, max(p_retailprice) AS last, round(avg(p_retailprice), 4) AS middle FROM c GROUP BY p_brand, cluster""")
def line_clusters(spark, sf):
    return W.line_clusters(table(spark, sf, "part").select("p_brand", "p_retailprice"), ["p_brand"], "p_retailprice", 1.0).withColumn("cluster", F.col("cluster").cast("bigint")).withColumn("middle", F.round("middle", 4))


@query("column_votes", """
WITH v AS (SELECT l_linenumber AS place, count(DISTINCT l_orderkey) AS votes FROM lineitem GROUP BY 1), n AS (SELECT count(DISTINCT l_orderkey) AS pages FROM lineitem)
SELECT CAST(place AS BIGINT) AS place, votes FROM v, n WHERE votes >= greatest(2, floor(0.4 * pages))""")
def column_votes(spark, sf):
    li = table(spark, sf, "lineitem")
    pages = li.agg(F.count_distinct("l_orderkey").alias("pages"))
    votes = li.groupBy(F.col("l_linenumber").cast("bigint").alias("place")).agg(F.count_distinct("l_orderkey").alias("votes"))
    return votes.join(F.broadcast(pages)).where(F.col("votes") >= F.greatest(F.lit(2), F.floor(F.lit(0.4) * F.col("pages")))).select("place", "votes")


@query("form_periods", """
WITH m AS (SELECT source, doc_id, lang, CASE WHEN lang IS NOT DISTINCT FROM lag(lang) OVER w AND lag(doc_id) OVER w IS NOT NULL THEN 0 ELSE 1 END AS fresh FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
p AS (SELECT *, sum(fresh) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS period FROM m)
SELECT source, CAST(period AS BIGINT) AS period, lang, min(doc_id) AS first, max(doc_id) AS last, count(*) AS n FROM p GROUP BY source, period, lang""")
def form_periods(spark, sf):
    return W.periods(table(spark, sf, "documents").select("source", "doc_id", "lang"), ["source"], "doc_id", "lang").withColumn("period", F.col("period").cast("bigint"))


_PAGE_SQL = """
WITH d AS (SELECT label, vec_id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM embeddings),
r AS (SELECT label, vec_id, sqrt(list_sum(list_transform(list_zip(embedding, before), lambda x: pow(x[1]::DOUBLE - x[2]::DOUBLE, 2))) / len(embedding)) AS distance FROM d WHERE before IS NOT NULL)"""


def _distances(spark, sf):
    w = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, sf, "embeddings").withColumn("before", F.lag("embedding").over(w)).where("before IS NOT NULL").select("label", "vec_id", W.rmse(F.col("embedding"), F.col("before")).alias("distance"))


@query("page_distance", _PAGE_SQL + " SELECT label, vec_id, round(distance, 5) AS distance FROM r")
def page_distance(spark, sf):
    return _distances(spark, sf).withColumn("distance", F.round("distance", 5))


@query("page_suspects", _PAGE_SQL + """,
m AS (SELECT label, list_sort(list(distance))[len(list(distance)) // 2 + 1] AS middle, count(*) AS n FROM r GROUP BY label)
SELECT r.label, vec_id, round(distance, 5) AS distance FROM r JOIN m ON r.label = m.label WHERE n >= 3 AND distance < least(0.85 * middle, 60)""")
def page_suspects(spark, sf):
    r = _distances(spark, sf)
    m = W.middles(r, "label", "distance").withColumnRenamed("upper", "middle")
    return r.join(m, "label").where((F.col("n") >= 3) & (F.col("distance") < F.least(F.lit(0.85) * F.col("middle"), F.lit(60.0)))).select("label", "vec_id", F.round("distance", 5).alias("distance"))


@query("asof_period", """
SELECT e.event_id, e.user_id, e.ts, s.ts AS as_of_time, s.event_id AS as_of_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') e
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'signup' GROUP BY user_id, ts) s
ON e.user_id = s.user_id AND e.ts >= s.ts""")
def asof_period(spark, sf):
    e = table(spark, sf, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'signup'").select("user_id", F.col("ts").alias("s_ts"), F.col("event_id").alias("s_id"))
    return W.as_of(left, right, "user_id", "ts", "s_ts", "s_id")


@query("num_sort", """
SELECT event_id, k, CAST(row_number() OVER (ORDER BY n, k, event_id) AS BIGINT) AS place FROM (
  SELECT event_id, k, coalesce(try_cast(nullif(regexp_extract(k, '^\\s*([+-]?[0-9]+)', 1), '') AS INTEGER), 0) AS n
  FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(user_id AS VARCHAR) || event_type END AS k FROM events WHERE event_type <> 'view'))""")
def num_sort(spark, sf):
    k = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.concat(F.col("user_id").cast("string"), F.col("event_type")))
    e = table(spark, sf, "events").where("event_type <> 'view'").select("event_id", k.alias("k"))
    return numbered_rows(e, [W.leading_int(F.col("k")), F.col("k"), F.col("event_id")], "place")


@query("cells", """
WITH b AS (SELECT p_brand, p_size, lead(p_size) OVER (PARTITION BY p_brand ORDER BY p_size) AS until FROM (SELECT DISTINCT p_brand, p_size FROM part))
SELECT p_brand, CAST(p_size AS BIGINT) AS top, CAST(until AS BIGINT) AS bottom, CAST(c AS BIGINT) AS col FROM b, generate_series(1, 3) t(c) WHERE until IS NOT NULL""")
def cells(spark, sf):
    rows = table(spark, sf, "part").select("p_brand", "p_size").distinct()
    w = Window.partitionBy("p_brand").orderBy("p_size")
    return rows.withColumn("bottom", F.lead("p_size").over(w)).where("bottom IS NOT NULL").select(
        "p_brand", F.col("p_size").cast("bigint").alias("top"), F.col("bottom").cast("bigint"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(3).cast("bigint"))).alias("col")
    )


@query("error_catalogue", """
SELECT l_linestatus AS read, o_orderstatus AS corrected, o_orderpriority AS register, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus <> o_orderstatus AND trim(o_orderstatus) <> '' GROUP BY ALL""")
def error_catalogue(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.where((F.col("l_linestatus") != F.col("o_orderstatus")) & (F.trim("o_orderstatus") != ""))
    return j.groupBy(F.col("l_linestatus").alias("read"), F.col("o_orderstatus").alias("corrected"), F.col("o_orderpriority").alias("register")).agg(F.count("*").alias("n"))


@query("error_top", """
SELECT l_linestatus AS read, o_orderstatus AS corrected, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_linestatus <> o_orderstatus GROUP BY ALL ORDER BY n DESC, read, corrected LIMIT 12""")
def error_top(spark, sf):
    return error_catalogue(spark, sf).groupBy("read", "corrected").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "read", "corrected").limit(12)


@query("traffic_light", """
SELECT o_orderpriority AS round, count(*) FILTER (o_orderstatus = 'F') AS green, count(*) FILTER (o_orderstatus = 'O') AS yellow,
       count(*) FILTER (o_orderstatus = 'P') AS red, count(*) AS n FROM orders GROUP BY 1""")
def traffic_light(spark, sf):
    s = F.col("o_orderstatus")
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("round")).agg(
        F.count_if(s == "F").alias("green"), F.count_if(s == "O").alias("yellow"), F.count_if(s == "P").alias("red"), F.count("*").alias("n")
    )


@query("effort", """
SELECT event_type AS register, count(*) AS n, round(sum(value), 2) AS seconds, round(avg(value), 2) AS mean, count(DISTINCT user_id) AS hands FROM events GROUP BY 1""")
def effort(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("register")).agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("seconds"), F.round(F.avg("value"), 2).alias("mean"), F.count_distinct("user_id").alias("hands")
    )


@query("cost", """
WITH p(kind, unit) AS (VALUES ('click', 1.0), ('purchase', 3.0), ('view', 5.0)),
c AS (SELECT event_type AS kind, user_id % 7 AS grp, coalesce(nullif(CASE WHEN event_id % 4 = 0 THEN value ELSE 0 END, 0), user_id * unit / 1000) AS dollars
      FROM events LEFT JOIN p ON event_type = kind WHERE event_type <> 'error')
SELECT CAST(grp AS BIGINT) AS grp, kind, round(sum(dollars), 4) AS dollars, round(sum(dollars), 4) < 500 AS free FROM c GROUP BY grp, kind""")
def cost(spark, sf):
    price = F.element_at(F.create_map(*[F.lit(x) for kv in (("click", 1.0), ("purchase", 3.0), ("view", 5.0)) for x in kv]), F.col("event_type"))
    named = F.when(F.col("event_id") % 4 == 0, F.col("value")).otherwise(F.lit(0.0))
    dollars = F.coalesce(F.nullif(named, F.lit(0.0)), F.col("user_id") * price / 1000)
    out = table(spark, sf, "events").where("event_type <> 'error'").groupBy((F.col("user_id") % 7).alias("grp"), F.col("event_type").alias("kind")).agg(F.round(F.sum(dollars), 4).alias("dollars"))
    return out.withColumn("free", F.col("dollars") < 500)


@query("scribes", "SELECT o_orderpriority AS hand, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY 1")
def scribes(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("hand")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@query("access_days", "SELECT CAST(ts AS DATE) AS day, count(*) AS hits, count(DISTINCT user_id) AS visitors FROM events GROUP BY 1")
def access_days(spark, sf):
    return table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("hits"), F.count_distinct("user_id").alias("visitors"))


@query("access_top", """
SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, count(*) AS hits FROM pages GROUP BY 1 ORDER BY hits DESC, host LIMIT 10""")
def access_top(spark, sf):
    return table(spark, sf, "pages").groupBy(F.regexp_extract("url", r"://([^/?#]*)", 1).alias("host")).agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "host").limit(10)


@query("upper_median", """
SELECT p_brand, list_sort(list(p_retailprice))[count(*) // 2 + 1] AS upper, round(median(p_retailprice), 4) AS middle, min(p_retailprice) AS least, max(p_retailprice) AS most,
       count(*) FILTER (p_size < 15) AS small FROM part GROUP BY 1""")
def upper_median(spark, sf):
    parts = table(spark, sf, "part")
    plain = parts.groupBy("p_brand").agg(F.min("p_retailprice").alias("least"), F.max("p_retailprice").alias("most"), F.count_if(F.col("p_size") < 15).alias("small"))
    middle = F.round((F.col("lower") + F.col("upper")) / 2, 4).alias("middle")
    return plain.join(W.middles(parts, "p_brand", "p_retailprice"), "p_brand").select("p_brand", "upper", middle, "least", "most", "small")


@query("number_gaps", """
SELECT l_orderkey, first, last, list_filter(range(first, last + 1), lambda x: NOT list_contains(have, x)) AS missing FROM
 (SELECT l_orderkey, min(l_linenumber)::BIGINT AS first, max(l_linenumber)::BIGINT AS last, list(DISTINCT l_linenumber::BIGINT) AS have FROM lineitem GROUP BY 1) WHERE len(have) < last - first + 1""")
def number_gaps(spark, sf):
    n = F.col("l_linenumber").cast("bigint")
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min(n).alias("first"), F.max(n).alias("last"), F.collect_set(n).alias("have"))
    return g.where(F.size("have") < F.col("last") - F.col("first") + 1).select("l_orderkey", "first", "last", F.array_except(F.sequence("first", "last"), "have").alias("missing"))


@query("instance_overview", """
SELECT n_name, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers FROM nation
LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c ON n_nationkey = c_nationkey
LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON n_nationkey = s_nationkey""")
def instance_overview(spark, sf):
    c = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("c"))
    s = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("s"))
    n = table(spark, sf, "nation")
    return n.join(c, n.n_nationkey == c.c_nationkey, "left").join(s, n.n_nationkey == s.s_nationkey, "left").select("n_name", F.coalesce("c", F.lit(0)).alias("customers"), F.coalesce("s", F.lit(0)).alias("suppliers"))


@query("reread_price", """
SELECT event_type AS register, count(*) AS pages, round(avg(value), 4) AS mean, round(avg(value) * 20, 4) AS batch FROM events WHERE value > 0 GROUP BY 1""")
def reread_price(spark, sf):
    return table(spark, sf, "events").where("value > 0").groupBy(F.col("event_type").alias("register")).agg(F.count("*").alias("pages"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.avg("value") * 20, 4).alias("batch"))


@query("table_counts", """
SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem
UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'events', count(*) FROM events""")
def table_counts(spark, sf):
    out = None
    for name in ("customer", "orders", "lineitem", "part", "supplier", "events"):
        one = table(spark, sf, name).agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("outcome_shares", """
SELECT o_orderstatus AS outcome, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS share FROM orders GROUP BY 1""")
def outcome_shares(spark, sf):
    g = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("outcome")).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


@query("detector_hits", """
SELECT CAST(tol AS BIGINT) AS tol, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM supplier s WHERE abs(s.s_acctbal - c.c_acctbal) <= tol AND s.s_nationkey = c.c_nationkey)) AS hits
FROM customer c, (VALUES (25), (40), (60)) t(tol) GROUP BY tol""")
def detector_hits(spark, sf):
    from ..operators.matching import date_band

    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").alias("nation"))
    s = table(spark, sf, "supplier").select("s_acctbal", F.col("s_nationkey").alias("nation"))
    near = date_band(c, s, "c_acctbal", "s_acctbal", 60, ["nation"]).groupBy("c_custkey").agg(F.min(F.abs(F.col("c_acctbal") - F.col("s_acctbal"))).alias("gap"))
    tolerances = F.explode(F.array(*[F.lit(t).cast("bigint") for t in (25, 40, 60)]))
    return c.join(near, "c_custkey", "left").select(tolerances.alias("tol"), "gap").groupBy("tol").agg(F.count("*").alias("n"), F.count_if(F.col("gap") <= F.col("tol")).alias("hits"))


@query("vocab_upsert", """
WITH h AS (SELECT doc_id % 2 AS half, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents),
a AS (SELECT half, word, count(*) AS n FROM h GROUP BY ALL)
SELECT word, CAST(sum(n) AS BIGINT) AS n, count(*) AS files FROM a GROUP BY word""")
def vocab_upsert(spark, sf):
    words = table(spark, sf, "documents").select((F.col("doc_id") % 2).alias("half"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return words.groupBy("half", "word").count().groupBy("word").agg(F.sum("count").alias("n"), F.count("*").alias("files"))


def header_pages(spark, sf):
    """A page for every document of a source: its header has the language, then what its length tells; short texts cannot be read."""
    long = F.when(F.col("n_chars") > 1500, F.lit("Long"))
    longer = F.when(F.col("n_chars") > 3000, F.lit("Longer."))
    header = F.when(F.col("n_chars") >= 100, F.array_compact(F.array("lang", long, longer)))
    return table(spark, sf, "documents").select(F.col("source").alias("register"), F.col("doc_id").alias("page"), header.alias("columns"))


@query("header_periods")
def header_periods(spark, sf):
    """Each period hangs on the richest header so far, so it is tested against a fold."""
    from ..operators.periods import form_periods

    return form_periods(header_pages(spark, sf), "register", "page", "columns")
