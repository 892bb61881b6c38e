"""Queries on matching, merging, classes, audit and search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import audit, graph
from ..operators import matching as M
from ..session import table
from .registry import query


@query("date_band", """
SELECT a.o_orderkey AS left_key, b.o_orderkey AS right_key FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
 AND abs(CAST(a.o_orderdate AS DATE) - CAST(b.o_orderdate AS DATE)) <= 5""")
def date_band(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.unix_date(F.to_date("o_orderdate")).alias("day"))
    left = o.select("o_custkey", F.col("o_orderkey").alias("left_key"), F.col("day").alias("left_day"))
    right = o.select("o_custkey", F.col("o_orderkey").alias("right_key"), F.col("day").alias("right_day"))
    return M.date_band(left, right, "left_day", "right_day", 5, ["o_custkey"]).where("left_key < right_key").select("left_key", "right_key")


def _couples(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_suppkey").agg(F.min("year").alias("first"), F.max("year").alias("last"), F.count("*").alias("n"))


_COUPLES = "k AS (SELECT o_custkey, l_suppkey, min(year(o_orderdate)) AS first, max(year(o_orderdate)) AS last, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"


@query("couple_anchor", f"WITH {_COUPLES} SELECT o_custkey, l_suppkey, CAST(first AS INT) AS first, CAST(last AS INT) AS last, n FROM k JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey = s_nationkey")
def couple_anchor(spark, sf):
    c, s = table(spark, sf, "customer").select("c_custkey", "c_nationkey"), table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    k = _couples(spark, sf).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return k.where("c_nationkey = s_nationkey").select("o_custkey", "l_suppkey", "first", "last", "n")


@query("parents_verdict", f"""
WITH {_COUPLES}, c AS (SELECT o_custkey, count(*) AS n, min(l_suppkey) AS candidate, bool_or(k.n > 1) AS dated FROM k JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey = s_nationkey GROUP BY 1)
SELECT c_custkey, coalesce(n, 0) AS n, CASE WHEN n = 1 THEN candidate END AS candidate,
  CASE WHEN n = 1 THEN CASE WHEN dated THEN 'green' ELSE 'yellow' END WHEN n > 1 THEN 'yellow' WHEN c_acctbal > 0 THEN 'yellow' ELSE 'red' END AS verdict,
  CASE WHEN n = 1 THEN CASE WHEN dated THEN 'one dated candidate' ELSE 'one undated candidate' END WHEN n > 1 THEN 'several candidates' WHEN c_acctbal > 0 THEN 'names known, no couple' ELSE 'names unknown' END AS reason
FROM customer LEFT JOIN c ON c_custkey = o_custkey""")
def parents_verdict(spark, sf):
    found = couple_anchor(spark, sf).select(F.col("o_custkey").alias("c_custkey"), F.col("l_suppkey").alias("candidate"), (F.col("n") > 1).alias("dated"))
    entries = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return M.one_candidate_verdict(entries, found, ["c_custkey"], F.col("c_acctbal") > 0).select("c_custkey", "n", "candidate", "verdict", "reason")


_CASCADE = """
WITH e AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS pr, o_orderstatus AS st, o_totalprice AS tp FROM orders),
p AS (SELECT a.o_orderkey AS entry, b.o_orderkey AS candidate, abs(a.day - b.day) <= 5 AS exact, year(a.day) = year(b.day) AS same_year, a.pr = b.pr AS given, a.st = b.st AS sur, abs(a.tp - b.tp) < 20000 AS parents
      FROM e a JOIN e b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey AND year(a.day) = year(b.day)),
s AS (SELECT *, CAST(CASE WHEN exact THEN 5 ELSE 2 END + 3 * given::INT + 1 * sur::INT + 4 * parents::INT AS INT) AS points, 1 + given::INT + sur::INT + parents::INT AS nf FROM p),
v AS (SELECT * FROM s WHERE nf >= 2 AND points >= 6),
r AS (SELECT *, row_number() OVER w AS rn, lead(points) OVER w AS second FROM v WINDOW w AS (PARTITION BY entry ORDER BY points DESC, candidate)),
b AS (SELECT * FROM r WHERE rn = 1),
o AS (SELECT e.o_orderkey AS entry, CASE WHEN b.entry IS NULL THEN 'none' WHEN coalesce(b.points <= b.second + 2, false) THEN 'ambiguous' ELSE 'hit' END AS outcome, b.candidate, b.points, b.exact FROM e LEFT JOIN b ON e.o_orderkey = b.entry)
"""


def _cascade(spark, sf):
    e = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("pr"), F.col("o_orderstatus").alias("st"), F.col("o_totalprice").alias("tp")).withColumn("year", F.year("day"))
    a, b = e.alias("a"), e.alias("b")
    p = a.join(b, (F.col("a.o_custkey") == F.col("b.o_custkey")) & (F.col("a.year") == F.col("b.year")) & (F.col("a.o_orderkey") != F.col("b.o_orderkey")))
    exact = F.abs(F.date_diff("a.day", "b.day")) <= 5
    flags = {"exact_date": exact, "same_year": ~exact, "given_name": F.col("a.pr") == F.col("b.pr"), "surname": F.col("a.st") == F.col("b.st"), "parents": F.abs(F.col("a.tp") - F.col("b.tp")) < 20000}
    scored = p.select(F.col("a.o_orderkey").alias("entry"), F.col("b.o_orderkey").alias("candidate"), M.features(flags).alias("found"), M.score(flags).alias("points"), exact.alias("exact"))
    from ..operators.windows import best_against_second

    best = best_against_second(scored.where(M.viable(F.col("found"), F.col("points"))), ["entry"], "points", [F.col("candidate")])
    out = e.select(F.col("o_orderkey").alias("entry")).join(best, "entry", "left")
    return out.withColumn("outcome", F.when(F.col("candidate").isNull(), "none").when(F.col("ambiguous"), "ambiguous").otherwise("hit"))


@query("register_anchor", _CASCADE + "SELECT entry, outcome, CASE WHEN outcome = 'hit' THEN candidate END AS candidate, CASE WHEN outcome = 'hit' AND exact THEN 'green' WHEN outcome = 'none' THEN 'grey' ELSE 'yellow' END AS verdict, points FROM o")
def register_anchor(spark, sf):
    c = _cascade(spark, sf)
    hit = F.col("outcome") == "hit"
    return c.select("entry", "outcome", F.when(hit, F.col("candidate")).alias("candidate"), F.when(hit & F.col("exact"), "green").when(F.col("outcome") == "none", "grey").otherwise("yellow").alias("verdict"), "points")


@query("death_cascade", _CASCADE + "SELECT outcome, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM o), 2) AS share FROM o GROUP BY 1")
def death_cascade(spark, sf):
    g = _cascade(spark, sf).groupBy("outcome").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


@query("truth_hits", """
SELECT d.source, count(*) FILTER (l.doc_id IS NULL) AS missing, count(*) FILTER (l.quality = 1) AS hits, count(*) FILTER (l.quality = 0) AS wrong FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def truth_hits(spark, sf):
    j = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    q = F.col("quality")
    return j.groupBy("source").agg(F.count_if(q.isNull()).alias("missing"), F.count_if(q == 1).alias("hits"), F.count_if(q == 0).alias("wrong"))


@query("second_reading", """
SELECT coalesce(d.doc_id, l.doc_id) AS id, d.lang AS first, CAST(l.quality AS VARCHAR) AS second, d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL AND (l.quality = 1) = (d.lang = 'en') AS equal
FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""")
def second_reading(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("a"), "lang")
    l = table(spark, sf, "labels").select(F.col("doc_id").alias("b"), "quality")
    j = d.join(l, F.col("a") == F.col("b"), "full_outer")
    equal = F.col("a").isNotNull() & F.col("b").isNotNull() & ((F.col("quality") == 1) == (F.col("lang") == "en"))
    return j.select(F.coalesce("a", "b").alias("id"), F.col("lang").alias("first"), F.col("quality").cast("string").alias("second"), F.coalesce(equal, F.lit(False)).alias("equal"))


#: Target: the first line of every order; source: every order. An order without lines is new, a finished one is guarded.
@query("merge_guarded", """
WITH t AS (SELECT l_orderkey AS o_orderkey, sum(l_extendedprice) AS price, max(l_linestatus) AS status FROM lineitem GROUP BY 1),
s AS (SELECT o_orderkey, o_totalprice AS price, o_orderstatus AS status FROM orders)
SELECT coalesce(t.o_orderkey, s.o_orderkey) AS o_orderkey, round(CASE WHEN w THEN s.price ELSE t.price END, 2) AS price, CASE WHEN w THEN s.status ELSE t.status END AS status, w AS written
FROM (SELECT t.o_orderkey AS tk, s.o_orderkey AS sk, s.o_orderkey IS NOT NULL AND (t.o_orderkey IS NULL OR t.status <> 'F') AS w FROM t FULL JOIN s ON t.o_orderkey = s.o_orderkey) k
LEFT JOIN t ON t.o_orderkey = k.tk LEFT JOIN s ON s.o_orderkey = k.sk""")
def merge_guarded(spark, sf):
    t = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("price"), F.max("l_linestatus").alias("status"))
    s = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    return M.guarded_merge(t, s, "o_orderkey", ["price", "status"], F.col("t.status") != "F").withColumn("price", F.round("price", 2))


@query("merge_ignore", """
SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderstatus <> 'F') WHERE rn = 1 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')""")
def merge_ignore(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    return M.insert_or_ignore(o.where("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"), o.where("o_orderstatus <> 'F'").select("o_custkey", "o_orderkey"), ["o_custkey"], [F.col("o_orderkey")])


@query("find_or_create", """
WITH known AS (SELECT s_suppkey AS id, s_nationkey AS nation, 'BUILDING' AS segment FROM supplier),
have AS (SELECT nation, segment, min(id) AS id FROM known GROUP BY ALL),
wanted AS (SELECT o_orderkey, c_nationkey AS nation, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey),
fresh AS (SELECT nation, segment, row_number() OVER (ORDER BY min(o_orderkey)) + (SELECT max(id) FROM known) AS id FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.nation = w.nation AND h.segment = w.segment) GROUP BY ALL)
SELECT w.*, coalesce(h.id, f.id) AS id, h.id IS NULL AS created FROM wanted w LEFT JOIN have h USING (nation, segment) LEFT JOIN fresh f USING (nation, segment)""")
def find_or_create(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    known = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.lit("BUILDING").alias("segment"))
    wanted = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "nation", "segment")
    return M.find_or_create(wanted, known, ["nation", "segment"], "id", [F.col("o_orderkey")])


@query("open_pages", """
SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND d.doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars < 200)""")
def open_pages(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return d.join(table(spark, sf, "labels"), "doc_id", "left_anti").join(d.where("n_chars < 200"), "doc_id", "left_anti").select("doc_id")


@query("dead_pointers", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def dead_pointers(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(table(spark, sf, "part").where("p_size > 5"), F.col("l_partkey") == F.col("p_partkey"), "left_anti")


@query("closure", """
WITH c AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT * FROM c)),
p AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_orderkey IN (SELECT * FROM o))
SELECT 'customer' AS kind, c_custkey AS k FROM c UNION ALL SELECT 'order', o_orderkey FROM o UNION ALL SELECT 'part', k FROM p""")
def closure(spark, sf):
    c = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING' AND c_acctbal > 5000").select("c_custkey")
    o = table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")
    p = table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_partkey").distinct()
    kind = lambda df, name, col: df.select(F.lit(name).alias("kind"), F.col(col).alias("k"))
    return kind(c, "customer", "c_custkey").unionByName(kind(o, "order", "o_orderkey")).unionByName(kind(p, "part", "l_partkey"))


@query("densify", """
SELECT s.seg AS segment, t.st AS status, coalesce(n, 0) AS n FROM (SELECT DISTINCT c_mktsegment AS seg FROM customer) s CROSS JOIN (SELECT DISTINCT o_orderstatus AS st FROM orders) t
LEFT JOIN (SELECT c_mktsegment, o_orderstatus, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 400000 GROUP BY ALL) g ON g.c_mktsegment = s.seg AND g.o_orderstatus = t.st""")
def densify(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    # Two short lists of domain values: every combination is the point of the operator.
    grid = c.select(F.col("c_mktsegment").alias("segment")).distinct().crossJoin(F.broadcast(o.select(F.col("o_orderstatus").alias("status")).distinct()))
    n = o.where("o_totalprice > 400000").join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("segment"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return grid.join(n, ["segment", "status"], "left").na.fill({"n": 0})


#: Overrides: what the lines of a part say of it; a part without lines keeps its own values.
@query("catalogue_overlay", """
SELECT p_partkey, coalesce(o.size, p_size) AS size, coalesce(o.brand, p_brand) AS brand, o.p IS NOT NULL AS overridden
FROM part LEFT JOIN (SELECT l_partkey AS p, CASE WHEN max(l_quantity) >= 50 THEN max(l_linenumber) END AS size, CASE WHEN max(l_tax) < 0.08 THEN 'own' END AS brand FROM lineitem GROUP BY 1) o ON p = p_partkey""")
def catalogue_overlay(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_size", "p_brand")
    over = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p")).agg(F.when(F.max("l_quantity") >= 50, F.max("l_linenumber")).alias("size"), F.when(F.max("l_tax") < 0.08, "own").alias("brand"))
    return part.join(over, F.col("p") == F.col("p_partkey"), "left").select("p_partkey", F.coalesce("size", "p_size").alias("size"), F.coalesce("brand", "p_brand").alias("brand"), F.col("p").isNotNull().alias("overridden"))


@query("name_classes", """
WITH RECURSIVE e AS (SELECT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem GROUP BY ALL HAVING count(*) >= 4),
n AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT DISTINCT a AS start, a AS goal FROM n UNION SELECT r.start, n.b FROM r JOIN n ON r.goal = n.a)
SELECT start AS node, min(r.goal) AS class FROM r GROUP BY start""")
def name_classes(spark, sf):
    return graph.classes(_name_edges(spark, sf))


def _name_edges(spark, sf):
    pairs = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").count().where("count >= 4")
    return pairs.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("a"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("b"))


@query("bridges", """
WITH RECURSIVE e AS (SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(*) >= 4),
n AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
c AS (SELECT DISTINCT a AS start, a AS goal FROM n UNION SELECT c.start, n.b FROM c JOIN n ON c.goal = n.a),
k AS (SELECT start AS node, min(goal) AS class FROM c GROUP BY 1),
r AS (SELECT a AS ea, b AS eb, a AS at FROM e UNION SELECT r.ea, r.eb, n.b FROM r JOIN n ON r.at = n.a WHERE NOT (n.a = r.ea AND n.b = r.eb) AND NOT (n.a = r.eb AND n.b = r.ea))
SELECT k.class, e.a, e.b FROM e JOIN k ON k.node = e.a WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.ea = e.a AND r.eb = e.b AND r.at = e.b)""")
def bridges(spark, sf):
    edges = _name_edges(spark, sf)
    return graph.bridges(edges, graph.classes(edges))


@query("audit", audit.FINDINGS_SQL)
def audit_findings(spark, sf):
    return audit.findings(*[table(spark, sf, n) for n in ("customer", "orders", "lineitem")])


@query("audit_summary", f"SELECT severity, rule, count(*) AS n FROM ({audit.FINDINGS_SQL}) GROUP BY ROLLUP (severity, rule)")
def audit_summary(spark, sf):
    return audit_findings(spark, sf).rollup("severity", "rule").agg(F.count("*").alias("n"))


@query("autocomplete", """
SELECT p_name AS name, count(*) AS n FROM part WHERE contains(lower(p_name), 'b') GROUP BY 1 ORDER BY CASE WHEN lower(p_name) LIKE 'b%' THEN 0 ELSE 1 END, n DESC, name LIMIT 8""")
def autocomplete(spark, sf):
    low = F.lower("p_name")
    hits = table(spark, sf, "part").where(low.contains("b")).groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n"))
    return hits.orderBy(F.when(F.lower("name").startswith("b"), 0).otherwise(1), F.desc("n"), "name").limit(8)


@query("person_search", """
SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '12') ORDER BY CASE WHEN c_name LIKE '%12' THEN 0 ELSE 1 END + CASE WHEN c_mktsegment <> 'BUILDING' THEN 2 ELSE 0 END, c_name, c_custkey LIMIT 8""")
def person_search(spark, sf):
    c = table(spark, sf, "customer").where(F.lower("c_name").contains("12"))
    place = F.when(F.col("c_name").endswith("12"), 0).otherwise(1) + F.when(F.col("c_mktsegment") != "BUILDING", 2).otherwise(0)
    return c.orderBy(place, "c_name", "c_custkey").limit(8).select("c_custkey", "c_name")


@query("person_card", """
SELECT c_custkey, c_name, coalesce(string_agg(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), ' ' ORDER BY rn), '') AS dates FROM customer LEFT JOIN
(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) o ON o_custkey = c_custkey AND rn <= 2 GROUP BY ALL""")
def person_card(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf, "orders").withColumn("rn", F.row_number().over(w)).where("rn <= 2").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("rn", F.to_date("o_orderdate").cast("string").alias("day")))).alias("days"))
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", F.coalesce(F.array_join(F.transform("days", lambda x: x["day"]), " "), F.lit("")).alias("dates"))


@query("attachment", """
WITH c AS (SELECT l_orderkey, min(l_suppkey) AS a, max(l_suppkey) AS b FROM lineitem GROUP BY 1),
f AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem),
j AS (SELECT c.l_orderkey, min(fa.p) AS common FROM c JOIN f fa ON fa.s = c.a JOIN f fb ON fb.s = c.b AND fb.p = fa.p WHERE a <> b GROUP BY 1)
SELECT c.l_orderkey, common, CASE WHEN common IS NOT NULL THEN 'attach' WHEN a <> b THEN 'check' ELSE 'new' END AS proposal FROM c LEFT JOIN j ON c.l_orderkey = j.l_orderkey""")
def attachment(spark, sf):
    li = table(spark, sf, "lineitem")
    c = graph.written(li.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("a"), F.max("l_suppkey").alias("b")))  # read twice
    # Common parts are found once for each pair of suppliers that occurs, not for each order.
    pairs = c.where("a <> b").select("a", "b").distinct()
    j = M.least_common(pairs, li.select(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("member"))).withColumnRenamed("least", "common")
    out = c.join(j, ["a", "b"], "left")
    return out.select("l_orderkey", "common", F.when(F.col("common").isNotNull(), "attach").when(F.col("a") != F.col("b"), "check").otherwise("new").alias("proposal"))


@query("chronology_blockers", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) GROUP BY 1")
def chronology_blockers(spark, sf):
    c = table(spark, sf, "customer").where("c_nationkey = 3").select("c_custkey")
    return table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").groupBy("o_custkey").agg(F.count("*").alias("n"))
