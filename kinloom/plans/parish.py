"""Couples of entries in a stock of persons and families, both derived from all customers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anchors
from ..operators import handover as H
from ..session import table
from .registry import query

# A person for every customer, a family for every customer and the next one, an entry for every order.
_STOCK = """
p AS (SELECT c_custkey AS person, 'given' || (c_custkey % 97) AS g1, 'second' || (c_custkey % 89) AS g2, 'family' || (c_custkey % 499) AS surn,
             1700 + c_custkey % 90 AS birth, CASE WHEN c_mktsegment = 'BUILDING' THEN 1745 + c_custkey % 80 END AS death FROM customer),
f AS (SELECT c_custkey AS family, c_custkey AS husband, c_custkey + 1 AS wife, CASE WHEN c_acctbal > 0 THEN 1720 + c_custkey % 80 END AS marriage, c_nationkey AS source FROM customer),
e AS (SELECT o_orderkey AS entry, year(o_orderdate) - 260 + o_custkey % 60 AS year,
             CASE o_orderpriority WHEN '1-URGENT' THEN NULL WHEN '2-HIGH' THEN 'Family' || (o_custkey % 499) WHEN '3-MEDIUM' THEN 'Given' || (o_custkey % 97) || ' Unread'
               ELSE 'Given' || (o_custkey % 97) || ' Second' || (o_custkey % 89) || ' Family' || (o_custkey % 499) END AS father,
             CASE o_orderstatus WHEN 'F' THEN 'Second' || ((o_custkey + 1) % 89) || ', Given' || ((o_custkey + 1) % 97) WHEN 'O' THEN 'Anna Family' || ((o_custkey + 1) % 499)
               ELSE CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE 'Nobody' END END AS mother FROM orders)
"""


def _stock(spark, sf):
    k = F.col("c_custkey")
    c = table(spark, sf, "customer")
    text = lambda word, n: F.concat(F.lit(word), n.cast("string"))
    persons = c.select(
        k.alias("person"), F.concat_ws(" ", text("Given", k % 97), text("Second", k % 89)).alias("givn"), text("Family", k % 499).alias("surn"), F.lit(None).cast("string").alias("sex"),
        (1700 + k % 90).alias("birth_year"), F.when(F.col("c_mktsegment") == "BUILDING", 1745 + k % 80).alias("death_year"), F.col("c_nationkey").alias("source"),
    )
    families = c.select(k.alias("family"), k.alias("husband"), (k + 1).alias("wife"), F.when(F.col("c_acctbal") > 0, 1720 + k % 80).alias("marriage_year"), F.col("c_nationkey").alias("source"))
    o, pr, st = F.col("o_custkey"), F.col("o_orderpriority"), F.col("o_orderstatus")
    w = o + 1
    father = (
        F.when(pr == "1-URGENT", F.lit(None)).when(pr == "2-HIGH", text("Family", o % 499)).when(pr == "3-MEDIUM", F.concat(text("Given", o % 97), F.lit(" Unread")))
        .otherwise(F.concat_ws(" ", text("Given", o % 97), text("Second", o % 89), text("Family", o % 499)))
    )
    mother = F.when(st == "F", F.concat(text("Second", w % 89), F.lit(", "), text("Given", w % 97))).when(st == "O", F.concat(F.lit("Anna "), text("Family", w % 499))).when(pr != "1-URGENT", F.lit("Nobody"))
    entries = table(spark, sf, "orders").select(F.col("o_orderkey").alias("entry"), father.alias("father"), mother.alias("mother"), (F.year("o_orderdate") - 260 + o % 60).alias("year"))
    proofs = table(spark, sf, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("source"))
    return entries, persons, families, proofs


_ANCHOR = f"""
WITH {_STOCK},
ft AS (SELECT entry, unnest(list_distinct(list_filter(string_split(lower(replace(father, ',', ' ')), ' '), lambda t: length(t) > 2))) AS t FROM e WHERE father IS NOT NULL),
mt AS (SELECT entry, unnest(list_distinct(list_filter(string_split(lower(replace(mother, ',', ' ')), ' '), lambda t: length(t) > 2))) AS t FROM e WHERE mother IS NOT NULL),
pg AS (SELECT person, g1 AS t FROM p UNION ALL SELECT person, g2 FROM p),
fit AS (
  SELECT side, entry, person, bool_or(sur) AS sur FROM (
    SELECT 'f' AS side, entry, person, true AS sur FROM ft JOIN p ON t = surn
    UNION ALL SELECT 'f', entry, person, false FROM ft JOIN pg ON ft.t = pg.t GROUP BY entry, person HAVING count(*) >= 2
    UNION ALL SELECT 'm', entry, person, true FROM mt JOIN p ON t = surn
    UNION ALL SELECT 'm', entry, person, false FROM mt JOIN pg ON mt.t = pg.t GROUP BY entry, person HAVING count(*) >= 2) GROUP BY ALL),
c AS (
  SELECT a.entry, f.family, f.husband, f.wife, a.sur AND b.sur AS by_surnames, coalesce(f.marriage, h.birth, h.death, w.birth, w.death) IS NOT NULL AS dated, n_nationkey IS NOT NULL AS confirms
  FROM f JOIN fit a ON a.side = 'f' AND a.person = f.husband JOIN fit b ON b.side = 'm' AND b.person = f.wife AND b.entry = a.entry
  JOIN p h ON h.person = f.husband JOIN p w ON w.person = f.wife JOIN e ON e.entry = a.entry LEFT JOIN nation ON n_nationkey = f.source AND n_regionkey <> 2
  WHERE coalesce(f.marriage <= e.year, true) AND coalesce(e.year - h.birth BETWEEN 16 AND 70, true) AND coalesce(e.year - w.birth BETWEEN 14 AND 50, true)
    AND coalesce(h.death >= e.year - 1, true) AND coalesce(w.death >= e.year, true)),
g AS (SELECT entry, count(*) AS n, min(family) AS family, min(husband) AS husband, min(wife) AS wife, bool_and(by_surnames) AS by_surnames, bool_and(dated) AS dated, bool_and(confirms) AS confirms FROM c GROUP BY 1),
k AS (SELECT e.entry, EXISTS (SELECT 1 FROM ft WHERE ft.entry = e.entry AND t IN (SELECT surn FROM p)) AS f, EXISTS (SELECT 1 FROM mt WHERE mt.entry = e.entry AND t IN (SELECT surn FROM p)) AS m FROM e),
r AS (SELECT e.entry, father IS NULL AND mother IS NULL AS missing, coalesce(n, 0) AS n, family, husband, wife, coalesce(by_surnames, false) AS by_surnames, coalesce(dated, false) AS dated, coalesce(confirms, false) AS confirms, k.f, k.m
      FROM e JOIN k ON k.entry = e.entry LEFT JOIN g ON g.entry = e.entry)
SELECT entry, n, CASE WHEN n = 1 THEN family END AS family, CASE WHEN n = 1 THEN husband END AS husband, CASE WHEN n = 1 THEN wife END AS wife,
  CASE WHEN missing THEN 'grey' WHEN n = 1 THEN CASE WHEN dated AND confirms THEN 'green' ELSE 'yellow' END WHEN n > 1 THEN 'yellow' WHEN f AND m THEN 'red' WHEN f OR m THEN 'yellow' ELSE 'red' END AS verdict,
  CASE WHEN missing THEN 'grey' WHEN n = 1 THEN CASE WHEN dated AND confirms THEN 'green' ELSE 'yellow' END WHEN n > 1 THEN 'yellow' WHEN f AND m THEN 'red' WHEN f THEN 'yellow' ELSE 'red' END AS father_verdict,
  CASE WHEN missing THEN 'grey' WHEN n = 1 THEN CASE WHEN dated AND confirms THEN 'green' ELSE 'yellow' END WHEN n > 1 THEN 'yellow' WHEN f AND m THEN 'red' WHEN m THEN 'yellow' ELSE 'red' END AS mother_verdict,
  n = 1 AND dated AND confirms AS linked,
  CASE WHEN missing THEN 'no names' WHEN n = 1 AND NOT confirms THEN 'source does not confirm' WHEN n = 1 AND NOT dated THEN 'no date' WHEN n = 1 THEN CASE WHEN by_surnames THEN 'by surnames' ELSE 'by given names' END
       WHEN n > 1 THEN 'several couples' WHEN f AND m THEN 'both known, no couple' WHEN f THEN 'father known' WHEN m THEN 'mother known' ELSE 'unknown' END AS reason
FROM r
"""


@query("parents_anchor", _ANCHOR)
def parents_anchor(spark, sf):
    """Every order as an entry against the couples of all customers."""
    return anchors.parents_anchor(*_stock(spark, sf))


@query("parents_anchor_tally", f"SELECT verdict, reason, count(*) AS n FROM ({_ANCHOR}) GROUP BY ALL")
def parents_anchor_tally(spark, sf):
    """How often each verdict is given, and why."""
    return parents_anchor(spark, sf).groupBy("verdict", "reason").agg(F.count("*").alias("n"))


def handover_tables(spark, sf):
    """(said, persons, families): a baptism for every order, in the order of the keys; a person for every customer, a couple for every one of them with a balance.

    Urgent entries are linked with persons of the stock. Mothers of finished orders have only a given name and inherit the father's surname.
    """
    k, o = F.col("c_custkey"), F.col("o_custkey")
    text = lambda word, n: F.concat(F.lit(word), n.cast("string"))
    full = lambda n: F.concat_ws(" ", text("Given", n % 97), text("Family", n % 499))
    c = table(spark, sf, "customer")
    persons = c.select(k.alias("person"), full(k).alias("name"))
    families = c.where("c_acctbal > 0").join(c.select((k - 1).alias("_n")), k == F.col("_n"), "left_semi").select(k.alias("family"), k.alias("husband"), (k + 1).alias("wife"), (F.col("c_mktsegment") == "BUILDING").alias("own"))
    known = table(spark, sf, "orders").join(c.select(k), k == o + 1, "left").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", k.isNotNull().alias("both"))
    linked = (F.col("o_orderpriority") == "1-URGENT") & F.col("both")
    status = F.col("o_orderstatus")
    mother = F.when(status == "F", F.lit("Anna")).when(status == "O", F.concat(F.lit("Anna "), text("Family", o % 499))).otherwise(full(o + 1))
    none = F.lit(None).cast("string")
    role = lambda name, value, sex, person: F.struct(F.lit(name).alias("role"), value.alias("value"), none.alias("given"), sex.alias("sex"), person.cast("bigint").alias("person"))
    roles = F.array(role("father", full(o), none, F.when(linked, o)), role("mother", mother, none, F.when(linked, o + 1)), role("child", text("Child", F.col("o_orderkey") % 31), F.lit("Knabe"), F.lit(None)))
    said = known.select(F.col("o_orderkey").alias("entry"), F.col("o_orderkey").alias("ord"), F.explode(roles).alias("r")).select("entry", "ord", "r.*")
    return said, persons, families


@query("handover")
def handover(spark, sf):
    """The couple of each entry and how it came; each hangs on those before it, so it is tested against a loop."""
    couples = H.handover(*handover_tables(spark, sf)[:1], H.BAPTISM, *handover_tables(spark, sf)[1:])[1]
    return couples.select("entry", "family", "state", "husband", "wife")
