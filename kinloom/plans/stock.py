"""The audit of a stock of persons, couples, children and events that is derived from all customers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import MONTHS
from ..operators import audit as A
from ..session import table
from .registry import query

# A person for every customer; a couple for every one with a balance and one for every builder with few other persons; events for every order.
_STOCK = """
p AS (SELECT c_custkey AS person, 'Family' || ((c_custkey // 3) % 499) AS surn, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '' WHEN 'BUILDING' THEN 'M' WHEN 'MACHINERY' THEN 'F' END AS sex FROM customer),
f AS (SELECT c_custkey AS family, c_custkey AS husband, c_custkey + 1 AS wife FROM customer WHERE c_acctbal > 0
      UNION ALL SELECT -c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 20 + 1 END, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey END FROM customer WHERE c_mktsegment = 'BUILDING'),
k AS (SELECT DISTINCT family, child FROM (SELECT c_custkey % 40 + 1 AS family, c_custkey AS child FROM customer WHERE c_mktsegment <> 'MACHINERY' UNION ALL SELECT c_custkey - 7, c_custkey FROM customer WHERE c_mktsegment IN ('FURNITURE', 'MACHINERY')) WHERE family IN (SELECT family FROM f)),
e AS (SELECT o_orderkey AS id, o_custkey AS person, CASE o_orderpriority WHEN '1-URGENT' THEN 'BIRT' WHEN '2-HIGH' THEN 'CHR' WHEN '3-MEDIUM' THEN 'DEAT' WHEN '5-LOW' THEN 'BURI' ELSE 'OCCU' END AS kind,
        CASE WHEN o_orderkey % 11 <> 0 THEN 1700 + o_custkey * 37 % 130 + CASE WHEN o_orderpriority IN ('3-MEDIUM', '5-LOW') THEN o_orderkey % 110 - 5 ELSE o_orderkey % 3 END END AS y,
        CASE WHEN o_orderstatus <> 'O' THEN month(o_orderdate) END AS m, CASE WHEN o_orderstatus = 'F' THEN day(o_orderdate) END AS d FROM orders),
w AS (SELECT family, 1715 + abs(family) * 53 % 90 AS y, CASE WHEN family % 3 = 0 THEN abs(family) % 12 + 1 END AS m, CASE WHEN family % 6 = 0 THEN abs(family) % 28 + 1 END AS d FROM f WHERE family % 5 <> 0)
"""


def _later(a: str, b: str) -> str:
    """SQL: whether date ``b`` lies before date ``a`` where both are known, part by part."""
    a, b = ([f"{x}.{part}" for part in "ymd"] for x in (a, b))
    return f"({b[0]} < {a[0]} OR ({b[0]} = {a[0]} AND ({b[1]} < {a[1]} OR ({b[1]} = {a[1]} AND {b[2]} < {a[2]}))))"


def _age(a: str, b: str) -> str:
    """SQL: completed years from date ``a`` to date ``b``."""
    return f"({b}.y - {a}.y - coalesce({b}.m < {a}.m OR ({b}.m = {a}.m AND coalesce({b}.d, 1) < coalesce({a}.d, 1)), false)::INT)"


_RULES = {
    "birth_after_death": ("error", "q", _later("birth", "death")), "christening_before_birth": ("error", "q", _later("birth", "chr")), "burial_before_death": ("error", "q", _later("death", "buri")),
    "christening_after_burial": ("error", "q", _later("chr", "buri")), "great_age": ("warning", "q", f"{_age('born', 'death')} > 90"), "sex_unknown": ("warning", "q", "coalesce(sex, '') = ''"),
    "unconnected": ("warning", "q", "n_parents = 0 AND n_marriages = 0"), "several_parents": ("warning", "q", "n_parents > 1"), "many_marriages": ("warning", "q", "n_marriages > 4"),
    "marriage_before_birth": ("error", "s", _later("born", "marr")), "marriage_after_death": ("error", "s", _later("marr", "death")),
    "married_young": ("warning", "s", f"{_age('born', 'marr')} < 17"), "married_old": ("warning", "s", f"{_age('born', 'marr')} > 50"),
    "spouse_age_gap": ("warning", "c", "abs(hb.y - wb.y) > 30"), "same_surname": ("warning", "c", "lower(hs) = lower(ws) AND hs <> ''"),
    "child_before_parent": ("error", "o", f"{_age('pborn', 'born')} < 0"), "young_father": ("warning", "o", f"role = 'f' AND {_age('pborn', 'born')} BETWEEN 0 AND 17"), "young_mother": ("warning", "o", f"role = 'm' AND {_age('pborn', 'born')} BETWEEN 0 AND 16"),
    "old_father": ("warning", "o", f"role = 'f' AND {_age('pborn', 'born')} > 65"), "old_mother": ("warning", "o", f"role = 'm' AND {_age('pborn', 'born')} > 48"),
    "child_after_mother_died": ("error", "o", f"role = 'm' AND {_later('born', 'pdeath')}"),
    "child_long_after_father_died": ("error", "o", f"role = 'f' AND {_later('born', 'pdeath')} AND (born.y * 12 + coalesce(born.m, 1)) - (pdeath.y * 12 + coalesce(pdeath.m, 1)) > 9"),
    "long_gap": ("warning", "g", "gap > 96"), "short_gap": ("warning", "g", "gap BETWEEN 1 AND 8 AND before IS DISTINCT FROM born"),
    "long_span": ("warning", "t", "span > 25"), "many_children": ("warning", "n", "person IS NOT NULL"),
}
_CARRIERS = {"q": "person, NULL, NULL", "s": "person, family, NULL", "c": "NULL, family, NULL", "o": "person, family, child", "g": "NULL, family, child", "t": "NULL, family, NULL", "n": "person, family, NULL"}
_AUDIT = f"""
WITH {_STOCK},
one AS (SELECT person, kind, CASE WHEN y IS NOT NULL THEN {{'y': y, 'm': m, 'd': d}} END AS day FROM e QUALIFY row_number() OVER (PARTITION BY person, kind ORDER BY id) = 1),
pe AS (SELECT p.*, b.day AS birth, h.day AS chr, t.day AS death, u.day AS buri, coalesce(b.day, h.day) AS born FROM p LEFT JOIN one b ON b.person = p.person AND b.kind = 'BIRT' LEFT JOIN one h ON h.person = p.person AND h.kind = 'CHR'
       LEFT JOIN one t ON t.person = p.person AND t.kind = 'DEAT' LEFT JOIN one u ON u.person = p.person AND u.kind = 'BURI'),
q AS (SELECT pe.*, (SELECT count(*) FROM k WHERE k.child = pe.person) AS n_parents, (SELECT count(*) FROM f WHERE f.husband = pe.person) + (SELECT count(*) FROM f WHERE f.wife = pe.person) AS n_marriages FROM pe),
c AS (SELECT f.family, h.person AS husband, v.person AS wife, h.born AS hb, v.born AS wb, h.death AS hd, v.death AS wd, h.surn AS hs, v.surn AS ws, CASE WHEN w.y IS NOT NULL THEN {{'y': w.y, 'm': w.m, 'd': w.d}} END AS marr
      FROM f LEFT JOIN pe h ON h.person = f.husband LEFT JOIN pe v ON v.person = f.wife LEFT JOIN w ON w.family = f.family),
s AS (SELECT family, marr, husband AS person, hb AS born, hd AS death FROM c WHERE husband IS NOT NULL UNION ALL SELECT family, marr, wife, wb, wd FROM c WHERE wife IS NOT NULL),
ch AS (SELECT k.family, k.child, pe.born FROM k LEFT JOIN pe ON pe.person = k.child),
o AS (SELECT ch.*, 'f' AS role, husband AS person, hb AS pborn, hd AS pdeath FROM ch JOIN c USING (family) WHERE ch.born IS NOT NULL AND husband IS NOT NULL
      UNION ALL SELECT ch.*, 'm', wife, wb, wd FROM ch JOIN c USING (family) WHERE ch.born IS NOT NULL AND wife IS NOT NULL),
g AS (SELECT family, child, born, before, (born.y * 12 + coalesce(born.m, 1)) - (before.y * 12 + coalesce(before.m, 1)) AS gap
      FROM (SELECT *, lag(born) OVER (PARTITION BY family ORDER BY born.y, coalesce(born.m, 0), coalesce(born.d, 0), child) AS before FROM ch WHERE born IS NOT NULL)),
t AS (SELECT family, count(*) AS n, max(born.y) - min(born.y) AS span FROM ch GROUP BY 1),
n AS (SELECT family, CASE WHEN wife IS NOT NULL AND n > 12 THEN wife WHEN husband IS NOT NULL AND n > 15 THEN husband END AS person FROM t JOIN c USING (family))
""" + " UNION ALL ".join(f"SELECT '{rule}' AS rule, '{severity}' AS severity, {', '.join(f'{x}::BIGINT AS {y}' for x, y in zip(_CARRIERS[source].split(', '), ('person', 'family', 'child')))} FROM {source} WHERE {test}" for rule, (severity, source, test) in _RULES.items())


def stock(spark, sf):
    """(persons, families, children, events) with dates as they are written in a file."""
    c, k, segment = table(spark, sf, "customer"), F.col("c_custkey"), F.col("c_mktsegment")
    text = lambda *parts: F.concat_ws(" ", *[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    sex = F.when(segment == "AUTOMOBILE", "").when(segment == "BUILDING", "M").when(segment == "MACHINERY", "F")
    persons = c.select(k.alias("id"), F.concat(F.lit("Family"), (F.floor(k / 3) % 499).cast("string")).alias("surn"), sex.alias("sex"))
    builders = c.where(segment == "BUILDING").select((-k).alias("id"), F.when(k % 2 == 0, k % 20 + 1).alias("husband"), F.when(k % 4 != 0, k).alias("wife"))
    families = c.where("c_acctbal > 0").select(k.alias("id"), k.alias("husband"), (k + 1).alias("wife")).unionByName(builders)
    edges = c.where(segment != "MACHINERY").select((k % 40 + 1).alias("family"), k.alias("person")).unionByName(c.where(segment.isin("FURNITURE", "MACHINERY")).select((k - 7).alias("family"), k.alias("person")))
    month = lambda m: F.element_at(F.array(*[F.lit(x) for x in MONTHS]), m.cast("int"))
    key, who, day, status, priority = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate"), F.col("o_orderstatus"), F.col("o_orderpriority")
    kind = F.when(priority == "1-URGENT", "BIRT").when(priority == "2-HIGH", "CHR").when(priority == "3-MEDIUM", "DEAT").when(priority == "5-LOW", "BURI").otherwise("OCCU")
    year = 1700 + who * 37 % 130 + F.when(kind.isin("DEAT", "BURI"), key % 110 - 5).otherwise(key % 3)
    written = F.when(status == "F", text(F.dayofmonth(day), month(F.month(day)), year)).when(status == "O", text("ABT", year)).otherwise(text("BEF", month(F.month(day)), year))
    none = F.lit(None).cast("bigint")
    of_persons = table(spark, sf, "orders").select(key.alias("id"), who.alias("person"), none.alias("family"), kind.alias("kind"), F.when(key % 11 != 0, written).otherwise("in the old book").alias("date"))
    f = F.col("id")
    married, name = 1715 + F.abs(f) * 53 % 90, month(F.abs(f) % 12 + 1)
    wedding = F.when(f % 6 == 0, text(F.abs(f) % 28 + 1, name, married)).when(f % 3 == 0, text(name, married)).otherwise(text("BET", married, "AND", married + 3))
    of_families = families.where(f % 5 != 0).select(f, none.alias("person"), f.alias("family"), F.lit("MARR").alias("kind"), wedding.alias("date"))
    return persons, families, edges.distinct(), of_persons.unionByName(of_families)


@query("register_audit", _AUDIT)
def register_audit(spark, sf):
    """Everything that the rules find in the stock of all customers and orders."""
    return A.register_audit(*stock(spark, sf))


@query("register_audit_summary", f"SELECT severity, rule, count(*) AS n FROM ({_AUDIT}) GROUP BY ALL")
def register_audit_summary(spark, sf):
    """Findings by rule."""
    return register_audit(spark, sf).groupBy("severity", "rule").agg(F.count("*").alias("n"))
