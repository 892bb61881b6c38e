"""Files written from and checked against register tables that are derived from all customers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.graph import written
from ..sources import gedcom7 as G
from ..sources import record_writers as W
from ..session import table
from .registry import query

# A person for every customer, a family for every one in credit with the next one as wife, children in debt, an event for every order.
_TABLES = """
c AS (SELECT c_custkey AS k, '@I' || c_custkey || '@' AS x, 'Given' || (c_custkey % 97) AS givn, 'Family' || (c_custkey % 499) AS surn, c_mktsegment AS s, c_acctbal > 0 AS own, 'Town' || c_nationkey AS town FROM customer),
ev AS (SELECT o_custkey AS k, o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'BIRT' WHEN '2-HIGH' THEN 'DEAT' WHEN '3-MEDIUM' THEN 'OCCU' WHEN '5-LOW' THEN 'EVEN' ELSE 'CHR' END AS kind, o_orderstatus AS st,
  CASE o_orderstatus WHEN 'F' THEN day(o_orderdate) || ' ' || upper(strftime(o_orderdate, '%b')) || ' ' || year(o_orderdate) END AS day, CASE o_orderstatus WHEN 'O' THEN 'vor Ostern ' || year(o_orderdate) END AS phrase,
  'Clerk' || (o_orderkey % 1000) AS clerk, 'p. ' || (o_orderkey % 300) AS page FROM orders)
"""
_EXPORT = f"""
WITH {_TABLES},
l AS (SELECT e.k, e.id, CASE WHEN kind = 'OCCU' THEN CASE WHEN st <> 'P' THEN '1 _BERUF_KB ' || clerk END ELSE concat_ws(chr(10), CASE kind WHEN 'EVEN' THEN '1 EVEN seen' ELSE '1 ' || kind END, CASE WHEN kind = 'DEAT' AND st = 'O' THEN '2 NOTE stillborn' END,
  '2 DATE ' || day, '2 DATE' || chr(10) || '3 PHRASE ' || phrase, CASE WHEN kind IN ('BIRT', 'CHR') THEN '2 PLAC ' || clerk END, '2 NOTE ' || page, CASE WHEN kind = 'BIRT' AND s = 'BUILDING' THEN '2 NOTE early' END) END AS t FROM ev e JOIN c ON c.k = e.k),
h AS (SELECT k, string_agg(t, chr(10) ORDER BY id) AS t FROM l WHERE t IS NOT NULL GROUP BY k),
fam AS (SELECT f.k, concat_ws(chr(10), '0 @F' || f.k || '@ FAM', '1 HUSB ' || f.x, '1 WIFE ' || w.x, CASE WHEN NOT w.own THEN '1 CHIL ' || w.x END, '1 MARR', '2 PLAC ' || f.town) AS raw FROM c f LEFT JOIN c w ON w.k = f.k + 1 WHERE f.own)
SELECT c.x AS xref, concat_ws(chr(10), '0 ' || c.x || ' INDI', '1 NAME ' || c.givn || ' /' || c.surn || '/', '2 GIVN ' || c.givn, '2 SURN ' || c.surn, CASE WHEN c.s = 'MACHINERY' THEN '2 _KB_NAME ' || c.givn || ' /' || c.surn || 'in/' END,
  CASE c.s WHEN 'BUILDING' THEN '1 SEX M' WHEN 'MACHINERY' THEN '1 SEX F' END, h.t, '1 RESI', '2 PLAC ' || c.town, CASE WHEN NOT c.own AND b.own THEN '1 FAMC @F' || b.k || '@' END,
  CASE WHEN c.own AND b.own THEN '1 FAMS ' || least('@F' || c.k || '@', '@F' || b.k || '@') || chr(10) || '1 FAMS ' || greatest('@F' || c.k || '@', '@F' || b.k || '@') WHEN c.own THEN '1 FAMS @F' || c.k || '@' WHEN b.own THEN '1 FAMS @F' || b.k || '@' END) AS raw
FROM c LEFT JOIN c b ON b.k = c.k - 1 LEFT JOIN h ON h.k = c.k
UNION ALL SELECT '@F' || k || '@', raw FROM fam
UNION ALL SELECT NULL, concat_ws(chr(10), '0 HEAD', '1 GEDC', '2 VERS 7.0', (SELECT '1 SCHMA' || chr(10) || string_agg('2 TAG ' || t || ' https://example.org/tags/' || lower(t), chr(10) ORDER BY t)
  FROM (SELECT '_BERUF_KB' AS t WHERE EXISTS (SELECT 1 FROM ev WHERE kind = 'OCCU' AND st <> 'P') UNION ALL SELECT '_KB_NAME' WHERE EXISTS (SELECT 1 FROM c WHERE s = 'MACHINERY'))), '1 SOUR kinloom', '2 NAME kinloom')
UNION ALL SELECT NULL, '0 TRLR'
"""


def register_tables(spark, sf):
    """(persons, families, children, forms, events, attributes) as the writers of records take them."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    none, number = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    given, surname, segment = text("Given", k % 97), text("Family", k % 499), F.col("c_mktsegment")
    sex = F.when(segment == "BUILDING", "M").when(segment == "MACHINERY", "F").when(segment == "HOUSEHOLD", "w")
    persons = c.select(k.alias("id"), text("@I", k, "@").alias("xref"), text(given, " ", surname).alias("name"), given.alias("givn"), surname.alias("surn"), sex.alias("sex"))
    families = c.where("c_acctbal > 0").select(k.alias("id"), text("@F", k, "@").alias("xref"), k.alias("husband"), (k + 1).alias("wife"))
    children = c.where("NOT c_acctbal > 0").select((k - 1).alias("family"), k.alias("person")).join(families.select(F.col("id").alias("family")), "family", "left_semi")
    forms = c.where(segment == "MACHINERY").select(k.alias("person"), F.lit("kb").alias("kind"), text(given, " /", surname, "in/").alias("value"))
    day, status, priority = F.col("o_orderdate"), F.col("o_orderstatus"), F.col("o_orderpriority")
    clerk = text("Clerk", F.col("o_orderkey") % 1000)
    kind = F.when(priority == "1-URGENT", "BIRT").when(priority == "2-HIGH", "DEAT").when(priority == "3-MEDIUM", "OCCU").when(priority == "5-LOW", "EVEN").otherwise("CHR")
    date = F.when(status == "F", text(F.day(day), ".", F.month(day), ".", F.year(day))).when(status == "O", text("vor Ostern ", F.year(day)))
    value = F.when((kind == "DEAT") & (status == "O"), "stillborn").when((kind == "OCCU") & (status != "P"), clerk).when(kind == "EVEN", "seen")
    of_persons = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("person"), number.alias("family"), kind.alias("kind"), date.alias("date"),
        F.when(kind.isin("BIRT", "CHR"), clerk).alias("place"), value.alias("value"), text("p. ", F.col("o_orderkey") % 300).alias("page"),
    )
    town = text("Town", F.col("c_nationkey"))
    of_families = c.where("c_acctbal > 0").select(k.alias("id"), number.alias("person"), k.alias("family"), F.lit("MARR").alias("kind"), none.alias("date"), town.alias("place"), none.alias("value"), none.alias("page"))
    attribute = lambda tag, value: c.select(k.alias("id"), k.alias("person"), number.alias("family"), F.lit(tag).alias("tag"), value.alias("value"), F.lit(1).alias("sort"))
    early = attribute("BIRT.NOTE", F.lit("early")).join(c.where(segment == "BUILDING").select(k.alias("id")), "id", "left_semi")
    return persons, families, children, forms, of_persons.unionByName(of_families), attribute("RESI", town).unionByName(early)


@query("export7", _EXPORT)
def export7(spark, sf):
    """All records of the GEDCOM 7 file of the tables."""
    return G.export7(*register_tables(spark, sf)).select("xref", "raw")


def _as_file(rows):
    """Written records (part, seq, xref, raw) as records that were read from one file."""
    typ = F.regexp_extract("raw", r"^0 (?:@[^@]+@ )?(\S+)", 1)
    return rows.select(F.lit("file").alias("source"), (F.col("part") * (1 << 40) + F.col("seq")).alias("seq"), "xref", typ.alias("typ"), "raw")


@query("validate7", f"""
WITH {_TABLES}, p AS (
  SELECT 'extension tag _KB_NAME is not declared in HEAD.SCHMA' AS cause, k, ' > NAME > _KB_NAME' AS path FROM c WHERE s = 'MACHINERY'
  UNION ALL SELECT 'extension tag _BERUF_KB is not declared in HEAD.SCHMA', k, ' > _BERUF_KB' FROM ev WHERE kind = 'OCCU' AND st <> 'P'
  UNION ALL SELECT 'DEAT has text; only Y or nothing is allowed', k, ' > DEAT' FROM ev WHERE kind = 'DEAT' AND st = 'O'
  UNION ALL SELECT 'TYPE is missing', k, ' > EVEN' FROM ev WHERE kind = 'EVEN')
SELECT cause, count(*) AS n, 'INDI @I' || min(k) || '@' || min(path) AS example FROM p GROUP BY 1 UNION ALL SELECT 'GEDC is missing', 1, 'HEAD'""")
def validate7(spark, sf):
    """Findings in the file that the tables give in the older form; it was not made for GEDCOM 7."""
    return G.validate(written(_as_file(W.rewritten(*register_tables(spark, sf))))).select("cause", "n", "example")


@query("validate7_export", """
SELECT 'TYPE is missing' AS cause, count(*) AS n, 'INDI @I' || min(o_custkey) || '@ > EVEN' AS example FROM orders WHERE o_orderpriority = '5-LOW' HAVING count(*) > 0""")
def validate7_export(spark, sf):
    """Findings in the GEDCOM 7 file of the tables: its events without a kind, and nothing else."""
    return G.validate(_as_file(G.export7(*register_tables(spark, sf)))).select("cause", "n", "example")


@query("extension_tags", f"""WITH {_TABLES} SELECT '_BERUF_KB' AS tag WHERE EXISTS (SELECT 1 FROM ev WHERE kind = 'OCCU' AND st <> 'P') UNION ALL SELECT '_KB_NAME' WHERE EXISTS (SELECT 1 FROM c WHERE s = 'MACHINERY')""")
def extension_tags(spark, sf):
    """The extension tags that the written file holds."""
    return G.extension_tags(_as_file(G.export7(*register_tables(spark, sf))))
