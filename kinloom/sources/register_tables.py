"""Person, name-form, family, child and event tables from line records.

All lines of a record are numbered by the level-1 block that they stand in, one window over the record. Each block
becomes a row by aggregation, and the tables are projections of these rows. Pointers are resolved by
joining them with the persons of the same source; pointers to unknown persons are left out.

Defined results: of person records with one id the first counts, of family records with one id the last gives the
spouses; events come from all of them. Records without an id are kept, each for itself. No records give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .line_records import record_lines

# Fixed values of the format.
EVENT_TAGS = ("BIRT", "CHR", "BAPM", "DEAT", "BURI", "MARR", "DIV", "OCCU", "RESI", "EVEN", "CENS", "CONF")
INEXACT = r"(?i)\b(BEF|AFT|ABT|CAL|EST|BET|FROM|TO)\b"
YEAR = r"\b([0-9]{3,4})\b"
POINTER = r"^(@[^@]+@)"


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _surname(full: Column) -> Column:
    """What stands between the two slashes of a full name."""
    return _filled(F.get(F.split(full, "/"), F.when(F.size(F.split(full, "/")) > 2, 1)))


def blocks(records: DataFrame) -> DataFrame:
    """One row per level-1 block: ``source, seq, xref, typ, block, tag, value, date, place, page, given, surname, book_names, call_names``.

    Block 0 is the head of the record.
    """
    record = Window.partitionBy("source", "seq")
    head = F.col("n") == 0
    lines = (
        record_lines(records.where(F.col("typ").isin("INDI", "FAM")))
        .withColumn("block", F.sum((F.coalesce("level", F.lit(0)) == 1).cast("int")).over(record.orderBy("n")))
        .withColumn("typ", F.max(F.when(head, F.col("tag"))).over(record))
        .withColumn("owner", F.max(F.when(head, F.col("xref"))).over(record))
    )
    at = lambda level, tag: (F.col("level") == level) & (F.col("tag") == tag)
    first = lambda level, tag: _filled(F.min(F.when(at(level, tag), F.struct("n", "value")))["value"])
    every = lambda level, tag: F.collect_set(F.when(at(level, tag), _filled(F.col("value"))))
    opening = F.min(F.struct("n", "tag", "value"))
    return (
        lines.groupBy("source", "seq", F.col("owner").alias("xref"), "typ", "block")
        .agg(
            opening.alias("o"), first(2, "DATE").alias("date"), first(2, "PLAC").alias("place"), first(3, "PAGE").alias("page"),
            first(2, "GIVN").alias("given"), first(2, "SURN").alias("surname"), every(2, "_KB_NAME").alias("book_names"), every(2, "_RUFNAME").alias("call_names"),
        )
        .select("source", "seq", "xref", "typ", "block", "o.tag", _filled(F.col("o.value")).alias("value"), "date", "place", "page", "given", "surname", "book_names", "call_names")
    )


def _own_key() -> Column:
    """Tells records without an id apart."""
    return F.when(F.col("xref").isNull(), F.col("seq")).alias("nameless")


def persons(parts: DataFrame) -> DataFrame:
    """``source, xref, name, givn, surn, sex`` of every person in ``blocks``."""
    full = F.col("value")
    name = F.struct(
        "block", F.trim(F.replace(full, F.lit("/"), F.lit(""))).alias("name"),
        F.coalesce("given", F.trim(F.get(F.split(full, "/"), F.lit(0)))).alias("givn"), F.coalesce("surname", _surname(full)).alias("surn"),
    )
    own = parts.where(F.col("typ") == "INDI").groupBy("source", "xref", "seq").agg(
        F.min(F.when((F.col("tag") == "NAME") & full.isNotNull(), name)).alias("name"), F.max(F.when(F.col("tag") == "SEX", F.struct("block", "value")))["value"].alias("sex")
    )
    one = own.groupBy("source", "xref", _own_key()).agg(F.min(F.struct("seq", "name", "sex")).alias("p"))
    return one.select("source", "xref", "p.name.name", "p.name.givn", "p.name.surn", "p.sex")


def name_forms(parts: DataFrame) -> DataFrame:
    """``source, xref, kind, value``: distinct surnames (``surn``), later names (``variante``), book forms (``kb``) and call names (``rufname``)."""
    names = parts.where((F.col("typ") == "INDI") & (F.col("tag") == "NAME") & F.col("value").isNotNull() & F.col("xref").isNotNull())
    first = F.min("block").over(Window.partitionBy("source", "seq"))
    form = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    forms = F.concat(
        F.array(form("surn", F.coalesce("surname", _surname(F.col("value")))), form("variante", F.when(F.col("block") > F.col("first"), F.col("value")))),
        F.transform("book_names", lambda x: form("kb", x)), F.transform("book_names", lambda x: form("surn", _surname(x))), F.transform("call_names", lambda x: form("rufname", x)),
    )
    return names.withColumn("first", first).select("source", "xref", F.explode(forms).alias("f")).select("source", "xref", "f.kind", "f.value").where(F.col("value").isNotNull()).distinct()


def _pointers(parts: DataFrame, people: DataFrame) -> DataFrame:
    """``source, seq, xref, block, tag, person`` of the pointers that families hold to known persons."""
    known = people.where(F.col("xref").isNotNull()).select("source", F.col("xref").alias("person"))
    target = F.nullif(F.regexp_extract("value", POINTER, 1), F.lit(""))
    return parts.where((F.col("typ") == "FAM") & F.col("tag").isin("HUSB", "WIFE", "CHIL")).select("source", "seq", "xref", "block", "tag", target.alias("person")).join(known, ["source", "person"])


def families(parts: DataFrame, people: DataFrame) -> DataFrame:
    """``source, xref, husband, wife``; the last known spouse of each kind counts."""
    last = lambda tag: F.max(F.when(F.col("tag") == tag, F.struct("block", "person")))["person"]
    spouses = _pointers(parts, people).groupBy("source", "seq").agg(last("HUSB").alias("husband"), last("WIFE").alias("wife"))
    heads = parts.where((F.col("typ") == "FAM") & (F.col("block") == 0)).select("source", "seq", "xref")
    rows = heads.join(spouses, ["source", "seq"], "left").groupBy("source", "xref", _own_key()).agg(F.max(F.struct("seq", "husband", "wife")).alias("f"))
    return rows.select("source", "xref", "f.husband", "f.wife")


def children(parts: DataFrame, people: DataFrame) -> DataFrame:
    """``source, family, person``, each edge once."""
    edges = _pointers(parts, people).where((F.col("tag") == "CHIL") & F.col("xref").isNotNull())
    return edges.select("source", F.col("xref").alias("family"), "person").distinct()


def events(parts: DataFrame) -> DataFrame:
    """``source, person, family, kind, date, year, exact, place, value, page``; dates stay as they are written."""
    year = F.nullif(F.regexp_extract(F.coalesce("date", F.lit("")), YEAR, 1), F.lit("")).cast("int")
    exact = ~F.coalesce(F.col("date").rlike(INEXACT), F.lit(False))
    owner = lambda typ: F.when(F.col("typ") == typ, F.col("xref"))
    return parts.where((F.col("block") > 0) & F.col("tag").isin(*EVENT_TAGS)).select(
        "source", owner("INDI").alias("person"), owner("FAM").alias("family"), F.col("tag").alias("kind"), "date", year.alias("year"), exact.alias("exact"), "place", "value", "page"
    )
