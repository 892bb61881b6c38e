"""Line records from tables: persons, families, a continued file, an excerpt, and the bytes of a file.

Records are built as arrays of lines by aggregation and joined to text, so a writer is a plan like any other. Tables:
``persons`` (id, xref, name, givn, surn, sex), ``families`` (id, xref, husband, wife), ``children`` (family, person),
``forms`` (person, kind, value), ``events`` (id, person, family, kind, date, place, value, page), ``attributes``
(id, person, family, tag, value, sort). Ids are numbers, an ``xref`` has its two signs (``@I1@``).

Defined results: a person without given name and surname is written by its full name; dates that cannot be
read become phrases; empty values give no line; equal lines of addenda are written once; empty tables give no records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import to_record_date
from ..functions.text import let
from ..operators.numbering import numbered_rows
from .line_records import read_records

#: Tags that a name's own lines hold; tags whose value is a place (fixed values of the format).
AT_NAME = ("_KB_NAME", "_RUFNAME")
AS_PLACE = ("RESI",)
#: Kinds of records that an excerpt takes along where a kept record points at them (fixed values of the format).
REFERENCED = ("_LOC", "SOUR", "NOTE", "OBJE", "REPO", "SUBM")


def _no_lines() -> Column:
    return F.array().cast("array<string>")


def _line(level: int, tag: Column | str, value: Column) -> Column:
    """An array of one line, or of none where the value is null or empty."""
    tag = F.lit(tag) if isinstance(tag, str) else tag
    return let(value, lambda v: F.when(F.coalesce(v, F.lit("")) != "", F.array(F.concat_ws(" ", F.lit(str(level)), tag, v))).otherwise(_no_lines()))


def _lines(df: DataFrame, owner: str, order: list[str], lines: Column, name: str) -> DataFrame:
    """All lines of an owner in order, as one array."""
    parts = F.sort_array(F.collect_list(F.struct(*order, lines.alias("_lines"))))
    return df.where(F.col(owner).isNotNull()).groupBy(F.col(owner).alias("_owner")).agg(F.flatten(F.transform(parts, lambda x: x["_lines"])).alias(name))


def attribute_lines(attributes: DataFrame, owner: str, name: str = "attribute_lines") -> DataFrame:
    """Lines of the attributes that stand by themselves; those of a name or an event stand there."""
    tag, value = F.col("tag"), F.col("value")
    own = attributes.where(~tag.contains(".") & ~tag.isin(*AT_NAME))
    lines = F.when(tag.isin(*AS_PLACE), F.array(F.concat(F.lit("1 "), tag), F.concat(F.lit("2 PLAC "), F.coalesce(value, F.lit(""))))).otherwise(F.array(F.concat_ws(" ", F.lit("1"), tag, F.coalesce(value, F.lit("")))))
    return _lines(own, owner, ["sort", "tag", "id"], lines, name)


def event_lines(events: DataFrame, attributes: DataFrame, owner: str, occupation_tag: bool) -> DataFrame:
    """Lines of the events with their date, place, source and the attributes that belong to their kind."""
    below = attributes.where(F.col("tag").contains(".") & F.col(owner).isNotNull()).select(F.col(owner).alias("_a_owner"), F.substring_index("tag", ".", 1).alias("_a_kind"), "id", F.concat_ws(" ", F.lit("2"), F.substring_index("tag", ".", -1), F.coalesce("value", F.lit(""))).alias("_a_line"))
    below = below.groupBy("_a_owner", "_a_kind").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "_a_line"))), lambda x: x["_a_line"]).alias("_below"))
    e = events.where(F.col(owner).isNotNull()).join(below, (F.col(owner) == F.col("_a_owner")) & (F.col("kind") == F.col("_a_kind")), "left")
    filled = F.coalesce("value", F.lit("")) != ""
    head = F.when(filled & F.lit(occupation_tag), F.concat_ws(" ", F.lit("1"), F.col("kind"), F.col("value"))).otherwise(F.concat(F.lit("1 "), F.col("kind")))
    whole = F.concat(F.array(head), _line(2, "DATE", to_record_date(F.col("date"))), _line(2, "PLAC", F.col("place")), _line(2, "NOTE", F.col("page")), F.coalesce("_below", _no_lines()))
    job = F.array(F.when(filled, F.concat(F.lit("1 _BERUF_KB "), F.col("value"))).otherwise(F.lit("1 OCCU")))
    return _lines(e, owner, ["id"], F.when(F.lit(occupation_tag) & (F.col("kind") == "OCCU"), job).otherwise(whole), "event_lines")


def _joined(heads: DataFrame, **parts: DataFrame) -> DataFrame:
    """``heads`` with the array of lines of each part, null where an owner has none."""
    for name, part in parts.items():
        lines = next(c for c in part.columns if c != "_owner")
        heads = heads.join(part.select(F.col("_owner").alias(f"_{name}"), F.col(lines).alias(name)), F.col("id") == F.col(f"_{name}"), "left").drop(f"_{name}")
    return heads


def _record(head: Column, *parts: Column | str) -> Column:
    """The head and the lines of all parts as one text; array_join leaves out nothing but missing parts."""
    return F.array_join(F.concat(head, *[F.coalesce(F.col(x) if isinstance(x, str) else x, _no_lines()) for x in parts]), "\n")


def person_records(persons: DataFrame, families: DataFrame, children: DataFrame, forms: DataFrame, events: DataFrame, attributes: DataFrame) -> DataFrame:
    """``id, xref, raw`` of every person with an xref."""
    xrefs = families.where(F.col("xref").isNotNull())
    pointers = lambda rows, tag, name: rows.groupBy(F.col("person").alias("_owner")).agg(F.transform(F.array_sort(F.collect_set("xref")), lambda x: F.concat(F.lit(f"1 {tag} "), x)).alias(name))
    as_child = pointers(children.join(xrefs.select(F.col("id").alias("family"), "xref"), "family"), "FAMC", "as_child")
    spouses = xrefs.select("xref", F.explode(F.array("husband", "wife")).alias("person")).where(F.col("person").isNotNull())
    own_forms = lambda kind, tag, name: _lines(forms.where(F.col("kind") == kind), "person", ["value"], _line(2, tag, F.col("value")), name)
    surname = F.when(F.coalesce("surn", F.lit("")) != "", F.concat(F.lit("/"), F.col("surn"), F.lit("/")))
    full = F.concat_ws(" ", F.nullif(F.coalesce("givn", F.lit("")), F.lit("")), surname)
    heads = persons.where(F.col("xref").isNotNull()).select("id", "xref", F.when(full != "", full).otherwise(F.coalesce("name", F.lit(""))).alias("full"), "givn", "surn", "sex")
    rows = _joined(
        heads, book=own_forms("kb", "_KB_NAME", "book"), call=own_forms("rufname", "_RUFNAME", "call"), happened=event_lines(events, attributes, "person", True),
        has=attribute_lines(attributes, "person"), as_child=as_child, as_spouse=pointers(spouses, "FAMS", "as_spouse"),
    )
    head = F.array(F.concat_ws(" ", F.lit("0"), "xref", F.lit("INDI")), F.concat(F.lit("1 NAME "), F.col("full")))
    text = _record(head, _line(2, "GIVN", F.col("givn")), _line(2, "SURN", F.col("surn")), "book", "call", _line(1, "SEX", F.col("sex")), "happened", "has", "as_child", "as_spouse")
    return rows.select("id", "xref", text.alias("raw"))


def family_records(persons: DataFrame, families: DataFrame, children: DataFrame, events: DataFrame, attributes: DataFrame) -> DataFrame:
    """``id, xref, raw`` of every family with an xref; members without one are left out."""
    x = persons.where(F.col("xref").isNotNull()).select(F.col("id").alias("_p"), F.col("xref").alias("_x"))
    member = lambda df, column, name: df.join(x.select(F.col("_p").alias(f"_{name}"), F.col("_x").alias(name)), F.col(column) == F.col(f"_{name}"), "left").drop(f"_{name}")
    heads = member(member(families.where(F.col("xref").isNotNull()).select("id", "xref", "husband", "wife"), "husband", "h_xref"), "wife", "w_xref")
    kids = _lines(children.join(x, F.col("person") == F.col("_p")), "family", ["person"], _line(1, "CHIL", F.col("_x")), "kids")
    rows = _joined(heads, kids=kids, happened=event_lines(events, attributes, "family", False), has=attribute_lines(attributes, "family"))
    text = _record(F.array(F.concat_ws(" ", F.lit("0"), "xref", F.lit("FAM"))), _line(1, "HUSB", F.col("h_xref")), _line(1, "WIFE", F.col("w_xref")), "kids", "happened", "has")
    return rows.select("id", "xref", text.alias("raw"))


def with_xrefs(rows: DataFrame, prefix: str) -> DataFrame:
    """``rows`` (with id and xref) where missing xrefs are numbered on from the largest number of this prefix, in order of the id."""
    number = F.regexp_extract("xref", rf"^@{prefix}(\d+)@$", 1)
    top = rows.agg(F.coalesce(F.max(F.nullif(number, F.lit("")).cast("bigint")), F.lit(0)).alias("_top"))
    fresh = numbered_rows(rows.where(F.col("xref").isNull()).select(F.col("id").alias("_id")), [F.col("_id")], "_n").join(F.broadcast(top))
    named = fresh.select("_id", F.concat(F.lit(f"@{prefix}"), (F.col("_top") + F.col("_n")).cast("string"), F.lit("@")).alias("_new"))
    return rows.join(named, F.col("id") == F.col("_id"), "left").withColumn("xref", F.coalesce("xref", "_new")).drop("_id", "_new")


def continued(template: DataFrame, persons: DataFrame, families: DataFrame, children: DataFrame, forms: DataFrame, events: DataFrame, attributes: DataFrame) -> DataFrame:
    """``part, seq, xref, raw, kind`` of a template (``seq, xref, typ, raw``) continued by the tables; the file is in order of part and seq.

    Records of the template pass through as they are (``passed``); those that lack a pointer to a family or child of the tables get it at their end,
    sorted (``extended``); persons and families that the template lacks follow (``person``, ``family``), and the trailer is last.
    """
    there = template.where(F.col("xref").isNotNull()).select("xref").distinct()
    absent = lambda rows: rows.join(there, "xref", "left_anti")
    p = persons.where(F.col("xref").isNotNull()).select(F.col("id").alias("person"), F.col("xref").alias("p_xref"))
    f = families.where(F.col("xref").isNotNull()).select(F.col("id").alias("family"), F.col("xref").alias("f_xref"))
    child = children.join(p, "person").join(f, "family")
    spouse = families.select(F.col("id").alias("family"), F.explode(F.array("husband", "wife")).alias("person")).join(p, "person").join(f, "family")
    new_child = child.join(there.select(F.col("xref").alias("p_xref")), "p_xref", "left_anti")
    wanted = (
        child.select(F.col("p_xref").alias("xref"), F.concat(F.lit("1 FAMC "), F.col("f_xref")).alias("line"))
        .unionByName(spouse.select(F.col("p_xref").alias("xref"), F.concat(F.lit("1 FAMS "), F.col("f_xref")).alias("line")))
        .unionByName(new_child.select(F.col("f_xref").alias("xref"), F.concat(F.lit("1 CHIL "), F.col("p_xref")).alias("line")))
    )
    addenda = wanted.groupBy(F.col("xref").alias("a_xref")).agg(F.array_sort(F.collect_set("line")).alias("addenda"))
    more = F.array_except(F.coalesce("addenda", _no_lines()), F.split(F.replace("raw", F.lit("\r"), F.lit("")), "\n"))
    last = F.col("typ").eqNullSafe(F.lit("TRLR"))
    old = template.join(addenda, F.col("xref") == F.col("a_xref"), "left").withColumn("more", more).select(
        F.when(last, 3).otherwise(0).alias("part"), F.col("seq").cast("bigint").alias("seq"), "xref",
        F.array_join(F.concat(F.array("raw"), "more"), "\n").alias("raw"), F.when(last, "trailer").when(F.size("more") > 0, "extended").otherwise("passed").alias("kind"),
    )
    made = lambda rows, part, kind: absent(rows).select(F.lit(part).alias("part"), F.col("id").cast("bigint").alias("seq"), "xref", "raw", F.lit(kind).alias("kind"))
    trailer = template.agg(F.count_if(last).alias("n")).where("n = 0").select(F.lit(3).alias("part"), F.lit(0).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("xref"), F.lit("0 TRLR").alias("raw"), F.lit("trailer").alias("kind"))
    return old.unionByName(made(person_records(persons, families, children, forms, events, attributes), 1, "person")).unionByName(made(family_records(persons, families, children, events, attributes), 2, "family")).unionByName(trailer)


def rewritten(persons: DataFrame, families: DataFrame, children: DataFrame, forms: DataFrame, events: DataFrame, attributes: DataFrame, head: str = "0 HEAD") -> DataFrame:
    """``part, seq, xref, raw, kind`` of a file made of the tables alone."""
    empty = persons.sparkSession.createDataFrame([(0, None, "HEAD", head)], "seq long, xref string, typ string, raw string")
    return continued(empty, persons, families, children, forms, events, attributes)


def file_properties(spark: SparkSession, path: str) -> DataFrame:
    """``source, bom, eol, final_newline, content`` of every file; a file is one row."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("source"), "content")
    bom = F.hex(F.substring("content", 1, 3)) == "EFBBBF"
    ends = F.length("content")
    return files.select("source", bom.alias("bom"), F.when(F.contains("content", F.lit(b"\r\n")), "crlf").otherwise("lf").alias("eol"), (F.hex(F.substring(F.col("content"), ends, F.lit(1))) == "0A").alias("final_newline"), "content")


def file_bytes(records: DataFrame, properties: DataFrame) -> DataFrame:
    """``source, bytes``: the records (``source, seq, raw``) of each file as the bytes of a file with these properties.

    A file is one row here; files beyond the memory of a task go through ``write_records``.
    """
    texts = records.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("seq", "raw"))).alias("r"))
    text = F.replace(F.array_join(F.transform("r", lambda x: x["raw"]), "\n"), F.lit("\r"), F.lit(""))
    text = F.concat(text, F.when(F.col("final_newline"), "\n").otherwise(""))
    text = F.when(F.col("eol") == "crlf", F.replace(text, F.lit("\n"), F.lit("\r\n"))).otherwise(text)
    mark = F.when(F.col("bom"), F.lit("\ufeff")).otherwise(F.lit(""))
    return texts.join(properties.select("source", "bom", "eol", "final_newline"), "source").select("source", F.encode(F.concat(mark, text), "UTF-8").alias("bytes"))


def unchanged(spark: SparkSession, path: str) -> DataFrame:
    """``source, size, identical, first_difference`` of every file that is read and written without a change; the place counts bytes from 0."""
    properties = file_properties(spark, path)
    made = file_bytes(read_records(spark, path), properties)
    both = properties.join(made, "source", "left").withColumn("bytes", F.coalesce("bytes", F.lit("").cast("binary")))
    step = 4096
    longest = F.greatest(F.length("content"), F.length("bytes"))
    blocks = F.sequence(F.lit(0), F.floor(longest / step).cast("int"))
    part = lambda c, k, size: F.substring(F.col(c), k + 1, F.lit(size))
    block = F.get(F.filter(blocks, lambda k: part("content", k * step, step) != part("bytes", k * step, step)), F.lit(0))
    place = F.get(F.filter(F.sequence(block * step, block * step + step), lambda k: part("content", k, 1) != part("bytes", k, 1)), F.lit(0))
    return both.select("source", F.length("content").cast("bigint").alias("size"), (F.col("content") == F.col("bytes")).alias("identical"), F.when(F.col("content") != F.col("bytes"), place).alias("first_difference"))


def dead_pointers(records: DataFrame) -> DataFrame:
    """``xref, target`` of the pointers without a record."""
    lines = records.select("xref", F.explode(F.split("raw", "\n")).alias("line"))
    target = F.regexp_extract("line", r"^\s*\d+ \S+ (@[^@]+@)\s*$", 1)
    return lines.select("xref", target.alias("target")).where(F.col("target") != "").distinct().join(records.select(F.col("xref").alias("target")).where(F.col("target").isNotNull()).distinct(), "target", "left_anti").select("xref", "target")


def excerpt(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """``seq, xref, typ, raw`` of the records around the ``wanted`` persons (``xref``).

    Kept are these persons, the families in which they are a spouse, the spouses of those families, and what kept records point
    at through two further steps (places, sources, notes, media, repositories, submitters), the head and the trailer. A line that points at a record that is not kept
    is cut with the lines below it.
    """
    lines = records.where(F.col("xref").isNotNull()).select("xref", "typ", F.explode(F.split("raw", "\n")).alias("line"))
    links = lines.select("xref", "typ", F.regexp_extract("line", r"^\s*\d+ (\S+) @[^@]+@\s*$", 1).alias("tag"), F.regexp_extract("line", r"^\s*\d+ \S+ (@[^@]+@)\s*$", 1).alias("target")).where(F.col("target") != "")
    start = wanted.select("xref").distinct()
    of_families = links.where((F.col("typ") == "FAM") & F.col("tag").isin("HUSB", "WIFE"))
    families = of_families.join(start.select(F.col("xref").alias("target")), "target", "left_semi").select("xref").distinct()
    spouses = of_families.join(families, "xref", "left_semi").select(F.col("target").alias("xref"))
    kept = start.unionByName(families).unionByName(spouses).distinct()
    others = records.where(F.col("typ").isin(*REFERENCED)).select("xref")
    for _ in range(2):  # a source points at its repository, a place at a place above it
        reached = links.join(kept, "xref", "left_semi").select(F.col("target").alias("xref")).join(others, "xref", "left_semi")
        kept = kept.unionByName(reached).distinct()
    chosen = records.join(kept, "xref", "left_semi").unionByName(records.where(F.col("typ").isin("HEAD", "TRLR")))
    numbered = chosen.select("seq", "xref", "typ", F.posexplode(F.split("raw", "\n")).alias("n", "line"))
    target = F.regexp_extract("line", r"^\s*\d+ \S+ (@[^@]+@)\s*$", 1)
    level = F.coalesce(F.regexp_extract("line", r"^\s*(\d+)", 1).try_cast("int"), F.lit(0))
    there = kept.select(F.col("xref").alias("t_xref"))
    marked = numbered.withColumn("target", target).join(there, F.col("target") == F.col("t_xref"), "left").withColumn("dead", (F.col("target") != "") & F.col("t_xref").isNull() & (F.col("n") > 0))
    rows = marked.groupBy("seq", "xref", "typ").agg(F.sort_array(F.collect_list(F.struct("n", level.alias("level"), "dead", "line"))).alias("l"))
    # One walk over the lines of a record: the level of the cut line that is open, and what is left.
    free = 1 << 20
    first = F.struct(F.lit(free).alias("cut"), _no_lines().alias("left"))

    def step(state: Column, x: Column) -> Column:
        open_ = F.when(x["level"] <= state["cut"], F.lit(free)).otherwise(state["cut"])
        now = F.when((open_ == free) & x["dead"], x["level"]).otherwise(open_)
        return F.struct(now.alias("cut"), F.when(now == free, F.concat(state["left"], F.array(x["line"]))).otherwise(state["left"]).alias("left"))

    return rows.select("seq", "xref", "typ", F.array_join(F.aggregate("l", first, step)["left"], "\n").alias("raw"))
