"""GEDCOM 7: files made of the tables, extension tags in use, and validation with findings bundled by cause.

A line's type hangs on the types of the lines above it. All lines of a record are typed level by level: a window over the record
finds the line above, and the table of the standard gives the type of the tag there. So a plan has one window a level
of the data, all on one sort, and no record is held as an array. Findings are counted by cause, with the first place of each.

Defined results: an empty table has no findings; the number of a record within its source orders the places; lines that are none, and lines whose
level jumps, are findings themselves and nothing below them is judged; nothing is said of what stands below an extension tag
or below a line that is itself out of place; ``CONT`` lines belong to the value above them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import to_record_date
from ..functions.text import let
from ..operators.graph import written
from .line_records import record_lines
from .record_writers import AS_PLACE, AT_NAME, _joined, _line, _lines, _no_lines, _record

# Fixed values of the public standard: what may stand below what. ``TAG=type`` names the type below where it is not the tag;
# ``*`` any number, ``!`` exactly one, ``+`` one or more, else at most one. Types that are not listed hold nothing.
_NOTES = "NOTE* SNOTE=to_note*"
_CITED = f"{_NOTES} SOUR=citation*"
_CONTACT = "PHON* EMAIL* FAX* WWW*"
_IDS = "REFN=kinded* UID* EXID=kinded*"
_KEPT = f"{_IDS} CHAN=changed CREA=made"
_DETAIL = f"DATE=dated PLAC=place ADDR {_CONTACT} AGNC RELI CAUS RESN SDATE=dated ASSO=associate* {_CITED} OBJE=to_media* UID* TYPE"
_PIECES = "NPFX* GIVN* NICK* SPFX* SURN* NSFX*"
_ORDINANCE = f"DATE=dated TEMP PLAC=place STAT=ordinance_state {_CITED}"
_EVENTS = ("BAPM", "BARM", "BASM", "BLES", "BURI", "CENS", "CHRA", "CONF", "CREM", "DEAT", "EMIG", "FCOM", "GRAD", "IMMI", "NATU", "ORDN", "PROB", "RETI", "WILL")
_FACTS = ("CAST", "DSCR", "EDUC", "NATI", "NCHI", "NMR", "OCCU", "PROP", "RELI", "RESI", "SSN", "TITL")
_UNIONS = ("ANUL", "CENS", "DIV", "DIVF", "ENGA", "MARB", "MARC", "MARL", "MARR", "MARS")
_each = lambda tags, kind: " ".join(f"{t}={kind}*" for t in tags)
GRAMMAR = {
    "file": "HEAD! FAM=family* INDI=person* OBJE=media* REPO=store* SNOTE=note* SOUR=source* SUBM=sender* TRLR=trailer!",
    "HEAD": "GEDC! SCHMA SOUR=program DEST DATE=timed SUBM=to_sender COPR LANG PLAC=place_form NOTE SNOTE=to_note",
    "GEDC": "VERS!", "SCHMA": "TAG=declaration*", "program": "VERS NAME CORP DATA=program_data", "CORP": f"ADDR {_CONTACT}", "program_data": "DATE=timed COPR", "place_form": "FORM!",
    "family": f"RESN {_each(('NCHI', 'RESI'), 'union_fact')} FACT=union_named* {_each(_UNIONS, 'union')} EVEN=union_named* NO* HUSB=to_spouse WIFE=to_spouse CHIL=to_child* ASSO=associate* SUBM=to_sender* SLGS=ordinance* {_CITED} OBJE=to_media* {_KEPT}",
    "person": f"RESN NAME=name* SEX {_each(_FACTS, 'fact')} {_each(('IDNO', 'FACT', 'EVEN'), 'named')} {_each(_EVENTS, 'event')} {_each(('BIRT', 'CHR'), 'birth')} ADOP=adoption* NO* {_each(('BAPL', 'CONL', 'ENDL', 'INIL'), 'ordinance')} SLGC=child_ordinance* "
    f"FAMC=to_parents* FAMS=to_union* SUBM=to_sender* ASSO=associate* ALIA=to_alias* ANCI=to_sender* DESI=to_sender* {_CITED} OBJE=to_media* {_KEPT}",
    "media": f"RESN FILE+ {_CITED} {_KEPT}", "FILE": "FORM=media_form! TITL TRAN=file_form*", "media_form": "MEDI=phrased", "file_form": "FORM!",
    "store": f"NAME! ADDR {_CONTACT} {_NOTES} {_KEPT}", "note": f"MIME LANG TRAN=translation* SOUR=citation* {_KEPT}",
    "source": f"DATA=source_data AUTH TITL ABBR PUBL TEXT=typed_text REPO=to_store* {_NOTES} OBJE=to_media* {_KEPT}", "source_data": f"EVEN=source_event* AGNC {_NOTES}", "source_event": "DATE=phrased PLAC=place",
    "sender": f"NAME! ADDR {_CONTACT} OBJE=to_media* LANG* {_NOTES} {_KEPT}",
    "name": f"TYPE=phrased {_PIECES} TRAN=name_translation* {_CITED}", "name_translation": f"LANG! {_PIECES}",
    "event": f"AGE=phrased {_DETAIL}", "fact": f"AGE=phrased {_DETAIL}", "named": f"AGE=phrased {_DETAIL.replace('TYPE', 'TYPE!')}", "birth": f"AGE=phrased FAMC=to_family {_DETAIL}", "adoption": f"AGE=phrased FAMC=adopting {_DETAIL}", "adopting": "ADOP=phrased",
    "union": f"HUSB=spouse WIFE=spouse {_DETAIL}", "union_fact": f"HUSB=spouse WIFE=spouse {_DETAIL}", "union_named": f"HUSB=spouse WIFE=spouse {_DETAIL.replace('TYPE', 'TYPE!')}", "spouse": "AGE=phrased!",
    "to_spouse": "PHRASE", "to_child": "PHRASE", "to_alias": "PHRASE", "to_parents": f"PEDI=phrased STAT=phrased {_NOTES}", "to_union": _NOTES, "associate": f"PHRASE ROLE=phrased! {_CITED}", "NO": f"DATE=phrased {_CITED}",
    "phrased": "PHRASE", "dated": "TIME PHRASE", "timed": "TIME", "place": f"FORM LANG TRAN=place_translation* MAP EXID=kinded* {_NOTES}", "place_translation": "LANG!", "MAP": "LATI! LONG!", "ADDR": "ADR1 ADR2 ADR3 CITY STAE POST CTRY",
    "kinded": "TYPE", "changed": f"DATE=timed! {_NOTES}", "made": "DATE=timed!", "NOTE": "MIME LANG TRAN=translation* SOUR=citation*", "translation": "MIME LANG",
    "citation": f"PAGE DATA=cited EVEN=cited_event QUAY OBJE=to_media* {_NOTES}", "cited": "DATE=dated TEXT=typed_text*", "typed_text": "MIME LANG", "cited_event": "PHRASE ROLE=phrased",
    "to_media": "CROP TITL", "CROP": "TOP LEFT HEIGHT WIDTH", "to_store": f"{_NOTES} CALN*", "CALN": "MEDI=phrased", "ordinance": _ORDINANCE, "child_ordinance": f"{_ORDINANCE} FAMC=to_family!", "ordinance_state": "DATE=timed!",
}
# Types without a value, with ``Y`` or none, and with a pointer to a kind of record (fixed values of the standard); all others hold text.
NO_VALUE = ("HEAD", "GEDC", "SCHMA", "family", "person", "media", "store", "source", "sender", "trailer", "MAP", "CROP", "changed", "made", "spouse", "source_data", "cited", "ordinance", "child_ordinance")
YES_OR_NONE = ("event", "birth", "adoption", "union")
POINTS_AT = {
    "to_note": "SNOTE", "citation": "SOUR", "to_media": "OBJE", "to_sender": "SUBM", "to_spouse": "INDI", "to_child": "INDI", "associate": "INDI", "to_alias": "INDI",
    "to_parents": "FAM", "to_union": "FAM", "to_family": "FAM", "adopting": "FAM", "to_store": "REPO",
}
#: Parts over which the lines of one tag, or without a pointer, are dealt in a join.
SPREAD = 64
#: Events and facts that hold no text of their own, so it moves into a note, and the values of SEX (fixed values of the standard).
WITHOUT_TEXT = ("ADOP", "BIRT", "CHR", *_EVENTS, *_UNIONS)
SEXES = ("M", "F", "X", "U")
VOID = "@VOID@"
_LEAST = {"!": 1, "+": 1}


def _rules() -> dict[str, dict[str, tuple[str, str]]]:
    """type -> tag -> (type of the tag there, sign of its number)."""
    out: dict[str, dict[str, tuple[str, str]]] = {}
    for kind, text in GRAMMAR.items():
        for entry in text.split():
            sign = entry[-1] if entry[-1] in "*!+" else ""
            tag, _, below = entry.rstrip("*!+").partition("=")
            out.setdefault(kind, {})[tag] = (below or tag, sign)
    return out


RULES = _rules()


def _map(pairs: dict[str, str]) -> Column:
    """A fixed map of words as one literal, which plans handle faster than one of many columns."""
    return F.str_to_map(F.lit(",".join(f"{k}:{v}" for k, v in pairs.items())), F.lit(","), F.lit(":"))


def _entry(kind: Column, tag: Column) -> Column:
    return F.concat(kind, F.lit(" "), tag)


_BELOW = {f"{kind} {tag}": below for kind, rows in RULES.items() for tag, (below, _) in rows.items()}
_ONCE = {f"{kind} {tag}": tag for kind, rows in RULES.items() for tag, (_, sign) in rows.items() if sign in ("", "!")}
_NEEDED = {kind: " ".join(t for t, (_, sign) in rows.items() if sign in _LEAST) for kind, rows in RULES.items() if kind != "file"}
_MEETS = {f"{kind} {tag}": tag for kind, tags in _NEEDED.items() for tag in tags.split()}


def typed_lines(records: DataFrame) -> DataFrame:
    """``source, seq, n, level, xref, tag, value, type, up, up_type, up_path, path, jumps`` of every line of ``source, seq, xref, typ, raw``; ``up`` is the number of the line above.

    ``path`` names the tags down to the line, the record with its id. Records travel whole and are cut into lines where they arrive.
    """
    cut = lambda rows: record_lines(rows).where(~F.col("tag").eqNullSafe(F.lit("CONT"))).withColumn("tag", F.coalesce("tag", F.lit("")))
    lines = cut(records.repartition("source", "seq"))
    deepest = 0
    for level in sorted(r[0] for r in cut(records).where("level IS NOT NULL").select("level").distinct().collect()):  # as many as levels
        if level > deepest + 1:
            break  # no line of these levels has a line above it
        deepest = level
    before = Window.partitionBy("source", "seq").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    table = _map(_BELOW)
    below = lambda kind: F.try_element_at(table, _entry(kind, F.col("tag")))
    at = lambda level: F.col("level") == level
    last = lambda cond, value: F.last(F.when(cond, value), ignorenulls=True).over(before)
    none = F.lit(None).cast("string")
    out = lines.withColumn("type", F.when(at(0), below(F.lit("file"))).otherwise(none)).withColumn("path", F.when(at(0), F.concat_ws(" ", "tag", "xref")).otherwise(none))
    out = out.withColumn("up", F.lit(None).cast("int")).withColumn("up_type", F.when(at(0), F.lit("file")).otherwise(none)).withColumn("up_path", none)
    for level in range(1, deepest + 1):
        above = last(at(level - 1), F.struct("n", "type", "path"))
        found = out.withColumn("_up", F.when(at(level), F.when(above["n"] == last(F.col("level") < level, F.col("n")), above)))
        here = at(level) & F.col("_up").isNotNull()
        out = (
            found.withColumn("up", F.when(here, F.col("_up.n")).otherwise(F.col("up"))).withColumn("up_type", F.when(here, F.col("_up.type")).otherwise(F.col("up_type"))).withColumn("up_path", F.when(here, F.col("_up.path")).otherwise(F.col("up_path")))
            .withColumn("type", F.when(here, below(F.col("_up.type"))).otherwise(F.col("type"))).withColumn("path", F.when(here, F.concat_ws(" > ", "_up.path", "tag")).otherwise(F.col("path"))).drop("_up")
        )
    jumps = (F.col("level") > 0) & F.col("up").isNull()
    return out.withColumn("jumps", F.coalesce(jumps, F.lit(False))).withColumn("path", F.coalesce("path", F.col("tag")))


def extension_tags(records: DataFrame) -> DataFrame:
    """``tag``: every extension tag that the records hold."""
    return record_lines(records).where(F.col("tag").startswith("_")).select("tag").distinct()


def findings(records: DataFrame) -> DataFrame:
    """``source, seq, n, cause, path`` of everything in ``records (source, seq, xref, typ, raw)`` that the standard does not allow.

    The records are read several times. The lines are gone through once and leave notes: findings, and what must be looked up elsewhere in the file. Only
    notes are written and joined; a line that needs neither leaves none.
    """
    tag, kind, value = F.col("tag"), F.col("type"), F.coalesce("value", F.lit(""))
    # The second of equal tags below a line stands for all of them; a parted window needs no further shuffle, the records lie together.
    place = F.when(F.col("up").isNotNull(), F.row_number().over(Window.partitionBy("source", "seq", "up", "tag").orderBy("n")))
    lines = typed_lines(records).withColumn("_place", place)
    pointer = F.when(value.rlike(r"^@[^@\s]+@$") & (value != VOID), value)
    points_at = F.try_element_at(_map(POINTS_AT), kind)
    is_pointer = value.rlike(r"^@[^@\s]+@$")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    own = tag.startswith("_")
    causes = F.array(
        F.when(F.col("level").isNull() & (F.col("n") >= 0), say("not a line")),
        F.when(F.col("jumps"), say("level jumps")),
        F.when(F.col("xref").isNotNull() & (F.col("level") > 0), say("id below a record")),
        F.when(~own & F.col("level").isNotNull() & kind.isNull() & F.col("up_type").isNotNull(), say(tag, " has no place here")),
        F.when(kind.isin(*NO_VALUE) & (value != ""), say(tag, " has a value and may have none")),
        F.when(kind.isin(*YES_OR_NONE) & ~value.isin("", "Y"), say(tag, " has text; only Y or nothing is allowed")),
        F.when(points_at.isNotNull() & ~is_pointer, say(tag, " needs a pointer")),
        F.when(kind.isNotNull() & points_at.isNull() & is_pointer, say(tag, " has a pointer and needs text")),
    )
    none = F.lit(None).cast("string")
    entry = _entry(F.col("up_type"), tag)

    def note(what: str, cond: Column, n: Column | str = "n", cause: Column = none, path: Column | str = "path", key: Column = none, to: Column = none) -> Column:
        named = {"n": n, "cause": cause, "path": path, "key": key, "to": to}
        return F.when(cond, F.struct(F.lit(what).alias("what"), *[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in named.items()]))

    told = F.concat(F.transform(F.array_compact(causes), lambda c: F.struct(F.lit("found").alias("what"), F.col("n"), c.alias("cause"), F.col("path"), none.alias("key"), none.alias("to"))), F.array_compact(F.array(
        note("found", (F.col("_place") == 2) & F.try_element_at(_map(_ONCE), entry).isNotNull(), "up", say("more than one ", tag), "up_path"),
        note("declared", kind == "declaration", path=none, key=F.substring_index("value", " ", 1)),
        note("own", own, cause=say("extension tag ", tag, " is not declared in HEAD.SCHMA"), key=tag),
        note("points", pointer.isNotNull(), cause=say(tag, " points at a record of another kind"), key=pointer, to=points_at),
        note("needs", F.try_element_at(_map({k: v for k, v in _NEEDED.items() if v}), kind).isNotNull(), key=kind),
        note("has", (F.col("_place") == 1) & F.try_element_at(_map(_MEETS), entry).isNotNull(), "up", path=none, key=tag),
    )))
    notes = written(lines.select("source", "seq", F.explode(told).alias("_note")).select("source", "seq", "_note.*"))
    of = lambda what, *columns: notes.where(F.col("what") == what).select("source", *columns)
    finding = ("seq", "n", "cause", "path")
    single = of("found", *finding)
    # A file has few extension tags: their lines are dealt over parts, or one task would join those of a tag.
    declared = of("declared", "key").distinct().withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    strange = of("own", *finding, "key").withColumn("_part", F.pmod(F.hash("seq", "n"), F.lit(SPREAD))).join(declared, ["source", "key", "_part"], "left_anti").select("source", *finding)
    targets = records.where(F.col("xref").isNotNull()).groupBy("source", F.col("xref").alias("key")).agg(F.min("typ").alias("_typ"), F.lit(True).alias("_there"))
    missed = F.when(F.col("_there").isNull(), say("pointer without a record")).when(F.col("_typ") != F.col("to"), F.col("cause"))
    dead = of("points", *finding, "key", "to").join(targets, ["source", "key"], "left").withColumn("cause", missed).where(F.col("cause").isNotNull()).select("source", *finding)
    needed = of("needs", "seq", "n", "path", "key").withColumn("key", F.explode(F.split(F.try_element_at(_map({k: v for k, v in _NEEDED.items() if v}), F.col("key")), " ")))
    lacks = needed.join(of("has", "seq", "n", "key"), ["source", "seq", "n", "key"], "left_anti").select("source", "seq", "n", say(F.col("key"), " is missing").alias("cause"), "path")
    # The file: one id a record, the head first, the trailer last.
    doubled = records.where(F.col("xref").isNotNull()).groupBy("source", "xref").agg(F.count("*").alias("times"), F.max("seq").alias("seq")).where("times > 1")
    ids = doubled.select("source", "seq", F.lit(0).alias("n"), say("id of two records").alias("cause"), F.col("xref").alias("path"))
    ends = records.groupBy("source").agg(F.min(F.struct("seq", "typ")).alias("first"), F.max(F.struct("seq", "typ")).alias("last"), F.count_if(F.col("typ") == "HEAD").alias("heads"), F.count_if(F.col("typ") == "TRLR").alias("trailers"))
    wrong = F.array_compact(F.array(
        F.when(~F.col("first.typ").eqNullSafe(F.lit("HEAD")), say("the file does not start with HEAD")), F.when(~F.col("last.typ").eqNullSafe(F.lit("TRLR")), say("the file does not end with TRLR")),
        F.when(F.col("heads") > 1, say("more than one HEAD")), F.when(F.col("trailers") > 1, say("more than one TRLR")),
    ))
    whole = ends.select("source", F.col("last.seq").alias("seq"), F.lit(0).alias("n"), F.explode(wrong).alias("cause"), F.lit("").alias("path"))
    return single.unionByName(strange).unionByName(dead).unionByName(lacks).unionByName(ids).unionByName(whole)


def validate(records: DataFrame) -> DataFrame:
    """``source, cause, n, example``: the findings by cause with the path of the first."""
    return findings(records).groupBy("source", "cause").agg(F.count("*").alias("n"), F.min_by("path", F.struct("seq", "n")).alias("example"))


# Export ------------------------------------------------------------------------------------------


def _text(level: int, tag: Column | str, value: Column) -> Column:
    """Lines of a value of any length: line ends become ``CONT`` lines, a leading at sign is doubled; none where it is null or empty."""
    tag = F.lit(tag) if isinstance(tag, str) else tag
    line = lambda x, i: F.rtrim(F.concat_ws(" ", F.when(i == 0, F.lit(str(level))).otherwise(F.lit(str(level + 1))), F.when(i == 0, tag).otherwise(F.lit("CONT")), F.when(x.startswith("@"), F.concat(F.lit("@"), x)).otherwise(x)))
    return let(value, lambda v: F.when(F.coalesce(v, F.lit("")) != "", F.transform(F.split(v, r"\r\n|\r|\n"), line)).otherwise(_no_lines()))


def _date(value: Column) -> Column:
    """A date line; what is no date stands as a phrase below an empty one."""
    def lines(d: Column) -> Column:
        phrase = F.concat(F.array(F.lit("2 DATE")), _text(3, "PHRASE", F.substring(d, F.lit(2), F.length(d) - 2)))
        return F.when(d == "", _no_lines()).when(d.startswith("(") & d.endswith(")"), phrase).otherwise(F.array(F.concat(F.lit("2 DATE "), d)))

    return let(to_record_date(value), lines)


def _fact_lines(attributes: DataFrame, owner: str) -> DataFrame:
    tag, value = F.col("tag"), F.col("value")
    own = attributes.where(~tag.contains(".") & ~tag.isin(*AT_NAME))
    bare = F.array(F.concat(F.lit("1 "), tag))
    lines = (
        F.when(tag.isin(*AS_PLACE), F.concat(bare, _text(2, "PLAC", value))).when(tag.isin(*WITHOUT_TEXT), F.concat(bare, _text(2, "NOTE", value)))
        .when(F.coalesce(value, F.lit("")) == "", bare).otherwise(_text(1, tag, value))
    )
    return _lines(own, owner, ["sort", "tag", "id"], lines, "has")


def _event_lines(events: DataFrame, attributes: DataFrame, owner: str) -> DataFrame:
    named = attributes.where(F.col("tag").contains(".") & F.col(owner).isNotNull())
    line = F.when(F.coalesce("value", F.lit("")) == "", F.array(F.concat(F.lit("2 "), F.substring_index("tag", ".", -1)))).otherwise(_text(2, F.substring_index("tag", ".", -1), F.col("value")))
    below = named.select(F.col(owner).alias("_a_owner"), F.substring_index("tag", ".", 1).alias("_a_kind"), "id", line.alias("_a_lines"))
    below = below.groupBy("_a_owner", "_a_kind").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("id", "_a_lines"))), lambda x: x["_a_lines"])).alias("_below"))
    e = events.where(F.col(owner).isNotNull()).join(below, (F.col(owner) == F.col("_a_owner")) & (F.col("kind") == F.col("_a_kind")), "left")
    bare = F.array(F.concat(F.lit("1 "), F.col("kind")))
    silent = F.col("kind").isin(*WITHOUT_TEXT)
    head = F.when(silent | (F.coalesce("value", F.lit("")) == ""), bare).otherwise(_text(1, F.col("kind"), F.col("value")))
    whole = F.concat(head, F.when(silent, _text(2, "NOTE", F.col("value"))).otherwise(_no_lines()), _date(F.col("date")), _text(2, "PLAC", F.col("place")), _text(2, "NOTE", F.col("page")), F.coalesce("_below", _no_lines()))
    # A person's trade in the words of the book has a tag of its own; one that is not named gives no line.
    lines = F.when(F.col("kind") == "OCCU", _text(1, "_BERUF_KB", F.col("value"))).otherwise(whole) if owner == "person" else whole
    return _lines(e, owner, ["id"], lines, "happened")


def export7(persons: DataFrame, families: DataFrame, children: DataFrame, forms: DataFrame, events: DataFrame, attributes: DataFrame, note: str | None = None, schema: str = "https://example.org/tags/") -> DataFrame:
    """``part, seq, xref, typ, raw`` of a file made of the tables (see ``record_writers``); the file is in order of part and seq.

    The head declares the extension tags that the records hold, each at ``schema`` and its name in lower case. Sexes that the standard does not know give no line.
    """
    xrefs = families.where(F.col("xref").isNotNull())
    people = persons.where(F.col("xref").isNotNull())
    pointers = lambda rows, tag, name: rows.groupBy(F.col("person").alias("_owner")).agg(F.transform(F.array_sort(F.collect_set("xref")), lambda x: F.concat(F.lit(f"1 {tag} "), x)).alias(name))
    as_child = pointers(children.join(xrefs.select(F.col("id").alias("family"), "xref"), "family"), "FAMC", "as_child")
    as_spouse = pointers(xrefs.select("xref", F.explode(F.array("husband", "wife")).alias("person")).where(F.col("person").isNotNull()), "FAMS", "as_spouse")
    form = lambda kind, tag, name: _lines(forms.where(F.col("kind") == kind), "person", ["value"], _text(2, tag, F.col("value")), name)
    surname = F.when(F.coalesce("surn", F.lit("")) != "", F.concat(F.lit("/"), F.col("surn"), F.lit("/")))
    full = F.concat_ws(" ", F.nullif(F.coalesce("givn", F.lit("")), F.lit("")), surname)
    heads = people.select("id", "xref", F.when(full != "", full).otherwise(F.coalesce("name", F.lit(""))).alias("full"), "givn", "surn", F.when(F.col("sex").isin(*SEXES), F.col("sex")).alias("sex"))
    p = _joined(heads, book=form("kb", "_KB_NAME", "book"), call=form("rufname", "_RUFNAME", "call"), happened=_event_lines(events, attributes, "person"), has=_fact_lines(attributes, "person"), as_child=as_child, as_spouse=as_spouse)
    name = F.when(F.col("full") == "", F.array(F.lit("1 NAME"))).otherwise(_text(1, "NAME", F.col("full")))
    first = lambda tag: F.array(F.concat_ws(" ", F.lit("0"), "xref", F.lit(tag)))
    p_raw = _record(first("INDI"), name, _text(2, "GIVN", F.col("givn")), _text(2, "SURN", F.col("surn")), "book", "call", _line(1, "SEX", F.col("sex")), "happened", "has", "as_child", "as_spouse")
    known = people.select(F.col("id").alias("_p"), F.col("xref").alias("_x"))
    member = lambda df, column, to: df.join(known.select(F.col("_p").alias(f"_{to}"), F.col("_x").alias(to)), F.col(column) == F.col(f"_{to}"), "left").drop(f"_{to}")
    f = member(member(xrefs.select("id", "xref", "husband", "wife"), "husband", "h"), "wife", "w")
    kids = _lines(children.join(known, F.col("person") == F.col("_p")), "family", ["person"], _line(1, "CHIL", F.col("_x")), "kids")
    f = _joined(f, kids=kids, happened=_event_lines(events, attributes, "family"), has=_fact_lines(attributes, "family"))
    f_raw = _record(first("FAM"), _line(1, "HUSB", F.col("h")), _line(1, "WIFE", F.col("w")), "kids", "happened", "has")
    made = p.select(F.lit(1).alias("part"), F.col("id").cast("bigint").alias("seq"), "xref", F.lit("INDI").alias("typ"), p_raw.alias("raw")).unionByName(
        f.select(F.lit(2).alias("part"), F.col("id").cast("bigint").alias("seq"), "xref", F.lit("FAM").alias("typ"), f_raw.alias("raw"))
    )
    body = written(made)  # read once for the tags and once for the file
    tags = written(extension_tags(body.withColumn("source", F.lit(""))).agg(F.array_sort(F.collect_list("tag")).alias("tags")))  # one row: as many tags as the writers know
    declared = F.when(F.size("tags") > 0, F.concat(F.array(F.lit("1 SCHMA")), F.transform("tags", lambda t: F.concat(F.lit("2 TAG "), t, F.lit(f" {schema}"), F.lower(t))))).otherwise(_no_lines())
    top = F.concat(F.array(F.lit("0 HEAD"), F.lit("1 GEDC"), F.lit("2 VERS 7.0")), declared, F.array(F.lit("1 SOUR kinloom"), F.lit("2 NAME kinloom")), _text(1, "NOTE", F.lit(note).cast("string")))
    none = F.lit(None).cast("string")
    end = lambda df, part, typ, raw: df.select(F.lit(part).alias("part"), F.lit(0).cast("bigint").alias("seq"), none.alias("xref"), F.lit(typ).alias("typ"), raw.alias("raw"))
    return end(tags, 0, "HEAD", F.array_join(top, "\n")).unionByName(body).unionByName(end(tags, 3, "TRLR", F.lit("0 TRLR")))
