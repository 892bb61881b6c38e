"""Partial dates as Column expressions: ``struct<y int, m int, d int>`` with nulls for unknown parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
#: Month names in registers (fixed values).
MONTH_NAMES = (
    ("jan", "januar", "jenner", "jänner"),
    ("feb", "februar", "hornung"),
    ("mar", "mär", "maerz", "märz", "merz"),
    ("apr", "april"),
    ("mai", "may"),
    ("jun", "juni", "junius", "brachmonat"),
    ("jul", "juli", "julius", "heumonat"),
    ("aug", "august"),
    ("sep", "sept", "september", "herbstmonat"),
    ("okt", "oct", "oktober", "october", "weinmonat"),
    ("nov", "november", "wintermonat"),
    ("dez", "dec", "dezember", "december", "christmonat"),
)
#: Months counted from March (fixed values).
COUNTED = (("7", 9), ("8", 10), ("9", 11), ("10", 12), ("x", 12), ("xa", 12))


def _lookup(c: Column, pairs) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in pairs for x in kv]), c)


def month_number(name: Column) -> Column:
    """Month of a register's month name, whole or by its first three letters."""
    pairs = [(n, i + 1) for i, names in enumerate(MONTH_NAMES) for n in names]
    low = F.lower(name)
    return F.coalesce(_lookup(low, pairs), _lookup(F.substring(low, 1, 3), pairs))


def _part(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit("")).try_cast("int")


def date_struct(y: Column, m: Column, d: Column) -> Column:
    return F.struct(y.cast("int").alias("y"), m.cast("int").alias("m"), d.cast("int").alias("d"))


def year_in(c: Column) -> Column:
    """First year from 1500 to 2099 that stands alone."""
    years = F.transform(F.regexp_extract_all(c, F.lit(r"\w+"), F.lit(0)), lambda w: _number(w, 4, 4))
    return F.get(F.filter(years, lambda y: y.between(1500, 2099)), F.lit(0))


def _tokens(c: Column) -> Column:
    """Numbers, words and other signs of a text in order; white space only separates."""
    return F.regexp_extract_all(c, F.lit(r"\d+|\p{L}+|[^\s\d\p{L}]"), F.lit(0))


def _number(token: Column, least: int, most: int) -> Column:
    """A token of ``least`` to ``most`` digits as a number, else null."""
    return F.when(token.rlike(r"^\d+$") & F.length(token).between(least, most), token.try_cast("int"))


def _without(tokens: Column, place: int, *signs: str) -> Column:
    """The tokens without the one at ``place`` if it is one of ``signs``."""
    rest = F.concat(F.slice(tokens, 1, place), F.slice(tokens, F.lit(place + 2), F.greatest(F.size(tokens) - place - 1, F.lit(0))))
    return F.when(F.lower(F.get(tokens, F.lit(place))).isin(*signs), rest).otherwise(tokens)


def parse_date(c: Column) -> Column:
    """``23 FEB 1778``, ``23.02.1778``, ``9. Januar 1808``, ``FEB 1778`` or a year; null without a year.

    The date is read from its tokens: a day of up to two digits, a month as number between two points or as a word with
    a point before or after it, and a year of four digits. Anything else gives its first year that stands alone.
    """
    at = lambda a, k: F.get(a, F.lit(k))
    short = [(m, i + 1) for i, m in enumerate(MONTHS)]

    def read(x: Column) -> Column:
        s, t = x["s"], x["t"]
        dotted = (F.size(t) == 5) & (at(t, 1) == ".") & (at(t, 3) == ".")
        dot_month = _number(at(t, 2), 1, 2)
        by_number = F.when(dotted & dot_month.between(1, 12) & _number(at(t, 0), 1, 2).isNotNull() & _number(at(t, 4), 4, 4).isNotNull(), date_struct(_number(at(t, 4), 4, 4), dot_month, _number(at(t, 0), 1, 2)))

        def by_word(bare: Column) -> Column:
            month = F.coalesce(F.when(~s.contains("."), _lookup(F.upper(at(bare, 1)), short)), month_number(at(bare, 1)))
            whole = (F.size(bare) == 3) & month.isNotNull() & _number(at(bare, 0), 1, 2).isNotNull() & _number(at(bare, 2), 4, 4).isNotNull()
            return F.when(whole, date_struct(_number(at(bare, 2), 4, 4), month, _number(at(bare, 0), 1, 2)))

        month_first = _lookup(F.upper(at(t, 0)), short)
        by_month = F.when((F.size(t) == 2) & month_first.isNotNull() & s.rlike(r"\s") & _number(at(t, 1), 4, 4).isNotNull(), date_struct(_number(at(t, 1), 4, 4), month_first, F.lit(None)))
        by_year = let(year_in(s), lambda y: F.when(y.isNotNull(), date_struct(y, F.lit(None), F.lit(None))))
        return F.coalesce(by_number, let(let(_without(t, 1, "."), lambda b: _without(b, 2, ".")), by_word), by_month, by_year)

    text = F.trim(F.coalesce(c, F.lit("")))
    return let(F.struct(text.alias("s"), _tokens(text).alias("t")), read)


def record_date(y: Column, m: Column, d: Column) -> Column:
    """``16 FEB 1808``, ``FEB 1808`` or ``1808``."""
    name = F.element_at(F.array(*[F.lit(x) for x in MONTHS]), m)
    return F.when(m.isNotNull() & d.isNotNull(), F.concat_ws(" ", d.cast("string"), name, y.cast("string"))).when(m.isNotNull(), F.concat_ws(" ", name, y.cast("string"))).otherwise(y.cast("string"))


#: Words before a date in record form, and between its two ends (fixed values of the format).
QUALIFIERS = ("ABT", "CAL", "EST", "BEF", "AFT", "BET", "FROM", "TO")
BETWEEN = ("AND", "TO")
#: What may stand after the number of a day (fixed values).
DAY_ENDINGS = (".", "ten", "sten", "te")


def _in_record_form(d: Column) -> Column:
    """Whether a text is a date in record form: an optional qualifier, then one or two of ``[day] [month] year``."""
    words = F.split(d, " ")
    body = F.when(F.get(words, F.lit(0)).isin(*QUALIFIERS), F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), " ")).otherwise(d)
    ends = F.split(body, f" (?:{'|'.join(BETWEEN)}) ")

    def plain(end: Column) -> Column:
        w = F.split(end, " ")
        before = F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0)))
        day = lambda x: x.rlike(r"^\d{1,2}$")
        fits = (
            F.when(F.size(before) == 0, F.lit(True))
            .when(F.size(before) == 1, day(F.get(before, F.lit(0))) | F.get(before, F.lit(0)).isin(*MONTHS))
            .when(F.size(before) == 2, day(F.get(before, F.lit(0))) & F.get(before, F.lit(1)).isin(*MONTHS))
            .otherwise(F.lit(False))
        )
        return F.element_at(w, -1).rlike(r"^\d{3,4}$") & fits

    return (F.size(ends) <= 2) & F.forall(ends, plain)


def to_record_date(c: Column) -> Column:
    """A date in record form; what cannot be read without interpretation becomes a phrase in brackets."""
    at = lambda a, k: F.get(a, F.lit(k))
    whole = [(n, i + 1) for i, names in enumerate(MONTH_NAMES) for n in names]

    def read(x: Column) -> Column:
        d, t = x["d"], x["t"]
        dotted = (F.size(t) == 5) & (at(t, 1) == ".") & (at(t, 3) == ".")
        day, month, year = _number(at(t, 0), 1, 2), _number(at(t, 2), 1, 2), _number(at(t, 4), 4, 4)
        by_number = F.when(dotted & month.between(1, 12) & day.between(1, 31) & year.isNotNull(), record_date(year, month, day))

        def by_word(bare: Column) -> Column:
            day, month, year = _number(at(bare, 0), 1, 2), _lookup(F.lower(at(bare, 1)), whole), _number(at(bare, 2), 4, 4)
            german = (F.size(bare) == 3) & d.rlike(r"\s\p{L}+\.?\s+\d+$")
            return F.when(german & month.isNotNull() & day.between(1, 31) & year.isNotNull(), record_date(year, month, day))

        bare = let(let(_without(t, 0, "den"), lambda b: _without(b, 1, *DAY_ENDINGS)), lambda b: _without(b, 2, "."))
        phrase = F.when(d.startswith("(") & d.endswith(")"), d).otherwise(F.concat(F.lit("("), d, F.lit(")")))
        return F.when((d == "") | _in_record_form(d), d).otherwise(F.coalesce(by_number, let(bare, by_word), phrase))

    text = F.trim(F.coalesce(c, F.lit("")))
    return let(F.struct(text.alias("d"), _tokens(text).alias("t")), read)


#: Signs and words that say that a note speaks of a death; beginnings of words that say that it speaks of something else (fixed values).
DEATH_SIGNS = ("†", "✝")
DEATH_WORDS = ("gest", "gestorben", "starb", "verstorben", "obiit", "mortuus")
OTHER_EVENTS = ("copul", "getraut", "verheirat", "ehelich", "conf", "firm", "ausgewandert", "emigr", "legitim")
#: What follows the number of a month that is counted from March, and ordinal endings of a day (fixed values).
COUNT_ENDINGS = ("ber", "bris")
ORDINALS = ("ste", "te", "ten", "ter", "tes", "tem", "sten", "ster", "stes", "stem")


def death_note(note: Column, entry_year: Column) -> Column:
    """Date of death in a margin note, in record form; null unless the note speaks of a death and of nothing else.

    The note is read as tokens. The first day that is followed by a month decides; the month is a number between points,
    a number counted from March (``7ber``), or a name; numbers go before counted months, these before names. A missing year is the entry's.
    """
    get = lambda a, i: F.get(a, i)
    day = lambda x: _number(x, 1, 2)
    whole = [(n, i + 1) for i, names in enumerate(MONTH_NAMES) for n in names]

    def dated(y: Column, m: Column, d: Column) -> Column:
        return let(F.struct(y.alias("y"), m.alias("m"), d.alias("d")), lambda x: F.when(x["y"].isNotNull() & x["m"].isNotNull() & x["d"].isNotNull(), record_date(x["y"], x["m"], x["d"])))

    def read(x: Column) -> Column:
        low, no_points = x["low"], x["words"]

        def by_number(i: Column) -> Column:
            points = (get(low, i + 1) == ".") & (get(low, i + 3) == ".")
            month, year = day(get(low, i + 2)), _number(get(low, i + 4), 2, 4)
            return F.when(points, dated(F.when(year < 100, year + 1800).otherwise(year), F.when(month.between(1, 12), month), day(get(low, i))))

        def by_count(i: Column) -> Column:
            number, ending = get(no_points, i + 1), get(no_points, i + 2)
            joined = F.regexp_extract(number, rf"^(xa?)(?:{'|'.join(COUNT_ENDINGS)})$", 1)
            apart = ending.isin(*COUNT_ENDINGS)
            month = _lookup(F.when(joined != "", joined).when(apart, number), COUNTED)
            year = _number(F.when(joined != "", ending).otherwise(get(no_points, i + 3)), 4, 4)
            return dated(F.coalesce(year, entry_year), month, day(get(no_points, i)))

        def by_name(i: Column) -> Column:
            def named(at: Column) -> Column:
                name = get(no_points, at)
                return dated(F.coalesce(_number(get(no_points, at + 1), 4, 4), entry_year), _lookup(name, whole), day(get(no_points, i)))

            return let(i + 1 + F.coalesce(get(no_points, i + 1).isin(*ORDINALS), F.lit(False)).cast("int"), named)

        first = lambda read: F.get(F.array_compact(F.transform(F.sequence(F.lit(0), F.greatest(F.size(low) - 1, F.lit(0))), read)), F.lit(0))
        says_death = F.exists(low, lambda w: w.isin(*DEATH_SIGNS, *DEATH_WORDS)) | x["t"].startswith("+")
        says_other = F.exists(low, lambda w: w.rlike("^(?:" + "|".join(OTHER_EVENTS) + ")"))
        return F.when((x["t"] != "") & says_death & ~says_other, F.coalesce(first(by_number), first(by_count), first(by_name), year_in(x["t"]).cast("string")))

    text = F.trim(F.coalesce(note, F.lit("")))
    parts = F.transform(_tokens(text), F.lower)
    return let(let(F.struct(text.alias("t"), parts.alias("low")), lambda x: F.struct(x["t"].alias("t"), x["low"].alias("low"), F.filter(x["low"], lambda w: w != ".").alias("words"))), read)


def birth_from_age(reference: Column, age: Column) -> Column:
    """struct(date, exact): the reference date struct minus an age phrase; exact only if days are named.

    Months are subtracted first, with the day held to 28 at most; then weeks and days.
    """
    units = ("jahr", "monat", "woche", "tag")
    full = reference["m"].isNotNull() & reference["d"].isNotNull()

    def read(said: Column) -> Column:
        """Each unit is searched for once; what it says is used several times."""
        years, months, weeks, days = (F.coalesce(said[u].try_cast("int"), F.lit(0)) for u in units)
        has = (said["jahr"] != "") | (said["monat"] != "") | (said["woche"] != "") | (said["tag"] != "")
        total = reference["y"] * 12 + reference["m"] - 1 - years * 12 - months
        base = let(total, lambda t: F.make_date(F.floor(t / 12).cast("int"), (F.pmod(t, F.lit(12)) + 1).cast("int"), F.least(reference["d"], F.lit(28))))
        to_day = let(F.date_sub(base, days + weeks * 7), lambda day: date_struct(F.year(day), F.month(day), F.dayofmonth(day)))
        dated = F.when(full, to_day).otherwise(date_struct(reference["y"] - years, F.lit(None), F.lit(None)))
        return F.when(has & reference.isNotNull(), F.struct(dated.alias("date"), (full & (said["tag"] != "")).alias("exact")))

    return let(F.struct(*[F.regexp_extract(age, rf"(?iu)(\d+)\s*{u}", 1).alias(u) for u in units]), read)


def stated_date(c: Column) -> Column:
    """The date that a text of the format states, whatever stands around it: ``ABT 1750`` and ``BET 3 MAY 1740 AND 1745`` give their first year.

    The year is the first number from 1000 to 2099 that stands alone, the month the first of ``MONTHS`` that does. The first number of the
    text is the day if it has one or two digits, ends its word, and a word of letters follows. Null without a year.
    """
    years = lambda words: F.filter(F.transform(words, lambda w: _number(w, 4, 4)), lambda y: y.between(1000, 2099))

    def day(parts: Column) -> Column:
        numbered = F.filter(F.arrays_zip(parts.alias("a"), F.slice(parts, F.lit(2), F.size(parts)).alias("b")), lambda p: p["a"].rlike(r"\d"))
        return let(F.get(numbered, F.lit(0)), lambda p: F.when(p["b"].rlike("^[A-Z]{3}"), _part(p["a"], r"^\D*(\d\d?)$", 1)))

    def read(text: Column) -> Column:
        words = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
        month = F.get(F.filter(words, lambda w: w.isin(*MONTHS)), F.lit(0))
        year = F.get(years(words), F.lit(0))
        return F.when(year.isNotNull(), date_struct(year, _lookup(month, [(m, i + 1) for i, m in enumerate(MONTHS)]), day(F.split(F.trim(text), r"\s+"))))

    return let(F.upper(F.coalesce(c, F.lit(""))), read)


def ordinal(date: Column) -> Column:
    """Day number of a full, valid date."""
    text = F.format_string("%04d-%02d-%02d", date["y"], date["m"], date["d"])
    return F.unix_date(F.try_to_date(F.when(date["m"].isNotNull() & date["d"].isNotNull(), text), "yyyy-MM-dd"))


def pseudo_ordinal(iso: Column) -> Column:
    """Day number of an ISO string with months of 31 and years of 372 days."""
    return _part(iso, r"^(\d{4})-(\d{2})-(\d{2})", 1) * 372 + _part(iso, r"^(\d{4})-(\d{2})-(\d{2})", 2) * 31 + _part(iso, r"^(\d{4})-(\d{2})-(\d{2})", 3)


def earlier(a: Column, b: Column) -> Column:
    """Whether a lies before b at the precision that both have."""
    month, day = a["m"].isNotNull() & b["m"].isNotNull(), a["d"].isNotNull() & b["d"].isNotNull()
    return F.when(a["y"] != b["y"], a["y"] < b["y"]).when(month & (a["m"] != b["m"]), a["m"] < b["m"]).otherwise(F.when(month & day, a["d"] < b["d"]).otherwise(F.lit(False)))


def months_between(a: Column, b: Column) -> Column:
    return (b["y"] * 12 + F.coalesce(b["m"], F.lit(1))) - (a["y"] * 12 + F.coalesce(a["m"], F.lit(1)))
