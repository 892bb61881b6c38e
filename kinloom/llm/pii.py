"""Sanitising personal data by information content (operator 1).

Patterns find the protected entities (e-mail, IP, card and phone numbers). The corpus then says which
other terms reveal them. Protected are the exact values and the classes that recur where values do not (``_protected``:
kind, e-mail domain, IP network, card issuer, phone area). Each occurrence of c has a window of ``CONTEXT`` terms
centred on it; over the occurrences of all terms, p(t) is the share of term t, p(c) the share that lies in a window of c (in
overlapping windows once), p(c, t) the share of both. A term discloses c if its pointwise
mutual information log(p(c,t) / p(c)p(t)) reaches ``DISCLOSURE`` times the information -log p(c) of
c itself. Statistical floor: at least ``SUPPORT`` windows that do not all lie in copies of one text, and more than
chance gives, p(c)^windows <= ``CHANCE`` / occurrences of all terms. A disclosing term is
generalised to its ``GENERAL``-letter prefix where that prefix, counted over all its terms, no longer discloses; otherwise it is
removed. Windows bound the work: an entity gives at most ``CONTEXT`` pairs for its value and each of its classes.

All counts cover all documents: one pass emits partial counts per task, Spark sums them. The set of
disclosing terms is sent to the tasks if it has at most ``BROADCAST_TERMS`` rows; beyond that the
terms of each text are joined with it.

Defined results: null text is empty, empty text has no spans, rows with equal ids or texts are
separate rows with results of their own, very long texts are read whole, an empty table gives no rows, other columns pass
through ``sanitise`` whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, read, text_of

CONTEXT, SUPPORT, DISCLOSURE, GENERAL = 50, 3, 0.98, 3
CHANCE = 0.05
BROADCAST_TERMS = 100_000
KINDS = ("email", "ip", "card", "phone", "term")
#: Partial counts that a task holds before it emits them.
_HELD = 300_000

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W_]+")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, int]  # start, place in KINDS, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, in linear time: the part before @ is the run of its characters that ends there."""
    done = seen = 0
    for m in _DOMAIN.finditer(text):
        left = text[max(done, seen) : m.start()]
        run = len(left) - len(left.rstrip(_LOCAL))
        # The run may reach back over a failed earlier @ only to the character after it.
        seen = m.start() + 1
        if run:
            done = m.end()
            yield m.start() - run, m.end()


def base_spans(text: str) -> list[Span]:
    """All spans of the patterns in the whole text, sorted."""
    found: list[Span] = []
    if "@" in text:
        found += [(a, 0, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def _terms(text: str, spans: list[Span]) -> list[tuple[int, int, str]]:
    """(start, end, lower-cased term) of the terms outside the spans."""
    out, k, reach = [], 0, -1
    for m in _TERM.finditer(text):
        while k < len(spans) and spans[k][0] < m.end():
            reach = max(reach, spans[k][2])
            k += 1
        if m.start() >= reach:
            out.append((m.start(), m.end(), m[0].lower()))
    return out


def _protected(kind: int, value: str) -> Iterator[str]:
    """The exact value and the classes it belongs to."""
    yield value
    yield f"kind:{KINDS[kind]}"
    digits = "".join(_DIGIT.findall(value))
    yield ("domain:" + value.rpartition("@")[2], "net:" + ".".join(value.split(".")[:2]), "issuer:" + digits[:6], "area:" + digits[:4])[kind]


def _near(terms: list[tuple[int, int, str]], spans: list[Span], text: str) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Every protected value or class of a text with the windows (ranges of ``terms``) centred on its occurrences, in order."""
    starts = [a for a, _, _ in terms]
    windows: dict[str, list[tuple[int, int]]] = {}
    for a, kind, b in spans:
        at = bisect_left(starts, a)
        for c in _protected(kind, text[a:b].lower()):
            windows.setdefault(c, []).append((max(at - CONTEXT // 2, 0), min(at + CONTEXT // 2, len(terms))))
    yield from windows.items()


def _counts(texts: Iterator[str], held: int = _HELD) -> Iterator[dict]:
    """Partial counts: ('', '') occurrences of all terms, ('', t) of t, (c, '') of all in windows of c, (c, t) of t in windows of c; ``s`` counts the windows, lo and hi are the range of the hashes of their texts."""
    plain: Counter = Counter()
    pairs: dict[tuple[str, str], list[int]] = {}

    def flush() -> Iterator[dict]:
        yield from ({"entity": "", "term": t, "n": n, "s": 0, "lo": 0, "hi": 0} for t, n in plain.items())
        yield from ({"entity": c, "term": t, "n": v[0], "s": v[1], "lo": v[2], "hi": v[3]} for (c, t), v in pairs.items())
        plain.clear()
        pairs.clear()

    for text in texts:
        spans = base_spans(text)
        if not spans:
            words = _TERM.findall(text.lower())
        else:
            terms = _terms(text, spans)
            words = [t for _, _, t in terms]
            mark = xxhash.xxh64_intdigest(text) >> 1
            for c, windows in _near(terms, spans, text):
                reach = 0
                for lo, hi in windows:
                    once = Counter(words[max(lo, reach) : hi])
                    once[""] = sum(once.values())
                    for t in {*words[lo:hi], ""}:
                        v = pairs.setdefault((c, t), [0, 0, mark, mark])
                        v[0], v[1], v[2], v[3] = v[0] + once[t], v[1] + 1, min(v[2], mark), max(v[3], mark)
                    reach = hi
                    if len(pairs) > held:
                        yield from flush()
        plain.update(words)
        plain[""] += len(words)
        if len(plain) > held:
            yield from flush()
    yield from flush()


def corpus_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``entity, term, n, s, lo, hi`` over all documents; rows that cannot reach ``SUPPORT`` are left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("entity", pa.string()), ("term", pa.string()), *[(x, pa.int64()) for x in ("n", "s", "lo", "hi")]])
        rows: list[dict] = []
        for row in _counts(t.as_py() for b in batches for t in b.column(0)):
            rows.append(row)
            if len(rows) >= 20_000:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    partial = docs.select(text_of(text_col).alias("text")).mapInArrow(work, "entity string, term string, n bigint, s bigint, lo bigint, hi bigint")
    summed = partial.groupBy("entity", "term").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return summed.where(F.when(F.col("entity") == "", F.col("n") >= SUPPORT).otherwise((F.col("n") > 0) & (F.col("s") >= SUPPORT) & (F.col("lo") < F.col("hi"))))


def disclosing_terms(docs: DataFrame, text_col: str = "text", disclosure: float = DISCLOSURE) -> DataFrame:
    """``term, general``: the terms that reveal an entity and what replaces them (null: removed)."""
    counts = cut(corpus_counts(docs, text_col))
    all_terms = counts.where((F.col("entity") == "") & (F.col("term") == "")).agg(F.max("n")).first()[0] or 0
    vocabulary = counts.where((F.col("entity") == "") & (F.col("term") != "")).select("term", F.col("n").alias("n_t"))
    entities = counts.where((F.col("entity") != "") & (F.col("term") == "")).select("entity", F.col("n").alias("n_c"))
    pairs = counts.where((F.col("entity") != "") & (F.col("term") != "")).select("entity", "term", F.col("n").alias("n_ct"), "s")
    general = F.concat(F.substring("term", 1, GENERAL), F.lit("*"))
    n = F.lit(float(max(all_terms, 1)))
    information = F.log(n / F.col("n_c"))
    reveals = lambda both, alone: (information > 0) & (F.log(n * both / (F.col("n_c") * alone)) >= disclosure * information)
    # No entity is rarer than one occurrence: what fails here reveals none, so the frequent classes do not fill one task of the join.
    likely = pairs.join(vocabulary, "term").where(F.col("n_ct") >= 0.999 * F.col("n_t") * F.pow(n, F.lit(disclosure - 1)))
    by_chance = F.col("s") * information < F.log(n / CHANCE)
    flagged = likely.join(entities, "entity").where(reveals(F.col("n_ct"), F.col("n_t")) & ~by_chance).select("entity", "term", "n_c", general.alias("general"))
    by_prefix = vocabulary.groupBy(general.alias("general")).agg(F.sum("n_t").alias("g_t"))
    both_prefix = pairs.groupBy("entity", general.alias("general")).agg(F.sum("n_ct").alias("g_ct"))
    judged = flagged.join(both_prefix, ["entity", "general"]).join(by_prefix, "general").withColumn("hidden", ~reveals(F.col("g_ct"), F.col("g_t")))
    return judged.groupBy("term").agg(F.when(F.bool_and("hidden") & (F.length(F.first("term")) > GENERAL), F.first("general")).alias("general"))


def find_spans(text: str, terms) -> list[Span]:
    """Base spans and the spans of the disclosing ``terms``, sorted."""
    spans = base_spans(text)
    if terms and not set(_TERM.findall(text.lower())).isdisjoint(terms):
        spans = sorted(spans + [(a, 4, b) for a, b, t in _terms(text, spans) if t in terms])
    return spans


def _with_terms(docs: DataFrame, terms: DataFrame, text_col: str, bound: int) -> tuple[DataFrame, dict | None]:
    """``docs`` and the disclosing terms: as a dictionary, or in a column ``_terms`` where there are more than ``bound``."""
    few = terms.limit(bound + 1).collect()
    if len(few) <= bound:
        return docs, {r["term"]: r["general"] for r in few}
    keyed = docs.withColumn("_key", F.sha2(text_of(text_col), 256))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = sorted(set(_TERM.findall(text.as_py().lower())))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(words), pa.string()), pa.array(words, pa.string())], names=["_key", "term"])

    used = keyed.select("_key", text_of(text_col)).mapInArrow(work, "_key string, term string").distinct()
    own = used.join(terms, "term").groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("term", F.coalesce("general", F.lit(""))))).alias("_terms"))
    return keyed.join(own, "_key", "left").drop("_key"), None


def _annotate(docs: DataFrame, terms: DataFrame, text_col: str, bound: int, outputs: str, make, columns: list[str]) -> DataFrame:
    """Run ``make(text, spans, terms) -> tuple`` on every row; ``columns`` of ``docs`` pass through."""
    rows, known = _with_terms(docs, terms, text_col, bound)
    sent = docs.sparkSession.sparkContext.broadcast(known) if known is not None else None
    inner = rows.select(*[F.col(c) for c in columns], text_of(text_col).alias("_text"), *([] if sent else ["_terms"]))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields if f.name in columns)
    names = [x.split()[0] for x in outputs.split(", ")]
    kinds = [pa.string() if x.split()[1] == "string" else pa.int64() for x in outputs.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = None if sent else batch.column("_terms").to_pylist()
            made = []
            for i, text in enumerate(batch.column("_text")):
                text = text.as_py()
                these = sent.value if sent else {k: v or None for k, v in (own[i] or [])}
                made.append(make(text, find_spans(text, these), these))
            arrays = [pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *arrays], names=[*columns, *names])

    return inner.mapInArrow(work, f"{head}, {outputs}")


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = BROADCAST_TERMS) -> DataFrame:
    """Counts, the digest of the base spans and all spans of every row."""

    def make(text, spans, terms):
        base = [s for s in spans if s[1] < 4]
        count = Counter(s[1] for s in spans)
        return (*(count[k] for k in range(4)), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), count[4])

    outputs = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_term bigint"
    return _annotate(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), disclosing_terms(docs, text_col), "text", bound, outputs, make, ["doc_id"])


def _clean(text: str, spans: list[Span], terms) -> tuple[str]:
    parts, at = [], 0
    for start, kind, end in spans:
        if end <= at:
            continue
        parts.append(text[at : max(at, start)])
        parts.append(f"[{KINDS[kind].upper()}]" if kind < 4 else terms[text[start:end].lower()] or "[TERM]")
        at = end
    return ("".join([*parts, text[at:]]),)


def sanitise(docs: DataFrame, text_col: str = "text", bound: int = BROADCAST_TERMS) -> DataFrame:
    """``docs`` with entities replaced by their kind and disclosing terms generalised or removed in ``text_col``."""
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # no column can clash with those in between
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in at.items()])
    clean = _annotate(inner, disclosing_terms(docs, text_col), at[text_col], bound, "_clean string", _clean, [n for c, n in at.items() if c != text_col])
    return clean.select(*[F.col("_clean" if c == text_col else n).alias(c) for c, n in at.items()])


def op1_pii(spark, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    return report(read(spark, sf_dir, "documents"))
