import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinloom.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    """The patterns as they are written down, with their checks."""
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a1.@-+ 5(9)é%", max_size=60))
def test_base_spans_follow_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


CARD = "4111 1111 1111 1111"


def test_report_and_sanitise(spark):
    rows = [
        (1, f"ask bob@example.org or 10.0.0.1, pay {CARD}, call +1 (555) 010-9999", 0),
        (1, "", 1), (2, None, 2), (None, "é a@b.cd " * 3000, 3),
        *[(10 + i, f"Zanzibari wrote to zed@example.net number {i}", 4) for i in range(6)],
        *[(20 + i, f"nothing is said here number {i}", 5) for i in range(30)],
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_email int")
    found = {(r["doc_id"], r["n_email"], r["n_term"]): r for r in pii.report(docs).collect()}
    assert len(found) >= 4 and pii.report(docs).count() == len(rows)
    for r in pii.report(docs).collect():
        text = next((t for i, t, _ in rows if i == r["doc_id"] and t is not None and (i != 1 or bool(t) == bool(r["spans"]))), "")
        base = plain_spans(text)
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) <= set(r["spans"].split(","))
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    assert clean.where(F.col("text").contains("@") | F.col("text").contains("4111")).count() == 0
    assert clean.where(F.col("text").rlike("(?i)zanzibari")).count() == 0, "a term that only stands with one entity discloses it"
    assert clean.where(F.col("text").contains("nothing is said here")).count() == 30
    assert pii.report(docs.where(F.lit(False))).count() == 0


def test_terms_in_a_join_equal_terms_in_a_dictionary(spark):
    docs = spark.createDataFrame([(i, f"Zanzibari wrote to zed@example.net number {i}" if i < 6 else f"plain text {i}") for i in range(40)], "doc_id long, text string")
    by = lambda bound: sorted(tuple(r) for r in pii.report(docs, bound=bound).collect())
    assert by(100) == by(0)


def test_terms_beside_a_class_of_values_that_never_recur(spark):
    filler = lambda i: " ".join(f"w{(i * 7 + k) % 60}" for k in range(49))
    told = [(i, f"{filler(i)} Quellenhof user{i}@desk.example.net {filler(i + 1)}") for i in range(12)]
    plain = [(100 + i, f"{filler(i)} {filler(i + 3)} {filler(i + 5)}") for i in range(200)]
    docs = spark.createDataFrame(told + plain, "doc_id long, text string")
    terms = {r["term"] for r in pii.disclosing_terms(docs).collect()}
    assert terms == {"quellenhof"}, "every address is new, its domain and kind are not; the term lies before a border of 50 terms"
    assert pii.sanitise(docs).where(F.col("text").rlike("(?i)quellenhof")).count() == 0


def test_counts_of_windows_follow_a_loop():
    texts = ["a b a x@y.zz a c " + "d " * 30 + "e x@y.zz q@y.zz f", "no entity a b", "a q@y.zz", ""]
    want: dict = {}
    for text in texts:
        words = [w for w in text.split() if "@" not in w]
        places, k = [], 0
        for w in text.split():
            if "@" in w:
                places += [(c, k) for c in (w, "kind:email", "domain:y.zz")]
            else:
                k += 1
        for c in {c for c, _ in places}:
            windows = [range(max(k - 25, 0), min(k + 25, len(words))) for own, k in places if own == c]
            for t in {*words, ""}:
                n = sum(any(i in w for w in windows) for i, x in enumerate(words) if t in ("", x))
                s = sum(t == "" or any(words[i] == t for i in w) for w in windows)
                if s:
                    a, b = want.get((c, t), (0, 0))
                    want[c, t] = a + n, b + s
        for t in [*words, *[""] * len(words)]:
            want["", t] = want.get(("", t), (0, 0))[0] + 1, 0
    for held in (1, 10_000):
        got: dict = {}
        for r in pii._counts(iter(texts), held):
            a, b = got.get((r["entity"], r["term"]), (0, 0))
            got[r["entity"], r["term"]] = a + r["n"], b + r["s"]
        assert got == want
