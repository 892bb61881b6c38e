"""Mixing, quality rules, quality scores, chat, pages, URLs and the pipeline on small tables."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinloom.llm import chat_format, html_extract, mixing, quality_model, quality_rules, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF_DIR = "/root/testdata/sf0.001"


def test_mix_meets_the_targets(spark):
    rows = [(i, "w " * (1 + i % 7), ("a", "b", "c", None)[(i % 9) // 3 if i % 10 else 3]) for i in range(400)] + [(1, None, "a"), (1, "", "a")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, taken long")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    for source in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == source]
        assert own[0]["source_size"] == sum(r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1 and own[0]["target"] <= 2 * own[0]["source_size"]
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    assert mixing.mix(docs.where(F.lit(False))).count() == 0


def plain_counts(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    under = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    failed = len(words) < 50 or 100 * len(under) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(under), failed


def test_quality_rules_count_like_a_loop(spark):
    texts = [None, "", " \n\n", "a b", "x y z x y z", "w " * 80, "a\nb\na\n a\n", "é#& " * 60, " ".join(f"w{i}" for i in range(20_000)), "\n".join(["one two three four"] * 30), "a\rb\vc\fd\u00a0e"]
    docs = spark.createDataFrame([(i % 9, t, t) for i, t in enumerate(texts)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(8, 1, 0), (5, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for rows in (labels, labels.where(F.lit(False))):
        got = quality_rules.apply_rules(docs.withColumn("_h", F.lit(1)).withColumn("_t", F.lit("x")), rows)
        assert got.columns == ["doc_id", "text", "_h", "_t", *quality_rules.COLUMNS]
        got = got.collect()
        assert len(got) == len(texts) and all(r["_h"] == 1 and r["_t"] == "x" for r in got)
        for r in got:
            assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == plain_counts(r["text"])
            assert not (r["base_failed"] and r["kept"])
    assert quality_rules.apply_rules(docs.where(F.lit(False)).drop("score"), labels).count() == 0


def test_all_good_labels_make_the_trusted_target(spark):
    # More good documents than the former bound of 20,000; ids repeat and some are missing.
    n = 20_500
    docs = spark.range(n).select(F.when(F.col("id") % 1000 != 7, F.col("id")).alias("doc_id"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(3, "again"), (3, "again"), (n + 1, "bad")], "doc_id long, text string"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality")).unionByName(spark.createDataFrame([(3, 1), (n + 1, 0)], "doc_id long, quality int"))
    rows = docs.select("doc_id", F.pmod(F.xxhash64("text"), F.lit(quality_rules.BUCKETS)).alias("b")).collect()
    raw, good = Counter(r["b"] for r in rows), Counter(r["b"] for r in rows if r["doc_id"] is not None and r["doc_id"] < n)
    total = lambda c: sum(c.values()) + quality_rules.BUCKETS
    want = [round(math.log((good[b] + 1) / total(good)) - math.log((raw[b] + 1) / total(raw)), 4) for b in range(quality_rules.BUCKETS)]
    assert quality_rules.bucket_weights(docs, labels) == pytest.approx(want, abs=1.1e-4)


def test_quality_scores_learn(spark):
    good = [(i, f"A calm sentence number {i} about rivers, hills and towns. " * (3 + i % 5)) for i in range(200)]
    bad = [(1000 + i, f"BUY!!! $$$ {i} *** click ### " * (4 + i % 3)) for i in range(200)]
    docs = spark.createDataFrame(good + bad + [(5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad], "doc_id long, quality int")
    got = quality_model.score(docs, labels).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 5000]
    assert held and sum(r["predicted"] == (r["doc_id"] < 1000) for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got) and len(got) == 402
    assert quality_model.score(docs, labels.where(F.lit(False))).count() == 402


def test_chat_round_trip(spark):
    odd = ["", "\\", "### User: x </turn>\n", "a:b", "\\### Assistant: </turn> ok", "new\nline", "é" * 3]
    turns = [(k, t, ("user", "assistant", "sys:tem")[t % 3], odd[(k + t) % len(odd)]) for k in range(8) for t in range(6)]
    rows = spark.createDataFrame([*turns, (None, None, None, None)], "conv_id long, turn long, role string, text string")
    for r in chat_format.render(rows).collect():
        own = [(role, text) for c, _, role, text in turns if c == r["conv_id"]] or [("", "")]
        assert chat_format.parse(r["formatted"]) == own and not r["rewrites"]
        loss = [chat_format.unescape(r["formatted"][s["start"] : s["end"]]) for s in r["loss"]]
        assert loss == [text for role, text in own if role == "assistant"]
    for role in ("assistant", "Assistant", "\u00dfa", ""):
        assert chat_format.parse(chat_format.escape_template([(role, "t")])) == [(role, "t")]
    forgetful = lambda turns: "".join(f"{r}={t};" for r, t in turns[-2:])
    assert all(r["rewrites"] for r in chat_format.render(rows.where("conv_id is not null"), forgetful, lambda t: t).collect())


def test_loss_mask_lies_on_the_text():
    closing = " </turn>\n"
    texts = {closing[a:b] for a in range(len(closing)) for b in range(a, len(closing) + 1)} | {"### assistant: ", ": ", "0", "1", "\\", "a" * 50}
    for text in texts:
        for turns in ([("user", "q"), ("assistant", text), ("user", text)], [("assistant", text)], [("assistant", "x"), ("assistant", text)]):
            output, spans, rewrites = chat_format.locate(turns, chat_format.escape_template)
            own = [k for k, t in enumerate(turns) if t[0] == "assistant"]
            want = []
            for k in own:
                start = len(chat_format.escape_template(turns[:k])) + len("### assistant: ")
                want.append((start, start + len(chat_format.escape(turns[k][1]))))
            assert chat_format.loss_spans(turns, chat_format.escape_template, chat_format.escape, rewrites) == want
    numbered = lambda turns: f"{len(turns)} turns\n" + "".join(f"{r}: {t}\n" for r, t in turns)
    turns = [("user", "q"), ("assistant", "user"), ("assistant", "")]
    output, _, rewrites = chat_format.locate(turns, numbered)
    assert rewrites and [output[a:b] for a, b in chat_format.loss_spans(turns, numbered, lambda t: t, True)] == ["user", ""]
    assert chat_format.loss_spans(turns, lambda turns: str(len(turns)), lambda t: t, False) == []


def test_long_pages_are_read_in_linear_time():
    import time

    from kinloom.llm.dom import Page

    n = 100_000
    pages = ["<b>" * n, "<b>x" * n, "<li>" * n, "<ul><li>" * n, "<table><tr><td>" + "<b><tr>" * n, '<a "' * n, "<a '" * n + ">", "<p><b>" * n, "<" * n, "<option>" * n]
    for source in pages:
        began = time.perf_counter()
        Page(source)
        assert time.perf_counter() - began < 8, source[:20]
    assert [t for _, t in Page("<p>a<b>b<i>c</b>d</p><ul><li>e<li>f<ul><li>g</ul><li>h</ul>").blocks] == ["abcd", "e", "f", "g", "h"]


def test_extraction_of_unseen_layouts(spark):
    """Block F1 on generated layouts that the trees were not trained on."""
    made = [html_extract.training_page(seed) for seed in range(50_000, 50_120)]
    rows = spark.createDataFrame([(i, "u", source) for i, (source, _) in enumerate(made)], "page_id long, url string, html string")
    right = wanted = given = 0
    for r in html_extract.extract(rows).collect():
        got = {block.split()[0] for block in r["text"].split("\n\n") if block}
        main = made[r["page_id"]][1]
        right, wanted, given = right + len(got & main), wanted + len(main), given + len(got)
    assert 2 * right / (wanted + given) > 0.93, 2 * right / (wanted + given)


def test_pages(spark):
    page = """<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/a">About</a></li></ul></nav>
    <article><h1>Title &amp; more</h1><p>First  paragraph with
    several words, commas and a full stop, so that it is text.</p><p>Second paragraph, which is also long enough to be read as text.</p></article>
    <div class="sidebar">Other links</div><footer>Footer words</footer><script>var x = "<p>no</p>";</script></body></html>"""
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (3, "u", "<p>unclosed <b>x")], "page_id long, url string, html string")
    got = {(r["page_id"], r["n_chars"]): r for r in html_extract.extract(rows).collect()}
    text = next(r["text"] for r in got.values() if r["page_id"] == 1)
    assert text.split("\n\n") == ["Title & more", "First paragraph with several words, commas and a full stop, so that it is text.", "Second paragraph, which is also long enough to be read as text."]
    assert (2, 0) in got and (3, 0) in got
    assert html_extract.extract(rows.where(F.lit(False))).count() == 0


def test_text_outside_any_block_element_is_read(spark):
    """A page need not mark its body: the words are found as they are inside one."""
    line = "a full sentence of the article, which goes on for some time, and then ends here as sentences do."
    pages = [f"Just plain text with {line}", f"<b>Bold main text</b> and more prose, with {line}", f"<p>First, {line}</p>after it, {line}", f"{line}<script>x()</script> <i>{line}</i>"]
    bodies = [f"<body>{p}</body>" for p in pages]
    rows = spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages + bodies)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(rows).collect()}
    for i in range(len(pages)):
        assert got[i] == got[i + len(pages)] and got[i].count("article") == pages[i].count("article"), pages[i]
    assert got[1].startswith("Bold main text and more prose")


def plain_url(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    low = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [(h, p, v) for h, p, v in url_filter.RULES if (low == h or low.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return low, path, best and best[0] + best[1], best and best[2]


def test_urls(spark):
    urls = [None, "", "x", "http://A.Example.NET/en/1?q=1", "http://example.net/de/", "http://net", "http://a.net/?x", "http://fr.org/fr/1#a", "http://badorg/fr/", "http://example.com/de/x", "http://example.com?/de/", "http://x.com/a://b.net/"]
    # As many allowed urls with a number, so that a number alone is no evidence.
    spam = [f"http://shop{i}.net/casino/{i}" for i in range(50)] + [f"http://fr{i}.org/fr/{i}" for i in range(50)] + ["http://other.com/casino/3", "http://other.com/news/3"]
    rows = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls + spam)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_filter.judge(rows).collect()}
    for i, u in enumerate(urls + spam):
        host, path, rule, verdict = plain_url(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert verdict is None or got[i]["verdict"] == verdict
    assert got[0]["verdict"] == "allow" and got[len(got) - 2]["verdict"] == "block" and got[len(got) - 1]["verdict"] == "allow"
    assert url_filter.judge(rows.where(F.lit(False))).count() == 0


def test_mined_url_rules_need_evidence_beyond_the_list(spark):
    urls = [f"http://evil.net/k{i}" for i in range(60)] + [f"http://s{i}.net/es/" for i in range(60)]
    urls += [f"http://b{i}.net/one/two/three/four" for i in range(60)]
    short = ["one/two/three", "one/two/four", "one/three/four", "two/three/four"]
    urls += [f"http://g{i}.org/fr/{short[i % 4]}" for i in range(120)]
    asked = ["http://evil.com/z", "http://y.com/es/a", "http://x.com/one/two/three/four", "http://x.com/one/two/three"]
    rows = spark.createDataFrame(list(enumerate(urls + asked)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge(rows).collect()}
    assert [got[len(urls) + k]["verdict"] for k in range(4)] == ["allow", "allow", "block", "allow"], "one host, a language, four tokens, three of them"
    assert len(got[len(urls) + 2]["mined_rule"].split(" ")) == 4


def test_pipeline_stages_keep_their_contract(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").unionByName(spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    docs = docs.withColumn("kept", F.lit(1))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF_DIR)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == list(corpus_pipeline.COLUMNS), name
            docs = out
    assert out.count() > 100


def odd_documents(spark):
    """Null and empty texts, repeated rows, a null id and source, ties, a text longer than others by far, and a column too many."""
    draw = __import__("random").Random(6)
    say = lambda n: " ".join("".join(draw.choice("abdeghilmnorst") for _ in range(draw.randint(2, 8))) for _ in range(n))
    base = [say(80) for _ in range(12)]
    texts = [None, "", " \n", *base, base[0], base[0] + " end", base[1].replace(" ", "\n", 3), f"mail me@example.org or 10.1.2.3 {say(60)}", say(30_000), "w " * 90, f"\u00e9t\u00e9 \U0001f600 {say(70)}"]
    rows = [(i, t, "en", ("a", "b", None)[i % 3], len(t or ""), 1) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, base[2], None, None, None, 1), (5, say(70), "de", "a", 7, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept int"), rows


def test_each_stage_returns_what_its_operator_decides(spark):
    """Every stage reads the same odd table; its rows are compared with a loop."""
    import base64
    import hashlib

    import public_tokenizers
    import tiktoken

    import corpus_pipeline
    from kinloom.llm import pii, shingle_join

    docs, rows = odd_documents(spark)
    docs = docs.repartition(3).cache()
    stages = dict(corpus_pipeline.STAGES)
    whole = lambda out: sorted(map(str, map(tuple, out.collect())))
    plain = lambda picked: sorted(str(r[:5]) for r in picked)
    # Quality: the rows of the texts that the rules keep, unchanged.
    judged = {r["text"]: r["kept"] for r in quality_rules.apply_rules(docs.select("doc_id", "text"), spark.read.parquet(f"{SF_DIR}/labels.parquet")).collect()}
    assert not any(judged[t] for t in (None, "", " \n", "w " * 90)) and sum(judged.values()) >= 10
    assert whole(stages["quality_rules"](spark, docs, SF_DIR)) == plain([r for r in rows if judged[r[1]]])
    # Near duplicates: five words, 0.8; the smallest id of a group stays.
    def shingles(t):
        words = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()

    sets = [shingles(r[1]) for r in rows]
    near = lambda i, j: bool(sets[i]) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    stay, seen = [], set()
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0)):
        if rows[i][0] is None or rows[i][:2] not in seen and not any(near(i, j) for j in stay if rows[j][0] is not None):
            stay.append(i)
            seen.add(rows[i][:2])
    assert len(stay) < len(rows) - 4
    assert whole(stages["near_duplicates"](spark, docs, SF_DIR)) == plain([rows[i] for i in stay])
    # Personal data: base spans by their kind.
    def clean(t):
        t, out, at = t or "", [], 0
        for start, kind, end in sorted(pii.base_spans(t)):
            out += [t[at:start], f"[{pii.KINDS[kind].upper()}]"]
            at = end
        return "".join([*out, t[at:]])

    cleaned = [(r[0], clean(r[1]), r[2], r[3], len(clean(r[1]))) for r in rows]
    assert sum("[EMAIL]" in r[1] and "[IP]" in r[1] for r in cleaned) == 1
    assert whole(stages["pii"](spark, docs, SF_DIR)) == plain(cleaned)
    # Mixing: as many whole copies as taken words allow, then the first of the rest.
    mixed = [(r["doc_id"], r["text"], r["lang"], r["source"], r["size"], r["taken"]) for r in mixing.mix(docs.drop("kept"), keep=("text", "lang")).collect()]
    want = []
    for doc_id, text, lang, source, size, taken in mixed:
        while taken > 0:
            ends = [m.end() for m in WORD.finditer(text)]
            part = text if taken >= size else text[: ends[taken - 1]]
            want.append((doc_id, part, lang, source, len(part)))
            taken -= size
    got = stages["mixing"](spark, docs, SF_DIR)
    assert whole(got) == plain(want) and any(len(t) < len(r[1] or "") for r in rows for i, t, *_ in want if i == r[0])
    # Tokens: as the public library encodes them.
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digest = lambda b: hashlib.sha256(b).hexdigest()
    encoded = []
    for r in rows:
        ids = library.encode_ordinary(r[1] or "")
        encoded.append(str((r[0], len(ids), digest(",".join(map(str, ids)).encode()), digest((r[1] or "").encode()))))
    assert whole(stages["bpe"](spark, docs, SF_DIR)) == sorted(encoded)
    for name, stage in stages.items():
        assert stage(spark, docs.where(F.lit(False)), SF_DIR).count() == 0, name
