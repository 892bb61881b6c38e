import hashlib

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from kinloom.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    None, "", "a", "it's  fine\n\n  indeed 12345 Änderung é", " " * 500 + "x", "word " * 300, "a" * 700, "\n" * 300 + "ab  cd" * 90,
    "日本語のテキスト" * 80, "😀" * 200 + " end", "x  y   z    " * 60, "The quick brown fox, 1234567!" * 30, "word " * 300,
]


def test_chunks_give_the_ids_of_the_whole_text(spark):
    docs = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(TEXTS)] + [(0, None, "kept")], "doc_id long, text string, piece string")
    direct = bpe.encoding(PATH, P.PATTERN)
    for chunk, overlap in ((64, 16), (100, 40), (1 << 16, 512)):
        apart = bpe.decode(bpe.encode(docs, PATH, P.PATTERN, keep=("piece",), chunk=chunk, overlap=overlap), PATH).collect()
        together = bpe.round_trip(docs, PATH, P.PATTERN, keep=("piece",), chunk=chunk, overlap=overlap).collect()
        assert len(apart) == len(together) == len(TEXTS) + 1
        for r in apart + together:
            text = TEXTS[r["doc_id"]] or ""
            assert list(r["ids"]) == direct.encode_ordinary(text), (chunk, r["doc_id"])
            assert bytes(r["decoded"]) == text.encode() and r["piece"] == "kept"


def test_digests(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in bpe.digests(docs, PATH, P.PATTERN).collect()}
    ids = bpe.encoding(PATH, P.PATTERN).encode_ordinary("hello world")
    assert rows[1]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert rows[2]["n_tokens"] == 0 and rows[2]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert bpe.digests(docs.where(F.lit(False)), PATH, P.PATTERN).count() == 0


@pytest.mark.parametrize("text", [" " * 3_000_000 + "a"])
def test_runs_that_the_library_cannot_split(text):
    ids = bpe.encode_text(text, PATH, P.PATTERN)
    words = bpe.vocabulary(PATH)
    assert b"".join(words[i] for i in ids) == text.encode()


def test_classes_of_the_splitter(spark):
    """Pre-token boundaries of a mixed text are the same where the splitter stands at any of its boundaries."""
    text = "".join(TEXTS[i] or "" for i in (3, 5, 8, 11))
    whole = bpe.boundaries(text, P.PATTERN)
    for b in whole[:: max(1, len(whole) // 50)]:
        assert [b + x for x in bpe.boundaries(text[b:], P.PATTERN)] == [x for x in whole if x >= b]
