"""A training-corpus pipeline of five operators.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; the runner writes it as Parquet and
gives the next stage what it reads back. All stages but the last return the columns of ``documents``.

1. quality_rules: documents that the rules reject go.
2. near_duplicates: one document of each group of near copies stays (five-word shingles, similarity 0.8).
3. pii: personal data and the terms that disclose it are replaced in the texts.
4. mixing: documents are repeated, or cut, to the target weights of their sources.
5. bpe: texts are encoded to token ids and decoded again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm import bpe, mixing, pii, quality_rules, shingle_join
from kinloom.llm.common import checkpoint_dir, read, small_batches

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, unchanged.

    A null or empty text has no words and goes; repeated rows are judged each; ties at the threshold stay; very long
    texts are read whole; an empty table gives no rows; further columns are left out.
    """
    judged = quality_rules.apply_rules(docs.select(*COLUMNS), read(spark, sf_dir, "labels"))
    return judged.where("kept").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Null and empty texts are near nothing and stay; rows without an id stay; rows that agree in id and text are one
    document; rows of one id with different texts are judged each by its own text; very long texts are read whole.
    """
    small_batches(spark)
    return shingle_join.one_per_component(docs, COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sanitised texts with their new lengths.

    A null text becomes an empty one; repeated rows stay repeated rows; very long texts are read whole; an empty table
    gives no rows; further columns are left out.
    """
    small_batches(spark)
    clean = pii.sanitise(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("bigint")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that a document is taken; the last document of a source's budget is cut at the word that ends it.

    Null and empty texts have no words, so the mix takes none of them; a null source is a source of its own; repeated
    rows are separate documents; equal keys are taken in order of the id; an empty table gives no rows.
    """
    mixed = mixing.mix(docs, keep=("text", "lang", "n_chars")).where(F.col("taken") > 0)
    # Whole copies, then what is left of the taken words.
    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    rest = F.col("taken") - whole * F.col("size")
    parts = F.concat(
        F.array_repeat(F.col("size"), whole),
        F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")),
    )
    rows = mixed.select("doc_id", "text", "lang", "source", "n_chars", "size", F.explode(parts).alias("words"))
    cut_text = _first_words(F.col("text"), F.col("words"))
    text = F.when(F.col("words") == F.col("size"), F.col("text")).otherwise(cut_text)
    return rows.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def _first_words(text, words):
    """The first ``words`` words of a text with what stands between them."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), words.cast("int")), "")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row; null texts are empty, long ones encoded in pieces."""
    import public_tokenizers

    small_batches(spark)
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: Learned scores and set joins stand between the tables and the last rows: no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's output is written to the shared folder and read back."""
    import uuid

    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
