"""Byte-level BPE encoding and decoding (operator 2).

Texts up to ``CHUNK`` characters are encoded where they are read. Longer texts are cut into
overlapping chunks that are spread over the cluster: each chunk is pre-tokenised by itself, the
first boundary on which two neighbouring chunks agree inside their overlap is where they
resynchronise, and the texts between such boundaries are encoded in parallel. No boundary after white space is taken:
a pattern may look ahead from white space, and a text that ends there would be split otherwise. A boundary counts only while
every earlier overlap of the text agreed too; otherwise the rest of the text is encoded as one piece, so
the ids are always those of the whole text. Decoding concatenates the raw bytes of the ids.

Defined results: null text is empty, empty text has no ids, repeated rows stay repeated rows,
an empty table gives no rows; the columns named in ``keep`` pass through.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read, text_of

CHUNK, OVERLAP = 1 << 16, 1 << 9


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    """The encoder of a rank file, made once per Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def vocabulary(path: str) -> list[bytes]:
    """The bytes of every id."""
    with open(path, "rb") as lines:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}
    return [ranks.get(i, b"") for i in range(max(ranks) + 1)]


def _joined(ids: list[list[int]], path: str) -> pa.Array:
    """The concatenated bytes of each list of ids."""
    get = vocabulary(path).__getitem__
    return pa.array([b"".join(map(get, x)) for x in ids], type=pa.binary())


def boundaries(text: str, pattern: str) -> list[int]:
    """Where the pre-tokens of ``text`` start."""
    import regex

    return [m.start() for m in regex.finditer(pattern, text)]


def encode_text(text: str, path: str, pattern: str) -> list[int]:
    """The ids of one text. The library's own splitter gives up on runs of millions of blanks; such a text is split here."""
    encoder = encoding(path, pattern)
    try:
        return encoder.encode_ordinary(text)
    except BaseException as error:
        if type(error).__name__ != "PanicException":
            raise
    import regex

    return [i for m in regex.finditer(pattern, text) for i in encoder._encode_single_piece(m[0])]


def _encode_column(rows: DataFrame, path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """Replace the last column ``text`` by ``ids array<int>`` and, if asked for, ``decoded binary``, made of these ids."""
    head = [f for f in rows.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in head) + ", ids array<int>" + ", decoded binary" * decoded

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # ids become Python numbers: few rows at a time
                part = batch.slice(at, 64)
                ids = [encode_text(t, path, pattern) for t in part.column("text").to_pylist()]
                made = [pa.array(ids, type=pa.list_(pa.int32())), *([_joined(ids, path)] if decoded else [])]
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in head], *made], names=[*[f.name for f in head], "ids", *["decoded"] * decoded])

    return rows.select(*[f.name for f in head], "text").mapInArrow(work, schema)


def _chunks(long: DataFrame, size: int, overlap: int) -> DataFrame:
    """``_row, _chunk, _start, _part`` of every long text."""
    rows = long.select("_row", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                starts = list(range(0, len(text), size))
                for k, start in enumerate(starts):
                    yield pa.RecordBatch.from_pylist(
                        [{"_row": row, "_chunk": k, "_start": start, "_part": text[start : start + size + overlap]}],
                        schema=pa.schema([("_row", pa.string()), ("_chunk", pa.int64()), ("_start", pa.int64()), ("_part", pa.string())]),
                    )

    return rows.mapInArrow(work, "_row string, _chunk bigint, _start bigint, _part string")


def _with_boundaries(chunks: DataFrame, pattern: str, size: int, overlap: int) -> DataFrame:
    """Add the absolute pre-token boundaries inside the overlaps with the chunk before and after."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for start, part in zip(batch.column("_start").to_pylist(), batch.column("_part").to_pylist()):
                cuts = boundaries(part, pattern)
                heads.append([start + c for c in cuts if c < overlap])
                tails.append([start + c for c in cuts[:-1] if size <= c and not part[c - 1].isspace()])  # the last pre-token may go on beyond the chunk
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, kind), pa.array(tails, kind)], names=[*batch.schema.names, "_head", "_tail"])

    return chunks.mapInArrow(work, "_row string, _chunk bigint, _start bigint, _part string, _head array<bigint>, _tail array<bigint>")


def _long_ids(long: DataFrame, path: str, pattern: str, size: int, overlap: int) -> DataFrame:
    """``_row, ids`` of the long texts."""
    chunks = _chunks(long, size, overlap).repartition("_row", "_chunk")
    order = Window.partitionBy("_row").orderBy("_chunk")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    met = (
        _with_boundaries(chunks, pattern, size, overlap)
        .withColumn("_meet", F.when(F.col("_chunk") == 0, F.lit(0).cast("bigint")).otherwise(F.array_min(F.array_intersect("_head", F.lag("_tail").over(order)))))
        .withColumn("_sync", F.min(F.col("_meet").isNotNull()).over(so_far))
        .withColumn("_from", F.when(F.col("_sync"), F.col("_meet")).otherwise(F.col("_start")))
        .withColumn("_unit", F.count_if("_sync").over(so_far))
        .withColumn("_to", F.coalesce(F.lead("_from").over(order), F.col("_start") + F.char_length("_part")))
    )
    piece = F.expr("substring(_part, cast(_from - _start as int) + 1, cast(_to - _from as int))")
    pieces = (
        met.select("_row", "_unit", F.struct("_chunk", piece.alias("piece")).alias("p"))
        .groupBy("_row", "_unit").agg(F.sort_array(F.collect_list("p")).alias("p"))
        .select("_row", "_unit", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("text"))
    )
    encoded = _encode_column(pieces, path, pattern)
    return encoded.groupBy("_row").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_unit", "ids"))), lambda x: x["ids"])).alias("ids"))


def _parts(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, keep: tuple[str, ...], chunk: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """(rows of at most one chunk with their ``text``, longer rows with their ``ids``)."""
    base = docs.select(F.col(id_col).alias("doc_id"), *keep, text_of(text_col).alias("text"))
    short = base.where(F.char_length("text") <= chunk)
    # Chunks of a text are tied together by its digest; copies of a long text are encoded once.
    long = base.where(F.char_length("text") > chunk).withColumn("_row", F.sha2("text", 256))
    ids = _long_ids(long.select("_row", "text").dropDuplicates(["_row"]), path, pattern, chunk, overlap)
    return short, long.drop("text").join(ids, "_row").select("doc_id", *keep, "ids")


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id``, the columns of ``keep`` and ``ids array<int>`` for every row."""
    short, long = _parts(docs, path, pattern, id_col, text_col, keep, chunk, overlap)
    return _encode_column(short, path, pattern).unionByName(long)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``encode`` and ``decode`` in one: a task needs one Python worker for both, not two side by side."""
    short, long = _parts(docs, path, pattern, id_col, text_col, keep, chunk, overlap)
    return _encode_column(short, path, pattern, decoded=True).unionByName(decode(long, path))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Add ``decoded binary``, the concatenated bytes of ``ids``, as the last column."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields) + ", decoded binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # ids become Python numbers: few rows at a time
                part = batch.slice(at, 64)
                decoded = _joined(part.column("ids").to_pylist(), path)
                yield pa.RecordBatch.from_arrays([*part.columns, decoded], names=[*part.schema.names, "decoded"])

    return encoded.mapInArrow(work, schema)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every document."""
    return round_trip(docs, path, pattern).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    """Every text encoded by the ranks of the public vocabulary and decoded again."""
    import public_tokenizers

    return digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
