"""Chat formatting with incremental rendering (operator 7).

A template is a black box: a function from a list of (role, text) turns to one string. Each
conversation is rendered for its successive turn prefixes; comparing consecutive outputs locates the
span that each turn added. A template whose longer output does not start with the shorter one rewrites history: the
conversation is marked ``rewrites`` and the spans are taken from the common prefix and suffix of the outputs.
The loss mask covers the text of assistant turns. It is located by rendering too: the turn is rendered with two
texts that differ in their only character, and the place where the outputs differ is where the text starts; what follows that
character follows the text. So no text is searched for, and a text that occurs in the marks cannot mislead.

``escape_template`` is the template in use. It marks turns with ``### role: `` and `` </turn>`` and
escapes backslash, ``#`` and ``<`` in roles and texts (in roles also the colon) with a backslash, so no text can forge a mark and
every role and text can be read back as it was.

One conversation is one row of work; its cost is the square of its number of turns, which is what
prefix rendering of a black box takes. Conversations are independent and spread over all tasks.

Defined results: null text and null role are empty, turns are ordered by (turn, role, text) with null
turns first, repeated rows are repeated turns, null ``conv_id`` is one conversation, an empty table
gives no rows, further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read

Turns = list[tuple[str, str]]
_SPECIAL = re.compile(r"[\\#<]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\#<:]|\\.)*): ((?:[^\\#<]|\\.)*) </turn>\n", re.S)
OUT = "conv_id bigint, formatted string, spans array<struct<start:int,end:int>>, loss array<struct<start:int,end:int>>, rewrites boolean"


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def escape_template(turns: Turns) -> str:
    """The whole conversation as one string."""
    return "".join(f"### {escape(role).replace(':', chr(92) + ':')}: {escape(text)} </turn>\n" for role, text in turns)


def parse(formatted: str) -> Turns:
    """Turns read back from what ``escape_template`` wrote."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")
    return out


def common_prefix(a: str, b: str) -> int:
    """Length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def locate(turns: Turns, template: Callable[[Turns], str]) -> tuple[str, list[tuple[int, int]], bool]:
    """(output, span of each turn, whether the template rewrites history)."""
    before, spans, rewrites = template([]), [], False
    for k in range(1, len(turns) + 1):
        after = template(turns[:k])
        if after.startswith(before):
            spans.append((len(before), len(after)))
        else:
            rewrites = True
            same = common_prefix(before, after)
            tail, most = 0, min(len(before), len(after)) - same
            while tail < most and before[-1 - tail] == after[-1 - tail]:
                tail += 1
            spans.append((same, len(after) - tail))
        before = after
    return before, spans, rewrites


def text_span(turns: Turns, k: int, template: Callable[[Turns], str], shown: Callable[[str], str]) -> tuple[int, int] | None:
    """Where the output of all ``turns`` shows the text of turn ``k``; None if it does not show it as ``shown`` says."""
    role, text = turns[k]
    one, two = (template([*turns[:k], (role, probe), *turns[k + 1 :]]) for probe in "01")
    start = common_prefix(one, two)
    if start == len(one):
        return None
    output, rest = template(turns), len(one) - start - 1
    end = len(output) - rest
    return (start, end) if end >= start and output[start:end] == shown(text) else None


def loss_spans(turns: Turns, template: Callable[[Turns], str], shown: Callable[[str], str], rewrites: bool) -> list[tuple[int, int]]:
    """Where the texts of assistant turns lie. Without rewriting the turns up to a turn fix its place."""
    found = (text_span(turns if rewrites else turns[: k + 1], k, template, shown) for k, (role, _) in enumerate(turns) if role == "assistant")
    return [span for span in found if span]


def render(conversations: DataFrame, template: Callable[[Turns], str] = escape_template, shown: Callable[[str], str] = escape) -> DataFrame:
    """One row per conversation: ``OUT``."""
    turns = conversations.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pairs = [(x["role"], x["text"]) for x in listed]
                output, spans, rewrites = locate(pairs, template)
                loss = loss_spans(pairs, template, shown, rewrites)
                as_rows = lambda s: [{"start": a, "end": b} for a, b in s]
                rows.append({"conv_id": conv, "formatted": output, "spans": as_rows(spans), "loss": as_rows(loss), "rewrites": rewrites})
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("spans", span), ("loss", span), ("rewrites", pa.bool_())])
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return turns.mapInArrow(work, OUT)


def digests(rendered: DataFrame) -> DataFrame:
    """What the rendered strings say when they are read back."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                turns = parse(x["formatted"])
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                loss = "".join(unescape(x["formatted"][s["start"] : s["end"]]) for s in x["loss"])
                digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
                rows.append(
                    {"conv_id": x["conv_id"], "n_turns": len(turns), "turns_sha256": digest(said), "loss_chars": len(loss), "loss_sha256": digest(loss), "formatted_chars": len(x["formatted"])}
                )
            schema = pa.schema(
                [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
            )
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return rendered.mapInArrow(work, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


#: A conversation of control strings.
PROBE = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def op7_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations and the probe, formatted and read back."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(render(rows.unionByName(spark.createDataFrame(PROBE, "conv_id bigint, turn bigint, role string, text string"))))


OP7_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       CAST(sum(length('### : ') + length(regexp_replace(role, '([\\#<:])', '\\\1', 'g'))
                + length(regexp_replace(text, '([\\#<])', '\\\1', 'g')) + length(' </turn>') + 1) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
