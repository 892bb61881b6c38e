"""An append-only journal of changes: the state of records at any time.

A change sets one field of a record, removes the record, or takes an earlier change back. Nothing is overwritten: the state at
a time is the last change of each field that is not taken back by then, and a record is there if no removal is later than all that was set.
Each state is one aggregation with partial results before the shuffle; no history of a record is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed

SET, REMOVE, UNDO = "set", "remove", "undo"


def state_at(journal: DataFrame, until: Column | None = None) -> DataFrame:
    """``record, field, value, at, change`` of all fields of the records that are there at ``until`` (included; null: the end).

    ``journal``: change (unique, grows with time among equal times), at, record, field, op, value, undone (the change that an undo takes back). An
    undo that is itself taken back does nothing; changes without a record or a time are ignored; setting null is a value.
    """
    rows = journal.where(F.col("record").isNotNull() & F.col("at").isNotNull())
    rows = rows.where(F.col("at") <= until) if until is not None else rows
    undone = rows.where(F.col("op") == UNDO).select(F.col("change").alias("by"), F.col("undone").alias("change")).where(F.col("change").isNotNull())
    # Undos of undos first: an undo counts unless it is taken back by one that is not. Chains are short: one round a link.
    live = undone
    taken = undone.limit(0).select("change")
    while True:
        top = live.join(live.select(F.col("change").alias("by")), "by", "left_anti")  # undos that no open undo takes back
        if not top.limit(1).count():
            break
        hit = top.select("change").distinct()
        taken = taken.unionByName(hit)
        live = checkpointed(live.join(top.select("by"), "by", "left_anti").join(hit.withColumnRenamed("change", "by"), "by", "left_anti"))
    counted = rows.where(F.col("op").isin(SET, REMOVE)).join(taken.distinct(), "change", "left_anti")
    latest = counted.groupBy("record", "field", "op").agg(F.max_by(F.struct("value", "at", "change"), F.struct("at", "change")).alias("last"))
    removed = latest.where(F.col("op") == REMOVE).groupBy("record").agg(F.max(F.struct("last.at", "last.change")).alias("gone"))
    there = latest.where(F.col("op") == SET).join(removed, "record", "left").where(F.col("gone").isNull() | (F.struct("last.at", "last.change") > F.col("gone")))
    return there.select("record", "field", "last.value", "last.at", "last.change")


def compacted(journal: DataFrame, until: Column) -> DataFrame:
    """A journal with the same states from ``until`` on: what is set at ``until``, then all later changes.

    Undos after ``until`` of changes before it need those changes, so these and their rivals stay.
    """
    later = journal.where(F.col("at") > until)
    wanted = later.where(F.col("op") == UNDO).select(F.col("undone").alias("change")).where(F.col("change").isNotNull())
    touched = journal.where(F.col("at") <= until).join(wanted, "change", "left_semi").select("record").distinct()
    kept = journal.where(F.col("at") <= until).join(touched, "record", "left_semi")
    state = state_at(journal, until).join(touched, "record", "left_anti").select("change", "at", "record", "field", F.lit(SET).alias("op"), "value", F.lit(None).cast(journal.schema["undone"].dataType).alias("undone"))
    columns = ["change", "at", "record", "field", "op", "value", "undone"]
    return later.select(columns).unionByName(kept.select(columns)).unionByName(state.select(columns))
