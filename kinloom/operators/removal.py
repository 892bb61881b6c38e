"""Removal of rows with all that hangs on them, along declared foreign keys.

Tables are visited from parents to children; a child's rows go by semi-joins with the removed keys of its parents. Keys that set null
leave their rows and lose the pointer. Keys that restrict remove nothing: rows that are left and point at removed ones are blockers, and are
reported before anything goes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CASCADE, SET_NULL, RESTRICT = "cascade", "set null", "restrict"


@dataclass(frozen=True)
class ForeignKey:
    child: str
    column: str
    parent: str
    key: str
    action: str = CASCADE


def discard(tables: dict[str, DataFrame], keys: list[ForeignKey], root: str, doomed: Column) -> tuple[dict[str, DataFrame], dict[str, DataFrame], DataFrame]:
    """(rows that go by table, tables as they are afterwards, blockers ``child, column, parent, value, n``).

    Rows of ``root`` that meet ``doomed`` go first. Null keys point at nothing. Keys must form no cycle among tables; a repeated row goes or stays
    as often as it is there; tables that nothing leads to stay as they are.
    """
    graph = {t: {k.parent for k in keys if k.child == t} for t in tables}
    order = list(TopologicalSorter(graph).static_order())
    gone = {t: df.limit(0) for t, df in tables.items()}
    gone[root] = tables[root].where(doomed)
    left = {t: df for t, df in tables.items()}
    left[root] = tables[root].where(~F.coalesce(doomed, F.lit(False)))
    pointed = lambda k: gone[k.parent].select(F.col(k.key).alias(k.column)).where(F.col(k.column).isNotNull()).distinct()
    reached = {root}
    for t in order:
        for k in [k for k in keys if k.child == t and k.parent in reached and k.action == CASCADE]:
            values = pointed(k)
            gone[t] = gone[t].unionByName(left[t].join(values, k.column, "left_semi").select(tables[t].columns))
            left[t] = left[t].join(values, k.column, "left_anti").select(tables[t].columns)
            reached.add(t)
    reports = []
    for k in [k for k in keys if k.parent in reached]:
        if k.action == SET_NULL:
            lost = pointed(k).withColumn("_lost", F.lit(True))
            left[k.child] = left[k.child].join(lost, k.column, "left").withColumn(k.column, F.when(F.col("_lost"), F.lit(None)).otherwise(F.col(k.column))).select(tables[k.child].columns)
        elif k.action == RESTRICT:
            held = left[k.child].join(pointed(k), k.column, "left_semi").groupBy(F.col(k.column).cast("string").alias("value")).agg(F.count("*").alias("n"))
            reports.append(held.select(F.lit(k.child).alias("child"), F.lit(k.column).alias("column"), F.lit(k.parent).alias("parent"), "value", "n"))
    spark = tables[root].sparkSession
    none = spark.createDataFrame([], "child string, column string, parent string, value string, n bigint")
    return {t: gone[t] for t in tables if t in reached}, left, reduce(DataFrame.unionByName, reports, none)
