"""Journals and removals on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import journal as J
from ..operators import removal as R
from ..session import table
from .registry import query

_JOURNAL_SQL = """
WITH bound AS (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS middle FROM events),
j AS (SELECT event_id, ts, user_id, event_type, value FROM events, bound WHERE ts <= middle),
s AS (SELECT user_id, event_type, max(ROW(ts, event_id)) AS last, arg_max(value, ROW(ts, event_id)) AS value FROM j WHERE event_type <> 'error' GROUP BY 1, 2),
r AS (SELECT user_id, max(ROW(ts, event_id)) AS gone FROM j WHERE event_type = 'error' GROUP BY 1)
SELECT s.user_id AS record, event_type AS field, round(s.value, 6) AS value FROM s LEFT JOIN r ON s.user_id = r.user_id WHERE r.gone IS NULL OR s.last > r.gone"""


def journal_of_events(spark, sf):
    """Every event changes a field of its user, named by the type; an error removes the user."""
    e, error = table(spark, sf, "events"), F.col("event_type") == "error"
    return e.select(
        F.col("event_id").alias("change"), F.col("ts").alias("at"), F.col("user_id").alias("record"), F.when(~error, F.col("event_type")).alias("field"),
        F.when(error, J.REMOVE).otherwise(J.SET).alias("op"), "value", F.lit(None).cast("bigint").alias("undone"),
    )


@query("journal_state", _JOURNAL_SQL)
def journal_state(spark, sf):
    """The state of all users in the middle of the time that the events cover."""
    least, most = table(spark, sf, "events").agg(F.min("ts"), F.max("ts")).first()
    middle = least + (most - least) / 2
    return J.state_at(journal_of_events(spark, sf), F.lit(middle)).select("record", "field", F.round("value", 6).alias("value"))


_KEYS = [R.ForeignKey("orders", "o_custkey", "customer", "c_custkey"), R.ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey"), R.ForeignKey("events", "user_id", "customer", "c_custkey", R.SET_NULL)]


@query("discard", """
WITH c AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)),
l AS (SELECT 1 FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o))
SELECT 'customer' AS name, (SELECT count(*) FROM c) AS gone, (SELECT count(*) FROM customer) - (SELECT count(*) FROM c) AS kept, CAST(0 AS BIGINT) AS unlinked
UNION ALL SELECT 'orders', (SELECT count(*) FROM o), (SELECT count(*) FROM orders) - (SELECT count(*) FROM o), 0
UNION ALL SELECT 'lineitem', (SELECT count(*) FROM l), (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM l), 0
UNION ALL SELECT 'events', 0, (SELECT count(*) FROM events), (SELECT count(*) FROM events WHERE user_id IN (SELECT c_custkey FROM c))""")
def discard(spark, sf):
    """What goes with the customers in debt, table by table, and how many events lose their user."""
    tables = {t: table(spark, sf, t) for t in ("customer", "orders", "lineitem", "events")}
    gone, left, _ = R.discard(tables, _KEYS, "customer", F.col("c_acctbal") < 0)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    rows = []
    for t in tables:
        lost = count(left[t].where("user_id IS NULL"), "a").join(count(tables[t].where("user_id IS NULL"), "b")).select((F.col("a") - F.col("b")).alias("unlinked")) if t == "events" else spark.createDataFrame([(0,)], "unlinked bigint")
        rows.append(count(gone.get(t, tables[t].limit(0)), "gone").join(count(left[t], "kept")).join(lost).select(F.lit(t).alias("name"), "gone", "kept", "unlinked"))  # one row each
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
