"""Periods of forms: pages in order whose headers agree, where a header may be read in part.

A page continues the period before it if one of the two headers is a contiguous part of the other; the richer one then stands for the period.
Pages whose header cannot be read interrupt nothing. This is a fold over the pages of a register, done as a parallel scan: registers are
cut into blocks of ``BLOCK`` pages, each block is folded for the header that it is thought to begin with, and blocks whose beginning
turns out to be another one (the header that the block before ends with) are folded again until none is. A block that shows the
full header once ends with it whatever it begins with, so few rounds are needed; at most as many as there are blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .graph import checkpointed
from .numbering import numbered_rows

BLOCK = 1024


def header_key(columns: Column) -> Column:
    """A header for comparison: lower case, single spaces, no marks around a column's name; order counts."""
    return F.transform(F.coalesce(columns, F.array().cast("array<string>")), lambda c: F.btrim(F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " ")), F.lit(" .:-")))


def contained(small: Column, large: Column) -> Column:
    """Whether ``small`` stands in ``large`` as a contiguous part; an empty one does not."""
    last = F.size(large) - F.size(small) + 1
    places = F.sequence(F.lit(1), F.greatest(last, F.lit(1)))
    return (F.size(small) > 0) & (last >= 1) & F.exists(places, lambda i: F.slice(large, i, F.size(small)) == small)


def _folded(pages: Column, begins: Column) -> Column:
    """struct(key, changes): the header after the pages of a block, and where it starts anew or grows richer."""
    none = F.array().cast("array<struct<n:bigint,start:boolean,key:array<string>>>")

    def step(state: Column, page: Column) -> Column:
        same = state["key"].isNotNull() & (contained(page["key"], state["key"]) | contained(state["key"], page["key"]))

        def moved(s: Column) -> Column:
            richer = ~s | (F.size(page["key"]) > F.size(state["key"]))
            change = F.array(F.struct(page["n"].alias("n"), (~s).alias("start"), page["key"].alias("key")))
            return F.when(richer, F.struct(page["key"].alias("key"), F.concat(state["changes"], change).alias("changes"))).otherwise(state)

        return let(F.coalesce(same, F.lit(False)), moved)

    return F.aggregate(pages, F.struct(begins.alias("key"), none.alias("changes")), step)


def form_periods(pages: DataFrame, register: str, page: str, columns: str, block: int = BLOCK) -> DataFrame:
    """``register, period, first, last, n, header`` of each period, numbered from 1 in the order of pages.

    ``columns``: array of the header's column names, null or empty where it cannot be read. A period reaches to the page before the next
    one begins, the last to the end of the register; the first begins with the first page that can be read, pages before it are in no period. A register without a
    readable page has none. ``page`` tells the pages of a register apart.
    """
    rows = pages.select(F.col(register).alias("register"), F.col(page).alias("page"), header_key(F.col(columns)).alias("key"))
    rows = numbered_rows(rows, [F.col("register"), F.col("page")], "n").withColumn("block", F.floor((F.col("n") - 1) / block))
    rows = checkpointed(rows)
    readable = F.collect_list(F.when(F.size("key") > 0, F.struct("n", "key")))  # at most BLOCK pages; nulls are left out
    blocks = checkpointed(rows.groupBy("register", "block").agg(F.sort_array(readable).alias("pages")))
    fold = lambda df: df.withColumn("f", _folded(F.col("pages"), F.col("begins")))
    named = lambda df, end: df.select(F.col("register").alias("_r"), (F.col("block") + 1).alias("_b"), F.col(end).alias("_ends"))
    no_key = F.lit(None).cast("array<string>")
    state = checkpointed(fold(blocks.withColumn("begins", no_key)).select("register", "block", "begins", F.col("f.key").alias("ends")))
    while True:
        seen = state.join(named(state, "ends"), F.col("register").eqNullSafe(F.col("_r")) & (F.col("block") == F.col("_b")), "left")
        seen = checkpointed(seen.select("register", "block", "ends", F.col("_ends").alias("begins"), (~F.col("_ends").eqNullSafe(F.col("begins"))).alias("changed")))
        if not seen.where("changed").limit(1).count():
            break
        b = blocks.select(F.col("register").alias("_r"), F.col("block").alias("_b"), "pages")
        again = fold(seen.where("changed").join(b, F.col("register").eqNullSafe(F.col("_r")) & (F.col("block") == F.col("_b"))))
        state = checkpointed(seen.where(~F.col("changed")).select("register", "block", "begins", "ends").unionByName(again.select("register", "block", "begins", F.col("f.key").alias("ends"))))
    s = state.select(F.col("register").alias("_r"), F.col("block").alias("_b"), "begins")
    final = fold(blocks.join(s, F.col("register").eqNullSafe(F.col("_r")) & (F.col("block") == F.col("_b"))))
    changes = checkpointed(final.select("register", "block", F.explode("f.changes").alias("c")).select("register", "block", "c.*"))
    # The number of a period: starts in the blocks before (one row a block), then inside the block.
    from pyspark.sql import Window

    per_block = rows.select("register", "block").distinct().join(changes.where("start").groupBy(F.col("register").alias("_r"), F.col("block").alias("_b")).count(), F.col("register").eqNullSafe(F.col("_r")) & (F.col("block") == F.col("_b")), "left")
    up = Window.partitionBy("register").orderBy("block")  # one row for 1,024 pages
    before = checkpointed(per_block.select("register", "block", (F.sum(F.coalesce("count", F.lit(0))).over(up) - F.coalesce("count", F.lit(0))).alias("before")))
    place = before.select(F.col("register").alias("_r"), F.col("block").alias("_b"), "before")
    inside = Window.partitionBy("register", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    of_block = lambda df: df.join(place, F.col("register").eqNullSafe(F.col("_r")) & (F.col("block") == F.col("_b"))).drop("_r", "_b")
    headers = of_block(changes).withColumn("period", F.col("before") + F.count_if("start").over(inside)).groupBy("register", "period").agg(F.max_by("key", "n").alias("header"))
    starts = changes.where("start").select(F.col("n").alias("_n"))
    every = of_block(rows.join(starts, F.col("n") == F.col("_n"), "left")).withColumn("period", F.col("before") + F.count_if(F.col("_n").isNotNull()).over(inside))
    spans = every.where("period > 0").groupBy(F.col("register").alias("_r"), F.col("period").alias("_p")).agg(F.min("page").alias("first"), F.max("page").alias("last"), F.count("*").alias("n"))
    return headers.join(spans, F.col("register").eqNullSafe(F.col("_r")) & (F.col("period") == F.col("_p"))).select("register", F.col("period").cast("bigint").alias("period"), "first", "last", "n", "header")
