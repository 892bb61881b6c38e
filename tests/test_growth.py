"""Steps whose rows or memory once grew faster than the tables."""

import random

from pyspark.sql import functions as F

from kinloom.functions import dates as D
from kinloom.functions import text as T
from kinloom.operators import anchors, audit, graph
from kinloom.operators import matching as M


def test_alike_entries_meet_their_couples_once(spark):
    """200,000 entries of one reading and 10,000 couples that fit it: set against each other they would be two thousand million rows."""
    n = 10_000
    ids = spark.range(2 * n)
    surname = F.when(F.col("id") < n, "Roth").otherwise("Koch")
    null = F.lit(None).cast("int")
    persons = ids.select(F.col("id").alias("person"), F.lit("Anna").alias("givn"), surname.alias("surn"), null.alias("birth_year"), null.alias("death_year"), F.lit(1).alias("source"))
    families = spark.range(n).select(F.col("id").alias("family"), F.col("id").alias("husband"), (F.col("id") + n).alias("wife"), (1700 + F.col("id") % 100).cast("int").alias("marriage_year"), F.lit(1).alias("source"))
    entries = spark.range(200_000).select(F.col("id").alias("entry"), F.lit("Hans Roth").alias("father"), F.lit("Eva Koch").alias("mother"), (1690 + F.col("id") % 20).cast("int").alias("year"))
    proofs = spark.range(1).select(F.lit(1).alias("source"))
    got = anchors.parents_anchor(entries, persons, families, proofs).groupBy((F.col("entry") % 20).alias("k")).agg(F.min("n").alias("least"), F.max("n").alias("most")).collect()
    assert {r["k"]: (r["least"], r["most"]) for r in got} == {k: (max(0, k - 9) * 100, max(0, k - 9) * 100) for k in range(20)}


def test_a_couple_counts_once_however_many_keys_it_shares(spark):
    persons = [(1, "Johann Georg Peter", "Roth", None, None, 1), (2, "Anna Maria Eva", "Koch", None, None, 1), (3, "Johann Georg", "Beck", None, None, 1)]
    families = [(10, 1, 2, 1780, 1), (11, 3, 2, 1780, 1)]
    entries = [(1, "Johann Georg Peter Roth", "Anna Maria Eva Koch", 1790), (2, "Peter Johann", "Eva, Maria", None), (3, "Johann Georg Beck", "Koch", 1790), (4, "Peter Roth", "Koch", 1770), (5, "", "Koch", 1790)]
    frame = spark.createDataFrame
    got = anchors.parents_anchor(
        frame(entries, "entry long, father string, mother string, year int"), frame(persons, "person long, givn string, surn string, birth_year int, death_year int, source int"),
        frame(families, "family long, husband long, wife long, marriage_year int, source int"), frame([(1,)], "source int"),
    ).collect()
    assert {r["entry"]: (r["n"], r["family"], r["reason"]) for r in got} == {
        1: (2, None, "several couples"), 2: (1, 10, "by given names"), 3: (2, None, "several couples"), 4: (0, None, "both known, no couple"), 5: (0, None, "mother known"),
    }


def test_least_common_equals_sets(spark):
    """With blocks of one owner, of a few and of all, and with cells dealt by member."""
    draw = random.Random(4)
    have = {owner: set(draw.sample(range(60), draw.randrange(0, 12))) for owner in (*range(25), 10**12, -3)}
    pairs = [(a, b) for a in have for b in have if draw.random() < 0.4]
    want = {(a, b, min(have[a] & have[b])) for a, b in pairs if have[a] & have[b]}
    frames = spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame([(o, m) for o, ms in have.items() for m in ms], "owner long, member long")
    for block, cell in ((1, 1000), (4, 10), (100, 1000)):
        assert {tuple(r) for r in M.least_common(*frames, block, cell).collect()} == want


def test_members_travel_as_chunks(spark):
    """2,000 members of an owner are one row of two bytes each, not 2,000 rows; members may be missing, doubled, below zero or far apart."""
    rows = spark.range(40_000).select((F.col("id") % 20).alias("owner"), F.floor(F.col("id") / 20).alias("member"))
    assert [r[0] for r in M.chunks(rows.unionByName(rows)).select(F.size("places")).collect()] == [2000] * 20
    have = [(1, -5000), (1, 7), (1, 2**50), (1, None), (2, 2**50), (2, -5000), (2, -5000), (3, 7), (3, None), (None, 7), (4, None)]
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (1, 4), (4, 3)], "a long, b long")
    got = M.least_common(pairs, spark.createDataFrame(have, "owner long, member long"), 2, 3).collect()
    assert {tuple(r) for r in got} == {(1, 2, -5000), (1, 3, 7)}


def test_members_travel_once_a_cell(spark):
    """400 owners with 300 members each and all their pairs: a join of pairs and members would have 24 million rows."""
    members = spark.range(400 * 300).select((F.col("id") % 400).alias("owner"), (F.col("id") % 400 % 7 + 7 * F.floor(F.col("id") / 400)).alias("member"))
    ids = spark.range(400 * 400)
    pairs = ids.select(F.floor(F.col("id") / 400).alias("a"), (F.col("id") % 400).alias("b"))
    got = M.least_common(pairs, members)
    assert got.count() == sum(1 for a in range(400) for b in range(400) if a % 7 == b % 7)


def test_rows_without_a_key_are_dealt(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 100 == 0, F.col("id")).alias("key"))
    other = spark.range(0, 4000, 200).select(F.col("id").alias("key"), F.lit("x").alias("found"))
    saved = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = graph.left_known(df, other, "key", ["id"]).withColumn("task", F.spark_partition_id())
        tasks = [r["count"] for r in got.where("key IS NULL").groupBy("task").count().collect()]
        assert len(tasks) == 4 and max(tasks) < 1300  # a plain join puts all 3,960 into one
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
    assert sorted(tuple(r) for r in got.select("id", "key", "found").where("found IS NOT NULL").collect()) == [(k, k, "x") for k in range(0, 4000, 200)]
    assert got.count() == 4000 and got.columns == ["id", "key", "found", "task"]


def test_lines_are_brought_together_before_they_are_grouped(spark):
    """No task groups lines of all orders as they come; the grouping needs one shuffle of them."""
    frame = spark.createDataFrame
    c = frame([(1, 5.0, "X")], "c_custkey long, c_acctbal double, c_mktsegment string")
    o = frame([(k, 1, "2000-01-01", "F" if k != 3 else "P", 1.0) for k in (1, 2, 3, 4)], "o_orderkey long, o_custkey long, o_orderdate string, o_orderstatus string, o_totalprice double")
    li = frame([(1, "A"), (1, "B"), (2, "A"), (2, None), (3, "A"), (3, "B"), (4, None)], "l_orderkey long, l_linestatus string").withColumn("l_shipdate", F.lit("2000-02-01"))
    found = audit.findings(c, o, li)
    assert [r["id"] for r in found.where("rule = 'mixed_status'").collect()] == [1]
    grouped = audit.findings(c, o, li)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [l_orderkey" in grouped


def test_forms_that_are_related_share_the_class_of_their_first_letter(spark):
    draw = random.Random(6)
    heads = ["th", "dt", "d", "t", "ck", "c", "k", "ph", "p", "f", "v", "y", "ey", "ai", "ay", "a", "e", "i", "z", "s", "aa", "ß", "Ä", "dth"]
    words = [draw.choice(heads) + "".join(draw.choice("aeiyhtdkcpfvzsr") for _ in range(draw.randrange(1, 6))) + draw.choice(("", "in", "en", "er", "e")) for _ in range(3000)]
    df = spark.createDataFrame([(w,) for w in words], "w string").withColumn("f", T.fold(F.col("w")))
    kin = F.array_union(T.name_candidates(F.col("w")), F.array("f", T.skeleton(F.col("f"))))
    assert df.where(F.exists(kin, lambda x: T._first_class(x) != T._first_class(F.col("f")))).count() == 0


def test_an_age_is_searched_once_for_each_unit(spark):
    df = spark.createDataFrame([(1808, 3, 31, "2 JAHRE 1 Woche"), (1808, 3, 31, None), (1808, 3, 31, "99999999999 Tage"), (1808, None, None, "3 Tage")], "y int, m int, d int, age string")
    out = df.select(D.birth_from_age(D.date_struct(F.col("y"), F.col("m"), F.col("d")), F.col("age")).alias("b"))
    assert [r[0] and (tuple(r[0]["date"]), r[0]["exact"]) for r in out.collect()] == [((1806, 3, 21), False), None, ((1808, 3, 28), True), ((1808, None, None), False)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 4 and "RLIKE" not in plan
