"""Handover of confirmed entries to the stock: persons and couples are found or created in the order of the entries.

Later entries see what earlier ones created: parents whose full names equal those of a couple that the capture made
before are that couple, and a couple of linked persons is made once. Whether a couple is created so hangs on whether earlier ones
were. This is solved in rounds over keys, never entry by entry: in each round a couple is decided as soon as no earlier undecided
couple has a key that it asks for; keys are aggregated to their first created and first undecided couple, one row a key. The
first undecided couple of all is always decided, so the rounds end; there are as many as the longest chain of entries that
depend on each other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .graph import left_known, written
from .numbering import numbered_rows

#: What a sex field may say, and the roles for which a single word is a given name.
SEX = {"m": "M", "männlich": "M", "maennlich": "M", "knabe": "M", "sohn": "M", "w": "F", "weiblich": "F", "f": "F", "mädchen": "F", "maedchen": "F", "tochter": "F"}
GIVEN_ONLY = ("child", "mother")


@dataclass(frozen=True)
class Plan:
    """Roles of a register in their order; couples; for whose children the couple's names are looked up; whose surname is inherited."""

    roles: tuple[str, ...]
    couples: tuple[tuple[str, str], ...]
    children: tuple[tuple[str, tuple[str, str]], ...]

    @property
    def head(self) -> str:
        return self.couples[0][0]


BAPTISM = Plan(("father", "mother", "child"), (("father", "mother"),), (("child", ("father", "mother")),))
MARRIAGE = Plan(
    ("groom", "bride", "groom_father", "groom_mother", "bride_father", "bride_mother"),
    (("groom", "bride"), ("groom_father", "groom_mother"), ("bride_father", "bride_mother")),
    (("groom", ("groom_father", "groom_mother")), ("bride", ("bride_father", "bride_mother"))),
)


def role_sex(role: Column, said: Column) -> Column:
    """M or F: what the field says, else what the role tells; null for roles that tell nothing."""
    table = F.create_map(*[F.lit(x) for pair in SEX.items() for x in pair])
    by_field = F.try_element_at(table, F.lower(F.trim(F.coalesce(said, F.lit("")))))
    by_role = F.when(role.endswith("father") | (role == "groom"), "M").when(role.endswith("mother") | (role == "bride"), "F")
    return F.when(F.coalesce(said, F.lit("")) != "", by_field).otherwise(by_role)


def name_parts(role: Column, value: Column, given: Column) -> Column:
    """struct(given, surname) of a role; the surname may be missing."""
    alone = role.isin(*GIVEN_ONLY) & (F.size(F.split(F.trim(value), r"\s+")) == 1) & ~value.contains("/")
    split = T.split_name(value)
    none = F.lit(None).cast("string")
    written = lambda c: F.nullif(c, F.lit(""))
    whole = F.when(alone, F.struct(F.trim(value).alias("given"), none.alias("surname"))).otherwise(F.struct(split["given"].alias("given"), split["surname"].alias("surname")))
    return F.when(written(value).isNotNull() & written(given).isNull(), whole).otherwise(F.struct(written(given).alias("given"), written(value).alias("surname")))


def full_name_key(c: Column) -> Column:
    """A full name for comparison: folded, without slashes, single spaces; empty for null."""
    return F.trim(F.regexp_replace(T.fold(F.replace(F.coalesce(c, F.lit("")), F.lit("/"), F.lit(" "))), r"\s+", " "))


def with_ids(couples: DataFrame, known: DataFrame) -> DataFrame:
    """``couples`` left-joined with ``known`` on ``ids``; couples without linked persons, which are most, are not shuffled."""
    rest = couples.where(F.col("ids").isNull())
    for field in known.drop("ids").schema:
        rest = rest.withColumn(field.name, F.lit(None).cast(field.dataType))
    return couples.where(F.col("ids").isNotNull()).join(known, "ids", "left").unionByName(rest)


#: Tables of decided couples that may pile up before they are written as one.
PILED = 8


def _decided(couples: DataFrame, known: DataFrame) -> DataFrame:
    """Add ``created`` to ``couples`` (entry, couple, pos, ord, asks, name, ids); ``known`` has the ``ids`` of couples of the stock.

    ``asks``: the name key looked up, null where none is; ``name``: the key under which the couple can be found once it is
    created; ``ids``: the pair of linked persons, else null. Couples of the capture from before carry negative places and are created.
    A round joins and writes the couples that are undecided, no others.
    """
    in_stock = known.select("ids").distinct().withColumn("stock", F.lit(True))
    same = [F.col(c) for c in ("entry", "couple", "pos", "ord", "asks", "name", "ids")]
    state = written(with_ids(couples, in_stock).select(
        *same, F.when(F.col("pos") < 0, F.lit(True)).when(F.col("stock") & F.col("asks").isNull(), F.lit(False)).alias("created"), F.coalesce("stock", F.lit(False)).alias("stock")
    ))
    closed, left = [state.where(F.col("created").isNotNull())], state.where(F.col("created").isNull())
    while left.limit(1).count():
        state = left
        for part in closed:
            state = state.unionByName(part)
        first = lambda key, at, wanted: state.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"_{wanted}")).agg(  # noqa: E731, B023
            F.min(F.when(F.col("created"), F.col(at))).alias(f"{wanted}_made"), F.min(F.when(F.col("created").isNull(), F.col(at))).alias(f"{wanted}_open")
        )
        by_name, by_ids = first("name", "ord", "asks"), first("ids", "pos", "ids")
        seen = left_known(with_ids(left, by_ids.withColumnRenamed("_ids", "ids")), by_name.withColumnRenamed("_asks", "asks"), "asks", ["pos"])
        earlier = lambda made, place: F.coalesce(F.col(made) < F.col(place), F.lit(False))
        reused, found = earlier("asks_made", "ord"), earlier("ids_made", "pos") | F.col("stock")
        waits = earlier("asks_open", "ord") | (earlier("ids_open", "pos") & ~F.col("stock"))
        decision = F.when(reused | (found & ~earlier("asks_open", "ord")), F.lit(False)).when(~waits, ~found)
        judged = written(seen.select(*same, decision.alias("created"), "stock"))
        closed, left = [*closed, judged.where(F.col("created").isNotNull())], judged.where(F.col("created").isNull())
        if len(closed) > PILED:
            whole = closed[0]
            for part in closed[1:]:
                whole = whole.unionByName(part)
            closed = [written(whole)]
    state = closed[0]
    for part in closed[1:]:
        state = state.unionByName(part)
    return state


def handover(said: DataFrame, plan: Plan, persons: DataFrame, families: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(persons, families, children) that the entries of one register lead to.

    ``said``: entry, ord (the place of the entry, unique), role, value, given, sex, person (null unless linked). ``persons``: person, name;
    ``families``: family, husband, wife, own (made by the capture before). Persons: entry, role, person, state (``created``, ``linked``, ``reused``),
    given, surname, sex, inherited. Families: entry, couple, family, state (``created``, ``found``, ``reused``), husband, wife.
    Children: family, child, once each.

    A role with neither a value nor a person is not there; a couple needs one of its two persons, its names are compared only where both are
    there. A second handover finds the couples of the first by their names. Rows of unknown roles are ignored.
    """
    place = {r: k for k, r in enumerate(plan.roles)}
    step = len(plan.couples) + 1
    named = persons.select("person", F.col("name").alias("_stock_name"))
    rows = said.where(F.col("role").isin(*plan.roles))
    # Only linked persons have a name to be looked up. Then the rows of an entry come together once, for the inherited name and for the couples.
    alone = rows.where(F.col("person").isNull()).withColumn("_stock_name", F.lit(None).cast("string"))
    together = alone.unionByName(rows.where(F.col("person").isNotNull()).join(named, "person", "left")).repartition("entry")
    heir = F.max(F.when(F.col("role") == plan.head, F.col("_p.surname"))).over(Window.partitionBy("entry"))
    surname = F.coalesce("_p.surname", "_heir")
    is_there = (F.coalesce("value", F.lit("")) != "") | F.col("person").isNotNull()
    present = together.withColumn("_p", name_parts(F.col("role"), F.col("value"), F.col("given"))).withColumn("_heir", heir).where(is_there).select(
        "entry", "ord", "role", F.col("value"), "person", F.col("_p.given").alias("given"), surname.alias("surname"), role_sex(F.col("role"), F.col("sex")).alias("sex"),
        (F.col("_p.surname").isNull() & F.col("_heir").isNotNull()).alias("inherited"),
        F.when(F.col("person").isNotNull(), F.col("_stock_name")).otherwise(F.concat_ws(" ", F.col("_p.given"), surname)).alias("name"),
    )
    asked = {couple for _, couple in plan.children}
    of_couple = {r: k for k, c in enumerate(plan.couples) for r in c}
    mapped = lambda pairs, key: F.try_element_at(F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]), key)
    sides = present.withColumn("couple", mapped(of_couple, F.col("role"))).where(F.col("couple").isNotNull())
    is_first = F.col("role").isin(*[c[0] for c in plan.couples])
    said_here = F.struct("ord", full_name_key(F.col("value")).alias("value"), full_name_key(F.col("name")).alias("name"), "person")
    both = sides.groupBy("entry", "couple").agg(F.max(F.when(is_first, said_here)).alias("a"), F.max(F.when(~is_first, said_here)).alias("b"))
    key = lambda x: F.when((F.col(f"a.{x}") != "") & (F.col(f"b.{x}") != ""), F.concat_ws("|", f"a.{x}", f"b.{x}"))
    at = F.coalesce("a.ord", "b.ord")
    here = written(both.select(
        "entry", "couple", (at * step + F.col("couple")).alias("pos"), at.alias("ord"), F.when(F.col("couple").isin(*[k for k, c in enumerate(plan.couples) if c in asked]), key("value")).alias("asks"), key("name").alias("name"),
        F.when(F.col("a.person").isNotNull() & F.col("b.person").isNotNull(), F.concat_ws(":", "a.person", "b.person")).alias("ids"),
    ))
    ids = F.concat_ws(":", "husband", "wife")
    husband, wife = named.toDF("husband", "h_name"), named.toDF("wife", "w_name")
    before = families.where("own").join(husband, "husband").join(wife, "wife").select(
        F.lit(None).cast(here.schema["entry"].dataType).alias("entry"), F.lit(-1).alias("couple"), (F.col("family") - F.lit(1 << 62)).alias("pos"), F.lit(-1).cast("bigint").alias("ord"), F.lit(None).cast("string").alias("asks"),
        F.concat_ws("|", full_name_key(F.col("h_name")), full_name_key(F.col("w_name"))).alias("name"), F.lit(None).cast("string").alias("ids"),
    )
    both_known = families.where(F.col("husband").isNotNull() & F.col("wife").isNotNull())
    state = _decided(here.unionByName(before), both_known.select(ids.alias("ids")))
    made = state.where("created")
    # What a couple that was not created stands for: by name the first created one, else by its persons.
    first_name = made.where(F.col("name").isNotNull()).groupBy(F.col("name").alias("asks")).agg(F.min(F.struct("ord", "pos")).alias("n"))
    of_ids = made.where(F.col("ids").isNotNull()).groupBy("ids").agg(F.min("pos").alias("i_pos"))
    stock_ids = both_known.groupBy(ids.alias("ids")).agg(F.min("family").alias("i_family"))
    own = made.where(F.col("pos") >= 0).select("entry", "couple", "pos", F.lit("created").alias("state"), F.col("pos").alias("target"), F.lit(None).cast(families.schema["family"].dataType).alias("i_family"))
    told = state.where(~F.col("created")).select("entry", "couple", "pos", "ord", "asks", "ids")
    told = left_known(with_ids(told, of_ids.join(stock_ids, "ids", "full_outer")).drop("ids"), first_name, "asks", ["pos"])
    reused = F.coalesce(F.col("n.ord") < F.col("ord"), F.lit(False))
    told = told.select("entry", "couple", "pos", F.when(reused, "reused").otherwise("found").alias("state"), F.when(reused, F.col("n.pos")).when(F.col("i_family").isNull(), F.col("i_pos")).alias("target"), F.when(~reused, F.col("i_family")).alias("i_family"))
    outcome = written(own.unionByName(told))
    # New persons: roles that are not linked and do not belong to a reused couple.
    role_couple = F.create_map(*[x for k, c in enumerate(plan.couples) if c in asked for r in c for x in (F.lit(r), F.lit(k))])
    taken = outcome.where(F.col("state") == "reused").select("entry", F.col("couple").alias("_couple"), F.lit(True).alias("_reused"))
    placed = rows.where(is_there).select("entry", "ord", "role", "person").withColumn("_couple", F.try_element_at(role_couple, F.col("role"))).join(taken, ["entry", "_couple"], "left")
    placed = written(placed.select("entry", "ord", "role", "person", F.when(F.col("_reused"), "reused").when(F.col("person").isNotNull(), "linked").otherwise("created").alias("state")))
    order = F.create_map(*[x for r, k in place.items() for x in (F.lit(r), F.lit(k))])
    fresh = placed.where(F.col("state") == "created").select("entry", "ord", "role", order[F.col("role")].alias("_k"))
    top = persons.agg(F.coalesce(F.max("person"), F.lit(0)).alias("_top"))  # one row
    fresh_ids = numbered_rows(fresh, [F.col("ord"), F.col("_k")], "_n").join(F.broadcast(top)).select("entry", "role", (F.col("_top") + F.col("_n")).alias("person"), F.lit("created").alias("state"))
    old = placed.where(F.col("state") != "created").select("entry", "role", F.when(F.col("state") == "linked", F.col("person")).alias("person"), "state")
    settled = written(fresh_ids.unionByName(old))
    # Created couples with their persons and numbers.
    side = lambda s: F.create_map(*[x for k, c in enumerate(plan.couples) for x in (F.lit(k), F.lit(c[s]))])[F.col("couple")]
    members = settled.withColumn("couple", mapped(of_couple, F.col("role"))).where(F.col("couple").isNotNull())
    members = members.groupBy("entry", "couple").agg(F.max(F.when(is_first, F.col("person"))).alias("husband"), F.max(F.when(~is_first, F.col("person"))).alias("wife"))
    new = outcome.where(F.col("state") == "created").select("entry", "couple", "pos").join(members, ["entry", "couple"], "left")
    top_family = families.agg(F.coalesce(F.max("family"), F.lit(0)).alias("_top"))  # one row
    created = numbered_rows(new.select("pos", "husband", "wife"), [F.col("pos")], "_n").join(F.broadcast(top_family)).select(F.col("pos").alias("target"), (F.col("_top") + F.col("_n")).alias("family"), "husband", "wife")
    every = written(created.unionByName(families.where("own").select((F.col("family") - F.lit(1 << 62)).alias("target"), "family", "husband", "wife")))
    stock = families.select(F.col("family").alias("i_family"), F.col("husband").alias("i_husband"), F.col("wife").alias("i_wife"))
    made_here = outcome.where(F.col("i_family").isNull()).join(every, "target", "left").select("entry", "couple", "family", "state", "husband", "wife")
    of_stock = outcome.where(F.col("i_family").isNotNull()).join(stock, "i_family", "left").select("entry", "couple", F.col("i_family").alias("family"), "state", F.col("i_husband").alias("husband"), F.col("i_wife").alias("wife"))
    couples = written(made_here.unionByName(of_stock))
    again = couples.where(F.col("state") == "reused").select("entry", F.explode(F.array(F.struct(side(0).alias("role"), F.col("husband").alias("p")), F.struct(side(1).alias("role"), F.col("wife").alias("p")))).alias("r")).select("entry", "r.role", F.col("r.p").alias("_again"))
    people = settled.join(present.select("entry", "role", "given", "surname", "sex", "inherited"), ["entry", "role"]).join(again, ["entry", "role"], "left").select(
        "entry", "role", F.coalesce("person", "_again").alias("person"), "state", "given", "surname", "sex", "inherited"
    )
    number = {c: k for k, c in enumerate(plan.couples)}
    child_couple = F.create_map(*[x for role, c in plan.children for x in (F.lit(role), F.lit(number[c]))])
    born = people.withColumn("couple", F.try_element_at(child_couple, F.col("role"))).where(F.col("couple").isNotNull()).join(couples.select("entry", "couple", "family"), ["entry", "couple"])
    return people, couples, born.select("family", F.col("person").alias("child")).distinct()
