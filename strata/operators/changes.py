"""Change sets between states: diff, patch, preconditions, drafts, free ids.

A state is a frame (elt_id, elt) with unique ids; elt has any type that Spark can compare. A change
set is a frame (elt_id, op, elt), op one of INS, REPL and DEL. Presence is the presence of a row and
never read off a NULL payload.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.errors import IdGenFailure, PatchApply
from strata.operators.ordered import running
from strata.scratch import Scratch

PROBES = 10_000
ID_SPACE = 2**64


def only(state: DataFrame, ids: DataFrame | list[int] | None) -> DataFrame:
    """The state restricted to some ids, before any join: a filter does not pass a full outer join."""
    if ids is None:
        return state
    if isinstance(ids, DataFrame):
        return state.join(ids.select("elt_id"), "elt_id", "left_semi")
    return state.where(F.col("elt_id").isin([int(i) for i in ids]))


def sides(old: DataFrame, new: DataFrame) -> DataFrame:
    """(elt_id, in_old, in_new, old, new): every id of either state, with what each side holds."""
    a = old.select("elt_id", F.col("elt").alias("old"), F.lit(True).alias("in_old"))
    b = new.select("elt_id", F.col("elt").alias("new"), F.lit(True).alias("in_new"))
    here = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return a.join(b, "elt_id", "full").select("elt_id", here("in_old"), here("in_new"), "old", "new")


def diff(old: DataFrame, new: DataFrame, ids: DataFrame | list[int] | None = None) -> DataFrame:
    """The change set that turns ``old`` into ``new``; elements equal on both sides are left out.

    A keyed full outer join and a CASE. NaN equals NaN, as everywhere in Spark.
    """
    op = F.when(~F.col("in_old"), "INS").when(~F.col("in_new"), "DEL").when(~F.col("old").eqNullSafe(F.col("new")), "REPL")
    return sides(only(old, ids), only(new, ids)).select("elt_id", op.alias("op"), F.col("new").alias("elt")).where("op IS NOT NULL")


def patch(base: DataFrame, changes: DataFrame) -> DataFrame:
    """The state after the changes. Kept rows pass an anti-join only, so few changes cost no shuffle of the base.

    The changes are read twice: cut them first where they are costly to make.
    """
    touched = changes.where("op <> 'INS'").select("elt_id")
    kept = base.select("elt_id", "elt").join(touched, "elt_id", "left_anti")
    return kept.unionByName(changes.where("op <> 'DEL'").select("elt_id", "elt"))


def violations(base: DataFrame, changes: DataFrame) -> DataFrame:
    """(elt_id, op, problem): changes whose precondition fails, and ids changed more than once."""
    have = base.select("elt_id").withColumn("have", F.lit(True))
    seen = changes.join(have, "elt_id", "left").select("elt_id", "op", F.coalesce("have", F.lit(False)).alias("have"))
    twice = changes.groupBy("elt_id").agg(F.count(F.lit(1)).alias("n"), F.min("op").alias("op")).where("n > 1")
    problem = F.when((F.col("op") == "INS") & F.col("have"), "IdClash").when((F.col("op") != "INS") & ~F.col("have"), "EltNotFound")
    return (
        seen.select("elt_id", "op", problem.alias("problem")).where("problem IS NOT NULL")
        .unionByName(twice.select("elt_id", "op", F.lit("Repeated").alias("problem")))
    )


def checked_patch(base: DataFrame, changes: DataFrame) -> DataFrame:
    if bad := violations(base, changes).limit(1).collect():
        raise PatchApply(f"{bad[0]['problem']}: {bad[0]['op']} of element {bad[0]['elt_id']}")
    return patch(base, changes)


def composed(changes: DataFrame, order: str) -> DataFrame:
    """Several changes per id, applied in order, as one each: first op and last op decide.

    An insertion that is deleted again disappears, a deletion followed by an insertion replaces.
    """
    last = F.max_by(F.struct("op", "elt"), order)
    per_id = changes.groupBy("elt_id").agg(F.min_by("op", order).alias("first"), last.alias("last"))
    op = (
        F.when((F.col("first") == "INS") & (F.col("last.op") != "DEL"), "INS")
        .when((F.col("first") != "INS") & (F.col("last.op") == "DEL"), "DEL")
        .when((F.col("first") != "INS") & (F.col("last.op") != "DEL"), "REPL")
    )
    return per_id.select("elt_id", op.alias("op"), F.when(F.col("last.op") != "DEL", F.col("last.elt")).alias("elt")).where("op IS NOT NULL")


def effective(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Without replacements by an equal payload."""
    old = base.select("elt_id", F.col("elt").alias("old"), F.lit(True).alias("have"))
    j = changes.join(old, "elt_id", "left")
    return j.where(~((F.col("op") == "REPL") & F.coalesce("have", F.lit(False)) & F.col("elt").eqNullSafe(F.col("old")))).select("elt_id", "op", "elt")


def free_id_near(states: list[DataFrame], start: int) -> int:
    """The first id from ``start`` on, wrapping, that no state holds; fails after ``PROBES`` tries."""
    signed = lambda i: (i % ID_SPACE) - (ID_SPACE if i % ID_SPACE >= ID_SPACE // 2 else 0)
    lo, hi = signed(start), signed(start + PROBES - 1)
    near = F.col("elt_id").between(lo, hi) if lo <= hi else (F.col("elt_id") >= lo) | (F.col("elt_id") <= hi)
    taken = reduce(DataFrame.unionByName, [s.select("elt_id").where(near) for s in states]).distinct()
    used = {r[0] for r in taken.collect()}  # at most PROBES ids
    for i in range(PROBES):
        if signed(start + i) not in used:
            return signed(start + i)
    raise IdGenFailure(f"no free id within {PROBES} of {start}")


def gaps(state: DataFrame) -> DataFrame:
    """(elt_id): the first free id after each run of taken ones, 0 after the largest; an anti-join, no sort."""
    taken = state.select("elt_id")
    nxt = taken.select(next_id("elt_id").alias("elt_id"))
    return nxt.join(taken, "elt_id", "left_anti")


def unsigned(id: str) -> F.Column:
    """An id as the unsigned number that it stands for."""
    c = F.col(id).cast("decimal(20,0)")
    return F.when(c < 0, c + F.lit(str(ID_SPACE)).cast("decimal(20,0)")).otherwise(c)


def unsigned_order(id: str) -> list:
    return [F.col(id) < 0, F.col(id)]


def next_id(id: str):
    """The following id; after the largest comes 0, as unsigned numbers wrap."""
    top = 2**63 - 1
    return F.when(F.col(id) == top, F.lit(-(2**63)).cast("bigint")).otherwise(F.col(id) + F.when(F.col(id) == top, 0).otherwise(1))


def ranked_new_ids(conflicts: DataFrame, taken: list[DataFrame], *, scratch: Scratch | None = None) -> DataFrame:
    """(elt_id, new_id): a distinct id for each row, by ascending elt_id, that none of the states ``taken`` holds.

    Ids are unsigned and wrap. The free ids lie in the gaps between taken ones; those above the
    largest come first, then, should these not do, the widest gap below it. Fails with IdGenFailure
    where neither has room.
    """
    scratch = scratch or Scratch(conflicts.sparkSession)
    wanted, n, _ = scratch.counted(conflicts.select("elt_id"))
    order = F.struct((F.col("elt_id") < 0).alias("high"), F.col("elt_id").alias("id"))
    top = reduce(DataFrame.unionByName, [t.select("elt_id") for t in taken]).agg(F.max(order)).first()[0]
    largest = -1 if top is None else top["id"] % ID_SPACE
    start = (largest + 1) % ID_SPACE
    if ID_SPACE - largest - 1 < n:
        start = _widest_gap(taken, n)
    numbered = running(wanted, ["elt_id"], scratch=scratch)
    # start + pos - 1 in two's complement: wrapping, as 64-bit numbers do
    new = F.lit(str(start)).cast("decimal(21,0)") + F.col("pos") - 1
    half, space = F.lit(str(ID_SPACE // 2)).cast("decimal(21,0)"), F.lit(str(ID_SPACE)).cast("decimal(21,0)")
    return numbered.select("elt_id", F.when(new >= half, new - space).otherwise(new).cast("bigint").alias("new_id"))


def _widest_gap(taken: list[DataFrame], n: int) -> int:
    """The first id of a run of ``n`` free ones below the largest id taken.

    Ids are looked at in blocks of 2^48, of which there are at most 65536: within each by a window,
    from block to block by the least and the largest of each.
    """
    ids = reduce(DataFrame.unionByName, [t.select("elt_id") for t in taken]).distinct().withColumn("u", unsigned("elt_id"))
    ids = ids.withColumn("block", F.floor(F.col("u") / F.lit(2**48)))
    inner = ids.withColumn("prev", F.lag("u").over(Window.partitionBy("block").orderBy("u")))
    wide = inner.where(F.col("u") - F.col("prev") > n).agg(F.min("prev")).first()[0]
    if wide is not None:
        return int(wide) + 1
    before = -1
    for lo, hi in ids.groupBy("block").agg(F.min("u").alias("lo"), F.max("u").alias("hi")).orderBy("lo").select("lo", "hi").collect():
        if lo - before > n:
            return before + 1
        before = int(hi)
    raise IdGenFailure(f"no room for {n} ids")
