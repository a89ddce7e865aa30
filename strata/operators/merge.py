"""Three-way merge of two states with a common ancestor, and its per-element solvers.

A conflict is an id whose presence or payload differs between A and B. A solver is a function of a
``Sides`` object that returns one Column: A, B, VALUE, DELETE, RENAME or FAIL; for VALUE it also
names the payload. The default solvers are plain Columns and stay inside generated code.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.errors import NotSolved
from strata.operators.changes import only, ranked_new_ids
from strata.scratch import Scratch

OUTCOMES = ("A", "B", "VALUE", "DELETE", "RENAME", "FAIL")


@dataclass(frozen=True)
class Sides:
    """Presence and payload of one element in A, B and the common ancestor C."""

    pa: Column
    pb: Column
    pc: Column
    a: Column
    b: Column
    c: Column

    @staticmethod
    def same(p: Column, x: Column, q: Column, y: Column) -> Column:
        """Both absent, or both present with equal payloads."""
        return (p & q & x.eqNullSafe(y)) | (~p & ~q)


#: A solver gives (outcome, value); value is None unless the outcome may be VALUE.
Solver = Callable[[Sides], tuple[Column, Column | None]]


def use_a(s: Sides):
    return F.lit("A"), None


def use_b(s: Sides):
    return F.lit("B"), None


def use_c(s: Sides):
    return F.when(s.pc, "VALUE").otherwise("DELETE"), s.c


def fail(s: Sides):
    return F.lit("FAIL"), None


def ancestor(s: Sides):
    """Where only one side changed since the ancestor, that side."""
    a_kept, b_kept = Sides.same(s.pa, s.a, s.pc, s.c), Sides.same(s.pb, s.b, s.pc, s.c)
    return F.when(a_kept, "B").when(b_kept, "A").otherwise("FAIL"), None


def renaming(s: Sides):
    """Two new elements under one id: both are kept."""
    return F.when(~s.pc, "RENAME").otherwise("FAIL"), None


def chain(*solvers: Solver) -> Solver:
    """Each solver is asked where those before it fail."""

    def solve(s: Sides):
        outcome, value = F.lit("FAIL"), None
        for one in solvers:
            o, v = one(s)
            open_ = outcome == "FAIL"
            if v is not None:
                value = v if value is None else F.when(open_, v).otherwise(value)
            outcome = F.when(open_, o).otherwise(outcome)
        return outcome, value

    return solve


def by_element(udf) -> Solver:
    """A solver from a pandas UDF (pa, pb, pc, a, b, c) -> outcome string, for rules that Columns can't say."""
    return lambda s: (udf(s.pa, s.pb, s.pc, s.a, s.b, s.c), None)


def conflicts(a: DataFrame, b: DataFrame, c: DataFrame, ids=None) -> DataFrame:
    """(elt_id, pa, pb, pc, a, b, c, outcome, value) with every outcome FAIL.

    Tagged union and one grouping, so all three states move once. Ids that only the ancestor has
    are no conflict.
    """
    kind = a.schema["elt"].dataType.simpleString()
    none = F.lit(None).cast(f"struct<elt:{kind}>")

    def tagged(state: DataFrame, name: str) -> DataFrame:
        return only(state, ids).select("elt_id", *[(F.struct("elt") if x == name else none).alias(x) for x in "abc"])

    rows = tagged(a, "a").unionByName(tagged(b, "b")).unionByName(tagged(c, "c"))
    one = rows.groupBy("elt_id").agg(*[F.first(x, ignorenulls=True).alias(x) for x in "abc"])
    flat = one.select("elt_id", *[F.col(x).isNotNull().alias(f"p{x}") for x in "abc"], *[F.col(f"{x}.elt").alias(x) for x in "abc"])
    differs = (F.col("pa") != F.col("pb")) | (F.col("pa") & F.col("pb") & ~F.col("a").eqNullSafe(F.col("b")))
    return flat.where(differs).withColumn("outcome", F.lit("FAIL")).withColumn("value", F.lit(None).cast(kind))


def _sides() -> Sides:
    return Sides(*[F.col(x) for x in ("pa", "pb", "pc", "a", "b", "c")])


def solve(found: DataFrame, solver: Solver, where: Column | None = None) -> DataFrame:
    """Ask the solver about the entries still unsolved, or about those that ``where`` selects."""
    outcome, value = solver(_sides())
    asked = where if where is not None else F.col("outcome") == "FAIL"
    kind = found.schema["value"].dataType
    new_value = F.when(asked, value.cast(kind)).otherwise(F.col("value")) if value is not None else F.when(asked, F.lit(None).cast(kind)).otherwise(F.col("value"))
    return found.select(
        "elt_id", "pa", "pb", "pc", "a", "b", "c",
        F.when(asked, outcome).otherwise(F.col("outcome")).alias("outcome_"), new_value.alias("value_"),
    ).select("elt_id", "pa", "pb", "pc", "a", "b", "c", F.col("outcome_").alias("outcome"), F.when(F.col("outcome_") == "VALUE", F.col("value_")).alias("value"))


def solve_one(found: DataFrame, elt_id: int, solver: Solver) -> DataFrame:
    return solve(found, solver, F.col("elt_id") == elt_id)


def summary(found: DataFrame) -> DataFrame:
    """(n_conflicts, n_unsolved, is_solved): one aggregate; without conflicts all is solved."""
    return found.agg(
        F.count(F.lit(1)).alias("n_conflicts"), F.count_if(F.col("outcome") == "FAIL").alias("n_unsolved"),
        F.coalesce(F.bool_and(F.col("outcome") != "FAIL"), F.lit(True)).alias("is_solved"),
    )


def with_new_ids(found: DataFrame, taken: list[DataFrame], *, scratch: Scratch | None = None) -> DataFrame:
    """Adds new_id for the conflicts that are renamed with both sides present; ``taken`` are the states merged and their ancestor.

    The conflicts are written once: the check, the counts and both change sets read them from there.
    """
    scratch = scratch or Scratch(found.sparkSession)
    found, _, n = scratch.counted(found, both=(F.col("outcome") == "RENAME") & F.col("pa") & F.col("pb"))
    if not n["both"]:
        return found.withColumn("new_id", F.lit(None).cast("bigint"))
    both = found.where("outcome = 'RENAME' AND pa AND pb")
    return found.join(ranked_new_ids(both, taken, scratch=scratch), "elt_id", "left")


def changes_against(named: DataFrame, side: str) -> DataFrame:
    """(elt_id, op, elt): what turns A (or B) into the merged state.

    Where both sides are kept, A's element keeps the id and B's gets the new one, seen from either.
    """
    return named.select(F.explode(_changes(named, side)).alias("x")).select("x.elt_id", "x.op", "x.elt")


def _changes(named: DataFrame, side: str) -> Column:
    """The changes of one conflict, as an array; NULL where there are none."""
    mine, other = ("a", "b") if side == "A" else ("b", "a")
    pm, po = F.col(f"p{mine}"), F.col(f"p{other}")
    m, o, value = F.col(mine), F.col(other), F.col("value")
    kind = named.schema["value"].dataType
    nothing = F.lit(None).cast(kind)

    def change(id_: Column, op: str, elt: Column) -> Column:
        return F.struct(id_.alias("elt_id"), F.lit(op).alias("op"), elt.cast(kind).alias("elt"))

    take_other = (
        F.when(pm & po, F.array(change(F.col("elt_id"), "REPL", o)))
        .when(po, F.array(change(F.col("elt_id"), "INS", o)))
        .otherwise(F.array(change(F.col("elt_id"), "DEL", nothing)))
    )
    take_value = (
        F.when(~pm, F.array(change(F.col("elt_id"), "INS", value)))
        .when(~m.eqNullSafe(value), F.array(change(F.col("elt_id"), "REPL", value)))
    )
    both_kept = F.array(change(F.col("new_id"), "INS", F.col("b")))
    if side == "B":
        both_kept = F.array(change(F.col("elt_id"), "REPL", F.col("a")), change(F.col("new_id"), "INS", F.col("b")))
    rename = F.when(pm & po, both_kept).when(~pm, F.array(change(F.col("elt_id"), "INS", o)))
    return (
        F.when(F.col("outcome") == ("B" if side == "A" else "A"), take_other)
        .when(F.col("outcome") == "VALUE", take_value)
        .when((F.col("outcome") == "DELETE") & pm, F.array(change(F.col("elt_id"), "DEL", nothing)))
        .when(F.col("outcome") == "RENAME", rename)
    )


@dataclass(frozen=True)
class MergeCommit:
    """The smaller of the two change sets, and the order of parents that goes with it."""

    first_is_a: bool
    changes: DataFrame
    n_changes: int


def make_commit(named: DataFrame) -> MergeCommit:
    """Relative to A only if that takes fewer changes; raises NotSolved while any entry fails.

    One pass over the conflicts counts what is unsolved and how many changes either side takes.
    """
    n = lambda side: F.coalesce(F.sum(F.coalesce(F.size(_changes(named, side)), F.lit(0))), F.lit(0))
    failed, n_a, n_b = named.agg(F.count_if(F.col("outcome") == "FAIL"), n("A"), n("B")).first()
    if failed:
        raise NotSolved("conflicts are left")
    return MergeCommit(True, changes_against(named, "A"), n_a) if n_a < n_b else MergeCommit(False, changes_against(named, "B"), n_b)
