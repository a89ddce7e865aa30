"""Replaying logs of changes: the latest change per element instead of a fold over commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replay(changes: DataFrame, order: list[str], base: DataFrame | None = None, until: Column | None = None) -> DataFrame:
    """(elt_id, elt) after all changes, or those that ``until`` selects.

    ``changes``: elt_id, op, elt and the ``order`` columns. A filter on elt_id reaches the scan, as
    it is the window's key.
    """
    rows = changes.where(until) if until is not None else changes
    w = Window.partitionBy("elt_id").orderBy(*[F.col(c).desc() for c in order])
    last = rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    live = last.where("op <> 'DEL'").select("elt_id", "elt")
    if base is None:
        return live
    return base.select("elt_id", "elt").join(last.select("elt_id"), "elt_id", "left_anti").unionByName(live)


def history(changes: DataFrame, order: list[str], elt_id: int | None = None) -> DataFrame:
    """Every change of an element in order, numbered from 1; of all elements without ``elt_id``."""
    rows = changes if elt_id is None else changes.where(F.col("elt_id") == elt_id)
    w = Window.partitionBy("elt_id").orderBy(*order)
    return rows.withColumn("step", F.row_number().over(w))


def broken_preconditions(changes: DataFrame, order: list[str], base: DataFrame | None = None) -> DataFrame:
    """(elt_id, op, before): insertions of what is present, other changes of what is absent."""
    w = Window.partitionBy("elt_id").orderBy(*order)
    rows = changes.withColumn("before", F.lag("op").over(w))
    if base is not None:
        have = base.select("elt_id", F.lit("INS").alias("given"))
        rows = rows.join(have, "elt_id", "left").withColumn("before", F.coalesce("before", "given"))
    present = F.coalesce(F.col("before") != "DEL", F.lit(False))
    return rows.where(F.when(F.col("op") == "INS", present).otherwise(~present)).select("elt_id", "op", "before", *order)


def compacted(changes: DataFrame, order: list[str]) -> DataFrame:
    """History compaction: one change per element between two kept snapshots."""
    rows = changes.withColumn("_o", F.struct(*order))
    per_id = rows.groupBy("elt_id").agg(F.min_by("op", "_o").alias("first"), F.max_by(F.struct("op", "elt"), "_o").alias("last"))
    op = (
        F.when((F.col("first") == "INS") & (F.col("last.op") != "DEL"), "INS")
        .when((F.col("first") != "INS") & (F.col("last.op") == "DEL"), "DEL")
        .when((F.col("first") != "INS") & (F.col("last.op") != "DEL"), "REPL")
    )
    return per_id.select("elt_id", op.alias("op"), "last.elt").where("op IS NOT NULL")
