"""Positions and running sums over a whole table in order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.scratch import Scratch


def running(df: DataFrame, order: list[str], *, sums: dict[str, Column] | None = None, xors: dict[str, Column] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Adds pos, the row's place from 1 on by ``order``, and the running sum or xor of each given column up to it.

    Rows are spread over ranges of the order. Each range is numbered and summed by itself, then moved
    by the totals of the ranges before it, of which there are as many as shuffle partitions. Rows
    that the order does not tell apart get places one after the other.
    """
    scratch = scratch or Scratch(df.sparkSession)
    sums, xors = sums or {}, xors or {}
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # the bounds of ranges come from a sample: they are written once and read twice
    parts = scratch.cut(df.withColumns({**sums, **xors}).repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    inner = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    total = {"pos": F.count(F.lit(1)), **{c: F.sum(c) for c in sums}, **{c: F.bit_xor(c) for c in xors}}
    at = parts.groupBy("_part").agg(*[x.alias(f"_{c}") for c, x in total.items()])
    over = {c: F.bit_xor if c in xors else F.sum for c in total}
    at = at.select("_part", *[F.coalesce(over[c](f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in total])
    own = parts.withColumns({"pos": F.row_number().over(inner).cast("bigint"), **{c: over[c](c).over(inner) for c in [*sums, *xors]}})
    moved = {c: F.col(c).bitwiseXOR(F.col(f"_{c}")) if c in xors else F.col(c) + F.col(f"_{c}") for c in total}
    return own.join(F.broadcast(at), "_part").withColumns(moved).drop("_part", *[f"_{c}" for c in total])
