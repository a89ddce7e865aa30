"""References to records that do not exist.

Skew-aware split: references are pre-aggregated per key and period, keys with many references are
looked up by a broadcast of those few keys, the rest goes through a shuffled anti-join; both kinds
of orphans are then put together. A key can be heavy only by holding more than 1/``max_heavy`` of
all references, so the broadcast never has more than ``max_heavy`` rows, however large the tables are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.scratch import Scratch

MAX_HEAVY = 4096


def live_records(records: DataFrame, key: str, received: str, purged: str) -> DataFrame:
    """(key) of the records whose row received last is not purged.

    A NULL time of receipt counts as earliest; of rows received at one time a purged one wins.
    """
    newest = F.max_by(F.col(purged).isNotNull(), F.struct(F.col(received), F.col(purged).isNotNull()))
    return records.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(newest.alias("gone")).where("NOT gone").select("key")


def per_period(refs: DataFrame, by: list[str], received: str) -> DataFrame:
    """(by, key, month, n): references counted per key and month of receipt, map-side first. A NULL time gives a NULL month."""
    month = F.date_format(F.date_trunc("month", F.col(received)), "yyyy-MM")
    return refs.groupBy(*by, "key", month.alias("month")).agg(F.count(F.lit(1)).alias("n"))


def lost_keys(counted: DataFrame, live: DataFrame, *, max_heavy: int = MAX_HEAVY, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(heavy, heavy_lost, light_lost): the heavy keys, and the keys of either kind that are not among those of ``live``.

    ``counted``: key, n, any number of rows per key; NULL keys are left out.
    """
    per_key = counted.where("key IS NOT NULL").groupBy("key").agg(F.sum("n").alias("n"))
    per_key = scratch.cut(per_key)
    total = per_key.agg(F.sum("n")).first()[0] or 0
    heavy = scratch.cut(per_key.where(F.col("n") > total / max_heavy).select("key"))  # fewer than max_heavy rows
    live = live.select("key")
    # of the heavy keys: which are there? The records are filtered by the few keys where they lie.
    there = live.join(F.broadcast(heavy), "key", "left_semi").distinct()
    heavy_lost = scratch.cut(heavy.join(there, "key", "left_anti"))
    light_lost = per_key.join(F.broadcast(heavy), "key", "left_anti").select("key").join(live, "key", "left_anti")
    return heavy, heavy_lost, light_lost


def orphans(refs: DataFrame, live: DataFrame, *, max_heavy: int = MAX_HEAVY, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``refs`` whose ``key`` is not among the keys of ``live``; all columns are kept.

    A NULL key names no record, so it is an orphan: leave such rows out if they refer to nothing.
    Repeated rows stay repeated. Empty tables: no references give no orphans, no records make
    every reference one.
    """
    scratch = scratch or Scratch(refs.sparkSession)
    refs = scratch.cut(refs)
    heavy, heavy_lost, light_lost = lost_keys(refs.select("key", F.lit(1).alias("n")), live, max_heavy=max_heavy, scratch=scratch)
    heavy_rows = refs.join(F.broadcast(heavy_lost), "key", "left_semi")
    light_rows = refs.where("key IS NOT NULL").join(F.broadcast(heavy), "key", "left_anti").join(light_lost, "key", "left_semi")
    return heavy_rows.unionByName(light_rows).unionByName(refs.where("key IS NULL"))


def orphan_counts(refs: DataFrame, live: DataFrame, by: list[str], received: str, *, max_heavy: int = MAX_HEAVY, scratch: Scratch | None = None) -> DataFrame:
    """(by, month, n_orphans): orphans per table and month of receipt; only counts per key and month pass the joins.

    NULL keys are orphans, as in :func:`orphans`. Empty tables: as there.
    """
    scratch = scratch or Scratch(refs.sparkSession)
    counted = scratch.cut(per_period(refs, by, received))
    heavy, heavy_lost, light_lost = lost_keys(counted, live, max_heavy=max_heavy, scratch=scratch)
    parts = [
        counted.join(F.broadcast(heavy_lost), "key", "left_semi"),
        counted.where("key IS NOT NULL").join(F.broadcast(heavy), "key", "left_anti").join(light_lost, "key", "left_semi"),
        counted.where("key IS NULL"),
    ]
    rest = [p.groupBy(*by, "month").agg(F.sum("n").alias("n")) for p in parts]
    both = rest[0].unionByName(rest[1]).unionByName(rest[2])
    return both.groupBy(*by, "month").agg(F.sum("n").alias("n_orphans"))
