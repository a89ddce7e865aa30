"""When to write a full snapshot: a running weight of commits and edits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.operators.hierarchy import way_from
from strata.operators.ordered import running
from strata.scratch import Scratch

PER_COMMIT, PER_EDIT, LIMIT, FORCED = 5, 1, 150, 1000


@dataclass
class SnapshotPolicy:
    """Counts 5 per commit and 1 per edit; a snapshot is due above 150."""

    weight: int = 0

    def count(self, commits: int, edits: int) -> None:
        self.weight += PER_COMMIT * commits + PER_EDIT * edits

    def force_snapshot(self) -> None:
        self.weight = FORCED

    def want_snapshot(self) -> bool:
        return self.weight > LIMIT

    def reset(self) -> None:
        self.weight = 0


#: A commit weighs at least 5, so that the limit is passed within so many commits.
REACH = LIMIT // PER_COMMIT + 1
BLOCK = 4096


def due(commits: DataFrame, group: str, seq: str, edits: str, *, scratch: Scratch | None = None) -> DataFrame:
    """(group, seq): after which commits of each group a snapshot is written.

    The weight falls back to 0 at every snapshot. After a snapshot the next is due at the first
    commit that takes the weight since then above the limit, which is one of the next ``REACH``; so
    every commit names the one that would follow it, and the chain from each group's beginning is
    followed by pointer doubling. NULL edits count as none; rows without group or seq are ignored.
    """
    scratch = scratch or Scratch(commits.sparkSession)
    rows = commits.select(F.col(group).alias("grp"), F.col(seq).alias("seq"), F.coalesce(F.col(edits).cast("bigint"), F.lit(0)).alias("edits"))
    rows = rows.where("grp IS NOT NULL AND seq IS NOT NULL")
    placed = scratch.cut(running(rows, ["grp", "seq"], sums={"weight": PER_COMMIT + PER_EDIT * F.col("edits")}, scratch=scratch))
    # blocks of positions, each with the first rows of the next one, so that no group is walked in one task
    block = F.floor(F.col("pos") / BLOCK)
    shared = F.when(F.col("pos") % BLOCK < REACH, F.array(block - 1, block)).otherwise(F.array(block))
    following = Window.partitionBy("block").orderBy("pos").rowsBetween(1, REACH)
    ahead = placed.withColumn("own", block).withColumn("block", F.explode(shared)).withColumn("ahead", F.collect_list(F.struct("grp", "pos", "weight")).over(following))
    far = F.filter("ahead", lambda x: (x["grp"] == F.col("grp")) & (x["weight"] - F.col("weight") > LIMIT))
    links = ahead.where("block = own").select(F.col("pos").alias("id"), F.get(far, F.lit(0))["pos"].alias("parent"))
    first = placed.groupBy("grp").agg(F.min("pos").alias("p0"))
    w = Window.partitionBy("grp").orderBy("pos")
    head = placed.join(first, "grp").where(F.col("pos").between(F.col("p0"), F.col("p0") + REACH))
    head = head.withColumn("since", F.sum(PER_COMMIT + PER_EDIT * F.col("edits")).over(w))
    start = head.where(F.col("since") > LIMIT).groupBy("grp").agg(F.min("pos").alias("id")).select(F.col("id").alias("key"), "id")
    way = way_from(start, links, scratch=scratch).select(F.col("id").alias("pos")).distinct()
    return placed.join(way, "pos", "left_semi").select(F.col("grp").alias(group), F.col("seq").alias(seq))
