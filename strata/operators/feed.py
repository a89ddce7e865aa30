"""Applying a change feed: the state of each repository at its head.

Changes carry no order of their own. Their commits have one: the first-parent way from the head.
Changes are tied to the commits on that way, deduplicated by identifier, ranked per element by the
distance of their commit from the head, and the latest is merged into the base.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.sums import digits, state_key, sum_bytes
from strata.operators.hierarchy import way_from
from strata.scratch import Scratch


def commits_once(commits: DataFrame) -> DataFrame:
    """(id, repo_id, statesum, number, ts, parents): one row per commit of the repeated, respelled rows.

    A column is NULL only where all rows of the commit lack it. Rows without a full sum are ignored.
    """
    c = commits.select(
        state_key("statesum").alias("id"), "repo_id", sum_bytes("statesum").alias("statesum"), "number", "ts", "parents"
    )
    return c.where("statesum IS NOT NULL").groupBy("id").agg(
        *[F.max(x).alias(x) for x in ("repo_id", "statesum", "number", "ts")],
        F.max(F.when(F.size("parents") > 0, F.transform("parents", lambda p: state_key(p)))).alias("parents"),
    )


def head_way(commits: DataFrame, heads: DataFrame, *, scratch: Scratch | None = None) -> DataFrame:
    """(repo_id, id, dist, number, statesum) of the commits on the first-parent way from each head.

    dist is 0 at the head. A head that is NULL or shorter than 32 digits has no way.
    """
    scratch = scratch or Scratch(commits.sparkSession)
    c = commits.select(
        state_key("statesum").alias("id"), sum_bytes("statesum").alias("statesum"), "number", state_key(F.get("parents", F.lit(0))).alias("parent")
    )
    c = c.where("statesum IS NOT NULL").groupBy("id").agg(F.max("statesum").alias("statesum"), F.max("number").alias("number"), F.max("parent").alias("parent"))
    c = scratch.cut(c)
    starts = heads.select(F.col("repo_id").alias("key"), state_key("head").alias("id")).where("key IS NOT NULL AND id IS NOT NULL").distinct()
    way = way_from(starts, c.select("id", "parent"), scratch=scratch)
    return way.select(F.col("key").alias("repo_id"), "id", "dist").join(c.select("id", "number", "statesum"), "id")


def applied(changes: DataFrame, way: DataFrame, columns: list[str]) -> DataFrame:
    """The changes of the commits on the way: repo_id, elt_id, op, ``columns`` of changes and of way.

    op is upper case without blanks; rows whose op is none of INS, REPL and DEL, and rows without
    elt_id or commit, are ignored. A change belongs to its commit's repository.
    """
    mine = [x for x in columns if x in changes.columns and x not in ("number", "dist", "statesum")]
    ch = changes.select(state_key("statesum").alias("id"), "elt_id", digits("op").alias("op"), *mine)
    ch = ch.where("id IS NOT NULL AND elt_id IS NOT NULL AND op IN ('INS', 'REPL', 'DEL')")
    return ch.join(way, "id").select("repo_id", "elt_id", "op", *columns)


def head_state(changes: DataFrame, way: DataFrame, columns: list[str] = ("statesum",), base: DataFrame | None = None) -> DataFrame:
    """(repo_id, elt_id, columns) of the elements present at the head.

    Repeated changes of one commit to one element count once, the row received last. An INS of a
    present element replaces it, a REPL of an absent one inserts it, a DEL of an absent one does
    nothing. ``base`` (repo_id, elt_id, columns) is the state below the first commit of the way;
    without it repositories start out empty.
    """
    cols = list(columns)
    rows = applied(changes, way, [*dict.fromkeys([*cols, "dist", "received_at"])])
    if base is not None:
        under = base.select("repo_id", "elt_id", F.lit("INS").alias("op"), *cols, F.lit(2**62).alias("dist"), F.lit(None).cast(rows.schema["received_at"].dataType).alias("received_at"))
        rows = rows.unionByName(under)
    # rank 1 is cut map-side before the shuffle, so an element with very many changes stays cheap
    latest = Window.partitionBy("repo_id", "elt_id").orderBy("dist", F.col("received_at").desc_nulls_last())
    return rows.withColumn("_rn", F.row_number().over(latest)).where("_rn = 1 AND op <> 'DEL'").select("repo_id", "elt_id", *cols)
