"""Queries p1 to p6 over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.sums import digits, state_key, sum_bytes, sum_text
from strata.operators import feed, hierarchy, references, residues, versions
from strata.scratch import Scratch

#: Snapshots up to this many are joined by broadcast (24 bytes each), more by a shuffle.
FEW_SNAPSHOTS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- 1: hierarchies -------------------------------------------------------------------------


def _commit_tree(spark: SparkSession, sf_dir: str, scratch: Scratch, with_counts: bool) -> DataFrame:
    """Nodes are full sums as bytes; a parent is named by its first 16 bytes, so sums are looked up once."""
    c = scratch.cut(feed.commits_once(table(spark, sf_dir, "commits")))
    named = c.select(F.col("id").alias("pid"), F.col("statesum").alias("parent"))
    nodes = c.select("statesum", F.get("parents", F.lit(0)).alias("pid")).join(named, "pid", "left").select("statesum", "parent")
    return hierarchy.hierarchy(nodes, "statesum", "parent", with_counts=with_counts, scratch=scratch)


def p1_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every commit: root, depth, path from the root, number of descendants, status."""
    scratch = Scratch(spark)
    tree = _commit_tree(spark, sf_dir, scratch, True)
    looped = hierarchy.loop_descendants(tree, scratch=scratch).groupBy(F.col("ancestor").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    out = lambda t, n: t.select(
        sum_text("id").alias("statesum"), sum_text("root").alias("root"), "depth", F.transform("path", lambda x: F.hex(x)).alias("path"), n.alias("n_descendants"), "status"
    )
    rest = tree.where("status <> 'tree'").join(looped, "id", "left")
    return out(tree.where("status = 'tree'"), F.col("n_descendants")).unionByName(out(rest, F.coalesce("n", F.lit(0).cast("bigint"))))


def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every commit with each of its descendants and their least distance; one on a cycle descends from itself."""
    scratch = Scratch(spark)
    tree = scratch.cut(_commit_tree(spark, sf_dir, scratch, False))
    pairs = hierarchy.descendants(tree).unionByName(hierarchy.loop_descendants(tree, scratch=scratch))
    return pairs.select(sum_text("ancestor").alias("statesum"), sum_text("descendant").alias("descendant"), "distance")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    c = scratch.cut(feed.commits_once(table(spark, sf_dir, "commits")))
    edges = c.select(F.col("id").alias("child"), F.explode("parents").alias("parent")).where("parent IS NOT NULL").distinct()
    ranks = c.select("id", F.col("repo_id").alias("grp"), F.col("number").alias("rank"))
    on = scratch.cut(hierarchy.cycle_members(edges, ranks, scratch=scratch))
    return c.join(on, "id", "left_semi").select("repo_id", sum_text("statesum").alias("statesum"))


# ---- 2: orphan references -------------------------------------------------------------------


def _references(spark: SparkSession, sf_dir: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The references, one row per referring place, and the keys of the commits that are there."""
    commits = table(spark, sf_dir, "commits")
    c = commits.select("repo_id", sum_bytes("statesum").alias("holder"), state_key("statesum").alias("id"), "parents", "received_at", "purged_at")
    # one row per referring place; repeats carry the same reference, its first receipt dates it
    from_commits = (
        c.where("holder IS NOT NULL")
        .select("repo_id", "holder", "received_at", F.posexplode("parents").alias("pos", "ref"))
        .where(F.length(digits("ref")) > 0)
        .groupBy("repo_id", "holder", F.col("pos").cast("bigint").alias("pos"), state_key("ref").alias("key"))
        .agg(F.min("received_at").alias("received_at"))
        .select(F.lit("commits").alias("src"), "repo_id", sum_text("holder").alias("holder"), "pos", "key", "received_at")
    )
    from_snapshots = (
        table(spark, sf_dir, "snapshots")
        .where(F.length(digits("statesum")) > 0)
        .groupBy("repo_id", "ss", state_key("statesum").alias("key"))
        .agg(F.min("received_at").alias("received_at"))
        .where("ss IS NOT NULL")
        .select(F.lit("snapshots").alias("src"), "repo_id", F.col("ss").cast("string").alias("holder"), F.lit(0).cast("bigint").alias("pos"), "key", "received_at")
    )
    live = scratch.cut(references.live_records(c.where("holder IS NOT NULL"), "id", "received_at", "purged_at"))
    return from_commits.unionByName(from_snapshots), live


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    refs, live = _references(spark, sf_dir, scratch)
    return references.orphans(refs, live, scratch=scratch).select("src", "repo_id", "holder", "pos").distinct()


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per referring table and month of the reference's first receipt."""
    scratch = Scratch(spark)
    refs, live = _references(spark, sf_dir, scratch)
    return references.orphan_counts(refs, live, ["src"], "received_at", scratch=scratch)


def p2_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan rows per referring table and month of receipt: every delivered row refers, so keys are as hot as the tables are."""
    scratch = Scratch(spark)
    _, live = _references(spark, sf_dir, scratch)
    of_changes = table(spark, sf_dir, "changes").select(F.lit("changes").alias("src"), state_key("statesum").alias("key"), "received_at")
    of_snapshots = table(spark, sf_dir, "snapshots").select(F.lit("snapshots").alias("src"), state_key("statesum").alias("key"), "received_at")
    refs = of_changes.unionByName(of_snapshots).where("key IS NOT NULL")
    return references.orphan_counts(refs, live, ["src"], "received_at", scratch=scratch)


# ---- 3: snapshots ---------------------------------------------------------------------------


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    rows = table(spark, sf_dir, "snapshots")
    seq = scratch.cut(residues.snapshot_sequence(rows))
    if seq.count() <= FEW_SNAPSHOTS:
        seq = F.broadcast(seq)
    return residues.snapshot_changes(rows, seq)


# ---- 4: change feed -------------------------------------------------------------------------


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    way = scratch.cut(feed.head_way(table(spark, sf_dir, "commits"), table(spark, sf_dir, "repo_heads"), scratch=scratch))
    state = feed.head_state(table(spark, sf_dir, "changes"), way)
    return state.select("repo_id", "elt_id", sum_text("statesum").alias("statesum"))


def p4_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elements of each repository at its head, with their payload."""
    scratch = Scratch(spark)
    way = scratch.cut(feed.head_way(table(spark, sf_dir, "commits"), table(spark, sf_dir, "repo_heads"), scratch=scratch))
    return feed.head_state(table(spark, sf_dir, "changes"), way, ["elt"])


# ---- 5: two copies --------------------------------------------------------------------------


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    def normal(name: str) -> DataFrame:
        t = table(spark, sf_dir, name)
        # a spelling that is no full sum stays as its digits, so that it equals only itself
        full = F.coalesce(sum_bytes("elt_sum"), F.to_binary(digits("elt_sum"), F.lit("utf-8")))
        state = F.coalesce(state_key("statesum"), F.to_binary(digits("statesum"), F.lit("utf-8")))
        return t.select("repo_id", "elt_id", "elt", full.alias("elt_sum"), state.alias("statesum"), "received_at")

    return residues.copy_differences(
        normal("states_north"), normal("states_south"), ["repo_id", "elt_id"], ["elt", "elt_sum", "statesum"], "received_at"
    )


# ---- 6: history -----------------------------------------------------------------------------


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    way = feed.head_way(table(spark, sf_dir, "commits"), table(spark, sf_dir, "repo_heads"), scratch=scratch)
    way = scratch.cut(way.select("repo_id", "id", "dist", "number"))
    longest = way.groupBy("repo_id").agg(F.max("dist").alias("last_pos"))
    placed = way.join(longest, "repo_id").select("repo_id", "id", "number", (F.col("last_pos") - F.col("dist")).alias("pos"), "last_pos")
    rows = feed.applied(table(spark, sf_dir, "changes"), placed, ["pos", "last_pos", "number", "elt", "received_at"])
    return versions.history(rows, scratch)


QUERIES = {
    "p1_found": p1_found, "p1_hierarchy": p1_hierarchy, "p1_descendants": p1_descendants,
    "p2_found": p2_found, "p2_counts": p2_counts, "p2_rows": p2_rows, "p3_found": p3_found,
    "p4_found": p4_found, "p4_state": p4_state, "p5_found": p5_found, "p6_found": p6_found,
}
