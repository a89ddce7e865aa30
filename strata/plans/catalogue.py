"""Queries over the star-schema tables, one per operator of the versioned store.

States are derived from orders: C is the ancestor, A and B two descendants. A log comes from events
(an element per user), the graph of commits from commits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata import policy
from strata.functions import sequences, sums, text
from strata.operators import changes, dag, merge, replay
from strata.operators.ordered import running
from strata.scratch import Scratch
from strata.sources import codec, files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def state(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    k, v = F.col("elt_id"), F.col("elt")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("elt_id"), F.col("o_totalprice").alias("elt"))
    if which == "C":
        return rows.where(k % 7 != 0)
    if which == "A":
        return rows.where((k % 11 != 0) & ((k % 7 != 0) | (k % 3 == 0))).withColumn("elt", F.when(k % 5 == 0, v + 1).otherwise(v))
    return rows.where((k % 13 != 0) & ((k % 7 != 0) | (k % 2 == 0))).withColumn("elt", F.when(k % 4 == 0, v + 2).otherwise(v))


def three(spark, d):
    return [state(spark, d, x) for x in "ABC"]


# ---- reads ----


def state_scan(spark, d):
    return state(spark, d, "A")


def state_count(spark, d):
    return state(spark, d, "A").agg(F.count(F.lit(1)).alias("n_elements"))


def state_any(spark, d):
    one = state(spark, d, "A").limit(1).agg(F.count(F.lit(1)).alias("n"))
    return one.select((F.col("n") > 0).alias("any_avail"))


def get_element(spark, d):
    return state(spark, d, "A").where("elt_id = 12")


def is_avail_set(spark, d):
    wanted = table(spark, d, "customer").select(F.col("c_custkey").alias("elt_id"))
    have = state(spark, d, "A").select("elt_id", F.lit(True).alias("avail"))
    return wanted.join(have, "elt_id", "left").select("elt_id", F.coalesce("avail", F.lit(False)).alias("avail"))


def elements_topn(spark, d):
    return state(spark, d, "A").orderBy(*changes.unsigned_order("elt_id")).limit(20)


def ids_unsigned(spark, d):
    x = table(spark, d, "changes").select("elt_id").distinct()
    return x.select("elt_id", changes.unsigned("elt_id").cast("string").alias("id_text"), changes.next_id("elt_id").alias("next_id"))


# ---- diff and patch ----


def diff_orders(spark, d):
    return changes.diff(state(spark, d, "C"), state(spark, d, "A"))


def diff_summary(spark, d):
    return diff_orders(spark, d).groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.sum("elt_id").alias("ids"))


def diff_identical_empty(spark, d):
    return changes.diff(state(spark, d, "A"), state(spark, d, "A"))


def diff_key_filtered(spark, d):
    wanted = table(spark, d, "customer").select(F.col("c_custkey").alias("elt_id"))
    return changes.diff(state(spark, d, "C"), state(spark, d, "A"), wanted)


def patch_orders(spark, d):
    delta = Scratch(spark).cut(changes.diff(state(spark, d, "C"), state(spark, d, "B")))
    return changes.patch(state(spark, d, "C"), delta)


def patch_roundtrip(spark, d):
    a, c = state(spark, d, "A"), state(spark, d, "C")
    wrong = changes.diff(changes.patch(c, changes.diff(c, a)), a)
    return wrong.agg(F.count(F.lit(1)).alias("n_wrong"))


def patch_violations(spark, d):
    return changes.violations(state(spark, d, "B"), changes.diff(state(spark, d, "C"), state(spark, d, "A")))


def draft_noop_elimination(spark, d):
    pending = state(spark, d, "A").select("elt_id", F.lit("REPL").alias("op"), "elt")
    c = state(spark, d, "C")
    return changes.effective(c, pending.join(c.select("elt_id"), "elt_id", "left_semi"))


def draft_composed(spark, d):
    """Three steps of a draft over the same ids, as one change per id."""
    c, a = state(spark, d, "C"), state(spark, d, "A")
    steps = changes.diff(c, a).withColumn("step", F.lit(1)).unionByName(changes.diff(a, state(spark, d, "B")).withColumn("step", F.lit(2)))
    return changes.composed(steps, "step")


def free_ids_near(spark, d):
    return changes.gaps(state(spark, d, "A"))


# ---- merge ----


def _found(spark, d):
    return merge.conflicts(*three(spark, d))


def merge_conflicts(spark, d):
    return _found(spark, d).select("elt_id", "pa", "pb", "pc")


def _outcomes(solver):
    def run(spark, d):
        return merge.solve(_found(spark, d), solver).select("elt_id", "outcome", "value")

    return run


CHAIN = merge.chain(merge.ancestor, merge.renaming)
FULL = merge.chain(merge.ancestor, merge.renaming, merge.use_a)


def merge_counts(spark, d):
    return merge.summary(merge.solve(_found(spark, d), CHAIN))


def merge_solve_one(spark, d):
    found = merge.solve(_found(spark, d), CHAIN)
    return merge.solve_one(found, 60, merge.use_b).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def _named(spark, d):
    return merge.with_new_ids(merge.solve(_found(spark, d), FULL), three(spark, d))


def merge_changes_vs_a(spark, d):
    return merge.changes_against(_named(spark, d), "A")


def merge_changes_vs_b(spark, d):
    return merge.changes_against(_named(spark, d), "B")


def merge_pick_parent(spark, d):
    got = merge.make_commit(_named(spark, d))
    return got.changes.agg(F.count(F.lit(1)).alias("n_changes")).select(F.lit(got.first_is_a).alias("first_is_a"), "n_changes")


def merge_result(spark, d):
    return changes.patch(state(spark, d, "A"), Scratch(spark).cut(merge_changes_vs_a(spark, d)))


# ---- replay ----


def log(spark, d):
    """An element per user; an error deletes it, anything else inserts or replaces it."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("prev", F.lag("event_type").over(w))
    gone = F.col("prev").isNull() | (F.col("prev") == "error")
    op = F.when((F.col("event_type") == "error") & ~gone, "DEL").when((F.col("event_type") != "error") & gone, "INS").when(F.col("event_type") != "error", "REPL")
    return e.select(F.col("user_id").alias("elt_id"), op.alias("op"), F.when(op != "DEL", F.col("event_type")).alias("elt"), "ts", "event_id").where("op IS NOT NULL")


def replay_latest(spark, d):
    return replay.replay(log(spark, d), ["ts", "event_id"])


def replay_at_commit(spark, d):
    """The state at three fifths of the log."""
    last = table(spark, d, "events").agg(F.max("event_id")).first()[0] or 0
    return replay.replay(log(spark, d), ["ts", "event_id"], until=F.col("event_id") < last * 3 // 5)


def replay_history_of_element(spark, d):
    return replay.history(log(spark, d), ["ts", "event_id"], 7).select("elt_id", "step", "op", "elt", "event_id")


def replay_preconditions(spark, d):
    return replay.broken_preconditions(log(spark, d), ["ts", "event_id"]).agg(F.count(F.lit(1)).alias("n_broken"))


def replay_compacted(spark, d):
    return replay.compacted(log(spark, d), ["ts", "event_id"])


# ---- commit graph ----


def graph(spark, d):
    """All commits, each once: statesum is the leading 32 digits that always name it, full its whole sum; parents likewise short."""
    c = table(spark, d, "commits").select(
        F.hex(sums.state_key("statesum")).alias("statesum"), sums.sum_text(sums.sum_bytes("statesum")).alias("full"), "repo_id", "number", "ext_flags",
        F.when(F.size("parents") > 0, F.transform("parents", lambda p: F.hex(sums.state_key(p)))).alias("parents"),
    )
    one = c.where("full IS NOT NULL").groupBy("statesum").agg(*[F.max(x).alias(x) for x in ("full", "repo_id", "number", "ext_flags", "parents")])
    return Scratch(spark).cut(one)


def tips(spark, d):
    return dag.tips(graph(spark, d)).select(F.col("full").alias("statesum"), "number")


def is_tip_flags(spark, d):
    return dag.with_tip_flag(graph(spark, d)).select(F.col("full").alias("statesum"), "is_tip")


def ancestors(spark, d):
    """All ancestors of the head of each repository, through parents at any position."""
    heads = table(spark, d, "repo_heads").select(F.col("repo_id").alias("label"), F.hex(sums.state_key("head")).alias("statesum"))
    g = graph(spark, d)
    found = dag.ancestors(g, heads.where("label IS NOT NULL AND statesum IS NOT NULL"))
    return found.join(g.select("statesum", "full"), "statesum").select(F.col("label").alias("repo_id"), F.col("full").alias("statesum"))


def common_ancestor(spark, d):
    """Of each repository with several tips, the latest common ancestor of the two that a merge would take next."""
    scratch = Scratch(spark)
    g = graph(spark, d)
    two = dag.first_two_tips(g, "repo_id").groupBy(F.col("repo_id").alias("label")).agg(F.min("statesum").alias("one"), F.max("statesum").alias("two"))
    found = dag.latest_common(g, scratch.cut(two.where("one <> two")), scratch=scratch)
    return found.join(g.select("statesum", "full"), "statesum").select(F.col("label").alias("repo_id"), F.col("full").alias("statesum"), "number")


def commit_numbers(spark, d):
    g = graph(spark, d)
    return dag.numbers(g).join(g.select("statesum", "full"), "statesum").select(F.col("full").alias("statesum"), "number", "expected", "ok")


def merged_flags(spark, d):
    g = graph(spark, d)
    return dag.merged_flags(g).join(g.select("statesum", "full"), "statesum").select(F.col("full").alias("statesum"), "inherited")


def commit_listing(spark, d):
    return dag.listing(graph(spark, d)).select("number", F.col("full").alias("statesum"), F.coalesce(F.size(F.array_compact("parents")), F.lit(0)).alias("n_parents"))


def state_from_prefix(spark, d):
    return dag.by_prefix(graph(spark, d).withColumn("statesum", F.col("full")), "4b 2").select("statesum")


def merge_next_tips(spark, d):
    """The two tips of each repository that a merge takes next."""
    return dag.first_two_tips(graph(spark, d), "repo_id").select("repo_id", F.col("full").alias("statesum"))


# ---- sums ----


def _line_elements(spark, d):
    line = table(spark, d, "lineitem")
    return line.select(F.col("l_orderkey").alias("elt_id"), F.concat_ws("|", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), "l_returnflag").alias("elt"))


def state_sum(spark, d):
    return sums.state_sum(_line_elements(spark, d))


def _digested(rows):
    return rows.select("*", sums.element_digest("elt_id", "elt").alias("elt_sum"))


def _text_state(spark, d, which):
    return state(spark, d, which).select("elt_id", F.col("elt").cast("decimal(18,2)").cast("string").alias("elt"))


def state_sum_incremental(spark, d):
    """The sum of A from that of C and the changes alone."""
    c, a = _text_state(spark, d, "C"), _text_state(spark, d, "A")
    delta = changes.diff(c, a)
    old = c.join(delta.where("op <> 'INS'").select("elt_id"), "elt_id", "left_semi")
    touched = old.unionByName(delta.where("op <> 'DEL'").select("elt_id", "elt"))
    both = sums.state_sum(c).select("elt_sum").unionByName(sums.state_sum(touched).select("elt_sum"))
    lanes = both.select(*sums.lanes(F.col("elt_sum"))).agg(*[F.bit_xor(x).alias(x) for x in sums.LANES])
    return lanes.select(sums.lanes_text(*sums.LANES).alias("elt_sum"))


def running_state_sum(spark, d):
    """The sum of the state after each change of the whole log: the old element's digest goes out, the new one's comes in."""
    from pyspark.sql import Window

    own = Window.partitionBy("elt_id").orderBy("ts", "event_id")
    x = log(spark, d).withColumn("old", F.when(F.col("op") != "INS", sums.element_digest("elt_id", F.lag("elt").over(own))))
    x = x.withColumn("new", F.when(F.col("op") != "DEL", sums.element_digest("elt_id", "elt")))
    none = F.lit("0" * 64)
    pairs = zip(sums.LANES, sums.lanes(F.coalesce("old", none)), sums.lanes(F.coalesce("new", none)))
    x = running(x.select("ts", "event_id", "elt_id", "old", "new"), ["ts", "event_id"], xors={lane: o.bitwiseXOR(n) for lane, o, n in pairs})
    return x.select(F.col("pos").alias("step"), "event_id", "elt_id", sums.lanes_text(*sums.LANES).alias("running"))


def verify_elements(spark, d):
    """Rows of the north copy whose stored sum is missing, malformed or not that of the element, with their number per repository and all its rows and sums.

    A repository without any such row has one row of the counts alone. The tables sum a NULL payload like an empty one.
    """
    n = table(spark, d, "states_north").select("repo_id", "elt_id", "elt", "elt_sum", sums.sum_bytes("elt_sum").alias("stored"))
    n = n.withColumn("digest", sums.element_blake2("elt_id", F.encode(F.coalesce("elt", F.lit("")), "utf-8")))
    problem = F.when(F.col("elt_sum").isNull(), "missing").when(F.col("stored").isNull(), "malformed").when(F.col("stored") != F.col("digest"), "different")
    n = n.withColumn("problem", problem)
    counts = n.groupBy("repo_id").agg(F.count("stored").alias("n"), F.countDistinct("stored").alias("n_sums"), F.count("problem").alias("n_wrong"))
    wrong = n.where("problem IS NOT NULL").select(F.col("repo_id").alias("repo"), "elt_id", "elt_sum", "problem")
    return counts.join(wrong, F.col("repo_id").eqNullSafe(F.col("repo")), "left").drop("repo")


def sum_spellings(spark, d):
    c = table(spark, d, "commits").select(sums.sum_bytes("statesum").alias("s")).distinct()
    return c.select(sums.sum_text("s").alias("statesum"), sums.sum_text("s", pairs=True).alias("pairs"), sums.short_text("s").alias("short"))


def state_sum_blake2(spark, d):
    e = _line_elements(spark, d).select(F.hex(sums.element_blake2("elt_id", F.col("elt").cast("binary"))).alias("h"))
    lanes = e.select(*sums.lanes(F.col("h"))).agg(*[F.bit_xor(x).alias(x) for x in sums.LANES])
    return lanes.select(sums.lanes_text(*sums.LANES).alias("elt_sum"))


# ---- policy, files, sequences ----


def snapshot_policy(spark, d):
    """Commits of each repository, in order of number and sum, after which a snapshot is due; edits are the elements changed."""
    g = graph(spark, d)
    edits = table(spark, d, "changes").select(F.hex(sums.state_key("statesum")).alias("statesum"), "elt_id").where("statesum IS NOT NULL AND elt_id IS NOT NULL")
    edits = edits.distinct().groupBy("statesum").agg(F.count(F.lit(1)).alias("edits"))
    rows = g.join(edits, "statesum", "left").select("repo_id", F.struct(F.coalesce("number", F.lit(-1)).alias("number"), "full").alias("seq"), "edits")
    return policy.due(rows, "repo_id", "seq", "edits").select("repo_id", F.col("seq.full").alias("statesum"))


def _files(spark, d):
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    base = F.concat(F.lower("n_name"), F.lit("-"))
    ss = F.concat(F.when(k % 5 == 0, "").otherwise(base), F.lit("ss"), (k % 4).cast("string"))
    name = F.when(k % 3 == 0, F.concat(ss, F.lit(".pip"))).when(k % 7 == 0, F.concat(ss, F.lit(".txt"))).otherwise(F.concat(ss, F.lit("-cl"), k.cast("string"), F.lit(".piplog")))
    return n.select(name.alias("name")).select("name", text.file_parts(F.col("name")).alias("p")).select("name", "p.*")


def basename_extract(spark, d):
    return _files(spark, d).where("kind IS NOT NULL").select("name", "basename")


def file_catalog(spark, d):
    f = _files(spark, d).where("kind IS NOT NULL")
    return f.agg(
        F.count_if(F.col("kind") == "snapshot").alias("n_snapshots"), F.count_if(F.col("kind") == "log").alias("n_logs"),
        (F.max("ss") + 1).alias("ss_len"), (F.max("cl") + 1).alias("cl_len"),
    )


def _seq(spark, d, elt):
    n = table(spark, d, "nation")
    return n.select(F.col("n_nationkey").cast("bigint").alias("elt_id"), elt(F.col("n_nationkey")).alias("elt")).select("elt_id", F.posexplode("elt").alias("i", "x"))


def gen_arithmetic(spark, d):
    return _seq(spark, d, lambda k: sequences.arithmetic(k, k, F.lit(0.5)))


def gen_geometric(spark, d):
    return _seq(spark, d, lambda k: sequences.geometric(k, F.lit(3.0), F.lit(0.5)))


def gen_fibonacci(spark, d):
    return _seq(spark, d, lambda k: sequences.fibonacci(k, F.lit(1.0), k.cast("double")))


def gen_power(spark, d):
    return _seq(spark, d, lambda k: sequences.power(k, F.lit(2.0)))


def sequence_stats(spark, d):
    n = table(spark, d, "nation").select(sequences.power(F.col("n_nationkey"), F.lit(2.0)).alias("elt"))
    return sequences.statistics(n)


# ---- binary format ----


def codec_roundtrip_snapshot(spark, d):
    rows = _text_state(spark, d, "A").select("elt_id", F.col("elt").cast("binary").alias("data"))
    return files.roundtrip_snapshot(rows, codec.Meta(1, 946684800))


def codec_roundtrip_log(spark, d):
    delta = changes.diff(_text_state(spark, d, "C"), _text_state(spark, d, "A"))
    return files.roundtrip_log(delta.select("elt_id", "op", F.col("elt").cast("binary").alias("data")), codec.Meta(1, 946684800))


QUERIES = {
    f.__name__: f
    for f in (
        state_scan, state_count, state_any, get_element, is_avail_set, elements_topn, ids_unsigned, diff_orders, diff_summary, diff_identical_empty,
        diff_key_filtered, patch_orders, patch_roundtrip, patch_violations, draft_noop_elimination, draft_composed, free_ids_near, merge_conflicts,
        merge_counts, merge_solve_one, merge_changes_vs_a, merge_changes_vs_b, merge_pick_parent, merge_result, replay_latest, replay_at_commit,
        replay_history_of_element, replay_preconditions, replay_compacted, tips, is_tip_flags, ancestors, common_ancestor, commit_numbers, merged_flags,
        commit_listing, state_from_prefix, merge_next_tips, state_sum, state_sum_incremental, running_state_sum, verify_elements, sum_spellings,
        state_sum_blake2, snapshot_policy, basename_extract, file_catalog, gen_arithmetic, gen_geometric, gen_fibonacci, gen_power, sequence_stats,
        codec_roundtrip_snapshot, codec_roundtrip_log,
    )
} | {
    "merge_use_a": _outcomes(merge.use_a), "merge_use_b": _outcomes(merge.use_b), "merge_use_c": _outcomes(merge.use_c), "merge_fail": _outcomes(merge.fail),
    "merge_ancestor": _outcomes(merge.ancestor), "merge_renaming": _outcomes(merge.renaming), "merge_chain": _outcomes(CHAIN),
}
