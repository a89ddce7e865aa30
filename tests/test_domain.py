"""References, snapshots, feeds, copies and histories: dirty input against plain Python."""

import datetime as dt
import random
from collections import Counter

from pyspark.sql import functions as F

from conftest import rows
from strata.operators import feed, references, residues, versions
from strata.scratch import Scratch

T0 = dt.datetime(2024, 1, 1)


def t(i):
    return T0 + dt.timedelta(hours=i)


def sums(k):
    return f"{k:064X}"[::-1]


# ---- 2 ----


def test_orphans_heavy_and_light(spark):
    refs = [("hot", i) for i in range(3000)] + [("gone", i) for i in range(2500)] + [(f"k{i % 40}", i) for i in range(200)] + [(None, 1)]
    r = spark.createDataFrame([(k, i, "extra") for k, i in refs], "key string, n int, gone string")
    live = spark.createDataFrame([("hot",), ("k1",), ("k2",), ("k2",)], "key string")
    got = rows(references.orphans(r, live, max_heavy=4), "key", "n")
    assert got == sorted([x for x in refs if x[0] not in ("hot", "k1", "k2")], key=str)
    months = spark.createDataFrame([(k, t(i * 24 % 2000)) for k, i in refs], "key string, received_at timestamp")
    counted = rows(references.orphan_counts(months.withColumn("src", F.lit("x")), live, ["src"], "received_at", max_heavy=4))
    want = Counter(t(i * 24 % 2000).strftime("%Y-%m") for k, i in refs if k not in ("hot", "k1", "k2"))
    assert counted == sorted((("x", m, n) for m, n in want.items()), key=str)
    assert references.orphan_counts(months.limit(0), live, [], "received_at").count() == 0
    assert references.orphans(r.limit(0), live).count() == 0
    assert references.orphans(r, live.limit(0)).count() == len(refs)


def test_last_row_tells_whether_purged(spark):
    c = spark.createDataFrame(
        [("a", t(1), None), ("a", t(2), t(2)), ("b", t(2), None), ("b", t(1), t(1)), ("c", None, t(1)), ("c", t(0), None), (None, t(1), None), ("d", t(1), None), ("d", t(1), t(9))],
        "key string, received_at timestamp, purged_at timestamp",
    )
    assert rows(references.live_records(c, "key", "received_at", "purged_at")) == [("b",), ("c",)]


# ---- 3 ----


def test_snapshot_changes(spark):
    data = [
        (1, 2, 7, "a", t(1)), (1, 2, 8, None, t(1)), (1, 2, 9, "", t(1)), (1, 2, 10, "old", t(1)), (1, 2, 10, "new", t(2)), (1, 2, 11, "x", t(1)),
        (1, 5, 7, "a", t(3)), (1, 5, 8, "", t(3)), (1, 5, 9, "", t(3)), (1, 5, 9, "", t(3)), (1, 5, 10, "new", t(3)), (1, 5, -1, None, t(3)),
        (1, 9, 7, "A", t(0)), (1, 9, -1, None, t(0)), (2, 5, 7, "z", None), (None, 1, 1, "n", t(1)), (1, None, 1, "n", t(1)), (1, 5, None, "n", t(1)),
    ]
    df = spark.createDataFrame(data, "repo_id bigint, ss bigint, elt_id bigint, elt string, received_at timestamp").withColumnsRenamed({})
    got = rows(residues.snapshot_changes(df, residues.snapshot_sequence(df)))
    want = [(1, 5, 8, "REPL"), (1, 5, 11, "DEL"), (1, 5, -1, "INS"), (1, 9, 7, "REPL"), (1, 9, 8, "DEL"), (1, 9, 9, "DEL"), (1, 9, 10, "DEL")]
    assert got == sorted(want, key=str)
    assert residues.snapshot_changes(df.limit(0), residues.snapshot_sequence(df.limit(0))).count() == 0


# ---- 4, 6 ----


def commits_of(spark, chains):
    data = []
    for repo, ids in chains.items():
        for i, k in enumerate(ids):
            parents = [sums(ids[i - 1])[: 64 if i % 2 else 40].lower()] if i else None
            data.append((repo, sums(k) if i % 3 else " " + sums(k).lower(), 10 * i, None, parents, "clash"))
            data.append((repo, sums(k), None, None, parents, "again"))
    return spark.createDataFrame(data, "repo_id bigint, statesum string, number bigint, ts timestamp, parents array<string>, dist string")


def brute(chain, by_commit):
    """State with the last commit per element, and versions, of one chain of commits."""
    state, last, vers, open_ = {}, {}, [], {}
    for i, k in enumerate(chain):
        for elt_id, op, elt in by_commit.get(k, []):
            if op == "DEL":
                if elt_id in state:
                    vers.append((elt_id, open_.pop(elt_id), 10 * i))
                    del state[elt_id]
            else:
                if elt_id not in state or state[elt_id] != elt:
                    if elt_id in state:
                        vers.append((elt_id, open_[elt_id], 10 * i))
                    open_[elt_id] = 10 * i
                state[elt_id] = elt
                last[elt_id] = k
    return {e: last[e] for e in state}, sorted(vers + [(e, n, -1) for e, n in open_.items()])


def test_feed_and_versions_against_a_fold(spark):
    r = random.Random(3)
    chains = {1: list(range(1, 60)), 2: list(range(100, 104)), 3: [200]}
    by_commit, data = {}, []
    for repo, ids in chains.items():
        for k in [*ids, 900 + repo]:  # the last is on no way
            for e in r.sample(range(-3, 5), 4):
                op = r.choice(["INS", "REPL", "DEL", "REPL"])
                elt = None if op == "DEL" else r.choice([None, "", "a", "b"])
                by_commit.setdefault(k, []).append((e, op, elt))
                spelled = r.choice([op, op.lower(), f" {op} "])
                key = r.choice([sums(k), sums(k)[:32], sums(k).lower()])
                data += [(repo, key, e, spelled, elt, t(k), "c")] * r.choice([1, 1, 2])
    data += [(1, None, 1, "INS", "n", t(1), "c"), (1, sums(3), None, "INS", "n", t(1), "c"), (1, sums(3), 99, None, "n", t(1), "c"), (1, sums(3), 98, "MOVE", "n", t(1), "c")]
    r.shuffle(data)
    ch = spark.createDataFrame(data, "repo_id bigint, statesum string, elt_id bigint, op string, elt string, received_at timestamp, number string")
    heads = spark.createDataFrame([(1, sums(59)[:36], "x"), (2, sums(103), "x"), (3, sums(200), "x"), (4, None, "x")], "repo_id bigint, head string, dist string")
    s = Scratch(spark)
    way = feed.head_way(commits_of(spark, chains), heads, scratch=s).cache()
    assert way.count() == 59 + 4 + 1
    state = [(x["repo_id"], x["elt_id"], bytes(x["statesum"]).hex().upper()) for x in feed.head_state(ch, way).collect()]
    want_state, want_versions = [], []
    for repo, ids in chains.items():
        now, vers = brute(ids, by_commit)
        want_state += [(repo, e, sums(k)) for e, k in now.items()]
        want_versions += [(repo, *v) for v in vers]
    assert sorted(state) == sorted(want_state)

    longest = way.groupBy("repo_id").agg(F.max("dist").alias("last_pos"))
    placed = way.join(longest, "repo_id").select("repo_id", "id", "number", (F.col("last_pos") - F.col("dist")).alias("pos"), "last_pos")
    applied = feed.applied(ch.drop("number"), placed, ["pos", "last_pos", "number", "elt", "received_at"])
    for block, batch in ((4096, 10_000), (4096, 3), (5, 3), (1, 10_000), (7, 1)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        assert rows(versions.history(applied, s, block=block)) == sorted(want_versions, key=str), (block, batch)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    assert versions.history(applied.limit(0), s).count() == 0
    assert feed.head_state(ch.limit(0), way).count() == 0


def test_base_under_the_feed(spark):
    way = spark.createDataFrame([(1, bytearray(bytes.fromhex(sums(1)[:32])), 0, "w")], "repo_id bigint, id binary, dist bigint, statesum string")
    ch = spark.createDataFrame([(sums(1), 5, "DEL", None, t(1)), (sums(1), 6, "REPL", "new", t(1))], "statesum string, elt_id bigint, op string, elt string, received_at timestamp")
    base = spark.createDataFrame([(1, 5, "a"), (1, 6, "b"), (1, 7, None)], "repo_id bigint, elt_id bigint, elt string")
    assert rows(feed.head_state(ch, way, ["elt"], base)) == [(1, 6, "new"), (1, 7, None)]


# ---- 5 ----


def test_copy_differences(spark):
    schema = "repo_id bigint, elt_id bigint, elt string, elt_sum string, received_at timestamp, side string, plus string"
    n = [(1, 1, "a", "s", t(1)), (1, 2, None, "s", t(1)), (1, 3, "old", "s", t(1)), (1, 3, "x", "s", t(2)), (1, 4, "x", None, t(1)), (1, 5, "x", "s", t(1)), (1, 5, "x", "s", t(1)), (None, 6, "x", "s", t(1))]
    s = [(1, 1, "a", "s", t(5)), (1, 2, "", "s", t(1)), (1, 3, "x", "s", t(1)), (1, 4, "y", "q", t(1)), (1, 7, None, None, t(1)), (1, None, "x", "s", t(1))]
    a, b = (spark.createDataFrame([(*x, "c", "c") for x in d], schema) for d in (n, s))
    got = rows(residues.copy_differences(a, b, ["repo_id", "elt_id"], ["elt", "elt_sum"], "received_at"))
    assert got == sorted([(1, 2, "elt"), (1, 4, "elt"), (1, 4, "elt_sum"), (1, 5, "missing_south"), (1, 7, "missing_north")], key=str)
    assert residues.copy_differences(a.limit(0), b.limit(0), ["repo_id", "elt_id"], ["elt"], "received_at").count() == 0


def test_hot_keys_move_once(spark):
    """Comparison and snapshot diff shuffle rows once; nothing is gathered by repository alone."""
    df = spark.createDataFrame([(1, 1, 1, "a", t(1))], "repo_id bigint, ss bigint, elt_id bigint, elt string, received_at timestamp")
    seq = Scratch(spark).cut(residues.snapshot_sequence(df))
    plan = residues.snapshot_changes(df, F.broadcast(seq))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(repo_id" in plan and ", elt_id" in plan
