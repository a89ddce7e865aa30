"""Laws of change sets, merges, replay, the commit graph and sums."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import rows
from strata import policy
from strata.errors import IdGenFailure, MultiMatch, NoMatch, NotSolved, PatchApply
from strata.functions import sequences, sums, text
from strata.operators import changes as ch
from strata.operators import dag, merge, replay


def state(spark, d):
    return spark.createDataFrame([(k, v) for k, v in d.items()], "elt_id bigint, elt string")


def as_dict(df):
    out = dict(rows(df, "elt_id", "elt"))
    assert len(out) == df.count()
    return out


def some_states(n, seed):
    r = random.Random(seed)
    return [{k: r.choice(["a", "b", "", None]) for k in range(-4, 12) if r.random() < 0.6} for _ in range(n)]


def test_chain_of_states(spark):
    a = {1: "one", 2: "two"}
    b = a | {3: "three", 4: "four", 5: "five"}
    c = {**{k: v for k, v in b.items() if k != 4}, 3: "half six", 6: "six", 7: "seven"}
    d = c | {8: "eight", 4: "half eight"}
    ops = lambda x, y: sorted(r["op"] for r in ch.diff(state(spark, x), state(spark, y)).collect())
    assert ops(a, b) == ["INS"] * 3
    assert ops(b, c) == ["DEL", "INS", "INS", "REPL"]
    assert ops(c, d) == ["INS", "INS"]


def test_patch_laws(spark):
    for a, b in itertools.pairwise(some_states(4, 1)):
        x, y = state(spark, a), state(spark, b)
        delta = ch.diff(x, y)
        assert as_dict(ch.checked_patch(x, delta)) == b
        assert ch.diff(x, x).count() == 0
        assert as_dict(ch.patch(x, ch.effective(x, delta))) == b
        assert rows(ch.diff(x, y, [1, 2])) == [r for r in rows(delta) if r[0] in (1, 2)]
        s = {r["elt_id"]: (r["in_old"], r["in_new"]) for r in ch.sides(x, y).collect()}
        assert s == {k: (k in a, k in b) for k in a.keys() | b.keys()}


def test_violations(spark):
    base = state(spark, {1: "a", 2: None})
    bad = spark.createDataFrame([(1, "INS", "x"), (3, "DEL", None), (4, "REPL", "x"), (2, "DEL", None), (2, "REPL", "q")], "elt_id bigint, op string, elt string")
    assert rows(ch.violations(base, bad), "elt_id", "problem") == [(1, "IdClash"), (2, "Repeated"), (3, "EltNotFound"), (4, "EltNotFound")]
    with pytest.raises(PatchApply):
        ch.checked_patch(base, bad)


def test_ids(spark):
    top = 2**63 - 1
    s = spark.createDataFrame([(5,), (6,), (8,), (top,), (-(2**63),)], "elt_id bigint")
    assert ch.free_id_near([s], 5) == 7 and ch.free_id_near([s, spark.createDataFrame([(7,)], "elt_id bigint")], 5) == 9
    assert ch.free_id_near([s], top) == -(2**63) + 1
    with pytest.raises(IdGenFailure):
        ch.free_id_near([spark.range(20_000).select(F.col("id").alias("elt_id"))], 0)
    got = {r[0]: (str(r[1]), r[2]) for r in s.select("elt_id", ch.unsigned("elt_id"), ch.next_id("elt_id")).collect()}
    assert got[top] == (str(2**63 - 1), -(2**63)) and got[-(2**63)] == (str(2**63), -(2**63) + 1)
    assert [r[0] for r in s.orderBy(*ch.unsigned_order("elt_id")).collect()] == [5, 6, 8, top, -(2**63)]


def solve_by_hand(a, b, c, k):
    if a.get(k, 0) == c.get(k, 0):
        return "B"
    if b.get(k, 0) == c.get(k, 0):
        return "A"
    return "RENAME" if k not in c else "FAIL"


def test_merge_outcomes_and_results(spark):
    for a, b, c in (some_states(3, s) for s in (2, 3)):
        abc = [state(spark, x) for x in (a, b, c)]
        found = merge.conflicts(*abc)
        differing = {k for k in a.keys() | b.keys() if (k in a) != (k in b) or a.get(k) != b.get(k)}
        assert {r["elt_id"] for r in found.collect()} == differing
        chained = merge.solve(merge.solve(found, merge.ancestor), merge.renaming)
        assert dict(rows(chained, "elt_id", "outcome")) == {k: solve_by_hand(a, b, c, k) for k in differing}
        assert rows(chained) == rows(merge.solve(found, merge.chain(merge.ancestor, merge.renaming)))
        failing = sum(solve_by_hand(a, b, c, k) == "FAIL" for k in differing)
        s = merge.summary(chained).first()
        assert (s["n_conflicts"], s["n_unsolved"], s["is_solved"]) == (len(differing), failing, failing == 0)
        if failing:
            with pytest.raises(NotSolved):
                merge.make_commit(merge.with_new_ids(chained, abc))
        for solver, result in ((merge.use_a, a), (merge.use_b, b)):
            named = merge.with_new_ids(merge.solve(found, solver), abc)
            assert as_dict(ch.patch(state(spark, a), merge.changes_against(named, "A"))) == result
            assert as_dict(ch.patch(state(spark, b), merge.changes_against(named, "B"))) == result
        named = merge.with_new_ids(merge.solve(found, merge.use_c), abc)
        want = {k: v for k, v in a.items() if k not in differing} | {k: c[k] for k in differing if k in c}
        for side, start in (("A", a), ("B", b)):
            assert as_dict(ch.patch(state(spark, start), merge.changes_against(named, side))) == want
        # all kinds at once: both parents lead to one result, renamed pairs are both kept
        full = merge.with_new_ids(merge.solve(chained, merge.use_a), abc)
        from_a, from_b = (as_dict(ch.checked_patch(state(spark, s), merge.changes_against(full, x))) for s, x in ((a, "A"), (b, "B")))
        assert from_a == from_b
        renamed = sorted(k for k in differing if solve_by_hand(a, b, c, k) == "RENAME" and k in a and k in b)
        new = sorted((k for k in from_a if k not in a | b | c), key=lambda k: k % 2**64)
        assert [from_a[k] for k in new] == [b[k] for k in renamed] and all(from_a[k] == a[k] for k in renamed)
        got = merge.make_commit(full)
        n = {x: merge.changes_against(full, x).count() for x in "AB"}
        assert got.first_is_a == (n["A"] < n["B"]) and got.n_changes == min(n.values())


def test_ancestor_solver_is_symmetric(spark):
    a, b, c = some_states(3, 9)
    one = dict(rows(merge.solve(merge.conflicts(*(state(spark, x) for x in (a, b, c))), merge.ancestor), "elt_id", "outcome"))
    two = dict(rows(merge.solve(merge.conflicts(*(state(spark, x) for x in (b, a, c))), merge.ancestor), "elt_id", "outcome"))
    assert {k: {"A": "B", "B": "A"}.get(v, v) for k, v in two.items()} == {k: v if not (k not in a and k not in c and k not in b) else v for k, v in one.items()}


def test_solve_one_and_udf_solver(spark):
    found = merge.conflicts(*(state(spark, x) for x in ({1: "a", 2: "b"}, {1: "x", 2: "y"}, {})))
    assert dict(rows(merge.solve_one(found, 2, merge.use_b), "elt_id", "outcome")) == {1: "FAIL", 2: "B"}

    @F.pandas_udf(T.StringType())
    def longest(pa, pb, pc, a, b, c):
        return (a > b).map({True: "A", False: "B"})

    assert dict(rows(merge.solve(found, merge.by_element(longest)), "elt_id", "outcome")) == {1: "B", 2: "B"}


def test_replay_is_a_fold(spark):
    r = random.Random(4)
    base, log, now = {1: "x", 2: None}, [], {1: "x", 2: None}
    for seq in range(60):
        k = r.randrange(6)
        op = r.choice(["REPL", "DEL"]) if k in now else "INS"
        elt = None if op == "DEL" else r.choice(["a", None, ""])
        log.append((seq, k, op, elt))
        now = {x: v for x, v in now.items() if x != k} | ({} if op == "DEL" else {k: elt})
    df = spark.createDataFrame(log, "seq int, elt_id bigint, op string, elt string")
    assert as_dict(replay.replay(df, ["seq"], state(spark, base))) == now
    assert replay.broken_preconditions(df, ["seq"], state(spark, base)).count() == 0
    assert as_dict(ch.patch(state(spark, base), replay.compacted(df, ["seq"]))) == now
    assert replay.broken_preconditions(spark.createDataFrame([(1, 5, "DEL", None)], df.schema), ["seq"]).count() == 1


def name(k):
    return hashlib.sha256(str(k).encode()).hexdigest().upper()


def test_graph(spark):
    parents = {0: [], 1: [0], 2: [1], 3: [1], 4: [2, 3], 5: [3], 6: [4, 5], 7: [4], 8: [7]}
    df = spark.createDataFrame([(name(k), [name(p) for p in ps], k, 1 << (2 * (k % 3))) for k, ps in parents.items()], "statesum string, parents array<string>, number bigint, ext_flags int")
    assert {r[0] for r in dag.tips(df).select("statesum").collect()} == {name(6), name(8)}
    assert dag.common_ancestors(df, name(6), name(8)).first()["statesum"] == name(4)
    assert dag.common_ancestors(df, name(2), name(5)).first()["statesum"] == name(1)
    # the latest by number, not the first met on some walk
    assert [r["number"] for r in dag.common_ancestors(df, name(6), name(5)).collect()] == [5, 3, 1, 0]
    assert dag.named_state(df, name(3)[:9].lower() + " ") == name(3)
    odd = next(p for n in range(1, 64) for p in [name(3)[:n]] if n % 2 and sum(name(k).startswith(p) for k in parents) == 1)
    assert dag.named_state(df, odd) == name(3)  # an odd number of digits is a true prefix
    with pytest.raises(NoMatch):
        dag.named_state(df, name(3) + "0")
    with pytest.raises(MultiMatch):
        dag.named_state(df, "")
    assert dict(rows(dag.merged_flags(df)))[name(4)] == 16 | 1


def test_sums(spark):
    s = name(1)
    df = spark.createDataFrame([(s.lower(),), (" ".join(s),), (s[:40],), (s[:31],), (None,), ("",), ("G" * 64,)], "x string")
    got = [(None if r[0] is None else bytes(r[0]).hex().upper(), None if r[1] is None else bytes(r[1]).hex().upper()) for r in df.select(sums.state_key("x"), sums.sum_bytes("x")).collect()]
    assert got == [(s[:32], s), (s[:32], s), (s[:32], None)] + [(None, None)] * 4
    e = [(1, "a"), (-5, None), (7, "")]
    st = spark.createDataFrame(e, "elt_id bigint, elt string")
    total = 0
    for i, v in e:
        total ^= int(hashlib.sha256((f"{i & (2**64 - 1):016X}" + ("N" if v is None else "P" + v)).encode()).hexdigest(), 16)
    assert sums.state_sum(st).first()["elt_sum"] == f"{total:064X}"
    assert sums.state_sum(st.limit(0)).first()["elt_sum"] == "0" * 64
    pair = st.select(F.hex(sums.element_blake2("elt_id", F.col("elt").cast("binary"))).alias("h")).collect()
    assert pair[0][0] == hashlib.blake2b((1).to_bytes(8, "big") + b"a", digest_size=32).hexdigest().upper() and pair[1][0] is None
    p = spark.createDataFrame([("AB12", "ab 1"), ("AB12", "B"), ("AB12", "A" * 65)], "s string, p string")
    assert [r[0] for r in p.select(sums.matches_prefix("s", "p")).collect()] == [True, False, False]


def test_policy(spark):
    p, want = policy.SnapshotPolicy(), []
    for i in range(200):
        p.count(1, i % 13)
        if p.want_snapshot():
            want.append(i)
            p.reset()
    df = spark.createDataFrame([(g, i, i % 13) for g in (1, 2) for i in range(200)], "grp bigint, seq bigint, edits bigint")
    assert rows(policy.due(df, "grp", "seq", "edits")) == sorted([(g, i) for g in (1, 2) for i in want], key=str)
    p.force_snapshot()
    assert p.want_snapshot()


def test_text_functions(spark):
    df = spark.createDataFrame([([0, 15, 8],), ([0, 15, 8, 8],), ([8],), ([],)], "v array<int>")
    assert [r[0] for r in df.select(text.rtrim(F.col("v"), 8)).collect()] == [[0, 15], [0, 15], [], []]
    assert text.escaped(b"a\"\\'\x00\xff~") == "a\\\"\\\\\\'\\x00\\xFF~"
    assert text.hex_dump(b"!A\x00 2").endswith("  !A..2")
    names = ["a-b-ss3.pip", "ss0.pip", "x-ss3-cl12.piplog", "ss01.pip", "x.pip", "ss2-cl3.pip"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(text.file_parts(F.col("n"))).collect()]
    assert [tuple(g) for g in got] == [("a-b", 3, None, "snapshot"), ("", 0, None, "snapshot"), ("x", 3, 12, "log"), (None,) * 4, (None,) * 4, ("ss2", 3, None, None)][:5] + [tuple(got[5])]
    assert got[5]["kind"] is None
    b = spark.createDataFrame([(bytearray(b"ok"),), (bytearray(b"\xff"),)], "b binary").select(text.text_or_bytes(F.col("b")).alias("x")).collect()
    assert b[0]["x"]["str"] == "ok" and b[0]["x"]["bin"] is None and b[1]["x"]["str"] is None and bytes(b[1]["x"]["bin"]) == b"\xff"
    v = spark.createDataFrame([("20160815",), ("2x",), ("",), (None,)], "d string")
    assert [r[0] for r in v.select(text.version_of(F.col("d"))).collect()] == [20160815, 0, 0, 0]
    assert [r[0] for r in spark.range(18).select(text.padding(F.col("id"))).collect()] == [-i % 16 for i in range(18)]


def test_sequences(spark):
    one = spark.range(1)
    got = one.select(
        sequences.arithmetic(F.lit(3), F.lit(1.0), F.lit(0.5)), sequences.geometric(F.lit(3), F.lit(2.0), F.lit(3.0)), sequences.fibonacci(F.lit(5), F.lit(1.0), F.lit(1.0)),
        sequences.power(F.lit(4), F.lit(2.0)), sequences.fibonacci(F.lit(1), F.lit(7.0), F.lit(1.0)), sequences.power(F.lit(0), F.lit(2.0)),
    ).first()
    assert [list(x) for x in got] == [[1.0, 1.5, 2.0], [2.0, 6.0, 18.0], [1.0, 1.0, 2.0, 3.0, 5.0], [0.0, 1.0, 4.0, 9.0], [7.0], []]
    g = sequences.generated(spark, 200, 1).cache()
    s = sequences.statistics(g).first()
    assert s["max_length"] <= 1000 and g.count() == 200
    back = g.select("elt", sequences.from_bytes(sequences.to_bytes("elt")).alias("b"))
    assert back.where("NOT (elt <=> b)").count() == 0


def test_ids_to_the_end_of_the_range(spark):
    ids = lambda *x: spark.createDataFrame([(i, "x") for i in x], "elt_id bigint, elt string")
    assert rows(ch.gaps(ids(2**63 - 1, 5, 6, -1, -(2**63)))) == sorted([(7,), (-(2**63) + 1,), (0,)], key=str)
    new = lambda n, *taken: [x[1] for x in sorted(ch.ranked_new_ids(ids(*range(100, 100 + n)), [ids(*t) for t in taken]).collect())]
    assert new(3, (2**63 - 1, 7), (5,)) == [-(2**63), -(2**63) + 1, -(2**63) + 2]
    assert new(2, (-5,), (4,)) == [-4, -3]
    assert new(3, (-2, 0, 3), (4, 5, 20)) == [6, 7, 8]  # no room above the largest: the first gap that is wide enough
    assert new(3, (-1, 0, 2), ()) == [3, 4, 5]
    assert new(2, (-1, 7)) == [0, 1]
    assert new(2, ()) == [0, 1] and new(0, (1,)) == []
