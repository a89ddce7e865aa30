"""Queries over whole tables, on small ones and against brute force."""

import hashlib

from conftest import rows
from strata import policy
from strata.operators import dag
from strata.plans import catalogue, domain
from strata.scratch import Scratch

def sha(k):
    return hashlib.sha256(str(k).encode()).hexdigest().upper()


# ---- commit graph ----


def table(spark, up, number=lambda k: k):
    data = [(str(k), [str(p) for p in ps], number(k), k % 4) for k, ps in up.items()]
    return spark.createDataFrame(data, "statesum string, parents array<string>, number bigint, ext_flags int")


def above(up, k):
    seen, todo = set(), [k]
    while todo:
        if (x := todo.pop()) not in seen and x in up:
            seen.add(x)
            todo += up[x]
    return seen


def test_ancestors_of_several_starts(spark):
    up = {k: [] if k == 0 else [max(k - 5, 0) if k % 40 == 39 else k - 1] + [k - 7] * (k % 10 == 0) + [9999] * (k % 9 == 0) for k in range(400)}
    up |= {500: [501], 501: [502, 20], 502: [500]}  # a cycle above a history
    starts = spark.createDataFrame([("a", "399"), ("a", "38"), ("b", "501"), ("c", "7"), ("d", "x")], "label string, statesum string")
    want = {("a", str(k)) for k in above(up, 399) | above(up, 38)} | {("b", str(k)) for k in above(up, 501)} | {("c", str(k)) for k in above(up, 7)}
    for number in (lambda k: k, lambda k: None, lambda k: -k % 13):
        assert rows(dag.ancestors(table(spark, up, number), starts)) == sorted(want, key=str)
    pairs = spark.createDataFrame([("p", "399", "38"), ("q", "7", "7"), ("r", "500", "0"), ("s", "500", "399"), ("t", "9", "x")], "label string, one string, two string")
    both = lambda x, y: max(above(up, x) & above(up, y))
    want = [("p", str(both(399, 38)), both(399, 38)), ("q", "7", 7), ("r", "0", 0), ("s", str(both(500, 399)), both(500, 399))]
    assert rows(dag.latest_common(table(spark, up), pairs)) == sorted(want, key=str)
    assert dag.ancestors(table(spark, up), starts.limit(0)).count() == 0


def test_rounds_of_ancestors_do_not_grow_with_the_history(spark):
    """Histories continued by second parents, and ladders, take logarithmically many tables."""

    def tables(up, start):
        s = Scratch(spark)
        t = table(spark, up)
        starts = spark.createDataFrame([("x", str(start))], "label string, statesum string")
        assert {int(x) for _, x in rows(dag.ancestors(t, starts, scratch=s))} == above(up, start)
        return s._n

    second = {k: [1000 + k, k - 1] if k else [] for k in range(300)} | {1000 + k: [k - 2] if k > 2 else [] for k in range(300)}
    ladder = {2 * i + a: [2 * i - 2, 2 * i - 1] if i else [] for i in range(150) for a in (0, 1)}
    assert tables(second, 299) < 50 and tables(ladder, 299) < 50


# ---- hierarchies ----


def test_descendants_on_and_below_cycles(spark, tmp_path):
    up = {i: i - 1 for i in range(1, 40)} | {0: None} | {100 + i: 100 + (i + 1) % 5 for i in range(5)} | {200: 200, 201: 200}
    up |= {300: 102, 301: 300, 302: 301, 303: 300}
    data = [(1, sha(k), k, [] if p is None else [sha(p)]) for k, p in up.items()]
    c = spark.createDataFrame(data, "repo_id bigint, statesum string, number bigint, parents array<string>")
    c.selectExpr("*", "timestamp_ntz'2024-01-01' AS ts", "timestamp_ntz'2024-01-01' AS received_at", "cast(NULL AS timestamp_ntz) AS purged_at").write.parquet(f"{tmp_path}/commits.parquet")
    want = set()
    for k in up:
        seen, x, n = set(), up[k], 1
        while x is not None and x not in seen:
            seen.add(x)
            want.add((sha(x), sha(k), n))
            x, n = up[x], n + 1
    assert rows(domain.p1_descendants(spark, str(tmp_path))) == sorted(want, key=str)
    got = dict(rows(domain.p1_hierarchy(spark, str(tmp_path)), "statesum", "n_descendants"))
    assert got == {sha(k): sum(a == sha(k) for a, _, _ in want) for k in up}


# ---- sums ----


def test_wrong_sums_are_found(spark, tmp_path):
    from strata.functions.sums import blake2

    good = lambda i, x: blake2(i, x.encode()).hex()
    data = [
        (1, 5, "a", good(5, "a")), (1, 6, "\u00e4", " " + good(6, "\u00e4").upper()), (1, -7, "b", good(-7, "c")), (1, 8, "", None), (1, 9, "x", good(9, "x")[:40]),
        (1, 10, "y", "Z" * 64), (2, 5, "a", good(5, "a")), (2, 5, "a", good(5, "a")), (2, 6, None, good(6, "")), (3, 1, None, None), (4, 1, None, good(1, "x")),
    ]
    spark.createDataFrame(data, "repo_id bigint, elt_id bigint, elt string, elt_sum string").write.parquet(f"{tmp_path}/states_north.parquet")
    got = rows(catalogue.verify_elements(spark, str(tmp_path)), "repo_id", "elt_id", "problem", "n", "n_sums", "n_wrong")
    want = [(1, -7, "different", 3, 3, 4), (1, 8, "missing", 3, 3, 4), (1, 9, "malformed", 3, 3, 4), (1, 10, "malformed", 3, 3, 4), (2, None, None, 3, 2, 0), (3, 1, "missing", 0, 0, 1), (4, 1, "different", 1, 1, 1)]
    assert got == sorted(want, key=str)


def test_running_sum_of_the_whole_log(spark, tmp_path):
    import random

    r = random.Random(3)
    data = [(i, r.randrange(40), r.randrange(12), r.choice(["error", "click", "view"])) for i in range(400)]
    e = spark.createDataFrame(data, "event_id bigint, t int, user_id bigint, event_type string")
    e.selectExpr("event_id", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, t) AS ts", "user_id", "event_type").write.parquet(f"{tmp_path}/events.parquet")
    state, want = {}, []
    for i, t, u, kind in sorted(data, key=lambda x: (x[1], x[0])):
        if kind == "error" and u not in state:
            continue
        state.pop(u, None)
        if kind != "error":
            state[u] = int(hashlib.sha256(f"{u:016X}P{kind}".encode()).hexdigest(), 16)
        total = 0
        for x in state.values():
            total ^= x
        want.append((len(want) + 1, i, u, f"{total:064X}"))
    assert rows(catalogue.running_state_sum(spark, str(tmp_path))) == sorted(want, key=str)


# ---- policy ----


def test_snapshots_are_due_as_a_walk_says(spark):
    import random

    r = random.Random(4)
    data = [(g, i, r.choice([None, 0, 1, 3, 40, 200])) for g, n in ((1, 700), (2, 1), (3, 60), (4, 9)) for i in range(n)] + [(5, 0, 500), (None, 1, 9), (6, None, 900)]
    weight, want = {}, []
    for g, i, e in sorted((x for x in data if None not in x[:2]), key=lambda x: x[:2]):
        weight[g] = weight.get(g, 0) + 5 + (e or 0)
        if weight[g] > 150:
            want.append((g, i))
            weight[g] = 0
    df = spark.createDataFrame(data, "g bigint, i bigint, e int")
    assert rows(policy.due(df, "g", "i", "e")) == sorted(want, key=str)
    assert policy.due(df.limit(0), "g", "i", "e").count() == 0
