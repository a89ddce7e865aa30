"""Forests, cycles and ways against plain walks."""

import random

from pyspark.sql import functions as F

from conftest import rows
from strata.operators.hierarchy import cycle_members, descendants, hierarchy, way_from


def closure(edges):
    nxt = {}
    for a, b in edges:
        nxt.setdefault(a, set()).add(b)
    out = {}
    for a in nxt:
        seen, todo = set(), list(nxt[a])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += nxt.get(x, ())
        out[a] = seen
    return out


def on_cycles(edges):
    reach = closure(edges)
    return {a for a in reach if a in reach[a]}, reach


def walk(parents, x):
    path = [x]
    while (p := parents.get(path[-1])) is not None and p in parents:
        if p in path:
            return None
        path.append(p)
    return path[::-1]


def test_forest_with_cycles_nulls_repeats_and_clashing_columns(spark):
    r = random.Random(5)
    parents = {i: (r.randrange(i) if i and r.random() > 0.1 else None) for i in range(120)}
    parents |= {500 + i: 500 + (i + 1) % 7 for i in range(7)}  # a cycle of 7
    parents |= {600: 600, 601: 600, 602: 503, 603: 602, 700: 9999}  # self loop, below cycles, missing parent
    data = [(k, p, "x", 1, None) for k, p in parents.items()]
    data += [(3, None, "again", 2, None), (None, 4, "no id", 3, None), (5, parents[5], "x", 1, "same")]
    df = spark.createDataFrame(data, "id bigint, up bigint, root string, depth int, path string")
    tree = hierarchy(df, "id", "up", with_counts=True).cache()
    got = {x["id"]: x for x in tree.collect()}
    assert set(got) == set(parents)
    for k in parents:
        path = walk(parents, k)
        if path is None:
            assert got[k]["path"] is None and got[k]["root"] is None and got[k]["depth"] is None
            assert got[k]["status"] == ("cycle" if k in {*range(500, 507), 600} else "below_cycle")
        else:
            assert got[k]["path"] == path and got[k]["root"] == path[0] and got[k]["depth"] == len(path) - 1 and got[k]["status"] == "tree"
    want = sorted((a, k, len(p) - 1 - i) for k in parents if (p := walk(parents, k)) for i, a in enumerate(p[:-1]))
    assert rows(descendants(tree)) == sorted(want, key=str)
    counts = {k: sum(a == k for a, _, _ in want) for k in parents if walk(parents, k)}
    assert dict(rows(tree.where("status = 'tree'"), "id", "n_descendants")) == counts
    plain = hierarchy(df, "id", "up", with_path=False)
    assert plain.columns == ["id", "parent", "root", "depth", "status"] and plain.count() == len(parents)


def test_empty_forest(spark):
    assert hierarchy(spark.createDataFrame([], "id string, up string"), "id", "up").count() == 0


def test_cycle_members_of_random_graphs(spark):
    r, edges, ranks = random.Random(11), [], []
    for g in range(60):  # many small graphs of all densities at once
        n = r.randrange(2, 14)
        for _ in range(r.randrange(1, 3 * n)):
            edges.append((100 * g + r.randrange(n), 100 * g + r.randrange(n)))
        ranks += [(100 * g + i, g, r.choice([None, i, i, i, r.randrange(n)])) for i in range(n)]
    # a long history with merges and one link back, a ladder without cycles, a figure of eight
    edges += [(10_000 + i, 10_000 + i - 1) for i in range(1, 200)] + [(10_000 + i, 10_000 + i - 3) for i in range(10, 200, 10)] + [(10_020, 10_150)]
    edges += [(20_000 + i, 20_000 + i - d) for i in range(2, 60) for d in (1, 2)]
    edges += [(30_000, 30_001), (30_001, 30_000), (30_001, 30_002), (30_002, 30_003), (30_003, 30_001)]
    ranks += [(10_000 + i, -1, i) for i in range(200)] + [(20_000 + i, -2, i) for i in range(60)] + [(30_000 + i, -3, 0) for i in range(4)]
    edges += [(40_000, 100), (100, 40_000)]  # across groups
    ranks += [(40_000, -4, 3)]
    want, reach = on_cycles(edges)
    e = spark.createDataFrame([*edges, *edges[:5], (1, None), (None, 1)], "child bigint, parent bigint")
    for rk in (None, spark.createDataFrame(ranks, "id bigint, grp bigint, rank bigint")):
        got = dict(rows(cycle_members(e, rk)))
        assert set(got) == want
        for a in want:  # equal labels exactly within a strongly connected component
            for b in reach[a] & want:
                assert (got[a] == got[b]) == (a in reach[b])


def test_cycle_members_without_cycles_or_rows(spark):
    e = spark.createDataFrame([(i, i - 1) for i in range(1, 50)], "child bigint, parent bigint")
    assert cycle_members(e).count() == 0
    assert cycle_members(e.limit(0)).count() == 0


def test_ways(spark):
    links = spark.createDataFrame([(i, i - 1) for i in range(1, 100)] + [(200, 201), (201, 200), (None, 3), (7, 6)][:3], "id bigint, parent bigint")
    heads = spark.createDataFrame([("a", 70), ("b", 3), ("c", 200), ("d", 12345), ("e", None)], "key string, id bigint")
    got = rows(way_from(heads, links))
    want = [("a", 70 - i, i) for i in range(71)] + [("b", 3 - i, i) for i in range(4)] + [("c", 200, 0), ("c", 201, 1), ("d", 12345, 0)]
    assert got == sorted(want, key=str)


def test_rounds_are_logarithmic(spark):
    from strata.scratch import Scratch

    s = Scratch(spark)
    df = spark.range(1, 500).select(F.col("id"), (F.col("id") - 1).alias("up"))
    assert hierarchy(df, "id", "up", scratch=s).agg(F.max("depth")).first()[0] == 498
    assert s._n < 30  # 9 doublings for depths, 5 for segments, 4 for waypoints


def test_rounds_of_cycles_are_logarithmic(spark):
    """Ladders, chains of merges and histories with links back take few rounds, with and without ranks."""
    from strata.scratch import Scratch

    def tables(edges, want):
        s = Scratch(spark)
        got = {x[0] for x in rows(cycle_members(spark.createDataFrame(edges, "child bigint, parent bigint"), scratch=s))}
        assert got == want
        return s._n

    n = 512
    ladder = [(2 * i + a, 2 * i + 2 + b) for i in range(n) for a in (0, 1) for b in (0, 1)]
    assert tables(ladder, set()) < 60
    assert tables([(a, b) for a, b in ladder if b < 64], set()) < 50
    merges = [(i, i + 1) for i in range(n)] + [(i, 10_000 + i) for i in range(n)] + [(10_000 + i, i + 5) for i in range(n - 5)]
    assert tables(merges, set()) < 120
    back = merges + [(n, 0)]
    assert tables(back, {*range(n + 1), *range(10_000, 10_000 + n - 5)}) < 120
    pairs = [(i, i + 1) for i in range(200)] + [(i + 1, i) for i in range(200)]  # a chain of cycles of two
    assert tables(pairs, set(range(201))) < 200
