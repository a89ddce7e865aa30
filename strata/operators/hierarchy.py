"""Parent-child links to full hierarchies, by pointer doubling.

``hierarchy``  path, depth and root of every node of a forest, and the nodes on or under cycles.
``cycle_members``  the nodes of any directed graph that are their own ancestors.
``way_from``  all ancestors of given nodes along single parents, with their distance.

All rounds are joins on evenly spread node ids. Each round doubles the length of the jumps, so a
chain of n links takes log2(n) rounds. No group of rows is ever gathered in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.scratch import Scratch

#: Paths are put together from segments of so many nodes.
WAYPOINT = 32


def hierarchy(nodes: DataFrame, id: str, parent: str, *, with_path: bool = True, with_counts: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """One row per node: id, parent, root, depth, path (root first), status.

    status is 'tree', 'cycle' (the node is its own ancestor) or 'below_cycle' (it hangs below such
    a node); root, depth and path are NULL for the latter two. ``with_counts`` adds n_descendants,
    the number of nodes below, NULL for the latter two (see :func:`loop_descendants`).

    Rows with a NULL id are ignored. Of several rows of one id the greatest non-NULL parent counts.
    A parent that is NULL or not among the ids makes the node a root. An empty table gives an
    empty result. Other columns of ``nodes`` are ignored, whatever their names.
    """
    scratch = scratch or Scratch(nodes.sparkSession)
    links = (
        nodes.select(F.col(id).alias("id"), F.col(parent).alias("parent"))
        .where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.max("parent").alias("parent"))
    )
    links = scratch.cut(links)
    more = ["n_descendants"] if with_counts else []
    now, left = _resolved(links, scratch, with_counts)
    done = now.where("ptr IS NULL").select(
        "id", "root", F.col("steps").alias("depth"), F.lit("tree").alias("status"), *[(F.col("size") - 1).alias(x) for x in more]
    )
    if left:
        loop = scratch.cut(now.where("ptr IS NOT NULL").select("id"))
        f = scratch.cut(links.join(loop, "id", "left_semi").select("id", F.col("parent").alias("ptr")))
        on = _periodic(f, scratch).select("id", F.lit(True).alias("on"))
        rest = loop.join(on, "id", "left").select(
            "id", F.lit(None).cast(nodes.schema[id].dataType).alias("root"), F.lit(None).cast("bigint").alias("depth"),
            F.when(F.col("on"), "cycle").otherwise("below_cycle").alias("status"), *[F.lit(None).cast("bigint").alias(x) for x in more],
        )
        done = done.unionByName(rest)
    if with_path:
        placed = scratch.cut(links.join(done, "id"))
        return _with_paths(placed, scratch, more)
    return links.join(done, "id").select("id", "parent", "root", "depth", "status", *more)


def _resolved(links: DataFrame, scratch: Scratch, sizes: bool = False) -> tuple[DataFrame, int]:
    """(id, ptr, steps, root), and how many nodes never get to a root: those keep a ptr.

    For the others ptr is NULL and root the end of their way, steps away. With ``sizes`` also size,
    the number of nodes of each tree node's subtree: after k rounds it is that of the nodes nearer
    than 2^k, and each node adds its own to that of the node 2^k above.
    """
    known = links.select(F.col("id").alias("parent")).withColumn("known", F.lit(True))
    start = links.join(known, "parent", "left").select(
        "id", F.when(F.col("known"), F.col("parent")).alias("ptr"), F.when(F.col("known"), F.lit(1)).otherwise(0).cast("bigint").alias("steps"),
        *([F.lit(1).cast("bigint").alias("size")] if sizes else []),
    )
    open_ = F.col("ptr").isNotNull()
    now, _, left = scratch.counted(start.withColumn("root", F.when(~open_, F.col("id"))), left=open_)
    left = left["left"]
    while left:
        nxt, _, still = scratch.counted(_double(now), left=open_)
        scratch.drop(now)
        now = nxt
        if still["left"] == left:  # no chain of finite length is left
            break
        left = still["left"]
    return now, left


def _double(now: DataFrame) -> DataFrame:
    """Jumps of twice the length; a jump that meets a resolved node resolves its own."""
    segment, sizes = "seg" in now.columns, "size" in now.columns
    far = now.select(
        F.col("id").alias("ptr"), F.col("ptr").alias("far"), F.col("root").alias("far_root"), F.col("steps").alias("far_steps"),
        *([F.col("seg").alias("far_seg")] if segment else []),
    )
    moved = now.where("ptr IS NOT NULL").join(far, "ptr").select(
        "id", F.col("far").alias("ptr"), (F.col("steps") + F.col("far_steps")).alias("steps"), F.col("far_root").alias("root"),
        *([F.concat("far_seg", "seg").alias("seg")] if segment else []), *(["size"] if sizes else []),
    )
    both = now.where("ptr IS NULL").unionByName(moved)
    if sizes:
        below = now.where("ptr IS NOT NULL").groupBy(F.col("ptr").alias("id")).agg(F.sum("size").alias("more"))
        both = both.join(below, "id", "left").withColumn("size", F.col("size") + F.coalesce("more", F.lit(0))).drop("more")
    return both


def _with_paths(placed: DataFrame, scratch: Scratch, more: list[str] = ()) -> DataFrame:
    """Adds the path from the root, NULL for nodes on or below cycles.

    Whole paths would move in every round. So segments are doubled only up to the next waypoint, a
    node whose depth is a multiple of ``WAYPOINT``; the paths of waypoints, few of all, are put
    together by doubling again; and each node's path is written where it joins its waypoint's.
    """
    tree = placed.where("status = 'tree'")
    is_waypoint = F.col("depth") % WAYPOINT == 0
    waypoints = tree.where(is_waypoint).select("id", "depth", "parent")
    # root is set once the pointer is a waypoint: the segment ends there
    now = scratch.cut(
        tree.where(~is_waypoint).select(
            "id", F.when(F.col("depth") % WAYPOINT > 1, F.col("parent")).alias("ptr"), F.lit(0).cast("bigint").alias("steps"),
            F.when(F.col("depth") % WAYPOINT == 1, F.col("parent")).alias("root"), F.array("id").alias("seg"),
        )
    )
    length = 1
    while length < WAYPOINT:
        nxt = scratch.cut(_double(now))
        scratch.drop(now)
        now, length = nxt, 2 * length
    own = waypoints.where("depth = 0").select("id", F.lit(None).cast(placed.schema["id"].dataType).alias("ptr"), F.col("id").alias("root"), F.array("id").alias("seg"))
    below = waypoints.where("depth > 0").select(F.col("id").alias("w"), F.col("parent").alias("id")).join(now, "id")
    below = below.select(F.col("w").alias("id"), F.col("root").alias("ptr"), F.lit(None).cast(placed.schema["id"].dataType).alias("root"), F.concat("seg", F.array("w")).alias("seg"))
    chain = scratch.cut(own.unionByName(below).withColumn("steps", F.lit(0).cast("bigint")))
    left = chain.where("ptr IS NOT NULL").limit(1).count()
    while left:
        nxt, _, still = scratch.counted(_double(chain), left=F.col("ptr").isNotNull())
        scratch.drop(chain)
        chain, left = nxt, still["left"]
    whole = chain.select("id", F.col("seg").alias("path"))
    cols = ["id", "parent", "root", "depth", "path", "status", *more]
    top = whole.join(placed, "id").select(*cols)
    # the other columns join the short segments, so that whole paths move no more
    short = now.select("id", F.col("root").alias("w"), "seg").join(placed, "id")
    rest = short.join(whole.select(F.col("id").alias("w"), F.col("path").alias("upper")), "w").withColumn("path", F.concat("upper", "seg"))
    none = placed.where("status <> 'tree'").withColumn("path", F.lit(None).cast(whole.schema["path"].dataType))
    return top.unionByName(rest.select(*cols)).unionByName(none.select(*cols))


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) of every pair on a path; the result is as large as all paths."""
    return tree.where("path IS NOT NULL").select("id", "depth", F.posexplode("path").alias("at", "ancestor")).where("at < depth").select(
        "ancestor", F.col("id").alias("descendant"), (F.col("depth") - F.col("at")).alias("distance")
    )


def loop_descendants(tree: DataFrame, *, scratch: Scratch | None = None) -> DataFrame:
    """(ancestor, descendant, distance) of the nodes on and below cycles, which have no path.

    Distances are the least ones. A node on a cycle descends from every node of it, from itself at
    the cycle's length. The ways up double each round; pairs met again at a greater distance drop
    out, so no round holds more than the result and its like of one step more.
    """
    scratch = scratch or Scratch(tree.sparkSession)
    jump = scratch.cut(tree.where("status <> 'tree'").select("id", F.col("parent").alias("ptr")))
    now = scratch.cut(jump.select(F.col("id").alias("key"), "id", F.lit(0).cast("bigint").alias("dist")))
    length, n, before = 1, now.count(), -1
    while n != before:
        further = now.join(jump, "id").select("key", F.col("ptr").alias("id"), (F.col("dist") + length).alias("dist"))
        nxt, n_next, _ = scratch.counted(now.unionByName(further).groupBy("key", "id").agg(F.min("dist").alias("dist")))
        scratch.drop(now)
        far = jump.select(F.col("id").alias("ptr"), F.col("ptr").alias("far"))
        jumped = scratch.cut(jump.join(far, "ptr").select("id", F.col("far").alias("ptr")))
        scratch.drop(jump)
        now, jump, length, n, before = nxt, jumped, 2 * length, n_next, n
    on = tree.where("status = 'cycle'").select(F.col("id").alias("key"))
    itself = now.join(on, "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("distance"))
    return now.where("dist > 0").select(F.col("id").alias("ancestor"), F.col("key").alias("descendant"), F.col("dist").alias("distance")).unionByName(
        itself.select(F.col("key").alias("ancestor"), F.col("key").alias("descendant"), "distance")
    )


def _periodic(f: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, label) of the nodes on cycles of the total function f(id, ptr); label is the cycle's least id.

    The image of the 2^k-th power shrinks to exactly the periodic nodes; once it and the least ids
    stay the same over a round, both are final.
    """
    now = scratch.cut(f.select("id", "ptr", F.least("id", "ptr").alias("label")))
    image = -1
    while True:
        far = now.select(F.col("id").alias("ptr"), F.col("ptr").alias("far"), F.col("label").alias("far_label"))
        nxt = scratch.cut(
            now.join(far, "ptr").select(
                "id", F.col("far").alias("ptr"), F.least("label", "far_label").alias("label"),
                (F.col("far_label") < F.col("label")).alias("fell"),
            )
        )
        got = nxt.agg(F.countDistinct("ptr"), F.coalesce(F.max("fell"), F.lit(False))).first()
        scratch.drop(now)
        now = nxt
        if got[0] == image and not got[1]:
            return nxt.select("id", "label").join(nxt.select(F.col("ptr").alias("id")).distinct(), "id", "left_semi")
        image = got[0]


def cycle_members(edges: DataFrame, ranks: DataFrame | None = None, *, scratch: Scratch | None = None) -> DataFrame:
    """(id, cycle) of all nodes that can be reached from themselves along edges(child, parent).

    ``cycle`` names the strongly connected component. Every node points to one of its parents; the
    pointers are doubled. Nodes that stay unresolved after logarithmic rounds hang on cycles of
    pointers: each such cycle, with the ways that leave it and come back, becomes one node. Once all
    are resolved their depths are known, and nodes with a deeper parent than the one they point to
    turn to it. When none has, depths fall along every edge, so no cycle is left.

    ``ranks`` (id, grp, rank) may give any numbers that mostly fall from child to parent, such as
    commit numbers. A cycle must rise somewhere, and each of its nodes lies between the ends of one
    of its rising links; what lies outside all of these is put aside first. Any ranks, missing ones
    too, give the same result; good ones give it sooner. Edges with a NULL end are ignored; a self
    link is a cycle. An empty table gives an empty result.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    e = edges.select("child", "parent").where("child IS NOT NULL AND parent IS NOT NULL")
    if ranks is not None:
        e = _rising(_inner(scratch.cut(e)), ranks, scratch)
    return _components(e, scratch).select("id", F.col("label").alias("cycle"))


def _inner(e: DataFrame) -> DataFrame:
    """Without edges that begin where none leads to or lead where none begins: no cycle has them."""
    return e.join(e.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").join(
        e.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi"
    )


def _before(df: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the greatest ``value`` of the rows of lower ``lo`` in the group: by blocks, then over the blocks before."""
    before = (Window.unboundedPreceding, -1)
    top = df.groupBy("grp", "block").agg(F.max(value).alias("top"))
    top = top.select("grp", "block", F.max("top").over(Window.partitionBy("grp").orderBy("block").rowsBetween(*before)).alias("earlier"))
    own = F.max(value).over(Window.partitionBy("grp", "block").orderBy("lo").rowsBetween(*before))
    return df.withColumn(name, own).join(top, ["grp", "block"]).withColumn(name, F.greatest(name, "earlier")).drop("earlier")


def _rising(e: DataFrame, ranks: DataFrame, scratch: Scratch) -> DataFrame:
    """The edges within the stretches of rank that rising edges span, and those between groups.

    Groups are told apart by a hash: should two share one, less is put aside. Ranks are handled in
    blocks, at most 65536 of them, so that neither a hot group nor a wide stretch gathers in a task.
    """
    r = ranks.select("id", F.xxhash64("grp").alias("grp"), F.coalesce(F.col("rank").cast("bigint"), F.lit(0).cast("bigint")).alias("rank"))
    r = scratch.cut(r.where("id IS NOT NULL").groupBy("id").agg(F.max("grp").alias("grp"), F.max("rank").alias("rank")))
    ends = r.agg(F.min("rank"), F.max("rank")).first()
    width = max(64.0, ((ends[1] or 0) - (ends[0] or 0)) / 65536)
    block = lambda c: F.floor(F.col(c).cast("double") / width)
    both = e.join(r.select(F.col("id").alias("child"), F.col("grp").alias("gc"), F.col("rank").alias("rc")), "child", "left").join(
        r.select(F.col("id").alias("parent"), F.col("grp").alias("gp"), F.col("rank").alias("rp")), "parent", "left"
    )
    same = F.col("gc").isNotNull() & F.col("gp").isNotNull() & (F.col("gc") == F.col("gp"))
    both, _, n = scratch.counted(both.withColumn("same", F.coalesce(same, F.lit(False))), rising=same & (F.col("rp") >= F.col("rc")), across=~F.coalesce(same, F.lit(False)))
    across = both.where("NOT same").select("child", "parent")
    spans = both.where("same AND rp >= rc").groupBy(F.col("gc").alias("grp"), F.col("rc").alias("lo")).agg(F.max("rp").alias("hi"))
    if n["across"]:  # a link from one group to another may rise or fall: both groups stay whole
        mixed = both.where("NOT same").select(F.explode(F.array("gc", "gp")).alias("grp")).where("grp IS NOT NULL").distinct()
        whole = r.join(mixed, "grp", "left_semi").groupBy("grp").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"))
        spans = spans.unionByName(whole).groupBy("grp", "lo").agg(F.max("hi").alias("hi"))
    elif not n["rising"]:
        return across
    spans = _before(scratch.cut(spans.withColumn("block", block("lo"))), "hi", "before")
    spans = scratch.cut(spans.withColumn("start", F.when(F.col("before").isNull() | (F.col("lo") > F.col("before")), F.col("lo"))))
    spans = _before(spans, "start", "started").withColumn("island", F.coalesce("start", "started"))
    islands = spans.groupBy("grp", "island").agg(F.max("hi").alias("hi"))
    islands = islands.select("grp", F.col("island").alias("lo"), "hi", F.explode(F.sequence(block("island"), block("hi"))).alias("block"))
    held = both.where("same").withColumn("grp", F.col("gc")).withColumn("block", block("rc")).join(scratch.cut(islands), ["grp", "block"])
    held = held.where("rc BETWEEN lo AND hi AND rp BETWEEN lo AND hi")
    return held.select("child", "parent").unionByName(across)


ENDLESS = 2**62


def _components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, label) of the nodes on cycles; equal labels: each can be reached from the other."""
    e = scratch.cut(edges.select("child", "parent").distinct())
    loops = e.where("child = parent").select(F.col("child").alias("id"), F.col("child").alias("label"))
    e, n, _ = scratch.counted(_inner(e.where("child <> parent")))
    names = depths = None
    turn = 0
    while n:
        # each node points to its deepest parent; a parent that has no depth yet is deeper than all
        deep = F.lit(ENDLESS) if depths is None else F.coalesce("d", F.lit(0))
        known = e if depths is None else e.join(depths.select(F.col("id").alias("parent"), "d"), "parent", "left")
        f = known.groupBy(F.col("child").alias("id")).agg(F.max_by("parent", F.struct(deep, F.xxhash64("parent", F.lit(turn)))).alias("parent"))
        f = scratch.cut(f)
        now, left = _resolved(f, scratch)
        depths = now.select("id", F.when(F.col("ptr").isNull(), F.col("steps") + 1).otherwise(ENDLESS).alias("d"))
        if left:
            stuck = scratch.cut(f.join(now.where("ptr IS NOT NULL"), "id", "left_semi").select("id", F.col("parent").alias("ptr")))
            members = scratch.cut(_ears(e, stuck, _periodic(stuck, scratch), scratch))
            short = lambda c: members.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"))
            e = e.join(short("child"), "child", "left").join(short("parent"), "parent", "left").select(
                F.coalesce("child_label", "child").alias("child"), F.coalesce("parent_label", "parent").alias("parent")
            )
            e = scratch.cut(e.where("child <> parent").distinct())
            if names is None:
                names = members
            else:  # nodes that had become one before go along with it
                new = members.withColumnRenamed("label", "upper")
                moved = names.join(new.withColumnRenamed("id", "label"), "label", "left").select("id", F.coalesce("upper", "label").alias("label"))
                names = scratch.cut(moved.unionByName(members.join(names, "id", "left_anti")))
        else:
            e = _rising(_inner(e), depths.select("id", F.lit(0).alias("grp"), F.col("d").alias("rank")), scratch)
        e, n, _ = scratch.counted(_inner(e))
        turn += 1
    if names is None:
        return loops
    # a self link adds its node unless a longer cycle has it already
    return names.unionByName(loops.join(names, "id", "left_anti"))


def _ears(e: DataFrame, stuck: DataFrame, cyc: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, label): the cycles of pointers, each with the ways that an edge leads off it to and that lead back by pointers."""
    cyc = scratch.cut(cyc)
    hang = stuck.join(cyc, "id", "left_anti").join(cyc.select(F.col("id").alias("ptr"), F.col("label").alias("root")), "ptr", "left")
    hang = hang.select("id", F.when(F.col("root").isNull(), F.col("ptr")).alias("ptr"), F.lit(0).cast("bigint").alias("steps"), "root")
    now, n, left = scratch.counted(hang, left=F.col("ptr").isNotNull())
    if not n:
        return cyc
    jumps, left = [], left["left"]
    while left:  # nothing here runs in circles: what does is in cyc
        jumps.append(now.where("ptr IS NOT NULL").select("id", "ptr"))
        now, _, got = scratch.counted(_double(now), left=F.col("ptr").isNotNull())
        left = got["left"]
    ends = now.select("id", F.col("root").alias("label"))
    off = e.join(cyc.select(F.col("id").alias("child"), F.col("label").alias("from")), "child").join(ends.withColumnRenamed("id", "parent"), "parent")
    marked, n, _ = scratch.counted(off.where("from = label").select(F.col("parent").alias("id")).distinct())
    if not n:
        return cyc
    for jump in jumps:  # from the first node of a way to all of it, twice as far each time
        marked = scratch.cut(marked.join(jump, "id").select(F.col("ptr").alias("id")).unionByName(marked).distinct())
    return cyc.unionByName(ends.join(marked, "id", "left_semi"))


class Jumps:
    """Jumps of 1, 2, 4 ... steps along links(id, parent), each written when it is first asked for."""

    def __init__(self, links: DataFrame, scratch: Scratch):
        self.scratch = scratch
        one = links.select("id", F.col("parent").alias("ptr")).where("id IS NOT NULL AND parent IS NOT NULL")
        one, self.n, _ = scratch.counted(one)
        self._by = [one]

    def of(self, k: int) -> DataFrame:
        while len(self._by) <= k:
            last = self._by[-1]
            far = last.select(F.col("id").alias("ptr"), F.col("ptr").alias("far"))
            self._by.append(self.scratch.cut(last.join(far, "ptr").select("id", F.col("far").alias("ptr"))))
        return self._by[k]


def way_from(heads: DataFrame, links: DataFrame | Jumps, *, seen: list[DataFrame] = (), scratch: Scratch | None = None) -> DataFrame:
    """(key, id, dist): for each head (key, id) all nodes along links(id, parent), the head at dist 0.

    The covered stretch doubles each round. Every id has at most one parent in ``links``; a parent
    that has no row of its own ends the way but is part of it. Should a way run into a cycle, each
    node comes once, at its least distance. ``seen`` (key, id) are nodes where ways end, as they and
    all beyond them are known already; ``links`` may be the Jumps of an earlier call.
    """
    scratch = scratch or Scratch(heads.sparkSession)
    jumps = links if isinstance(links, Jumps) else Jumps(links, scratch)
    parts = [scratch.cut(heads.select("key", "id", F.lit(0).cast("bigint").alias("dist")).where("id IS NOT NULL"))]
    k = 0
    while True:
        jump = jumps.of(k)
        if k and jumps is not links:  # no later call asks for the shorter ones
            scratch.drop(jumps.of(k - 1))
        new = reduce(DataFrame.unionByName, parts).join(jump, "id").select("key", F.col("ptr").alias("id"), (F.col("dist") + 2**k).alias("dist"))
        if seen:
            new = new.join(reduce(DataFrame.unionByName, seen), ["key", "id"], "left_anti")
        new, n, _ = scratch.counted(new)
        if not n:
            return reduce(DataFrame.unionByName, parts)
        parts.append(new)
        k += 1
        if 2**k > max(1, jumps.n):
            return reduce(DataFrame.unionByName, parts).groupBy("key", "id").agg(F.min("dist").alias("dist"))
