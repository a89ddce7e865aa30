"""The graph of commits: tips, ancestors, common ancestors, numbers, lookup by prefix.

Commits are a frame with statesum (upper-case digits), parents (array) and number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.errors import MultiMatch, NoMatch
from strata.functions.sums import BLANKS
from strata.operators.hierarchy import Jumps, way_from
from strata.scratch import Scratch

MAX_NUMBER = 2**32 - 1
#: Flag bits whose meaning is unknown and may not be ignored.
UNKNOWN_ESSENTIAL = 0x5554


def edges(commits: DataFrame) -> DataFrame:
    """(child, parent, ord)."""
    return commits.select(F.col("statesum").alias("child"), F.posexplode("parents").alias("ord", "parent"))


def tips(commits: DataFrame) -> DataFrame:
    """Commits that no commit has as a parent."""
    return commits.join(edges(commits).select(F.col("parent").alias("statesum")), "statesum", "left_anti")


def with_tip_flag(commits: DataFrame) -> DataFrame:
    used = edges(commits).select(F.col("parent").alias("statesum")).distinct().withColumn("used", F.lit(True))
    return commits.join(used, "statesum", "left").withColumn("is_tip", F.col("used").isNull()).drop("used")


def known_once(commits: DataFrame) -> DataFrame:
    """States that come more than once count once: of rows that differ, that of the greatest number, then of the greatest other columns."""
    others = [c for c in commits.columns if c != "statesum"]
    first = [c for c in others if c == "number"]
    best = commits.groupBy("statesum").agg(F.max(F.struct(*first, *[c for c in others if c not in first])).alias("_one"))
    return best.select(*[F.col("statesum") if c == "statesum" else F.col(f"_one.{c}").alias(c) for c in commits.columns])


def ancestors(commits: DataFrame, starts: DataFrame, *, scratch: Scratch | None = None) -> DataFrame:
    """(label, statesum): all ancestors, themselves included, of starts (label, statesum).

    Every commit has a main parent, the one of the greatest number (the first of equals), and ways
    along main parents are followed by doubling. A new round begins only from other parents that no
    way has met yet, so there are as many rounds as merges of side branches are nested, not as
    histories are long, whichever parent continues them. Any numbers give the same result.
    """
    scratch = scratch or Scratch(commits.sparkSession)
    have = commits.select(F.col("statesum").alias("parent"), F.coalesce("number", F.lit(-1)).alias("pn"))
    e = scratch.cut(edges(commits).join(have, "parent"))
    main = scratch.cut(e.groupBy(F.col("child").alias("id")).agg(F.max_by("parent", F.struct("pn", -F.col("ord"))).alias("parent")))
    more = e.join(main.withColumnsRenamed({"id": "child", "parent": "main"}), "child").where("parent <> main").select("child", "parent").distinct()
    more, n_more, _ = scratch.counted(more)
    jumps, seen = Jumps(main, scratch), []
    new = starts.join(commits.select("statesum").distinct(), "statesum", "left_semi").select(F.col("label").alias("key"), F.col("statesum").alias("id")).distinct()
    while True:
        # two new starts of one label may lie on one way
        seen.append(scratch.cut(way_from(new, jumps, seen=seen, scratch=scratch).select("key", "id").distinct()))
        n = 0
        if n_more:
            new = seen[-1].join(more, F.col("id") == F.col("child")).select("key", F.col("parent").alias("id")).distinct()
            new, n, _ = scratch.counted(new.join(reduce(DataFrame.unionByName, seen), ["key", "id"], "left_anti"))
        if not n:
            return reduce(DataFrame.unionByName, seen).select(F.col("key").alias("label"), F.col("id").alias("statesum"))


def latest_common(commits: DataFrame, pairs: DataFrame, *, scratch: Scratch | None = None) -> DataFrame:
    """(label, statesum, number): for each of pairs (label, one, two) the latest commit that both descend from, if any.

    Latest by number, then by sum. All pairs are followed at once.
    """
    starts = pairs.select(F.col("label").alias("pair"), F.explode(F.array("one", "two")).alias("statesum")).distinct()
    starts = starts.select(F.struct("pair", F.col("statesum").alias("start")).alias("label"), "statesum")
    above = ancestors(commits, starts, scratch=scratch).select(F.col("label.pair").alias("label"), "statesum")
    n = pairs.select("label", F.when(F.col("one") == F.col("two"), 1).otherwise(2).alias("n"))
    shared = above.groupBy("label", "statesum").agg(F.count(F.lit(1)).alias("met")).join(n, "label").where("met = n")
    found = shared.join(commits.select("statesum", "number"), "statesum")
    return found.groupBy("label").agg(F.max(F.struct("number", "statesum")).alias("x")).select("label", "x.statesum", "x.number")


def common_ancestors(commits: DataFrame, one: str, two: str, *, scratch: Scratch | None = None) -> DataFrame:
    """Commits that both states descend from, latest first by number, then by sum."""
    spark = commits.sparkSession
    both = ancestors(commits, spark.createDataFrame([("1", one), ("2", two)], "label string, statesum string"), scratch=scratch)
    shared = both.groupBy("statesum").agg(F.countDistinct("label").alias("n")).where("n = 2" if one != two else "n >= 1")
    return commits.join(shared.select("statesum"), "statesum", "left_semi").orderBy(F.col("number").desc(), F.col("statesum").desc())


def numbers(commits: DataFrame) -> DataFrame:
    """(statesum, number, expected, ok): is each number the largest of its parents' plus one, saturating?"""
    have = commits.select(F.col("statesum").alias("parent"), F.col("number").alias("pn"))
    top = edges(commits).join(have, "parent").groupBy(F.col("child").alias("statesum")).agg(F.max("pn").alias("pn"))
    expected = F.when(F.col("pn").isNull(), 0).otherwise(F.least(F.col("pn") + 1, F.lit(MAX_NUMBER)))
    return commits.select("statesum", "number").join(top, "statesum", "left").select("statesum", "number", expected.cast("bigint").alias("expected")).withColumn("ok", F.col("number") == F.col("expected"))


def merged_flags(commits: DataFrame) -> DataFrame:
    """(statesum, inherited): the flags of all parents or-ed."""
    have = commits.select(F.col("statesum").alias("parent"), "ext_flags")
    return edges(commits).join(have, "parent").groupBy(F.col("child").alias("statesum")).agg(F.bit_or("ext_flags").alias("inherited"))


def by_prefix(commits: DataFrame, text: str) -> DataFrame:
    """Commits whose sum begins with the digits; letter case and blanks carry no meaning."""
    digits = text.translate({ord(b): None for b in BLANKS}).upper()
    return commits.where(F.lit(len(digits) <= 64) & F.startswith(F.col("statesum"), F.lit(digits)))


def named_state(commits: DataFrame, text: str) -> str:
    """The one sum that the prefix names; NoMatch or MultiMatch otherwise."""
    found = [r[0] for r in by_prefix(commits, text).select("statesum").distinct().orderBy("statesum").limit(2).collect()]
    if not found:
        raise NoMatch(f"no state matches {text!r}")
    if len(found) > 1:
        raise MultiMatch(*found)
    return found[0]


def listing(commits: DataFrame) -> DataFrame:
    return commits.orderBy("number", "statesum")


def first_two_tips(commits: DataFrame, by: str | None = None) -> DataFrame:
    """The tips that a merge takes next: the two least sums, of each group where ``by`` names a column."""
    if by is None:
        return tips(commits).orderBy("statesum").limit(2)
    w = Window.partitionBy(by).orderBy("statesum")
    return tips(commits).withColumn("_rn", F.row_number().over(w)).where("_rn <= 2").drop("_rn")
