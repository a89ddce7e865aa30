"""EXCEPT ALL both ways, and what its residues say key by key.

``newer EXCEPT ALL older`` and ``older EXCEPT ALL newer`` together are the rows whose count on one
side exceeds that on the other. Both come out of one pass: rows are tagged +1 and -1 and summed over
all columns, which is how EXCEPT ALL itself is run, here once for both directions. The residues are
few; a full join by key then labels them. All rows of a key are in one partition already, so that
neither the EXCEPT ALL nor the join moves data again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_received(df: DataFrame, keys: list[str], received: str, extra: list[Column] = ()) -> DataFrame:
    """Of the rows of one key the one received last; NULL times are earliest, ``extra`` breaks ties."""
    w = Window.partitionBy(*keys).orderBy(F.col(received).desc_nulls_last(), *extra)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def residues(tagged: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, side): rows left by EXCEPT ALL either way of the rows tagged side +1 and -1."""
    return tagged.groupBy(*columns).agg(F.sum("side").alias("side")).where("side <> 0")


def joined(residue: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Full join of the two residues by key: (keys, plus, minus), each a struct of fields or NULL.

    Each side holds a key at most once; as both sides are in one frame, the join is a grouping.
    """
    whole = F.struct(*fields)
    return residue.groupBy(*keys).agg(
        F.max(F.when(F.col("side") > 0, whole)).alias("plus"), F.max(F.when(F.col("side") < 0, whole)).alias("minus")
    )


def snapshot_changes(rows: DataFrame, following: DataFrame) -> DataFrame:
    """Changes between each full snapshot and the next: (repo_id, ss, elt_id, op).

    ``rows``: repo_id, ss, elt_id, elt, received_at; ``following``: repo_id, ss, next_ss (NULL for
    the last), has_prev. op is INS, DEL or REPL, ss that of the newer snapshot.

    Of several rows of one element in one snapshot the one received last counts. Payloads are
    compared as they are, NULL equals only NULL. Rows without repo_id, ss or elt_id are ignored.
    """
    rows = rows.select("repo_id", "ss", "elt_id", "elt", "received_at").where("repo_id IS NOT NULL AND ss IS NOT NULL AND elt_id IS NOT NULL")
    # one shuffle for all: an element's rows of all snapshots of a repository meet; a hot repository
    # or a hot element alone does not make a hot partition
    rows = rows.join(following, ["repo_id", "ss"]).repartition("repo_id", "elt_id")
    rows = last_received(rows, ["repo_id", "elt_id", "ss"], "received_at", [F.col("elt").desc_nulls_last()])
    newer = F.when(F.col("has_prev"), F.struct(F.col("ss").alias("at"), F.lit(1).alias("side")))
    older = F.when(F.col("next_ss").isNotNull(), F.struct(F.col("next_ss").alias("at"), F.lit(-1).alias("side")))
    tagged = rows.select("repo_id", "elt_id", "elt", F.explode(F.array_compact(F.array(newer, older))).alias("x"))
    tagged = tagged.select("repo_id", "elt_id", "elt", F.col("x.at").alias("ss"), F.col("x.side").alias("side"))
    left = residues(tagged, ["repo_id", "elt_id", "ss", "elt"])
    sides = left.groupBy("repo_id", "elt_id", "ss").agg(F.max("side").alias("hi"), F.min("side").alias("lo"))
    op = F.when(F.col("hi") < 0, "DEL").when(F.col("lo") > 0, "INS").otherwise("REPL")
    return sides.select("repo_id", "ss", "elt_id", op.alias("op"))


def snapshot_sequence(rows: DataFrame) -> DataFrame:
    """(repo_id, ss, next_ss, has_prev): the snapshots present, in order; one row per snapshot."""
    have = rows.select("repo_id", "ss").where("repo_id IS NOT NULL AND ss IS NOT NULL").distinct()
    w = Window.partitionBy("repo_id").orderBy("ss")
    return have.select("repo_id", "ss", F.lead("ss").over(w).alias("next_ss"), F.lag("ss").over(w).isNotNull().alias("has_prev"))


def copy_differences(north: DataFrame, south: DataFrame, keys: list[str], fields: list[str], received: str) -> DataFrame:
    """(keys, diff) between two copies: 'missing_north', 'missing_south' or a differing field's name.

    Both frames hold keys, fields (already normalised) and the time of receipt; other columns are
    ignored. Of several rows of one key in one copy the one received last counts. NULL equals only
    NULL. Rows with a NULL in the key are ignored. An empty copy misses every row of the other.
    """
    cols = [*keys, *fields, received]
    whole = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    both = north.select(*cols, F.lit(1).alias("side")).unionByName(south.select(*cols, F.lit(-1).alias("side"))).where(whole)
    both = both.repartition(*keys)
    last = last_received(both, [*keys, "side"], received, [F.col(f).desc_nulls_last() for f in fields])
    sides = joined(residues(last, [*keys, *fields]), keys, fields)
    differing = [F.when(~F.col(f"plus.{f}").eqNullSafe(F.col(f"minus.{f}")), F.lit(f)) for f in fields]
    diff = (
        F.when(F.col("plus").isNull(), F.array(F.lit("missing_north")))
        .when(F.col("minus").isNull(), F.array(F.lit("missing_south")))
        .otherwise(F.array_compact(F.array(*differing)))
    )
    return sides.select(*keys, F.explode(diff).alias("diff"))
