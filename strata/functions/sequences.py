"""Numeric sequences as ARRAY<DOUBLE>: generators, statistics and the little-endian codec."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_LENGTH = 1000


def _steps(n: Column, first: Column, following) -> Column:
    """n values, each from the one before, so that rounding is that of repeated steps."""
    none = F.array().cast("array<double>")
    grown = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))), none,
        lambda acc, i: F.when(F.size(acc) == 0, F.array(first.cast("double"))).otherwise(F.array_append(acc, following(F.element_at(acc, -1)))),
    )
    return F.when(n > 0, grown).otherwise(none)


def arithmetic(n: Column, start: Column, step: Column) -> Column:
    return _steps(n, start, lambda x: x + step)


def geometric(n: Column, start: Column, factor: Column) -> Column:
    return _steps(n, start, lambda x: x * factor)


def fibonacci(n: Column, first: Column, second: Column) -> Column:
    none = F.array().cast("array<double>")
    two = F.array(first.cast("double"), second.cast("double"))
    grown = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), none, lambda a, i: F.when(i <= 2, F.slice(two, 1, i)).otherwise(F.array_append(a, F.element_at(a, -1) + F.element_at(a, -2))))
    return F.when(n > 0, grown).otherwise(none)


def power(n: Column, exponent: Column) -> Column:
    """i to the exponent for i from 0 to n - 1."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.pow(i.cast("double"), exponent))).otherwise(F.array().cast("array<double>"))


def generated(spark: SparkSession, rows: int, seed: int) -> DataFrame:
    """(elt_id, elt): sequences of all four kinds with random parameters and log-normal lengths."""
    r = spark.range(rows).select(
        F.col("id").alias("elt_id"), (F.rand(seed) * 4).cast("int").alias("kind"),
        F.least(F.exp(1 + 2 * F.randn(seed + 1)).cast("bigint"), F.lit(MAX_LENGTH)).alias("n"), F.randn(seed + 2).alias("p"), F.randn(seed + 3).alias("q"),
    )
    kinds = [arithmetic(F.col("n"), F.col("p"), F.col("q")), geometric(F.col("n"), F.col("p"), F.col("q")), fibonacci(F.col("n"), F.col("p"), F.col("q")), power(F.col("n"), F.col("p"))]
    elt = F.when(F.col("kind") == 0, kinds[0]).when(F.col("kind") == 1, kinds[1]).when(F.col("kind") == 2, kinds[2]).otherwise(kinds[3])
    return r.select("elt_id", elt.alias("elt"))


def statistics(state: DataFrame) -> DataFrame:
    return state.agg(F.max(F.size("elt")).alias("max_length"), F.avg(F.size("elt")).alias("avg_length"))


@F.pandas_udf(T.BinaryType())
def to_bytes(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else np.asarray(x, "<f8").tobytes())


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def from_bytes(data: pd.Series) -> pd.Series:
    """Fails for lengths that are no multiple of 8."""
    return data.map(lambda x: None if x is None else np.frombuffer(x, "<f8").tolist())
