"""Metadata of commits: times, numbers, flags; and classifiers over elements."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.errors import ArgError
from strata.operators.dag import MAX_NUMBER, UNKNOWN_ESSENTIAL


def timestamp_now() -> int:
    """Whole seconds since 1970, UTC."""
    return int(time.time())


def date_time(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def next_number(number: Column) -> Column:
    """One more, at most the largest number that the format holds."""
    return F.least(number + 1, F.lit(MAX_NUMBER))


def unknown_essential(flags: Column) -> Column:
    """Are flags set that may not be ignored?"""
    return flags.bitwiseAND(F.lit(UNKNOWN_ESSENTIAL)) != 0


def checked_flags(flags: int) -> int:
    if flags & UNKNOWN_ESSENTIAL:
        raise ArgError("unknown essential flags")
    return flags


def explicit_commit(commits: DataFrame) -> DataFrame:
    """The commits, or an error at run time where one has unknown essential flags or no or over 255 parents."""
    ok = ~unknown_essential(F.coalesce("ext_flags", F.lit(0))) & F.size("parents").between(1, 255)
    return commits.where(F.when(ok, True).otherwise(F.raise_error(F.lit("a commit that can't be read"))))


class Property:
    """A classifier of elements, by which states are filtered, counted or laid out."""

    def __init__(self, name: str, of: Callable[[Column], Column]):
        self.name, self.of = name, of

    def add(self, state: DataFrame) -> DataFrame:
        return state.withColumn(self.name, self.of(F.col("elt")))

    def select(self, state: DataFrame, value) -> DataFrame:
        return state.where(self.of(F.col("elt")).eqNullSafe(F.lit(value)))

    def counts(self, state: DataFrame) -> DataFrame:
        return state.groupBy(self.of(F.col("elt")).alias(self.name)).agg(F.count(F.lit(1)).alias("n"))

    def write(self, state: DataFrame, path: str) -> None:
        """Laid out by the property, so that a filter on it prunes directories; many files per value where needed."""
        self.add(state).write.partitionBy(self.name).parquet(path)
