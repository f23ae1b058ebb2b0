"""Checks that stop a job: uniqueness, dependencies, emptiness, budgets, row counts.

Each is an action of its own before the main plan, so that column pruning
can't remove it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class CheckFailed(ValueError):
    """A stated condition on the data doesn't hold."""


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` itself; raises if a key (null counts as one) has more than one row."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(3).collect()
    if twice:
        raise CheckFailed(f"duplicate key: {[tuple(r)[:-1] for r in twice]}")
    return df


def assert_not_empty(df: DataFrame, what: str = "table") -> DataFrame:
    if df.limit(1).count() == 0:
        raise CheckFailed(f"{what} is empty")
    return df


def assert_dependency(df: DataFrame, key: str, value: str) -> DataFrame:
    """Raises if one key has several values."""
    bad = df.groupBy(key).agg(F.count_distinct(value).alias("n")).where("n > 1").limit(3).collect()
    if bad:
        raise CheckFailed(f"{key} has more than one {value}: {[r[0] for r in bad]}")
    return df


def assert_budget(df: DataFrame, size: str, most: int) -> DataFrame:
    total = df.agg(F.sum(size)).first()[0] or 0
    if total > most:
        raise CheckFailed(f"sum of {size} is {total}, above {most}")
    return df


def assert_rows(df: DataFrame, expected: int) -> DataFrame:
    n = df.count()
    if n != expected:
        raise CheckFailed(f"{n} rows, expected {expected}")
    return df
