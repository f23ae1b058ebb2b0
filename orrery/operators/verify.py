"""Multiset equality and order-free digests of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators.assertions import CheckFailed
from orrery.runtime import at_most


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames hold the same rows equally often, in any order."""
    b = b.select(*a.columns)
    return a.exceptAll(b).limit(1).count() == 0 and b.exceptAll(a).limit(1).count() == 0


def as_lines(df: DataFrame) -> Column:
    """Every row as one tab-separated line; nulls are empty."""
    return F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])


#: Lines that may meet in one row to be digested in order.
DIGEST_LINES = 1_000_000


def digest_of_lines(df: DataFrame, most: int = DIGEST_LINES) -> DataFrame:
    """(n_rows, sha256) of the sorted lines, each ended by a newline.

    A digest of lines in order can't be split, so this is for results of
    report size: more than ``most`` lines stop the job before they are
    gathered. row_fingerprint() is for results of any size.
    """
    lines = df.select(as_lines(df).alias("line"))
    if not at_most(lines, most):
        raise CheckFailed(f"more than {most} lines to digest; use row_fingerprint")
    return lines.agg(F.count("*").alias("n_rows"), F.sha2(F.concat(F.array_join(F.array_sort(F.collect_list("line")), "\n"), F.when(F.count("*") > 0, "\n").otherwise("")), 256).alias("sha256"))


def row_fingerprint(df: DataFrame) -> DataFrame:
    """(n_rows, fingerprint): an order-free sum of row hashes, for results of any size."""
    return df.select(F.xxhash64(*df.columns).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("n_rows"), F.sum("h").alias("fingerprint"))
