"""Joins of facts with dimensions, and aggregates by category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.assertions import CheckFailed, assert_not_empty, assert_unique
from orrery.runtime import fresh, maybe_broadcast


def word_count(words: Column, df: DataFrame) -> DataFrame:
    """(word, total) of an array column; counted on the map side first."""
    return df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("total"))


def sum_counts(df: DataFrame, word: str, count: str) -> DataFrame:
    """(word, total) of partial counts; a count that isn't a whole number raises."""
    return df.groupBy(F.col(word).alias("word")).agg(F.sum(F.col(count).cast("bigint")).alias("total"))


def natural_join(facts: DataFrame, dims: DataFrame, key: str) -> DataFrame:
    """Inner equi-join with a dimension whose key is unique (else raises); facts without a match drop out, as do null keys."""
    assert_unique(dims.where(F.col(key).isNotNull()), key)
    side, _ = maybe_broadcast(dims)
    return facts.join(side, key)


def strict_lookup_join(facts: DataFrame, dims: DataFrame, key: str, before: bool = True) -> DataFrame:
    """Every fact must find its dimension row; an unknown or null key is an error.

    With ``before`` it is raised here, by a scan of the key column alone. Without,
    the job that reads the result stops, in its own single pass: the
    check is a filter over a left join, so no pruning of columns removes it.
    """
    assert_unique(assert_not_empty(dims, "dimension table"), key)
    mark = fresh(facts, fresh(dims, "__known"))
    side, _ = maybe_broadcast(dims.withColumn(mark, F.lit(True)))
    if before:
        unknown = facts.select(key).join(side, key, "left_anti").limit(3).collect()
        if unknown:
            raise CheckFailed(f"unknown dimension key: {[r[0] for r in unknown]}")
        return facts.join(side, key).drop(mark)
    stop = F.raise_error(F.concat(F.lit("unknown dimension key: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean")
    return facts.join(side, key, "left").where(F.when(F.col(mark), True).otherwise(stop)).drop(mark)


def unmatched(facts: DataFrame, dims: DataFrame, key: str) -> DataFrame:
    """(key, n): fact rows without a dimension row, by key; a null key never matches."""
    side, _ = maybe_broadcast(dims.select(key).distinct())
    return facts.join(side, key, "left_anti").groupBy(key).agg(F.count("*").alias("n"))


def matched(facts: DataFrame, dims: DataFrame, key: str) -> DataFrame:
    """The facts that have a dimension row, unchanged."""
    side, _ = maybe_broadcast(dims.select(key).distinct())
    return facts.join(side, key, "left_semi")


def count_and_sums(df: DataFrame, by: str, count_name: str, **sums: str) -> DataFrame:
    """Rows and sums per group, partially aggregated before the shuffle."""
    return df.groupBy(by).agg(F.count("*").alias(count_name), *[F.sum(c).alias(n) for n, c in sums.items()])


def with_shares(df: DataFrame, count: str, words: str) -> DataFrame:
    """Adds share_pct of ``count`` in the whole and mean_words = words / count; df has one row per group."""
    return df.withColumn("share_pct", 100.0 * F.col(count) / F.sum(count).over(Window.partitionBy())).withColumn("mean_words", F.try_divide(words, count))


def tagged_union(parts: dict[str, DataFrame], tag: str = "record_type") -> DataFrame:
    """One frame of several relations, each row with its relation's tag; missing columns are null."""
    frames = [df.withColumn(tag, F.lit(t)) for t, df in parts.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def run_sql(spark, text: str, **views: DataFrame) -> DataFrame:
    """The result of a SQL text over the given frames as views."""
    return spark.sql(text, **views) if views else spark.sql(text)
