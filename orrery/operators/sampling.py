"""Deterministic samples: nested prefixes by size, greedy budgets, shards."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from orrery.runtime import fresh, stage


def _cumulated(batches: Iterator[pa.RecordBatch], size: str, names: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
    """Batches of one sorted partition with its number, each row's place in it and the sum of ``size`` before the row."""
    pid, rows, total = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        s = np.array(b.column(size).fill_null(0))
        upto = total + np.cumsum(s, dtype=np.int64)
        cols = [pa.array(np.full(len(s), pid, np.int64)), pa.array(rows + np.arange(len(s))), pa.array(upto - s)]
        yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *names])
        if len(s):
            rows, total = rows + len(s), int(upto[-1])


def ranked(df: DataFrame, order: list[str], size: Column, place: str = "place", before: str = "before") -> DataFrame:
    """Adds ``place`` (from 0) in the order of ``order`` and ``before``, the sum of ``size`` of all earlier rows.

    Rows are sorted in range partitions, which an outlier can't unbalance,
    and summed there; only one row a partition meets in a single task. A
    null size counts as 0; rows equal in ``order`` come in any order.
    """
    s, pid, n = fresh(df, "__size"), fresh(df, "__pid"), fresh(df, "__n")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn(s, size.cast("bigint")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = StructType([*rows.schema.fields]).add(pid, LongType()).add(place, LongType()).add(before, LongType())
    rows = stage(rows.mapInArrow(partial(_cumulated, size=s, names=(pid, place, before)), schema), "ranked")
    w = Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(pid).agg(F.count("*").alias(n), F.coalesce(F.sum(s), F.lit(0)).alias("__t"))
    base = ends.select(pid, F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n), F.coalesce(F.sum("__t").over(w), F.lit(0)).alias("__t"))
    return rows.join(F.broadcast(base), pid).withColumn(place, F.col(place) + F.col(n)).withColumn(before, F.col(before) + F.col("__t")).drop(pid, s, n, "__t")


def nested_samples(df: DataFrame, seq: str, size: Column, targets: dict[str, int], header_bytes: int = 0) -> DataFrame:
    """Rows of each prefix sample, with its name in ``sample``.

    A sample takes rows in order of ``seq`` (unique) until header and rows
    reach its target: the row that crosses it is in, the first row always.
    Smaller samples are prefixes of larger ones; all come from one pass.
    """
    place, before = fresh(df, "__place"), fresh(df, "__before")
    picks = F.filter(F.array(*[F.when((F.col(place) == 0) | (F.col(before) + header_bytes < t), F.lit(n)) for n, t in targets.items()]), lambda x: x.isNotNull())
    return ranked(df, [seq], size, place, before).withColumn("sample", F.explode(picks)).drop(place, before)


def budget_prefix(parts: DataFrame, order: list[str], size: str, budget: int) -> DataFrame:
    """Parts in order, stopped before the first that would exceed the budget; the first part is always in. Sizes aren't negative."""
    place, before = fresh(parts, "__place"), fresh(parts, "__before")
    return ranked(parts, order, F.col(size), place, before).where((F.col(place) == 0) | (F.col(before) + F.coalesce(F.col(size), F.lit(0)) <= budget)).drop(place, before)


def round_robin(parts: DataFrame, order: list[str], index: int, count: int) -> DataFrame:
    """Every ``count``-th part from ``index`` on; an index outside the shards is an error."""
    if count < 1 or not 0 <= index < count:
        raise ValueError(f"shard {index} of {count}")
    place, before = fresh(parts, "__place"), fresh(parts, "__before")
    return ranked(parts, order, F.lit(0), place, before).where(F.col(place) % count == index).drop(place, before)
