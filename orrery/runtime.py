"""Run-time helpers: shared stage tables, size checks and column-name hygiene."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes (as JSON) up to which a side may be broadcast.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20

T = TypeVar("T")
_stages: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    A temporary folder is taken only where that setting is absent and the
    master is local; elsewhere its absence is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    at = "file://" + tempfile.mkdtemp(prefix="orrery-")
    spark.conf.set("spark.checkpoint.dir", at)
    _stages.append((spark, at))
    return at


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that doesn't exist yet; it goes with the stage tables."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _stages.append((spark, path))
    return path


def stage(df: DataFrame, name: str, by: str | None = None, most: int = 0) -> DataFrame:
    """Write ``df`` as a table in the shared folder, in files of ``most`` rows if given, and return a scan of it.

    This cuts lineage with replicated storage behind it: a lost executor
    costs only its running tasks. Stage tables go when the process ends, or
    with release_stages().
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write.mode("errorifexists").option("compression", "zstd").option("maxRecordsPerFile", most)
    (writer.partitionBy(by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_stage(staged: DataFrame) -> None:
    """Delete the table that stage() returned, once everything made from it is staged itself."""
    path = staged.stage_path
    _stages.remove((staged.sparkSession, path))
    _delete(staged.sparkSession, path)


def release_stages() -> None:
    """Delete every stage table of this process; frames that read them end with it."""
    while _stages:
        spark, path = _stages.pop()
        try:
            _delete(spark, path)
        except Exception:  # the JVM has ended: nothing left to call
            return


atexit.register(release_stages)


def spread(df: DataFrame) -> DataFrame:
    """``df``, repartitioned if it comes in fewer partitions than there are cores.

    For CPU-heavy work on inputs of a few unsplittable files; an input of
    many files keeps its partitions and isn't shuffled. Only for frames
    without a shuffle of their own: counting the partitions of others would
    run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has no more than ``rows`` rows, reading no more than needed."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """``df`` with a broadcast hint if its rows and their bytes prove it small, and whether it is."""
    got = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("b")).first()
    small = got["n"] <= rows and (got["b"] or 0) <= size
    return (F.broadcast(df) if small else df), small


def drop_shuffles(spark: SparkSession) -> None:
    """Let the files of shuffles go that nothing refers to any more: Spark's cleaner waits for a collection on the driver."""
    spark._jvm.System.gc()


def side_by_side(*steps: Callable[[], T]) -> list[T]:
    """The results of independent steps whose jobs run at the same time, in order."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [f.result() for f in [pool.submit(step) for step in steps]]


def hot_join(rows: DataFrame, side: DataFrame, on: list[str], hot: Column) -> DataFrame:
    """``rows`` joined with ``side``, of which ``hot`` marks the rows that meet very many.

    Those are few; where their size proves it they are broadcast, and the
    rows with such keys don't go into the shuffle of the others.
    """
    busy, small = maybe_broadcast(side.where(hot))
    if not small:
        return rows.join(side, on)
    if at_most(busy, 0):
        return rows.join(side.where(F.coalesce(~hot, F.lit(True))), on)
    keys = F.broadcast(side.where(hot).select(*on).distinct())
    return rows.join(busy, on).unionByName(rows.join(keys, on, "left_anti").join(side.where(F.coalesce(~hot, F.lit(True))), on))


def fresh(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``df`` has that name (in any case)."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted += "_"
    return wanted
