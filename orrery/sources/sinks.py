"""Sinks. None overwrites: an existing target is an error. Files appear whole, by the output committer or a rename."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from orrery.operators.assertions import CheckFailed


def write_quoted(df: DataFrame, path: str, header: bool = True) -> None:
    """Tab-separated with CSV quoting where a value needs it."""
    df.write.mode("errorifexists").csv(path, sep="\t", header=header, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_raw(df: DataFrame, path: str) -> None:
    """Tab-separated lines without quoting; tabs and line breaks in values become spaces."""
    cols = [F.translate(F.coalesce(F.col(c).cast("string"), F.lit("")), "\t\r\n", "   ") for c in df.columns]
    df.select(F.concat_ws("\t", *cols).alias("value")).write.mode("errorifexists").text(path)


def write_summary(df: DataFrame, path: str) -> None:
    """Comma-separated with a header, a part file per partition: a summary is small by its making, not by a gathering here."""
    df.write.mode("errorifexists").csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_report(row: dict, path: str) -> None:
    """One JSON object (a manifest, report or record), written beside and renamed.

    With a session the path may be on any file system it knows; without one
    it is a local path.
    """
    text = (json.dumps(row, indent=2, ensure_ascii=False) + "\n").encode("utf-8")
    spark = SparkSession.getActiveSession()
    if spark is None:
        target = Path(path)
        if target.exists():
            raise FileExistsError(path)
        part = target.with_name(target.name + ".part")
        part.write_bytes(text)
        part.rename(target)
        return
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, part = hadoop.Path(path), hadoop.Path(path + ".part")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(path)
    out = fs.create(part, True)
    try:
        out.write(bytearray(text))
    finally:
        out.close()
    if not fs.rename(part, target):
        raise FileExistsError(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_observed(df: DataFrame, path: str, **counters: Column) -> dict[str, int]:
    """Write Parquet and evaluate counters (aggregates) in the same pass."""
    seen = Observation()
    df.observe(seen, *[c.alias(n) for n, c in counters.items()]).write.mode("errorifexists").parquet(path)
    return dict(seen.get)


def write_counted(df: DataFrame, path: str, expected: int | None = None) -> int:
    """Write Parquet and count in the same pass; another count than expected is an error."""
    n = write_observed(df, path, n=F.count(F.lit(1)))["n"]
    if expected is not None and n != expected:
        raise CheckFailed(f"{n} rows written to {path}, expected {expected}")
    return n


def write_samples(samples: DataFrame, path: str) -> None:
    """All nested samples in one pass, a folder for each."""
    samples.write.mode("errorifexists").partitionBy("sample").parquet(path)
