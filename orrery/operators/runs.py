"""Run records: timing, counters in log text, summaries."""

from __future__ import annotations

import json
import re
import subprocess
import time
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: counters that a log may hold, with the names they are recorded under
COUNTERS = {
    "CPU time spent (ms)": "cpu_time_ms",
    "Map input records": "map_input_records",
    "Map output records": "map_output_records",
    "Reduce input records": "reduce_input_records",
    "Reduce output records": "reduce_output_records",
    "HDFS: Number of bytes read": "hdfs_bytes_read",
    "HDFS: Number of bytes written": "hdfs_bytes_written",
    "FILE: Number of bytes read": "local_bytes_read",
    "FILE: Number of bytes written": "local_bytes_written",
    "Reduce shuffle bytes": "reduce_shuffle_bytes",
    "Launched map tasks": "launched_map_tasks",
    "Launched reduce tasks": "launched_reduce_tasks",
}
COUNTER_LINE = r"^\s*([^=]+?)\s*=\s*(\d+)\s*$"
RUN_SCHEMA = "schema_version int, label string, engine string, dataset_id string, started_utc string, elapsed_seconds double, exit_status int, input_rows bigint, input_bytes bigint, output_rows bigint, application_ids array<string>, job_ids array<string>, hadoop_counters map<string,bigint>, command array<string>"


def parse_counters(logs: DataFrame, run: str, line_no: str, line: str) -> DataFrame:
    """(run, counter, value): known counters of the log lines, the last line of each wins."""
    name, value = F.regexp_extract(line, COUNTER_LINE, 1), F.regexp_extract(line, COUNTER_LINE, 2)
    names = F.create_map(*[F.lit(x) for kv in COUNTERS.items() for x in kv])
    rows = logs.select(F.col(run).alias("run"), F.col(line_no).alias("n"), F.try_element_at(names, name).alias("counter"), value.try_cast("bigint").alias("v"))
    return rows.where("counter is not null and v is not null").groupBy("run", "counter").agg(F.max_by("v", "n").alias("value"))


def ids_in(text, prefix: str):
    """Sorted distinct 'application_1_2' or 'job_1_2' style ids of a text column."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(prefix + r"_\d+_\d+"), F.lit(0))))


def summarize_runs(runs: DataFrame, tie: str = "path") -> DataFrame:
    """Per (dataset_id, engine, label): attempts, successes, the first attempt and the median successful time.

    The first attempt is the least (started_utc, ``tie``). Records without
    elapsed_seconds or engine are left out; the median is null without a success.
    """
    ok = F.col("exit_status") == 0
    first = F.struct("elapsed_seconds", "exit_status", "input_rows", "input_bytes", "output_rows")
    return (
        runs.where("elapsed_seconds is not null and engine is not null")
        .groupBy("dataset_id", "engine", "label")
        .agg(F.count("*").alias("attempts"), F.count_if(ok).alias("successful_attempts"), F.min_by(first, F.struct("started_utc", tie)).alias("f"), F.median(F.when(ok, F.col("elapsed_seconds"))).alias("median_success_seconds"))
        .select("dataset_id", "engine", "label", "attempts", "successful_attempts", F.col("f.elapsed_seconds").alias("first_seconds"), F.col("f.exit_status").alias("first_exit_status"), "median_success_seconds", "f.input_rows", "f.input_bytes", "f.output_rows")
    )


class StageTimer:
    """Seconds of named steps, by a monotonic clock."""

    def __init__(self):
        self.steps: list[dict] = []

    def run(self, label: str, step, *args, **kwargs):
        began = time.perf_counter()
        try:
            return step(*args, **kwargs)
        finally:
            self.steps.append({"step": label, "seconds": round(time.perf_counter() - began, 3)})


def timed_command(command: list[str], record: str, **facts) -> int:
    """Run a command, write one JSON record of it (failures too) to a new file, and return its exit status."""
    target = Path(record)
    if target.exists():
        raise FileExistsError(record)
    started, began = datetime.now(timezone.utc).isoformat(timespec="seconds"), time.perf_counter()
    done = subprocess.run(command, capture_output=True, text=True)
    said = done.stdout + done.stderr
    counters = {}
    for line in said.splitlines():
        if (m := re.match(COUNTER_LINE, line)) and m[1] in COUNTERS:
            counters[COUNTERS[m[1]]] = int(m[2])
    row = {"schema_version": 1, "started_utc": started, "elapsed_seconds": time.perf_counter() - began, "exit_status": done.returncode, "application_ids": sorted(set(re.findall(r"application_\d+_\d+", said))), "job_ids": sorted(set(re.findall(r"job_\d+_\d+", said))), "hadoop_counters": counters, "command": command, **facts}
    part = target.with_suffix(target.suffix + ".part")
    part.write_text(json.dumps(row, indent=2) + "\n", encoding="utf-8")
    part.rename(target)
    return done.returncode
