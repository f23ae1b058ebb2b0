"""References to records that do not exist (or not at that time).

Keys become integers: their places in the sorted dictionary of all parent and
reference keys. The parents' integers are compressed into contiguous runs, and
so are, for keys with spells of validity, the integer microseconds at which a
key is live. A reference is matched as of the preceding run start and is an
orphan when it lies beyond that run's end.

Runs are built in range partitions of the sorted integers, and of each
partition only its last run is looked at elsewhere. Few runs are broadcast and
searched by bisection; many are sorted together with the references, so
neither a key with many spells nor one with many references gathers in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructType

from orrery.operators.sampling import ranked
from orrery.runtime import BROADCAST_ROWS, fresh, hot_join, maybe_broadcast, stage

_MIN, _MAX = -(2**62), 2**62
#: References of one key beyond which its dictionary row is broadcast to them.
HOT_ROWS = 1_000_000


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, independent of the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(`{ts}` AS TIMESTAMP_NTZ))")


def _starts_new(by: pa.Array, before: object) -> np.ndarray:
    """Where a value differs from the one before it; ``before`` stands in front of the first."""
    if not len(by):
        return np.zeros(0, bool)
    inner = np.array(pc.not_equal(by.slice(1), by.slice(0, len(by) - 1)))
    return np.append(by[0].as_py() != before, inner)


def _behind(one: pa.RecordBatch, b: pa.RecordBatch) -> pa.RecordBatch:
    """``b`` with the row ``one`` in front of it."""
    return pa.RecordBatch.from_arrays([pa.concat_arrays([x.cast(y.type), y]) for x, y in zip(one.columns, b.columns)], names=b.schema.names)


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one range partition from spans (ref_key, s, e) ordered by key and start; the last run is marked."""
    pid, kind = TaskContext.get().partitionId(), None
    held: tuple | None = None  # the run that may go on: (key, start, end)

    def out(keys, s, e, last):
        n = len(s)
        return pa.RecordBatch.from_arrays([keys, pa.array(s, pa.int64()), pa.array(e, pa.int64()), pa.array(np.full(n, pid, np.int32)), pa.array(np.full(n, last))], names=["ref_key", "run_start", "run_end", "pid", "is_last"])

    for b in batches:
        if not len(b):
            continue
        kind = b.schema.field(0).type
        if held is not None:
            b = _behind(pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(held, b.schema.types)], names=b.schema.names), b)
        keys, s, e = b.column(0), np.array(b.column(1)), np.array(b.column(2))
        new_key = _starts_new(keys, object())
        upto = pd.Series(e).groupby(np.cumsum(new_key)).cummax().to_numpy()
        start = new_key | np.append(True, s[1:] > upto[:-1] + 1)
        at = np.flatnonzero(start)
        end = upto[np.append(at[1:], len(s)) - 1]
        held = (keys[int(at[-1])].as_py(), int(s[at[-1]]), int(end[-1]))
        yield out(keys.take(pa.array(at[:-1])), s[at[:-1]], end[:-1], False)
    if held is not None:
        yield out(pa.array([held[0]], kind), [held[1]], [held[2]], True)


def merged_runs(spans: DataFrame, parts: int | None = None) -> DataFrame:
    """Maximal runs (ref_key, run_start, run_end) of the integers that the spans (ref_key, s, e) hold, both ends inside.

    Overlapping and adjacent spans of a key merge, in any number. Spans are
    sorted in range partitions; the last run of each, one row a partition,
    tells where a run goes on in the partitions behind it.
    """
    spark = spans.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = spans.schema["ref_key"].dataType.simpleString()
    ordered = spans.select("ref_key", "s", "e").repartitionByRange(parts, "ref_key", "s", "e").sortWithinPartitions("ref_key", "s")
    runs = stage(ordered.mapInArrow(_compress, f"ref_key {key}, run_start bigint, run_end bigint, pid int, is_last boolean"), "runs")
    open_ = None
    carried = []
    for r in sorted(runs.where("is_last").collect(), key=lambda r: r["pid"]):
        if open_ is not None:
            carried.append((r["pid"], *open_))
        goes_on = open_ is not None and open_[0] == r["ref_key"] and r["run_start"] <= open_[2] + 1
        open_ = (open_[0], open_[1], max(open_[2], r["run_end"])) if goes_on else (r["ref_key"], r["run_start"], r["run_end"])
    if not carried:
        return runs.select("ref_key", "run_start", "run_end")
    before = spark.createDataFrame(carried, f"pid int, key_before {key}, start_before bigint, end_before bigint")
    on = (F.col("key_before") == F.col("ref_key")) & (F.col("run_start") <= F.col("end_before") + 1)
    begun = runs.join(F.broadcast(before), "pid", "left").select("ref_key", F.when(on, F.col("start_before")).otherwise(F.col("run_start")).alias("run_start"), "run_end")
    return begun.groupBy("ref_key", "run_start").agg(F.max("run_end").alias("run_end"))


def contiguous_runs(parents: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """Maximal runs (run_start, run_end) of consecutive values of the integer column ``key``.

    Nulls are dropped, repeats count once; an empty table gives no run.
    """
    k = F.col(key).cast("bigint")
    return merged_runs(parents.where(k.isNotNull()).select(F.lit(0).alias("ref_key"), k.alias("s"), k.alias("e")), parts).drop("ref_key")


def integer_orphans(refs: DataFrame, key: str, runs: DataFrame, parts: int | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``refs`` whose integer ``key`` lies in no run of contiguous_runs(). Null keys are left out."""
    one = fresh(refs, "__one")
    lost = orphan_references(refs.where(F.col(key).isNotNull()).withColumn(one, F.lit(0)), one, F.col(key).cast("bigint"), runs.select(F.lit(0).alias("ref_key"), "run_start", "run_end"), broadcast_rows, parts)
    return lost.select(*refs.columns)


def live_runs(parents: DataFrame, key: Column, added: str, removed: str) -> DataFrame:
    """Runs (ref_key, run_start, run_end) of microseconds in which a key is live, both ends inside.

    A null ``added`` means always, a null ``removed`` means still; a spell
    that ends before it begins holds no instant. Repeated and overlapping
    spells merge. Null keys are dropped.
    """
    spells = parents.select(key.alias("ref_key"), F.coalesce(micros(added), F.lit(_MIN)).alias("s"), F.coalesce(micros(removed) - 1, F.lit(_MAX)).alias("e"))
    return merged_runs(spells.where(F.col("ref_key").isNotNull() & (F.col("s") <= F.col("e"))))


def key_codes(refs: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """(key, code, n_refs, known): the sorted dictionary of the keys of two frames.

    Codes are places in the order of all distinct keys, so that neighbours
    have consecutive integers. n_refs counts the references; known tells
    whether the code lies in a contiguous run of parents' codes.
    """
    used = refs.groupBy(key).agg(F.count("*").alias("n_refs")).select(key, "n_refs", F.lit(False).alias("parent"))
    there = parents.select(F.col(key), F.lit(0).cast("bigint").alias("n_refs"), F.lit(True).alias("parent"))
    keys = used.unionByName(there).where(F.col(key).isNotNull()).groupBy(key).agg(F.sum("n_refs").alias("n_refs"), F.max("parent").alias("parent"))
    coded = ranked(keys, [key], F.lit(0), "code", "__none").drop("__none")
    lost = integer_orphans(coded, "code", contiguous_runs(coded.where("parent"), "code")).select("code", F.lit(False).alias("known"))
    return coded.join(lost, "code", "left").select(key, "code", "n_refs", F.coalesce("known", F.lit(True)).alias("known"))


def coded(refs: DataFrame, codes: DataFrame, key: str) -> DataFrame:
    """``refs`` with the code of their key and whether it is known; null keys drop out. Keys of very many rows don't gather in a task."""
    side, small = maybe_broadcast(codes)
    return (refs.join(side, key) if small else hot_join(refs, codes, [key], F.col("n_refs") > HOT_ROWS)).drop("n_refs")


class _Bisected:
    """Runs as sorted arrays: each reference finds the preceding run start by bisection."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values(["ref_key", "run_start"])
        self.keys = pd.Index(rows["ref_key"].unique())
        self.instants = np.unique(rows["run_start"].to_numpy(np.int64))
        self.end = rows["run_end"].to_numpy(np.int64)
        self.of = self.keys.get_indexer(rows["ref_key"])
        self.place = self._places(self.of, rows["run_start"].to_numpy(np.int64))

    def _places(self, key: np.ndarray, at: np.ndarray) -> np.ndarray:
        return key * (len(self.instants) + 1) + np.searchsorted(self.instants, at, side="right")

    def reasons(self, key: pd.Series, at: pd.Series) -> pd.Series:
        none = at.isna().to_numpy()
        position = at.fillna(0).to_numpy(np.int64)
        k = self.keys.get_indexer(key)
        run = np.searchsorted(self.place, self._places(k, position), side="right") - 1
        known = (k >= 0) & ~none
        found = known & (run >= 0)
        found[found] = self.of[run[found]] == k[found]
        out = np.full(len(key), "never", object)
        out[known] = "not_yet"
        out[found] = np.where(position[found] <= self.end[run[found]], None, "gone")
        return pd.Series(out)


_OUT_TAIL = StructType().add("__reason", StringType()).add("__open", BooleanType()).add("__pid", IntegerType())


def _as_of(batches: Iterator[pa.RecordBatch], n_refs: int) -> Iterator[pa.RecordBatch]:
    """Orphans of one sorted partition of runs and references.

    Columns: those of the references, then key, position, run end (null for
    a reference). References in front of the first run stay open, and the
    last run of the partition is handed on.
    """
    pid = TaskContext.get().partitionId()
    before: pa.RecordBatch | None = None

    def out(b, reason, is_open):
        n = len(b)
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(reason, pa.string()), pa.array(is_open, pa.bool_()), pa.array(np.full(n, pid, np.int32))], names=[*b.schema.names, *_OUT_TAIL.names])

    for b in batches:
        if not len(b):
            continue
        if before is not None:
            b = _behind(before, b)
        is_run = np.array(pc.is_valid(b.column(n_refs + 2)))
        run = np.maximum.accumulate(np.where(is_run, np.arange(len(b)), -1))
        ref = ~is_run
        is_open = ref & (run < 0)
        key, at, end = b.column(n_refs), b.column(n_refs + 1), b.column(n_refs + 2)
        take = pa.array(np.maximum(run, 0))
        own = np.array(pc.fill_null(pc.equal(key, key.take(take)), False))
        beyond = np.array(pc.fill_null(pc.greater(at, end.take(take)), True))
        first = np.array(pc.fill_null(pc.less(end.take(take), _MIN - 1), False))
        reason = np.where(own, np.where(first, "not_yet", "gone"), "never")
        orphan = ref & ~is_open & (~own | beyond)
        keep = orphan | is_open
        if keep.any():
            yield out(b.filter(pa.array(keep)), reason[keep], is_open[keep])
        if is_run.any():
            before = b.slice(int(np.flatnonzero(is_run)[-1]), 1)
    if before is not None:
        yield out(before, [None], [False])


def _sorted_as_of(left: DataFrame, key: str, at: str, runs: DataFrame, reason: str, parts: int | None) -> DataFrame:
    """The orphans of ``left`` with their reason: runs and references in one order, whatever the number of either.

    Each key's first run is an empty one in front of all positions, so that
    a key without any run can be told from one whose runs come later.
    """
    spark = left.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = left.columns
    k, p, e = (fresh(left, f"__asof_{x}") for x in ("key", "at", "end"))
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in left.schema.fields]
    refs = left.select("*", F.col(key).alias(k), F.coalesce(F.col(at), F.lit(_MIN - 9)).alias(p), F.lit(None).cast("bigint").alias(e))
    empty = runs.select("ref_key").distinct().select("ref_key", F.lit(_MIN - 5).alias("run_start"), F.lit(_MIN - 6).alias("run_end"))
    firsts = runs.select("ref_key", "run_start", "run_end").unionByName(empty).select(*none, F.col("ref_key").cast(left.schema[key].dataType).alias(k), F.col("run_start").alias(p), F.col("run_end").alias(e))
    both = refs.unionByName(firsts)
    order = [F.col(k), F.col(p), F.col(e).isNull()]
    ordered = both.repartitionByRange(parts, *order, F.xxhash64(*names)).sortWithinPartitions(*order)
    found = stage(ordered.mapInArrow(lambda it, n=len(names): _as_of(it, n), StructType([*both.schema.fields, *_OUT_TAIL.fields])), "as-of")
    lasts = {r["__pid"]: (r[k], r[e]) for r in found.where("__reason is null").select("__pid", k, e).collect()}
    pids = [r["__pid"] for r in found.where("__open").select("__pid").distinct().collect()]
    carried = []
    for pid in pids:
        earlier = [q for q in lasts if q < pid]
        if earlier:
            carried.append((pid, *lasts[max(earlier)]))
    done = found.where("not __open and __reason is not null").select(*names, F.col("__reason").alias(reason))
    if not pids:
        return done
    before = spark.createDataFrame(carried, StructType().add("__pid", IntegerType()).add("__k", both.schema[k].dataType).add("__e", both.schema[e].dataType))
    own = F.coalesce(F.col("__k") == F.col(k), F.lit(False))
    why = F.when(~own, "never").when(F.col("__e") < _MIN - 1, "not_yet").when(F.col(p) > F.col("__e"), "gone")
    opened = found.where("__open").join(F.broadcast(before), "__pid", "left").withColumn("__reason", why).where("__reason is not null")
    return done.unionByName(opened.select(*names, F.col("__reason").alias(reason)))


def orphan_references(refs: DataFrame, key: str, at: Column, runs: DataFrame, broadcast_rows: int = BROADCAST_ROWS, parts: int | None = None) -> DataFrame:
    """The rows of ``refs`` whose ``key`` has no run holding the position ``at``.

    Adds ``orphan_reason``: 'never' (no run of this key at all), 'not_yet'
    (before its first run) or 'gone' (beyond the end of the preceding run).
    Rows with a null key refer to nothing and are left out; a null position
    is no instant at which the key is live, so it is an orphan ('never'
    known to be live). Columns of ``refs`` stay as they are, whatever their
    names. An empty parent table makes every reference an orphan. Up to
    ``broadcast_rows`` runs are broadcast, beyond they are sorted together
    with the references; the rows are the same.
    """
    where, out = fresh(refs, "__at"), fresh(refs, "orphan_reason")
    left = refs.where(F.col(key).isNotNull()).withColumn(where, at)
    _, small = maybe_broadcast(runs, broadcast_rows)
    if not small:
        return _sorted_as_of(left, key, where, runs, out, parts).drop(where)
    held = refs.sparkSession.sparkContext.broadcast(runs.select("ref_key", "run_start", "run_end").toPandas())
    made: list[_Bisected] = []

    @F.pandas_udf(StringType())
    def reason(k: pd.Series, position: pd.Series) -> pd.Series:
        if not made:
            made.append(_Bisected(held.value))
        return made[0].reasons(k, position)

    return left.withColumn(out, reason(F.col(key), F.col(where))).where(F.col(out).isNotNull()).drop(where)
