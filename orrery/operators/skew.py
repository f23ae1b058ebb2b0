"""Complete per-key results where a few keys hold most rows.

Everything a key needs is expressed as mergeable counts. Rows are first
aggregated on (key, leading digits of the value), with map-side combining, so
a hot key is spread over many groups; those few histogram rows per key are
then merged. Quantiles are exact: the histogram bin that holds a wanted rank
is refined digit by digit until it is a single value. No task ever sees the
values of a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.runtime import maybe_broadcast, stage

DIGIT_BITS = 10
STATE_ROWS = 100_000


def _bits(df: DataFrame, value: str) -> int:
    top = df.agg(F.max(value).alias("m")).first()["m"]
    return max(1, int(top or 0).bit_length())


def key_profiles(
    df: DataFrame,
    key: Column,
    value: Column,
    quantiles: tuple[float, ...] = (0.5, 0.9, 0.99),
    sums: dict[str, Column] | None = None,
    latest: tuple[Column, Column] | None = None,
    digit_bits: int = DIGIT_BITS,
) -> DataFrame:
    """One row per key: rows, values, sums, latest record and exact quantiles of ``value``.

    ``value`` is a non-negative integer; null values count in ``n_rows`` but
    not in ``n_values`` or the quantiles (null for a key without values).
    The quantile q is the smallest value whose rank reaches ceil(q * n_values).
    ``latest`` = (time, id): the id of the greatest (time, id); nulls come
    first. Null keys form a row of their own with a null key. Ties share a
    rank range; an empty table gives no rows.
    """
    sums = sums or {}
    narrow = df.select(key.alias("k"), value.cast("bigint").alias("v"), *[c.alias(f"s_{n}") for n, c in sums.items()], *([latest[0].alias("at"), latest[1].alias("rid")] if latest else []))
    narrow = stage(narrow, "key-values")
    bits = _bits(narrow, "v")
    steps = -(-bits // digit_bits)
    shift = (steps - 1) * digit_bits

    aggs = [F.count("*").alias("n"), F.count("v").alias("nv"), *[F.sum(f"s_{n}").alias(f"s_{n}") for n in sums]]
    if latest:
        aggs.append(F.max(F.struct("at", "rid")).alias("last"))
    hist = stage(narrow.groupBy("k", F.shiftright("v", shift).alias("bin")).agg(*aggs), "key-histogram")
    merged = [F.sum("n").alias("n_rows"), F.sum("nv").alias("n_values"), *[F.sum(f"s_{n}").alias(n) for n in sums]]
    if latest:
        merged.append(F.max("last")["rid"].alias("latest_id"))
    totals = hist.groupBy("k").agg(*merged)

    if not quantiles:
        return totals.withColumnRenamed("k", "key")
    # wanted ranks: one row per key and quantile
    wanted = totals.where("n_values > 0").select("k", F.explode(F.array(*[F.struct(F.lit(i).alias("qi"), F.greatest(F.lit(1), F.ceil(F.lit(float(q)) * F.col("n_values"))).cast("bigint").alias("rank")) for i, q in enumerate(quantiles)])).alias("w")).select("k", "w.qi", "w.rank")
    counts = hist.where("bin is not null").select("k", "bin", F.col("nv").alias("n"))
    state = _resolve(wanted.withColumn("pre", F.lit(0).cast("bigint")), counts.withColumn("pre", F.lit(0).cast("bigint")))
    for step in range(1, steps):
        shift -= digit_bits
        state = stage(state, f"key-ranks-{step}")
        live, small = maybe_broadcast(state.select("k", "pre").distinct(), STATE_ROWS)
        base = narrow.where("v is not null").withColumn("pre", F.shiftright("v", shift + digit_bits))
        if not small:
            # pre-aggregated before the join, so that a hot key's rows are few
            base = base.groupBy("k", "pre", F.shiftright("v", shift).alias("bin")).agg(F.count("*").alias("n"))
            counts = base.join(live.withColumnRenamed("k", "k2").withColumnRenamed("pre", "pre2"), F.col("k").eqNullSafe(F.col("k2")) & (F.col("pre") == F.col("pre2")), "left_semi")
        else:
            counts = base.join(live.withColumnRenamed("k", "k2").withColumnRenamed("pre", "pre2"), F.col("k").eqNullSafe(F.col("k2")) & (F.col("pre") == F.col("pre2")), "left_semi").groupBy("k", "pre", F.shiftright("v", shift).alias("bin")).agg(F.count("*").alias("n"))
        state = _resolve(state, counts)
    qcols = [F.max(F.when(F.col("qi") == i, F.col("pre"))).alias(f"q{round(q * 1000):03d}") for i, q in enumerate(quantiles)]
    picked = state.groupBy("k").agg(*qcols).withColumnRenamed("k", "k2")
    return totals.join(picked, F.col("k").eqNullSafe(F.col("k2")), "left").drop("k2").withColumnRenamed("k", "key")


def _resolve(state: DataFrame, counts: DataFrame) -> DataFrame:
    """Each wanted rank moved into the child bin that holds it.

    state: k, qi, rank, pre; counts: k, pre, bin, n with one bin for each
    value of the next digit at most, so the window is bounded.
    """
    order = Window.partitionBy("k", "pre").orderBy("bin")
    cum = counts.withColumn("upto", F.sum("n").over(order)).select(F.col("k").alias("ck"), F.col("pre").alias("cp"), "bin", "upto", "n")
    return (
        state.join(cum, F.col("k").eqNullSafe(F.col("ck")) & (F.col("pre") == F.col("cp")) & (F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
        .select("k", "qi", (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"), F.col("bin").alias("pre"))
    )


def hot_keys(profiles: DataFrame, share: float = 0.05) -> DataFrame:
    """The keys of key_profiles() (null left out) that hold at least ``share`` of all rows, null keys counted in the total."""
    total = profiles.agg(F.sum("n_rows").alias("total"))
    return profiles.crossJoin(F.broadcast(total)).where(F.col("key").isNotNull() & (F.col("n_rows") >= F.lit(share) * F.col("total")))
