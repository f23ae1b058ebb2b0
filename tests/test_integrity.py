import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from orrery.operators import references as R
from orrery.operators.skew import hot_keys, key_profiles

T0 = datetime(2031, 1, 1)


def test_contiguous_runs(spark):
    rng = random.Random(5)
    keys = [k for k in range(-300, 3000) if rng.random() < 0.8] + [10**12, 10**12 + 1]
    df = spark.createDataFrame([(k,) for k in keys * 2] + [(None,)], "k bigint").repartition(7)
    want, s = [], set(keys)
    for k in sorted(s):
        if k - 1 not in s:
            want.append([k, k])
        want[-1][1] = k
    for bits in (4, 16):
        assert sorted(map(list, R.contiguous_runs(df, "k", bits).collect())) == want
    assert R.contiguous_runs(df.limit(0), "k").count() == 0


@pytest.mark.parametrize("bound", [R.BROADCAST_ROWS, 0])
def test_orphans_against_a_plain_loop(spark, bound):
    rng = random.Random(8)
    day = lambda n: None if n is None else T0 + timedelta(hours=n)
    parents = [(f"k{rng.randrange(6)}", day(rng.choice([None, *range(0, 60, 3)])), day(rng.choice([None, *range(5, 90, 5)]))) for _ in range(40)] + [(None, None, None)]
    refs = [(i, rng.choice([f"k{j}" for j in range(8)] + ["k0"] * 20), day(rng.choice([None, *range(-3, 95)])), i) for i in range(400)] + [(1000, None, T0, 1)]
    p = spark.createDataFrame(parents, "k string, a timestamp_ntz, r timestamp_ntz")
    f = spark.createDataFrame(refs, "id int, k string, at timestamp_ntz, runs int")
    got = R.orphan_references(f, "k", R.micros("at"), R.live_runs(p, F.col("k"), "a", "r"), bound)
    assert got.columns == ["id", "k", "at", "runs", "orphan_reason"]

    def live(k, t):
        return t is not None and any(x == k and (a is None or a <= t) and (r is None or r > t) for x, a, r in parents)

    want = {i for i, k, t, _ in refs if k is not None and not live(k, t)}
    rows = got.collect()
    assert {r["id"] for r in rows} == want and len(rows) == len(want)
    assert {r["orphan_reason"] for r in rows if r["k"] in ("k6", "k7")} == {"never"}


def test_integer_orphans(spark):
    rng = random.Random(7)
    parents = {k for k in range(-50, 900) if rng.random() < 0.9}
    refs = [rng.randrange(-90, 1000) for _ in range(600)]
    p = spark.createDataFrame([(k,) for k in parents], "pk int")
    f = spark.createDataFrame([(k, k) for k in refs] + [(None, 0)], "k int, run_start int").repartition(3)
    for bits in (4, 16):
        got = R.integer_orphans(f, "k", R.contiguous_runs(p, "pk", bits), bits)
        assert sorted(r["k"] for r in got.collect()) == sorted(k for k in refs if k not in parents) and got.columns == f.columns
    assert R.integer_orphans(f, "k", R.contiguous_runs(p.limit(0), "pk")).count() == len(refs)


def test_orphans_of_empty_tables(spark):
    p = spark.createDataFrame([], "k string, a timestamp_ntz, r timestamp_ntz")
    f = spark.createDataFrame([("x", T0)], "k string, at timestamp_ntz")
    runs = R.live_runs(p, F.col("k"), "a", "r")
    assert [r["orphan_reason"] for r in R.orphan_references(f, "k", R.micros("at"), runs).collect()] == ["never"]
    assert R.orphan_references(f.limit(0), "k", R.micros("at"), runs).count() == 0


@pytest.mark.parametrize("bits", [2, 10])
def test_profiles_against_a_plain_loop(spark, bits):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([None, 0, 7, rng.randrange(5000)]), rng.randrange(9), rng.choice([None, T0 + timedelta(hours=rng.randrange(40))]), f"r{i:04d}") for i in range(900)] + [("empty", None, None, None, None)]
    df = spark.createDataFrame(rows, "k string, v int, w int, at timestamp_ntz, rid string").repartition(5)
    got = {r["key"]: r for r in key_profiles(df, F.col("k"), F.col("v"), (0.5, 0.9), {"words": F.col("w")}, (F.col("at"), F.col("rid")), bits).collect()}
    assert set(got) == {"hot", "a", "b", None, "empty"}
    for key, r in got.items():
        own = [x for x in rows if x[0] == key]
        vals = sorted(x[1] for x in own if x[1] is not None)
        assert (r["n_rows"], r["n_values"]) == (len(own), len(vals))
        assert r["words"] == (sum(x[2] for x in own) if key != "empty" else None)
        for q, name in ((0.5, "q500"), (0.9, "q900")):
            assert r[name] == (vals[max(1, -(-int(q * 10) * len(vals) // 10)) - 1] if vals else None)
        assert r["latest_id"] == max(own, key=lambda x: (x[3] is not None, x[3] or T0, x[4] or ""))[4]
    hot = {r["key"] for r in hot_keys(key_profiles(df, F.col("k"), F.col("v"))).collect()}
    assert hot == {k for k in ("hot", "a", "b", "empty") if sum(x[0] == k for x in rows) >= 0.05 * len(rows)}


def test_profiles_of_an_empty_table(spark):
    df = spark.createDataFrame([], "k string, v int")
    assert key_profiles(df, F.col("k"), F.col("v")).count() == 0


@pytest.mark.parametrize("parts", [1, 3, 9])
def test_runs_over_many_partitions(spark, parts):
    rng = random.Random(parts)
    spans = [(rng.choice("aab"), s, s + rng.choice([0, 1, 2, 40, 700])) for s in (rng.randrange(900) for _ in range(120))] + [("c", -(2**62), 2**62), ("c", 5, 6)]
    got = sorted(map(tuple, R.merged_runs(spark.createDataFrame(spans, "ref_key string, s bigint, e bigint").repartition(5), parts).collect()))
    want = []
    for k, s, e in sorted(spans):
        if want and want[-1][0] == k and s <= want[-1][2] + 1:
            want[-1][2] = max(want[-1][2], e)
        else:
            want.append([k, s, e])
    assert got == sorted(map(tuple, want))


def test_sorted_and_bisected_references_agree(spark):
    rng = random.Random(1)
    spans = [(k, s, s + rng.randrange(30)) for k in ("hot", "b", "late") for s in [rng.randrange(500) for _ in range(25)]] + [("late", 10_000, 10_010)]
    runs = R.merged_runs(spark.createDataFrame(spans, "ref_key string, s bigint, e bigint"))
    refs = spark.createDataFrame([(i, rng.choice(["hot"] * 9 + ["b", "late", "none", None]), rng.choice([None, *range(-20, 600, 3)])) for i in range(900)], "id int, k string, at bigint").repartition(4)
    every = [sorted((r["id"], r["orphan_reason"]) for r in R.orphan_references(refs, "k", F.col("at"), runs, bound, parts).collect()) for bound, parts in ((10**6, None), (0, 1), (0, 4), (0, 16))]
    assert every[0] and all(x == every[0] for x in every)


def test_key_codes(spark):
    refs = spark.createDataFrame([(k,) for k in "bbdzx"] + [(None,)], "k string")
    parents = spark.createDataFrame([(k,) for k in "abbcx"] + [(None,)], "k string")
    codes = R.key_codes(refs, parents, "k")
    assert sorted(map(tuple, codes.collect())) == [("a", 0, 0, True), ("b", 1, 2, True), ("c", 2, 0, True), ("d", 3, 1, False), ("x", 4, 1, True), ("z", 5, 1, False)]
    assert sorted(r["code"] for r in R.coded(refs, codes, "k").collect()) == [1, 1, 3, 4, 5]
    assert {r["known"] for r in R.key_codes(refs, parents.limit(0), "k").collect()} == {False}
    assert R.key_codes(refs.limit(0), parents.limit(0), "k").count() == 0


def test_profiles_without_quantiles(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 3)], "k string, v int")
    got = {r["key"]: (r["n_rows"], r["n_values"]) for r in key_profiles(df, F.col("k"), F.col("v"), ()).collect()}
    assert got == {"a": (2, 1), None: (1, 1)}
