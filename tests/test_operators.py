import random

import pytest
from pyspark.sql import functions as F

from orrery.functions.shingles import word_shingles
from orrery.operators import similarity as S
from orrery.operators.assertions import CheckFailed, assert_dependency, assert_unique
from orrery.operators.relational import count_and_sums, natural_join, run_sql, strict_lookup_join, unmatched
from orrery.operators.sampling import budget_prefix, nested_samples, ranked, round_robin
from orrery.operators.similarity import with_exact
from orrery.operators.transcript import fold_transcript, malformed_headers, text_lines
from orrery.operators.verify import digest_of_lines, same_rows


def bag(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def star(spark):
    facts = spark.createDataFrame([("1", "0", 3, 15, "Hello Moon café"), ("2", "10", 3, 13, "One two three"), ("3", "0", 2, 10, "Hello again")], "record_id string, dimension_key string, word_count bigint, text_bytes bigint, text string")
    dims = spark.createDataFrame([("0", "(main)"), ("10", "Template")], "dimension_key string, category string")
    return facts, dims


def test_joins(spark):
    u = spark.createDataFrame([("u-1", "CDR", 2), ("u-2", "CC", 3), ("u-3", "ZZ", 1), ("u-4", None, 1)], "utterance_id string, speaker_code string, word_count int")
    s = spark.createDataFrame([("CDR", "crew"), ("CC", "mission-control")], "speaker_code string, category string")
    j = natural_join(u, s, "speaker_code")
    assert bag(j.select("utterance_id", "category")) == [("u-1", "crew"), ("u-2", "mission-control")]
    assert bag(count_and_sums(j, "category", "n", w="word_count")) == [("crew", 1, 2), ("mission-control", 1, 3)]
    assert {r["speaker_code"]: r["n"] for r in unmatched(u, s, "speaker_code").collect()} == {"ZZ": 1, None: 1}
    with pytest.raises(CheckFailed, match="duplicate key"):
        natural_join(u, s.unionByName(s), "speaker_code")


def test_strict_join_raises_even_if_the_aggregate_ignores_the_category(spark, star):
    facts, dims = star
    assert bag(count_and_sums(strict_lookup_join(facts, dims, "dimension_key"), "category", "n", w="word_count", b="text_bytes")) == [("(main)", 2, 5, 25), ("Template", 1, 3, 13)]
    more = facts.unionByName(spark.createDataFrame([("9", "999", 1, 1, "x")], facts.schema))
    with pytest.raises(CheckFailed, match="unknown dimension key"):
        strict_lookup_join(more, dims, "dimension_key").agg(F.sum("word_count")).collect()
    with pytest.raises(CheckFailed, match="empty"):
        strict_lookup_join(facts, dims.limit(0), "dimension_key")
    big = spark.createDataFrame([("1", "0", 1, 140000, "x" * 140000)], facts.schema)
    assert bag(count_and_sums(strict_lookup_join(big, dims, "dimension_key"), "category", "n", b="text_bytes")) == [("(main)", 1, 140000)]
    assert run_sql(spark, "SELECT count(*) AS n FROM {f}", f=facts).first()["n"] == 3


def test_checks(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y")], "k string, v string")
    with pytest.raises(CheckFailed):
        assert_dependency(df, "k", "v")
    assert assert_unique(df, "k", "v") is df


TRANSCRIPT = """INTRODUCTION
00 00 00 04 CDR Inline start
Second line with you’re here.
(GOSS NET 1) Tape 1/1
00 00 01 02 CC
Apollo 11, Houston.
"""


def test_transcript(spark):
    df = spark.createDataFrame([("air", TRANSCRIPT)], "file string, text string")
    got = fold_transcript(text_lines(df, "file", "text").repartition(3)).orderBy("utterance_id").collect()
    assert [tuple(r)[1:] for r in got] == [("air-000001", "00:00:00:04", "CDR", 7, "Inline start Second line with you’re here."), ("air-000002", "00:00:01:02", "CC", 2, "Apollo 11, Houston.")]
    bad = spark.createDataFrame([("f", "00 00 00 04 CDR One\n00 O0 08 19 CC\nlost text\n00 00 09 00 LMP (EVA)\nTwo\n00 00 09 01 LMP (EVA)\n")], "file string, text string")
    rows = text_lines(bad, "file", "text")
    assert [r["text"] for r in fold_transcript(rows).orderBy("utterance_id").collect()] == ["One", "Two"]
    assert bag(malformed_headers(rows)) == [("f", 2, "00 O0 08 19 CC")]
    assert fold_transcript(text_lines(df.limit(0), "file", "text")).count() == 0


def test_samples_against_a_plain_loop(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(1, 90)) for i in range(500)]
    df = spark.createDataFrame(rows, "seq bigint, b bigint").repartition(5)
    got = {}
    for r in nested_samples(df, "seq", F.col("b"), {"tiny": 1, "small": 900, "all": 10**9}, 51).collect():
        got.setdefault(r["sample"], set()).add(r["seq"])
    for name, target in (("tiny", 1), ("small", 900), ("all", 10**9)):
        want, total = set(), 51
        for i, b in rows:
            if not want or total < target:
                want.add(i)
                total += b
            else:
                break
        assert got[name] == want
    assert nested_samples(df.limit(0), "seq", F.col("b"), {"x": 5}).count() == 0


def test_budget_and_shards(spark):
    parts = spark.createDataFrame([(2, 3, 60), (1, 10, 60), (1, 1, 50)], "part int, first int, size bigint")
    assert bag(budget_prefix(parts, ["part", "first"], "size", 100).select("part", "first")) == [(1, 1)]
    assert budget_prefix(parts, ["part", "first"], "size", 1).count() == 1
    ten = spark.range(10)
    shards = [set(r["id"] for r in round_robin(ten, ["id"], i, 3).collect()) for i in range(3)]
    assert set.union(*shards) == set(range(10)) and sum(map(len, shards)) == 10
    with pytest.raises(ValueError):
        round_robin(ten, ["id"], 3, 3)


def test_window_starts(spark):
    for n, want in ((120, [0, 25, 50, 70]), (30, [0]), (100, [0, 25, 50]), (0, [])):
        assert spark.createDataFrame([(n,)], "n int").select(S.window_starts(F.col("n"), 50, 25).alias("s")).first()["s"] == want
    with pytest.raises(ValueError):
        S.window_starts(F.col("n"), 0, 1)


def test_banding_toy(spark):
    sig = {"A": [1, 2, 3, 4], "B": [1, 2, 9, 9], "C": [7, 8, 3, 4], "D": [5, 6, 7, 8]}
    for seed in range(3):
        df = spark.createDataFrame([(k, k, 0, v) for k, v in sig.items()], "window_id string, file string, start int, sig array<bigint>").orderBy(F.rand(seed))
        raw = S.buckets(df, 2, 2)
        pairs = S.candidate_pairs(raw)
        assert bag(pairs.select("a", "b", "bands")) == [("A", "B", 1), ("A", "C", 1)]
    swapped = spark.createDataFrame([("X", "X", 0, [1, 1, 2, 2]), ("Y", "Y", 0, [2, 2, 1, 1])], df.schema)
    assert S.candidate_pairs(S.buckets(swapped, 2, 2)).count() == 0


def test_exact_pairs_and_evaluation(spark):
    docs = spark.createDataFrame([("D1", "the eagle has landed"), ("D2", "the eagle has landed safely"), ("D3", "houston the eagle is go"), ("D4", "roger houston we copy"), ("D5", ""), ("D6", None)], "f string, t string")
    win = S.token_windows(docs, F.col("f"), "t")
    sets = S.hashed_sets(win, word_shingles(F.col("tokens"), 2))
    got = {(r["a"][:2], r["b"][:2]): r["j"] for r in S.exact_pairs(sets, 50).collect()}
    assert got == {("D1", "D2"): 3 / 4, ("D1", "D3"): 1 / 6, ("D2", "D3"): 1 / 7}
    numpy, aggregate, expression = ({r["window_id"]: list(r["sig"]) for r in S.signatures(sets, 10, 4099, m).collect()} for m in ("numpy", "aggregate", "expression"))
    assert numpy == aggregate == expression
    sigs = S.signatures(sets, 10)
    none = S.candidate_pairs(S.buckets(sigs, 5, 2)).where("false")
    row = S.evaluation(none, S.exact_pairs(sets, 50, 0.5), sigs, 50, 0.5, True).first()
    assert (row["true_pairs"], row["candidates"], row["recall"], row["precision"]) == (1, 0, 0.0, None)
    cover = {r["file"]: r["covered"] for r in S.coverage(S.exact_pairs(sets, 50), win, 50, 0.5).collect()}
    assert cover == {"D1": 50, "D2": 50, "D3": 0, "D4": 0}
    top = S.top_pairs(S.exact_pairs(sets, 50), win, 50, 2).collect()
    assert [(r["a"][:2], r["b"][:2]) for r in top] == [("D1", "D2"), ("D1", "D3")]


def test_verify(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "n int, s string")
    assert same_rows(a, a.orderBy(F.desc("n"))) and not same_rows(a, a.distinct())
    assert digest_of_lines(a).collect() == digest_of_lines(a.repartition(3)).collect()


def test_strict_join_in_one_pass(spark, star):
    facts, dims = star
    got = count_and_sums(strict_lookup_join(facts, dims, "dimension_key", before=False), "category", "n", w="word_count", b="text_bytes")
    assert bag(got) == [("(main)", 2, 5, 25), ("Template", 1, 3, 13)]
    for key in ("999", None):
        more = facts.unionByName(spark.createDataFrame([("9", key, 1, 1, "x")], facts.schema))
        with pytest.raises(Exception, match="unknown dimension key"):
            strict_lookup_join(more, dims, "dimension_key", before=False).agg(F.sum("word_count")).collect()


def test_ranked_with_ties_nulls_outliers_and_clashing_names(spark):
    rows = [(1, 5, "a", "p"), (2, None, "b", "p"), (10**15, 7, None, "p"), (3, 1, "", None)]
    df = spark.createDataFrame(rows, "seq long, size long, place string, __pid string")
    got = {r["seq"]: (r["at"], r["before"], r["place"]) for r in ranked(df, ["seq"], F.col("size"), "at").collect()}
    assert got == {1: (0, 0, "a"), 2: (1, 5, "b"), 3: (2, 5, ""), 10**15: (3, 6, None)}
    assert ranked(df.limit(0), ["seq"], F.col("size"), "at").count() == 0


def test_digest_is_bounded_and_exact_fallback(spark):
    with pytest.raises(CheckFailed, match="more than 2 lines"):
        digest_of_lines(spark.range(3), 2)
    sets = spark.createDataFrame([("a", [1, 2, 3]), ("b", [2, 3, 4]), ("c", [9])], "window_id string, h array<bigint>")
    kept = spark.createDataFrame([("a", "b", 0.5)], "a string, b string, j double")
    cands = spark.createDataFrame([("a", "b"), ("a", "c")], "a string, b string")
    assert bag(with_exact(cands, kept, sets)) == [("a", "b", 0.5), ("a", "c", 0.0)]
