import random

import pytest
from pyspark.sql import functions as F

from orrery.functions import shingles as sh
from orrery.functions.html import body_text, decode_bytes
from orrery.functions.labels import label_code
from orrery.functions.text import blank_tokens, collapse_blanks, excerpt, f1_count, f1_words, f2_count, flatten_breaks, lines, parse_size
from orrery.operators.relational import sum_counts, word_count


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first()["y"]


def counts(spark, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return {r["word"]: r["total"] for r in word_count(f1_words(F.col("t")), df).collect()}


def test_word_count(spark):
    assert counts(spark, "Houston, HOUSTON!\nEagle.\n") == {"eagle": 1, "houston": 2}
    got = counts(spark, "00 00 01 02 CC Apollo 11, you're GO. YOU’RE 'go'! air-to-ground A11B")
    assert got == {"a": 1, "air": 1, "apollo": 1, "b": 1, "cc": 1, "go": 2, "ground": 1, "to": 1, "you're": 2}
    assert counts(spark, "", "11 00:42 ... --\n", None) == {}
    assert counts(spark, *["cat dog cat"] * 3) == {"cat": 6, "dog": 3}


def test_partial_counts(spark):
    df = spark.createDataFrame([("eagle", "2"), ("eagle", "3")], "w string, n string")
    assert [tuple(r) for r in sum_counts(df, "w", "n").collect()] == [("eagle", 5)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        sum_counts(spark.createDataFrame([("eagle", "not-a-number")], "w string, n string"), "w", "n").collect()


def test_text_functions(spark):
    assert one(spark, "café ² don’t x_y", f2_count) == 5
    assert one(spark, "you’re GO 11", f1_count) == 2
    assert one(spark, " one\t two  　three ", collapse_blanks) == "one two three"
    assert one(spark, "a\r\nb\tc", flatten_breaks) == "a  b c"
    assert one(spark, "a\nb\r\n\x85c d\n", lines) == ["a", "b", "", "c", "d"]
    assert one(spark, "  ", blank_tokens) == [] and one(spark, " a  b ", blank_tokens) == ["a", "b"]
    assert one(spark, "2MiB", parse_size) == 2097152 and one(spark, " 128", parse_size) == 128
    with pytest.raises(Exception, match="invalid size"):
        one(spark, "2MB", parse_size)
    assert one(spark, list("abcdefghijklmnop"), excerpt, "array<string>").endswith("n ...")
    assert one(spark, ["a"], excerpt, "array<string>") == "a"
    assert one(spark, " (x) Cap. [VOX]:", label_code) == "CAP" and one(spark, "--", label_code) is None and one(spark, None, label_code) is None


def test_html():
    assert body_text("<head><title>T</title></head><body>Hello<script>x()</script><style>y</style><br>world</body>Outside") == "Hello\nworld\n"
    assert body_text("<body>00 00 01 02 <font>CC</font><br>Test &amp; test!<br>0123</body>") == "00 00 01 02 CC\nTest & test!\n0123\n"
    assert body_text("<body><table><tr><td>CDR</td><td>Commander</td></tr></table><p>A <b>small</b> sample.</p></body>") == "CDR Commander\nA small sample.\n"
    assert decode_bytes(b"Sample \xa2 text", "utf-8") == ("Sample ¢ text", "windows-1252")
    with pytest.raises(UnicodeDecodeError):
        decode_bytes(b"\xff", "ascii")


def test_shingles(spark):
    def words(t, k):
        return one(spark, t, lambda c: sh.word_shingles(c, k), "array<string>")

    assert words(["roger", "houston"], 3) == [] and words([], 3) == []
    assert words(["the", "eagle", "has"], 3) == ["the eagle has"]
    assert one(spark, ["go"], lambda c: sh.char_shingles(c, 5), "array<string>") == []
    a = one(spark, "Eagle, 11 HAS!", lambda c: sh.char_shingles(f1_words(c), 4))
    assert set(a) == set(one(spark, "eagle has", lambda c: sh.char_shingles(f1_words(c), 4)))
    assert one(spark, "the eagle has", sh.stable_hash) == 216341939
    # the guard survives an explode behind it
    df = spark.createDataFrame([(["a"],), (["a", "b", "c"],)], "t array<string>")
    assert df.select(F.explode(sh.word_shingles(F.col("t"), 3)).alias("s")).count() == 1
    with pytest.raises(ValueError):
        sh.word_shingles(F.col("t"), 0)


def test_jaccard_and_estimate(spark):
    def j(a, b):
        return spark.createDataFrame([(a, b)], "a array<int>, b array<int>").select(sh.jaccard(F.col("a"), F.col("b")).alias("j")).first()["j"]

    assert (j([1, 2, 3], [2, 3, 4]), j([1], [2]), j([], [])) == (0.5, 0.0, 0.0)
    df = spark.createDataFrame([([1, 2], [1])], "a array<int>, b array<int>")
    with pytest.raises(Exception, match="differ in length"):
        df.select(sh.estimate(F.col("a"), F.col("b"))).collect()


def test_minhash_forms_agree_and_estimate(spark):
    params = sh.hash_params(200, 7)
    assert sh.hash_params(1, 4099) == [(868373596377458534, 832289431422763383)]
    rng = random.Random(1)
    for want in (0.2, 0.5, 0.8):
        both = round(2 * 400 * want / (1 + want))
        pool = rng.sample(range(2**32), 800 - both)
        a, b = pool[:400], pool[400 - both :]
        df = spark.createDataFrame([("a", a), ("b", b)], "i string, h array<bigint>")
        more = df.unionByName(spark.createDataFrame([("empty", []), ("null", None)], df.schema))
        fast = {r["i"]: list(r["sig"]) for r in more.mapInArrow(sh.minhash_batches(params), "i string, sig array<bigint>").collect()}
        plain = {k: [min((x * p + q) % sh.PRIME for x in v) for p, q in params] for k, v in (("a", a), ("b", b))}
        assert fast == plain
        same = sum(x == y for x, y in zip(fast["a"], fast["b"])) / 200
        assert abs(same - len(set(a) & set(b)) / len(set(a) | set(b))) <= 3 * 0.5 / 200**0.5
    small = spark.createDataFrame([([5, 2**32 - 1, 77],)], "h array<bigint>")
    assert small.select(sh.minhash_expression(F.col("h"), params[:5]).alias("s")).first()["s"] == [min((x * p + q) % sh.PRIME for x in (5, 2**32 - 1, 77)) for p, q in params[:5]]


def test_banding_formulas(spark):
    assert round(sh.lsh_threshold(20, 5), 4) == 0.5493
    assert round(one(spark, 0.8, lambda c: sh.lsh_probability(c, 20, 5), "double"), 5) == 0.99964
    with pytest.raises(Exception, match="bands"):
        one(spark, [1, 2, 3], lambda c: sh.band_keys(c, 2, 2), "array<bigint>")
