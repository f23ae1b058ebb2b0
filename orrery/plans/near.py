"""Near-duplicate search over windows of the documents: 50 words, stride 25, shingles of 3 words, 100 minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.shingles import PRIME, char_shingles, hash_params, lsh_probability, lsh_threshold, stable_hash, word_shingles
from orrery.operators import similarity as S
from orrery.operators import window_pairs as P
from orrery.runtime import spread, stage
from orrery.sources.tables import table

SIZE, STRIDE, K, N, SEED, BANDS, ROWS, NEAR, KEEP = 50, 25, 3, 100, 4099, 25, 4, 0.5, 0.1
SETTINGS = ((20, 5), (25, 4), (10, 10))


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.token_windows(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), F.format_string("%06d", "doc_id"), "text", SIZE, STRIDE)


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hashed_sets(_windows(spark, sf_dir), word_shingles(F.col("tokens"), K))


def _packed(spark: SparkSession, sf_dir: str, n: int = 0) -> DataFrame:
    """The windows' sets as a packed stage table, with n minima."""
    return P.packed(table(spark, sf_dir, "documents").select("doc_id", "text"), F.format_string("%06d", "doc_id"), F.col("text"), SIZE, STRIDE, K, n, SEED)


def _sigs(sets: DataFrame) -> DataFrame:
    """Signatures as a stage table: both sides of the bucket join read it."""
    return stage(S.signatures(sets, N, SEED), "window-signatures")


def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir).select("window_id", "file", "start", F.array_join("tokens", " ").alias("tokens"))


def _shingle_counts(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    return _windows(spark, sf_dir).select(F.explode(make(F.col("tokens"))).alias("shingle")).groupBy("shingle").agg(F.count("*").alias("windows"))


def word_shingle_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 3-word shingle with the number of windows that hold it."""
    return _shingle_counts(spark, sf_dir, lambda t: word_shingles(t, K))


def char_shingle_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 9-character shingle with the number of windows that hold it."""
    return _shingle_counts(spark, sf_dir, lambda t: char_shingles(t, 9))


def shingle_crc32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_shingle_windows(spark, sf_dir).select("shingle", stable_hash(F.col("shingle")).alias("h"))


def minhash_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.signatures(_sets(spark, sf_dir), N, SEED).select("window_id", F.array_join(F.transform("sig", lambda v: v.cast("string")), " ").alias("signature"))


def lsh_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of two windows or more, with their members in order."""
    b = S.buckets(_sigs(_sets(spark, sf_dir)), BANDS, ROWS)
    return b.groupBy("bucket").agg(F.count("*").alias("members"), F.min("window_id").alias("first"), F.max("window_id").alias("last")).where("members > 1")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.candidate_pairs(S.buckets(_sigs(_sets(spark, sf_dir)), BANDS, ROWS))


def lsh_pair_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw candidate pairs with the number of bands they share."""
    return _pairs(spark, sf_dir).select("a", "b", "bands")


def lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs that aren't overlaps within one document."""
    return _pairs(spark, sf_dir).where(~S.trivial(SIZE)).select("a", "b")


def lsh_candidates_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).where(S.cross()).select("a", "b")


def exact_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs kept: similarity 0.1 or more."""
    return P.similar_pairs(_packed(spark, sf_dir), SIZE, KEEP).select("a", "b", "j")


def jaccard_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = P.similarity_counts(_packed(spark, sf_dir), SIZE)
    return counts.groupBy(S.bin_of(S.similarity(F.col("both"), F.col("n")), 20).alias("bin")).agg(F.sum("pairs").alias("pairs"))


def _estimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.estimate_counts(_packed(spark, sf_dir, N), SIZE, KEEP)


def minhash_error_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.error_bins(_estimated(spark, sf_dir), N, "pairs")


def minhash_error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.error_summary(_estimated(spark, sf_dir), N, "pairs")


def _evaluations(spark: SparkSession, sf_dir: str, only_cross: bool) -> DataFrame:
    return S.rates(P.evaluated(_packed(spark, sf_dir, N), SETTINGS, SIZE, NEAR, only_cross), "setting")


def lsh_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluations(spark, sf_dir, False)


def lsh_evaluation_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluations(spark, sf_dir, True)


def s_curve_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = _packed(spark, sf_dir, N)
    return S.s_curve_counted(P.similarity_counts(sets, SIZE), P.candidates(sets, BANDS, ROWS, SIZE), BANDS, ROWS, KEEP)


def s_curve_theory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold and candidate probability of every setting over similarity 0 to 1."""
    s = spark.range(21).select((F.col("id") / 20).alias("s"))
    parts = [s.select(F.lit(f"b={b},r={r}").alias("setting"), "s", F.lit(lsh_threshold(b, r)).alias("threshold"), lsh_probability(F.col("s"), b, r).alias("probability")) for b, r in SETTINGS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def coverage_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").where(F.lower("text").rlike("[a-z]")).select(F.format_string("%06d", "doc_id").alias("file"))
    return S.coverage(P.near_pairs(_packed(spark, sf_dir), SIZE, NEAR), files, SIZE, NEAR)


def windows_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.window_counts(_windows(spark, sf_dir))


def top_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best pairs. Where pairs of NEAR or more make up all ten, those below them can't be among them."""
    sets, file = _packed(spark, sf_dir), F.format_string("%06d", "doc_id")
    for least in (NEAR, KEEP):
        top = S.best_pairs(P.near_pairs(sets, SIZE, least), SIZE)
        rows = top.collect()
        if len(rows) == 10:
            break
    files = sorted({r[i].rpartition(":")[0] for r in rows for i in "ab"})
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").where(file.isin(files))
    return S.with_texts(spark.createDataFrame(rows, top.schema), S.token_windows(docs, file, "text", SIZE, STRIDE))


def lsh_candidates_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate that isn't trivial with its exact similarity."""
    return P.candidates(_packed(spark, sf_dir, N), BANDS, ROWS, SIZE).select("a", "b", "j")


QUERIES = {
    f.__name__: f
    for f in (
        lsh_candidates_exact, token_windows, word_shingle_windows, char_shingle_windows, shingle_crc32, minhash_signatures, lsh_buckets, lsh_pair_bands, lsh_candidates, lsh_candidates_cross, exact_jaccard_pairs, jaccard_histogram,
        minhash_error_bins, minhash_error_summary, lsh_evaluation, lsh_evaluation_cross, s_curve_measured, s_curve_theory, coverage_words, windows_per_doc, top_near_duplicates,
    )
}

# --- the same in DuckDB's SQL ---
def _crc_table() -> str:
    rows = []
    for i in range(256):
        c = i
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        rows.append(str(c))
    return "[" + ",".join(rows) + "]"


_WIN = f"""
WITH docs AS (SELECT printf('%06d', doc_id) AS file, regexp_extract_all(replace(lower(text), '’', ''''), '[a-z]+(?:''[a-z]+)*') AS w FROM documents),
st AS (SELECT file, w, unnest(list_distinct(list_concat(range(0, greatest(len(w) - {SIZE}, 0) + 1, {STRIDE}), [greatest(len(w) - {SIZE}, 0)]))) AS start FROM docs WHERE len(w) > 0),
win AS MATERIALIZED (SELECT printf('%s:%06d', file, start) AS window_id, file, start, w[start + 1 : start + {SIZE}] AS tokens FROM st),
"""
_SH = f"""
sh AS MATERIALIZED (SELECT DISTINCT window_id, file, start, unnest(list_transform(range(1, len(tokens) - {K} + 2), lambda i: array_to_string(tokens[i : i + {K} - 1], ' '))) AS shingle FROM win WHERE len(tokens) >= {K}),
"""
_HASHED = f"""
crc AS MATERIALIZED (SELECT shingle, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(shingle, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS h
  FROM (SELECT DISTINCT shingle FROM sh), (SELECT {_crc_table()}::BIGINT[] AS t)),
hs AS MATERIALIZED (SELECT DISTINCT window_id, file, start, h FROM sh JOIN crc USING (shingle)),
"""
_PARAMS = "[" + ",".join(f"{{'a': {a}::HUGEINT, 'b': {b}::HUGEINT}}" for a, b in hash_params(N, SEED)) + "]"
_SIG = f"""
perm AS MATERIALIZED (SELECT h, list_transform({_PARAMS}, lambda q: ((q.a * h::HUGEINT + q.b) % {PRIME}::HUGEINT)::BIGINT) AS p FROM (SELECT DISTINCT h FROM hs)),
sig AS MATERIALIZED (SELECT window_id, any_value(file) AS file, any_value(start) AS start, [{", ".join(f"min(p[{i + 1}])" for i in range(N))}] AS s FROM hs JOIN perm USING (h) GROUP BY window_id),
"""
_TRIVIAL = f"(x.file = y.file AND abs(x.start - y.start) < {SIZE})"
_TRUTH = f"""
sizes AS (SELECT window_id, any_value(file) AS file, any_value(start) AS start, count(*) AS n FROM hs GROUP BY window_id),
truth AS MATERIALIZED (SELECT p.a, p.b, x.file AS file_a, y.file AS file_b, x.start AS start_a, y.start AS start_b, c / (x.n + y.n - c)::DOUBLE AS j
  FROM (SELECT x.window_id AS a, y.window_id AS b, count(*) AS c FROM hs x JOIN hs y ON x.h = y.h AND x.window_id < y.window_id GROUP BY 1, 2) p JOIN sizes x ON p.a = x.window_id JOIN sizes y ON p.b = y.window_id WHERE NOT {_TRIVIAL}),
"""


def _cands(b: int, r: int, name: str) -> str:
    return f"""
bk_{name} AS MATERIALIZED (SELECT window_id, file, start, unnest(list_transform(range(0, {b}), lambda i: i::VARCHAR || ':' || substr(sha1(array_to_string(s[i * {r} + 1 : i * {r} + {r}], ',')), 1, 16))) AS bucket FROM sig),
cand_{name} AS MATERIALIZED (SELECT x.window_id AS a, y.window_id AS b, any_value(x.file) AS file_a, any_value(y.file) AS file_b, bool_or({_TRIVIAL}) AS trivial, count(*) AS bands FROM bk_{name} x JOIN bk_{name} y ON x.bucket = y.bucket AND x.window_id < y.window_id GROUP BY 1, 2),
"""


def _tidy(sql: str) -> str:
    return sql.rstrip().rstrip(",") + "\n"


_ERR = "est AS (SELECT j, len(list_filter(range(1, 101), lambda i: x.s[i] = y.s[i])) / 100::DOUBLE - j AS e FROM truth t JOIN sig x ON t.a = x.window_id JOIN sig y ON t.b = y.window_id WHERE j >= 0.1)"


def _eval(only_cross: bool) -> str:
    pick = "WHERE file_a <> file_b" if only_cross else ""
    also = "AND c.file_a <> c.file_b" if only_cross else ""
    parts = []
    for b, r in SETTINGS:
        n = f"{b}_{r}"
        parts.append(f"""SELECT 'b={b},r={r}' AS setting, true_pairs, candidates, round(hits / nullif(true_pairs, 0)::DOUBLE, 4) AS recall, round(hits / nullif(candidates, 0)::DOUBLE, 4) AS precision, verified_candidates,
          round(vh / nullif(true_pairs, 0)::DOUBLE, 4) AS verified_recall, round(vh / nullif(verified_candidates, 0)::DOUBLE, 4) AS verified_precision
        FROM (SELECT (SELECT count(*) FROM (SELECT * FROM truth {pick}) WHERE j >= {NEAR}) AS true_pairs, count(*) AS candidates, count(*) FILTER (j >= {NEAR}) AS hits, count(*) FILTER (est >= {NEAR}) AS verified_candidates, count(*) FILTER (est >= {NEAR} AND j >= {NEAR}) AS vh
          FROM (SELECT coalesce(t.j, 0) AS j, len(list_filter(range(1, 101), lambda i: x.s[i] = y.s[i])) / 100::DOUBLE AS est FROM cand_{n} c JOIN sig x ON c.a = x.window_id JOIN sig y ON c.b = y.window_id LEFT JOIN truth t ON c.a = t.a AND c.b = t.b WHERE NOT c.trivial {also}))""")
    return _WIN + _SH + _HASHED + _SIG + _TRUTH + _tidy("".join(_cands(b, r, f"{b}_{r}") for b, r in SETTINGS)) + " UNION ALL ".join(parts)


_BASE = _WIN + _SH + _HASHED
_CAND = _BASE + _SIG + _tidy(_cands(BANDS, ROWS, "m"))

# the greedy choice, a pair a step: the best one left that doesn't overlap a taken pair of the same files on both sides
_TOP = f"""
ranked AS MATERIALIZED (SELECT a, b, file_a, file_b, start_a, start_b, j, row_number() OVER (ORDER BY j DESC, a, b) AS rn FROM truth WHERE file_a <> file_b AND j >= 0.1),
pick AS (SELECT 0 AS n, 0::BIGINT AS last, []::STRUCT(fa VARCHAR, fb VARCHAR, x BIGINT, y BIGINT, rn BIGINT)[] AS taken
  UNION ALL SELECT n + 1, min(c.rn), list_append(taken, arg_min({{'fa': c.file_a, 'fb': c.file_b, 'x': c.start_a::BIGINT, 'y': c.start_b::BIGINT, 'rn': c.rn}}, c.rn)) FROM pick JOIN ranked c ON c.rn > pick.last
  WHERE n < 10 AND len(list_filter(taken, lambda t: t.fa = c.file_a AND t.fb = c.file_b AND abs(t.x - c.start_a) < {SIZE} AND abs(t.y - c.start_b) < {SIZE})) = 0 GROUP BY n, taken),
best AS (SELECT unnest(arg_max(taken, n)).rn AS rn FROM pick),
ex AS (SELECT window_id, array_to_string(tokens[1:14], ' ') || CASE WHEN len(tokens) > 14 THEN ' ...' ELSE '' END AS t FROM win)
SELECT a, b, round(j, 4) AS jaccard, x.t AS a_text, y.t AS b_text FROM best JOIN ranked USING (rn) JOIN ex x ON x.window_id = a JOIN ex y ON y.window_id = b
"""

ORACLES = {
    "lsh_candidates_exact": _BASE + _SIG + _TRUTH + _tidy(_cands(BANDS, ROWS, "m")) + "SELECT c.a, c.b, coalesce(j, 0) AS j FROM cand_m c LEFT JOIN truth t ON c.a = t.a AND c.b = t.b WHERE NOT trivial",
    "top_near_duplicates": (_BASE + _TRUTH + _TOP).replace("WITH docs", "WITH RECURSIVE docs", 1),
    "token_windows": _tidy(_WIN) + "SELECT window_id, file, start::INT AS start, array_to_string(tokens, ' ') AS tokens FROM win",
    "word_shingle_windows": _tidy(_WIN + _SH) + "SELECT shingle, count(*) AS windows FROM sh GROUP BY 1",
    "char_shingle_windows": _tidy(_WIN) + "SELECT shingle, count(*) AS windows FROM (SELECT DISTINCT window_id, unnest(list_transform(range(1, length(x) - 7), lambda i: substr(x, i, 9))) AS shingle FROM (SELECT window_id, array_to_string(tokens, ' ') AS x FROM win) WHERE length(x) >= 9) GROUP BY 1",
    "shingle_crc32": _tidy(_WIN + _SH + _HASHED) + "SELECT shingle, h FROM crc",
    "minhash_signatures": _tidy(_BASE + _SIG) + "SELECT window_id, array_to_string(s, ' ') AS signature FROM sig",
    "lsh_buckets": _CAND + "SELECT bucket, count(*) AS members, min(window_id) AS first, max(window_id) AS last FROM bk_m GROUP BY 1 HAVING count(*) > 1",
    "lsh_pair_bands": _CAND + "SELECT a, b, bands FROM cand_m",
    "lsh_candidates": _CAND + "SELECT a, b FROM cand_m WHERE NOT trivial",
    "lsh_candidates_cross": _CAND + "SELECT a, b FROM cand_m WHERE file_a <> file_b",
    "exact_jaccard_pairs": _tidy(_BASE + _TRUTH) + "SELECT a, b, j FROM truth WHERE j >= 0.1",
    "jaccard_histogram": _tidy(_BASE + _TRUTH) + "SELECT least(floor(j * 20)::INT, 19) AS bin, count(*) AS pairs FROM truth GROUP BY 1",
    "minhash_error_bins": _BASE + _SIG + _TRUTH + _ERR + " SELECT bin, count(*) AS pairs, round(avg(e), 4) AS mean_error, round(avg(abs(e)), 4) AS mean_abs_error, round(sqrt(avg(e * e)), 4) AS rmse, round(sqrt(((bin + 0.5) / 10) * (1 - (bin + 0.5) / 10) / 100), 4)::DOUBLE AS theory_sd_at_mid FROM (SELECT least(floor(j * 10)::INT, 9) AS bin, e FROM est) GROUP BY bin",
    "minhash_error_summary": _BASE + _SIG + _TRUTH + _ERR + " SELECT count(*) AS pairs, round(avg(abs(e)), 4) AS mean_abs_error, round(sqrt(avg(e * e)), 4) AS rmse, 0.1::DOUBLE AS one_over_sqrt_n, round(avg((abs(e) <= 0.1::DOUBLE)::INT), 4) AS within_one_over_sqrt_n FROM est",
    "lsh_evaluation": _eval(False),
    "lsh_evaluation_cross": _eval(True),
    "s_curve_measured": _BASE + _SIG + _TRUTH + _tidy(_cands(BANDS, ROWS, "m")) + f"SELECT bin, count(*) FILTER (j >= 0.1) AS pairs, round(avg(hit) FILTER (j >= 0.1), 4) AS measured, round(avg(1 - pow(1 - pow(j, {ROWS}), {BANDS})) FILTER (j >= 0.1), 4) AS theory FROM (SELECT least(floor(j * 20)::INT, 19) AS bin, j, (c.a IS NOT NULL)::INT AS hit FROM truth t LEFT JOIN cand_m c ON t.a = c.a AND t.b = c.b) GROUP BY bin HAVING min(j) >= 0.1",
    "s_curve_theory": " UNION ALL ".join(f"SELECT 'b={b},r={r}' AS setting, i / 20::DOUBLE AS s, pow(1 / {b}::DOUBLE, 1 / {r}::DOUBLE) AS threshold, 1 - pow(1 - pow(i / 20::DOUBLE, {r}), {b}) AS probability FROM range(21) t(i)" for b, r in SETTINGS),
    "coverage_words": _BASE + _tidy(_TRUTH) + f", hit AS (SELECT DISTINCT * FROM (SELECT file_a AS file, start_a AS start FROM truth WHERE file_a <> file_b AND j >= {NEAR} UNION ALL SELECT file_b, start_b FROM truth WHERE file_a <> file_b AND j >= {NEAR})), c AS (SELECT file, count(DISTINCT p) AS covered FROM (SELECT file, unnest(range(start, start + {SIZE})) AS p FROM hit) GROUP BY file) SELECT f.file, coalesce(covered, 0) AS covered FROM (SELECT DISTINCT file FROM win) f LEFT JOIN c USING (file)",
    "windows_per_doc": _tidy(_WIN) + "SELECT file, count(*) AS windows, max(start + len(tokens)) AS words FROM win GROUP BY file",
}
