"""Transcript folding, samples, budgets, shards and run records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.text import collapse_blanks, f1_count, f2_count, flatten_breaks, utf8_bytes
from orrery.operators.runs import parse_counters, summarize_runs
from orrery.operators.sampling import budget_prefix, nested_samples, round_robin
from orrery.operators.transcript import fold_transcript, malformed_headers, text_lines
from orrery.runtime import spread
from orrery.sources.readers import FACTS_HEADER_BYTES
from orrery.sources.tables import table

TARGETS = {"small": 20_000, "medium": 200_000, "large": 2_000_000}


def transcript_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), "text")
    return fold_transcript(text_lines(spread(docs), "file", "text"))


def transcript_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), "text")
    return malformed_headers(text_lines(spread(docs), "file", "text"))


def sanitized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with line breaks flattened, white space collapsed, and recomputed words and bytes."""
    t = F.col("text")
    return table(spark, sf_dir, "facts").select("record_id", "ingested_at", flatten_breaks(t).alias("flat"), collapse_blanks(t).alias("collapsed"), f1_count(t).alias("f1_words"), f2_count(t).alias("f2_words"), utf8_bytes(t).alias("bytes"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.length(F.concat_ws("\t", F.col("doc_id").cast("string"), F.coalesce("lang", F.lit("")), flatten_breaks(F.col("text")))).alias("chars"), F.octet_length(F.concat_ws("\t", F.col("doc_id").cast("string"), F.coalesce("lang", F.lit("")), flatten_breaks(F.col("text")))).alias("line_bytes"))
    return nested_samples(docs, "doc_id", F.col("line_bytes") + 1, TARGETS, FACTS_HEADER_BYTES)


def nested_sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir).select("sample", "doc_id")


def nested_sample_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, bytes and distinct keys of each sample, and whether it reached its target."""
    got = _samples(spark, sf_dir).groupBy("sample").agg(F.count("*").alias("page_rows"), (F.sum(F.col("line_bytes") + 1) + FACTS_HEADER_BYTES).alias("bytes"), F.count_distinct("lang").alias("output_rows"))
    target = F.create_map(*[F.lit(x) for kv in TARGETS.items() for x in kv])
    return got.withColumn("complete", F.col("bytes") >= target[F.col("sample")])


def budget_prefix_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as parts with a size each, taken in order within a budget."""
    parts = table(spark, sf_dir, "supplier").select("s_suppkey", F.floor(F.abs("s_acctbal")).cast("bigint").alias("bytes"))
    return budget_prefix(parts, ["s_suppkey"], "bytes", 100_000)


def round_robin_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three shards of the nations, each with its number."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    shards = [round_robin(nation, ["n_nationkey"], i, 3).withColumn("shard", F.lit(i)) for i in range(3)]
    return shards[0].unionByName(shards[1]).unionByName(shards[2])


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runs: five data sets, an engine per event type, failures every seventh event."""
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 5).cast("string").alias("dataset_id"),
        F.col("event_type").alias("engine"),
        F.lit("run").alias("label"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("started_utc"),
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("path"),
        F.col("value").alias("elapsed_seconds"),
        F.when(F.col("event_id") % 7 == 0, 1).otherwise(0).alias("exit_status"),
        F.col("event_id").alias("input_rows"),
        (F.col("event_id") * 10).alias("input_bytes"),
        F.col("user_id").alias("output_rows"),
    )


def run_summary_first_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarize_runs(_runs(spark, sf_dir))


def engine_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median time of each engine over the fastest engine's, per data set."""
    s = run_summary_first_median(spark, sf_dir).select("dataset_id", "engine", "median_success_seconds")
    best = s.groupBy("dataset_id").agg(F.min("median_success_seconds").alias("best"))
    return s.join(best, "dataset_id").select("dataset_id", "engine", F.try_divide("median_success_seconds", "best").alias("ratio"))


def counter_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of log lines made from events: two known names and an unknown one, the last value wins."""
    name = F.when(F.col("event_id") % 3 == 0, "Map input records").when(F.col("event_id") % 3 == 1, "CPU time spent (ms)").otherwise("Unknown counter")
    logs = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("run_no"), F.col("event_id").alias("n"), F.concat(F.lit("   "), name, F.lit(" = "), F.floor(F.abs("value")).cast("bigint").cast("string")).alias("line"))
    return parse_counters(logs, "run_no", "n", "line")


QUERIES = {f.__name__: f for f in (transcript_fold, transcript_malformed, sanitized_text, nested_sample_rows, nested_sample_manifest, budget_prefix_parts, round_robin_shards, run_summary_first_median, engine_ratio, counter_parse)}

_ENDS = r"'\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'"
_WS = r"'[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'"
_H = r"'^(\d{2})\s+(\d{2})\s+(\d{2})\s+(\d{2})\s+([A-Z][A-Z0-9/-]*)(?:\s+(.*))?$'"
_FOLD = rf"""
WITH parts AS (SELECT doc_id::VARCHAR AS file, regexp_split_to_array(text, {_ENDS}) AS p FROM documents WHERE text IS NOT NULL),
ls AS (SELECT file, unnest(p) AS line, unnest(range(1, len(p) + 1)) AS line_no FROM parts),
l AS (SELECT file, line_no, trim(regexp_replace(line, {_WS}, ' ', 'g')) AS l FROM ls),
k AS (SELECT *, CASE WHEN l = '' THEN 'blank' WHEN regexp_matches(l, {_H}) THEN 'header' WHEN regexp_matches(l, '^(?:[0-9O]{{2}}\s+){{3}}[0-9O]{{2}}\s+') THEN 'malformed'
  WHEN regexp_matches(l, '^(?:\* \* \*|NOTE|END OF TAPE|INTRODUCTION|APOLLO 11 AIR-TO-GROUND VOICE TRANSCRIPTION|THE FOLLOWING IS A MESSAGE.*|\*{{3}} Three asterisks.*|\(GOSS NET 1\).*|[A-Z][A-Z .''-]+ \(REV\s*\d+\))$') THEN 'meta' ELSE 'text' END AS kind FROM l),
"""
_FOLDED = rf"""
g AS (SELECT *, sum((kind <> 'text')::INT) OVER (PARTITION BY file ORDER BY line_no) AS grp FROM k WHERE kind NOT IN ('blank', 'meta')),
s AS (SELECT file, grp, line_no, kind, CASE WHEN kind = 'header' THEN CASE WHEN regexp_matches(regexp_extract(l, {_H}, 6), '^\([^)]+\)$') THEN '' ELSE regexp_extract(l, {_H}, 6) END ELSE l END AS said,
  CASE WHEN kind = 'header' THEN concat_ws(':', regexp_extract(l, {_H}, 1), regexp_extract(l, {_H}, 2), regexp_extract(l, {_H}, 3), regexp_extract(l, {_H}, 4)) END AS t, CASE WHEN kind = 'header' THEN regexp_extract(l, {_H}, 5) END AS who FROM g WHERE grp > 0),
r AS (SELECT file, grp, min(line_no) AS line_no, max(t) AS mission_time, max(who) AS speaker_code, bool_or(kind = 'header') AS good, string_agg(said, ' ' ORDER BY line_no) FILTER (said <> '') AS text FROM s GROUP BY file, grp)
SELECT file, printf('%s-%06d', file, row_number() OVER (PARTITION BY file ORDER BY line_no)) AS utterance_id, mission_time, speaker_code, len(regexp_extract_all(replace(lower(text), '’', ''''), '[a-z]+(?:''[a-z]+)*')) AS word_count, text
FROM r WHERE good AND text IS NOT NULL
"""
_SAMPLES = f"""
WITH d AS (SELECT doc_id, lang, strlen(concat_ws(chr(9), doc_id::VARCHAR, coalesce(lang, ''), translate(text, chr(13) || chr(10) || chr(9), '   '))) + 1 AS b FROM documents),
r AS (SELECT *, coalesce(sum(b) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (ORDER BY doc_id) AS rn FROM d),
t(sample, target) AS (VALUES {", ".join(f"('{n}', {t})" for n, t in TARGETS.items())}),
picked AS (SELECT sample, target, doc_id, lang, b FROM r, t WHERE rn = 1 OR {FACTS_HEADER_BYTES} + before < target)
"""
_RUNS = """
WITH runs AS (SELECT (user_id % 5)::VARCHAR AS dataset_id, event_type AS engine, 'run' AS label, ts, event_id, value, CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS exit_status, user_id FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL),
s AS (SELECT dataset_id, engine, label, count(*) AS attempts, count(*) FILTER (exit_status = 0) AS successful_attempts, arg_min(value, (ts, event_id)) AS first_seconds, arg_min(exit_status, (ts, event_id)) AS first_exit_status,
  median(value) FILTER (exit_status = 0) AS median_success_seconds, arg_min(event_id, (ts, event_id)) AS input_rows, arg_min(event_id, (ts, event_id)) * 10 AS input_bytes, arg_min(user_id, (ts, event_id)) AS output_rows FROM runs GROUP BY ALL)
"""

ORACLES = {
    "transcript_fold": _FOLD.rstrip() + _FOLDED,
    "transcript_malformed": _FOLD.rstrip().rstrip(",") + " SELECT file, line_no AS line, l AS text FROM k WHERE kind = 'malformed'",
    "sanitized_text": rf"SELECT record_id, ingested_at, translate(text, chr(13) || chr(10) || chr(9), '   ') AS flat, trim(regexp_replace(text, {_WS}, ' ', 'g')) AS collapsed, len(regexp_extract_all(replace(lower(text), '’', ''''), '[a-z]+(?:''[a-z]+)*')) AS f1_words, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+(?:[''’][\p{{L}}\p{{N}}]+)*')) AS f2_words, strlen(text) AS bytes FROM facts",
    "nested_sample_rows": _SAMPLES + "SELECT sample, doc_id FROM picked",
    "nested_sample_manifest": _SAMPLES + f"SELECT sample, count(*) AS page_rows, sum(b)::BIGINT + {FACTS_HEADER_BYTES} AS bytes, count(DISTINCT lang) AS output_rows, sum(b) + {FACTS_HEADER_BYTES} >= any_value(target) AS complete FROM picked GROUP BY sample",
    "budget_prefix_parts": "WITH p AS (SELECT s_suppkey, floor(abs(s_acctbal))::BIGINT AS bytes FROM supplier), r AS (SELECT *, sum(bytes) OVER (ORDER BY s_suppkey) AS run, row_number() OVER (ORDER BY s_suppkey) AS rn FROM p) SELECT s_suppkey, bytes FROM r WHERE rn < coalesce((SELECT min(rn) FROM r WHERE run > 100000 AND rn > 1), 9223372036854775807)",
    "round_robin_shards": "SELECT n_nationkey, n_name, ((row_number() OVER (ORDER BY n_nationkey) - 1) % 3)::INT AS shard FROM nation",
    "run_summary_first_median": _RUNS + "SELECT * FROM s",
    "engine_ratio": _RUNS + "SELECT dataset_id, engine, median_success_seconds / min(median_success_seconds) OVER (PARTITION BY dataset_id) AS ratio FROM s",
    "counter_parse": "SELECT user_id % 50 AS run, CASE event_id % 3 WHEN 0 THEN 'map_input_records' ELSE 'cpu_time_ms' END AS counter, arg_max(floor(abs(value))::BIGINT, event_id) AS value FROM events WHERE event_id % 3 <> 2 AND value IS NOT NULL GROUP BY ALL",
}
