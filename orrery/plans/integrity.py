"""Queries on references and skew over the utterance and fact tables."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.labels import label_code, outer_blanks_off
from orrery.operators.references import coded, contiguous_runs, integer_orphans, key_codes, live_runs, micros, orphan_references
from orrery.operators.skew import hot_keys, key_profiles
from orrery.runtime import maybe_broadcast, side_by_side, stage
from orrery.sources.tables import table


def _code_of_label(utterances: DataFrame, speakers: DataFrame) -> DataFrame:
    """(record_key, ref_key, ingested_at): labels as codes, full descriptions replaced by their row's code."""
    said = speakers.where("description is not null and speaker_code is not null").groupBy(F.upper("description").alias("said")).agg(F.min("speaker_code").alias("said_code"))
    side, _ = maybe_broadcast(said)
    return (
        utterances.select(F.col("utterance_id").alias("record_key"), label_code(F.col("speaker_code")).alias("code"), "ingested_at")
        .where("code is not null")
        .join(side, F.col("code") == F.col("said"), "left")
        .select("record_key", F.coalesce("said_code", "code").alias("ref_key"), "ingested_at")
    )


def _lost(refs: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """The orphans among ``refs`` (record_key, ref_key, ingested_at): keys no parent ever had by their codes, the others by their live runs."""
    keys = parents.select(F.col(key).alias("ref_key"), "added_at", "removed_at")
    codes = stage(key_codes(refs, keys, "ref_key"), "reference-keys")
    rows = coded(refs, codes, "ref_key")
    live = live_runs(coded(keys, codes, "ref_key"), F.col("code"), "added_at", "removed_at")
    never = rows.where("not known").select("record_key", "ref_key", "ingested_at", F.lit("never").alias("orphan_reason"))
    return never.unionByName(orphan_references(rows.where("known"), "code", micros("ingested_at"), live).select("record_key", "ref_key", "ingested_at", "orphan_reason"))


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    speakers, dimensions = table(spark, sf_dir, "speakers"), table(spark, sf_dir, "dimensions")
    facts = table(spark, sf_dir, "facts").select(F.col("record_id").alias("record_key"), outer_blanks_off(F.col("dimension_key")).alias("ref_key"), "ingested_at").where("ref_key is not null")
    parts = side_by_side(
        lambda: _lost(_code_of_label(table(spark, sf_dir, "utterances"), speakers), speakers, "speaker_code").withColumn("tbl", F.lit("utterances")),
        lambda: _lost(facts, dimensions, "dimension_key").withColumn("tbl", F.lit("facts")),
    )
    return parts[0].unionByName(parts[1]).withColumn("month_key", F.date_format("ingested_at", "yyyy-MM"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("tbl", "record_key", "month_key").distinct()


def p2_orphans_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table, month and reason: rows, records and missing keys."""
    per_record = _orphans(spark, sf_dir).groupBy("tbl", "month_key", "orphan_reason", "record_key", "ref_key").agg(F.count("*").alias("n"))
    per_key = per_record.groupBy("tbl", "month_key", "orphan_reason", "ref_key").agg(F.sum("n").alias("n"), F.count("*").alias("records"))
    return per_key.groupBy("tbl", "month_key", "orphan_reason").agg(F.sum("n").alias("n_rows"), F.sum("records").alias("n_records"), F.count("*").alias("n_keys"))


_INTEGER = (("events", "user_id", "ts", "customer", "c_custkey"), ("orders", "o_custkey", "o_orderdate", "customer", "c_custkey"), ("lineitem", "l_suppkey", "l_shipdate", "supplier", "s_suppkey"), ("lineitem", "l_orderkey", "l_shipdate", "orders", "o_orderkey"))


def p2_integer_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references of integer keys per table, key and month: rows and distinct keys."""

    def lost_keys(tbl: str, key: str, at: str, parent: str, pk: str) -> DataFrame:
        refs = table(spark, sf_dir, tbl).select(F.col(key).cast("bigint").alias("k"), F.date_format(at, "yyyy-MM").alias("month_key"))
        lost = integer_orphans(refs, "k", contiguous_runs(table(spark, sf_dir, parent), pk))
        per_key = lost.groupBy("month_key", "k").agg(F.count("*").alias("n"))
        return per_key.groupBy("month_key").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys")).select(F.lit(f"{tbl}.{key}").alias("reference"), "month_key", "n_rows", "n_keys")

    return reduce(DataFrame.unionByName, side_by_side(*[partial(lost_keys, *x) for x in _INTEGER]))


def p2_deleted_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items whose order is gone, per month: the orders that are finished count as deleted."""
    kept = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'")
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.date_format("l_shipdate", "yyyy-MM").alias("month_key"))
    lost = integer_orphans(refs, "k", contiguous_runs(kept, "o_orderkey"))
    return lost.groupBy("month_key", "k").agg(F.count("*").alias("n")).groupBy("month_key").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"))


def _profiles(spark: SparkSession, sf_dir: str, name: str, key: str, rid: str) -> DataFrame:
    size = F.octet_length("text").cast("bigint")
    return key_profiles(table(spark, sf_dir, name), F.col(key), size, sums={"n_words": F.col("word_count"), "n_bytes": size}, latest=(F.col("ingested_at"), F.col(rid))).withColumn("tbl", F.lit(name))


_PROFILED = (("utterances", "speaker_code", "utterance_id"), ("facts", "dimension_key", "record_id"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = side_by_side(*[lambda p=p: hot_keys(_profiles(spark, sf_dir, *p)).select("tbl", F.col("key").alias("hot_key")) for p in _PROFILED])
    return a.unionByName(b)


def p3_key_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, words, bytes, latest record and exact byte quantiles of every key, null keys as a row of their own."""
    a, b = side_by_side(*[lambda p=p: _profiles(spark, sf_dir, *p) for p in _PROFILED])
    return a.unionByName(b).select("tbl", "key", "n_rows", "n_values", "n_words", "n_bytes", "latest_id", "q500", "q900", "q990")


QUERIES = {"p2_found": p2_found, "p2_orphans_by_month": p2_orphans_by_month, "p2_integer_orphans": p2_integer_orphans, "p2_deleted_parents": p2_deleted_parents, "p3_found": p3_found, "p3_key_results": p3_key_results}

_REFS = r"""
WITH refs AS (
  SELECT 'utterances' AS tbl, utterance_id AS record_key,
         upper(regexp_replace(regexp_replace(regexp_replace(speaker_code, '\([^()]*\)|\[[^\[\]]*\]', '', 'g'), '^[^A-Za-z0-9]+', ''), '[^A-Za-z0-9]+$', '')) AS code,
         ingested_at FROM utterances
  UNION ALL
  SELECT 'facts', record_id, regexp_replace(dimension_key, '^\s+|\s+$', '', 'g'), ingested_at FROM facts),
said AS (SELECT upper(description) AS said, min(speaker_code) AS said_code FROM speakers WHERE description IS NOT NULL GROUP BY 1),
keyed AS (
  SELECT tbl, record_key, CASE WHEN tbl = 'utterances' THEN coalesce(said_code, code) ELSE code END AS ref_key, ingested_at
  FROM refs LEFT JOIN said ON refs.code = said.said AND refs.tbl = 'utterances'
  WHERE code IS NOT NULL AND NOT (tbl = 'utterances' AND code = '')),
parents AS (
  SELECT 'utterances' AS tbl, speaker_code AS k, added_at, removed_at FROM speakers
  UNION ALL SELECT 'facts', dimension_key, added_at, removed_at FROM dimensions),
orphans AS (
  SELECT r.*, strftime(ingested_at, '%Y-%m') AS month_key FROM keyed r
  WHERE NOT EXISTS (SELECT 1 FROM parents p WHERE p.tbl = r.tbl AND p.k = r.ref_key
    AND (p.added_at IS NULL OR p.added_at <= r.ingested_at) AND (p.removed_at IS NULL OR p.removed_at > r.ingested_at)))
"""

_KEYED = """
WITH rows_ AS (
  SELECT 'utterances' AS tbl, speaker_code AS key, word_count, strlen(text) AS b, ingested_at, utterance_id AS rid FROM utterances
  UNION ALL SELECT 'facts', dimension_key, word_count, strlen(text), ingested_at, record_id FROM facts)
"""

ORACLES = {
    "p2_found": _REFS + "SELECT DISTINCT tbl, record_key, month_key FROM orphans",
    "p2_orphans_by_month": _REFS
    + """, reasons AS (SELECT o.*, CASE WHEN NOT EXISTS (SELECT 1 FROM parents p WHERE p.tbl = o.tbl AND p.k = o.ref_key) THEN 'never'
      WHEN EXISTS (SELECT 1 FROM parents p WHERE p.tbl = o.tbl AND p.k = o.ref_key AND (p.added_at IS NULL OR p.added_at <= o.ingested_at)) THEN 'gone' ELSE 'not_yet' END AS orphan_reason FROM orphans o)
    SELECT tbl, month_key, orphan_reason, count(*) AS n_rows, count(DISTINCT (record_key, ref_key)) AS n_records, count(DISTINCT ref_key) AS n_keys FROM reasons GROUP BY ALL""",
    "p2_integer_orphans": " UNION ALL ".join(f"SELECT '{t}.{k}' AS reference, strftime({a}, '%Y-%m') AS month_key, count(*) AS n_rows, count(DISTINCT {k}) AS n_keys FROM {t} WHERE {k} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} WHERE {pk} = {k}) GROUP BY ALL" for t, k, a, p, pk in _INTEGER),
    "p2_deleted_parents": "SELECT strftime(l_shipdate, '%Y-%m') AS month_key, count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_keys FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') GROUP BY 1",
    "p3_found": _KEYED + "SELECT tbl, key AS hot_key FROM (SELECT tbl, key, count(*) AS n, sum(count(*)) OVER (PARTITION BY tbl) AS total FROM rows_ GROUP BY tbl, key) WHERE key IS NOT NULL AND n >= 0.05 * total",
    "p3_key_results": _KEYED
    + """SELECT tbl, key, count(*) AS n_rows, count(b) AS n_values, sum(word_count)::BIGINT AS n_words, sum(b)::BIGINT AS n_bytes,
      arg_max(rid, (ingested_at, rid)) AS latest_id, quantile_disc(b, 0.5)::BIGINT AS q500, quantile_disc(b, 0.9)::BIGINT AS q900, quantile_disc(b, 0.99)::BIGINT AS q990
    FROM rows_ GROUP BY tbl, key""",
}
