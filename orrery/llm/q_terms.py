"""Queries: frequency of every term."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.terms import term_frequencies
from orrery.sources.tables import table


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [term_frequencies(table(spark, sf_dir, t), i, "text").select(F.lit(f"{t}.text").alias("field_name"), "*") for t, i in (("utterances", "utterance_id"), ("facts", "record_id"))]
    return parts[0].unionByName(parts[1])


def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term of both text fields with occurrences, records and verdict (null: neither)."""
    return _terms(spark, sf_dir).drop("last_record")


def p1_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term with the last record that holds it."""
    return _terms(spark, sf_dir).select("field_name", "term", "last_record")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terms(spark, sf_dir).where("verdict is not null").select("field_name", "term", "verdict")


QUERIES = {"p1_terms": p1_terms, "p1_found": p1_found, "p1_last_seen": p1_last_seen}

_SQL = """
WITH recs AS (
  SELECT 'utterances.text' AS field_name, utterance_id AS rid, any_value(text) AS txt FROM utterances GROUP BY 2
  UNION ALL SELECT 'facts.text', record_id, any_value(text) FROM facts GROUP BY 2),
tok AS (SELECT field_name, rid, unnest(regexp_extract_all(replace(lower(txt), '’', ''''), '[a-z]+(?:''[a-z]+)*')) AS term FROM recs),
cnt AS (SELECT field_name, term, count(*) AS occurrences, count(DISTINCT rid) AS records FROM tok GROUP BY 1, 2),
tot AS (SELECT field_name, count(txt) AS with_text FROM recs GROUP BY 1),
marked AS (SELECT field_name, term, occurrences, records, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.1 * with_text THEN 'common' END AS verdict FROM cnt JOIN tot USING (field_name))
"""

ORACLES = {
    "p1_last_seen": _SQL + "SELECT field_name, term, max(rid) AS last_record FROM tok GROUP BY 1, 2",
    "p1_terms": _SQL + "SELECT * FROM marked",
    "p1_found": _SQL + "SELECT field_name, term, verdict FROM marked WHERE verdict IS NOT NULL",
}
