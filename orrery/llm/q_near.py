"""Queries: near-duplicate utterances and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.near_duplicates import components, near_duplicates, similar_pairs
from orrery.sources.tables import table

_TABLES = (("utterances", "utterance_id"), ("facts", "record_id"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 3 words, similarity 0.5 and 12 words at least, as the test data's statement fixes them."""

    def pairs(name: str, rid: str) -> DataFrame:
        members, links = near_duplicates(table(spark, sf_dir, name), rid, "text", k=3, threshold=0.5, min_words=12)
        return similar_pairs(members, links).select(F.lit(name).alias("tbl"), "key_a", "key_b")

    a, b = (pairs(*t) for t in _TABLES)
    return a.unionByName(b)


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record with a text of 5 words or more: its class of copies and its group at similarity 0.8 of 5-word runs."""

    def groups(name: str, rid: str) -> DataFrame:
        members, links = near_duplicates(table(spark, sf_dir, name), rid, "text")
        roots = components(links, "rep_a", "rep_b")
        return members.join(roots, F.col("rep") == F.col("node"), "left").select(F.lit(name).alias("tbl"), F.col("rid").alias("record_key"), F.col("rep").alias("class_key"), F.coalesce("root", "rep").alias("group_key"))

    a, b = (groups(*t) for t in _TABLES)
    return a.unionByName(b)


QUERIES = {"p4_found": p4_found, "p4_groups": p4_groups}
_TOKENS = "regexp_extract_all(replace(lower(any_value(text)), '’', ''''), '[a-z]+(?:''[a-z]+)*')"

#: The exact join over an inverted index, all shared runs counted.
_EXACT = " UNION ALL ".join(
    f"""SELECT '{name}' AS tbl, key_a, key_b FROM (
      WITH r AS (SELECT {rid} AS rid, {_TOKENS} AS w FROM {name} WHERE {rid} IS NOT NULL GROUP BY {rid}),
      g AS MATERIALIZED (SELECT DISTINCT rid, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) AS g FROM r WHERE len(w) >= 12),
      n AS (SELECT rid, count(*) AS n FROM g GROUP BY rid),
      p AS (SELECT a.rid AS key_a, b.rid AS key_b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.rid < b.rid GROUP BY ALL)
      SELECT key_a, key_b FROM p JOIN n x ON x.rid = key_a JOIN n y ON y.rid = key_b WHERE c >= 0.5 * (x.n + y.n - c))"""
    for name, rid in _TABLES
)

ORACLES = {"p4_found": _EXACT}
