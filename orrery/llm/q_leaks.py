"""Queries: evaluation items leaked into the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.leaks import leaked_items
from orrery.sources.tables import table


def _leaks(spark: SparkSession, sf_dir: str, substitutions: int) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text", substitutions)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir, 0).select(F.col("doc").cast("bigint").alias("doc_id"), F.col("item").alias("item_id"))


def p7_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks with up to 2 substituted words inside a stretch that holds 12 equal ones."""
    return _leaks(spark, sf_dir, 2).select(F.col("doc").cast("bigint").alias("doc_id"), F.col("item").alias("item_id"), "words", "substitutions")


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaked item with the number of documents concerned and its longest stretch."""
    return _leaks(spark, sf_dir, 0).groupBy(F.col("item").alias("item_id")).agg(F.count("*").alias("n_documents"), F.max("words").alias("longest_words"))


QUERIES = {"p7_found": p7_found, "p7_tolerant": p7_tolerant, "p7_items": p7_items}

_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+(?:[''’][\p{L}\p{N}]+)*') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(text, '[\p{L}\p{N}]+(?:[''’][\p{L}\p{N}]+)*') AS w FROM eval_items WHERE text IS NOT NULL),
grams AS (SELECT item_id, least(len(w), 12) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 12) + 2), lambda p: lower(array_to_string(w[p : p + least(len(w), 12) - 1], ' ')))) AS g FROM i WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM grams),
dg AS (SELECT DISTINCT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda p: lower(array_to_string(w[p : p + n - 1], ' ')))) AS g FROM d, lens WHERE len(w) >= n)
SELECT DISTINCT doc_id, item_id FROM dg JOIN grams USING (n, g)
"""

_WORDS = r"""
WITH d AS MATERIALIZED (SELECT doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+(?:[''’][\p{L}\p{N}]+)*'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL),
i AS MATERIALIZED (SELECT item_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+(?:[''’][\p{L}\p{N}]+)*'), lambda x: lower(x)) AS w FROM eval_items WHERE text IS NOT NULL),
"""


def _best(substitutions: int) -> str:
    """Best stretches by comparing whole diagonals: 12 equal words with so many others inside hold a run of 12 // (substitutions + 1) equal ones, which names the diagonal."""
    run = 12 // (substitutions + 1)
    size = f"CASE WHEN len(w) >= 12 THEN {run} ELSE len(w) END"
    cuts = ", ".join(f"{{'equal': list_max(list_transform(range(1, len(c) - {s}), lambda j: c[j + {s + 1}] - c[j])) - 1 - {s}, 'less': -{s}}}" for s in range(substitutions + 1))
    return (
        _WORDS
        + f"""ig AS (SELECT item_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS g FROM (SELECT item_id, w, {size} AS n, unnest(range(1, len(w) - {size} + 2)) AS p FROM i WHERE len(w) > 0)),
dg AS (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM ig) WHERE len(w) >= n)),
diag AS MATERIALIZED (SELECT DISTINCT doc_id, item_id, dg.p - ig.p AS shift FROM dg JOIN ig USING (n, g)),
laid AS (SELECT doc_id, item_id, d.w AS dw, i.w AS iw, shift, greatest(0, -shift) AS lo, least(len(i.w), len(d.w) - shift) AS hi FROM diag JOIN d USING (doc_id) JOIN i USING (item_id)),
cut AS (SELECT doc_id, item_id, len(iw) AS n, list_concat(list_concat([lo - 1], list_filter(range(lo, hi), lambda x: iw[x + 1] <> dw[x + shift + 1])), [hi]) AS c FROM laid WHERE hi > lo),
best AS (SELECT doc_id, item_id, n, list_max(list_filter([{cuts}], lambda x: x.equal IS NOT NULL)) AS b FROM cut),
leak AS (SELECT doc_id, item_id, max({{'equal': b.equal, 'words': b.equal - b.less, 'less': -b.less}}) AS b FROM best WHERE b.equal >= least(12, n) GROUP BY ALL)
"""
    )


ORACLES = {
    "p7_found": _SQL,
    "p7_items": _best(0) + "SELECT item_id, count(*) AS n_documents, max(b.words)::BIGINT AS longest_words FROM leak GROUP BY 1",
    "p7_tolerant": _best(2) + "SELECT doc_id, item_id, b.words::BIGINT AS words, b.less::BIGINT AS substitutions FROM leak",
}
