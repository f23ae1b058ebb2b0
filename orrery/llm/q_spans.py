"""Queries: long exact spans shared between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.spans import MIN_SPAN, linked_pairs, linked_spans, merged_spans
from orrery.sources.tables import table


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents, copies of equal texts of MIN_SPAN characters included."""
    classes, links, _ = linked_spans(table(spark, sf_dir, "documents"), "doc_id", "text")
    ids = classes.select(F.col("doc").cast("bigint").alias("d"), "cls", "n")
    same = linked_pairs(ids.where(F.col("n") >= MIN_SPAN).select(F.col("cls").alias("grp"), "d"), "d")
    one, two = (ids.select(F.col("d").alias(f"d{x}"), F.col("cls").alias(x)) for x in "ab")
    other = linked_pairs(links, "cls").join(one, "a").join(two, "b").select(F.least("da", "db").alias("a"), F.greatest("da", "db").alias("b"))
    return same.unionByName(other).select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: characters, characters in shared spans, number of spans and share found elsewhere."""
    classes, _, spans = linked_spans(table(spark, sf_dir, "documents"), "doc_id", "text")
    per = merged_spans(spans).groupBy("cls").agg(F.sum(F.col("to_") - F.col("from_")).alias("c"), F.count("*").alias("k"))
    copies = classes.groupBy("cls").agg(F.count("*").alias("copies"))
    whole = (F.col("copies") > 1) & (F.col("n") >= MIN_SPAN)
    chars = F.when(whole, F.col("n")).otherwise(F.coalesce("c", F.lit(0)))
    return classes.join(copies, "cls").join(per, "cls", "left").select(
        F.col("doc").cast("bigint").alias("doc_id"), F.col("n").alias("n_chars"), chars.alias("shared_chars"), F.when(whole, F.lit(1)).otherwise(F.coalesce("k", F.lit(0))).cast("bigint").alias("n_spans"), F.coalesce(F.try_divide(chars, F.col("n")), F.lit(0.0)).alias("shared_share")
    )


def p9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shared span of every document, in code points."""
    classes, _, spans = linked_spans(table(spark, sf_dir, "documents"), "doc_id", "text")
    copies = classes.groupBy("cls").agg(F.count("*").alias("copies"))
    ids = classes.join(copies, "cls")
    whole = ids.where((F.col("copies") > 1) & (F.col("n") >= MIN_SPAN)).select(F.col("doc").cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("span_from"), F.col("n").alias("span_to"))
    parts = ids.where(F.col("copies") == 1).join(merged_spans(spans), "cls").select(F.col("doc").cast("bigint").alias("doc_id"), F.col("from_").alias("span_from"), F.col("to_").alias("span_to"))
    return whole.unionByName(parts)


QUERIES = {"p9_found": p9_found, "p9_shares": p9_shares, "p9_spans": p9_spans}

_GRAMS = f"""
WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) >= {MIN_SPAN}),
g AS MATERIALIZED (SELECT doc_id, p, hash(substr(text, p::BIGINT, {MIN_SPAN})) AS h FROM (SELECT doc_id, text, unnest(range(1, n - {MIN_SPAN} + 2)) AS p FROM d)),
again AS MATERIALIZED (SELECT h FROM g GROUP BY h HAVING count(DISTINCT doc_id) > 1),
s AS (SELECT doc_id, p, lag(p) OVER w AS before, lead(p) OVER w AS after FROM g SEMI JOIN again USING (h) WINDOW w AS (PARTITION BY doc_id ORDER BY p))
"""

ORACLES = {
    "p9_found": _GRAMS + ", m AS (SELECT DISTINCT doc_id, h FROM g SEMI JOIN again USING (h)) SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM m a JOIN m b ON a.h = b.h AND a.doc_id < b.doc_id",
    "p9_shares": _GRAMS
    + f""", c AS (SELECT doc_id, sum(least({MIN_SPAN}, coalesce(after - p, {MIN_SPAN})))::BIGINT AS c, count(*) FILTER (before IS NULL OR p > before + {MIN_SPAN}) AS k FROM s GROUP BY doc_id)
    SELECT doc_id, length(text) AS n_chars, coalesce(c, 0) AS shared_chars, coalesce(k, 0) AS n_spans, CASE WHEN length(text) > 0 THEN coalesce(c, 0) / length(text)::DOUBLE ELSE 0 END AS shared_share FROM documents LEFT JOIN c USING (doc_id) WHERE text IS NOT NULL""",
    "p9_spans": _GRAMS
    + f""", r AS (SELECT doc_id, p, sum((before IS NULL OR p > before + {MIN_SPAN})::INT) OVER (PARTITION BY doc_id ORDER BY p) AS grp FROM s)
    SELECT doc_id, min(p) - 1 AS span_from, max(p) - 1 + {MIN_SPAN} AS span_to FROM r GROUP BY doc_id, grp""",
}
