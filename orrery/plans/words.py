"""Word counts and text statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.html import visible_text
from orrery.functions.text import blank_tokens, f1_words, f2_count, lines, utf8_bytes
from orrery.operators.relational import sum_counts, word_count
from orrery.sources.tables import table

_TEXT = "text"


def wordcount_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_count(f1_words(_TEXT), table(spark, sf_dir, "documents"))


def wordcount_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_count(f1_words(_TEXT), table(spark, sf_dir, "utterances"))


def wordcount_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 most frequent words; ties by word."""
    return wordcount_documents(spark, sf_dir).orderBy(F.desc("total"), "word").limit(20)


def precounted_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals from partial counts per source."""
    part = table(spark, sf_dir, "documents").select("source", F.explode(f1_words(_TEXT)).alias("w")).groupBy("source", "w").agg(F.count("*").alias("n"))
    return sum_counts(part, "w", "n")


def unicode_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "facts").select("record_id", "ingested_at", f2_count(_TEXT).alias("words"))


def text_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", utf8_bytes(_TEXT).alias("bytes"))


def input_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, tokens and non-empty lines per source and overall."""
    one = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("(none)")).alias("source"), utf8_bytes(_TEXT).alias("b"), F.size(blank_tokens(_TEXT)).alias("t"), F.size(F.filter(lines(_TEXT), lambda x: F.trim(x) != "")).alias("l"))
    return one.rollup("source").agg(F.count("*").alias("files"), F.sum("b").alias("bytes"), F.sum("t").alias("tokens"), F.sum("l").alias("lines"))


def html_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible body text of every fact; a text without a body gives a bare line end."""
    return table(spark, sf_dir, "facts").select("record_id", "ingested_at", visible_text(_TEXT).alias("visible"))


QUERIES = {f.__name__: f for f in (wordcount_documents, wordcount_utterances, wordcount_top20, precounted_sum, unicode_word_counts, text_bytes, input_stats, html_visible_text)}

_WORDS = "unnest(regexp_extract_all(replace(lower(text), '’', ''''), '[a-z]+(?:''[a-z]+)*'))"

ORACLES = {
    "wordcount_documents": f"SELECT word, count(*) AS total FROM (SELECT {_WORDS} AS word FROM documents) GROUP BY word",
    "wordcount_utterances": f"SELECT word, count(*) AS total FROM (SELECT {_WORDS} AS word FROM utterances) GROUP BY word",
    "wordcount_top20": f"SELECT word, count(*) AS total FROM (SELECT {_WORDS} AS word FROM documents) GROUP BY word ORDER BY total DESC, word LIMIT 20",
    "precounted_sum": f"SELECT word, count(*) AS total FROM (SELECT {_WORDS} AS word FROM documents) GROUP BY word",
    "unicode_word_counts": r"SELECT record_id, ingested_at, len(regexp_extract_all(text, '[\p{L}\p{N}]+(?:[''’][\p{L}\p{N}]+)*')) AS words FROM facts",
    "text_bytes": "SELECT doc_id, strlen(text) AS bytes FROM documents",
    "input_stats": r"""
      SELECT source, count(*) AS files, sum(b)::BIGINT AS bytes, sum(t)::BIGINT AS tokens, sum(l)::BIGINT AS lines FROM (
        SELECT coalesce(source, '(none)') AS source, strlen(text) AS b, len(regexp_extract_all(text, '[^\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')) AS t,
          len(list_filter(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'), lambda x: trim(x) <> '')) AS l FROM documents)
      GROUP BY ROLLUP (source)""",
}
