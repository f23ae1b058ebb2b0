"""Queries: documents mixed to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.mixing import mix_sources
from orrery.sources.tables import table


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mix_sources(table(spark, sf_dir, "documents"), "doc_id", "text", "source", table(spark, sf_dir, "mix_targets"))


def p8_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents to take, the source each is taken for, how often, and its tokens."""
    return _mix(spark, sf_dir)[0].select(F.col("doc").cast("bigint").alias("doc_id"), "source", "uses", F.col("tokens").alias("n_tokens"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets beside actual tokens, shares and repeats, also for sources that can't reach their target."""
    return _mix(spark, sf_dir)[1]


QUERIES = {"p8_selected": p8_selected, "p8_report": p8_report}
ORACLES: dict[str, str] = {}
