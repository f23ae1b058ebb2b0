"""Wiki page dumps: pages as facts, name spaces as dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.text import f2_count, flatten_breaks, utf8_bytes
from orrery.operators.assertions import assert_dependency, assert_not_empty

_PAGE = "id string, ns string, revision struct<text:string>"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, dimension_key, word_count, text_bytes, text, well_formed) of an XML dump, plain or bzip2.

    Tags are matched without their name space. A page without id or ns is
    there with well_formed false; a missing text is ''. Broken XML stops the
    job, and so does a dump without a page.
    """
    raw = spark.read.format("xml").option("rowTag", "page").option("ignoreNamespace", True).option("ignoreSurroundingSpaces", False).option("nullValue", "\x00").option("mode", "FAILFAST").schema(_PAGE).load(path)
    body = flatten_breaks(F.coalesce("revision.text", F.lit("")))
    good = (F.coalesce("id", F.lit("")) != "") & (F.coalesce("ns", F.lit("")) != "")
    pages = raw.select(F.col("id").alias("record_id"), F.col("ns").alias("dimension_key"), f2_count(body).alias("word_count"), utf8_bytes(body).alias("text_bytes"), body.alias("text"), good.alias("well_formed"))
    return assert_not_empty(pages, "dump (malformed XML)")


def read_namespaces(spark: SparkSession, path: str) -> DataFrame:
    """(dimension_key, category): an unnamed space is '(main)'; one key with two names is an error."""
    raw = spark.read.format("xml").option("rowTag", "namespace").option("ignoreNamespace", True).schema("_key string, _VALUE string").load(path)
    names = raw.where("_key is not null").select(F.col("_key").alias("dimension_key"), F.coalesce(F.nullif(F.trim(flatten_breaks(F.col("_VALUE"))), F.lit("")), F.lit("(main)")).alias("category")).distinct()
    return assert_dependency(assert_not_empty(names, "name spaces"), "dimension_key", "category").orderBy(F.col("dimension_key").cast("int"))


def facts_of(pages: DataFrame) -> DataFrame:
    return pages.where("well_formed").drop("well_formed")
