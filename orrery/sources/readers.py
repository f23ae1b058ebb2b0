"""Readers: text, delimited relations, JSON, digests, signatures; every schema explicit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.assertions import assert_not_empty, assert_unique
from orrery.operators.runs import RUN_SCHEMA

UTTERANCES = "record_type string, utterance_id string, mission_time string, speaker_code string, word_count bigint, text string"
SPEAKERS = "record_type string, speaker_code string, category string, description string"
FACTS = "record_id string, dimension_key string, word_count bigint, text_bytes bigint, text string"
DIMENSIONS = "dimension_key string, category string"
FACTS_HEADER_BYTES = 51


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of every file below a directory."""
    return spark.read.text(path)


def read_whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): each file as one text, named without folder and suffix."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("file"), F.col("value").alias("text"))


def read_quoted(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """A tab-separated relation with CSV quoting; a row of another arity or type stops the job. A bare empty field is null, a quoted one empty."""
    return spark.read.csv(path, sep="\t", header=header, quote='"', escape='"', multiLine=True, schema=schema, mode="FAILFAST", enforceSchema=False, nullValue="\x00")


def read_raw_facts(spark: SparkSession, path: str, schema: str = FACTS) -> DataFrame:
    """Unquoted tab-separated facts: the last field may hold tabs and quotes, an optional header line is skipped.

    A line with fewer fields, or a number that isn't one, stops the job.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [c.split()[1] for c in schema.split(", ")]
    f = F.split("value", "\t", len(names))
    checked = F.when(F.size(f) == len(names), f).otherwise(F.raise_error(F.concat(F.lit("malformed record: "), F.substring("value", 1, 80))).cast("array<string>"))
    rows = spark.read.text(path).where(~F.startswith("value", F.lit(names[0] + "\t")))
    return rows.select(checked.alias("f")).select(*[F.col("f")[i].cast(k).alias(n) for i, (n, k) in enumerate(zip(names, kinds))])


def read_dimensions(spark: SparkSession, path: str) -> DataFrame:
    """The dimension relation: never empty, one row a key."""
    df = spark.read.csv(path, sep="\t", header=True, quote="", schema=DIMENSIONS, mode="FAILFAST")
    return assert_unique(assert_not_empty(df, "dimension table"), "dimension_key")


def read_tagged(spark: SparkSession, *paths: str) -> dict[str, DataFrame]:
    """Relations mixed in one input, split by their tag: 'U' with 6 fields, 'S' with 4; anything else stops the job."""
    f = F.split("value", "\t")
    rows = spark.read.text(list(paths)).where((F.trim("value") != "") & ~F.startswith("value", F.lit("record_type\t"))).select(f.alias("f"))
    good = ((F.col("f")[0] == "U") & (F.size("f") == 6)) | ((F.col("f")[0] == "S") & (F.size("f") == 4))
    bad = rows.where(~good).limit(1).collect()
    if bad:
        raise ValueError(f"malformed record: {bad[0]['f'][:2]}")
    split = lambda tag, schema: rows.where(F.col("f")[0] == tag).select(*[F.col("f")[i].cast(c.split()[1]).alias(c.split()[0]) for i, c in enumerate(schema.split(", "))])
    return {"U": split("U", UTTERANCES), "S": split("S", SPEAKERS)}


def read_dump_status(spark: SparkSession, path: str, base: str) -> DataFrame:
    """(part, first, last, name, url, bytes, sha1) of the article parts named in a dump-status file."""
    kind = "jobs map<string,struct<files:map<string,struct<url:string,size:bigint,sha1:string>>>>"
    files = spark.read.json(path, schema=kind, multiLine=True).select(F.explode("jobs")).select(F.explode("value.files").alias("name", "m"))
    pattern = r"pages-articles-multistream(\d+)\.xml-p(\d+)p(\d+)\.bz2$"
    good = files.where(F.col("name").rlike(pattern) & (F.coalesce("m.url", F.lit("")) != "") & (F.coalesce("m.size", F.lit(0)) > 0))
    n = [F.regexp_extract("name", pattern, i).cast("bigint").alias(c) for i, c in ((1, "part"), (2, "first"), (3, "last"))]
    full = F.when(F.col("m.url").rlike("^[a-z]+://"), F.col("m.url")).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.ltrim(F.col("m.url"), F.lit("/"))))
    return good.select(*n, "name", full.alias("url"), F.col("m.size").alias("bytes"), F.col("m.sha1").alias("sha1"))


def read_manifest(spark: SparkSession, path: str, budget: int) -> DataFrame:
    """The parts of a source manifest: not empty, every field there, no more bytes than the budget."""
    from orrery.operators.assertions import CheckFailed, assert_budget

    parts = spark.read.json(path, schema="parts array<struct<name:string,url:string,bytes:bigint,sha1:string>>", multiLine=True).select(F.inline("parts"))
    if parts.where("name is null or url is null or bytes is null or sha1 is null").limit(1).count():
        raise CheckFailed("a manifest part lacks a field")
    return assert_budget(assert_not_empty(parts, "manifest"), "bytes", budget)


def read_run_records(spark: SparkSession, root: str) -> DataFrame:
    """Run records below a folder with their path; files that aren't records are skipped."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root, schema=RUN_SCHEMA, multiLine=True, mode="PERMISSIVE")
    return raw.withColumn("path", F.input_file_name()).where("elapsed_seconds is not null and engine is not null")


def read_signatures(spark: SparkSession, path: str) -> DataFrame:
    """(window_id, sig) of 'id<TAB>v1 v2 ...' lines."""
    f = F.split("value", "\t", 2)
    return spark.read.text(path).select(f[0].alias("window_id"), F.transform(F.split(f[1], " "), lambda v: v.cast("bigint")).alias("sig"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha1, sha256) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha1("content").alias("sha1"), F.sha2("content", 256).alias("sha256"))


def read_parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A written result, all its part files."""
    return spark.read.csv(path, sep="\t", schema=schema, quote="", mode="FAILFAST")


def read_report_curve(spark: SparkSession, path: str, k: str) -> DataFrame:
    """(setting, bin, pairs, measured, theory) of a similarity report."""
    kind = "by_k map<string,struct<settings:map<string,struct<s_curve:array<struct<bin:string,pairs:bigint,measured:double,theory:double>>>>>>"
    return spark.read.json(path, schema=kind, multiLine=True).select(F.explode(F.col("by_k")[k]["settings"]).alias("setting", "s")).select("setting", F.inline("s.s_curve"))
