"""Relations written by the sinks and read back by the readers, and the checks that stop a job.

Every query writes whole tables to the shared folder and returns what a
reader makes of the files.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.html import decoded, visible_text
from orrery.functions.text import excerpt, f1_words, flatten_breaks, parse_size, utf8_bytes
from orrery.operators import assertions as A
from orrery.operators.relational import natural_join, strict_lookup_join, sum_counts
from orrery.operators.runs import ids_in
from orrery.operators.sampling import budget_prefix, nested_samples, round_robin
from orrery.operators.verify import same_rows
from orrery.runtime import scratch
from orrery.sources import readers as R
from orrery.sources import sinks as K
from orrery.sources import xmlpages as X
from orrery.sources.tables import table

_FACTS = ["record_id", "dimension_key", "word_count", "text_bytes", "text"]
_NO_XML = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffe}\x{ffff}]"


def _text(*values: Column) -> Column:
    """Tab-separated values of a line; nulls are empty."""
    return F.concat_ws("\t", *[F.coalesce(v.cast("string"), F.lit("")) for v in values])


def _lines_of(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, str]:
    df = table(spark, sf_dir, name).where("text is not null").select(flatten_breaks(F.col("text")).alias("value"))
    path = scratch(spark, "lines")
    df.write.text(path)
    return df, path


def lines_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a folder of text files with its number of occurrences."""
    return R.read_lines(spark, _lines_of(spark, sf_dir, "facts")[1]).groupBy("value").agg(F.count("*").alias("n"))


def whole_files_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from whole files: each file one text, split into its lines."""
    files = R.read_whole_files(spark, _lines_of(spark, sf_dir, "documents")[1])
    return files.select(F.explode(F.split(F.expr("substring(text, 1, length(text) - 1)"), "\n")).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def quoted_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances through the quoting writer: tabs, quotes, line breaks, nulls and empty texts come back as they were."""
    names = [c.split()[0] for c in R.UTTERANCES.split(", ")]
    path = scratch(spark, "quoted")
    K.write_quoted(table(spark, sf_dir, "utterances").select(*names), path)
    return R.read_quoted(spark, path, R.UTTERANCES)


def raw_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts through the raw writer, which turns tabs and line breaks into spaces and null into nothing."""
    path = scratch(spark, "raw")
    K.write_raw(table(spark, sf_dir, "facts").select("record_id", "dimension_key", F.coalesce("word_count", F.lit(-1)).alias("word_count"), F.coalesce("text_bytes", F.lit(-1)).alias("text_bytes"), "text"), path)
    return R.read_raw_facts(spark, path)


def raw_tabs_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts whose last field keeps tabs and quotes, behind a header line."""
    path = scratch(spark, "raw-tabs")
    facts = table(spark, sf_dir, "facts").select(_text(F.col("record_id"), F.col("dimension_key"), F.coalesce("word_count", F.lit(0)), utf8_bytes(F.coalesce("text", F.lit(""))), F.concat(F.lit('"'), F.coalesce(F.translate("text", "\r\n", "  "), F.lit("")), F.lit('\t"'))).alias("value"))
    spark.createDataFrame([("\t".join(_FACTS),)], "value string").unionByName(facts).write.text(path)
    return R.read_raw_facts(spark, path)


def dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension rows, one a key, written and read by their strict reader."""
    path = scratch(spark, "dimensions")
    dims = table(spark, sf_dir, "dimensions").where("dimension_key is not null").groupBy("dimension_key").agg(F.min("category").alias("category"))
    dims.orderBy("dimension_key").write.csv(path, sep="\t", header=True, quote="")
    return R.read_dimensions(spark, path)


def tagged_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances and speakers in one mixed input, split by their tags again."""
    at = {}
    for name, schema in (("utterances", R.UTTERANCES), ("speakers", R.SPEAKERS)):
        at[name] = scratch(spark, "tagged")
        cols = [c.split()[0] for c in schema.split(", ")]
        df = table(spark, sf_dir, name).select(*[F.coalesce(c, F.lit(0)).alias(c) if c == "word_count" else F.col(c) for c in cols])
        K.write_raw(df, at[name])
    got = R.read_tagged(spark, *at.values())
    return got["U"].select("record_type", F.col("utterance_id").alias("key"), "speaker_code", "word_count", "text").unionByName(got["S"].select("record_type", F.col("category").alias("key"), "speaker_code", F.lit(None).cast("bigint").alias("word_count"), F.col("description").alias("text")))


def _xml(value: Column) -> Column:
    value = F.regexp_replace(value, _NO_XML, "")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
        value = F.replace(value, F.lit(sign), F.lit(name))
    return value


def _wrapped(batches: Iterator[pa.RecordBatch], before: str, after: str) -> Iterator[pa.RecordBatch]:
    """The lines of a partition between two others."""
    line = lambda x: pa.RecordBatch.from_arrays([pa.array([x])], names=["value"])
    yield line(before)
    yield from batches
    yield line(after)


def _dump(spark: SparkSession, sf_dir: str) -> str:
    """Facts as bzip2 dumps of wiki pages, dimensions as the name spaces of one; a fact without a key makes a page without one."""
    path = scratch(spark, "dump")
    spaces = table(spark, sf_dir, "dimensions").where("dimension_key is not null").groupBy("dimension_key").agg(F.min("category").alias("c"))
    spaces = spaces.select(F.concat(F.lit('<namespace key="'), _xml(F.col("dimension_key")), F.lit('" case="first-letter">'), F.when(F.col("dimension_key") == "0", "").otherwise(_xml(F.col("c"))), F.lit("</namespace>")).alias("value"))
    page = F.concat(F.lit("<page><title>t</title><ns>"), F.coalesce(_xml(F.col("dimension_key")), F.lit("")), F.lit("</ns><id>"), F.col("record_id"), F.lit('</id><revision><id>7</id><text xml:space="preserve">'), F.coalesce(_xml(F.col("text")), F.lit("")), F.lit("</text></revision></page>"))
    pages = table(spark, sf_dir, "facts").select(page.alias("value"))
    spaces = spaces.coalesce(1).mapInArrow(partial(_wrapped, before="<mediawiki><siteinfo><namespaces>", after="</namespaces></siteinfo></mediawiki>"), "value string")
    spaces.unionByName(pages.mapInArrow(partial(_wrapped, before="<mediawiki>", after="</mediawiki>"), "value string")).write.option("compression", "bzip2").text(path)
    return path


def wiki_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.facts_of(X.read_pages(spark, _dump(spark, sf_dir)))


def wiki_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.read_namespaces(spark, _dump(spark, sf_dir))


def wiki_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages seen, kept and malformed, with the words and bytes of the kept, counted while they are written."""
    pages = X.read_pages(spark, _dump(spark, sf_dir))
    good = F.col("well_formed")
    got = K.write_observed(pages, scratch(spark, "pages"), pages_seen=F.count(F.lit(1)), page_rows=F.count_if(good), malformed=F.count_if(~good), words=F.sum(F.when(good, F.col("word_count"))), bytes=F.sum(F.when(good, F.col("text_bytes"))))
    return spark.createDataFrame([tuple(got.values())], ", ".join(f"{n} bigint" for n in got))


def join_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched and unmatched facts, counted in the pass that writes the matched ones."""
    dims = table(spark, sf_dir, "dimensions").where("dimension_key is not null").select("dimension_key").distinct().withColumn("known", F.lit(True))
    joined = table(spark, sf_dir, "facts").join(dims, "dimension_key", "left")
    got = K.write_observed(joined, scratch(spark, "joined"), rows_in=F.count(F.lit(1)), matched=F.count("known"), unmatched=F.count_if(F.col("known").isNull()))
    return spark.createDataFrame([tuple(got.values())], ", ".join(f"{n} bigint" for n in got))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as dump parts; every tenth is an index, every eleventh has no size, every thirteenth no url."""
    k = F.col("s_suppkey")
    name = F.format_string("wiki-pages-articles-multistream%d.xml-p%dp%d", k % 7 + 1, k * 10, k * 10 + 9)
    return table(spark, sf_dir, "supplier").select(
        k.alias("k"),
        F.when(k % 10 == 0, F.concat(name, F.lit(".idx"))).otherwise(F.concat(name, F.lit(".bz2"))).alias("name"),
        F.when(k % 13 == 0, "").when(k % 2 == 0, F.concat(F.lit("/dumps/"), name)).otherwise(F.concat(F.lit("https://mirror.example/"), name)).alias("url"),
        F.when(k % 11 == 0, 0).otherwise(k * 1000).cast("bigint").alias("size"),
        F.sha1(name.cast("binary")).alias("sha1"),
    )


def dump_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article parts of a dump-status file: names by pattern, urls made whole, sizes above 0."""
    entry = F.map_from_entries(F.collect_list(F.struct("name", F.struct("url", "size", "sha1").alias("m"))))
    status = _parts(spark, sf_dir).agg(F.to_json(F.struct(F.create_map(F.lit("articlesmultistreamdump"), F.struct(entry.alias("files"))).alias("jobs"))).alias("value"))
    path = scratch(spark, "status")
    status.write.text(path)
    return R.read_dump_status(spark, path, "https://dumps.example/")


def dump_parts_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts chosen within a budget, in the order of part, first and last page and name."""
    return budget_prefix(dump_status(spark, sf_dir), ["part", "first", "last", "name"], "bytes", 600_000)


def manifest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest published whole by the report sink and read back under its budget."""
    parts = [r.asDict() for r in _parts(spark, sf_dir).where("size > 0 and url <> ''").orderBy("k").limit(50).select("name", "url", F.col("size").alias("bytes"), "sha1").toLocalIterator()]
    path = scratch(spark, "manifest") + ".json"
    K.write_report({"schema_version": 1, "parts": parts}, path)
    return R.read_manifest(spark, path, 10**12)


def run_records_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON record per nation below a folder; those without an engine or a time aren't records."""
    k = F.col("n_nationkey")
    log = F.concat(F.lit("Submitted application_17_000"), k, F.lit(" then job_17_000"), k, F.lit(", job_17_000"), k % 3)
    runs = table(spark, sf_dir, "nation").select(F.lit("run").alias("label"), F.when(k % 6 == 5, None).otherwise(F.concat(F.lit("engine"), k % 2)).alias("engine"), (k % 4).cast("string").alias("dataset_id"), F.when(k % 7 == 6, None).otherwise(k * 0.5).alias("elapsed_seconds"), F.when(k % 9 == 8, 1).otherwise(0).alias("exit_status"), ids_in(log, "application").alias("application_ids"), ids_in(log, "job").alias("job_ids"), F.create_map(F.lit("cpu_time_ms"), (k * 10).cast("bigint")).alias("hadoop_counters"), F.array(F.col("n_name")).alias("command"))
    path = scratch(spark, "records")
    runs.coalesce(1).write.option("maxRecordsPerFile", 1).json(path)
    got = R.read_run_records(spark, path)
    return got.select(F.col("command")[0].alias("name"), "engine", "dataset_id", "elapsed_seconds", "exit_status", F.array_join("application_ids", ",").alias("applications"), F.array_join("job_ids", ",").alias("jobs"), F.col("hadoop_counters")["cpu_time_ms"].alias("cpu_time_ms"))


def signatures_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as signature lines and back."""
    path = scratch(spark, "signatures")
    values = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024).cast("bigint").cast("string"))
    table(spark, sf_dir, "embeddings").select(_text(F.col("vec_id"), F.array_join(values, " ")).alias("value")).write.text(path)
    return R.read_signatures(spark, path).select("window_id", F.size("sig").cast("bigint").alias("n"), F.aggregate("sig", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.array_min("sig").alias("least"))


def file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and digests of whole files, one a nation."""
    path = scratch(spark, "digests")
    table(spark, sf_dir, "nation").select(F.col("n_name").alias("value")).coalesce(1).write.option("maxRecordsPerFile", 1).text(path)
    return R.file_digests(spark, path).where("bytes > 0").select("bytes", "sha1", "sha256")


def parts_readback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts written as parts without quoting, read as one relation, and summed once more."""
    path = scratch(spark, "counts")
    K.write_raw(table(spark, sf_dir, "documents").select(F.explode(f1_words(F.col("text"))).alias("word"), "lang").groupBy("word", "lang").agg(F.count("*").alias("n")).select("word", "n"), path)
    return sum_counts(R.read_parts(spark, path, "word string, n string"), "word", "n")


def report_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report with a curve per setting, written as JSON and read for one k."""
    b = F.least(F.floor(F.col("l_discount") * 200).cast("int"), F.lit(19))
    bins = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("b="), F.col("l_linenumber").cast("string")).alias("setting"), b.cast("string").alias("bin")).agg(F.count("*").alias("pairs"), F.count_if(F.col("l_quantity") > 25).alias("hits"))
    points = bins.groupBy("setting").agg(F.collect_list(F.struct("bin", "pairs", (F.col("hits") / F.col("pairs")).alias("measured"), (F.col("pairs") / 2).alias("theory"))).alias("s_curve"))
    settings = F.map_from_entries(F.collect_list(F.struct("setting", F.struct("s_curve"))))
    path = scratch(spark, "report")
    K.write_json(points.agg(F.create_map(F.lit("3"), F.struct(settings.alias("settings"))).alias("by_k")), path)
    return R.read_report_curve(spark, path, "3")


def table_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as a partitioned table under a row-count post-condition, and read with the partition pruned in."""
    orders = table(spark, sf_dir, "orders")
    path = scratch(spark, "counted")
    K.write_counted(orders, path, orders.count())
    by = scratch(spark, "orders")
    K.write_table(spark.read.parquet(path).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), by, ["o_orderstatus"])
    return spark.read.parquet(by).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.count_distinct("o_custkey").alias("customers"))


def summary_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals per market segment as a comma-separated summary with a header."""
    path = scratch(spark, "summary")
    K.write_summary(table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("customers"), F.max("c_custkey").alias("last_key")), path)
    return spark.read.csv(path, header=True, schema="c_mktsegment string, customers bigint, last_key bigint", enforceSchema=False)


_TARGETS = {"small": 20_000, "medium": 200_000, "large": 2_000_000}


def samples_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested samples fanned out to a folder each in one pass; each row with the smallest sample it stands in, which proves them prefixes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", utf8_bytes(F.coalesce("text", F.lit(""))).alias("b"))
    path = scratch(spark, "samples")
    K.write_samples(nested_samples(docs, "doc_id", F.col("b"), _TARGETS), path)
    back = spark.read.parquet(path)
    return back.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("sample")), ",").alias("samples"))


def shard_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of four shards hold each supplier: one."""
    parts = table(spark, sf_dir, "supplier").select("s_suppkey")
    shards = [round_robin(parts, ["s_suppkey"], i, 4).withColumn("shard", F.lit(i)) for i in range(4)]
    return shards[0].unionByName(shards[1]).unionByName(shards[2]).unionByName(shards[3]).groupBy("s_suppkey").agg(F.count("*").alias("n_shards"), F.max("shard").alias("shard"))


def decode_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose letters all lie in Latin-1, as bytes of it under a wrong declaration; the others as UTF-8."""
    latin = F.col("text").rlike("^[\\x00-\\x7f\\xa0-\\xff]*$")
    raw = F.when(latin, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return table(spark, sf_dir, "documents").select("doc_id", decoded(raw, F.lit("utf-8")).alias("d")).select("doc_id", "d.text", "d.encoding")


def html_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of pages made of the documents: head, scripts and what follows the body are hidden, blocks break lines, cells don't."""
    esc = F.replace(F.replace(F.replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x85\x{2028}\x{2029}]", " "), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&#62;"))
    page = F.concat(F.lit("<html><head><title>no</title></head><body><h1>"), F.col("doc_id"), F.lit("</h1><script>var no = '<p>';</script><style>p {}</style><div><p>"), esc, F.lit("</p><table><tr><td>a</td><td><b>b</b></td></tr><tr><th>c"), F.coalesce("lang", F.lit("")), F.lit("</th></tr></table>x<br>y<template>no</template></div></body>after</html>"))
    return table(spark, sf_dir, "documents").select("doc_id", visible_text(page).alias("visible"))


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 14 words of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", excerpt(f1_words(F.col("text"))).alias("excerpt"))


def size_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes with units as bytes, one per customer."""
    k = F.col("c_custkey")
    size = F.concat(k, F.element_at(F.array(*[F.lit(u) for u in ("", "B", "KiB", "mib", "GIB")]), (k % 5 + 1).cast("int")))
    return table(spark, sf_dir, "customer").select(k.alias("c_custkey"), parse_size(size).alias("bytes"))


def acceptance_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The acceptance count: three files of the same three words a region."""
    path = scratch(spark, "acceptance")
    table(spark, sf_dir, "region").select(F.explode(F.array(*[F.lit("cat dog cat")] * 3)).alias("value")).write.text(path)
    return R.read_lines(spark, path).select(F.explode(f1_words(F.col("value"))).alias("word")).groupBy("word").agg(F.count("*").alias("total"))


def _stopped(job: Callable[[], object]) -> tuple[bool, str]:
    """Whether a job stops, and the message's first words that are ours."""
    try:
        got = job()
        if isinstance(got, DataFrame):
            got.write.format("noop").mode("overwrite").save()
    except Exception as x:
        known = re.search(r"malformed record|duplicate key|table is empty|unknown dimension key|has more than one|above \d+|rows written|invalid size|shard \d+ of \d+|PATH_ALREADY_EXISTS|lacks a field|CAST_INVALID_INPUT|malformed XML", str(x))
        return True, known[0] if known else type(x).__name__
    return False, ""


def _stop_cases(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], object]]:
    nation, region, facts = (table(spark, sf_dir, n) for n in ("nation", "region", "facts"))
    at = scratch(spark, "nation")
    K.write_raw(nation.select("n_nationkey", "n_name"), at)
    dump = scratch(spark, "bad-dump")
    spark.createDataFrame([("<mediawiki></mediawiki>",)], "value string").write.text(dump)
    manifest = scratch(spark, "bad-manifest") + ".json"
    K.write_report({"parts": [{"name": "a", "url": None, "bytes": 1, "sha1": "x"}]}, manifest)
    keyed = region.withColumnRenamed("r_regionkey", "n_regionkey")
    return {
        "P4 a line of another arity": lambda: R.read_raw_facts(spark, at),
        "P4 an unknown tag": lambda: R.read_tagged(spark, at),
        "P4 a count that is none": lambda: sum_counts(nation.select("n_name", F.lit("many").alias("n")), "n_name", "n"),
        "J12 a key twice": lambda: natural_join(nation, keyed.unionByName(keyed), "n_regionkey"),
        "J12 a null key twice": lambda: A.assert_unique(nation.select(F.lit(None).cast("int").alias("k")), "k"),
        "J3 an unknown key": lambda: strict_lookup_join(nation, keyed.where("n_regionkey > 0"), "n_regionkey").agg(F.count("*")),
        "J3 an unknown key, in one pass": lambda: strict_lookup_join(nation, keyed.where("n_regionkey > 0"), "n_regionkey", before=False).agg(F.count("*")),
        "J3 an empty dimension": lambda: strict_lookup_join(nation, keyed.limit(0), "n_regionkey"),
        "A19 two values of a key": lambda: A.assert_dependency(nation, "n_regionkey", "n_name"),
        "A22 a budget": lambda: A.assert_budget(nation, "n_nationkey", 10),
        "K12 another row count": lambda: K.write_counted(nation, scratch(spark, "short"), 3),
        "K8 an existing target": lambda: K.write_table(nation, at),
        "K8 an existing text target": lambda: K.write_raw(nation, at),
        "W5 a shard outside": lambda: round_robin(nation, ["n_nationkey"], 3, 3),
        "F19 an invalid size": lambda: nation.select(parse_size(F.lit("2MB"))),
        "S10 a field missing": lambda: R.read_manifest(spark, manifest, 10),
        "S8 a dump without pages": lambda: X.read_pages(spark, dump),
        "fine: a known key": lambda: strict_lookup_join(nation, keyed, "n_regionkey"),
        "fine: rows as expected": lambda: A.assert_rows(A.assert_not_empty(facts.limit(1)), 1),
    }


def strict_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stops a job, and by which word."""
    rows = [(case, *_stopped(job)) for case, job in _stop_cases(spark, sf_dir).items()]
    return spark.createDataFrame(rows, "check_case string, stopped boolean, because string")


def same_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether relations that went through each sink hold the same rows as before."""
    names = {"quoted": quoted_round_trip(spark, sf_dir), "lines": R.read_lines(spark, _lines_of(spark, sf_dir, "facts")[1])}
    before = {"quoted": table(spark, sf_dir, "utterances").select(*names["quoted"].columns), "lines": table(spark, sf_dir, "facts").where("text is not null").select(flatten_breaks(F.col("text")).alias("value"))}
    return spark.createDataFrame([(n, same_rows(names[n], before[n])) for n in names], "relation string, same boolean")


QUERIES = {
    f.__name__: f
    for f in (
        lines_scan, whole_files_scan, quoted_round_trip, raw_round_trip, raw_tabs_in_text, dimension_scan, tagged_scan, wiki_pages, wiki_namespaces, wiki_counters, join_counters, dump_status, dump_parts_in_order, manifest_scan,
        run_records_scan, signatures_scan, file_digests, parts_readback, report_curve, table_round_trip, summary_round_trip, samples_written, shard_cover, decode_fallback, html_round_trip, excerpts, size_parse, acceptance_count,
        strict_stops, same_relations,
    )
}

_FLAT = "translate({}, chr(13) || chr(10) || chr(9), '   ')"
_F1 = "regexp_extract_all(replace(lower(text), '’', ''''), '[a-z]+(?:''[a-z]+)*')"
_WS = r"'[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'"
_F2 = r"len(regexp_extract_all({}, '[\p{{L}}\p{{N}}]+(?:[''’][\p{{L}}\p{{N}}]+)*'))"
_PAGE_SQL = f"""
WITH p AS (SELECT record_id, regexp_replace(dimension_key, '{_NO_XML}', '', 'g') AS dimension_key, {_FLAT.format(f"regexp_replace(coalesce(text, ''), '{_NO_XML}', '', 'g')")} AS text FROM facts),
w AS (SELECT record_id, dimension_key, {_F2.format("text")} AS word_count, strlen(text) AS text_bytes, text, coalesce(dimension_key, '') <> '' AS good FROM p)
"""
_PARTS_SQL = """
WITH b AS (SELECT s_suppkey AS k, 'wiki-pages-articles-multistream' || (s_suppkey % 7 + 1) || '.xml-p' || (s_suppkey * 10) || 'p' || (s_suppkey * 10 + 9) AS stem FROM supplier),
parts AS (SELECT k, stem || '.bz2' AS name, CASE WHEN k % 2 = 0 THEN 'https://dumps.example/dumps/' ELSE 'https://mirror.example/' END || stem AS url, k * 1000 AS bytes, sha1(stem) AS sha1,
  k % 7 + 1 AS part, k * 10 AS first, k * 10 + 9 AS last FROM b WHERE k % 10 <> 0 AND k % 11 <> 0 AND k % 13 <> 0)
"""
_STOPS = [
    ("P4 a line of another arity", "malformed record"),
    ("P4 an unknown tag", "malformed record"),
    ("P4 a count that is none", "CAST_INVALID_INPUT"),
    ("J12 a key twice", "duplicate key"),
    ("J12 a null key twice", "duplicate key"),
    ("J3 an unknown key", "unknown dimension key"),
    ("J3 an unknown key, in one pass", "unknown dimension key"),
    ("J3 an empty dimension", "table is empty"),
    ("A19 two values of a key", "has more than one"),
    ("A22 a budget", "above 10"),
    ("K12 another row count", "rows written"),
    ("K8 an existing target", "PATH_ALREADY_EXISTS"),
    ("K8 an existing text target", "PATH_ALREADY_EXISTS"),
    ("W5 a shard outside", "shard 3 of 3"),
    ("F19 an invalid size", "invalid size"),
    ("S10 a field missing", "lacks a field"),
    ("S8 a dump without pages", "malformed XML"),
    ("fine: a known key", ""),
    ("fine: rows as expected", ""),
]
_LATIN = r"regexp_full_match(text, '[\x00-\x7f\x{a0}-\x{ff}]*', 's')"

ORACLES = {
    "lines_scan": f"SELECT {_FLAT.format('text')} AS value, count(*) AS n FROM facts WHERE text IS NOT NULL GROUP BY 1",
    "whole_files_scan": f"SELECT {_FLAT.format('text')} AS value, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "quoted_round_trip": "SELECT record_type, utterance_id, mission_time, speaker_code, word_count, text FROM utterances",
    "raw_round_trip": f"SELECT record_id, {_FLAT.format('dimension_key')} AS dimension_key, coalesce(word_count, -1) AS word_count, coalesce(text_bytes, -1) AS text_bytes, coalesce({_FLAT.format('text')}, '') AS text FROM (SELECT record_id, coalesce(dimension_key, '') AS dimension_key, word_count, text_bytes, text FROM facts)",
    "raw_tabs_in_text": "SELECT record_id, coalesce(dimension_key, '') AS dimension_key, coalesce(word_count, 0) AS word_count, strlen(coalesce(text, '')) AS text_bytes, '\"' || coalesce(translate(text, chr(13) || chr(10), '  '), '') || chr(9) || '\"' AS text FROM facts",
    "dimension_scan": "SELECT dimension_key, min(category) AS category FROM dimensions WHERE dimension_key IS NOT NULL GROUP BY 1",
    "tagged_scan": f"SELECT record_type, utterance_id AS key, coalesce({_FLAT.format('speaker_code')}, '') AS speaker_code, coalesce(word_count, 0) AS word_count, coalesce({_FLAT.format('text')}, '') AS text FROM utterances UNION ALL SELECT record_type, coalesce(category, ''), coalesce(speaker_code, ''), NULL, coalesce(description, '') FROM speakers",
    "wiki_pages": _PAGE_SQL + "SELECT record_id, dimension_key, word_count, text_bytes, text FROM w WHERE good",
    "wiki_namespaces": "SELECT dimension_key, CASE WHEN dimension_key = '0' OR trim(min(category)) = '' THEN '(main)' ELSE trim(min(category)) END AS category FROM dimensions WHERE dimension_key IS NOT NULL GROUP BY 1",
    "wiki_counters": _PAGE_SQL + "SELECT count(*) AS pages_seen, count(*) FILTER (good) AS page_rows, count(*) FILTER (NOT good) AS malformed, sum(word_count) FILTER (good)::BIGINT AS words, sum(text_bytes) FILTER (good)::BIGINT AS bytes FROM w",
    "join_counters": "SELECT count(*) AS rows_in, count(*) FILTER (m) AS matched, count(*) FILTER (NOT m) AS unmatched FROM (SELECT coalesce(dimension_key IN (SELECT dimension_key FROM dimensions WHERE dimension_key IS NOT NULL), false) AS m FROM facts)",
    "dump_status": _PARTS_SQL + "SELECT part, first, last, name, url, bytes, sha1 FROM parts",
    "dump_parts_in_order": _PARTS_SQL + ", r AS (SELECT *, sum(bytes) OVER w AS run, row_number() OVER w AS rn FROM parts WINDOW w AS (ORDER BY part, first, last, name)) SELECT part, first, last, name, url, bytes, sha1 FROM r WHERE rn = 1 OR run <= 600000",
    "manifest_scan": "WITH b AS (SELECT s_suppkey AS k, 'wiki-pages-articles-multistream' || (s_suppkey % 7 + 1) || '.xml-p' || (s_suppkey * 10) || 'p' || (s_suppkey * 10 + 9) AS stem FROM supplier) SELECT stem || CASE WHEN k % 10 = 0 THEN '.idx' ELSE '.bz2' END AS name, CASE WHEN k % 2 = 0 THEN '/dumps/' ELSE 'https://mirror.example/' END || stem AS url, k * 1000 AS bytes, sha1(stem) AS sha1 FROM b WHERE k % 11 <> 0 AND k % 13 <> 0 ORDER BY k LIMIT 50",
    "run_records_scan": "SELECT n_name AS name, 'engine' || (n_nationkey % 2) AS engine, (n_nationkey % 4)::VARCHAR AS dataset_id, n_nationkey * 0.5::DOUBLE AS elapsed_seconds, CASE WHEN n_nationkey % 9 = 8 THEN 1 ELSE 0 END AS exit_status, 'application_17_000' || n_nationkey AS applications, array_to_string(list_sort(list_distinct(['job_17_000' || n_nationkey, 'job_17_000' || (n_nationkey % 3)])), ',') AS jobs, n_nationkey * 10::BIGINT AS cpu_time_ms FROM nation WHERE n_nationkey % 6 <> 5 AND n_nationkey % 7 <> 6",
    "signatures_scan": "SELECT vec_id::VARCHAR AS window_id, len(s) AS n, list_sum(s)::BIGINT AS total, list_min(s) AS least FROM (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS s FROM embeddings)",
    "file_digests": "SELECT strlen(n_name) + 1 AS bytes, sha1(n_name || chr(10)) AS sha1, sha256(n_name || chr(10)) AS sha256 FROM nation",
    "parts_readback": f"SELECT word, count(*) AS total FROM (SELECT unnest({_F1}) AS word FROM documents) GROUP BY word",
    "report_curve": "SELECT 'b=' || l_linenumber AS setting, least(floor(l_discount * 200)::INT, 19)::VARCHAR AS bin, count(*) AS pairs, count(*) FILTER (l_quantity > 25) / count(*)::DOUBLE AS measured, count(*) / 2::DOUBLE AS theory FROM lineitem GROUP BY ALL",
    "table_round_trip": "SELECT o_orderstatus, count(*) AS n, min(o_orderkey) AS first_key, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1",
    "summary_round_trip": "SELECT c_mktsegment, count(*) AS customers, max(c_custkey) AS last_key FROM customer GROUP BY 1",
    "samples_written": f"WITH r AS (SELECT doc_id, coalesce(sum(strlen(coalesce(text, ''))) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (ORDER BY doc_id) AS rn FROM documents), t(sample, target) AS (VALUES {', '.join(f'({chr(39)}{n}{chr(39)}, {t})' for n, t in _TARGETS.items())}) SELECT doc_id, string_agg(sample, ',' ORDER BY sample) AS samples FROM r, t WHERE rn = 1 OR before < target GROUP BY doc_id",
    "shard_cover": "SELECT s_suppkey, 1::BIGINT AS n_shards, ((row_number() OVER (ORDER BY s_suppkey) - 1) % 4)::INT AS shard FROM supplier",
    "decode_fallback": f"SELECT doc_id, text, CASE WHEN text IS NULL THEN NULL WHEN {_LATIN} AND NOT regexp_full_match(text, '[\\x00-\\x7f]*', 's') THEN 'windows-1252' ELSE 'utf-8' END AS encoding FROM documents",
    "html_round_trip": r"WITH t AS (SELECT doc_id, lang, list_filter(list_transform(string_split(replace(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0b\x0c\x0e-\x1f\x{85}\x{2028}\x{2029}]', ' ', 'g'), chr(13), chr(10)), chr(10)), lambda l: trim(regexp_replace(l, " + _WS + r", ' ', 'g'))), lambda l: l <> '') AS ls FROM documents) SELECT doc_id, array_to_string(list_concat([doc_id::VARCHAR], ls, ['a b', 'c' || coalesce(lang, ''), 'x', 'y']), chr(10)) || chr(10) AS visible FROM t",
    "excerpts": f"SELECT doc_id, array_to_string(w[1:14], ' ') || CASE WHEN len(w) > 14 THEN ' ...' ELSE '' END AS excerpt FROM (SELECT doc_id, {_F1} AS w FROM documents)",
    "size_parse": "SELECT c_custkey, c_custkey * CASE c_custkey % 5 WHEN 2 THEN 1024 WHEN 3 THEN 1048576 WHEN 4 THEN 1073741824 ELSE 1 END::BIGINT AS bytes FROM customer",
    "acceptance_count": "SELECT word, n * (SELECT count(*) FROM region) AS total FROM (VALUES ('cat', 6), ('dog', 3)) t(word, n)",
    "strict_stops": "SELECT * FROM (VALUES " + ", ".join(f"('{c}', {str(bool(w)).lower()}, '{w}')" for c, w in _STOPS) + ") t(check_case, stopped, because)",
    "same_relations": "SELECT * FROM (VALUES ('quoted', true), ('lines', true)) t(relation, same)",
}
