"""Joins of facts with dimensions and aggregates by category."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.relational import count_and_sums, matched, natural_join, run_sql, strict_lookup_join, tagged_union, unmatched, with_shares
from orrery.operators.verify import digest_of_lines, row_fingerprint, same_rows
from orrery.sources.tables import table


def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One category per speaker code: the table holds several spells of validity per code."""
    return table(spark, sf_dir, "speakers").groupBy("speaker_code").agg(F.min("category").alias("category"))


def _dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "dimensions").groupBy("dimension_key").agg(F.min("category").alias("category"))


def natural_join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "utterances").drop("record_type", "source_id")
    return natural_join(u, _roles(spark, sf_dir), "speaker_code").select("utterance_id", "mission_time", "speaker_code", "category", "word_count", "text", "ingested_at").orderBy("speaker_code", "utterance_id")


def join_agg_count_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_and_sums(natural_join(table(spark, sf_dir, "utterances"), _roles(spark, sf_dir), "speaker_code"), "category", "utterance_count", total_words="word_count").orderBy("category")


def category_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_shares(join_agg_count_sum(spark, sf_dir), "utterance_count", "total_words")


def unmatched_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unmatched(table(spark, sf_dir, "utterances"), _roles(spark, sf_dir), "speaker_code")


def unmatched_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts in, with and without a dimension row, and the missing keys in order."""
    facts = table(spark, sf_dir, "facts")
    missing = unmatched(facts, _dims(spark, sf_dir), "dimension_key")
    lost = missing.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("unmatched_rows"), F.array_sort(F.collect_set("dimension_key")).alias("unknown_keys"))
    return facts.agg(F.count("*").alias("input_rows")).crossJoin(F.broadcast(lost)).select("input_rows", (F.col("input_rows") - F.col("unmatched_rows")).alias("matched_rows"), "unmatched_rows", F.array_join("unknown_keys", ",").alias("unknown_keys"))


def semi_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched(table(spark, sf_dir, "facts"), _dims(spark, sf_dir), "dimension_key").select("record_id", "dimension_key", "ingested_at")


def observed_not_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes in use that the dimension doesn't know."""
    return unmatched(table(spark, sf_dir, "utterances"), table(spark, sf_dir, "speakers"), "speaker_code").select("speaker_code")


def star_agg_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_and_sums(natural_join(table(spark, sf_dir, "facts"), _dims(spark, sf_dir), "dimension_key"), "category", "count", words="word_count", bytes="text_bytes").orderBy("category")


def star_agg_customer_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two strict lookups: every customer has a nation, every nation a region."""
    nation = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    region = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    joined = strict_lookup_join(strict_lookup_join(table(spark, sf_dir, "customer"), nation, "c_nationkey", before=False), region, "n_regionkey", before=False)
    return joined.groupBy(F.col("r_name").alias("category")).agg(F.count("*").alias("count"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def star_agg_lineitem_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A strict lookup of a growing dimension: the join strategy follows its checked size."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    joined = strict_lookup_join(table(spark, sf_dir, "lineitem"), part, "l_partkey", before=False)
    return joined.groupBy(F.col("p_brand").alias("category")).agg(F.count("*").alias("count"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))


def star_agg_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star aggregate as a SQL text over views."""
    text = "SELECT d.category, COUNT(*) AS count, SUM(f.word_count) AS words, SUM(f.text_bytes) AS bytes FROM {facts} f JOIN {dims} d ON f.dimension_key = d.dimension_key GROUP BY d.category ORDER BY d.category"
    return run_sql(spark, text, facts=table(spark, sf_dir, "facts"), dims=_dims(spark, sf_dir))


def dimension_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functional dependency: the number of names of each key, in numeric order."""
    return table(spark, sf_dir, "dimensions").groupBy("dimension_key").agg(F.count_distinct("category").alias("n_names")).orderBy(F.col("dimension_key").try_cast("bigint"))


def tagged_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both relations as one tagged union, counted by tag."""
    both = tagged_union({"U": table(spark, sf_dir, "utterances").drop("record_type"), "S": table(spark, sf_dir, "speakers").drop("record_type")})
    return both.groupBy("record_type").agg(F.count("*").alias("n_rows"), F.count("text").alias("n_text"), F.count("category").alias("n_category"))


def outputs_match_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star aggregate by two plans: their digests and whether the rows are the same."""
    a, b = star_agg_facts(spark, sf_dir), star_agg_sql(spark, sf_dir)
    same = same_rows(a, b)
    return digest_of_lines(a).select("n_rows", F.col("sha256").alias("sha256_a")).crossJoin(digest_of_lines(b.select(*a.columns)).select(F.col("sha256").alias("sha256_b"))).withColumn("same_rows", F.lit(same))


def fact_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_fingerprint(table(spark, sf_dir, "facts"))


def distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "facts").agg(F.count_distinct("dimension_key").alias("output_rows"))


QUERIES = {
    f.__name__: f
    for f in (natural_join_inner, join_agg_count_sum, category_shares, unmatched_keys, unmatched_summary, semi_matched, observed_not_known, star_agg_facts, star_agg_customer_region, star_agg_lineitem_brand, star_agg_sql, dimension_names, tagged_relations, outputs_match_digest, fact_fingerprint, distinct_keys)
}

_ROLES = "roles AS (SELECT speaker_code, min(category) AS category FROM speakers GROUP BY 1)"
_DIMS = "dims AS (SELECT dimension_key, min(category) AS category FROM dimensions GROUP BY 1)"
_AGG = "SELECT category, count(*) AS utterance_count, sum(word_count)::BIGINT AS total_words FROM utterances JOIN roles USING (speaker_code) GROUP BY category"
_STAR = f"WITH {_DIMS} SELECT category, count(*) AS count, sum(word_count)::BIGINT AS words, sum(text_bytes)::BIGINT AS bytes FROM facts JOIN dims USING (dimension_key) GROUP BY category"
_LINES = "(SELECT sha256(string_agg(line, chr(10) ORDER BY line) || chr(10)) FROM (SELECT concat_ws(chr(9), category, count, coalesce(words::VARCHAR, ''), coalesce(bytes::VARCHAR, '')) AS line FROM star))"

ORACLES = {
    "natural_join_inner": f"WITH {_ROLES} SELECT utterance_id, mission_time, speaker_code, category, word_count, text, ingested_at FROM utterances JOIN roles USING (speaker_code)",
    "join_agg_count_sum": f"WITH {_ROLES} {_AGG}",
    "category_shares": f"WITH {_ROLES}, agg AS ({_AGG}) SELECT *, 100.0 * utterance_count / sum(utterance_count) OVER ()::DOUBLE AS share_pct, total_words / utterance_count::DOUBLE AS mean_words FROM agg",
    "unmatched_keys": f"WITH {_ROLES} SELECT speaker_code, count(*) AS n FROM utterances u WHERE NOT EXISTS (SELECT 1 FROM roles r WHERE r.speaker_code = u.speaker_code) GROUP BY 1",
    "unmatched_summary": f"WITH {_DIMS}, x AS (SELECT f.dimension_key, d.dimension_key IS NULL AS lost FROM facts f LEFT JOIN dims d USING (dimension_key)) SELECT count(*) AS input_rows, count(*) FILTER (NOT lost) AS matched_rows, count(*) FILTER (lost) AS unmatched_rows, (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT DISTINCT f.dimension_key AS k FROM facts f WHERE f.dimension_key IS NOT NULL AND f.dimension_key NOT IN (SELECT dimension_key FROM dims WHERE dimension_key IS NOT NULL))) AS unknown_keys FROM x",
    "semi_matched": "SELECT record_id, dimension_key, ingested_at FROM facts WHERE dimension_key IN (SELECT dimension_key FROM dimensions)",
    "observed_not_known": "SELECT DISTINCT speaker_code FROM utterances u WHERE NOT EXISTS (SELECT 1 FROM speakers s WHERE s.speaker_code = u.speaker_code)",
    "star_agg_facts": _STAR,
    "star_agg_customer_region": "SELECT r_name AS category, count(*) AS count, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    "star_agg_lineitem_brand": "SELECT p_brand AS category, count(*) AS count, sum(l_quantity::BIGINT)::BIGINT AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
    "star_agg_sql": _STAR,
    "dimension_names": "SELECT dimension_key, count(DISTINCT category) AS n_names FROM dimensions GROUP BY 1",
    "tagged_relations": "SELECT 'U' AS record_type, count(*) AS n_rows, count(text) AS n_text, 0::BIGINT AS n_category FROM utterances UNION ALL SELECT 'S', count(*), 0, count(category) FROM speakers",
    "outputs_match_digest": f"WITH star AS ({_STAR}) SELECT count(*) AS n_rows, {_LINES} AS sha256_a, {_LINES} AS sha256_b, TRUE AS same_rows FROM star",
    "distinct_keys": "SELECT count(DISTINCT dimension_key) AS output_rows FROM facts",
}
