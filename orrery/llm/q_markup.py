"""Queries: markup residue of the facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.differencing import differenced
from orrery.llm.markup import clean_documents, part_kinds
from orrery.sources.tables import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_kinds(table(spark, sf_dir, "facts"), "record_id", "text").select(F.col("rid").alias("record_id"), "part_kind")


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its language, its part kinds and its clean text."""
    return clean_documents(table(spark, sf_dir, "facts"), "record_id", "text").select(F.col("rid").alias("record_id"), "language", "part_kinds", F.col("clean").alias("clean_text"))


def p5_differenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record without the lines it shares with its neighbour: dimension_key for the host, record_id for the path."""
    out = differenced(table(spark, sf_dir, "facts"), "record_id", "dimension_key", "record_id", "text")
    return out.select(F.col("rid").alias("record_id"), F.col("partner").alias("partner_id"), "n_lines", "shared_lines", F.col("kept").alias("kept_text"))


# texts around a supplier's name, and the kinds of their parts
_PLANTED = [
    ("{} holds 5 < 7 tanks for $3 (see /opt/x_1_2).", ""),
    ("# {}\n\nText of it.\n\n- one\n- two\n", "heading list markup"),
    ("<h2>{}</h2><p>Text</p><ul><li>a</li></ul>", "heading list markup"),
    ("== {} ==\nText with [[a link]].\n* a\n* b\n", "heading list markup"),
    ("\\section{{{}}}\nText $$x^2$$.\n\\begin{{verbatim}}\nz\n\\end{{verbatim}}", "code formula heading markup"),
    ("Text **{}** here.\n\n```\n# no heading\n```\n", "code markup"),
    ("Text &amp; more of <!-- c --> {}", "markup"),
    ("<pre>- {}</pre> and <math>x</math>", "code formula markup"),
    ("{} says: it's 3 * 4 * 5, as `before.", ""),
    ("Title of {}\n=====\n\n1. one\n2. two\n", "heading list markup"),
    ("\\begin{{itemize}}\n\\item {}\n\\end{{itemize}}\nand \\(a+b\\)", "formula list markup"),
]


def p5_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part kinds of texts made around every supplier's name, of which the kinds are known."""
    pieces = [t.format("\x00").split("\x00") for t, _ in _PLANTED]
    k = F.col("s_suppkey")
    pick = lambda i: F.element_at(F.array(*[F.lit(p[i]) for p in pieces]), (k % len(pieces) + 1).cast("int"))
    texts = table(spark, sf_dir, "supplier").select(k.cast("string").alias("id"), F.concat(pick(0), F.translate("s_name", "#", ""), pick(1)).alias("text"))
    return part_kinds(texts, "id", "text").groupBy(F.col("rid").cast("bigint").alias("s_suppkey")).agg(F.array_join(F.array_sort(F.collect_set("part_kind")), " ").alias("kinds"))


QUERIES = {"p5_found": p5_found, "p5_clean": p5_clean, "p5_differenced": p5_differenced, "p5_planted": p5_planted}
ORACLES = {"p5_planted": "SELECT s_suppkey, kinds FROM (SELECT s_suppkey, [" + ", ".join(f"'{k}'" for _, k in _PLANTED) + f"][s_suppkey % {len(_PLANTED)} + 1] AS kinds FROM supplier) WHERE kinds <> ''"}
