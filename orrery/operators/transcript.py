"""Transcript lines folded into utterances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.text import collapse_blanks, f1_count, lines

# fixed values: the line patterns of a transcript
HEADER = r"^(\d{2})\s+(\d{2})\s+(\d{2})\s+(\d{2})\s+([A-Z][A-Z0-9/-]*)(?:\s+(.*))?$"
TIME_LIKE = r"^(?:[0-9O]{2}\s+){3}[0-9O]{2}\s+"
METADATA = (
    r"^(?:\* \* \*|NOTE|END OF TAPE|INTRODUCTION|APOLLO 11 AIR-TO-GROUND VOICE TRANSCRIPTION|THE FOLLOWING IS A MESSAGE.*|"
    r"\*{3} Three asterisks.*|\(GOSS NET 1\).*|[A-Z][A-Z .'-]+ \(REV\s*\d+\))$"
)
ROLE_ONLY = r"^\([^)]+\)$"


def text_lines(docs: DataFrame, file: str, text: str) -> DataFrame:
    """(file, line_no, line): the lines of each document, numbered from 1."""
    return docs.select(F.col(file).alias("file"), F.posexplode(lines(F.col(text))).alias("p", "line")).select("file", (F.col("p") + 1).alias("line_no"), "line")


def _marked(rows: DataFrame) -> DataFrame:
    line = F.col("l")
    kind = F.when(line == "", "blank").when(line.rlike(HEADER), "header").when(line.rlike(TIME_LIKE), "malformed").when(line.rlike(METADATA), "meta").otherwise("text")
    return rows.select("file", "line_no", collapse_blanks(F.col("line")).alias("l")).withColumn("kind", kind)


def malformed_headers(rows: DataFrame) -> DataFrame:
    """(file, line, text) of lines that look like a header but aren't one."""
    return _marked(rows).where("kind = 'malformed'").select("file", F.col("line_no").alias("line"), F.col("l").alias("text"))


def fold_transcript(rows: DataFrame) -> DataFrame:
    """Utterances of (file, line_no, line) rows.

    A header opens a record, later lines continue it, a header or a
    malformed header closes it; what follows a malformed header belongs to
    nothing. Metadata and blank lines drop out, as does an inline role
    remark. Records without text are dropped before ids are numbered per
    file. Files are the unit of order: each is folded by itself.
    """
    marks = _marked(rows).where("kind not in ('blank', 'meta')")
    order = Window.partitionBy("file").orderBy("line_no")
    grouped = marks.withColumn("grp", F.sum(F.when(F.col("kind") != "text", 1).otherwise(0)).over(order)).where("grp > 0")
    part = lambda i: F.regexp_extract("l", HEADER, i)
    said = F.when(F.col("kind") == "header", F.when(part(6).rlike(ROLE_ONLY), "").otherwise(part(6))).otherwise(F.col("l"))
    folded = grouped.groupBy("file", "grp").agg(
        F.min(F.when(F.col("kind") != "text", F.struct("line_no", "kind", F.concat_ws(":", part(1), part(2), part(3), part(4)).alias("t"), part(5).alias("who")))).alias("h"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(said != "", F.struct(F.col("line_no").alias("n"), said.alias("s"))))), lambda x: x["s"]), " ").alias("text"),
    )
    kept = folded.where("h.kind = 'header' and text <> ''")
    number = F.row_number().over(Window.partitionBy("file").orderBy("h.line_no"))
    return kept.select("file", F.format_string("%s-%06d", "file", number).alias("utterance_id"), F.col("h.t").alias("mission_time"), F.col("h.who").alias("speaker_code"), f1_count(F.col("text")).alias("word_count"), "text")
