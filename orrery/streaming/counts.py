"""The word count and the star aggregate as streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orrery.functions.text import f1_words
from orrery.operators.relational import count_and_sums, word_count


def stream_table(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def running_word_count(stream: DataFrame, text: str, name: str, checkpoint: str) -> StreamingQuery:
    """Totals of every word so far, in the memory table ``name``; ends when the input on hand is read."""
    return word_count(f1_words(F.col(text)), stream).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_totals(stream: DataFrame, dims: DataFrame, key: str, name: str, checkpoint: str) -> StreamingQuery:
    """Rows, words and bytes per category so far, facts without a dimension row left out."""
    joined = stream.join(dims, key)
    return count_and_sums(joined, "category", "n", words="word_count", bytes="text_bytes").writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
