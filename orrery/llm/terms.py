"""Occurrences and record counts of every term, by last-seen counters.

Records are hash-partitioned by their identifier and lie in order in each
task. A term keeps three things: its occurrences, its records, and the last
record it was seen in. A token whose record isn't that last one is the term
in a new record; no set of records is ever kept. Since a record lies whole in
one task, the counters of a term from different tasks add up: they are
hash-partitioned by term, so that a term in every record costs a row a task
and tokens themselves never travel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.words import f1_words
from orrery.runtime import spread, stage

#: Distinct terms that a task holds before it hands its counters on.
HELD_TERMS = 300_000
_SCHEMA = "term string, occurrences long, records long, last_record string"


class LastSeen:
    """Counters of terms over tokens that come ordered by record; records are numbered as they come."""

    def __init__(self):
        self.ids: dict[str, int] = {}
        self.occurrences, self.records, self.last = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, tokens: list[str], record: np.ndarray) -> None:
        """Tokens with the number of the record of each, not descending."""
        ids = self.ids
        t = np.array([ids.setdefault(w, len(ids)) for w in tokens], np.int64)
        more = len(ids) - len(self.last)
        if more > 0:
            more += len(ids)
            self.occurrences, self.records = (np.concatenate([x, np.zeros(more, np.int64)]) for x in (self.occurrences, self.records))
            self.last = np.concatenate([self.last, np.full(more, -1)])
        if not len(t):
            return
        # a term's tokens side by side, still ordered by record: each is compared with the record the term was last seen in
        order = np.argsort(t, kind="stable")
        t, record = t[order], record[order]
        first = np.append(True, t[1:] != t[:-1])
        seen = np.where(first, self.last[t], np.append(-1, record[:-1]))
        self.occurrences += np.bincount(t, minlength=len(self.last))
        self.records += np.bincount(t[record != seen], minlength=len(self.last))
        end = np.append(first[1:], True)
        self.last[t[end]] = record[end]

    def rows(self, name: list) -> tuple[list, np.ndarray, np.ndarray, list]:
        """(term, occurrences, records, last record) of every term; ``name`` gives the identifiers of the records."""
        n = len(self.ids)
        return list(self.ids), self.occurrences[:n], self.records[:n], [name[i] for i in self.last[:n]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters of the records in a task; the row without a term counts records with text. Rows: record, text, ordered by record."""
    seen, names, with_text = LastSeen(), [], 0

    def out():
        term, occ, rec, last = seen.rows(names)
        return pa.RecordBatch.from_arrays([pa.array([None, *term], pa.string()), pa.array(np.append(with_text, occ)), pa.array(np.append(with_text, rec)), pa.array([None, *last], pa.string())], names=["term", "occurrences", "records", "last_record"])

    for batch in batches:
        tokens: list[str] = []
        numbers, sizes = [], []
        for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text is None:
                continue
            with_text += 1
            words = f1_words(text)
            numbers.append(len(names))
            names.append(rid)
            sizes.append(len(words))
            tokens += words
        seen.add(tokens, np.repeat(np.array(numbers, np.int64), sizes))
        if len(seen.ids) > HELD_TERMS or len(names) > HELD_TERMS:
            yield out()
            seen, names, with_text = LastSeen(), [], 0
    yield out()


def term_frequencies(records: DataFrame, record_id: str, text: str, rare_below: int = 3, common_above: float = 0.1) -> DataFrame:
    """Every F1 word of ``text``: term, occurrences, records, verdict, last_record.

    Rows with the same ``record_id`` are one record. verdict is 'rare' for a
    term in fewer than ``rare_below`` records, else 'common' for one in more
    than ``common_above`` of the records whose text isn't null, else null;
    last_record is the greatest identifier of a record with the term. Null,
    empty or wordless texts give no term (empty ones count as records with
    text); an empty table gives no rows.
    """
    once = spread(records.select(F.col(record_id).alias("rid"), F.col(text).alias("txt"))).dropDuplicates(["rid"]).sortWithinPartitions("rid")
    sums = [F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"), F.max("last_record").alias("last_record")]
    counts = stage(once.select(F.col("rid").cast("string"), "txt").mapInArrow(_count, _SCHEMA).groupBy("term").agg(*sums), "terms")
    total = counts.where("term is null").agg(F.coalesce(F.max("records"), F.lit(0)).alias("with_text"))
    verdict = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.lit(common_above) * F.col("with_text"), "common")
    return counts.where("term is not null").crossJoin(F.broadcast(total)).select("term", "occurrences", "records", verdict.alias("verdict"), "last_record")
