"""Nearest-URL page differencing: lines that a page shares with its neighbour on the same host are its frame.

Pages are ordered by host and path; a page's partner is the neighbour in that
order whose path begins like its own for longest. The lines of the two are
aligned by a longest common subsequence, and what they share is deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators.sampling import ranked
from orrery.runtime import stage


def common_lines(a: list[str], b: list[str]) -> list[int]:
    """Places in ``a`` of a longest common subsequence of the lines of both, by bit vectors.

    Bit i of the vector after line j of ``b`` is 0 where a[: i + 1] has one
    more line in common with b[: j + 1] than a[:i].
    """
    where: dict[str, int] = {}
    for i, line in enumerate(a):
        where[line] = where.get(line, 0) | 1 << i
    full = (1 << len(a)) - 1
    v, steps = full, []
    for line in b:
        u = v & where.get(line, 0)
        v = ((v + u) | (v - u)) & full
        steps.append(v)
    out, i, j = [], len(a) - 1, len(b) - 1
    while i >= 0 and j >= 0:
        if steps[j] >> i & 1:
            i -= 1
        elif j > 0 and not steps[j - 1] >> i & 1:
            j -= 1
        else:
            out.append(i)
            i, j = i - 1, j - 1
    return out[::-1]


def _begins_alike(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _partners(batches) -> Iterator[pa.RecordBatch]:
    """place and partner's place, from (place, path, before, after): paths of the neighbours on the host, null if there is none."""
    for b in batches:
        out = []
        for place, path, before, after in zip(*(b.column(c).to_pylist() for c in ("place", "path", "before", "after"))):
            back, on = (-1 if x is None else _begins_alike(path, x) for x in (before, after))
            out.append(None if max(back, on) < 0 else place - 1 if back >= on else place + 1)
        yield pa.RecordBatch.from_arrays([b.column("place"), pa.array(out, pa.int64())], names=["place", "partner"])


def _differences(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, shared, kept = [], [], []
        for own, other in zip(b.column("txt").to_pylist(), b.column("other").to_pylist()):
            lines = [] if own is None else own.split("\n")
            same = set() if other is None else set(common_lines(lines, other.split("\n")))
            n.append(len(lines))
            shared.append(len(same))
            kept.append(None if own is None else "\n".join(x for i, x in enumerate(lines) if i not in same))
        yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("partner_rid"), pa.array(n, pa.int64()), pa.array(shared, pa.int64()), pa.array(kept, pa.string())], names=["rid", "partner", "n_lines", "shared_lines", "kept"])


def differenced(pages: DataFrame, page_id: str, host: str, path: str, text: str) -> DataFrame:
    """(rid, partner, n_lines, shared_lines, kept) of every distinct page.

    Rows with one id count once. A page alone on its host, or without a
    text, loses nothing (partner null where there is none); a null host or
    path is a host or path of its own kind (''). Neighbours are found by
    places in one distributed order, so no host gathers in a task.
    """
    once = pages.where(F.col(page_id).isNotNull()).select(F.col(page_id).cast("string").alias("rid"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), F.col(text).alias("txt")).dropDuplicates(["rid"])
    placed = stage(ranked(once, ["host", "path", "rid"], F.lit(0), "place", "none").drop("none"), "placed-pages")
    narrow = placed.select("place", "host", "path")
    beside = lambda step, name: narrow.select((F.col("place") + step).alias("place"), F.col("host").alias(f"{name}_host"), F.col("path").alias(f"{name}_path"))
    both = narrow.join(beside(1, "b"), "place", "left").join(beside(-1, "a"), "place", "left")
    on_host = lambda name: F.when(F.col(f"{name}_host") == F.col("host"), F.col(f"{name}_path"))
    partners = both.select("place", "path", on_host("b").alias("before"), on_host("a").alias("after")).mapInArrow(_partners, "place long, partner long")
    other = placed.select(F.col("place").alias("partner"), F.col("rid").alias("partner_rid"), F.col("txt").alias("other"))
    return placed.join(partners, "place").join(other, "partner", "left").select("rid", "partner_rid", "txt", "other").mapInArrow(_differences, "rid string, partner string, n_lines long, shared_lines long, kept string")
