"""Evaluation texts inside a corpus, by spaced seeds.

A seed is a fixed mask over a window of words; the words under its zeros are
ignored. The masks are chosen by the number of substituted words so that none
of their places can hide a leak. The masked windows of all test items are
hashed and joined with those of every document: a broadcast of sorted hashes
while their number is proven small; beyond, a sketch of bounded size thins the
documents' windows before they are shuffled. A hit names a diagonal: the two texts are
laid on each other there, over the whole length of the item, and the best
stretch of agreeing words is found, with a budget of substituted words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.words import U64, Hasher, f2_words, mix, odd_constants
from orrery.runtime import at_most, hot_join, spread, stage

#: Words of a run that counts as a leak.
RUN = 12
# fixed values: the seeds of a family reach every stretch with RUN equal words and so many substitutions, wherever these stand (enumerated in the tests)
MASKS = ("1" * RUN, "1101110111", "11101111", "1110010111")
FAMILIES = {0: MASKS[:1], 1: MASKS[1:2], 2: MASKS[2:]}
#: Masked windows of items up to which they are broadcast (24 bytes each).
BROADCAST_SEEDS = 1_000_000
#: Documents that hold one seed, or one item, beyond which it is broadcast to them in the shuffled plan.
HOT_SEED = 100_000
BATCH_WORDS = 300_000


def masked(tokens: np.ndarray, mask: str) -> np.ndarray:
    """Hashes of all windows of len(mask) words, the ones under a zero ignored."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.empty(0, U64)
    h = np.full(n, len(mask), U64)
    for i, (bit, c) in enumerate(zip(mask, odd_constants(len(mask), 991))):
        if bit == "1":
            h += tokens[i : i + n] * c
    return mix(h + U64(int(mask, 2)))


def family(substitutions: int) -> tuple[str, ...]:
    """Masks of which one at least fits into any stretch of RUN equal words and ``substitutions`` others.

    Beyond the enumerated families it is one block: RUN words in
    substitutions + 1 parts leave a part of so many equal words.
    """
    return FAMILIES.get(substitutions) or ("1" * -(-RUN // (substitutions + 1)),)


def _masks_for(n_words: int, substitutions: int) -> tuple[str, ...]:
    """The family of masks, or all words of an item of fewer than RUN, which must stand there unchanged."""
    return family(substitutions) if n_words >= RUN else ("1" * n_words,) if n_words else ()


def _item_seeds(batches, substitutions: int) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for b in batches:
        rows = [[], [], [], []]
        for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            t = hasher(f2_words(text))
            for mask in _masks_for(len(t), substitutions):
                h = masked(t, mask)
                rows[0] += [mask] * len(h)
                rows[1] += h.view(np.int64).tolist()
                rows[2] += [item] * len(h)
                rows[3] += range(len(h))
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.int64())], names=["mask", "h", "item", "pos"])


def overlap(doc: np.ndarray, item: np.ndarray, shift: int, substitutions: int) -> tuple[int, int]:
    """(words, substitutions) of the agreeing stretch with most equal words, item[i] laid on doc[i + shift].

    At most ``substitutions`` unequal words lie inside the stretch, no more
    than it needs; it begins and ends with equal words.
    """
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    if hi <= lo:
        return 0, 0
    bad = np.flatnonzero(item[lo:hi] != doc[lo + shift : hi + shift]) + lo
    cuts = np.concatenate([[lo - 1], bad, [hi]])
    # words between cuts s + 1 apart, without the s unequal ones; of equally many, those with the least s
    equal, s = max((int((cuts[s + 1 :] - cuts[: -s - 1]).max()) - 1 - s, -s) for s in range(min(substitutions, len(bad)) + 1))
    return (equal - s, -s) if equal > 0 else (0, 0)


def _needed(n_item: int) -> int:
    return min(RUN, n_item)


def _verify(doc: np.ndarray, item: np.ndarray, shifts, substitutions: int) -> tuple[int, int] | None:
    """The best overlap of at least _needed() equal words on the diagonals that were hit, each compared whole."""
    words, subs = max((overlap(doc, item, s, substitutions) for s in set(shifts)), key=lambda o: (o[0] - o[1], o[0]))
    return (words, subs) if words - subs >= _needed(len(item)) else None


_OUT = "doc string, item string, words long, substitutions long"


def _out(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["doc", "item", "words", "substitutions"])


def _scan(batches, seeds, substitutions: int) -> Iterator[pa.RecordBatch]:
    """Documents against broadcast seeds and items."""
    tables, items = seeds.value
    hasher = Hasher()
    ids, words, sizes = [], [], []

    def portion():
        tokens = hasher(words)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        doc_of = np.repeat(np.arange(len(sizes)), sizes)
        hits: dict[tuple[int, int], set] = {}
        for mask, (hashes, which, pos) in tables.items():
            h = masked(tokens, mask)
            if not len(h):
                continue
            at = np.searchsorted(hashes, h)
            at[at == len(hashes)] = 0
            inside = doc_of[: len(h)] == doc_of[len(mask) - 1 :]
            for p in np.flatnonzero((hashes[at] == h) & inside):
                d, k = int(doc_of[p]), int(at[p])
                while k < len(hashes) and hashes[k] == h[p]:
                    hits.setdefault((d, int(which[k])), set()).add(int(p - starts[d] - pos[k]))
                    k += 1
        rows = []
        for (d, i), found in hits.items():
            got = _verify(tokens[starts[d] : starts[d + 1]], items[i][1], found, substitutions)
            if got:
                rows.append((ids[d], items[i][0], *got))
        return _out(rows)

    for b in batches:
        doc_ids = b.column(0).to_pylist()
        for i, text in enumerate(b.column(1).to_pylist()):
            w = f2_words(text)
            if not w:
                continue
            ids.append(doc_ids[i])
            words += w
            sizes.append(len(w))
            if len(words) > BATCH_WORDS:
                yield portion()
                ids, words, sizes = [], [], []
    if ids:
        yield portion()


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> U64(64 - bits)).astype(np.int64)


def _seed_bits(batches, bits: int) -> Iterator[pa.RecordBatch]:
    """Bits of the item seeds by their leading bits, in chunks of 2**16."""
    held = np.zeros(1 << bits, bool)
    for b in batches:
        held[_slots(np.array(b.column(0)).view(U64), bits)] = True
    chunks = held.reshape(-1, 1 << 16)
    used = np.flatnonzero(chunks.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([np.packbits(chunks[c]).tobytes() for c in used], pa.binary())], names=["chunk", "bits"])


def _seed_sketch(seeds: DataFrame) -> np.ndarray:
    """Packed bits that hold every item seed: a corpus seed without its bit meets no item. 32 MB at most, whatever the number of seeds."""
    bits = min(max((16 * seeds.count()).bit_length(), 20), 28)
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in seeds.select("h").mapInArrow(partial(_seed_bits, bits=bits), "chunk int, bits binary").toLocalIterator():
        out[row["chunk"] << 13 : (row["chunk"] + 1) << 13] |= np.frombuffer(row["bits"], np.uint8)
    return out


def _doc_seeds(batches, masks: list[str], sketch) -> Iterator[pa.RecordBatch]:
    """The seeds of documents that may be an item's, as the sketch says."""
    bits = sketch.value
    width = (8 * len(bits)).bit_length() - 1
    hasher = Hasher()
    for b in batches:
        rows = [[], [], [], []]
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            t = hasher(f2_words(text))
            for mask in masks:
                h = masked(t, mask)
                slot = _slots(h, width)
                at = np.flatnonzero(bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1)
                rows[0] += [mask] * len(at)
                rows[1] += h[at].view(np.int64).tolist()
                rows[2] += [doc] * len(at)
                rows[3] += at.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["mask", "h", "doc", "dpos"])


def _check_pairs(batches, substitutions: int) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for b in batches:
        rows = []
        for r in b.to_pylist():
            got = _verify(hasher(f2_words(r["dtext"])), hasher(f2_words(r["itext"])), r["shifts"], substitutions)
            if got:
                rows.append((r["doc"], r["item"], *got))
        yield _out(rows)


def leaked_items(corpus: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, substitutions: int = 0, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(doc, item, words, substitutions): documents that hold a test item or a part of it.

    An item leaks into a document if a stretch of RUN of its words, or all
    of a shorter item's, stands there in order; ``substitutions`` words
    inside the stretch may be replaced by others, counting as no match.
    Words are F2 words. Null, empty or wordless texts match nothing; rows
    with the same id are verified each by itself and count once. Null ids
    are left out. Ids come back as strings.
    """
    spark = corpus.sparkSession
    docs = spread(corpus.select(F.col(doc_id).cast("string").alias("doc"), F.col(text).alias("dtext")).where("doc is not null and dtext is not null"))
    probes = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("itext")).where("item is not null and itext is not null").distinct()
    seeds = stage(probes.mapInArrow(partial(_item_seeds, substitutions=substitutions), "mask string, h long, item string, pos long"), "item-seeds")
    if at_most(seeds, broadcast_seeds):
        # items without a seed can't match; those with one are no more than the seeds
        texts = [(r["item"], Hasher()(f2_words(r["itext"]))) for r in probes.join(seeds.select("item").distinct(), "item", "left_semi").collect()]
        number: dict[str, list[int]] = {}
        for i, (name, _) in enumerate(texts):
            number.setdefault(name, []).append(i)
        rows = seeds.toPandas()
        tables = {}
        for mask, g in rows.groupby("mask"):
            flat = [(h, i, p) for h, name, p in zip(g["h"], g["item"], g["pos"]) for i in number[name]]
            h, i, p = (np.array(x) for x in zip(*flat))
            h = h.astype(np.int64).view(U64)
            order = np.argsort(h, kind="stable")
            tables[mask] = (h[order], i[order], p[order])
        found = docs.mapInArrow(partial(_scan, seeds=spark.sparkContext.broadcast((tables, texts)), substitutions=substitutions), _OUT)
    else:
        masks = [r["mask"] for r in seeds.select("mask").distinct().collect()]  # the family and one per word count below RUN
        sketch = spark.sparkContext.broadcast(_seed_sketch(seeds))
        mine = stage(docs.mapInArrow(partial(_doc_seeds, masks=masks, sketch=sketch), "mask string, h long, doc string, dpos long"), "corpus-seeds")
        # a seed that very many documents hold is broadcast to them
        busy = mine.groupBy("mask", "h").agg(F.count("*").alias("n")).where(F.col("n") > HOT_SEED)
        hits = hot_join(mine, seeds.join(busy, ["mask", "h"], "left"), ["mask", "h"], F.col("n").isNotNull())
        # a diagonal is verified whole: any hit names it, and a pair has no more of them than words
        hits = hits.select("doc", "item", (F.col("dpos") - F.col("pos")).alias("shift")).distinct().groupBy("doc", "item").agg(F.collect_list("shift").alias("shifts"))
        hits = stage(hits, "leak-hits")
        wide = hits.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") > HOT_SEED)
        texts = hot_join(hits, probes.join(wide, "item", "left"), ["item"], F.col("n").isNotNull()).drop("n")
        found = texts.join(docs, "doc").mapInArrow(partial(_check_pairs, substitutions=substitutions), _OUT)
    return found.groupBy("doc", "item").agg(F.max(F.struct("words", "substitutions")).alias("b")).select("doc", "item", "b.words", "b.substitutions")
