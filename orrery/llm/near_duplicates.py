"""Near-duplicate records: b-bit MinHash with banded candidates.

Every record becomes the set of its runs of k words. Records with equal sets
are one class (named by a 128-bit digest), so copies never multiply. For each
class 64 minima are taken and their two low bits packed into 128 bits.

Bands. A sketch of the whole collection (counters of a bounded number) tells
which runs are common. If more than (1 - t) of a set's runs are uncommon, any
partner with a Jaccard similarity >= t shares an uncommon run, so minima over
uncommon runs alone make its bands: one row each, and hence buckets no larger
than the sketch's threshold. Sets that are poor in uncommon runs also enter
bands of three rows over all runs, so that two poor sets can meet.

Band entries travel as packed NumPy blobs, not as rows: (key, class, two
packed signatures). Within a bucket the similarity is estimated by counting
equal two-bit fields, corrected for chance collisions, by the first signature
and then by both; only pairs near or above the threshold leave the task. They
are then checked exactly. Sets grow poor as a collection grows, so entries are
made and paired in rounds, a few bands at a time: the disk holds the entries
of one round, however many bands a set has. Buckets above
HOT_BUCKET entries are cut into blocks, and each pair of blocks is a task of
its own: no pair is dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.words import U64, Hasher, f1_words, mix, odd_constants, run_hashes, run_sets
from orrery.runtime import at_most, drop_shuffles, drop_stage, spread, stage

MINIMA, LOW_BITS = 64, 2
RARE_BANDS = 14
FULL_BANDS, FULL_ROWS = 32, 3
#: Bits of a run hash that number the counters of the sketch: about one counter a run, within these bounds.
SKETCH_BITS = (22, 26)
COMMON_ABOVE = 128
#: Bits of the sketch of wanted ids: eight slots an id, within these bounds.
WANTED_BITS = (24, 28)
HOT_BUCKET = 4096
BATCH_WORDS = 400_000
#: Band entries that a task holds before it hands them on.
HELD_ENTRIES = 500_000
#: Bytes of band entries that a task pairs at once.
PART_BYTES = 64 << 20
#: Band entries a set, on average, that one round makes and pairs.
ROUND_ENTRIES = 5
_MULT = odd_constants(MINIMA, 4711)
_MORE_MULT = odd_constants(MINIMA, 4714)
_RARE_MULT = odd_constants(RARE_BANDS, 4712)
_FULL_MULT = odd_constants(FULL_BANDS * FULL_ROWS, 4713)


def _texts(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(ids, hashed words on end, words per record) of the records with enough words, in bounded portions."""
    hasher = Hasher()
    ids, words, sizes = [], [], []
    for batch in batches:
        rid = batch.column(0).to_pylist()
        for i, text in enumerate(batch.column(1).to_pylist()):
            w = f1_words(text)
            if len(w) < min_words:
                continue
            ids.append(rid[i])
            words += w
            sizes.append(len(w))
            if len(words) > BATCH_WORDS:
                yield ids, hasher(words), np.array(sizes)
                ids, words, sizes = [], [], []
    if ids:
        yield ids, hasher(words), np.array(sizes)


def _between(n: int, bounds: tuple[int, int]) -> int:
    """Bits for n slots, within bounds."""
    return min(max(int(n).bit_length(), bounds[0]), bounds[1])


_TOKENS = "rid string, w array<bigint>, again array<int>, cls long, cls2 long, sig binary, chunk int, counts binary"


def _tokens(batches, k: int, min_words: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Records with enough words as hashed words, with the places of repeated runs, class digest and both signatures.

    And counters of run hashes (255 stands for more) in chunks of 2**16;
    chunk -1 has the number of sets, chunk -2 that of their runs.
    """
    total = np.zeros(1 << bits, np.uint8)
    sets = runs = 0
    kinds = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary())
    names = ["rid", "w", "again", "cls", "cls2", "sig", "chunk", "counts"]

    def batch(*cols):
        n = len(cols[0]) if cols[0] is not None else len(cols[-1])
        return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else c for c, t in zip(cols, kinds)], names=names)

    for ids, tokens, sizes in _texts(batches, min_words):
        h, doc = run_hashes(tokens, sizes, k)
        starts = np.concatenate([[0], np.cumsum(sizes - k + 1)])
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        repeats = np.sort(order[~new])
        of = np.searchsorted(starts, repeats, side="right") - 1
        again = pa.ListArray.from_arrays(pa.array(np.searchsorted(repeats, starts).astype(np.int32)), pa.array((repeats - starts[of]).astype(np.int32)))
        h, counts = h[new], np.bincount(doc[new], minlength=len(ids))
        slots, n = np.unique((h >> U64(64 - bits)).astype(np.int64), return_counts=True)
        total[slots] = np.minimum(total[slots] + n, 255)
        sets += len(ids)
        runs += len(h)
        at = np.concatenate([[0], np.cumsum(counts)])
        raw = h.tobytes()
        dig = np.array([np.frombuffer(hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest(), np.int64) for a, b in zip(at[:-1], at[1:])]).reshape(-1, 2)
        sig = np.concatenate([_pack(_minima(h, counts, m)) for m in (_MULT, _MORE_MULT)], axis=1)
        words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(tokens.view(np.int64)))
        yield batch(pa.array(ids, pa.string()), words, again, pa.array(dig[:, 0].copy()), pa.array(dig[:, 1].copy()), pa.array([x.tobytes() for x in sig], pa.binary()), None, None)
    if sets:
        chunks = total.reshape(-1, 1 << 16)
        used = np.flatnonzero(chunks.any(axis=1))
        yield batch(None, None, None, None, None, None, pa.array(np.append(used, [-1, -2]).astype(np.int32)), pa.array([*(chunks[c].tobytes() for c in used), sets.to_bytes(8, "little"), runs.to_bytes(8, "little")], pa.binary()))


def _words(batches) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(ids, hashed words on end, words per record) of batches (rid, w), in bounded portions."""
    for b in batches:
        ids, lists = b.column(0).to_pylist(), b.column(1)
        at = np.array(lists.offsets).astype(np.int64)
        flat = np.array(lists.values).view(U64)
        i = 0
        while i < len(ids):
            j = max(i + 1, int(np.searchsorted(at, at[i] + BATCH_WORDS)))
            j = min(j, len(ids))
            yield ids[i:j], flat[at[i] : at[j]], np.diff(at[i : j + 1])
            i = j


def _sum_sketch(batches) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for c, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            sums[c] = sums.get(c, 0) + (np.frombuffer(x, np.uint8).astype(np.uint32) if c >= 0 else int.from_bytes(x, "little"))
    for c, x in sums.items():
        out = x.to_bytes(8, "little") if c < 0 else np.packbits(x > COMMON_ABOVE + 2 * float(x.mean())).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([out], pa.binary())], names=["chunk", "common"])


def common_runs(records: DataFrame, k: int, min_words: int) -> tuple[DataFrame, np.ndarray, int, int]:
    """(stage table, packed bits, sets, runs): the records as hashed words (where rid isn't null), whether a run hash with these leading bits is common, the number of sets and of their runs.

    Texts are read and cut into words here alone. The sketch counts every
    run of every record; it has 2**26 counters at most, and what calls a
    run common is above the mean where they are full.
    """
    bits = _between(16 * records.count(), SKETCH_BITS)
    found = stage(records.mapInArrow(partial(_tokens, k=k, min_words=min_words, bits=bits), _TOKENS), "tokens")
    parts = found.where("rid is null").select("chunk", "counts").repartition("chunk")
    common, n = np.zeros((1 << bits) // 8, np.uint8), {}
    for row in parts.mapInArrow(_sum_sketch, "chunk int, common binary").toLocalIterator():
        if row["chunk"] < 0:
            n[row["chunk"]] = int.from_bytes(row["common"], "little")
        else:
            common[row["chunk"] << 13 : (row["chunk"] + 1) << 13] = np.frombuffer(row["common"], np.uint8)
    return found, common, n.get(-1, 0), n.get(-2, 0)


def part_labels(spark: SparkSession, parts: int) -> np.ndarray:
    """For each of ``parts`` partitions a number that the hash partitioner sends there, so that no two parts meet in a task."""
    n = F.col("id").cast("int")
    rows = spark.range(parts * (8 + parts.bit_length())).groupBy(F.pmod(F.hash(n), F.lit(parts)).alias("p")).agg(F.min(n).alias("n")).collect()
    out = np.full(parts, rows[0]["n"], np.int32)
    for r in rows:
        out[r["p"]] = r["n"]
    return out


def _minima(h: np.ndarray, counts: np.ndarray, mult: np.ndarray) -> np.ndarray:
    """Minima per multiplier (rows) of each non-empty group (columns) of h."""
    at = np.concatenate([[0], np.cumsum(counts)])[:-1]
    return np.stack([np.minimum.reduceat(mix_light(h, m), at) for m in mult]) if len(counts) else np.empty((len(mult), 0), U64)


def mix_light(h: np.ndarray, m: np.uint64) -> np.ndarray:
    x = h * m
    return x ^ (x >> U64(31))


def _pack(minima: np.ndarray) -> np.ndarray:
    """Two low bits of 64 minima in two words per set: bit 0 of each in the first, bit 1 in the second."""
    place = (U64(1) << np.arange(MINIMA, dtype=U64))[:, None]
    scrambled = minima >> U64(7)
    return np.stack([((scrambled & U64(1)) * place).sum(axis=0, dtype=U64), (((scrambled >> U64(1)) & U64(1)) * place).sum(axis=0, dtype=U64)], axis=1)


_ENTRY = np.dtype([("key", "<u4"), ("cls", "<u8"), ("s0", "<u8"), ("s1", "<u8"), ("s2", "<u8"), ("s3", "<u8")])
_SIGNED = ("s0", "s1", "s2", "s3")


def prefix_sizes(counts: np.ndarray, threshold: float) -> np.ndarray:
    """How many runs of a set of each size must be looked at so that, in one order of all runs, similar sets share one."""
    return counts - np.ceil(threshold * counts - 1e-9).astype(np.int64) + 1


def _run_portions(batches, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(runs, their sets, runs per set, classes, signatures) of batches (w, again, cls, sig); copies within a portion enter once."""
    for b in batches:
        lists, repeats = b.column(0), b.column(1)
        at, past = (np.array(x.offsets).astype(np.int64) for x in (lists, repeats))
        flat, places = np.array(lists.values).view(U64), np.array(repeats.values).astype(np.int64)
        classes = np.array(b.column(2)).view(U64)
        sigs = np.frombuffer(b"".join(b.column(3).to_pylist()), U64).reshape(-1, 4)
        i = 0
        while i < len(b):
            j = min(max(i + 1, int(np.searchsorted(at, at[i] + BATCH_WORDS))), len(b))
            sizes = np.diff(at[i : j + 1])
            h, doc = run_hashes(flat[at[i] : at[j]], sizes, k)
            starts = np.concatenate([[0], np.cumsum(sizes - k + 1)])[:-1]
            cls, first = np.unique(classes[i:j], return_index=True)
            pick = np.zeros(j - i, bool)
            pick[first] = True
            keep = pick[doc]
            keep[places[past[i] : past[j]] + np.repeat(starts, np.diff(past[i : j + 1]))] = False
            doc = (np.cumsum(pick) - 1)[doc[keep]]
            yield h[keep], doc, np.bincount(doc, minlength=len(cls)), classes[i:j][pick], sigs[i:j][pick]
            i = j


def _entries(batches, k: int, threshold: float, common, labels: np.ndarray, kind: str, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
    """Blobs of one round's entries by partition, and the number of poor sets.

    kind: "rare" for the bands lo to hi over uncommon runs, "full" for those
    of poor sets over all runs; "exact" for every run of the prefixes whose
    hash is lo modulo hi.
    """
    common = common.value
    bits = (8 * len(common)).bit_length() - 1
    parts = len(labels)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n_held = n_poor = 0

    def flush():
        keys = np.concatenate([a for a, _ in held])
        rows = np.concatenate([b for _, b in held])
        part = (keys % U64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        rows, part = rows[order], part[order]
        cut = np.flatnonzero(np.diff(part)) + 1
        ps = part[np.concatenate([[0], cut])]
        return pa.RecordBatch.from_arrays([pa.nulls(len(ps), pa.int64()), pa.array(labels[ps]), pa.array([p.tobytes() for p in np.split(rows, cut)], pa.binary())], names=["poor", "part", "blob"])

    for h, doc, counts, cls, sig in _run_portions(batches, k):
        slot = (h >> U64(64 - bits)).astype(np.int64)
        rare = (common[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 0
        n_rare = np.bincount(doc[rare], minlength=len(counts))

        def entries(of: np.ndarray, keys: np.ndarray):
            keys = mix(keys)
            row = np.empty(keys.size, _ENTRY)
            row["key"] = (keys >> U64(32)).ravel()
            for name, x in (("cls", cls), *zip(_SIGNED, sig.T)):
                row[name] = np.broadcast_to(x[of], keys.shape).ravel()
            held.append((keys.ravel() & U64(0xFFFFFFFF), row))
            return keys.size

        has, poor = n_rare > 0, n_rare <= np.floor((1 - threshold) * counts + 1e-9)
        n_poor += int(poor.sum())
        if kind == "exact":  # every run of the prefix is a key of its own: uncommon runs first, then by hash
            order = np.lexsort((h, ~rare, doc))
            at = np.concatenate([[0], np.cumsum(counts)])[:-1]
            first = np.arange(len(h)) - np.repeat(at, counts) < np.repeat(prefix_sizes(counts, threshold), counts)
            first &= h[order] % U64(hi) == lo
            n_held += entries(doc[order][first], h[order][first])
        elif kind == "rare" and has.any():
            m = _minima(h[rare], n_rare[has], _RARE_MULT[lo:hi])
            n_held += entries(np.flatnonzero(has), m + np.arange(lo, hi, dtype=U64)[:, None])
        elif kind == "full" and poor.any():
            m = _minima(h[poor[doc]], counts[poor], _FULL_MULT[lo * FULL_ROWS : hi * FULL_ROWS]).reshape(hi - lo, FULL_ROWS, -1)
            key = np.zeros((hi - lo, m.shape[2]), U64)
            for r in range(FULL_ROWS):
                key = mix(key + m[:, r])
            n_held += entries(np.flatnonzero(poor), key + np.arange(1000 + lo, 1000 + hi, dtype=U64)[:, None])
        if n_held > HELD_ENTRIES:
            yield flush()
            held, n_held = [], 0
    if n_held:
        yield flush()
    yield pa.RecordBatch.from_arrays([pa.array([n_poor], pa.int64()), pa.array(labels[:1]), pa.nulls(1, pa.binary())], names=["poor", "part", "blob"])


def estimate(*both: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Collision-corrected similarity from the words of packed signatures, given as (one, other) in the order of the words."""
    same = sum(np.bitwise_count(~((x ^ y) | (z ^ w))).astype(int) for (x, y), (z, w) in zip(both[::2], both[1::2]))
    chance = 2.0**-LOW_BITS
    return (same / (MINIMA * len(both) // 2) - chance) / (1 - chance)


def _alike(e: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, least: tuple[float, float]) -> np.ndarray:
    """Which entries i and j have estimates that reach ``least`` by the first signature and by both."""
    ok = np.flatnonzero(estimate(*((e[s][i], e[s][j]) for s in _SIGNED[:2])) >= least[0])
    return ok[estimate(*((e[s][i[ok]], e[s][j[ok]]) for s in _SIGNED)) >= least[1]]


def _columns(e: np.ndarray) -> dict[str, np.ndarray]:
    return {s: np.ascontiguousarray(e[s]) for s in ("cls", *_SIGNED)}


def cut_off(threshold: float, sigmas: float = 4.0, minima: int = MINIMA) -> float:
    """The estimate below which a pair is given up: ``sigmas`` standard deviations under the threshold."""
    c = 2.0**-LOW_BITS
    p = c + (1 - c) * threshold
    return threshold - sigmas * (p * (1 - p) / minima) ** 0.5 / (1 - c)


def _pairs_out(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate([f[i] for f in found]) if found else np.empty(0, U64) for i in (0, 1))
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.empty((0, 2), U64)
    n = len(both)
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(both[:, 0].copy().view(np.int64)), pa.array(both[:, 1].copy().view(np.int64)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=["poor", "a", "b", "hot", "entry"])


def _buckets(batches, least: tuple[float, float]) -> Iterator[pa.RecordBatch]:
    """Pairs of classes in a bucket whose estimates reach ``least``; entries of hot buckets and numbers of poor sets as they are.

    Rows are ordered by part; one part's entries are held at a time.
    """
    blobs: list[bytes] = []
    part = None

    for b in batches:
        told = b.column("poor").drop_null()
        if n := len(told):
            yield pa.RecordBatch.from_arrays([told, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=["poor", "a", "b", "hot", "entry"])
        rest = b.filter(b.column("poor").is_null())
        for p, blob in zip(rest.column("part").to_pylist(), rest.column("blob").to_pylist()):
            if p != part and blobs:
                yield from _paired(part, blobs, least)
                blobs = []
            part = p
            blobs.append(blob)
    if blobs:
        yield from _paired(part, blobs, least)


def _paired(p: int, blobs: list[bytes], least: tuple[float, float]) -> Iterator[pa.RecordBatch]:
    e = np.frombuffer(b"".join(blobs), _ENTRY)
    e = e[np.lexsort((e["cls"], e["key"]))]
    new = np.ones(len(e), bool)
    new[1:] = (e["key"][1:] != e["key"][:-1]) | (e["cls"][1:] != e["cls"][:-1])
    e = e[new]
    start = np.ones(len(e), bool)
    start[1:] = e["key"][1:] != e["key"][:-1]
    at = np.flatnonzero(start)
    size = np.diff(np.append(at, len(e)))
    for i in np.flatnonzero(size > HOT_BUCKET):
        rows = e[at[i] : at[i] + size[i]]
        hot = (p << 32) + int(rows["key"][0])
        for j in range(0, len(rows), 10_000):
            part = rows[j : j + 10_000]
            n = len(part)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(np.full(n, hot, np.int64)), pa.array([x.tobytes() for x in part], pa.binary())], names=["poor", "a", "b", "hot", "entry"])
    left = np.repeat(np.where((size > 1) & (size <= HOT_BUCKET), size, 0), size)
    rank = np.arange(len(e)) - np.repeat(at, size)
    todo = np.flatnonzero(left > 1)
    e = _columns(e)
    found, n_found, d = [], 0, 1
    while len(todo):
        todo = todo[rank[todo] + d < left[todo]]
        ok = todo[_alike(e, todo, todo + d, least)]
        if len(ok):
            found.append((e["cls"][ok], e["cls"][ok + d]))
            n_found += len(ok)
        if n_found > 500_000:
            yield _pairs_out(found)
            found, n_found = [], 0
        d += 1
    if found:
        yield _pairs_out(found)


def _block_pairs(batches, least: tuple[float, float]) -> Iterator[pa.RecordBatch]:
    """Pairs across (or, for side 2, within) the two blocks of each (hot, i, j)."""
    groups: dict[tuple, dict[int, list[bytes]]] = {}
    for b in batches:
        for hot, i, j, side, entry in zip(*(b.column(x).to_pylist() for x in range(5))):
            groups.setdefault((hot, i, j), {}).setdefault(side, []).append(entry)
    for (_, i, j), sides in groups.items():
        own = {s: np.frombuffer(b"".join(x), _ENTRY) for s, x in sides.items()}
        if i == j:
            x = _columns(own[2])
            at = np.arange(len(own[2]))
            for d in range(1, len(at)):
                ok = _alike(x, at[:-d], at[d:], least)
                if len(ok):
                    yield _pairs_out([(x["cls"][ok], x["cls"][ok + d])])
        elif len(own) == 2:
            n = len(own[1])
            x = _columns(np.concatenate([own[1], own[0]]))
            for one in range(n, n + len(own[0])):
                ok = _alike(x, np.full(n, one), np.arange(n), least)
                if len(ok):
                    yield _pairs_out([(np.full(len(ok), x["cls"][one]), x["cls"][ok])])


_PAIRS = "poor long, a long, b long, hot long, entry binary"


def _slot(rid: str, bits: int) -> int:
    return xxhash.xxh3_64_intdigest(rid) >> (64 - bits)


def _wanted(batches, n_bits: int) -> Iterator[pa.RecordBatch]:
    """Set bits of the wanted record ids, in chunks of 2**16."""
    bits = np.zeros(1 << n_bits, bool)
    for b in batches:
        bits[[_slot(r, n_bits) for r in b.column(0).to_pylist()]] = True
    chunks = bits.reshape(-1, 1 << 16)
    used = np.flatnonzero(chunks.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([np.packbits(chunks[c]).tobytes() for c in used], pa.binary())], names=["chunk", "bits"])


def _or_chunks(batches) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for c, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            sums[c] = sums.get(c, 0) | np.frombuffer(x, np.uint8)
    for c, x in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["chunk", "bits"])


def wanted_sketch(rids: DataFrame) -> np.ndarray:
    """A sketch of bounded size that holds every id of ``rids`` (and a few others): it thins a scan before its join."""
    n_bits = _between(8 * rids.count(), WANTED_BITS)
    bits = np.zeros((1 << n_bits) // 8, np.uint8)
    parts = rids.mapInArrow(partial(_wanted, n_bits=n_bits), "chunk int, bits binary").repartition("chunk").mapInArrow(_or_chunks, "chunk int, bits binary")
    for row in parts.toLocalIterator():
        bits[row["chunk"] << 13 : (row["chunk"] + 1) << 13] = np.frombuffer(row["bits"], np.uint8)
    return bits


def _sets(batches, k: int, wanted) -> Iterator[pa.RecordBatch]:
    bits = wanted.value
    n_bits = (8 * len(bits)).bit_length() - 1

    def thinned():
        for b in batches:
            at = np.array([_slot(r, n_bits) for r in b.column(0).to_pylist()], np.int64)
            keep = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            if keep.any():
                yield b.filter(pa.array(keep))

    for ids, tokens, sizes in _words(thinned()):
        h, _, counts = run_sets(tokens, sizes, k)
        at = np.concatenate([[0], np.cumsum(counts)])
        raw = h.tobytes()
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array([raw[8 * a : 8 * b] for a, b in zip(at[:-1], at[1:])], pa.binary())], names=["rid", "runs"])


def _exact(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        j = []
        for x, y in zip(b.column("runs_a").to_pylist(), b.column("runs_b").to_pylist()):
            x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            j.append(both / (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([b.column("rid_a"), b.column("rid_b"), pa.array(j, pa.float64())], names=["rid_a", "rid_b", "jaccard"])


def near_duplicates(records: DataFrame, record_id: str, text: str, k: int = 5, threshold: float = 0.8, min_words: int | None = None, parts: int | None = None, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(members, links): the classes of equal run sets, and the similar pairs between classes.

    members: rid, rep (the least record id of its class; one row per record
    that has at least max(min_words, k) F1 words). links: rep_a < rep_b,
    jaccard >= threshold, each pair of classes once. Rows with the same id
    are one record; null ids are left out; null, empty and short texts have
    no run and are not members. An empty table gives two empty frames.

    The bands miss a pair at the threshold with a small probability, and so
    does the cut on the estimate. With ``exact`` nothing is missed: the keys
    are then the runs of each set's prefix, and every pair in a bucket is
    checked. That costs entries in proportion to the words of a text.

    Entries are made and paired in rounds of about ROUND_ENTRIES a set, and
    candidates are checked in slices of as many bytes, or more for long texts.
    """
    spark = records.sparkSession
    least_words = max(min_words or k, k)
    src = spread(records.select(F.col(record_id).cast("string").alias("rid"), F.col(text).alias("txt")).where("rid is not null"))
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    staged, common, n_sets, n_runs = common_runs(src, k, least_words)
    kept = spread(staged.where("rid is not null"))
    round_bytes = max(1, n_sets) * ROUND_ENTRIES * _ENTRY.itemsize
    parts = parts or max(shuffle, -(-round_bytes // PART_BYTES))
    labels = part_labels(spark, parts)
    common = spark.sparkContext.broadcast(common)
    least = (-1.0, -1.0) if exact else (cut_off(threshold), cut_off(threshold, 4.0, 2 * MINIMA))

    def paired(kind: str, lo: int, hi: int) -> DataFrame:
        entries = kept.select("w", "again", "cls", "sig").mapInArrow(partial(_entries, k=k, threshold=threshold, common=common, labels=labels, kind=kind, lo=lo, hi=hi), "poor long, part int, blob binary")
        pairs = entries.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(partial(_buckets, least=least), _PAIRS)
        out = stage(pairs.withColumn("kind", F.when(F.col("poor").isNotNull(), 0).when(F.col("hot").isNull(), 1).otherwise(2)), "buckets", by="kind")
        drop_shuffles(spark)
        return out

    if exact:
        n = rounds_of(n_runs - int(threshold * n_runs) + n_sets, n_sets)
        rounds = [paired("exact", i, n) for i in range(n)]
    else:
        rounds = [paired("rare", i, min(i + ROUND_ENTRIES, RARE_BANDS)) for i in range(0, RARE_BANDS, ROUND_ENTRIES)]
        n_poor = rounds[0].where("kind = 0").agg(F.sum("poor")).first()[0] or 0
        if n_poor:
            step = -(-FULL_BANDS // rounds_of(FULL_BANDS * n_poor, n_sets))
            rounds += [paired("full", i, min(i + step, FULL_BANDS)) for i in range(0, FULL_BANDS, step)]
    found = reduce(DataFrame.unionByName, rounds)
    pairs = found.where("kind = 1").select("a", "b")
    hot = found.where("kind = 2").select("hot", "entry")
    if not at_most(hot, 0):
        n = hot.groupBy("hot").agg(F.ceil(F.count("*") / (HOT_BUCKET // 2)).cast("int").alias("nb"))
        blk = hot.join(n, "hot").withColumn("blk", F.pmod(F.xxhash64("entry"), F.col("nb")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
        halves = blk.withColumn("o", other).select("hot", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), F.when(F.col("blk") == F.col("o"), 2).when(F.col("blk") < F.col("o"), 0).otherwise(1).alias("side"), "entry")
        pairs = pairs.unionByName(halves.repartition(4 * shuffle, "hot", "i", "j").mapInArrow(partial(_block_pairs, least=least), _PAIRS).select("a", "b"))
    cand = stage(pairs.distinct(), "candidates")
    for x in rounds:
        drop_stage(x)
    members = kept.select("rid", "cls", "cls2").distinct()
    reps = members.groupBy("cls", "cls2").agg(F.min("rid").alias("rep"))
    members = stage(members.join(reps, ["cls", "cls2"]).select("rid", "rep", "cls"), "members")
    drop_shuffles(spark)
    need = cand.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    named = stage(members.where("rid = rep").join(need, "cls").select("cls", "rid"), "candidate-classes")
    wanted = spark.sparkContext.broadcast(wanted_sketch(named.select("rid")))
    sets = kept.select("rid", "w").mapInArrow(partial(_sets, k=k, wanted=wanted), "rid string, runs binary").dropDuplicates(["rid"])
    sets = stage(named.join(sets, "rid"), "candidate-sets")
    drop_stage(staged)
    drop_shuffles(spark)
    one, two = (sets.select(F.col("cls").alias(x), F.col("rid").alias(f"rid_{x}"), F.col("runs").alias(f"runs_{x}")) for x in "ab")
    set_bytes = sets.agg(F.avg(F.octet_length("runs"))).first()[0] or 0
    # a slice moves as much as a round does, or half of all runs where texts are long
    n = -(-int(2 * set_bytes * cand.count()) // max(round_bytes, 4 * n_runs, PART_BYTES))
    links = []
    for i in range(max(1, n)):
        of_slice = F.pmod(F.xxhash64("a"), F.lit(n)) == i if n > 1 else F.lit(True)
        checked = cand.where(of_slice).join(one.where(of_slice), "a").join(two, "b").select("rid_a", "rid_b", "runs_a", "runs_b").mapInArrow(_exact, "rid_a string, rid_b string, jaccard double").where(F.col("jaccard") >= threshold)
        links.append(stage(checked.select(F.least("rid_a", "rid_b").alias("rep_a"), F.greatest("rid_a", "rid_b").alias("rep_b"), "jaccard").distinct(), "links"))
        drop_shuffles(spark)
    drop_stage(sets)
    # the same link from two slices: classes that share their 64 bits
    links = reduce(DataFrame.unionByName, links)
    return members.select("rid", "rep"), links.distinct() if n > 1 else links


def rounds_of(entries: int, sets: int) -> int:
    """Rounds that make ROUND_ENTRIES entries a set each."""
    return max(1, -(-entries // (ROUND_ENTRIES * max(1, sets))))


def similar_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs (key_a < key_b) of different records behind members and links, copies expanded."""
    m1, m2 = (members.select(F.col("rid").alias(f"r{x}"), F.col("rep").alias(f"p{x}")) for x in "12")
    many = members.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select("rep")
    inside = members.join(many, "rep")
    i1, i2 = (inside.select(F.col("rid").alias(f"r{x}"), F.col("rep").alias(f"p{x}")) for x in "12")
    within = i1.join(i2, (F.col("p1") == F.col("p2")) & (F.col("r1") < F.col("r2"))).select("r1", "r2")
    across = links.join(m1, F.col("rep_a") == F.col("p1")).join(m2, F.col("rep_b") == F.col("p2")).select("r1", "r2")
    both = within.unionByName(across)
    return both.select(F.least("r1", "r2").alias("key_a"), F.greatest("r1", "r2").alias("key_b"))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): connected components by alternating large-star and small-star steps.

    Every step is a grouped minimum and a join, written to the shared folder;
    no component is ever gathered. Nodes without links aren't listed.
    """
    edges = stage(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage(large, "large-star")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        small = stage(small, "small-star")
        moved = small.exceptAll(edges).limit(1).count() + edges.exceptAll(small).limit(1).count()
        edges = small
        if not moved:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
