"""Shingles, seeded minhash, banding: expressions, and a NumPy path for signatures."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = (1 << 61) - 1


def word_shingles(tokens: Column, k: int) -> Column:
    """The distinct runs of k tokens; empty for fewer than k. The guard lies inside the expression, so no rewrite can lose it."""
    if k < 1:
        raise ValueError("k must be positive")
    n = F.size(tokens)
    runs = F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.array_join(F.slice(tokens, i + 1, F.lit(k)), " "))
    return F.when(n >= k, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def char_shingles(tokens: Column, k: int) -> Column:
    """The distinct runs of k characters of the tokens joined by spaces."""
    if k < 1:
        raise ValueError("k must be positive")
    text = F.array_join(tokens, " ")
    n = F.length(text)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(k)))
    return F.when(n >= k, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def stable_hash(s: Column) -> Column:
    """CRC-32 of the UTF-8 bytes, as a non-negative bigint."""
    return F.crc32(F.encode(s, "UTF-8"))


def hash_params(n: int, seed: int) -> list[tuple[int, int]]:
    """n pairs (a, b) of the family (a * x + b) mod 2**61 - 1, drawn in the order a, b, a, b."""
    draw = random.Random(seed).randrange
    flat = [draw(PRIME) if i % 2 else draw(1, PRIME) for i in range(2 * n)]
    return list(zip(flat[::2], flat[1::2]))


def permuted(x: Column, a: int, b: int) -> Column:
    """(a * x + b) mod 2**61 - 1 for 0 <= x < 2**32, every step below 2**63."""
    high, low = a >> 31, a & ((1 << 31) - 1)
    t = (F.lit(high) * x) % F.lit(PRIME)
    turned = F.shiftright(t, 30) + F.shiftleft(t.bitwiseAND(F.lit((1 << 30) - 1)), 31)
    return ((turned % F.lit(PRIME)) + (F.lit(low) * x) % F.lit(PRIME) + F.lit(b) % F.lit(PRIME)) % F.lit(PRIME)


def minhash_expression(hashes: Column, params: list[tuple[int, int]]) -> Column:
    """The signature of an array of hashes, by higher-order functions alone."""

    def one(a: int, b: int) -> Column:
        return F.array_min(F.transform(hashes, lambda x: permuted(x, a, b)))

    return F.array(*[one(a, b) for a, b in params])


def minhash_numpy(values: np.ndarray, starts: np.ndarray, params: list[tuple[int, int]]) -> np.ndarray:
    """Signatures (a row each) of non-empty sets of hashes below 2**32, given on end with the start of each."""
    p, m29 = np.uint64(PRIME), np.uint64((1 << 29) - 1)
    x = values.astype(np.uint64)
    out = np.empty((len(starts), len(params)), np.int64)
    for i, (a, b) in enumerate(params):
        t = (np.uint64(a >> 32) * x) % p
        t = ((t & m29) << np.uint64(32)) + (t >> np.uint64(29))
        v = np.uint64(a & ((1 << 32) - 1)) * x
        v = (v & p) + (v >> np.uint64(61))
        out[:, i] = np.minimum.reduceat((t + v + np.uint64(b)) % p, starts)
    return out


def minhash_batches(params: list[tuple[int, int]]):
    """A function for mapInArrow: the last column, an array of hashes, becomes its signature; empty and null sets are left out."""

    def run(batches):
        for batch in batches:
            last = batch.num_columns - 1
            full = pc.fill_null(pc.greater(pc.list_value_length(batch.column(last)), 0), False)
            batch = batch.filter(full)
            if not len(batch):
                continue
            lists = batch.column(last)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            sig = minhash_numpy(lists.flatten().to_numpy(zero_copy_only=False), starts, params)
            offsets = np.arange(0, sig.size + 1, len(params), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(last)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(sig.ravel()))], names=[*batch.schema.names[:last], "sig"])

    return run


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets as arrays; 0.0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), (F.size(a) + F.size(b) - both).cast("double")), F.lit(0.0))


def estimate(a: Column, b: Column) -> Column:
    """The fraction of equal places of two signatures; different lengths raise."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z))
    return F.when(F.size(a) != F.size(b), F.raise_error("signatures differ in length").cast("double")).otherwise(same / F.size(a))


def lsh_threshold(bands: int, rows: int) -> float:
    return (1 / bands) ** (1 / rows)


def lsh_probability(s: Column, bands: int, rows: int) -> Column:
    return 1 - F.power(1 - F.power(s, F.lit(rows)), F.lit(bands))


def band_keys(signature: Column, bands: int, rows: int) -> Column:
    """'band:digest' of every band of the signature; a signature of another length raises."""
    keys = F.array(*[F.concat(F.lit(f"{i}:"), F.substring(F.sha1(F.array_join(F.transform(F.slice(signature, i * rows + 1, rows), lambda v: v.cast("string")), ",").cast("binary")), 1, 16)) for i in range(bands)])
    return F.when(F.size(signature) != bands * rows, F.raise_error("signature length is not bands * rows").cast("array<string>")).otherwise(keys)
