"""Words, their hashes and hashed word runs, batch-wise with NumPy."""

from __future__ import annotations

import re

import numpy as np
import xxhash

# fixed values: the two word rules
F1_WORD = re.compile(r"[a-z]+(?:'[a-z]+)*")
F2_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")

U64 = np.uint64
CACHE = 400_000


def f1_words(text: str | None) -> list[str]:
    """Lower-case ASCII words with inner apostrophes; none for null."""
    return F1_WORD.findall(text.lower().replace("’", "'")) if text else []


def f2_words(text: str | None) -> list[str]:
    """Runs of letters and digits of any script with inner apostrophes, each lower-cased after it is found."""
    return [w.lower() for w in F2_WORD.findall(text)] if text else []


class Hasher:
    """64-bit hashes of words, the same in every process; remembers a bounded number of words."""

    def __init__(self):
        self.seen: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        seen = self.seen
        if len(seen) > CACHE:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(seen.__getitem__, words), dtype=U64, count=len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finalizer of splitmix64)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def odd_constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers."""
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=U64) * U64(2) + U64(1)


def run_hashes(tokens: np.ndarray, lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k tokens that stay inside one document, and the document of each.

    tokens: the hashed words of all documents on end; lengths: words per document.
    """
    n = len(tokens) - k + 1
    if n <= 0:
        return np.empty(0, U64), np.empty(0, np.int64)
    h = np.zeros(n, U64)
    for i, c in enumerate(odd_constants(k, 77)):
        h += mix(tokens[i : i + n] + U64(i)) * c
    doc = np.repeat(np.arange(len(lengths)), lengths)
    inside = doc[:n] == doc[k - 1 :]
    return mix(h[inside]), doc[:n][inside]


def run_sets(tokens: np.ndarray, lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document the sorted distinct run hashes: all values on end, their documents, and counts per document."""
    h, doc = run_hashes(tokens, lengths, k)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if len(h):
        keep = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
        h, doc = h[keep], doc[keep]
    return h, doc, np.bincount(doc, minlength=len(lengths))
