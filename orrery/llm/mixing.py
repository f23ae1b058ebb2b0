"""Mixing sources to target weights, as a min-cost flow.

Texts are the units: a text that stands in several sources can serve any of
them. Units are aggregated by membership pattern (the set of listed sources
that hold them), so the flow network has a node per pattern and per source,
whatever the number of documents: start -> pattern, an arc for every
repetition whose cost grows with it (convex); pattern -> source, as often as
the source allows; source -> end, its quota of tokens. The flow is then laid
on the units of each pattern in a seeded order.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import types
from collections import deque
from collections.abc import Iterator
from functools import partial
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators.sampling import ranked
from orrery.runtime import at_most, maybe_broadcast, spread, stage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the word pattern that belongs to the vocabulary
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Patterns and sources that the flow network on the driver may have: it is a property of the mix, not of the number of documents.
MAX_PATTERNS = 200_000
MAX_SOURCES = 10_000


def encoder(vocabulary: bytes):
    """The encoder of a rank file's content, built once in a process."""
    kept = sys.modules.setdefault("_orrery_kept", types.ModuleType("_orrery_kept"))
    name = hashlib.blake2b(vocabulary, digest_size=16).hexdigest()
    if name not in kept.__dict__:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        kept.__dict__[name] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept.__dict__[name]


def _count(batches, vocabulary) -> Iterator[pa.RecordBatch]:
    enc = encoder(vocabulary.value)
    for b in batches:
        texts = b.column("txt").to_pylist()
        digest = [int.from_bytes(hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True) for t in texts]
        yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("src"), pa.array(digest, pa.int64()), pa.array([len(enc.encode_ordinary(t)) for t in texts], pa.int64())], names=["doc", "src", "unit", "tokens"])


class Network:
    """Arcs with capacities and costs; arc e and its way back are 2e and 2e + 1."""

    def __init__(self, arcs: list[tuple[str, str, int, int]]):
        self.head, self.cap, self.cost, self.out = [], [], [], {}
        for u, v, cap, cost in arcs:
            for a, b, c, w in ((u, v, cap, cost), (v, u, 0, -cost)):
                self.out.setdefault(a, []).append(len(self.head))
                self.head.append(b)
                self.cap.append(c)
                self.cost.append(w)

    def distances(self, start: str) -> dict[str, int]:
        """The cheapest cost from start to every node that can still be reached."""
        dist, waiting, queued = {start: 0}, deque([start]), {start}
        while waiting:
            u = waiting.popleft()
            queued.discard(u)
            for e in self.out.get(u, ()):
                v, d = self.head[e], dist[u] + self.cost[e]
                if self.cap[e] > 0 and d < dist.get(v, d + 1):
                    dist[v] = d
                    if v not in queued:
                        queued.add(v)
                        waiting.append(v)
        return dist

    def saturate(self, start: str, end: str, dist: dict[str, int]) -> int:
        """Push along cheapest paths until none is left; each arc is given up once it leads nowhere."""
        left = {u: iter(es) for u, es in self.out.items()}
        total, path, on_path = 0, [], {start}
        at = start
        while True:
            if at == end:
                push = min(self.cap[e] for e in path)
                total += push
                for e in path:
                    self.cap[e] -= push
                    self.cap[e ^ 1] += push
                cut = next(i for i, e in enumerate(path) if self.cap[e] == 0)
                for e in path[cut:]:
                    on_path.discard(self.head[e])
                at = self.head[path[cut] ^ 1]
                # the arcs of the nodes given back may be used again
                for e in path[cut + 1 :]:
                    u = self.head[e ^ 1]
                    left[u] = chain([e], left[u])
                del path[cut:]
                continue
            for e in left.get(at, ()):
                v = self.head[e]
                if self.cap[e] > 0 and v not in on_path and dist.get(v) == dist[at] + self.cost[e]:
                    path.append(e)
                    on_path.add(v)
                    at = v
                    break
            else:
                if not path:
                    return total
                e = path.pop()
                on_path.discard(at)
                at = self.head[e ^ 1]


def min_cost_flow(arcs: list[tuple[str, str, int, int]], start: str, end: str) -> list[int]:
    """The flow on each arc (from, to, capacity, cost) of a cheapest maximal flow.

    Primal-dual: all cheapest paths at once, then those of the next cost;
    costs are numbers of repetitions, so the rounds are few.
    """
    net = Network(arcs)
    while end in (dist := net.distances(start)):
        net.saturate(start, end, dist)
    return [net.cap[2 * i + 1] for i in range(len(arcs))]


def plan(patterns: dict[tuple[str, ...], int], quotas: dict[str, int], repeats: dict[str, int]) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens that each pattern gives to each of its sources."""
    arcs, names = [], []
    for n, (pattern, tokens) in enumerate(sorted(patterns.items())):
        for r in range(max(repeats[s] for s in pattern)):
            arcs.append(("start", f"p{n}", tokens, r))
            names.append(None)
        for s in pattern:
            arcs.append((f"p{n}", f"s:{s}", tokens * repeats[s], 0))
            names.append((pattern, s))
    for s, q in sorted(quotas.items()):
        arcs.append((f"s:{s}", "end", q, 0))
        names.append(None)
    return {name: f for name, f in zip(names, min_cost_flow(arcs, "start", "end")) if name}


def mix_sources(docs: DataFrame, doc_id: str, text: str, source: str, targets: DataFrame, total_tokens: int | None = None, seed: int = 17, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(selected, report) for targets (source, target_share, max_repeats).

    selected: doc, source, uses, tokens (of one use): what to take, each text
    at most max_repeats times for a source. report: one row per target with
    quota, actual tokens and share, distinct documents, greatest number of
    uses, whether the quota was reached to within the largest document, and the
    documents and tokens that are copies of another document of the source
    and so were not units of their own.
    ``total_tokens`` is the size of the mix; by default all tokens of the
    listed sources, copies counted once. Documents with null text or source,
    of a source not listed, or without tokens can't serve. A share that is
    null or not positive counts as 0, a max_repeats that is null or below 1
    as 1; sources without documents are reported with 0.
    """
    src = spread(docs.select(F.col(doc_id).cast("string").alias("doc"), F.col(source).alias("src"), F.col(text).alias("txt")).where("doc is not null and txt is not null and src is not null"))
    wanted = {r[0]: (max(0.0, r[1] or 0.0), max(1, r[2] or 1)) for r in targets.select("source", "target_share", "max_repeats").where("source is not null").limit(MAX_SOURCES + 1).collect()}
    if len(wanted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    with open(tokenizer, "rb") as f:  # on the driver; the executors get its content
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    repeats = {s: r for s, (_, r) in wanted.items()}
    counted = stage(src.where(F.col("src").isin(*wanted)).mapInArrow(partial(_count, vocabulary=vocabulary), "doc string, src string, unit long, tokens long").where("tokens > 0"), "token-counts")
    bearer = counted.groupBy("unit", "src").agg(F.min("doc").alias("doc"), F.max("tokens").alias("tokens"))
    units = stage(bearer.groupBy("unit").agg(F.array_sort(F.collect_set("src")).alias("pattern"), F.max("tokens").alias("tokens")), "units")
    sums = units.groupBy("pattern").agg(F.sum("tokens").alias("t"))
    if not at_most(sums, MAX_PATTERNS):
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = {tuple(r["pattern"]): r["t"] for r in sums.collect()}
    total = total_tokens if total_tokens is not None else sum(patterns.values())
    quotas = {s: round(share * total) for s, (share, _) in wanted.items()}
    flow = plan(patterns, quotas, repeats)

    # segments of each pattern's line of uses: level r of the pattern covers [r * t, (r + 1) * t)
    rows, at = [], {}
    for (pattern, s), f in flow.items():
        if f:
            rows.append((list(pattern), patterns[pattern], s, at.get(pattern, 0), at.get(pattern, 0) + f))
            at[pattern] = at.get(pattern, 0) + f
    spark = docs.sparkSession
    segments = spark.createDataFrame(rows, "pattern array<string>, t long, src string, seg_from long, seg_to long")

    # the start of each unit on its pattern's line: running sums in the seeded order, less those of the patterns before
    placed = ranked(units.withColumn("o", F.xxhash64(F.lit(seed), "unit")), ["pattern", "o", "unit"], F.col("tokens"), "place", "c").drop("place")
    base, _ = maybe_broadcast(placed.groupBy("pattern").agg(F.min("c").alias("base")))
    starts = placed.join(base, "pattern").select("unit", "pattern", "tokens", (F.col("c") - F.col("base")).alias("c"))
    # uses of a unit for a segment: the levels r with seg_from <= r * t + c < seg_to
    levels = lambda x: F.expr(f"CASE WHEN {x} <= c THEN 0 ELSE ({x} - c + t - 1) DIV t END")
    uses = levels("seg_to") - levels("seg_from")
    taken = starts.join(maybe_broadcast(segments)[0], "pattern").withColumn("uses", uses).where("uses > 0").select("unit", F.col("src"), "uses", "tokens")
    selected = stage(taken.join(bearer.select("unit", "src", "doc"), ["unit", "src"]).select("doc", F.col("src").alias("source"), "uses", "tokens"), "selected")

    got = selected.groupBy("source").agg(F.sum(F.col("uses") * F.col("tokens")).alias("actual_tokens"), F.count("*").alias("n_documents"), F.max("uses").alias("most_uses"))
    have = counted.groupBy(F.col("src").alias("source")).agg(F.max("tokens").alias("largest"), F.count("*").alias("all_documents"), F.sum("tokens").alias("all_source_tokens"))
    once = bearer.groupBy(F.col("src").alias("source")).agg(F.count("*").alias("texts"), F.sum("tokens").alias("text_tokens"))
    goals = spark.createDataFrame([(s, share, r, quotas[s]) for s, (share, r) in wanted.items()], "source string, target_share double, max_repeats int, quota_tokens long")
    all_ = got.agg(F.sum("actual_tokens").alias("all_tokens"))
    report = (
        goals.join(got, "source", "left")
        .join(have, "source", "left")
        .join(once, "source", "left")
        .crossJoin(F.broadcast(all_))
        .select(
            "source",
            "target_share",
            "max_repeats",
            "quota_tokens",
            F.coalesce("actual_tokens", F.lit(0)).alias("actual_tokens"),
            F.coalesce(F.try_divide("actual_tokens", "all_tokens"), F.lit(0.0)).alias("actual_share"),
            F.coalesce("n_documents", F.lit(0)).alias("n_documents"),
            F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
            (F.coalesce("actual_tokens", F.lit(0)) + F.coalesce("largest", F.lit(0)) >= F.col("quota_tokens")).alias("reached"),
            F.coalesce(F.col("all_documents") - F.col("texts"), F.lit(0)).alias("copies_left_out"),
            F.coalesce(F.col("all_source_tokens") - F.col("text_tokens"), F.lit(0)).alias("copies_tokens"),
        )
    )
    return selected, report
