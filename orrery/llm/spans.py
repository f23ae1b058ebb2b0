"""Long exact spans shared between documents, by relative Lempel-Ziv factors.

Reference blocks are cut around anchors: k-grams that are the least of some
window, so that every span of MIN_SPAN characters holds an anchor chosen in
the same way wherever the span stands. All documents are indexed. Anchors
seen in a single text are dropped; around each of the others a block of at
most 2 * MIN_SPAN characters is kept, which holds every span of MIN_SPAN
characters that has this anchor.

Each block is parsed greedily against all reference blocks with its anchor.
The index is sorted: the texts from the anchor on lie in order, with the
length that neighbours have in common, as in a suffix array, and so do the
texts before the anchor, read backwards. A parse goes from left to right;
from each start the longest factor is the neighbour's common length among
the blocks that agree up to the anchor. A start behind the boundary of the
factor before is tried too, and a new factor begins where the end moves on,
so that no shared span is cut by an earlier phrase. Both boundaries are
common lengths of the characters themselves.

Blocks that share a factor are a link group, a row a block: pairs are made
only by linked_pairs(). Equal texts are one class and equal blocks one
block, so copies cost a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.words import U64, mix
from orrery.runtime import at_most, hot_join, spread, stage

MIN_SPAN = 300
SEGMENT = 1_000_000
#: Blocks parsed at once, and blocks of one anchor beyond which it is spread over tasks.
CHUNK_BLOCKS = 4_096
HOT_BLOCKS = 16_384
#: Members of a link group whose pairs are made in one task.
PAIR_BLOCK = 2_048
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)


_made: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """At least the first n powers of base, mod 2**64; made anew only when longer than before."""
    if len(_made.get(base, ())) < n:
        p = np.full(n, base, U64)
        p[0] = 1
        _made[base] = np.cumprod(p)
    return _made[base]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(chars: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams of ``chars``, independent of their place."""
    n = len(chars) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    size = 1 << max(10, int(len(chars)).bit_length())
    sums = np.zeros(len(chars) + 1, U64)
    np.cumsum(mix(chars.astype(U64) + U64(1)) * _powers(_BASE, size)[: len(chars)], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * _powers(_INVERSE, size)[:n])


def _slide(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over all windows of w, by prefixes and suffixes of blocks of w."""
    n = len(x)
    pad = -n % w
    fill = x[-1:].repeat(pad)
    b = np.concatenate([x, fill]).reshape(-1, w)
    left = op.accumulate(b, axis=1).ravel()
    right = op.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(right[: n - w + 1], left[w - 1 : n])


def anchors(chars: np.ndarray, min_span: int, lengths: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the least k-gram of every window of min_span characters, ties to the right.

    With ``lengths``, chars are several texts on end; k-grams across their
    borders are never chosen. k is half of min_span.
    """
    k = min_span // 2
    w = min_span - k + 1
    h = gram_hashes(chars, k)
    if len(h) < w:
        return np.empty(0, np.int64), np.empty(0, U64)
    low = (U64(1) << U64(24)) - U64(1)
    order = (h & ~low) | (low - (np.arange(len(h), dtype=U64) & low))
    ok = np.ones(len(h), bool)
    if lengths is not None:
        for e in np.cumsum(lengths)[:-1]:
            ok[max(0, e - k + 1) : e] = False
        order[~ok] = ~U64(0)
    least = _slide(order, w, np.minimum)
    edge = np.zeros(w - 1, U64)
    chosen = _slide(np.concatenate([edge, least, edge]), w, np.maximum) == order
    at = np.flatnonzero(chosen & ok)
    return at, h[at]


def _class_of(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _anchor_rows(batches, min_span: int) -> Iterator[pa.RecordBatch]:
    """Classes (doc, cls, n) and anchors (h, cls, pos); a text of a portion that came before has its class row only."""

    def out(texts: list[tuple[int, str, int]]):
        """Anchors of (class, piece, offset) triples."""
        pieces = [code_points(t) for _, t, _ in texts]
        sizes = np.array([len(p) for p in pieces])
        at, h = anchors(np.concatenate(pieces), min_span, sizes)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        which = np.searchsorted(starts, at, side="right") - 1
        cls = np.array([c for c, _, _ in texts], np.int64)[which]
        pos = at - starts[which] + np.array([o for _, _, o in texts], np.int64)[which]
        n = len(at)
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.string()), pa.array(cls), pa.array(pos), pa.array(h.view(np.int64))], names=["doc", "cls", "n", "h"])

    for b in batches:
        ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        cls = [_class_of(t) for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(cls, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.nulls(len(ids), pa.int64())], names=["doc", "cls", "n", "h"])
        held, n = [], 0
        for c, t in {c: t for c, t in zip(cls, texts) if len(t) >= min_span}.items():
            for s in range(0, max(1, len(t) - 2 * min_span), SEGMENT):
                piece = t[s : s + SEGMENT + 2 * min_span]
                held.append((c, piece, s))
                n += len(piece)
                if n > SEGMENT:
                    yield out(held)
                    held, n = [], 0
        if held:
            yield out(held)


def _repeated(batches) -> Iterator[pa.RecordBatch]:
    """Class rows, and the anchors of more than one class, from rows ordered by anchor and class."""
    held = None

    def rows(t: pa.Table, last: bool):
        """The anchors of t that are to be kept; an anchor that may go on is held back."""
        nonlocal held
        h, cls = t.column("h").to_numpy(), t.column("cls").to_numpy()
        start = np.ones(len(h), bool)
        start[1:] = h[1:] != h[:-1]
        at = np.flatnonzero(start)
        ends = np.append(at[1:], len(h))
        keep = np.repeat(cls[at] != cls[ends - 1], ends - at)
        cut = len(h) if last else int(at[-1])
        if not last and cls[at[-1]] != cls[-1]:
            # known to be repeated: one earlier row of another class is enough to hold
            out, held = t.filter(pa.array(keep)), t.slice(at[-1], 1)
        else:
            out, held = t.slice(0, cut).filter(pa.array(keep[:cut])), t.slice(cut)
        return out

    for b in batches:
        t = pa.Table.from_batches([b])
        is_class = pc.is_null(t.column("h"))
        yield from t.filter(is_class).to_batches()
        t = t.filter(pc.invert(is_class))
        if not len(t):
            continue
        yield from rows(pa.concat_tables([held, t]) if held is not None and len(held) else t, False).to_batches()
    if held is not None and len(held):
        yield from rows(held, True).to_batches()


def _blocks(batches, min_span: int) -> Iterator[pa.RecordBatch]:
    """Blocks around the kept anchors of each class: (h, cls, block id, block, anchor's place in it, block's place)."""
    k = min_span // 2
    for b in batches:
        cols = [[] for _ in range(6)]
        for cls, text, kept in zip(b.column("cls").to_pylist(), b.column("txt").to_pylist(), b.column("kept").to_pylist()):
            for a in kept:
                p = a["n"]
                lo = max(0, p - (min_span - k))
                block = text[lo : p + min_span]
                bid = int.from_bytes(hashlib.blake2b(f"{p - lo} {block}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
                for c, v in zip(cols, (a["h"], cls, bid, block, p - lo, lo)):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64()))], names=["h", "cls", "bid", "block", "place", "lo"])


_FACTORS = "kind int, h long, bid long, grp long, from_ int, to_ int, block string, place int, c0 long, c1 long"
_FACTOR_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64())
FACTOR, LINK, HOT = 0, 1, 2


def _factor_rows(**cols) -> pa.RecordBatch:
    n = len(next(iter(cols.values())))
    names = [c.split()[0] for c in _FACTORS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(cols[c], t) if c in cols else pa.nulls(n, t) for c, t in zip(names, _FACTOR_TYPES)], names=names)


class _Sorted:
    """Texts (rows of characters, 0 behind their end) in order within their groups, and what neighbours have in common."""

    def __init__(self, chars: np.ndarray, sizes: np.ndarray, group: np.ndarray):
        rows = np.concatenate([group[:, None].astype(np.uint32) + 1, chars], axis=1)
        key = np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").ravel()
        self.order = np.argsort(key, kind="stable")
        self.rank = np.empty(len(key), np.int64)
        self.rank[self.order] = np.arange(len(key))
        rows, sizes = rows[self.order], sizes[self.order]
        same = rows[1:] == rows[:-1]
        common = np.where(same.all(axis=1), rows.shape[1], same.argmin(axis=1)) - 1
        #: common length of each text with the next in order; -1 across groups
        self.common = np.minimum(common, np.minimum(sizes[1:], sizes[:-1]))
        self.levels = [self.common]

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common length of the texts of ranks a < b: the least over the ranks between them."""
        n = np.bitwise_or(b - a, 1)
        level = np.frexp(n.astype(float))[1] - 1
        while len(self.levels) <= level.max(initial=0):
            x, w = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(x[: len(x) - w], x[w:]) if len(x) > w else x[:0])
        out = np.empty(len(a), np.int64)
        for v in np.unique(level):
            pick = level == v
            x = self.levels[v]
            out[pick] = np.minimum(x[a[pick]], x[b[pick] - (1 << v)])
        return out


def _part(flat: np.ndarray, start: np.ndarray, size: np.ndarray, step: int, width: int) -> np.ndarray:
    """Characters from ``start`` on in one direction, raised by 1; 0 behind the end."""
    at = start[:, None] + step * np.arange(width)
    return np.where(np.arange(width) < size[:, None], flat[np.clip(at, 0, len(flat) - 1)] + np.uint32(1), np.uint32(0))


def _parse(group: np.ndarray, texts: list[str], place: np.ndarray, c0: np.ndarray, c1: np.ndarray, bid: np.ndarray, min_span: int) -> tuple[tuple, tuple]:
    """Factors (block, from, to) and link rows (block, group id) of blocks whose anchors are equal within ``group``.

    c0, c1: least and greatest class that hold a block; a block of several
    classes is a factor of itself.
    """
    n, before = len(texts), min_span - min_span // 2
    flat = code_points("".join(texts))
    size = np.array([len(t) for t in texts])
    start = np.concatenate([[0], np.cumsum(size)])[:-1] + place
    right_size, left_size = np.minimum(size - place, min_span), np.minimum(place, before)
    right = _Sorted(_part(flat, start, right_size, 1, min_span), right_size, group)
    left = _Sorted(_part(flat, start - 1, left_size, -1, before), left_size, group)
    scrambled = mix(bid.view(U64))
    reached = np.full(n, -1)
    named = np.zeros(n, U64)
    factors, links = [], []
    for a in range(before, -1, -1):
        need = min_span - a
        fits = np.flatnonzero((left_size >= a) & (right_size >= need))
        if not len(fits):
            continue
        # blocks that agree in the a characters before the anchor, in the order of what follows it
        alike = np.concatenate([[0], np.cumsum(left.common < a)])[left.rank[fits]]
        x = fits[np.argsort(alike * n + right.rank[fits])]
        alike = np.concatenate([[0], np.cumsum(left.common < a)])[left.rank[x]]
        lcp = np.full(len(x) + 1, -1)
        inner = np.flatnonzero(alike[1:] == alike[:-1])
        lcp[inner + 1] = right.between(right.rank[x[inner]], right.rank[x[inner + 1]])
        at = np.flatnonzero(lcp[:-1] < need)
        many = np.minimum.reduceat(c0[x], at) != np.maximum.reduceat(c1[x], at)
        count = np.diff(np.append(at, len(x)))
        shared = np.flatnonzero(np.repeat(many, count))
        if not len(shared):
            continue
        # the longest factor from here: with a neighbour of another class, or with the block's own other class
        y = x[shared]
        reach = np.where(c0[y] != c1[y], right_size[y], need)
        for other, common in ((shared - 1, lcp[shared]), (shared + 1, lcp[shared + 1])):
            z = x[np.clip(other, 0, len(x) - 1)]
            reach = np.where((common >= need) & (np.minimum(c0[y], c0[z]) != np.maximum(c1[y], c1[z])), np.maximum(reach, common), reach)
        on = reach > reached[y]
        reached[y[on]] = reach[on]
        factors.append((y[on], place[y[on]] - a, place[y[on]] + reach[on]))
        # a group whose members are those of the start before is known
        name = mix(np.add.reduceat(scrambled[x], at) + group[x[at]].astype(U64))
        news = many & (name != named[x[at]])
        pick = np.repeat(news, count)
        links.append((x[pick], np.repeat(name, count)[pick]))
        named[x] = np.repeat(np.where(many, name, U64(0)), count)
    join = lambda parts, i, kind: np.concatenate([p[i] for p in parts]).astype(kind) if parts else np.empty(0, kind)
    return tuple(join(factors, i, np.int64) for i in range(3)), (join(links, 0, np.int64), join(links, 1, U64))


def _factors(batches, min_span: int, hot_blocks: int) -> Iterator[pa.RecordBatch]:
    """Factors and links of blocks ordered by anchor, parsed in chunks of whole anchors; anchors beyond hot_blocks are handed on."""
    held: list[tuple] = []

    def parsed(rows: list[tuple]):
        h, bid, c0, c1, place = (np.array([r[i] for r in rows], np.int64) for i in (0, 1, 2, 3, 5))
        group = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]]))
        (b, f, t), (x, g) = _parse(group, [r[4] for r in rows], place, c0, c1, bid, min_span)
        yield _factor_rows(kind=np.full(len(b), FACTOR, np.int32), h=h[b], bid=bid[b], from_=f.astype(np.int32), to_=t.astype(np.int32))
        yield _factor_rows(kind=np.full(len(x), LINK, np.int32), h=h[x], bid=bid[x], grp=mix(g + h[x].view(U64)).view(np.int64))

    def hot(rows: list[tuple]):
        yield _factor_rows(kind=np.full(len(rows), HOT, np.int32), **{c: [r[i] for r in rows] for i, c in enumerate(("h", "bid", "c0", "c1", "block", "place"))})

    passing = None  # the anchor that is being handed on
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("h", "bid", "c0", "c1", "block", "place"))):
            if passing is not None and row[0] != passing:
                yield from hot(held)
                held, passing = [], None
            if held and passing is None and row[0] != held[-1][0] and len(held) >= CHUNK_BLOCKS:
                yield from parsed(held)
                held = []
            held.append(row)
            if passing is None and len(held) > hot_blocks:
                first = next(i for i, r in enumerate(held) if r[0] == row[0])
                if len(held) - first > hot_blocks:
                    if first:
                        yield from parsed(held[:first])
                    held, passing = held[first:], row[0]
            if passing is not None and len(held) >= CHUNK_BLOCKS:
                yield from hot(held)
                held = []
    if held:
        yield from (hot(held) if passing is not None else parsed(held))


def _hot_grams(hot: DataFrame, min_span: int) -> tuple[DataFrame, DataFrame]:
    """Factors and links of anchors with too many blocks for a task: equal grams at equal places, as aggregates.

    A gram's classes and members are counted with map-side combining; grams
    of many blocks are joined by broadcast, so that none gathers in a task.
    """
    starts = F.sequence(F.lit(0), F.length("block") - min_span)
    gram = lambda s: F.struct(s.alias("s"), (s - F.col("place")).alias("r"), F.md5(F.expr("block").substr(s + 1, F.lit(min_span)).cast("binary")).alias("g"))
    grams = stage(hot.where(F.length("block") >= min_span).select("h", "bid", "c0", "c1", F.explode(F.transform(starts, gram)).alias("x")).select("h", "bid", "c0", "c1", "x.s", "x.r", "x.g"), "hot-grams")
    named = F.sum(F.xxhash64("bid").cast("decimal(20,0)")).alias("name")
    groups = stage(grams.groupBy("h", "r", "g").agg(F.min("c0").alias("lo"), F.max("c1").alias("hi"), F.count("*").alias("n"), named).where("lo <> hi"), "hot-groups")
    shared = hot_join(grams, groups.select("h", "r", "g", "n"), ["h", "r", "g"], F.col("n") > HOT_BLOCKS)
    factors = shared.select("h", "bid", F.col("s").alias("from_"), (F.col("s") + min_span).alias("to_"))
    # places with the same members are one group
    once = groups.groupBy("h", "name").agg(F.min(F.struct("r", "g", "n")).alias("x")).select("h", "x.r", "x.g", "x.n", F.xxhash64("h", "name").alias("grp"))
    return factors, hot_join(grams, once, ["h", "r", "g"], F.col("n") > HOT_BLOCKS).select("h", "bid", "grp")


def linked_spans(docs: DataFrame, doc_id: str, text: str, min_span: int = MIN_SPAN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, links, spans) of the texts that share a substring of min_span characters or more.

    classes: doc, cls, n (characters), for every document with a text.
    links: grp, cls; the classes of a group have such a substring in common,
    and every pair of classes that has one is in a group. spans: cls, from_,
    to_ (code points, not merged): what stands in another text too. Equal
    texts share one class. Null texts and ids are left out; texts shorter
    than min_span share nothing; repeats within one text don't count.
    """
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src = spread(docs.select(F.col(doc_id).cast("string").alias("doc"), F.col(text).alias("txt")).where("doc is not null and txt is not null"))
    marks = src.mapInArrow(partial(_anchor_rows, min_span=min_span), "doc string, cls long, n long, h long").repartition(n_parts, F.coalesce("h", "cls")).sortWithinPartitions("h", "cls", "n")
    marks = stage(marks.mapInArrow(_repeated, "doc string, cls long, n long, h long").withColumn("kind", F.col("doc").isNull().cast("int")), "anchors", by="kind")
    classes = marks.where("kind = 0").select("doc", "cls", "n").distinct()
    kept = marks.where("kind = 1").groupBy("cls").agg(F.collect_set(F.struct("n", "h")).alias("kept"))
    # one document of each class gives the text
    bearer = kept.join(classes.groupBy("cls").agg(F.min("doc").alias("doc")), "cls")
    blocks = stage(src.dropDuplicates(["doc"]).join(bearer, "doc").select("cls", "txt", "kept").mapInArrow(partial(_blocks, min_span=min_span), "h long, cls long, bid long, block string, place int, lo long"), "blocks")
    each = blocks.groupBy("h", "bid").agg(F.min("cls").alias("c0"), F.max("cls").alias("c1"), F.first("block").alias("block"), F.first("place").alias("place"))
    found = stage(each.repartition(n_parts, "h").sortWithinPartitions("h", "bid").mapInArrow(partial(_factors, min_span=min_span, hot_blocks=HOT_BLOCKS), _FACTORS), "factors", by="kind")
    factors = found.where(f"kind = {FACTOR}").select("h", "bid", "from_", "to_")
    links = found.where(f"kind = {LINK}").select("h", "bid", "grp")
    hot = found.where(f"kind = {HOT}").select("h", "bid", "c0", "c1", "block", "place")
    if not at_most(hot, 0):
        more_factors, more_links = _hot_grams(hot, min_span)
        factors, links = factors.unionByName(more_factors), links.unionByName(more_links)
    # a block that many classes hold is broadcast to its places
    at = blocks.select("h", "bid", "cls", "lo").distinct()
    many = blocks.groupBy("h", "bid").agg(F.count("*").alias("n")).where(F.col("n") > HOT_BLOCKS)
    factors, links = (df.join(many, ["h", "bid"], "left") if not at_most(many, 0) else df.withColumn("n", F.lit(None).cast("bigint")) for df in (factors, links))
    spans = hot_join(at, factors, ["h", "bid"], F.col("n").isNotNull()).select("cls", (F.col("lo") + F.col("from_")).alias("from_"), (F.col("lo") + F.col("to_")).alias("to_"))
    return classes, hot_join(at, links, ["h", "bid"], F.col("n").isNotNull()).select("grp", "cls").distinct(), spans


def linked_pairs(links: DataFrame, member: str) -> DataFrame:
    """(a, b), a < b: every pair of members of a group, once.

    Groups with the same members are one. A group of more than PAIR_BLOCK
    members is cut into blocks, and each pair of blocks is a key of its own.
    """
    links = stage(links.select("grp", F.col(member).alias("m")), "links")
    sizes = links.groupBy("grp").agg(F.count("*").alias("n"), F.sum(F.xxhash64("m").cast("decimal(20,0)")).alias("name")).where("n > 1")
    once = sizes.groupBy("name", "n").agg(F.min("grp").alias("grp")).select("grp", F.ceil(F.col("n") / PAIR_BLOCK).cast("int").alias("nb"))
    rows = hot_join(links, once, ["grp"], F.col("nb") > 1).withColumn("i", F.pmod(F.xxhash64("m"), F.col("nb")).cast("int"))
    across = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    one = across.where("i <= j").select("grp", "i", "j", F.col("m").alias("x"))
    two = across.where("j <= i").select("grp", F.col("j").alias("i"), F.col("i").alias("j"), F.col("m").alias("y"))
    return one.join(two, ["grp", "i", "j"]).where("i < j and x <> y or i = j and x < y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def shared_spans(docs: DataFrame, doc_id: str, text: str, min_span: int = MIN_SPAN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, pairs, spans): linked_spans() with the pairs cls_a < cls_b behind its links."""
    classes, links, spans = linked_spans(docs, doc_id, text, min_span)
    return classes, linked_pairs(links, "cls").toDF("cls_a", "cls_b"), spans


def merged_spans(spans: DataFrame) -> DataFrame:
    """Overlapping or touching spans of each class as one: cls, from_, to_."""
    w = Window.partitionBy("cls").orderBy("from_", "to_")
    before = F.max("to_").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return spans.distinct().withColumn("new", (F.col("from_") > F.coalesce(before, F.lit(-1))).cast("int")).withColumn("grp", F.sum("new").over(w)).groupBy("cls", "grp").agg(F.min("from_").alias("from_"), F.max("to_").alias("to_")).drop("grp")
