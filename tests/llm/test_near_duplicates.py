import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import near_duplicates as N
from orrery.llm import spans as P
from orrery.llm.words import f1_words


def shingles(t, k):
    w = f1_words(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def corpus(rng, n=160):
    vocab = [f"{a}{b}" for a in "bcdfg" for b in ("ar", "el", "in", "ot", "um", "yx")]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            w = f1_words(rng.choice(rows)[1])
            for _ in range(rng.randrange(0, 4)):
                a = rng.randrange(len(w))
                w[a : a + rng.randrange(2)] = [rng.choice(vocab) for _ in range(rng.randrange(2))]
        else:
            w = [rng.choice(vocab) for _ in range(rng.randrange(12, 50))]
        rows.append((f"r{i:03d}", " ".join(w)))
    return rows


@pytest.mark.parametrize("mode", ["usual", "poor", "hot"])
def test_pairs_against_brute_force(spark, monkeypatch, mode):
    if mode == "poor":  # every run counts as common: full bands alone
        monkeypatch.setattr(N, "COMMON_ABOVE", -1)
    if mode == "hot":
        monkeypatch.setattr(N, "HOT_BUCKET", 2)
    rng = random.Random(11)
    rows = corpus(rng)
    rows += rows[:5] + [("c1", rows[0][1]), ("c2", rows[0][1].upper()), ("n", None), ("e", ""), ("s", "too short"), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "cls string, text string").repartition(3)
    members, links = N.near_duplicates(df, "cls", "text", k=3, threshold=0.5, min_words=12)
    got = {tuple(r) for r in N.similar_pairs(members, links).collect()}
    sets = {i: shingles(t, 3) for i, t in rows if i and t and len(f1_words(t)) >= 12}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    assert not got - want
    assert len(got & want) >= 0.99 * len(want) and ("c1", "c2") in got
    assert {r["rid"] for r in members.collect()} == set(sets)


def test_empty_tables_and_long_texts(spark):
    df = spark.createDataFrame([], "id string, t string")
    members, links = N.near_duplicates(df, "id", "t")
    assert members.count() == 0 and links.count() == 0
    long = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}" for i in range(60000))
    df = spark.createDataFrame([("a", long), ("b", long + " more"), ("c", "x")], "id string, t string")
    members, links = N.near_duplicates(df, "id", "t")
    assert {(r["rep_a"], r["rep_b"]) for r in links.collect()} == {("a", "b")} and members.count() == 2


def test_components(spark):
    rng = random.Random(1)
    edges = [(f"n{a:03d}", f"n{a + 1:03d}") for a in range(60)] + [(f"m{rng.randrange(40):02d}", f"m{rng.randrange(40):02d}") for _ in range(30)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r["node"]: r["root"] for r in N.components(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    assert got == {x: find(x) for x in {n for e in edges if e[0] != e[1] for n in e}}


def brute_spans(docs, m):
    where = {}
    for i, t in docs:
        for p in range(len(t or "") - m + 1):
            where.setdefault(t[p : p + m], set()).add(i)
    pairs = {p for s in where.values() for p in itertools.combinations(sorted(s), 2)}
    cover = {}
    for i, t in docs:
        c = set()
        for p in range(len(t or "") - m + 1):
            if len(where[t[p : p + m]]) > 1:
                c.update(range(p, p + m))
        cover[i] = len(c)
    return pairs, cover


@pytest.mark.parametrize("hot", [2, 20000])
def test_spans_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(P, "HOT_BLOCKS", hot)
    monkeypatch.setattr(P, "SEGMENT", 700)
    rng = random.Random(9)
    m = 40
    text = lambda n: "".join(rng.choice("abcdé 🚀\n") for _ in range(n))
    docs = [(f"d{i:02d}", text(rng.randrange(0, 300))) for i in range(40)]
    for i in range(40, 90):
        src = rng.choice(docs)[1]
        a = rng.randrange(0, max(1, len(src)))
        docs.append((f"d{i:02d}", text(rng.randrange(60)) + src[a : a + rng.choice([38, 39, 40, 41, 60, 200])] + text(rng.randrange(60))))
    docs += [("e1", ""), ("p1", "ab" * 60), ("p2", "x" + "ab" * 40), ("q1", "z" * 90), ("q2", "z" * 41), ("big", text(1500) + docs[0][1] + text(900))]
    pairs, cover = brute_spans(docs, m)
    copies = [("c1", docs[0][1]), ("c2", docs[0][1])]
    df = spark.createDataFrame(docs + [("null", None), (None, "x")] + copies[:0], "doc string, cls string").repartition(4)
    classes, got_pairs, spans = P.shared_spans(df, "doc", "cls", m)
    name = {r["cls"]: r["doc"] for r in classes.collect()}
    assert {tuple(sorted((name[r["cls_a"]], name[r["cls_b"]]))) for r in got_pairs.collect()} == pairs
    got = {}
    for r in P.merged_spans(spans).collect():
        got[name[r["cls"]]] = got.get(name[r["cls"]], 0) + r["to_"] - r["from_"]
    assert {i: got.get(i, 0) for i, _ in docs} == cover


def test_spans_of_an_empty_table(spark):
    classes, pairs, spans = P.shared_spans(spark.createDataFrame([], "d string, t string"), "d", "t")
    assert classes.count() == pairs.count() == spans.count() == 0
    assert F is not None


def test_a_shared_footer_costs_a_row_a_block(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefgh \n") for _ in range(n))
    footer = text(400)
    rows = {}
    for n in (100, 400):
        df = spark.createDataFrame([(f"d{i:04d}", text(700) + footer + text(rng.randrange(700))) for i in range(n)], "d string, t string")
        classes, links, spans = P.linked_spans(df, "d", "t")
        assert classes.count() == n and links.select("cls").distinct().count() == n
        rows[n] = links.count() + spans.count()
        assert P.linked_pairs(links, "cls").count() == n * (n - 1) // 2
    assert rows[400] <= 6 * rows[100]  # chance neighbours of the footer add a logarithm; pairs would be 16


@pytest.mark.parametrize("seed", range(4))
def test_parse_finds_the_longest_factors_and_all_links(seed):
    rng = random.Random(seed)
    m, k = 12, 6
    blocks, group, place, cls = [], [], [], []
    for g in range(30):
        anchor = "".join(rng.choice("ab") for _ in range(k))
        pool = ["".join(rng.choice("ab") for _ in range(6)) for _ in range(3)]
        for _ in range(rng.randrange(1, 7)):
            left, right = rng.choice(pool)[rng.randrange(7) :], rng.choice(pool)[: rng.randrange(7)]
            blocks.append(left + anchor + right)
            group.append(g)
            place.append(len(left))
            cls.append(rng.randrange(5))
    arr = lambda x: np.array(x, np.int64)
    (b, f, t), (x, name) = P._parse(arr(group), blocks, arr(place), arr(cls), arr(cls), arr(range(len(blocks))), m)
    want_cover, want_pairs = {}, set()
    for i, j in itertools.permutations(range(len(blocks)), 2):
        if group[i] == group[j] and cls[i] != cls[j]:
            lo = 0
            while lo < min(place[i], place[j]) and blocks[i][place[i] - lo - 1] == blocks[j][place[j] - lo - 1]:
                lo += 1
            hi = 0
            while hi < min(len(blocks[i]) - place[i], len(blocks[j]) - place[j]) and blocks[i][place[i] + hi] == blocks[j][place[j] + hi]:
                hi += 1
            lo = min(lo, m - k)
            if lo + hi >= m:
                want_cover.setdefault(i, set()).update(range(place[i] - lo, place[i] + hi))
                want_pairs.add((min(i, j), max(i, j)))
    cover = {}
    for i, lo, hi in zip(b.tolist(), f.tolist(), t.tolist()):
        assert hi - lo >= m
        cover.setdefault(i, set()).update(range(lo, hi))
    assert cover == want_cover
    members = {}
    for i, n in zip(x.tolist(), name.tolist()):
        members.setdefault(n, set()).add(i)
    assert {p for s in members.values() for p in itertools.combinations(sorted(s), 2) if cls[p[0]] != cls[p[1]]} == want_pairs


@pytest.mark.parametrize("hot", [2, 4096])
def test_the_exact_mode_misses_nothing(spark, monkeypatch, hot):
    monkeypatch.setattr(N, "HOT_BUCKET", hot)
    monkeypatch.setattr(N, "COMMON_ABOVE", 3)
    rng = random.Random(21)
    rows = corpus(rng)
    df = spark.createDataFrame(rows + [("n", None), ("e", "")], "id string, text string").repartition(3)
    members, links = N.near_duplicates(df, "id", "text", k=3, threshold=0.5, min_words=12, exact=True)
    sets = {i: shingles(t, 3) for i, t in rows if len(f1_words(t)) >= 12}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    assert {tuple(r) for r in N.similar_pairs(members, links).collect()} == want


def test_prefixes_share_a_run():
    rng = random.Random(2)
    for _ in range(400):
        a = set(rng.sample(range(60), rng.randrange(1, 30)))
        b = set(rng.sample(sorted(a), rng.randrange(len(a) + 1))) | set(rng.sample(range(60), rng.randrange(1, 12)))
        for t in (0.5, 0.8):
            if len(a & b) >= t * len(a | b):
                p, q = (sorted(s)[: N.prefix_sizes(np.array([len(s)]), t)[0]] for s in (a, b))
                assert set(p) & set(q)


def test_poor_sets_are_paired_in_rounds_of_bounded_bytes(spark, monkeypatch):
    monkeypatch.setattr(N, "COMMON_ABOVE", -1)  # as in a large collection: every run counts as common
    rng = random.Random(5)
    words = [a + b + c for a in "bcdfgklm" for b in "aeiou" for c in "nrstlxyz"]
    n = 3000
    texts = [" ".join(rng.choice(words) for _ in range(16)) for _ in range(n)]
    df = spark.createDataFrame([(f"r{i:05d}", t) for i, t in enumerate(texts)] + [("twin", texts[7] + " more")], "id string, text string").repartition(3)
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    stages = lambda: {s.stageId(): s.shuffleWriteBytes() for i in [store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())] for s in (i.apply(j) for j in range(i.size()))}
    before = set(stages())
    members, links = N.near_duplicates(df, "id", "text", k=3, threshold=0.5, min_words=12)
    assert [tuple(r)[:2] for r in links.collect()] == [("r00007", "twin")] and members.count() == n + 1
    # an entry of every band at once would be 46 x 28 bytes a set
    assert max(b for s, b in stages().items() if s not in before) < 600 * n
