import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import leaks, terms
from orrery.llm.words import f1_words, f2_words


def test_terms_against_a_plain_count(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(f"r{i}", " ".join(rng.choice(["Go", "don’t", "go.", "zz%d" % rng.randrange(60), "é"]) for _ in range(rng.randrange(9)))) for i in range(200)]
    rows += rows[:40] + [("n1", None), ("e1", ""), ("long", "word " * 50000)]
    df = spark.createDataFrame(rows, "rid string, body string").withColumn("term", F.lit(1)).withColumn("records", F.lit(2)).repartition(5)
    for held in (10, 10**6):
        monkeypatch.setattr(terms, "HELD_TERMS", held)
        got = {r["term"]: (r["occurrences"], r["records"], r["verdict"]) for r in terms.term_frequencies(df, "rid", "body").collect()}
        once = dict(rows)
        occ, rec = {}, {}
        for t in once.values():
            w = f1_words(t)
            for x in w:
                occ[x] = occ.get(x, 0) + 1
            for x in set(w):
                rec[x] = rec.get(x, 0) + 1
        n = sum(t is not None for t in once.values())
        assert got == {x: (occ[x], rec[x], "rare" if rec[x] < 3 else "common" if rec[x] > 0.1 * n else None) for x in occ}
    assert terms.term_frequencies(df.limit(0), "rid", "body").count() == 0


def contains(doc, item):
    d, i = f2_words(doc), f2_words(item)
    k = min(12, len(i))
    return k > 0 and any(d[a : a + k] == i[b : b + k] for a in range(len(d) - k + 1) for b in range(len(i) - k + 1))


@pytest.mark.parametrize("bound", [leaks.BROADCAST_SEEDS, 0])
def test_leaks_against_brute_force(spark, bound):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(40)] + ["Käse", "don’t", "İstanbul"]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(f"i{j}", " ".join(words(n))) for j, n in enumerate([1, 2, 5, 11, 12, 13, 20, 30, 30])] + [("same", None), ("empty", " -- "), ("twin", "w1 w2 w3 w4 w5")]
    docs = []
    for d in range(120):
        w = words(rng.randrange(0, 60))
        if rng.random() < 0.6:
            part = f2_words(rng.choice(items)[1] or "")
            a = rng.randrange(0, max(1, len(part)))
            part = part[a : a + rng.randrange(6, 31)]
            if part and rng.random() < 0.3:
                part[len(part) // 2] = "swapped"
            w[rng.randrange(0, len(w) + 1) : 0] = part
        docs.append((d, rng.choice([" ", ", ", "\n", "<b>"]).join(x.upper() if rng.random() < 0.2 and x != "İstanbul" else x for x in w)))
    docs += [(500, None), (501, ""), (502, docs[3][1]), (502, docs[3][1])]
    df = spark.createDataFrame(docs, "item long, text string").repartition(4)
    it = spark.createDataFrame(items, "doc string, text string")
    got = {(int(r["doc"]), r["item"]) for r in leaks.leaked_items(df, "item", "text", it, "doc", "text", 0, bound).collect()}
    assert got == {(d, i) for d, t in docs for i, x in items if t and x and contains(t, x)}
    assert leaks.leaked_items(df.limit(0), "item", "text", it, "doc", "text").count() == 0
    assert leaks.leaked_items(df, "item", "text", it.limit(0), "doc", "text").count() == 0


def test_leak_with_substitutions(spark):
    item = [f"k{i}" for i in range(16)]
    changed = item[:]
    changed[2] = "other"  # under a zero of a mask that begins at word 0
    docs = spark.createDataFrame([(1, " ".join(changed)), (2, " ".join(item[:11]))], "d long, t string")
    probe = spark.createDataFrame([("q", " ".join(item))], "i string, t string")
    rows = leaks.leaked_items(docs, "d", "t", probe, "i", "t", 1).collect()
    assert [(r["doc"], r["words"], r["substitutions"]) for r in rows] == [("1", 16, 1)]


@pytest.mark.parametrize("substitutions", [0, 1, 2, 3, 5])
def test_seeds_reach_every_placement(substitutions):
    seeds = [(m, [i for i, bit in enumerate(m) if bit == "1"]) for m in leaks.family(substitutions)]
    for n in range(leaks.RUN, leaks.RUN + substitutions + 3):
        for changed in map(set, combinations(range(n), min(substitutions, n - leaks.RUN))):
            assert any(changed.isdisjoint(at + i for i in ones) for m, ones in seeds for at in range(n - len(m) + 1)), changed


def stretch(doc, item, substitutions):
    """Whether RUN equal words of the item, or all of a shorter one, stand in the document with so many others between them."""
    d, i = f2_words(doc), f2_words(item)
    if not set(d) & set(i):
        return False
    for shift in range(-len(i), len(d)):
        equal = [0 <= k + shift < len(d) and d[k + shift] == w for k, w in enumerate(i)]
        for a in range(len(i)):
            run = equal[a : a + min(leaks.RUN, len(i)) + substitutions]
            if any(sum(run[:z]) >= min(leaks.RUN, len(i)) and run[:z].count(False) <= substitutions for z in range(1, len(run) + 1)):
                return True
    return False


@pytest.mark.parametrize("bound", [leaks.BROADCAST_SEEDS, 0])
@pytest.mark.parametrize("substitutions", [1, 2, 3])
def test_substitutions_at_every_place(spark, substitutions, bound):
    sizes = (5, 11, 12, 13, 14, 15, 17, 20)
    items = [(f"i{n}", " ".join(f"k{n}x{i}" for i in range(n))) for n in sizes]
    docs = []
    for (_, text), n in zip(items, sizes):
        for places in [c for s in range(min(substitutions, 2) + 1) for c in combinations(range(n), s)] + [(3, 7, 9), (2, 6, 10), (1, 2, 3)]:
            docs.append((len(docs), "a b c " + " ".join("other" if i in places else w for i, w in enumerate(text.split())) + " d e"))
    df, it = spark.createDataFrame(docs, "d long, t string"), spark.createDataFrame(items, "i string, t string")
    got = {(int(r["doc"]), r["item"]) for r in leaks.leaked_items(df, "d", "t", it, "i", "t", substitutions, bound).collect()}
    assert got == {(d, i) for d, t in docs for i, x in items if stretch(t, x, substitutions)}


@pytest.mark.parametrize("substitutions", [0, 1, 2])
def test_shuffled_path_finds_the_same(spark, substitutions):
    items = [(f"i{n}", " ".join(f"k{n}x{i}" for i in range(n))) for n in range(13, 25)]
    texts = [t.split() for _, t in items]
    docs = [w[:c] + ["other"] + w[c + 1 :] for w in texts for c in range(len(w))]
    # with words 3, 4 and 6 changed the hit at 0 doesn't tell of the run from 7 on
    docs += [["other" if i in c else x for i, x in enumerate(texts[6])] for c in combinations(range(12), 3)]
    docs += [w[4:17] for w in texts] + [w[:9] + ["x"] * 3 + w for w in texts]
    df = spark.createDataFrame([(d, " ".join(["a", "b", *w, "z", "z", "z"])) for d, w in enumerate(docs)], "d long, t string")
    it = spark.createDataFrame(items, "i string, t string")
    rows = [sorted(map(tuple, leaks.leaked_items(df, "d", "t", it, "i", "t", substitutions, bound).collect())) for bound in (leaks.BROADCAST_SEEDS, 0)]
    assert rows[0] == rows[1]
    assert {(int(d), i) for d, i, _, _ in rows[1]} == {(d, i) for d, w in enumerate(docs) for i, x in items if stretch(" ".join(w), x, substitutions)}
    assert {tuple(r[2:]) for r in rows[1] if int(r[0]) >= len(docs) - len(items)} == {(n, 0) for n in range(13, 25)}


def test_overlap_ends_with_equal_words():
    a = leaks.Hasher()([f"w{i}" for i in range(16)])
    b = leaks.Hasher()([f"w{i}" for i in range(14)] + ["x", "y"])
    assert leaks.overlap(b, a, 0, 2) == (14, 0) and leaks.overlap(b, a, 5, 2) == (0, 0)


def test_word_rules():
    assert f1_words("YOU’RE it's a-b") == ["you're", "it's", "a", "b"] and f1_words(None) == []
    assert f2_words("Don’t_STOP Ünïcode 12") == ["don’t", "stop", "ünïcode", "12"]
    assert re.fullmatch("[01]{12}", leaks.MASKS[0])


def test_last_seen_counters_keep_a_record_that_goes_on(spark):
    rng = random.Random(3)
    words, record = [], []
    for r in range(60):
        n = rng.randrange(0, 9)
        words += [rng.choice("abcdefg") for _ in range(n)]
        record += [r] * n
    seen, at = terms.LastSeen(), 0
    while at < len(words):  # cuts anywhere, also inside a record
        n = rng.randrange(0, 12)
        seen.add(words[at : at + n], np.array(record[at : at + n], np.int64))
        at += n
    got = {t: (o, n, x) for t, o, n, x in zip(*seen.rows([str(r) for r in range(60)]))}
    assert got == {t: (words.count(t), len({r for w, r in zip(words, record) if w == t}), str(max(r for w, r in zip(words, record) if w == t))) for t in set(words)}


@pytest.mark.parametrize("substitutions", [0, 1, 2])
def test_both_plans_find_the_same_with_hot_seeds(spark, monkeypatch, substitutions):
    monkeypatch.setattr(leaks, "HOT_SEED", 3)
    rng = random.Random(substitutions)
    item = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    items = [("long", item(24)), ("edge", item(15)), ("short", item(5)), ("twin", item(13))]
    docs = []
    for name, w in items * 12:
        w = list(w)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = "other"
        docs.append(" ".join(item(rng.randrange(9)) + w[rng.randrange(3) :] + item(rng.randrange(9))))
    docs += ["w0 " * 40, "", None]
    d = spark.createDataFrame(list(enumerate(docs)), "id int, t string").repartition(3)
    e = spark.createDataFrame([(n, " ".join(w)) for n, w in items], "i string, t string")
    one, two = (sorted(map(tuple, leaks.leaked_items(d, "id", "t", e, "i", "t", substitutions, bound).collect())) for bound in (10**6, 0))
    assert one == two and len(one) > 10
