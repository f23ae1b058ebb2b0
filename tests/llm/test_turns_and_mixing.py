import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import mixing as M
from orrery.llm import turns as T

SPEAKERS = "record_type string, speaker_code string, category string, description string, added_at timestamp_ntz, removed_at timestamp_ntz"
UTTERANCES = "source_id string, utterance_id string, mission_time string, speaker_code string, text string, clean string, num int"


@pytest.mark.parametrize("text,want", [("07:02:16:47", ((7 * 24 + 2) * 60 + 16) * 60 + 47), ("169:45:10", (169 * 60 + 45) * 60 + 10), ("O7 02 l6 4I", ((7 * 24 + 2) * 60 + 16) * 60 + 41), ("GET 07:01:45:10", ((7 * 24 + 1) * 60 + 45) * 60 + 10), ("T+1.2.3.4", ((24 + 2) * 60 + 3) * 60 + 4), ("01:24:00:00", None), ("1:60:00", None), ("NO TIME", None), ("--:--:--:--", None), ("", None), (None, None), ("1:2", None)])
def test_times(text, want):
    assert T.speech_seconds(text) == want


@pytest.mark.parametrize("text,want", [(None, ""), ("", ""), ("Uhhhh... ERM", ""), ("- [long pause] - ...", ""), ("((tone for 12 seconds))", ""), ("<<laughs>> *static, 3 sec*", ""), ("169:45:10 (Music playing)", ""), ("00:59:36,941 --> 00:59:40,217 <beep>", ""), ("T+57:36:35 {tone}", ""), ("06 22 19 03 (GARBLE)", ""), ("Okay.", "Okay."), ("er Ys.", "Ys."), ("CAP: Yes, uh, go.", "Yes, go."), ("[01:23:20] Roger, we'll do that.", "Roger, we'll do that."), ("Tank 12", "Tank 12")])
def test_spoken_part(text, want):
    assert T.spoken_part(text) == want


def plain_turns(rows, desc):
    import re

    def code(label):
        if label is None:
            return None
        x = re.sub(r"\([^()]*\)|\[[^\[\]]*\]", "", label)
        x = re.sub(r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "", x).upper()
        return desc.get(x, x) or None

    out = set()
    for src in {r[0] for r in rows}:
        own = sorted({(int(r[1].rsplit("-", 1)[1]), r[1], T.speech_seconds(r[2]), code(r[3]), bool(T.spoken_part(r[4]))) for r in rows if r[0] == src})
        last, timed = -1, []
        for n, uid, s, c, spoken in own:
            last = s if s is not None else last
            timed.append((last, n, uid, c, spoken))
        prev, cur = "", None
        for _, _, uid, c, spoken in sorted(timed, key=lambda x: (x[0], x[1])):
            if not spoken:
                continue
            prev = c if c is not None else prev
            if cur and cur[2] == prev:
                cur[1] = uid
            else:
                out |= {tuple(cur)} if cur else set()
                cur = [uid, uid, prev]
        out |= {tuple(cur)} if cur else set()
    return out


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_turns_against_a_plain_loop(spark, parts, monkeypatch):
    monkeypatch.setattr(T, "NUMBER_BLOCK", 7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rng = random.Random(parts)
        rows = []
        for src, n in (("hot", 300), ("a", 20), ("b", 3), ("c", 1)):
            for i in range(1, n + 1):
                t = rng.choice([f"00:00:{i // 60:02d}:{i % 60:02d}"] * 6 + ["--", None, f"00:00:00:{rng.randrange(60):02d}"])
                who = rng.choice(["CAP", "CAP", " cap.", "Commander", "PLT (EVA)", None, None, "?"])
                rows.append((src, f"{src}-{i:06d}", t, who, rng.choice(["Go ahead.", "Yes.", "uh", "(static)", None, "Okay um."]), "x", 1))
        rows += [("blank", f"blank-{i:06d}", None, None, "Yes.", None, None) for i in range(4)]
        df = spark.createDataFrame(rows + rows[:50], UTTERANCES).repartition(4)
        sp = spark.createDataFrame([("S", "COM", "crew", "Commander", None, None), ("S", "COM", "crew", "Commander", None, None), ("S", None, None, None, None, None)], SPEAKERS)
        rec = T.ordered_records(df, sp, True)
        got = T.speaker_turns(rec).collect()
        assert {(r["first_id"], r["last_id"], r["code"]) for r in got} == plain_turns(rows, {"COMMANDER": "COM"})
        assert sum(r["n"] for r in got) == sum(bool(T.spoken_part(r[4])) for r in rows)
        model = T.fit_model(rec)
        inferred = T.speaker_turns(rec, model).collect()
        assert sum(r["n"] for r in inferred) == sum(r["n"] for r in got) and {r["code"] for r in inferred} <= set(model.codes)
        assert T.speaker_turns(T.ordered_records(df.limit(0), sp, True)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_model_tells_speakers_by_their_words(spark):
    rng = random.Random(0)
    own = {"AAA": ["orbit", "burn", "vector"], "BBB": ["medic", "pulse", "sleep"]}
    rows, truth = [], {}
    for i in range(1, 601):
        who = rng.choice(list(own))
        uid = f"s-{i:06d}"
        hidden = rng.random() < 0.2
        truth[uid] = who if hidden else None
        rows.append(("s", uid, f"{i // 3600}:{i // 60 % 60}:{i % 60}", None if hidden else who, " ".join(rng.choice(own[who]) for _ in range(6)), None, None))
    df = spark.createDataFrame(rows, UTTERANCES)
    sp = spark.createDataFrame([], SPEAKERS)
    rec = T.ordered_records(df, sp, True)
    rec_ids = {r["uid"]: r for r in rec.collect()}
    found = {}
    for t in T.speaker_turns(rec, T.fit_model(rec)).collect():
        a, b = int(t["first_id"][2:]), int(t["last_id"][2:])
        found |= {f"s-{i:06d}": t["code"] for i in range(a, b + 1)}
    held = [u for u, w in truth.items() if w]
    assert len(rec_ids) == 600 and sum(found[u] == truth[u] for u in held) >= 0.95 * len(held)


def test_rare_speakers_are_states_too(spark):
    names = [f"S{i:03d}" for i in range(130)]
    rows = []
    for i, who in enumerate(names):
        for who in [who] * (3 if i < 120 else 2) + [None, who]:
            rows.append(("s", f"s-{len(rows) + 1:06d}", None, who, f"word{chr(97 + i % 26)}{chr(97 + i // 26)} " * 6, None, None))
    rec = T.ordered_records(spark.createDataFrame(rows, UTTERANCES), spark.createDataFrame([], SPEAKERS), True)
    model = T.fit_model(rec)
    assert {(t["code"], t["n"]) for t in T.speaker_turns(rec, model).collect()} == {(w, 5 if i < 120 else 4) for i, w in enumerate(names)}
    # the same as with all counts written out
    k = len(names)
    words, trans = np.full((k, 1 << T.PROFILE_BITS), 0.5), np.full((k, k), 0.1)
    np.add.at(words, (model.words[1], model.words[0]), model.words[2])
    np.add.at(trans, (model.trans[0], model.trans[1]), model.trans[2])
    words, trans = np.log(words / words.sum(axis=1, keepdims=True)), np.log(trans / trans.sum(axis=1, keepdims=True))
    slots = (model.hasher(T.f1_words("wordaa wordaa none")) >> np.uint64(64 - T.PROFILE_BITS)).astype(np.int64)
    assert np.allclose(model.emission("wordaa wordaa none"), words[:, slots].sum(axis=1))
    score = np.random.default_rng(1).normal(size=k)
    best, before = model._step(score)
    assert np.allclose(best, (score[:, None] + trans).max(axis=0)) and (before == (score[:, None] + trans).argmax(axis=0)).all()


def test_min_cost_flow():
    arcs = [("s", "a", 5, 0), ("s", "a", 5, 1), ("s", "b", 4, 0), ("a", "x", 10, 0), ("b", "x", 4, 0), ("b", "y", 4, 0), ("x", "t", 8, 0), ("y", "t", 3, 0)]
    flow = M.min_cost_flow(arcs, "s", "t")
    assert sum(flow[6:]) == 11 and flow[0] == 5 and flow[7] == 3 and flow[1] == 2


DOCS = "doc string, text string, src string, tokens int"
TARGETS = "source string, target_share double, max_repeats int"


def test_mix(spark):
    rng = random.Random(3)
    docs = [(f"a{i:03d}", f"alpha {i} " + "word " * rng.randrange(5, 30), "A", 1) for i in range(300)]
    docs += [(f"b{i:03d}", f"beta {i} " + "word " * rng.randrange(5, 30), "B", 1) for i in range(20)]
    docs += [(f"c{i:03d}", f"alpha {i} shared " * 5, s, 1) for i, s in enumerate(["A", "B"] * 10)]
    docs += [("x1", docs[-1][1], "A", 1), ("n1", None, "A", 1), ("n2", "lost", None, 1), ("n3", "not listed", "Z", 1), ("e1", "", "B", 1)]
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    goals = spark.createDataFrame([("A", 0.7, 1), ("B", 0.25, 3), ("none", 0.05, 2)], TARGETS)
    total = 4000
    selected, report = M.mix_sources(df, "doc", "text", "src", goals, total)
    rows = {r["source"]: r for r in report.collect()}
    taken = selected.collect()
    cap = {"A": 1, "B": 3}
    text = {d: t for d, t, _, _ in docs}
    per_text = {}
    for r in taken:
        assert 1 <= r["uses"] <= cap[r["source"]]
        per_text.setdefault((text[r["doc"]], r["source"]), []).append(r["uses"])
    assert all(len(v) == 1 for v in per_text.values())
    largest = max(r["tokens"] for r in taken)
    for s in "AB":
        assert abs(rows[s]["actual_tokens"] - rows[s]["quota_tokens"]) <= 2 * largest and rows[s]["reached"]
    assert rows["none"]["actual_tokens"] == 0 and not rows["none"]["reached"]
    again = M.mix_sources(df.repartition(7), "doc", "text", "src", goals, total)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, taken))
    # a source that is too small stops at its cap
    selected, report = M.mix_sources(df, "doc", "text", "src", goals, 100000)
    assert {r["source"]: r["reached"] for r in report.collect()} == {"A": False, "B": False, "none": False}
    assert selected.where("source = 'B'").agg(F.max("uses")).first()[0] == 3
    empty, report = M.mix_sources(df.limit(0), "doc", "text", "src", goals)
    assert empty.count() == 0 and report.count() == 3


def test_only_known_labels_are_cut_off(spark):
    rows = [("s", f"s-{i:03d}", None, who, text, None, None) for i, (who, text) in enumerate([("CAP", "OK - go ahead"), ("CAP", "NO - say again"), ("NAV", "CAP: right"), ("GR18", "GR18 - yes"), (None, "NAV - on"), ("COM", "CAPX: left")])]
    sp = spark.createDataFrame([("S", "CAP", "c", "Captain", None, None), ("S", "NAV", "c", None, None, None)], SPEAKERS)
    got = {r["uid"]: r["clean"] for r in T.ordered_records(spark.createDataFrame(rows, UTTERANCES), sp, True).collect()}
    assert [got[f"s-{i:03d}"] for i in range(6)] == ["OK - go ahead", "NO - say again", "right", "yes", "on", "CAPX: left"]


def test_long_blank_runs_decode_the_same_in_stretches(monkeypatch):
    rng = np.random.default_rng(5)
    codes = list("ABCD")
    flat = np.array([(s, c, n) for (s, c), n in sorted({(int(s), int(c)): int(n) for s, c, n in zip(rng.integers(0, 4096, 400), rng.integers(0, 4, 400), rng.integers(1, 9, 400))}.items())]).T
    trans = np.array([(a, b, int(n)) for (a, b), n in zip([(a, b) for a in range(4) for b in range(4)], rng.integers(1, 30, 16))]).T
    model = T.Model(codes, tuple(flat), tuple(trans), np.array([4.0, 3, 2, 1]))
    texts = [" ".join(rng.choice(["go", "stop", "roger", "water", "moon", "tank"], 3)) for _ in range(40)]
    whole = model.decode(texts, "A", "C")
    for stretch in (1, 3, 39, 40):
        monkeypatch.setattr(T.Chain, "STRETCH", stretch)
        assert model.decode(texts, "A", "C") == whole
    assert T.Carried().decode([None] * 600, "A", "B") == ["A"] * 600 and T.Carried().decode(["x"], None, "B") == [None]


def test_times_are_carried_over_blocks_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(T, "NUMBER_BLOCK", 2)
    rows = [("s", f"s-{i:03d}", "00:00:00:05" if i == 1 else "00:00:01:00" if i == 40 else None, "A", "word", None, None) for i in range(64)]
    got = {r["uid"]: r["secs"] for r in T.ordered_records(spark.createDataFrame(rows, UTTERANCES), spark.createDataFrame([], SPEAKERS), False).collect()}
    assert [got[f"s-{i:03d}"] for i in range(64)] == [-1 if i < 1 else 5 if i < 40 else 60 for i in range(64)]


def test_a_turn_over_many_partitions_keeps_its_text_in_order(spark):
    rows = [("s", f"s-{i:04d}", None, "A" if i % 300 == 0 else None, f"w{i:04d}", None, None) for i in range(300)]
    turns = T.speaker_turns(T.ordered_records(spark.createDataFrame(rows, UTTERANCES), spark.createDataFrame([], SPEAKERS), True)).collect()
    assert [(t["first_id"], t["last_id"], t["n"], t["text"]) for t in turns] == [("s-0000", "s-0299", 300, " ".join(f"w{i:04d}" for i in range(300)))]


def plain_min_cost_flow(arcs, start, end):
    """(flow, cost) by one cheapest path at a time."""
    left = {}
    for u, v, cap, cost in arcs:
        left.setdefault((u, v, cost), 0)
        left[u, v, cost] += cap
        left.setdefault((v, u, -cost), 0)
    flow = total = 0
    while True:
        dist, via = {start: 0}, {}
        for _ in range(60):
            for (u, v, c), cap in left.items():
                if cap > 0 and u in dist and dist[u] + c < dist.get(v, 10**9):
                    dist[v], via[v] = dist[u] + c, (u, v, c)
        if end not in dist:
            return flow, total
        path, at = [], end
        while at != start:
            path.append(via[at])
            at = via[at][0]
        push = min(left[p] for p in path)
        for u, v, c in path:
            left[u, v, c] -= push
            left[v, u, -c] += push
        flow, total = flow + push, total + push * dist[end]


@pytest.mark.parametrize("seed", range(12))
def test_flow_is_greatest_and_cheapest(seed):
    rng = random.Random(seed)
    sources = list("abcd")
    patterns = {tuple(sorted(rng.sample(sources, rng.randrange(1, 5)))): rng.randrange(1, 40) for _ in range(9)}
    quotas, repeats = {s: rng.randrange(0, 90) for s in sources}, {s: rng.randrange(1, 4) for s in sources}
    arcs = [("s", f"p{i}", t, r) for i, (p, t) in enumerate(patterns.items()) for r in range(max(repeats[x] for x in p))]
    arcs += [(f"p{i}", x, t * repeats[x], 0) for i, (p, t) in enumerate(patterns.items()) for x in p] + [(x, "t", q, 0) for x, q in quotas.items()]
    flow = M.min_cost_flow(arcs, "s", "t")
    assert all(0 <= f <= a[2] for f, a in zip(flow, arcs))
    for node in {a[1] for a in arcs} - {"t"}:
        assert sum(f for f, a in zip(flow, arcs) if a[1] == node) == sum(f for f, a in zip(flow, arcs) if a[0] == node)
    got = sum(f for f, a in zip(flow, arcs) if a[1] == "t"), sum(f * a[3] for f, a in zip(flow, arcs))
    assert got == plain_min_cost_flow(arcs, "s", "t")


def test_flow_of_many_patterns_ends_soon():
    rng = random.Random(1)
    sources = [f"s{i}" for i in range(16)]
    patterns = {tuple(sorted(rng.sample(sources, rng.randrange(1, 9)))): rng.randrange(1, 1000) for _ in range(6000)}
    total = sum(patterns.values())
    flow = M.plan(patterns, {s: total // 16 for s in sources}, {s: 1 + i % 3 for i, s in enumerate(sources)})
    assert sum(flow.values()) == total // 16 * 16


def test_p6_found_decodes_by_the_fitted_model(spark, tmp_path, monkeypatch):
    from orrery.llm import q_turns as Q

    rng = random.Random(12)
    rows = [(src, f"{src}-{i:06d}", f"0:{i // 60:02d}:{i % 60:02d}", rng.choice(["AAA", "BBB", None, None]), rng.choice(["orbit burn", "medic pulse", "uh"]), "x", 1) for src in "st" for i in range(1, 200)]
    spark.createDataFrame(rows, UTTERANCES).write.parquet(f"{tmp_path}/utterances.parquet")
    spark.createDataFrame([], SPEAKERS).write.parquet(f"{tmp_path}/speakers.parquet")
    used = []
    turns = Q.speaker_turns
    monkeypatch.setattr(Q, "speaker_turns", lambda records, *more, **how: used.append((*more, *how.values())) or turns(records, *more, **how))
    assert {tuple(r) for r in Q.p6_found(spark, str(tmp_path)).collect()} == plain_turns(rows, {})
    assert used and used[0] and set(used[0][0].codes) == {"AAA", "BBB"} and len(used[0][0].words[0]) and len(used[0][0].trans[0])
    # the best of all paths that never change the speaker, by the model's own scores
    m = used[0][0]
    chain = T.Kept(m.codes, m.words, m.trans, m.start)
    texts = ["orbit burn", "medic pulse", "none"]
    for left, right in itertools.product(["AAA", "BBB"], ["AAA", "BBB", None]):
        assert chain.decode(texts, left, right) == [left] * 3 and np.isfinite(chain.enter(left)[1]).sum() == 1
    assert chain.decode(texts, None, "AAA") == [None] * 3 and chain.decode(texts, "", "AAA") == [""] * 3
