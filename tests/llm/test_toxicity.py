import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from folioguard.llm.toxicity import DISGUISED, EDGE, OTHER, STATES, Channel, _restored, classify_toxicity, language_model, op7_toxicity, restore_texts, suspects

from .auc import auc
from .test_quality import brute_score

SF = "/root/testdata/sf0.1"


def test_held_out(spark):
    got = op7_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    y = [r.toxic for r in got]
    a = auc([r.score for r in got], y)
    hit = np.mean([r.predicted for r in got if r.toxic == 1])
    false = np.mean([r.predicted for r in got if r.toxic == 0])
    print("toxicity: held-out AUC", a, "recall", hit, "false alarms", false)
    assert a > 0.95 and hit > 0.9 and false < 0.02


def test_viterbi_is_the_best_path():
    cost = np.random.default_rng(3).uniform(0, 4, (STATES, STATES, STATES))
    channel = Channel(cost)
    for text in ("1d1ot", "sooo4p", "a b c", "x|!y", "$$$a", "aaab5bbbb"):
        def price(path):
            total, p, q, s = 0.0, EDGE, EDGE, ""
            for own in [*path, ("\n", 0.0)]:
                total += own[1]
                for ch in own[0]:
                    k = OTHER if ch in "0134567899@$!|+8" else EDGE if not ch.isalpha() else ord(ch) - 96
                    total += cost[p, q, k]
                    p, q = q, k
                s += own[0]
            return total, s[:-1]
        assert channel.decode(text) == min(price(p) for p in itertools.product(*channel.readings(text)))[1]


def test_restored(spark):
    plain = "the idiot and the loser said the stupid thing is worthless trash to an idiot loser " * 40
    docs = spark.createDataFrame([(1, plain), (2, "the 1d10t and l0ser"), (3, "you i d i o t man"), (4, "stuuuupid trrrash"), (5, None), (6, "in 2024 I paid 15 $ at 7pm!!")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in restore_texts(docs).collect()}
    assert got[1] == plain and got[2] == "the idiot and loser" and got[3] == "you idiot man" and got[4] == "stupid trash" and got[5] is None
    assert "2024" in got[6]


def test_disguised_words_count(spark):
    rows = [(i, ("the thing said an idiot and " if i % 2 else "the thing said an area and ") + f"word{i % 5} " * 30, i % 2) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, "the thing said an 1d10t and word"), (1001, "the thing said an i d i o t and"), (1002, "the thing said an area and word"), (1003, None), (1004, "x" * 400_000), (None, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(None, 1, 0), (1003, None, 0)], "doc_id long, toxic int, score int")
    got = {r.doc_id: r.predicted for r in classify_toxicity(docs, labels).collect()}
    assert got[1000] == got[1001] == 1 and got[1002] == got[1003] == got[1004] == got[None] == 0
    assert {r.score for r in classify_toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert classify_toxicity(docs.limit(0), labels).collect() == []


def test_suspects_miss_none():
    texts = ["plain words", "1diot", "a.b.c", "loool", "i d", "x 1 y", "@s", "é4é", "a1b"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    channel = Channel(np.zeros((STATES, STATES, STATES)))
    changed = {i for i, t in enumerate(texts) if channel.restore(t) != t}
    assert changed <= set(suspects(data, at).tolist())


def test_parts_are_restored_as_whole_texts_are():
    """Texts of the characters that kinds of disguises turn on, at random, many to a chunk and in chunks of their own."""
    channel = Channel(np.random.default_rng(5).uniform(0, 4, (STATES, STATES, STATES)))
    r = random.Random(8)
    some = ["a", "b", "i", "d", "A", "1", "0", "@", "|", "2", " ", " ", " ", ".", "-", "\t", "\n", "\x7f", "é", "ab", "will", " the ", " i d i ", "l0l"]
    texts = ["".join(r.choice(some) for _ in range(r.choice((0, 1, 2, 5, 9, 14, 40)))) for _ in range(30_000)]
    texts += [" ".join(texts[:2_000]), "i d o", "x y z", " i d", "i d i ", "i d", "ab", "o i d", "x " * 700_000, "", ""]
    lead = "dropped"  # a slice of a batch begins behind other bytes
    data = np.frombuffer((lead + "".join(texts) + lead).encode(), np.uint8)
    at = np.cumsum([len(lead), *(len(t.encode()) for t in texts)])
    new, to = _restored(data, at, channel)
    got = [new[a:b].tobytes().decode() for a, b in itertools.pairwise(to.tolist())]
    want = [channel.restore(t) for t in texts]
    assert sum(g != t for g, t in zip(want, texts)) > 1_000
    assert [(g, w) for g, w in zip(got, want, strict=True) if g != w][:3] == []


def test_model_is_a_distribution(spark):
    cost = language_model(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    np.testing.assert_allclose(np.exp(-cost).sum(2), 1)


def test_long_spelled_runs(spark):
    plain = "the idiot and the loser said the stupid thing is worthless trash to an idiot loser "
    cost = language_model(spark.createDataFrame([(1, plain * 40)], "doc_id long, text string"))
    channel = Channel(cost)
    for n in (6, 33, 40, 64, 65, 200, 20_000):
        letters = ("idiot" * n)[:n]
        for gap in " .":
            got = channel.restore(gap.join(letters))
            assert got.replace(gap, "").replace(" ", "") == letters and got.count("idiot") == n // 5


def test_every_kind_of_disguise(spark):
    plain = "the idiot and the loser said the stupid thing, is it worthless trash? you kill a hello letter ass well! it is all an idiot loser. "
    channel = Channel(language_model(spark.createDataFrame([(1, plain * 40)], "doc_id long, text string")))
    cases = {"kil1": "kill", "idio7": "idiot", "a$$": "ass", "!diot": "idiot", "|diot": "idiot", "i d 1 o t": "idiot", "i.d.1.o.t": "idiot", "s-t-u-p-1-d": "stupid"}
    cases |= {"i  d  i  o  t": "idiot", "i,d,i,o,t": "idiot", "i - d - i - o - t": "idiot", "id.iot": "idiot", "stuupid": "stupid", "STuUPiD": "stupid", "idiot!": "idiot!", "1d10t!!": "idiot!!"}
    texts = [f"you {w} and" for w in cases] + list(cases)
    assert [channel.restore(t) for t in texts] == [f"you {w} and" for w in cases.values()] + list(cases.values())
    assert channel.restore(plain) == plain and channel.restore("Well! Hello, all 3 4 5 1 0") == "Well! Hello, all 3 4 5 1 0"
    assert re.search(DISGUISED, "lose4")
    texts += ["a", "", "a.b", "é  a  1  b", "x\ty\tz", "l1", "aA", "plain words"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    found = set(suspects(data, np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))).tolist())
    assert {i for i, t in enumerate(texts) if re.search(DISGUISED, t)} <= found


def test_mixed_disguises(spark):
    plain = "the idiot and the loser said the stupid thing is worthless trash to an idiot loser. " * 40
    channel = Channel(language_model(spark.createDataFrame([(1, plain)], "doc_id long, text string")))
    for n in (5, 40, 200):
        letters = ("idiot" * n)[: 5 * n]
        spelled = " ".join({"i": "1", "o": "0"}.get(c, c) if k % 2 else c for k, c in enumerate(letters))
        assert channel.restore(spelled).replace(" ", "") == letters
    for text in ("1 d 1 0 t", "i d 1 o t", "1.d.i.0.t", "id-iot", "1d-10t", "i-d_1*o.t", "iii d i ooo t"):
        assert channel.restore(f"you {text} and") in ("you idiot and",), text


def brute_model(texts):
    """Negative log probabilities by counting one character at a time."""
    n = np.zeros((STATES, STATES, STATES))
    joined = b"".join((t or "").encode() + b"\0" for t in texts)
    state = lambda c: c - 96 if 97 <= c <= 122 else c - 64 if 65 <= c <= 90 else OTHER if c >= 128 or 48 <= c <= 57 else EDGE
    s = [state(c) for c in joined]
    for a, b, c in zip(s, s[1:], s[2:]):
        n[a, b, c] += 1
    return n


def test_score_against_brute_force(spark):
    """Evidence, noisy-or and calibration again with sets of strings, from texts that ``restore`` gives."""
    r = random.Random(4)
    clean = ["river", "stone", "bridge", "slowly", "garden", "letter", "winter"]
    toxic = ["idiot", "1d10t", "l0ser", "s-t-u-p-i-d", "trash", "i d i o t", "stuuupid"]
    rows, y = [], {}
    for i in range(260):
        bad = r.random() < 0.4
        words = [r.choice(clean) for _ in range(r.randint(2, 25))] + [r.choice(toxic) for _ in range(r.randint(1, 3) if bad else 0)]
        r.shuffle(words)
        rows.append((i, " ".join(words)))
        if r.random() < 0.9:
            y[i] = int(bad) if r.random() < 0.95 else r.randint(0, 1)
    rows += [(1000, None), (1001, ""), (None, "an idiot"), (1002, rows[3][1]), (1003, "IDIOTIC é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # Where texts meet in a batch is no part of the model, so counts over one partition are the brute-force ones.
    docs = docs.coalesce(1)
    cost = language_model(docs)
    n = brute_model([t for _, t in rows])
    back = (n.sum(0) + 0.1) / (n.sum(0).sum(1, keepdims=True) + 0.1 * STATES)
    np.testing.assert_allclose(cost, -np.log((n + 5 * back[None]) / (n.sum(2, keepdims=True) + 5)))
    channel = Channel(cost)

    def evidence(text):
        out = set()
        for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", channel.restore(text or "").encode()):
            w = bytes(c + 32 if 65 <= c <= 90 else c for c in w)
            out |= {("word", w)} | {("start", w[:k]) for k in (4, 5, 6) if len(w) > k}
        return out

    ev = [evidence(t) for _, t in rows]
    fold = [zlib.crc32(str(d).encode()) % 5 if d is not None else 0 for d, _ in rows]
    seen, bad = Counter(), Counter()
    for (d, _), e, f in zip(rows, ev, fold):
        if d in y and f > 1:
            seen.update(e)
            bad.update(e if y[d] else ())
    low = {e: bad[e] / (k + 6) for e, k in seen.items() if k >= 3 and bad[e] / (k + 6) >= 0.3}
    raw = [round(sum(-math.log1p(-min(low[x], 0.999)) for x in e if x in low), 9) for e in ev]
    pairs = [(v, float(y[d])) for (d, _), v, f in zip(rows, raw, fold) if d in y and f == 1]
    want = dict(zip([d for d, _ in rows], brute_score(pairs, raw)))
    labels = spark.createDataFrame(list(y.items()), "doc_id long, toxic int")
    for parts in (1, 5):
        got = classify_toxicity(docs.repartition(parts) if parts > 1 else docs, labels).collect()
        assert len(got) == len(rows)
        for x in got:
            assert abs(x.score - min(1, max(0, want[x.doc_id]))) < 1e-6 and x.predicted == int(x.score >= 0.5)


def test_extra_columns_and_order(spark):
    rows = [(i, ("the idiot said " if i % 3 == 0 else "the area said ") + f"word{i % 4}", float(i), "x") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0 or i % 50 == 1), 1) for i in range(400)], "doc_id long, toxic int, predicted int")
    seen = set()
    for seed in (1, 2, 3):
        random.Random(seed).shuffle(rows)
        got = classify_toxicity(spark.createDataFrame(rows, "doc_id long, text string, score double, held_out string").repartition(seed), labels).collect()
        seen.add(tuple(sorted((x.doc_id, round(x.score, 7), x.predicted) for x in got)))
    assert len(seen) == 1
