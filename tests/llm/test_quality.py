import itertools
import random
import re
import zlib

import numpy as np
import pytest

from folioguard.llm.quality import FEATURES, GAMMA, N_STATS, RIDGE, calibrated, classify_quality, isotonic, labelled_sample, op5_quality

from .auc import auc

SF = "/root/testdata/sf0.1"
DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int"


def test_held_out(spark):
    got = op5_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    y = [r.quality for r in got]
    a = auc([r.score for r in got], y)
    right = np.mean([r.predicted == r.quality for r in got])
    kept = np.mean([r.predicted for r in got if r.quality == 1])
    print("quality: held-out AUC", a, "accuracy", right, "kept", kept)
    assert a > 0.95 and right > 0.9 and kept > 0.97


def test_isotonic():
    x, y = isotonic(np.array([3.0, 1, 2, 4]), np.array([0.0, 0, 1, 1]))
    assert np.all(np.diff(y) > 0) and y[0] == 0 and y[-1] == 1
    np.testing.assert_allclose((x, y), ([1, 2.5, 4], [0, 0.5, 1]))


def brute_isotonic(pairs):
    """Fitted value of each distinct value: the greatest over starts of the least mean over ends."""
    values = sorted({v for v, _ in pairs})
    n = [sum(v == w for w, _ in pairs) for v in values]
    s = [sum(y for w, y in pairs if v == w) for v in values]
    return {v: max(min(sum(s[a : b + 1]) / sum(n[a : b + 1]) for b in range(i, len(values))) for a in range(i + 1)) for i, v in enumerate(values)}


def brute_score(pairs, asked):
    """Linear between the mean values of the ranges with equal fit."""
    fit = brute_isotonic(pairs)
    groups = {}
    for v, _ in pairs:
        groups.setdefault(round(fit[v], 12), []).append(v)
    x, y = zip(*sorted((sum(v) / len(v), f) for f, v in groups.items()))
    return [0.999 * np.interp(a, x, y) + 0.001 / (1 + np.exp(-4 * (a - 0.5))) for a in asked]


@pytest.mark.parametrize("seed", range(12))
def test_isotonic_with_ties(seed):
    r = random.Random(seed)
    pairs = [(r.randint(0, 6) / 7, float(r.random() < 0.4)) for _ in range(r.randint(1, 60))]
    want = brute_score(pairs, [k / 20 for k in range(-2, 23)])
    for _ in range(5):
        r.shuffle(pairs)
        knots = isotonic(*map(np.array, zip(*pairs)))
        assert np.all(np.diff(knots[0]) > 0)
        np.testing.assert_allclose(calibrated(knots, np.array([k / 20 for k in range(-2, 23)])), want, atol=1e-12)


def test_isotonic_hundred_ties():
    labels = np.zeros(100)
    labels[[3, 97]] = 1
    for order in (labels, labels[::-1], np.sort(labels)):
        assert isotonic(np.ones(100), order)[1].tolist() == [0.02]


def brute_statistics(text):
    """The statistics of one text, from its characters; the classes are those of bytes."""
    b = (text or "").encode()
    if not b:
        return [0.0] * N_STATS
    sets = [range(65, 91), range(97, 123), range(48, 58), b" \t\r", b"\n", b".,;:?", b"!", b"#$%&*@^~_+=<>", b"|", b"'\"()[]{}/\\-`"]
    kind = [next((k for k, s in enumerate(sets) if c in s), len(sets)) for c in b]
    size, out = len(b), []
    for k in range(len(sets)):
        out.append(kind.count(k) / size)
    out.append((kind.count(len(sets))) / size)
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in b)
    words = [(m.start(), m[0]) for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", low)]
    n, some = len(words), max(1, len(words))
    inside = sum(k <= 2 or c >= 128 for k, c in zip(kind, b))
    starts = [a for a, _ in words]
    gaps = [(starts[i + 1] if i + 1 < n else size + 1) - a for i, a in enumerate(starts)]
    return b, kind, size, out, words, n, some, inside, gaps


def test_score_against_brute_force(spark):
    """Features, normal equations, ridge and calibration again, one row at a time, from the statistics."""
    from folioguard.llm.common import Rolling
    from folioguard.llm.quality import statistics

    r = random.Random(3)
    good = lambda: " ".join(r.choice(["the", "river", "over", "stone", "bridge", "slowly"]) + r.choice(["", ",", "."]) for _ in range(r.randint(5, 60)))
    bad = lambda: "\n".join(r.choice(["BUY!!", "click here", "$$$ 99", "|||"]) for _ in range(r.randint(2, 30)))
    rows = [(i, good() if r.random() < 0.5 else bad()) for i in range(160)]
    rows += [(200 + i, rows[i % 5][1]) for i in range(40)]
    y = {i: int("the" in t or "river" in t) if r.random() < 0.9 else r.randint(0, 1) for i, t in rows}
    want_docs = [*rows, (900, None), (901, "")]
    stats = {}
    for i, t in want_docs:
        data = np.frombuffer((t or "").encode(), np.uint8)
        stats[i] = statistics(data, np.array([0, len(data)]), Rolling(51, 1 << 12))[0]
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i, _ in want_docs}
    learn = [i for i in y if fold[i] > 0]
    x = np.array([stats[i] for i in learn])
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    rng = np.random.default_rng(7)
    weight, phase = rng.normal(0, np.sqrt(2 * GAMMA), (N_STATS, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)

    def feature(i):
        z = [min(8, max(-8, v)) for v in (stats[i] - mean) / scale]
        return np.array([np.cos(sum(a * b for a, b in zip(z, weight[:, k])) + phase[k]) * (2 / FEATURES) ** 0.5 for k in range(FEATURES)] + [1.0])

    f = {i: feature(i) for i, _ in want_docs}
    ridge = [i for i in learn if fold[i] > 1]
    a = sum(np.outer(f[i], f[i]) for i in ridge) + RIDGE * len(ridge) / FEATURES * np.eye(FEATURES + 1)
    beta = np.linalg.solve(a, sum(f[i] * y[i] for i in ridge))
    raw = {i: round(float(f[i] @ beta), 9) for i in f}
    pairs = [(raw[i], float(y[i])) for i in learn if fold[i] == 1]
    want = dict(zip(raw, brute_score(pairs, raw.values())))
    got = classify_quality(spark.createDataFrame(want_docs, DOCS), spark.createDataFrame(list(y.items()), LABELS)).collect()
    assert len(got) == len(want)
    for row in got:
        assert abs(row.score - min(1, max(0, want[row.doc_id]))) < 1e-6 and row.held_out == (fold[row.doc_id] == 0)
        assert row.predicted == int(row.score >= 0.3)


@pytest.mark.parametrize("text", ["", "a", "Plain words, over TWO\nlines.\n", "x\n" * 30, "BUY!! $$$ || é日本 99", "--- ...\n\n\n", "same same same same\nother line\nsame same same same", "wait... what?? no--!!"])
def test_statistics_against_brute_force(text):
    from folioguard.llm.common import Rolling
    from folioguard.llm.quality import N_CLASSES, statistics

    data = np.frombuffer(("before " + text + " after").encode(), np.uint8)
    at = np.array([0, 7, 7 + len(text.encode()), len(data)])
    got = statistics(data, at, Rolling(51, 1 << 12))[1]
    if not text:
        assert not got.any()
        return
    b, kind, size, shares, words, n, some, inside, gaps = brute_statistics(text)
    np.testing.assert_allclose(got[:N_CLASSES], shares, atol=1e-12)
    counts = {}
    for _, w in words:
        counts[w] = counts.get(w, 0) + 1
    pairs = {}
    for (_, v), (_, w) in itertools.pairwise(words):
        pairs[v, w] = pairs.get((v, w), 0) + 1
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in b)
    lines = [x for x in low.split(b"\n") if len(x) > 1]
    want = {
        0: np.log(size), 1: np.log1p(n), 2: inside / some, 5: len(counts) / some, 6: max(counts.values(), default=0) / some,
        9: sum(k >= 5 and k < N_CLASSES - 1 and p == q for k, p, q in zip(kind, b, b[1:])) / some,
        3: sum(min(g, 40) for g in gaps) / some, 7: sum(g <= 3 for g in gaps) / some, 10: len(set(lines)) / max(1, len(lines)),
        12: len(pairs) / max(1, n - 1), 13: max(pairs.values(), default=0) / max(1, n - 1),
    }
    for k, v in want.items():
        assert abs(got[N_CLASSES + k] - v) < 1e-9, k


def test_cases(spark):
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate([None, "", "a", "É" * 300000, "x\n" * 50, "!!!", "a b c. " * 9] * 8)] + [(None, "q", 1), (3, "a", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, i % 7 % 2, 0) for i in range(56)] + [(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    rows = classify_quality(docs, labels).collect()
    assert len(rows) == 58 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in classify_quality(docs, none).collect()} == {0.5}
    assert classify_quality(docs.limit(0), labels).collect() == []


def test_order_of_rows(spark):
    """Scores are a function of the rows, not of their order or partitions; equal texts have equal scores."""
    r = random.Random(6)
    rows = [(i, r.choice(["a calm river, and stones", "BUY!!! $$$ now", "", "x\n" * 9, f"text {i % 7} of words"])) for i in range(300)]
    labels = spark.createDataFrame([(i, int(r.random() < (0.8 if t[:1] in "at" else 0.2))) for i, t in rows], LABELS)
    seen = []
    for parts in (1, 3, 8):
        r.shuffle(rows)
        got = {x.doc_id: x.score for x in classify_quality(spark.createDataFrame(rows, DOCS).repartition(parts), labels).collect()}
        seen.append([got[i] for i in range(300)])
        by_text = {}
        for i, t in rows:
            by_text.setdefault(t, set()).add(got[i])
        assert all(len(v) == 1 for v in by_text.values())
    for other in seen[1:]:
        np.testing.assert_allclose(seen[0], other, atol=1e-7)


def test_sample_is_bounded_however_ids_repeat(spark):
    docs = spark.createDataFrame([(i % 20, f"text {i % 3}") for i in range(2000)], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], LABELS)
    few = labelled_sample(docs, labels, "quality", 50)
    ids = sum(zlib.crc32(str(i).encode()) % 5 > 0 for i in range(20))
    assert few.count() == ids and labelled_sample(docs, labels, "quality", 5000).count() == 100 * ids
