import random
import re

import numpy as np
import pytest

from folioguard.llm.components import components
from folioguard.llm.set_join import DEPTH, RECALL, THRESHOLD, jaccard_join, jaccard_rows, minhashes, op2_jaccard_join, path_keys, runs_for

SF = "/root/testdata/sf0.01"


def brute(rows, t=0.8):
    words = [tuple(w.lower() for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", x or "")) for _, x in rows]
    classes = {}
    for (d, _), w in zip(rows, words):
        if w:
            classes.setdefault(w, []).append(d)
    sets = {w: {w[i : i + 5] for i in range(max(1, len(w) - 4))} for w in classes}
    index, links, parent = {}, {w: set() for w in classes}, {w: w for w in classes}

    def find(w):
        while parent[w] != w:
            w = parent[w]
        return w

    for w, s in sets.items():
        near = set()
        for x in s:
            near.update(index.setdefault(x, []))
            index[x].append(w)
        for v in near:
            both = len(s & sets[v])
            if both >= t * (len(s) + len(sets[v]) - both) - 1e-9:
                links[w].add(v), links[v].add(w)
                parent[find(w)] = find(v)
    least = {}
    for w, ids in classes.items():
        least[find(w)] = min([least.get(find(w), 1 << 60), *ids])
    out = []
    for (d, _), w in zip(rows, words):
        out.append((d, least[find(w)], min(classes[w]), len(classes[w]), len(links[w]), sum(len(classes[v]) for v in links[w])) if w else (d, d, d, 1, 0, 0))
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    text = lambda n: [f"w{r.randint(0, 5000)}" for _ in range(n)]
    rows, base, line = [], text(120), text(12)
    for i in range(80):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = f"z{r.randint(0, 99)}"
        rows.append(" ".join(w))
    rows += [" ".join(text(30) + line + text(30)) for _ in range(60)]
    rows += [" ".join(base).upper() + "!"] * 5 + ["a b", "A, b", "a", None, "", "..."] + [" ".join(text(r.randint(1, 300))) for _ in range(60)]
    rows.append(" ".join(text(20000)))
    rows.append(rows[-1] + " tail")
    return [(i + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("bucket,depth", [(256, 3), (8, 2)])
def test_brute_force(spark, bucket, depth):
    rows = corpus(5)
    df = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, n int")
    got = sorted(map(tuple, jaccard_join(df, bucket=bucket, depth=depth, recall=0.999999).collect()))
    want = brute(rows)
    assert sum(x[4] for x in want) > 300
    assert got == want


def test_query_recall(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(map(tuple, op2_jaccard_join(spark, SF).collect()))
    want = brute(rows)
    assert [g[:1] + g[2:4] for g in got] == [w[:1] + w[2:4] for w in want]
    assert all(g[4] <= w[4] for g, w in zip(got, want))
    assert sum(g[4] for g in got) >= 0.999 * sum(w[4] for w in want) > 0


def test_cases(spark):
    rows = [(None, "one two three four five six"), (1, "x y z"), (1, "other words here"), (1, "x y z")]
    got = sorted(map(tuple, jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == [(1, 1, 1, 1, 0, 0), (1, 1, 1, 2, 0, 0), (1, 1, 1, 2, 0, 0), (None, None, None, 1, 0, 0)]
    assert jaccard_join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_rows_without_an_id_are_linked(spark):
    w = [f"w{i}" for i in range(60)]
    near = lambda *at: " ".join("z" if i in at else x for i, x in enumerate(w))
    rows = [(None, near(0)), (None, near(59)), (5, near()), (None, "a b c d e f g h i j"), (None, "a b c d e f g h i j k"), (None, "a b c d e f g h i j"), (7, near()), (7, near(0) + "!"), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, jaccard_join(df).collect()), key=str)
    linked = [(5, 5, 5, 2, 2, 3), (7, 5, 5, 2, 2, 3), (7, 5, 7, 2, 2, 3), (None, 5, 7, 2, 2, 3), (None, 5, None, 1, 2, 4)]
    alone = [(None, None, None, 2, 1, 1)] * 2 + [(None, None, None, 1, 1, 2)] + [(None, None, None, 1, 0, 0)] * 2
    assert got == sorted(linked + alone, key=str)
    kept = sorted(((r.doc_id, r.class_id, r.n_copies) for r in jaccard_rows(df).where("kept").collect()), key=str)
    assert kept[0] == (5, 5, 2) and len(kept) - 3 in (1, 2) and {k[0] for k in kept[1:]} == {None}


def test_runs():
    assert runs_for(0.8, 1, 0.99) == 3 and runs_for(0.8, 3, 0.999) == 10


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100 + r.randrange(40), 100 + r.randrange(40)) for _ in range(25)] + [(7, 7), (None, 3)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {v: v for e in edges for v in e if v is not None}
    for _ in range(100):
        for u, v in edges:
            if u is not None:
                root[u] = root[v] = min(root[u], root[v])
    assert got == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] and None not in e for e in edges)}


def test_recall_at_full_depth():
    """Pairs of sets at the threshold meet at the last depth of some run as often as RECALL asks for."""
    r, runs, pairs, missed = np.random.default_rng(8), runs_for(THRESHOLD, DEPTH, RECALL), 40_000, 0
    assert runs_for(0.5, 5, 0.999) > 64
    for _ in range(4):
        s = r.integers(0, 1 << 63, (pairs // 4, 50), dtype=np.uint64)  # 40 of 45 shared: 40 / 50
        off = np.arange(pairs // 4 + 1) * 45
        a, b = (path_keys(minhashes(np.sort(x, axis=1).ravel(), off, 128), runs, DEPTH) for x in (s[:, :45], s[:, 5:]))
        missed += int((a[:, :, -1] != b[:, :, -1]).all(1).sum())
    print("missed", missed, "of", pairs)
    assert missed <= 1.2 * (1 - RECALL) * pairs


def test_join_at_full_depth(spark):
    r = random.Random(4)
    rows = []
    for k in range(1500):  # 44 shingles each, 40 of them shared; buckets of one force the last depth
        w = [f"w{r.randrange(10**6)}" for _ in range(52)]
        rows += [(2 * k, " ".join(w[:48])), (2 * k + 1, " ".join(w[4:]))]
    got = jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), bucket=1).collect()
    want = brute(rows)
    assert sum(x[4] for x in want) == 3000
    assert sum(x.n_links for x in got) >= RECALL * 3000
