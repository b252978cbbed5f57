import numpy as np
import pytest
from pyspark.sql import functions as F

from folioguard.llm import hard_negatives as H
from folioguard.llm.hard_negatives import OP11_SQL, hard_negatives, op11_hard_negatives

from .oracle import same

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, score string, q int"


def brute(rows, every, positives=5, negatives=5):
    """Rows by hand: (vec_id, vector, label), each row once."""
    ok = {(i, tuple(v), y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    dim = max((len(v) for _, v, _ in ok), default=0)
    floored = {(i, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v) + (0,) * (dim - len(v)), y) for i, v, y in ok}
    out = []
    for a in floored:
        if a[0] % every:
            continue
        scored = [(sum(x * y for x, y in zip(a[1], b[1])), b) for b in floored if b != a]
        best = lambda some, k: sorted(some, key=lambda s: (-s[0], s[1][0]))[:k]
        for p, positive in best([s for s in scored if s[1][2] == a[2]], positives):
            band = best([s for s in scored if s[1][2] != a[2] and 80 * p <= 100 * s[0] <= 100 * p], negatives)
            out += [(a[0], positive[0], r, n[0], p, s) for r, (s, n) in enumerate(band, 1)]
    return sorted(out)


def mined(spark, rows, every, **sizes):
    df = spark.createDataFrame([(i, v, y, "x", 1) for i, v, y in rows], SCHEMA)
    return sorted(tuple(r) for r in hard_negatives(df, f"vec_id % {every} = 0", **sizes).collect())


def clustered(n, dim, groups, labels, seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, dim)) * 2
    return [(int(i), [float(x) for x in np.float32(centers[g] + rng.normal(size=dim) * 0.3)], int(y)) for i, g, y in zip(rng.permutation(n), rng.integers(0, groups, n), rng.integers(0, labels, n))]


def test_query(spark):
    assert len(same(op11_hard_negatives(spark, SF), OP11_SQL, SF)) > 100


@pytest.mark.parametrize("sizes", [{}, {"block": 8, "anchor_block": 3, "sample": 40}])
def test_clusters(spark, sizes):
    rows = clustered(240, 5, 12, 3, 4)
    assert mined(spark, rows, 10, **sizes) == brute(rows, 10)


def test_prunes(spark, monkeypatch):
    """Clusters that lie apart are not scored against each other."""
    rows = clustered(400, 6, 20, 2, 9)
    asked = []
    plain = H.score_pairs
    monkeypatch.setattr(H, "score_pairs", lambda pairs, a, c, *more: asked.append(pairs.count() / a.count() / c.count()) or plain(pairs, a, c, *more))
    assert mined(spark, rows, 10, block=16, anchor_block=4) == brute(rows, 10)
    assert len(asked) == 3 and max(asked[1:]) < 0.5, asked


def test_ties_and_nulls(spark):
    """Equal vectors tie by vec_id; broken rows take no part; short vectors are padded; repeated rows count once."""
    one, nan = [1.0, 0.5], float("nan")
    rows = [(i, one, i % 3) for i in range(60)] + [(0, one, 0), (7, one, 1), (70, [1.0], 1), (None, one, 0), (80, None, 0), (90, one, None), (100, [nan, 1.0], 0), (110, [None, 1.0], 0), (120, [float("inf"), 0.0], 1), (130, [], 2)]
    got = mined(spark, rows, 10, block=7, anchor_block=2)
    assert got == brute(rows, 10)
    assert [r[3] for r in got if r[:2] == (0, 3)] == [1, 2, 4, 5, 7]


def test_no_rows(spark):
    assert mined(spark, [], 10) == []
    assert mined(spark, [(1, [1.0], 0), (2, [1.0], 1)], 10) == []
    assert mined(spark, [(10, [1.0], 0), (2, [1.0], 1)], 10) == []


def test_negative_scores(spark):
    """A positive of negative score has no band; one of score 0 has negatives of score 0."""
    rows = [(10, [1.0, 0.0], 0), (1, [-1.0, 0.0], 0), (2, [-0.9, 0.0], 1), (20, [0.0, 1.0], 2), (3, [1.0, 0.0], 2), (4, [5.0, 0.0], 1)]
    assert mined(spark, rows, 10) == brute(rows, 10) == [(20, 3, 1, 1, 0, 0), (20, 3, 2, 2, 0, 0), (20, 3, 3, 4, 0, 0), (20, 3, 4, 10, 0, 0)]


def test_reach(spark):
    with pytest.raises(ValueError, match="64 bits"):
        mined(spark, [(10, [1e20], 0), (1, [1.0], 0)], 10)
    big = [(10, [3e6, 1.0], 0), (1, [3e6, 2.0], 0), (2, [2.9e6, 5.0], 1)]  # beyond what doubles hold exactly
    assert mined(spark, big, 10) == brute(big, 10)


def test_interval_holds():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, c = rng.normal(size=(7, 4)) * 50, rng.normal(size=(9, 4)) * 20 + 30
        center = [x.mean(axis=0) for x in (a, c)]
        radius = [np.linalg.norm(x - m, axis=1).max() for x, m in zip((a, c), center)]
        spread = np.linalg.norm(center[0]) * radius[1] + radius[0] * np.linalg.norm(center[1]) + radius[0] * radius[1]
        assert np.abs(a @ c.T - center[0] @ center[1]).max() <= spread + 1e-6


def test_tables(spark):
    """Every row lies in one block of its label, however many vectors are equal."""
    df = spark.range(500).select(F.col("id").alias("vec_id"), F.col("id").alias("key"), (F.col("id") % 2).alias("label"), F.array(F.lit(3), F.lit(4)).cast("array<long>").alias("q"), F.lit(0).alias("leaf"))
    blocks = H.block_table(df, 2, 32, "<i2").collect()
    ids = [i for b in blocks for i in np.frombuffer(b.ids, np.int64).tolist()]
    assert sorted(ids) == list(range(500)) and max(b.n for b in blocks) <= 32
    assert sorted(b.node for b in blocks) == list(range(len(blocks)))
    assert all({i % 2 for i in np.frombuffer(b.ids, np.int64).tolist()} == {b.label} for b in blocks)
