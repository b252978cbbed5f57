import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioguard.llm.packing import op3_packing, optimal_bounds, pack

SF = "/root/testdata/sf0.01"


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 50), min_size=1, max_size=9), st.integers(1, 4))
def test_bounds_are_optimal(hist, k):
    lengths = sorted(hist)
    counts = [hist[n] for n in lengths]
    got = optimal_bounds(np.array(lengths), np.array(counts), k)
    assert len(got) <= k and max(got) == lengths[-1]
    best = min(padding(lengths, counts, [*c, lengths[-1]]) for r in range(k) for c in itertools.combinations(lengths[:-1], r))
    assert padding(lengths, counts, got) == best


def brute(rows, bounds_of, budget, pad_to):
    n = {i: len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")) for i, (_, t) in enumerate(rows)}
    up = {i: -(-v // pad_to) * pad_to for i, v in n.items()}
    bounds = bounds_of(sorted(up.values()))
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(min(b for b in bounds if b >= up[i]), []).append((d, n[i]))
    out = []
    for b, members in groups.items():
        size = max(1, budget // max(1, b))
        members.sort(key=lambda m: m[0])
        for p, (d, k) in enumerate(members):
            out.append((d, k, b, p // size, p % size, min(size, len(members) - p // size * size)))
    return sorted(out)


@pytest.mark.parametrize("buckets,budget", [(16, 65536), (3, 2000)])
def test_pack(spark, buckets, budget):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]

    def bounds(values):
        v, c = np.unique([x for x in values if x], return_counts=True)
        return [0, *optimal_bounds(v, c, buckets)]

    got = pack(docs, buckets, budget) if buckets != 16 else op3_packing(spark, SF)
    assert sorted(map(tuple, got.collect())) == brute(rows, bounds, budget, 8)


def test_cases(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "...", 1), (4, "a b", 1), (4, "a b", 1), (None, "a", 1), (5, "w " * 5000, 1)]
    got = {tuple(r) for r in pack(spark.createDataFrame(rows, "doc_id long, text string, batch int"), 2, 16, 1).collect()}
    assert {r[0] for r in got if r[2] == 0} == {1, 2, 3}
    assert (5, 5000, 5000, 0, 0, 1) in got
    assert sorted(r[3:] for r in got if r[2] == 2) == [(0, 0, 3), (0, 1, 3), (0, 2, 3)]
    assert pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
