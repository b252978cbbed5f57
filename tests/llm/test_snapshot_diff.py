import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioguard.llm import snapshot_diff as D
from folioguard.llm.snapshot_diff import OP12_SQL, build, numbered, op12_snapshot_diff, peel, snapshot_diff

from .oracle import same

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, k int, d string, n string"
COLUMNS = ["text", "lang", "source"]


def test_query(spark):
    rows = same(op12_snapshot_diff(spark, SF), OP12_SQL, SF)
    assert {r[3] for r in rows} == {"same", "update", "rekey", "insert", "delete"}


def last(x):
    return (x is None, 0 if x is None else x)


def brute(old, new):
    """Pairs by equal rows, then by key, then by text, for snapshots in which a key is at most once on each side."""
    sha = lambda r: hashlib.sha256("\n".join("~" if x is None else x for x in r[1:]).encode()).hexdigest()
    differs = lambda a, b: ",".join(c for c, x, y in zip(COLUMNS, a[1:], b[1:]) if x != y)
    out, a, b = [], {r[0]: r for r in old}, {r[0]: r for r in new}
    for k in a.keys() & b.keys():
        changed = differs(a[k], b[k])
        out.append((k, k, "update" if changed else "same", changed, sha(b[k])))
    texts = defaultdict(lambda: ([], []))
    for side, rows, other in ((0, a, b), (1, b, a)):
        for k in sorted(rows.keys() - other.keys(), key=last):
            texts[rows[k][1]][side].append(rows[k])
    for gone, come in texts.values():
        out += [(y[0], x[0], "rekey", differs(x, y), sha(y)) for x, y in zip(gone, come)]
        out += [(x[0], x[0], "delete", "", None) for x in gone[len(come) :]] + [(y[0], None, "insert", "", sha(y)) for y in come[len(gone) :]]
    return sorted(out, key=str)


def diff(spark, old, new, **sizes):
    a, b = (spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA) for rows in (old, new))
    df = snapshot_diff(a, b, "doc_id", COLUMNS, "text", **sizes)
    assert df.columns == ["key", "old_key", "op", "changed", "row_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def rows(n, seed):
    rng = np.random.default_rng(seed)
    pick = lambda some: some[rng.integers(len(some))]
    return [(i, pick(["a", "b", "", None, f"own {i}"]), pick(["en", None, "fr"]), pick(["x", "~", None])) for i in range(n)]


def test_small(spark):
    old = [(1, "a", "en", "x"), (2, None, "en", "x"), (3, "", "en", None), (None, "n", "en", "x"), (5, "t", "en", "x"), (6, "t", "en", "x"), (7, "t", "fr", "x")]
    new = [(1, "a", "en", None), (12, None, "fr", "x"), (3, None, "en", None), (None, "n", "en", "x"), (16, "t", "en", "x"), (15, "t", "en", "x"), (99, "", "en", "x")]
    got = diff(spark, old, new)
    assert got == brute(old, new)
    assert {r[:4] for r in got} == {
        (1, 1, "update", "source"), (12, 2, "rekey", "lang"), (3, 3, "update", "text"), (None, None, "same", ""), (15, 5, "rekey", ""), (16, 6, "rekey", ""), (7, 7, "delete", ""), (99, None, "insert", ""),
    }


@pytest.mark.parametrize("sizes", [{}, {"rows": 40, "cells": 3}])
def test_random(spark, sizes):
    """With three cells for forty rows, tables have to be enlarged several times."""
    old = rows(300, 1)
    new = [(k if k % 3 else k + 1000, t if k % 5 else f"{t}+", a, s) for k, t, a, s in old if k % 7] + [(k + 5000, *r) for k, *r in rows(40, 2)]
    assert diff(spark, old, new, **sizes) == brute(old, new)


def test_no_rows(spark):
    some = rows(20, 3)
    assert diff(spark, [], []) == []
    assert diff(spark, some, []) == brute(some, [])
    assert diff(spark, [], some) == brute([], some)
    assert {r[2] for r in diff(spark, some, some)} == {"same"}


def test_repeated_keys(spark):
    """Equal rows pair first; what is left of a key pairs in the order of content; the rest pairs by text."""
    a, b, c = (7, "a", "en", "x"), (7, "b", "en", "x"), (7, "c", "en", "x")
    count = lambda got: sorted(r[2] for r in got)
    assert count(diff(spark, [a, a, a, b], [a, a, b])) == ["delete", "same", "same", "same"]
    assert count(diff(spark, [a, a], [a, a, a, c])) == ["insert", "insert", "same", "same"]
    assert count(diff(spark, [a, b], [a, c])) == ["same", "update"]
    assert count(diff(spark, [a] * 50, [b] * 30 + [(8, "a", "en", "x")] * 5)) == ["delete"] * 15 + ["rekey"] * 5 + ["update"] * 30


def test_crc(spark):
    ids = [0, 7, -5, 123456789]
    df = D.later_snapshot(spark.createDataFrame([(i, None, "en", "x") for i in [*ids, None]], "doc_id long, text string, lang string, source string")).collect()
    for i in ids:
        fate = zlib.crc32(str(i).encode()) % 16
        keys = sorted(r.doc_id for r in df if r.doc_id in (i, -1 - i))
        assert keys == sorted({0: [], 3: [-1 - i], 4: [-1 - i], 5: [i, -1 - i]}.get(fate, [i]))
    assert [r for r in df if r.doc_id is None] == [(None, None, "en", "x")]


entry = st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(entry, st.tuples(st.integers(0, 5), st.integers(0, 5)), max_size=40))
def test_table_decodes(counts):
    """What is left of two tables with room enough is the difference of the multisets."""
    k, d = (np.array([e[i] for e in counts], np.uint64) for i in (0, 1))
    old, new = (np.array([c[i] for c in counts.values()], np.int64) for i in (0, 1))
    k2, d2, n, ok = peel(build(k, d, old, 300) - build(k, d, new, 300))
    assert ok
    assert {(int(a), int(b)): int(c) for a, b, c in zip(k2, d2, n)} == {e: a - b for e, (a, b) in counts.items() if a != b}


def test_full_table_says_so():
    rng = np.random.default_rng(2)
    k, d = rng.integers(0, 2**63, (2, 200)).astype(np.uint64)
    assert not peel(build(k, d, np.ones(200, np.int64), 60))[3]


def test_numbered(spark):
    """One group holds most rows; places are gapless in every group."""
    df = spark.range(900).selectExpr("if(id < 800, null, id % 3) AS g", "id * 7919 % 900 AS o")
    got = defaultdict(list)
    for r in numbered(df, ["g"], ["o"]).collect():
        got[r.g].append((r.i, r.o))
    for members in got.values():
        members.sort()
        assert [i for i, _ in members] == list(range(1, len(members) + 1)) and members == sorted(members, key=lambda m: m[1])
