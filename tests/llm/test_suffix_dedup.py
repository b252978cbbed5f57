import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest

from folioguard.llm.suffix_dedup import SLICE, Collection, op1_suffix_dedup, substring_dedup


def brute(rows, width):
    count = Counter(b[i : i + width] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - width + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if count[b[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["an", "th", "é", "or", "in", "st"]) for _ in range(r.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    common, line = text(60), text(20)
    rows = [(i, text(r.randint(0, 120))) for i in range(60)]
    rows += [(100 + i, text(20) + common[i:] + text(20)) for i in range(10)]
    rows += [(200 + i, text(15) + line + text(15)) for i in range(20)]
    rows += [(300, rows[3][1] + rows[3][1]), (301, rows[5][1]), (302, None), (303, ""), (304, "a" * 700), (305, "ab" * 500), (306, "a" * 210)]
    rows += [(None, rows[61][1]), (300, text(50)), (301, rows[5][1]), (400, "\0" * 300), (401, "x" + "\0" * 250 + common)]
    return rows


@pytest.mark.parametrize("hot,batch,width", [(8192, 8192, 100), (3, 16, 100), (8192, 50, 200)])
def test_against_brute_force(spark, hot, batch, width):
    rows = corpus(1)
    df = spark.createDataFrame([(*x, "z") for x in rows], "doc_id long, text string, n_bytes string")
    got = sorted((tuple(x) for x in substring_dedup(df, width, hot, batch).collect()), key=str)
    assert got == brute(rows, width)
    assert sum(x[2] for x in got) > 1000


def test_long_texts(spark):
    """Texts of over half a megabyte are cut with overlap."""
    r = random.Random(2)
    noise = lambda n: "".join(r.choices("abcdefghijklmnop ", k=n))
    shared, late = noise(700), noise(300)
    long = noise(520_000) + shared + noise(4_000) + late + noise(300_000) + shared[100:500] + "é" * 90 + noise(200)
    rows = [(1, long), (2, noise(50) + late), (3, noise(SLICE - 150) + shared[:260]), (4, long[SLICE - 300 : SLICE + 300])]
    got = sorted((tuple(x) for x in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 96).collect()), key=str)
    assert got == brute(rows, 96)
    assert all(x[2] > 200 for x in got)


def test_rounds_against_sorted_suffixes(tmp_path):
    """Each round's order and common prefixes are those of the suffixes, and its file's BWT the symbols before them."""
    r, width = random.Random(3), 64
    texts = [bytes(r.choices(b"ab", k=r.randint(64, 96))) for _ in range(70)] + [b"a" * 64, b"a" * 80, b"a" * 64]
    lead = np.array([r.randint(len(t) - 64, 32) for t in texts])
    at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    none = np.zeros(len(texts), np.int64)
    with Collection("file://" + str(tmp_path), width) as c:
        c.add((none, np.arange(len(texts)), none, none, lead), np.frombuffer(b"".join(texts), np.uint8), at)
        seen = 0
        for column, lcp, text in c.rounds():
            own = [texts[k][max(0, column - c.left + lead[k]) :] if column >= c.left - lead[k] else b"" for k in text]
            starts = column - c.left + lead[text]
            real = [s if p >= 0 else None for s, p in zip(own, starts)]
            some = [s for s in real if s]
            assert some == sorted(some)
            for i in range(1, len(real)):
                if real[i] and real[i - 1]:
                    k = next((k for k, (x, y) in enumerate(zip(real[i - 1], real[i])) if x != y), min(len(real[i - 1]), len(real[i])))
                    assert lcp[i] == min(k, width)
            data = (tmp_path / next(p.name for p in tmp_path.iterdir()) / f"bwt{column}").read_bytes()
            bwt = np.frombuffer(data[: 2 * len(texts)], np.uint16)
            for s, k, p in zip(bwt, text, starts):
                assert s == (texts[k][p - 1] + 1 if 0 < p <= len(texts[k]) else 0)
            seen += len(some)
        assert seen == sum(map(len, texts))
    assert not list(tmp_path.iterdir())


def test_thousands_of_equal_rows(spark):
    """Equal rows, with an id and without, cost about as much as rows of distinct ids; results are those of brute force."""
    r = random.Random(5)
    text = "".join(r.choices("abcdefgh ", k=700))
    own = [(i, "".join(r.choices("abcdefgh ", k=300)) + text[i : i + 220]) for i in range(20)]

    def timed(rows):
        began = time.time()
        df = spark.createDataFrame(rows, "doc_id long, text string")
        return sorted((tuple(x) for x in substring_dedup(df).collect()), key=str), time.time() - began

    equal = [(7000, text)] * 2500 + [(None, text)] * 2500
    distinct, base = timed([(k + 100, text) for k in range(5000)] + own)
    got, took = timed(equal + own)
    few = brute([(7000, text)] * 2 + [(None, text)] * 2 + own, 200)
    assert sorted(set(got), key=str) == sorted(set(few), key=str)
    assert sum(g[0] == 7000 for g in got) == sum(g[0] is None for g in got) == 2500 and len(got) == 5020
    assert {g[1:] for g in distinct if g[0] >= 100} == {g[1:] for g in got if g[0] in (7000, None)}
    assert took < 2 * base + 20


def test_empty_table(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(spark):
    df = op1_suffix_dedup(spark, "/root/testdata/sf0.001")
    rows = [(x.doc_id, x.text) for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sorted((tuple(x) for x in df.collect()), key=str) == brute(rows, 200)
