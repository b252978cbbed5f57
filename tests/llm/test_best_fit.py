import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folioguard.llm import best_fit as B
from folioguard.llm.best_fit import Packer, PartEncoder, best_fit_pack, lower_bound, op13_best_fit, packed_shards

SF = "/root/testdata/sf0.01"
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]


def brute(rows, size):
    out = []
    for doc_id, text in rows:
        ids = np.array(TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        out += [(doc_id, p, a, len(ids[a : a + size]), zlib.crc32(ids[a : a + size].tobytes())) for p, a in enumerate(range(0, len(ids), size))]
    return sorted(out, key=str)


def checked(df, rows, size):
    """All pieces are there, sequences are gapless and hold at most ``size``; gives the number of sequences."""
    got = df.collect()
    assert df.columns == [*COLUMNS, "sequence_id", "offset"]
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows, size)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in by.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    lengths = np.array([p[3] for p in brute(rows, 4096)])
    assert checked(op13_best_fit(spark, SF), rows, 4096) == lower_bound(lengths, 4096)


@pytest.mark.parametrize("shard,over", [(8, 14), (60, 2)])
def test_many_shards(spark, shard, over):
    """What is lost at borders between shards is won back, all but little: a shard of 8 pieces cannot be packed well."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join("ab"[k % 2] for k in range(int(n)))) for i, n in enumerate(rng.integers(0, 90, 400))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, length string")
    lengths = np.array([p[3] for p in brute(rows, 64)])
    assert checked(best_fit_pack(df, size=64, shard=shard), rows, 64) <= lower_bound(lengths, 64) + over


def test_nulls_and_repeated_rows(spark):
    rows = [(1, None), (1, ""), (None, "the cat"), (2, "the cat"), (2, "the cat"), (3, "word " * 300), (4, "<|endoftext|> it's"), (5, "İstanbul Σίσυφος é   naïve 漢字 12a")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, uid string")
    assert checked(best_fit_pack(df, size=32), rows, 32) == -(-sum(p[3] for p in brute(rows, 32)) // 32)
    assert best_fit_pack(df.limit(0)).count() == 0


TEXT = st.text(st.one_of(st.sampled_from(" \n\t'\"sdtmlrev,.AZaz09(éÉİıſΣσς́ÅßǅⅣ½²漢  ‍-_|<>"), st.characters(codec="utf-8")), max_size=60)
ENCODER = PartEncoder(None)


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_parts_agree_with_the_tokenizer(texts):
    data = [t.encode() for t in texts]
    at = np.cumsum([0, *map(len, data)])
    ids, starts = ENCODER.encode(np.frombuffer(b"".join(data), np.uint8), at)
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]


def test_forgets(monkeypatch):
    """Results do not depend on how many parts are remembered."""
    monkeypatch.setattr(B, "REMEMBERED", 5)
    encoder, text = PartEncoder(None), "one two three four five six seven one two"
    for _ in range(3):
        ids, _ = encoder.encode(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        assert ids.tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def fewest(lengths, size):
    """By trying all partitions."""
    best = len(lengths)
    for labels in itertools.product(range(len(lengths)), repeat=len(lengths)):
        if max(np.bincount(labels, lengths)) <= size:
            best = min(best, len(set(labels)))
    return best


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 10), min_size=1, max_size=6))
def test_packer_on_small_sets(lengths):
    lengths = -np.sort(-np.array(lengths))
    packer = Packer(lengths, 10, [1])
    best = packer.evolve(packer.start(6), 20, 6)[0]
    assert packer.bound <= fewest(lengths.tolist(), 10) == len(set(best.tolist()))


def test_genes():
    """Children keep every piece once and every bin within its size; evolution never loses bins it has saved."""
    rng = np.random.default_rng(3)
    lengths = -np.sort(-rng.integers(900, 2100, 300))
    packer = Packer(lengths, 4096, [2])
    population = packer.start(6)
    for child in (packer.crossover(population[1], population[2]), packer.mutate(population[3])):
        assert child.min() == 0 and set(child.tolist()) == set(range(child.max() + 1))
        assert packer.fills(child).max() <= 4096
    before = max(packer.fitness(p) for p in population)
    assert packer.fitness(packer.evolve(population, 20, 6)[0]) > before


def test_elites_migrate(spark):
    """Several epochs over shards that no start solves: the result is no worse than best fit by descending length."""
    rng = np.random.default_rng(4)
    lengths = rng.integers(900, 2100, 600)
    short = spark.createDataFrame([(int(i), int(n)) for i, n in enumerate(lengths)], "uid long, length long")
    done = packed_shards(short, 2, 1, 4096, 2, 4, 4, 3).collect()
    assert sorted(r.uid for r in done) == list(range(600))
    fills = {}
    for r in done:
        fills[r.sequence_id] = fills.get(r.sequence_id, 0) + r.length
    assert max(fills.values()) <= 4096
    whole = Packer(-np.sort(-lengths), 4096, [1])
    assert len(fills) <= len(set(whole.start(1)[0].tolist())) + 2
