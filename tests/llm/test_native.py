import random
import re

import pytest

from folioguard.llm import decontamination
from folioguard.llm.common import scratch
from folioguard.llm.decontamination import OP8_SQL, PositionalIndex, contamination, decontaminate, op8_decontaminate, proximity_matches
from folioguard.llm.exact_dedup import OP9_SQL, DigestIndex, digest_rows, exact_dedup, op9_exact_dedup

from .oracle import same

SF = "/root/testdata/sf0.01"


def test_exact_dedup_sql(spark):
    rows = same(op9_exact_dedup(spark, SF), OP9_SQL, SF)
    assert len({r for r in rows}) == 1000


def test_exact_dedup_cases(spark):
    rows = [(1, "a b", 0), (2, "ab", 0), (3, "a  b", 0), (4, None, 0), (5, "", 0), (6, " \t\n", 0), (7, "a b", 0), (3, "a  b", 0), (None, "q", 0), (8, "x" * 100_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    index = DigestIndex(spark, "digest_test", scratch(spark, "d"), 4)
    index.append(df)
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(df, index).collect()}
    assert got == {(1, 3, 4, False), (2, 3, 4, False), (3, 3, 4, True), (4, 6, 3, False), (5, 6, 3, False), (6, 6, 3, True), (7, 7, 1, True), (None, None, 1, True), (8, 8, 1, True)}
    n = index.read().count()
    index.append(df)
    assert index.read().count() == n == 5
    index.append(spark.createDataFrame([(9, "new"), (10, "ab ")], "doc_id long, text string"))
    assert index.read().count() == 6
    assert not re.search("Python|Arrow|Pandas", exact_dedup(df, index)._jdf.queryExecution().toString())
    spark.sql("DROP TABLE digest_test")


def test_rows_that_were_never_appended(spark):
    index = DigestIndex(spark, "digest_unknown", scratch(spark, "d"), 4)
    old = spark.createDataFrame([(1, "a"), (2, "a "), (3, "b")], "doc_id long, text string")
    index.append(old)
    with pytest.raises(Exception, match="not in the index"):
        exact_dedup(old.unionByName(spark.createDataFrame([(4, "c")], "doc_id long, text string")), index).collect()


def test_batches(spark):
    """A text belongs to the batch that brought it, and its entry never changes."""
    path = scratch(spark, "d")
    index = DigestIndex(spark, "digest_batches", path, 4)
    one = spark.createDataFrame([(1, "a"), (2, "a "), (3, "b")], "doc_id long, text string")
    two = spark.createDataFrame([(4, "a    "), (5, "c"), (6, "c"), (0, "b")], "doc_id long, text string")
    index.append(one)
    index.append(two)
    want = {(4, 2, 2, False), (5, 5, 2, True), (6, 5, 2, False), (0, 3, 1, False)}
    result = lambda i: {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(two, i).collect()}
    assert result(index) == want
    files = lambda i: len(i.read().inputFiles())
    for k in range(3):
        index.append(spark.createDataFrame([(10 + k, f"more {k}")], "doc_id long, text string"))
    before, rows = files(index), sorted(map(tuple, index.read().collect()))
    index.compact()
    assert files(index) <= 4 < before and sorted(map(tuple, index.read().collect())) == rows and result(index) == want
    index.compact()
    # Another session finds the index by its path.
    spark.sql("DROP TABLE digest_batches")
    again = DigestIndex(spark, "digest_batches", path)
    assert again.buckets == 4 and again.version == 2 and sorted(map(tuple, again.read().collect())) == rows and result(again) == want
    again.append(two)
    assert again.read().count() == len(rows)


def test_tables_of_another_kind_stay(spark):
    spark.createDataFrame([(1,)], "x int").write.option("path", scratch(spark, "own")).saveAsTable("somebodys")
    with pytest.raises(ValueError, match="another kind"):
        DigestIndex(spark, "somebodys", scratch(spark, "d"))
    assert spark.read.table("somebodys").count() == 1
    spark.sql("DROP TABLE somebodys")


def test_one_exchange(spark):
    """The aggregate's exchange is the only one on the way into the index."""
    index = DigestIndex(spark, "digest_plan", scratch(spark, "d"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    index.append(docs)
    new = index.unseen(digest_rows(docs))
    new.collect()
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan.split("Initial Plan")[0])) == 1, plan


def test_exact_dedup_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    index = DigestIndex(spark, "digest_none", scratch(spark, "d"), 4)
    index.append(df)
    assert exact_dedup(df, index).collect() == []
    spark.sql("DROP TABLE digest_none")


def test_decontaminate_sql(spark):
    df = op8_decontaminate(spark, SF)
    rows = same(df, OP8_SQL, SF)
    assert sum(r[0] for r in rows) > 5
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().toString())


def brute(docs, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for i, s in items:
            v = words(s)
            k = min(len(v), 10)
            wins = {tuple(v[a : a + k]) for a in range(len(v) - k + 1)} if v else set()
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in wins:
                    hit |= set(range(a, a + k))
                    ids.add(str(i))
        out.append((d, len(w), len(hit), len(ids), ",".join(sorted(ids))))
    return out


def test_decontaminate_cases(spark):
    import hashlib

    seq = " ".join(f"w{i}" for i in range(30))
    items = [(1, seq), (10, "Short É one"), (2, None), (3, "..."), (4, "the the the the the the the the the the the the"), (5, seq), (9, "solo")]
    docs = [(1, f"x {seq} y"), (2, "w3 w4 w5 w6 w7 w8 w9 w10 w11"), (3, "w3 W4, w5 w6-w7 w8 w9 w10 w11 w12 z"), (4, None), (5, ""), (6, "a short É one b short É"), (7, "short é one"), (8, "the " * 500), (8, "solo"), (8, "solo"), (None, seq), (11, "w1 " * 20000 + seq)]
    got = decontaminate(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_hit int"), spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, n int"))
    want = sorted(((d, n, h, k, hashlib.sha256(s.encode()).hexdigest(), h > 0) for d, n, h, k, s in brute(docs, items)), key=str)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), none).collect()} == {0}


def index_of(spark, docs, name):
    index = PositionalIndex(spark, name, scratch(spark, "i"), 4)
    index.append(spark.createDataFrame(docs, "doc_id long, text string"))
    return index


def split(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())


def brute_near(docs, asked, within):
    out = set()
    for d, t in docs:
        w = split(t)
        for q, terms in asked:
            spans = {}
            for last in range(len(w)):
                at = [max((i for i in range(last + 1) if w[i] == v), default=None) for v in set(terms)]
                if w[last] in terms and None not in at and last - min(at) < within:
                    spans[min(at)] = min(spans.get(min(at), last), last)
            out |= {(q, d, a, b) for a, b in spans.items()}
    return out


def test_proximity(spark):
    r = random.Random(5)
    docs = [(i, " ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 40)))) for i in range(40)] + [(None, "a x b"), (None, "b"), (3, "c a b"), (50, None), (51, "q " * 300 + "x A")]
    asked = [("1", ["a", "b"]), ("2", ["x", "a"]), ("3", ["h", "g", "f", "h"]), ("4", ["missing", "a"]), ("5", ["c"])]
    index = index_of(spark, docs, "near_postings")
    got = proximity_matches(index, spark.createDataFrame(asked, "query_id string, words array<string>"), 6)
    assert {(x.query_id, x.doc_id, x.first, x.last) for x in got.collect()} == brute_near(docs, asked, 6)
    assert not re.search("Python|Arrow|Pandas", got._jdf.queryExecution().toString())
    assert proximity_matches(index, spark.createDataFrame([], "query_id string, words array<string>"), 6).collect() == []


def test_one_index_for_two_benchmarks(spark):
    """The index knows nothing of a benchmark, and its documents are split into words once."""
    r = random.Random(9)
    text = lambda n: " ".join(r.choice(["on", "of", "it", "so", "we", "go"]) + str(r.randint(0, 2)) for _ in range(n))
    items = [(i, text(r.randint(1, 30))) for i in range(12)]
    docs = [(i, text(r.randint(0, 60)) + " " + r.choice(items)[1] + " " + text(5)) for i in range(60)] + [(None, items[3][1]), (None, None), (7, items[5][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    index = index_of(spark, docs, "two_postings")
    for some in (items[:6], items[6:], [(99, "the on0")]):
        got = contamination(df, spark.createDataFrame(some, "item_id long, text string"), index, anchors=r.choice([1, 2, 3]))
        plan = got._jdf.queryExecution().toString()
        assert "split(" not in plan
        rows = sorted(((x.doc_id, x.n_words, x.n_hit, x.n_items) for x in got.collect()), key=str)
        assert rows == sorted((x[:4] for x in brute(docs, some)), key=str)
    index.compact()
    again = PositionalIndex(spark, "two_again", index.path)
    assert again.read().count() == sum(len(split(t)) for _, t in docs)


def test_decontaminate_no_documents(spark):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate(spark.createDataFrame([], "doc_id long, text string"), items).collect() == []


def test_decontaminate_thousands_of_equal_rows(spark):
    seq = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(7, f"x {seq} y")] * 1500 + [(None, seq)] * 1500 + [(8, "clean")], "doc_id long, text string")
    got = decontaminate(docs, spark.createDataFrame([(1, seq)], "item_id long, text string")).groupBy("doc_id", "n_words", "n_hit", "contaminated").count().collect()
    assert sorted(map(tuple, got), key=str) == sorted([(7, 14, 12, True, 1500), (None, 12, 12, True, 1500), (8, 1, 0, False, 1)], key=str)


def test_near_windows(spark):
    """Words of a window in any order, over the edges of cells too, against a search of all spans."""
    r = random.Random(17)
    vocabulary = [f"v{i}" for i in range(25)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(n))) for i, n in enumerate([1, 3, 5, 6, 8, 12])] + [(90, None), (91, ""), (92, "v1 v1 v1")]
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 3, 9, 30, 200])))) for i in range(40)]
    docs += [(100 + i, "x " * i + " ".join(r.sample(items[4][1].split(), 8)) + " y" * 30) for i in range(12)] + [(None, items[3][1]), (None, None), (7, items[2][1])]
    length, within = 5, 8

    def near(text, item):
        w, v = split(text), split(item)
        k = min(len(v), length)
        wins = [set(v[a : a + k]) for a in range(len(v) - k + 1)] if v else []
        return any(win <= set(w[a : a + within]) for win in wins for a in range(len(w)))

    want = sorted(((d, sum(near(t, x) for _, x in items)) for d, t in docs), key=str)
    for anchors in (1, 2, 4):
        got = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), length, anchors, within)
        assert sorted(((x.doc_id, x.n_near) for x in got.collect()), key=str) == want
        assert all(x.n_near >= x.n_items for x in got.collect())
    assert not re.search("Python|Arrow|Pandas", got._jdf.queryExecution().toString())


def test_counts_of_many_terms(spark, monkeypatch):
    """Beyond the bound for broadcasts, postings are counted before they meet the terms."""
    docs = [(1, "a b a"), (2, "the " * 50 + "b"), (3, None)]
    index = index_of(spark, docs, "count_postings")
    terms = spark.createDataFrame([("a",), ("b",), ("the",), ("none",)], "word string")
    few = sorted(map(tuple, index.counts(terms).collect()))
    monkeypatch.setattr("folioguard.llm.decontamination.BROADCAST_ROWS", 1)
    assert sorted(map(tuple, index.counts(terms).collect())) == few == [("a", 2), ("b", 2), ("none", 0), ("the", 50)]


def test_postings_stay_in_their_shards(spark, monkeypatch):
    """With more cells than a broadcast takes, as at 6 GB, only postings in such cells are exchanged, not all of them twice."""
    own = decontamination.small_enough
    monkeypatch.setattr(decontamination, "small_enough", lambda df, *a: df if {"id", "key"} <= set(df.columns) else own(df, *a))
    monkeypatch.setattr(decontamination, "_few", lambda df, rows=20_000: rows > 20_000)
    store = spark.sparkContext._jsc.sc().statusStore().store()

    def shuffled():
        stages, n = store.view(spark._jvm.java.lang.Class.forName("org.apache.spark.status.StageDataWrapper")).closeableIterator(), {}
        while stages.hasNext():
            i = stages.next().info()
            n[i.stageId()] = i.shuffleWriteRecords()
        return n

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled()
        got = op8_decontaminate(spark, SF).collect()
        sent = sum(v for k, v in shuffled().items() if k not in before)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sent < sum(r.n_words for r in got) / 2, sent
    monkeypatch.undo()
    assert sorted(got, key=lambda r: r.doc_id) == sorted(op8_decontaminate(spark, SF).collect(), key=lambda r: r.doc_id)
