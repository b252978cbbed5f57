import re

import corpus_pipeline
from folioguard.llm.common import stored
from folioguard.llm.quality import THRESHOLD, classify_quality

from .test_native import brute as leaks
from .test_set_join import brute as near

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = set(text)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        new = stored(stage(spark, docs, SF), "s")
        assert new.columns == list(corpus_pipeline.COLUMNS)
        got = [r.doc_id for r in new.collect()]
        if k == 0:
            rows = classify_quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
            want = {r.doc_id for r in rows if r.score >= THRESHOLD}
        elif k == 1:
            best = {}
            for d in want:
                key = re.sub(r"[\x20\x09-\x0D]", "", text[d] or "")
                best[key] = min(best.get(key, (1, 0)), (-len(text[d] or ""), d))
            want = {d for _, d in best.values()}
        elif k == 2:
            want = {d for d, c, *_ in near([(d, text[d]) for d in want]) if d == c}
        else:
            want = {d for d, _, hit, *_ in leaks([(d, text[d]) for d in want], items) if not hit}
        assert len(got) == len(set(got)) and set(got) == want, k
        docs = new
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == want
    assert 0 < len(want) < len(text)


def test_empty_and_null(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (None, "a text", "en", "s", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = stored(stage(spark, docs, SF), "s")
    assert docs.count() == 3
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "s")
    assert docs.count() == 0


def test_contaminated_rows_beside_clean_ones(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(d, t, "en", "s", len(t)) for d in (None, 1) for t in (f"before {item} after", "a clean text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.benchmark(spark, docs, SF).collect()
    assert {(r.doc_id, r.text) for r in got} == {(None, "a clean text"), (1, "a clean text")} and len(got) == 2


def frame(spark, rows, extra=""):
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), *(["x"] if extra else [])) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long" + extra)


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_exact_stage_goes_by_rows(spark):
    rows = [(7, "x y"), (7, "xy"), (7, "x  y"), (None, "a b"), (None, "ab"), (None, "c"), (8, "q"), (8, "q"), (9, "r s"), (9, "r\ts"), (None, ""), (4, " ")]
    got = kept(corpus_pipeline.exact(spark, frame(spark, rows, ", kept string"), SF))
    assert [r for r in got if r[0] != 9] == sorted([(7, "x  y"), (None, "a b"), (None, "c"), (8, "q"), (4, " ")], key=str)
    assert len([r for r in got if r[0] == 9]) == 1


def test_near_stage_goes_by_rows(spark):
    w = [f"w{i}" for i in range(60)]
    a, b, c = " ".join(w), " ".join(["z", *w[1:]]), " ".join([*w[:-1], "z"])
    rows = [(None, b), (5, a), (5, c), (5, a), (None, "other words of its own here"), (None, "other words of its own here"), (None, ""), (3, None)]
    got = kept(corpus_pipeline.near(spark, frame(spark, rows, ", tid string"), SF))
    assert len(got) == 4 and {r for r in got if r[1] not in (a, c)} == {(None, "other words of its own here"), (None, ""), (3, None)}
    assert [r[0] for r in got if r[1] in (a, c)] == [5]


def test_all_stages_on_rows_without_ids(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(None, item), (None, "a clean text of five words"), (None, "a  clean text of five words"), (None, item + " tail"), (2, "a clean text  of five words")]
    docs = frame(spark, rows, ", contaminated string")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = stored(stage(spark, docs, SF), "s")
        assert docs.columns == list(corpus_pipeline.COLUMNS)
    assert kept(docs) == [(2, "a clean text  of five words")]
    assert corpus_pipeline.packing(spark, docs, SF).count() == 1
