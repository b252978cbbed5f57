"""Edits against a sequential fold, and literal quantities, digests and bundle folders."""

import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from folioguard.operators import consistency as K
from folioguard.operators import edits as E
from folioguard.operators import mapping as M
from folioguard.operators import placement as T
from folioguard.sources import bundles as B

EDIT = "deck_id long, step long, op string, slug string, position long, new_slug string"


def fold(slugs, log):
    """(origin, slug) after each edit in turn, and the steps that could not be done."""
    state, ignored = [(s, s) for s in slugs], []
    for step, op, slug, position, new in log:
        names = [s for _, s in state]
        k = names.index(slug) if slug in names else None
        at = None if position is None else position - 1
        if op == "insert" and k is None and at is not None:
            state.insert(min(max(at, 0), len(state)), (None, slug))
        elif op == "delete" and k is not None:
            state.pop(k)
        elif op == "move" and k is not None and at is not None:
            s = state.pop(k)
            state.insert(min(max(at, 0), len(state)), s)
        elif op == "rename" and k is not None and new is not None and new not in names[:k] + names[k + 1 :]:
            state[k] = (state[k][0], new)
        else:
            ignored.append(step)
    return state, ignored


def test_random_logs(spark):
    rng, decks = random.Random(1), {}
    for d in range(60):
        slugs, pool = [f"s{k}" for k in range(rng.randint(0, 7))], [f"s{k}" for k in range(9)]
        decks[d] = slugs, [(n, rng.choice(["insert", "delete", "move", "rename", "shout"]), rng.choice(pool), rng.choice([None, -3, 1, 2, 4, 50]), rng.choice([*pool, None])) for n in range(rng.randint(0, 12))]
    slides = spark.createDataFrame([(d, k, s) for d, (slugs, _) in decks.items() for k, s in enumerate(slugs)], "deck_id long, position long, slug string")
    edits = spark.createDataFrame([(d, *e) for d, (_, log) in decks.items() for e in log], EDIT)
    got = {r.deck_id: ([tuple(s) for s in r.slides], r.ignored) for r in E.replayed(slides, edits).collect()}
    assert got == {d: fold(*x) for d, x in decks.items() if any(x)}


def test_file_changes(spark):
    slides = spark.createDataFrame([(1, k, s) for k, s in enumerate(["cover", "idea", "data", "end"])], "deck_id long, position long, slug string")
    edits = spark.createDataFrame([(1, 1, "insert", "plan", 2, None), (1, 2, "delete", "data", None, None), (1, 3, "rename", "idea", None, "big-idea"), (1, 4, "delete", "data", None, None)], EDIT)
    decks = E.replayed(slides, edits)
    assert sorted(tuple(r)[1:] for r in E.file_changes(decks).collect() if r.new_stem) == [("create", None, "02-slide-plan"), ("keep", "01-slide-cover", "01-slide-cover"), ("keep", "04-slide-end", "04-slide-end"), ("rename", "02-slide-idea", "03-slide-big-idea")]
    assert [tuple(r) for r in E.file_changes(decks).where("new_stem IS NULL").collect()] == [(1, "remove", "03-slide-data", None)]
    assert [tuple(r) for r in E.ignored_edits(decks).collect()] == [(1, 4)]


def test_quantities(spark):
    lines = ["The ORFAN cohort held 40,091 patients at 8 centres. It grew.", "Wittmann et al. [12] report 93.5 % on FISH&CHIPS (n = 27729 scans); 12 images were lost", "In orfan-like data 5 patients; ORFAN has 40091 patients and 9 Centers!", "We saw 17 patients. TransCC of 2020 used 3 layers", None, "Wittmann et al. 93.50% and Wittmann et al. 2 mm"]
    df = spark.createDataFrame([(1, k, s) for k, s in enumerate(lines)] + [(2, 0, "ORFAN has 7 patients")], "doc_id long, line_no long, line string")
    got = sorted(tuple(r)[1:] for r in K.quantities(df).where("doc_id = 1").collect())
    assert got == sorted([
        (0, "orfan", 40091.0, "patient"), (0, "orfan", 8.0, "center"), (1, "wittmann", 93.5, "%"), (1, "fishchips", 27729.0, "scan"), (2, "orfan", 40091.0, "patient"), (2, "orfan", 9.0, "center"),
        (3, "transcc", 3.0, "layer"), (5, "wittmann", 93.5, "%"), (5, "wittmann", 2.0, "mm"),
    ])
    assert [tuple(r) for r in K.conflicting_quantities(df).collect()] == [(1, "orfan", "center", [8.0, 9.0], [0, 2])]


def test_quantities_stay_in_their_sentence(spark):
    lines = ["ORFAN.\t5 patients", "ORFAN et al. 5 patients; 6 patients", "ORFAN? \n 7 cases", " ORFAN 1,2,\t3.5\nCENTRES", "Wang et al.  9 ms! 8 ms", "ORFAN 5.patients; ORFAN .5 cm, v5 cm and 5cmx", "5 cm ORFAN,6 CM.7 mm"]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, line string").withColumn("line_no", F.lit(0))
    got = sorted(tuple(r)[:1] + tuple(r)[2:] for r in K.quantities(df).collect())
    assert got == [(1, "orfan", 5.0, "patient"), (3, "orfan", 3.5, "center"), (4, "wang", 9.0, "ms"), (6, "orfan", 6.0, "cm")]


def test_digests(spark):
    digest = {
        "thesis_claim": "Attention  is ENOUGH", "contributions": ["28.4 BLEU", "made up"], "method": {"equations": [{"id": "1", "latex": "d_k = 64", "source_ref": "p. 999"}], "deep": [[{"x": [{"y": "2.3·10¹⁹"}]}]]},
        "results": {"n": 41, "ok": True, "none": None}, "gap": "[MISSING: 77]", "language": "zz", "limitations": [],
    }
    digests = spark.createDataFrame([(1, json.dumps(digest)), (2, "no json"), (3, '{"a": "b"}'), (4, '"alone"')], "paper_id long, digest string")
    leaves = {(r.path, r.value) for r in K.digest_leaves(digests).where("paper_id = 1").collect()}
    assert ("$.method.deep[0][0].x[0].y", "2.3·10¹⁹") in leaves and ("$.contributions[1]", "made up") in leaves and len(leaves) == 12
    sources = spark.createDataFrame([(1, "Attention is enough. We get 28.\n4 BLEU, with d_k = 64 and 2.3 x 1019; 410 runs.")], "paper_id long, source string")
    got = {tuple(r) for r in K.ungrounded_leaves(digests, sources).collect()}
    assert got == {(1, "$.contributions[1]", "made up", "made up"), (1, "$.results.n", "41", "41"), (3, "$.a", "b", "b"), (4, "$", "alone", "alone")}


def bundles(spark, rows):
    return B.bundle_files(spark.createDataFrame(rows, "source string, ingest string, figures string, manifest string"))


def test_bundles(spark, tmp_path):
    path = str(tmp_path / "out")
    first = [("in/a b.pdf", '{"t": "x\\ny"}', "[]", "{}"), ("other/a b.pdf", "{}", "[]", "{}"), ("2024.pdf", "{}", None, "{}\n")]
    state = lambda rows: {r.bundle: r.state for r in B.write_bundles(bundles(spark, rows), path).collect()}
    there = lambda: {(r.bundle, r.file): r.content for r in B.read_bundles(spark, path).collect()}
    assert there() == {}
    assert state(first) == {"a_b": "written", "a_b_2": "written", "2024": "written"}
    assert there() == {("a_b", "ingest"): '{"t": "x\\ny"}', ("a_b", "figures"): "[]", ("a_b", "manifest"): "{}", ("a_b_2", "ingest"): "{}", ("a_b_2", "figures"): "[]", ("a_b_2", "manifest"): "{}", ("2024", "ingest"): "{}", ("2024", "manifest"): "{}\n"}
    stamps = lambda: {p: p.stat().st_mtime_ns for p in tmp_path.rglob("part-*")}
    before = stamps()
    assert set(state(first).values()) == {"unchanged"} and stamps() == before
    changed = [("in/a b.pdf", "{}", None, "{}"), *first[1:]]
    assert state(changed) == {"a_b": "written", "a_b_2": "unchanged", "2024": "unchanged"}
    assert there()["a_b", "ingest"] == "{}" and there()["a_b", "figures"] == "" and there()["a_b_2", "figures"] == "[]"
    assert {p for p, t in stamps().items() if before.get(p) != t} == set(tmp_path.rglob("bundle=a_b/*/part-*"))
    assert set(state(changed).values()) == {"unchanged"}
    assert state([("new.pdf", "1", "2", "3")]) == {"new": "written"} and len({b for b, _ in there()}) == 4


def test_bundles_after_a_failed_job(spark, tmp_path):
    """A job whose tasks fail half-way leaves what was there; the next one writes all."""
    path = str(tmp_path / "out")
    rows = [(f"s{k}.pdf", "{}", "[]", "{}") for k in range(20)]
    B.write_bundles(bundles(spark, rows), path)
    before = {tuple(r) for r in B.read_bundles(spark, path).collect()}
    new = bundles(spark, [(s, '{"new": 1}', f, m) for s, _, f, m in rows])
    broken = new.withColumn("content", F.when(F.col("bundle") == "s13", F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("content")))
    with pytest.raises(PySparkException, match="lost"):
        B.write_bundles(broken, path)
    assert {tuple(r) for r in B.read_bundles(spark, path).collect()} == before
    assert {r.state for r in B.write_bundles(new, path).collect()} == {"written"}
    assert {r.content for r in B.read_bundles(spark, path).where("file = 'ingest'").collect()} == {'{"new": 1}'}


def mapped(spark, captions, slides):
    c = spark.createDataFrame([(1, k, t) for k, t in enumerate(captions)], "deck_id long, fig_id long, caption string")
    s = spark.createDataFrame([(1, k, t) for k, t in enumerate(slides)], "deck_id long, slide long, text string")
    scores = {(r.fig_id, r.slide): r.score for r in M.mapping_scores(c, s).collect()}
    return {r.fig_id: (r.slide, r.score, r.band) for r in M.mapped_figures(c, s).collect()}, scores


def test_figures_to_slides(spark):
    got, scores = mapped(
        spark, ["Overview of the proposed framework", "Comparison with other methods: results on lungs", "Nothing shared", None, "framework framework"],
        ["Results on lungs", "Comparison with other methods: results on lungs", "", None, "The framework"],
    )
    assert got[1] == (1, 1.0, "auto") and got[2] == got[3] == (None, 0.0, "skip")
    assert {got[0][0], got[4][0]} == {4, None} and got[4][1] > 0.5 and got[4][2] in ("auto", "review")
    assert (2, 2) not in scores and scores[1, 0] < scores[1, 1]


def test_best_pairs_first(spark):
    """Against a plain loop: take the best pair, cross out its row and column, and so on."""
    rng = random.Random(3)
    words = "lung heart liver bone vessel tumor nodule method results".split()
    text = lambda: " ".join(rng.choices(words, k=rng.randint(0, 5)))
    got, scores = mapped(spark, [text() for _ in range(9)], [text() for _ in range(7)])
    left, want = dict(scores), {}
    while left:
        f, s = min(left, key=lambda k: (-left[k], k))
        want[f] = (s, left[f, s])
        left = {k: v for k, v in left.items() if k[0] != f and k[1] != s}
    assert {f: v[:2] for f, v in got.items() if v[0] is not None} == want and len(got) == 9


def test_decks_in_tasks_and_by_joins(spark, monkeypatch):
    """Decks mapped whole, large ones by joins, and all by joins for a large vocabulary come to the same, decks without a key or slides included."""
    rng = random.Random(8)
    words = "lung heart liver framework comparison ablation method results it".split()
    text = lambda: " ".join(rng.choices(words, k=rng.randint(0, 5))) if rng.random() > 0.05 else None
    rows = lambda most: [(d, k, text()) for d in [*range(60), None] for k in range(rng.randint(0, most))]
    c, s = spark.createDataFrame(rows(4), "deck_id long, fig_id long, caption string"), spark.createDataFrame(rows(6), "deck_id long, slide long, text string")
    got = lambda: sorted(map(str, M.mapped_figures(c, s).collect()))
    whole = M.mapped_figures(c, s)
    assert "Join" not in whole._jdf.queryExecution().executedPlan().toString()
    whole = sorted(map(str, whole.collect()))
    assert len(whole) == c.count()
    monkeypatch.setattr(M, "DECK", 3)
    assert got() == whole
    monkeypatch.setattr(M, "VOCABULARY", 3)
    assert got() == whole


def test_places_of_a_template(spark):
    page = "page_id long, title string, caption string, figure_w long, figure_h long, width long, height long"
    rows = [(1, "A title", "A caption", 1600, 800, 1920, 1080), (2, "word " * 30, "word " * 50, 100, 400, 1920, 1080), (3, "x", None, 0, 10, 1920, 1080), (4, "word " * 400, "", 10, 10, 1280, 720)]
    got = {r.page_id: r for r in T.template_places(spark.createDataFrame(rows, page)).collect()}
    one = got[1]
    assert (one.title_font, one.caption_font, [tuple(t) for t in one.titles], [tuple(c) for c in one.captions]) == (48, 24, [("A title", 80.0)], [("A caption", 1000.0)])
    # Title to 182.4, caption from 1000: 777.6 of room, of which 702 may be used; 1600 x 800 fits by its height.
    assert [round(v, 6) for v in one.figure] == [258.0, 220.2, 1404.0, 702.0] and [round(v, 6) for v in one.frame] == [238.0, 200.2, 1444.0, 742.0]
    two = got[2]
    assert [len(t.text) for t in two.titles] == [69, 69, 9] or len(two.titles) == 3
    assert [round(t.y, 6) for t in two.titles] == [80.0, 142.4, 204.8] and round(two.captions[1].y, 6) == 1033.6
    assert round(two.figure.h, 6) == round(min(702, 1000 - (80 + 3 * 62.4 + 40) - 40), 6) and round(two.figure.w * 4, 6) == round(two.figure.h, 6)
    assert got[3].figure is None and got[3].captions == [] and got[4].figure is None and got[4].title_font == 32


def test_digests_in_one_pass(spark, monkeypatch):
    """Digests of few levels are not written between levels; deeper ones, and brackets in strings, give the same leaves."""
    texts = ['{"a": {"b": [1, [2, {"c": "]]}}{{[["}]]}, "d": {}, "e": [], "f\\"[": null}', "[" * 12 + '{"x": "\\"["}' + "]" * 12, "[", '"s"', "7", None]
    digests = spark.createDataFrame(list(enumerate(texts)), "paper_id long, digest string")
    whole = sorted(map(tuple, K.digest_leaves(digests).collect()), key=str)
    assert [(r[0], r[2], r[3]) for r in whole if r[0] == 1] == [(1, "x", '"[')] and len(whole) == 7
    assert whole == sorted(map(tuple, K._leaves_in_rounds(digests).collect()), key=str)
    monkeypatch.setattr(K, "written", None)
    assert sorted(map(tuple, K.digest_leaves(digests.where("paper_id NOT IN (1, 2)")).collect()), key=str) == [r for r in whole if r[0] != 1]
