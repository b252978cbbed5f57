"""Prose rules, charts and page extracts on small rows: nulls, empty tables, ties and limits."""

import pytest
from pyspark.sql import functions as F

from folioguard.operators import bib as B
from folioguard.operators import charts as C
from folioguard.operators import deck as D
from folioguard.operators import protocol as P
from folioguard.plans import rules
from folioguard.sources import extracted as X


def rows(df, *names):
    return sorted((tuple(r[n] for n in names or df.columns) for r in df.collect()), key=str)


def test_citations_and_entries(spark):
    body = spark.createDataFrame([(1, "as (Kumar & Alvarez, 2022) and (Li et al., 2020b)"), (1, None), (2, "(kumar, 2022) [TBD]")], "doc_id long, line string")
    entries = spark.createDataFrame([(1, "Kumar A, Alvarez B. (2022). T."), (1, "Roe C. (1999). U."), (2, None)], "doc_id long, entry string")
    assert rows(P.author_year_orphans(body, entries)) == [(1, "Li", "2020b", "orphan-citation"), (1, "Roe", "1999", "orphan-reference")]
    assert P.author_year_orphans(body.limit(0), entries.limit(0)).count() == 0
    assert rows(P.stub_markers(body.withColumn("line_no", F.lit(7)))) == [(2, 7, "[TBD]")]


def test_authors(spark):
    four = ["Zhang H", " wang L", "Chen Y", "Liu Q"]
    records = spark.createDataFrame([(1, four), (2, four[:3]), (3, four[:3] + ["Okonkwo D"]), (4, None), (5, [])], "record_id long, authors array<string>")
    assert rows(P.generic_authors(records)) == [(1,)]


def test_style_ties_and_default(spark):
    docs = spark.createDataFrame([(1, "Gaming, creative work"), (2, None), (3, "science communication"), (4, "data data thesis")], "doc_id long, text string")
    got = {r.doc_id: (r.style, r.signals) for r in P.auto_style(docs).collect()}
    assert got == {1: ("dark-atmospheric", 2), 2: ("blueprint", 0), 3: ("editorial-infographic", 1), 4: ("academic-paper", 1)}


def test_bands_and_rubric(spark):
    talks = spark.createDataFrame([(3, 8), (5, 5), (19, 18), (45, 36)], "m int, n int")
    assert [r.v for r in talks.select(P.slide_count_verdict(F.col("m"), F.col("n")).alias("v")).collect()] == ["over", "within", "within", "over"]
    scores = spark.createDataFrame([(0.81,), (0.8,), (0.5,), (0.49,)], "s double")
    assert [r.b for r in scores.select(P.confidence_band(F.col("s")).alias("b")).collect()] == ["auto", "review", "review", "skip"]
    rated = spark.createDataFrame([(1, s, 4) for s in P.RUBRIC] + [(2, s, 5) for s in list(P.RUBRIC)[1:]] + [(3, s, 2 if s == "Methodology" else 5) for s in P.RUBRIC] + [(4, None, None)], "proposal_id long, section string, rating int")
    assert rows(P.rubric_result(rated), "proposal_id", "passes") == [(1, True), (2, False), (3, False)]


def test_sampling_and_runs(spark):
    refs = spark.createDataFrame([(d, r) for d, n in ((1, 1), (2, 10), (3, 11)) for r in range(n)], "doc_id long, ref_no long")
    assert rows(P.spot_checks(refs).groupBy("doc_id").count()) == [(1, 1), (2, 2), (3, 3)]
    lines = spark.createDataFrame([(1, k, "| a |") for k in range(1, 22)] + [(1, 23, " | b | "), (1, 24, "x | y"), (2, 1, None)], "doc_id long, line_no long, line string")
    assert rows(P.table_limits(lines)) == [(1, 2, 1, False)]


def test_decks(spark):
    slides = spark.createDataFrame([(1, 30, "b"), (1, 10, "a"), (1, 20, "b"), (2, 1, "a")], "deck_id long, position int, slug string")
    assert rows(P.renumbered(slides), "deck_id", "file_stem", "role", "repeated") == [(1, "01-slide-a", "cover", False), (1, "02-slide-b", "content", True), (1, "03-slide-b", "back-cover", True), (2, "01-slide-a", "cover", False)]
    kinds = spark.createDataFrame([(1, "critique-concerns"), (1, None), (2, None)], "deck_id long, layout string")
    assert rows(P.missing_layouts(kinds)) == [(1, "discussion-questions"), (2, "critique-concerns"), (2, "discussion-questions")]
    wide = spark.createDataFrame([("ab cd  efghij k", 5), (None, 5), ("", 5)], "t string, n int").select(D.wrapped(F.col("t"), F.col("n")).alias("w"))
    assert [r.w for r in wide.collect()] == [["ab cd", "efghij", "k"], [], []]
    boxes = spark.createDataFrame([(100, 50, 200, 50), (0, 5, 1, 1)], "w int, h int, bw int, bh int")
    assert [r.s for r in boxes.select(D.contain_scale(*(F.col(c) for c in ("w", "h", "bw", "bh"))).alias("s")).collect()] == [1.0, None]
    spec = spark.createDataFrame([(1, '{"slides": [{"layout": "equation", "equations": [{"latex": "a=b", "num": "1"}]}, {"layout": "section"}]}')], "deck_id long, spec string")
    assert rows(D.equations_of(D.slides_of(spec))) == [(1, 1, 0, "a=b", "1")]


def test_charts(spark):
    s = "chart_id long, categories array<string>, series array<struct<name:string,values:array<double>,color:string>>"
    charts = spark.createDataFrame([(1, ["a"], [(None, [1.5], None), ("x", [1.0, 2.0], "#fff")]), (2, None, [("y", [1.0], None)]), (3, ["a"], None)], s)
    assert rows(C.chart_series(charts), "chart_id", "name", "color", "error") == [(1, "series1", "#0072B2", None), (1, "x", "#fff", "2 values for 1 categories"), (2, "y", "#0072B2", "no categories or series"), (3, "series1", "#0072B2", "no categories or series")]
    labels = spark.createDataFrame([(["x"] * 8,), (["x"] * 9,), (["a label that is long"],), ([],)], "c array<string>")
    assert [r.r for r in labels.select(C.tick_rotation(F.col("c")).alias("r")).collect()] == [0, 15, 15, 0]


def test_page_text(spark):
    items = spark.createDataFrame([(1, 50.0, 100.0, "b"), (1, 10.0, 97.0, "a"), (1, 10.0, 80.0, "c"), (1, 5.0, 80.0, " "), (1, 1.0, None, "lost"), (2, 1.0, 1.0, None)], "page_id long, x double, y double, str string")
    assert rows(X.page_text(items)) == [(1, "a b\nc"), (2, "")]
    assert X.page_text(items.limit(0)).count() == 0


def test_entries(spark):
    got = spark.createDataFrame([('{"title": [], "author": [{"family": "Li"}], "published-print": {"date-parts": [[2018]]}, "created": {"date-parts": [[2020]]}}',), ("{",), (None,)], "m string").select(B.crossref_entry(F.col("m")).alias("e")).collect()
    assert [g.e and (g.e.title, g.e.authors, g.e.year) for g in got] == [("(untitled)", ["Li"], "2018"), None, None]


def test_reports(spark):
    decks = spark.createDataFrame([(k,) for k in range(5)], "deck_id long")
    reports = spark.createDataFrame([(0, '{"rework": []}'), (1, '{"rework": [{"slide": 2}]}'), (2, "{"), (3, '{"mean": 1}')], "deck_id long, report string")
    assert rows(D.review_findings(decks, reports)) == [(1, "aesthetics-rework-open", "P2"), (2, "aesthetics-report-invalid", "P2"), (3, "aesthetics-report-invalid", "P2"), (4, "aesthetics-not-run", "P3")]
    scores = spark.createDataFrame([(1, s, {"space": v, "figures": None}) for s, v in ((1, 4), (2, 3), (3, 2), (4, 4))] + [(2, 1, {"space": None})], "deck_id long, slide int, dims map<string,int>")
    assert rows(D.aesthetics(scores)) == [(1, 19.5, 1, "3,2,1")]


def test_atom_entry(spark):
    feed = lambda inner: f'<?xml version="1.0" encoding="UTF-8"?>\n<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><title>q</title>{inner}</feed>'
    cases = [
        (feed('<entry><id>http://arxiv.org/abs/2001.00001v2</id><published>2020-01-02</published><title type="html"> A &amp;\n <![CDATA[B <x>]]> <!-- no -->C</title><author><name>Ana Li</name><name/></author><author><name> Bo\n Roe </name></author><arxiv:doi>10.1/x</arxiv:doi><arxiv:journal_ref>J</arxiv:journal_ref></entry><entry><id>other</id></entry>'), ("A & B <x> C", ["Ana Li", "", "Bo Roe"], "2020", "J", "10.1/x", "2001.00001")),
        (feed("<entry><title>first</title><title>second</title><doi>not arXiv's</doi><id>x</id></entry>"), ("first", [], None, "arXiv preprint", None, None)),
        (feed("<entry/>"), ("", [], None, "arXiv preprint", None, None)),
        ("<feed><entry><title>bare</title></entry></feed>", ("bare", [], None, "arXiv preprint", None, None)),
        (feed(""), None), ("<rss><entry/></rss>", None), ("", None), (None, None),
    ]
    rows = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(cases)], "k int, x string").select("k", B.atom_entry(F.col("x")).alias("e"))
    assert {r.k: r.e and tuple(r.e) for r in rows.collect()} == {k: e for k, (_, e) in enumerate(cases)}
    with pytest.raises(Exception, match="ParseError"):
        spark.createDataFrame([("<feed><entry>",)], "x string").select(B.atom_entry(F.col("x"))).collect()


def test_feeds_are_parsed_once(spark):
    """One function for all fields and for the filter: a path of its own for each parsed a feed up to twenty times."""
    plan = rules.atom_entry(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_feed_entry(") == 1 and "xpath" not in plan, plan
