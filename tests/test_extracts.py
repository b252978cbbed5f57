"""Literal fixtures of panels, parity, tables, readers and text helpers."""

import json
import re

import pytest
from pyspark.sql import functions as F

from folioguard.functions import text as H
from folioguard.operators import deck as D
from folioguard.operators import geometry as G
from folioguard.operators import manuscript as M
from folioguard.operators import parity as P
from folioguard.operators import reports as W
from folioguard.operators import tables as T
from folioguard.plans import extracts
from folioguard.sources import readers

BOX = "x0 double, y0 double, x1 double, y1 double"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def panels(spark, spans, box=(0.0, 0.0, 300.0, 200.0)):
    figures = spark.createDataFrame([(1, 1, *box)], f"fig_id long, page_id long, {BOX}")
    rows = [(1, t, f, float(s), float(x), float(y), x + 5.0, y + 8.0) for t, f, s, x, y in spans]
    df = spark.createDataFrame(rows, f"page_id long, text string, font string, size double, {BOX}")
    return {r.label: (r.x0, r.y0, r.x1, r.y1) for r in G.panel_boxes(figures, df).collect()}


def test_panels(spark):
    grid = [("a", "B", 9, 0, 0), ("b", "B", 9, 100, 1), ("c", "B", 9, 200, 0), ("d", "B", 9, 1, 100)]
    caption = [(x, "T", 7, 10 * k, 190) for k, x in enumerate("abcd")]
    want = {"a": (0, 0, 100, 100), "b": (100, 1, 200, 200), "c": (200, 0, 300, 200), "d": (1, 100, 300, 200)}
    assert panels(spark, grid + caption) == want  # a tie in letters goes to the larger font
    assert panels(spark, grid[:2]) == {}  # too few
    assert panels(spark, [("A", *g[1:]) for g in grid]) == {}  # capitals are no panels
    assert set(panels(spark, [g for g in grid if g[0] != "b"])) == set()  # a gap ends the run
    assert set(panels(spark, [*grid, ("e", "B", 9, 900, 0)])) == set("abcd")  # outside of the figure
    assert panels(spark, [*grid, ("a", "B", 9.4, 250, 150)])["a"] == want["a"]  # the topmost one of a letter counts


def test_panel_clip(spark):
    boxes = spark.createDataFrame([(1, "a", 0.0, 5.0, 99.5, 50.0)], f"fig_id long, label string, {BOX}")
    asked = spark.createDataFrame([(1, "a"), (1, "z")], "fig_id long, label string")
    pages = spark.createDataFrame([(1, 100.0, 100.0)], "fig_id long, page_w double, page_h double")
    got = {r.label: (r.x0, r.y0, r.x1, r.y1, r.found) for r in G.panel_clips(asked, boxes, pages).collect()}
    assert got == {"a": (0, 4, 100, 51, True), "z": (None,) * 4 + (False,)}


BUILT = "deck_id long, slide long, text string, notes string, cells array<string>, has_picture boolean, has_table boolean"


def parity(spark, slides, built):
    s = D.slides_of(spark.createDataFrame([(1, json.dumps({"slides": slides}))], "deck_id long, spec string"))
    b = spark.createDataFrame([(1, k + 1, *x) for k, x in enumerate(built)], BUILT)
    return sorted((r.slide, r.kind, r.field) for r in P.parity_findings(s, b).collect())


def test_parity(spark):
    slides = [
        {"layout": "paper-title", "title": "A $x^2$ study", "authors": ["Ann", "Bob"], "presenter": "P"},
        {"layout": "results-table", "action_title": "Wins", "title": "ignored", "table": {"caption": "Cap", "rows": [["5", {"v": 9}], ["5", None]]}, "speaker_notes": "say it"},
        {"layout": "assertion-evidence", "title": "T", "figure": {"src": "f.png", "caption": "==k|C== one"}, "annotation": ""},
        {"layout": "critique-concerns", "title": "T", "points": [{"head": "h", "body": "b"}, {"head": "gone"}]},
        {"layout": "two-column", "title": "T", "points": ["left"], "text": "mid", "points2": ["right"]},
    ]
    fine = [
        ("A x^2  STUDY Ann, Bob p", None, None, False, False), ("wins cap 5 9 5", "Say  it", ["5", "9", "5"], False, True), ("t c one", "", None, True, False), ("T h b gone", None, None, False, False), ("T left mid right", None, None, None, None),
    ]
    assert parity(spark, slides, fine) == []
    broken = [
        ("A study Ann", None, None, False, False), ("wins cap 59", "", ["59", "5"], False, False), ("t c", "", None, False, False), ("T h b", None, None, False, False), ("T leftmost mid", None, None, None, None),
    ]
    assert parity(spark, slides, broken) == sorted([
        (1, "missing-text", "title"), (1, "missing-text", "authors"), (1, "missing-text", "presenter"), (2, "missing-text", "table.cell[1]"), (2, "missing-text", "table.cell[2]"), (2, "missing-notes", ""), (2, "missing-table", ""),
        (3, "missing-text", "figure.caption"), (3, "missing-figure", ""), (4, "missing-text", "points[1].head"), (5, "missing-text", "points[0]"), (5, "missing-text", "points2[0]"),
    ])
    assert parity(spark, slides, fine[:4]) == [(0, "slide-count", "5/4")]
    no_cells = parity(spark, slides[1:2], [("wins cap 5", "say it", None, False, True)])
    assert no_cells == [(1, "missing-text", "table.cell[1]")]  # without cells, one 5 vouches for two


def test_tables(spark):
    spec = {"caption": "C", "columns": ["M", {"label": "Acc", "unit": "%"}], "rows": [["a<b", {"v": 28.4, "bold": True}], [None, 7]], "row_header": True}
    df = spark.createDataFrame([(1, json.dumps(spec)), (2, '{"rows":[]}'), (3, "nope"), (4, None)], "table_id long, spec string")
    html = {r.table_id: r.html for r in T.as_html(df).collect()}
    assert html[1] == (
        '<table class="results roomy"><caption>C</caption><thead><tr><th>M</th><th>Acc<span class="u">%</span></th></tr></thead><tbody>'
        "<tr><th>a&lt;b</th><td><strong>28.4</strong></td></tr><tr><th></th><td>7</td></tr></tbody></table>"
    )
    assert html[2] is html[3] is html[4] is None
    got = [(r.row, r.col, r.text, r.bold, r.align) for r in T.table_rows(df).orderBy("row", "col").collect()]
    assert got == [(0, 0, "M", True, "center"), (0, 1, "Acc (%)", True, "center"), (1, 0, "a<b", False, "left"), (1, 1, "28.4", True, "right"), (2, 0, "", False, "left"), (2, 1, "7", False, "right")]


def test_texts(spark):
    assert value(spark, H.render_emphasis(F.lit("a ==b== ==k|c== ==p|d== ==w|e f== = ==g"))) == 'a <span class="metric">b</span> <span class="key">c</span> <span class="pos">d</span> <span class="warn">e f</span> = ==g'
    assert [tuple(x) for x in value(spark, H.math_segments(F.lit("$$a\nb$$ in $c$, 5$ and\n6$")))] == [("display", "a\nb"), ("prose", " in "), ("inline", "c"), ("prose", ", 5$ and\n6$")]
    assert value(spark, H.math_segments(F.lit(None).cast("string"))) == []
    kinds = {"1706.03762v2": ("arxiv", "1706.03762"), "https://arxiv.org/pdf/2101.00001": ("arxiv", "2101.00001"), "2101.1": ("unknown", None)}
    for arg, want in kinds.items():
        assert tuple(value(spark, H.source_kind(F.lit(arg), F.lit(False)))) == want
    stems = {"a/b/My Paper.v2.pdf": "My_Paper_v2", ".hidden": "_hidden", "": "source", "x/": "source", "论文 1.pdf": "论文_1"}
    assert [value(spark, H.source_stem(F.lit(k))) for k in stems] == list(stems.values())
    assert value(spark, H.with_extension(F.lit("a.b/c.png"), F.lit("image/jpeg"))) == "a.b/c.jpg"
    assert value(spark, H.citation_numbers(F.lit("[1, 12345678901] [3, 99999999999999999999]"))) == [1, 12345678901, 3]


def test_readers(spark, tmp_path):
    write = lambda name, v: (tmp_path / name).write_text(v if isinstance(v, str) else json.dumps(v))
    write("a.ingest.json", {"path": "a.pdf", "n_pages": 3, "full_text": "text", "meta": {"title": "T", "arxiv_id": None}})
    write("b.ingest.json", {"n_pages": 1})
    write("c.ingest.json", "not json")
    got = {r.doc_id.rsplit("/", 1)[-1][0]: (r.n_pages, r.full_text, r.title) for r in readers.ingests(spark, f"{tmp_path}/*.ingest.json").collect()}
    assert got == {"a": (3, "text", "T"), "b": (1, "", None), "c": (None, None, None)}
    write("figures.json", [{"id": "figure-1", "kind": "figure", "number": "1", "figure_bbox": [10, 20, 110, 70], "min_font_pt": 6.5, "page": 2, "panels": [{"label": "a", "bbox": [10, 20, 60, 70]}]}, {"id": "table-2", "kind": "table", "number": "2", "figure_bbox": None}])
    figures = readers.figures(spark, f"{tmp_path}/figures.json")
    assert sorted((r.id, r.page, r.panels[0].label if r.panels else None) for r in figures.collect()) == [("figure-1", 2, "a"), ("table-2", None, None)]
    assert [tuple(r) for r in readers.figure_meta(figures).collect()] == [("figure-1", 6.5, 100.0, 50.0)]
    write("q.json", ["one", "two"])
    assert [r.query for r in readers.bib_queries(spark, f"{tmp_path}/q.json", ("zero",)).collect()] == ["zero", "one", "two"]
    write("m1.json", {"decks": [{"name": "d1", "dir": "out/d1"}]})
    write("m2.json", [{"name": "d2", "dir": "out/d2"}])
    assert sorted(tuple(r) for r in readers.manifest(spark, f"{tmp_path}/m?.json").collect()) == [("d1", "out/d1"), ("d2", "out/d2")]
    for name in ("01-a.md", "01-a.txt", "02-b.txt", "x.png"):
        write(name, "p")
    outputs = spark.createDataFrame([("02-b", 20_000), ("01-a", 10)], "stem string, bytes long")
    assert [(r.stem, r.suffix) for r in readers.pending(readers.prompts(spark, str(tmp_path)).where("stem LIKE '0%'"), outputs).collect()] == [("01-a", ".md")]


def test_orders(spark):
    rows = [(1, 1, "table", "II"), (1, 1, "figure", "10"), (1, 1, "figure", "2"), (1, 2, "figure", "1"), (1, 2, "table", "IX"), (1, 3, "table", "3a")]
    df = spark.createDataFrame(rows, "doc_id long, page long, kind string, number string")
    assert [(r.kind, r.number) for r in G.inventory_order(df).orderBy("place").collect()][:3] == [("figure", "10"), ("figure", "2"), ("table", "II")]
    assert [r.number for r in G.figure_order(df).orderBy("place").collect()] == ["1", "2", "10", "II", "3a", "IX"]


def test_unreadable_decks_reach_the_gate(spark):
    specs = [(1, '{"slides":[{"layout":"section","title":"T"}]}'), (2, "no"), (3, "{}"), (4, None), (5, '{"slides":[]}'), (6, "[]")]
    decks = spark.createDataFrame(specs, "deck_id long, spec string")
    findings = D.deck_problems(decks).unionByName(D.qa_findings(D.slides_of(decks), spark.createDataFrame([], "deck_id long, source string")))
    gates = {r.deck_id: r.gate for r in D.qa_gate(findings, decks).collect()}
    assert gates == {1: "PASS", **dict.fromkeys(range(2, 7), "BLOCK")}
    assert {r.category for r in D.deck_problems(decks).collect()} == {"unreadable", "no-slides"}


def test_reviews_are_the_union_of_their_checks(spark):
    spec = {"slides": [
        {"layout": "bullets", "title": "==a== ==p|b== ==w|c== 12 and 345", "points": ["N = 99 🚀", {"head": "12", "body": "[MISSING] 99"}]}, {"layout": "bullets", "points": ["x"]}, {"layout": "bullets", "points": ["7 77"]}, {"layout": "bullets", "points": ["y"]},
        {"layout": "results-table", "source_ref": "s", "table": {"rows": [["12", {"v": "88"}]]}}, {"layout": None}, {"layout": "assertion-evidence", "source_ref": "s", "title": "T", "figure": {"src": "a", "caption": "c" * 250, "cite": "55"}, "annotation": "n"},
        {"layout": "references", "entries": ["44 [UNVERIFIED x]"]},
    ]}
    decks = spark.createDataFrame([(1, json.dumps(spec)), (2, json.dumps({"slides": [{"layout": "section", "title": "66"}]}))], "deck_id long, spec string")
    sources = spark.createDataFrame([(1, "12 and 9. 9 and 77")], "deck_id long, source string")
    s = D.slides_of(decks)
    f, mix = D.fields(s), D.layout_mix(s)
    want = [(r.deck_id, r.severity, "number") for r in D.ungrounded_numbers(f, sources).collect()] + [(r.deck_id, "P2", "flag") for r in D.deck_flags(f).collect()]
    for name, df in (("emphasis", D.emphasis_over(f)), ("emoji", D.emoji_audit(f)), ("crowding", D.figure_crowding(s)), ("bullets", mix.where("bullet_ratio > 1/3D")), ("run", mix.where("max_run >= 4"))):
        want += [(r.deck_id, "P3", name) for r in df.collect()]
    want += [(r.deck_id, "P0", "spec") for r in D.spec_problems(s).where("severity = 'error'").collect()]
    assert {w[2] for w in want} == {"number", "flag", "emphasis", "emoji", "crowding", "bullets", "run", "spec"}
    assert sorted(tuple(r) for r in D.qa_findings(s, sources).collect()) == sorted(want)
    assert D.longest_run(s, "deck_id", "slide", "layout").where("deck_id = 1").first().max_run == mix.where("deck_id = 1").first().max_run == 4


def test_audit_without_a_second_exchange(spark):
    """Windows, entries and documents share one exchange by doc_id."""
    lines = M.lines_of(spark.createDataFrame([(k, f"A [1]\n## References\n[1] X {k}") for k in range(50)], "doc_id long, text string"))
    df = M.audit(lines)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1, plan


@pytest.mark.parametrize("setting", ["true", "false"])
def test_unions_group_alike_with_partitioning_on_and_off(spark, setting):
    """A union of parts that are hashed alike must not be grouped without an exchange that it needs."""
    from folioguard.plans import catalogue as C
    from folioguard.plans import extracts  # noqa: F401 (registers its queries)

    key = "spark.sql.unionOutputPartitioning"
    before = spark.conf.get(key, None)
    spark.conf.set(key, setting)
    try:
        rows = C.QUERIES["finding_summary"](spark, "/root/testdata/sf0.001").collect()
        parts = C.QUERIES["parity_findings"](spark, "/root/testdata/sf0.001").groupBy("deck_id").count().collect()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    assert len(rows) == len({r.doc_id for r in rows}) > 1000 and len(parts) == len({r.deck_id for r in parts}) > 500


def test_audit_of_a_long_bibliography(spark):
    """Citations meet the entries of a long manuscript as the operators for single checks find them; numbers without an entry, repeated ones and entries without names included."""
    cited = [f"{'Wang' if k % 3 else 'Kim'} et al. [{k * 7 % 260 + 1}] reported units [{k * 11 % 300}]." for k in range(400)]
    entries = [f"[{k}] " + ("" if k % 17 == 0 else f"{'Wang' if k % 2 else 'Kim'} A, Jones B. Part {k}.") for k in range(1, 251)] + ["[5] Sato C. Again.", "[99999999999] Kim D."]
    docs = [(1, "\n".join([*cited, "## References", *entries])), (2, "\n".join(cited)), (None, "\n".join([*cited[:9], "## References", *entries[:3]])), (3, None)]
    rows = M.lines_of(spark.createDataFrame(docs, "doc_id long, text string"))
    zoned = M.with_zones(rows).where("doc_id IS NOT NULL")
    refs, cites = M.bibliography(zoned), M.citations(zoned)
    want = M.missing_references(cites, refs).unionByName(M.author_mismatches(zoned, refs)).unionByName(M.uncited_references(cites, refs)).unionByName(M.references_not_detected(cites, refs))
    kinds = ["missing_reference", "author_citation_mismatch", "uncited_reference", "references_not_detected"]
    got = M.audit(rows).where(F.col("category").isin(*kinds))
    plain = lambda df: sorted(tuple(r[c] for c in ("doc_id", "severity", "category", "line_no", "detail")) for r in df.collect())
    known = plain(got.where("doc_id IS NOT NULL"))
    assert known == plain(want) and {r[2] for r in known} == set(kinds)
    assert got.where("doc_id IS NULL AND category = 'missing_reference'").count() > 0


def test_cheap_checks_lose_nothing(spark):
    """Lines that a pattern matches pass what is asked before it, and the short way reads the same numbers."""
    said = ["a XXX b", "see [tbd]", "x):xXx", "DOI: 10.1/xx", "To Be Added", "TO BE DECLARED", "a Figure Placeholder", "xx", "10.1/x", "tbd", None]
    lines = spark.createDataFrame([(1, k, x) for k, x in enumerate(said)], "doc_id int, line_no int, line string")
    assert {r.line_no for r in M.placeholders(lines).collect()} == set(range(7))
    cases = {"a [3]": [3], "[0]": [], "[007] b": [7], "[1] [0] [2]": [1, 2], f"[{10**18 - 1}]": [10**18 - 1], f"[{10**18}]": [], f"[{'0' * 18}1]": [], "[x [4]": [4], "a\n[5]\n": [5], "[1, 0]": [], "none": []}
    rows = spark.createDataFrame([(x,) for x in cases], "x string").select("x", H.citation_numbers(F.col("x")).alias("n")).collect()
    assert {r.x: r.n for r in rows} == cases


def test_results_of_audits(spark):
    """Out of a document's row come the same results as out of findings and joins; documents without findings stay in reports only."""
    texts = [(1, "# A Systematic Review\nfoo et al. [1] [TBD]\n## References\n[2] Roe A. X. doi:10.1234/a doi:10.1234/a"), (2, "# Plain\nnothing"), (None, "#### 1. H\nOur SYSTEMATIC\nreview of x")]
    lines = M.lines_of(spark.createDataFrame(texts, "doc_id long, text string")).cache()
    found, audits, refs = M.audit(lines), M.audits(lines), M.bibliography(M.with_zones(lines))
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert {(r.doc_id, r.category) for r in found.collect()} >= {(1, "unsupported_systematic_claim"), (1, "missing_reference"), (1, "duplicate_doi"), (None, "numbered_heading"), (None, "h4_heading"), (None, "unsupported_systematic_claim")}
    assert rows(M.summaries(audits)) == rows(M.severity_summary(found)) and rows(M.gates(audits)) == rows(M.gate(found)) and rows(M.gates(audits, "critical")) == rows(M.gate(found, "critical"))
    assert rows(M.markdowns(audits)) == rows(M.as_markdown(found))
    named = lambda df: [r for r in rows(df) if r[0] is not None]
    assert named(W.audited_documents(audits)) == named(W.audit_documents(lines, found, refs)) and audits.count() == 3


def test_audits_are_made_once(spark):
    """audit_json read its lines three times and joined what it made of them."""
    plan = extracts.audit_json(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and len(re.findall(r"Relation \[", plan)) == 1, plan
