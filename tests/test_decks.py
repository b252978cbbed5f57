"""Literal pages of every layout, and PPTX files written and read back."""

import json
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from folioguard.operators import deck as D
from folioguard.operators import layouts as L
from folioguard.operators import parity as P
from folioguard.plans import catalogue
from folioguard.plans.decks import pptx_bytes
from folioguard.sources import pptx as X


def rendered(spark, slides, meta=None, pictures=None):
    decks = spark.createDataFrame([(1, json.dumps({"meta": meta or {}, "slides": slides}))], "deck_id long, spec string")
    sizes = spark.createDataFrame([(1, s, size) for s, size in (pictures or {}).items()], "deck_id long, src string, size struct<width: long, height: long>")
    return [r.html for r in L.slide_html(L.slides_to_render(decks), sizes).orderBy("slide").collect()]


def page(layout, cls, inner, notes=""):
    return f'<section data-layout="{layout}"><div class="slide-inner {cls}">{inner}</div>{notes}</section>'


def bar(title, eyebrow=""):
    return f'<div class="s-title-bar">{eyebrow}<h2 class="s-action-title">{title}</h2></div>'


REF = '<div class="s-source"><span class="cite">p. 3 &amp; 4</span></div>'
PAGES = [
    (
        {"layout": "paper-title", "title": "On $x^2$ & ==k|more==", "authors": ["Ann", "Bob"], "affiliation": "Lab <1>", "venue": "", "presenter": "Eve"},
        page("paper-title", "s-paper-title", '<h1>On <span class="math inline">\\(x^2\\)</span> &amp; <span class="key">more</span></h1><div class="authors">Ann, Bob</div><div class="affil">Lab &lt;1&gt;</div><div class="presenter">Eve</div>'),
    ),
    ({"layout": "paper-title", "title": "T", "authors": "Ann"}, page("paper-title", "s-paper-title", '<h1>T</h1><div class="authors">Ann</div>')),
    ({"layout": "section", "title": "Methods", "num": "2"}, page("section", "s-section", '<div class="num">2</div><h2>Methods</h2>')),
    (
        {"layout": "outline-agenda", "title": "Plan", "items": ["a", "b"], "current": 1, "source_ref": "not shown"},
        page("outline-agenda", "s-agenda", bar("Plan") + '<div class="s-body"><ol><li class="">a</li><li class="cur">b</li></ol></div>'),
    ),
    (
        {"layout": "assertion-evidence", "title": "t", "action_title": "It works", "eyebrow": "A'", "figure": {"src": "f/a.png", "caption": "Cap", "cite": "Fig. 1"}, "annotation": "==w|but==", "source_ref": "p. 3 & 4", "speaker_notes": 'say "it"'},
        page("assertion-evidence", "s-ae", bar("It works", '<div class="s-eyebrow">A&#39;</div>') + '<div class="s-body"><figure class="s-figure"><img src="f/a.png" alt="Cap" style="object-fit:contain"><figcaption>Cap <span class="cite">[Fig. 1]</span></figcaption></figure><div class="s-annotation"><span class="warn">but</span></div></div>' + REF, '<aside class="notes">say &quot;it&quot;</aside>'),
    ),
    (
        {"layout": "assertion-evidence", "title": "Hero", "figure": {"src": "wide.png", "caption": "Cap", "hero": True}, "source_ref": "p. 3 & 4"},
        page("assertion-evidence", "s-ae s-ae--hero", bar("Hero") + '<div class="s-body"><figure class="s-figure"><img src="wide.png" alt="figure" class="wide" style="--fig-ar:2.50" style="object-fit:contain"></figure></div><div class="s-source">Cap · <span class="cite">p. 3 &amp; 4</span></div>'),
    ),
    ({"layout": "assertion-evidence", "title": "Bare"}, page("assertion-evidence", "s-ae", bar("Bare") + '<div class="s-body"></div>')),
    (
        {"layout": "equation", "title": "E", "equations": [{"latex": "a<b", "num": "1", "numbered": True}, {"latex": "c"}], "note": "where $$y$$", "source_ref": "p. 3 & 4"},
        page("equation", "s-equation", bar("E") + '<div class="s-body"><div class="eq"><span class="math display">\\[a&lt;b\\]</span><span class="eq-num">(1)</span></div><div class="eq"><span class="math display">\\[c\\]</span></div><div class="note">where <span class="math display">\\[y\\]</span></div></div>' + REF),
    ),
    (
        {"layout": "results-table", "title": "R", "table": {"columns": ["A", {"label": "B", "unit": "%"}], "rows": [["x", {"v": 1, "bold": True}]], "row_header": True}},
        page("results-table", "s-results", bar("R") + '<div class="s-body"><table class="results roomy"><thead><tr><th>A</th><th>B<span class="u">%</span></th></tr></thead><tbody><tr><th>x</th><td><strong>1</strong></td></tr></tbody></table></div>'),
    ),
    (
        {"layout": "two-column", "title": "C", "points": ["p"], "text": "unused", "figure": {"src": "sq.png", "fit": "cover", "alt": "A"}},
        page("two-column", "s-two-col", bar("C") + '<div class="s-body"><div class="cols"><div class="col-text"><ul><li>p</li></ul></div><div class="col-fig"><figure class="s-figure"><img src="sq.png" alt="A" style="object-fit:cover"></figure></div></div></div>'),
    ),
    ({"layout": "two-column", "title": "C", "text": "a < b", "points2": ["q"]}, page("two-column", "s-two-col", bar("C") + '<div class="s-body"><div class="cols"><div class="col-text">a &lt; b</div><div class="col-fig"><ul><li>q</li></ul></div></div></div>')),
    ({"layout": "critique-concerns", "title": "Q", "points": [{"head": "H", "body": "B"}]}, page("critique-concerns", "s-critique", bar("Q") + '<div class="s-body"><div class="pt"><div class="head">H</div><div class="body">B</div></div></div>')),
    ({"layout": "discussion-questions", "title": "D", "questions": ["why?"]}, page("discussion-questions", "s-discussion", bar("D") + '<div class="s-body"><ul><li>why?</li></ul></div>')),
    ({"layout": "bullets", "title": "L", "points": ["==+1==", "b"], "source_ref": "p. 3 & 4"}, page("bullets", "s-bullets", bar("L") + '<div class="s-body"><ul><li><span class="metric">+1</span></li><li>b</li></ul></div>' + REF)),
    ({"layout": "references", "title": "Refs", "entries": ["a", "b", "c"]}, page("references", "s-references", bar("Refs") + '<div class="s-body"><ol class="single"><li>a</li><li>b</li><li>c</li></ol></div>')),
    ({"layout": "references", "title": "Refs", "entries": list("abcd")}, page("references", "s-references", bar("Refs") + '<div class="s-body"><ol><li>a</li><li>b</li><li>c</li><li>d</li></ol></div>')),
    ({"layout": "bullets", "title": "None"}, page("bullets", "s-bullets", bar("None") + '<div class="s-body"><ul></ul></div>')),
    ({"layout": "invented", "title": "x"}, None),
    ({"layout": "results-table", "title": "x", "table": {"rows": []}}, None),
    ({"layout": "assertion-evidence", "title": "x", "figure": {"caption": "no file"}}, None),
]


def test_every_layout(spark):
    assert {s["layout"] for s, html in PAGES if html} == set(D.LAYOUTS)
    got = rendered(spark, [s for s, _ in PAGES], pictures={"wide.png": (500, 200), "sq.png": (100, 100)})
    for (spec, want), html in zip(PAGES, got):
        assert html == want, spec


def test_page(spark):
    fine = [s for s, html in PAGES if html]
    specs = {1: {"meta": {"title": "A <b>", "theme": "conference", "language": "zh"}, "slides": fine}, 2: {"slides": fine[:1]}, 3: {"slides": [{"layout": "invented"}]}, 4: {"slides": []}}
    decks = spark.createDataFrame([(k, json.dumps(v)) for k, v in specs.items()], "deck_id long, spec string")
    shown, printed = ({r.deck_id: r.html for r in L.deck_html(decks, p).collect()} for p in (False, True))
    assert shown[1].startswith('<!doctype html>\n<html lang="zh">\n<head>\n<meta charset="utf-8">') and "<title>A b</title>" in shown[1] and "\n".join(html for _, html in PAGES if html and "wide.png" not in html)[:300] in shown[1]
    assert "assets/conference.css" in shown[1] and "assets/journal-club.css" in shown[2] and '<html lang="en">' in shown[2] and "<title>Slides</title>" in shown[2]
    assert "reveal.js" in shown[1] and "reveal" not in printed[1].replace('class="reveal"', "") and "print.css" in printed[1] and "print.css" not in shown[1]
    assert shown[3] is None and 'class="slides">\n\n</div>' in shown[4]


def test_pages_pass_the_checks(spark):
    """The static checks of built decks find nothing in what is built here but pictures that are not there."""
    slides = [s for s, html in PAGES if html]
    decks = spark.createDataFrame([(1, json.dumps({"slides": slides}))], "deck_id long, spec string")
    pages = L.deck_html(decks).withColumnRenamed("deck_id", "page_id")
    files = spark.createDataFrame([(1, s["figure"]["src"]) for s in slides if "figure" in s], "page_id long, src string")
    assert D.html_problems(pages, files).collect() == []
    assert {r.check for r in D.html_problems(pages, files.limit(0)).collect()} == {"missing-image"}


def written(tmp_path, **files):
    for name, content in files.items():
        (tmp_path / f"{name}.pptx").write_bytes(content)
    return str(tmp_path)


def test_pptx_files(spark, tmp_path):
    slides = [
        {"title": "First & <last>", "text": "one\ntwo", "notes": "say it", "picture": True, "rows": [["a", "5"], ["", "9"]], "grouped": "unseen"},
        {"text": "", "film": True},
        {},
    ]
    path = written(tmp_path, deck=pptx_bytes(slides), empty=pptx_bytes([]), bad=b"PK no zip", cut=pptx_bytes(slides)[:200])
    (tmp_path / "notes.txt").write_text("no deck")
    shapes = X.pptx_shapes(X.pptx_files(spark, path)).cache()
    got = {(r.deck_id.rsplit("/", 1)[-1], r.slide): tuple(r)[2:] for r in X.built_slides(shapes).collect()}
    assert got == {
        ("deck.pptx", 1): ("First\v& <last> \n a \n 5 \n  \n 9 \n one\ntwo", "say it", ["a", "5", "", "9"], True, True),
        ("deck.pptx", 2): ("", "", [], False, False), ("deck.pptx", 3): ("", "", [], False, False),
    }
    assert {r.deck_id.rsplit("/", 1)[-1] for r in X.unreadable(shapes).collect()} == {"bad.pptx", "cut.pptx"}


def test_pptx_without_parts(spark, tmp_path):
    """A link to a part that is not there makes a file unreadable as a whole."""
    path = tmp_path / "x.pptx"
    path.write_bytes(pptx_bytes([{"text": "a"}, {"text": "b"}]))
    with zipfile.ZipFile(path) as z:
        kept = {n: z.read(n) for n in z.namelist() if n != "ppt/slides/slide1.xml"}
    with zipfile.ZipFile(path, "w") as z:
        for n, content in kept.items():
            z.writestr(n, content)
    assert [r.kind for r in X.pptx_shapes(X.pptx_files(spark, str(tmp_path))).collect()] == ["unreadable"]


@pytest.mark.parametrize("change,want", [
    ({}, []),
    ({"text": "other"}, [(2, "missing-text", "points[0]"), (2, "missing-text", "points[1]")]),
    ({"notes": None}, [(2, "missing-notes", "")]),
    ({"picture": False}, [(2, "missing-figure", "")]),
    ({"title": "One thing"}, [(2, "missing-text", "title")]),
])
def test_parity_against_files(spark, tmp_path, change, want):
    spec = [
        {"layout": "results-table", "title": "Numbers", "table": {"rows": [["5", "9"], ["5", {"v": "x"}]]}},
        {"layout": "bullets", "title": "Two things", "points": ["==k|one== is $n$", "three"], "speaker_notes": "Say it", "figure": {"src": "f.png"}},
    ]
    built = [{"title": "Numbers only", "rows": [["5", "9"], ["5", "x"]]}, {"title": "Two things", "text": "One is n\nTHREE", "notes": "say  it", "picture": True} | change]
    path = written(tmp_path, d=pptx_bytes(built))
    shown = X.built_slides(X.pptx_shapes(X.pptx_files(spark, path).withColumn("deck_id", F.lit(1).cast("long"))))
    slides = D.slides_of(spark.createDataFrame([(1, json.dumps({"slides": spec}))], "deck_id long, spec string"))
    assert sorted((r.slide, r.kind, r.field) for r in P.parity_findings(slides, shown).collect()) == want


def test_cells_of_a_file_serve_once(spark, tmp_path):
    spec = [{"layout": "results-table", "title": "N", "table": {"rows": [["5", "5"], ["9"]]}}, {"layout": "section", "title": "End"}]
    path = written(tmp_path, d=pptx_bytes([{"title": "N n", "rows": [["5", "59"]], "text": "5 9"}]))
    shown = X.built_slides(X.pptx_shapes(X.pptx_files(spark, path).withColumn("deck_id", F.lit(1).cast("long"))))
    slides = D.slides_of(spark.createDataFrame([(1, json.dumps({"slides": spec}))], "deck_id long, spec string"))
    assert sorted((r.slide, r.kind, r.field) for r in P.parity_findings(slides, shown).collect()) == [(0, "slide-count", "2/1"), (1, "missing-text", "table.cell[1]"), (1, "missing-text", "table.cell[2]")]


def test_numbers_are_made_once(spark):
    """Tokens meet their source in one join; they were derived twice, once to ask for the distinct ones."""
    plan = catalogue.QUERIES["ungrounded_numbers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and len(re.findall(r"\bJoin ", plan)) == 1, plan
    rows = [(1, 1, "results-table", "points[0]", "in 12 and 1² or 34. of 34.5, 12"), (2, 1, "bullets", "title", "77"), (None, 1, "bullets", "title", "88")]
    fields = spark.createDataFrame(rows, "deck_id long, slide int, layout string, field string, text string")
    got = D.ungrounded_numbers(fields, spark.createDataFrame([(1, "has 34.  5 and ¹²"), (3, "77")], "deck_id long, source string"))
    assert sorted(map(tuple, got.collect()), key=str) == [(2, 1, "title", "77", "P2"), (None, 1, "title", "88", "P2")]
