"""Literal fixtures with values known beforehand."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from folioguard.functions import text as H
from folioguard.operators import bib as B
from folioguard.operators import deck as D
from folioguard.operators import geometry as G
from folioguard.operators import manuscript as M
from folioguard.operators import parity as P
from folioguard.sources import readers
from folioguard.streaming.findings import line_findings


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def findings(spark, text):
    lines = M.lines_of(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    return [r.category for r in M.audit(lines).collect()]


@pytest.mark.parametrize(
    "line,want",
    [("[1, 3-5]", [1, 3, 4, 5]), ("[0]", []), ("[5-3]", []), ("[1,0]", []), ("[1-60]", []), ("[1-51]", list(range(1, 52))), ("[1–3]", []), ("[1-]", []), ("a [2] b [7, 9]", [2, 7, 9])],
)
def test_citation_numbers(spark, line, want):
    assert value(spark, H.citation_numbers(F.lit(line))) == want


def test_manuscripts(spark):
    refs = "\n## References\n[1] Wang A, Li B. Study one.\n[2] Xu C. Study two.\n   continued here\n"
    assert "missing_reference" in findings(spark, "See [7] and [1].\n" + refs)
    assert findings(spark, "See [1] and [2].\n" + refs) == []
    assert findings(spark, "A [1] [2] [3].") == ["references_not_detected"]
    assert findings(spark, "Wang et al. [1] and Smith et al. [2].\n" + refs) == ["author_citation_mismatch"]
    assert findings(spark, "见 [1] [2]。\n## 参考文献：\n[1] 王. 一.\n[2] 李. 二.\n") == []
    assert findings(spark, "See Box 1.\n$$x$$\n## Box 1\n$$y$$\n") == ["display_equation_outside_box"]
    assert findings(spark, "# T\nWe conducted a systematic review of parts.\n") == ["unsupported_systematic_claim"]
    assert findings(spark, "# T\nThis is not a systematic review. Earlier systematic reviews exist.\n") == []
    entries = M.bibliography(M.with_zones(M.lines_of(spark.createDataFrame([(1, "x" + refs)], "doc_id long, text string")))).collect()
    assert {r.ref_no: r.entry for r in entries} == {1: "Wang A, Li B. Study one.", 2: "Xu C. Study two. continued here"}


def test_lines(spark):
    rows = M.lines_of(spark.createDataFrame([(1, "a\r\nb c\n"), (2, ""), (3, None)], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.line_no, r.line) for r in rows] == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c")]


def test_texts(spark):
    assert value(spark, H.number_tokens(F.lit("28.4 and 2.3·10¹⁹"))) == ["28.4", "2.3", "1019"]
    assert value(spark, H.rejoin_decimals(F.lit("34.\n1 and 6. 3"))) == "34.1 and 6.3"
    assert [value(spark, H.roman(F.lit(x))) for x in ("XIV", "MCMXC", "abc")] == [14, 1990, None]
    assert value(spark, H.contains_whole(F.lit("about 59 units"), F.lit("5"))) is False
    assert value(spark, H.emphasis_roles(F.lit("==a== ==k|b== ==p|c== ==w|d=="))) == ["key", "metric", "pos", "warn"]
    assert value(spark, H.minutes(F.lit("word " * 260))) == 2 and value(spark, H.minutes(F.lit("字" * 240))) == 1
    assert value(spark, H.clock(F.lit(0.995))) == "1:00" and value(spark, H.clock_faithful(F.lit(0.995))) == "0:60"
    assert value(spark, H.html_placeholders(F.lit("&lt;presenter&gt; &lt; 日期 &gt; &lt;eos&gt;"))) == ["<presenter>", "<日期>"]


def test_whole_words_against_a_search_of_all_places(spark):
    r = random.Random(6)
    some = ["a", "b", "1", " ", ".", "A", "é", "😀", "\\E", "\n"]
    rows = [("".join(r.choice(some) for _ in range(r.randint(0, 12))), "".join(r.choice(some[: r.choice((3, 10))]) for _ in range(r.randint(0, 3)))) for _ in range(4_000)]
    rows += [("xa a a", "a a"), ("a", "a"), ("ab a", "a"), ("", "a"), ("", "")]

    def whole(h, n):
        word = lambda c: c.isascii() and (c.isdigit() or c.islower())
        at = [i for i in range(len(h) - len(n) + 1) if h.startswith(n, i)]
        return n == "" or any(not (i and word(h[i - 1])) and not word(h[i + len(n) : i + len(n) + 1] or " ") for i in at)

    df = spark.createDataFrame([*rows, (None, "a"), ("a", None), (None, "")], "h string, n string")
    got = df.select("h", "n", H.contains_whole(F.col("h"), F.col("n")), F.element_at(F.transform(F.array("n"), lambda n: H.contains_whole(F.col("h"), n)), 1)).collect()
    assert [tuple(x) for x in got if x[0] is None or x[1] is None] == [(None, "a", None, None), ("a", None, None, None), (None, "", True, True)]
    assert [x for x in got if None not in x[:2] and not x[2] == x[3] == whole(x[0], x[1])] == []
    assert sum(x[2] or False for x in got) > 300


def test_deck(spark):
    spec = '{"slides":[{"layout":"results-table","title":"T","table":{"rows":[["A",{"v":"28.4","bold":true}],["29.1",7]]}},{"layout":"bullets","points":["N = 6",{"head":"h","body":"b"}],"entries":["x [UNVERIFIED]"]},{"layout":"odd"}]}'
    s = D.slides_of(spark.createDataFrame([(1, spec)], "deck_id long, spec string"))
    f = D.fields(s)
    got = {(r.slide, r.field): r.text for r in f.collect()}
    assert got[1, "table[0][1]"] == "28.4" and got[1, "table[1][1]"] == "7" and got[2, "points[0]"] == "N = 6" and got[2, "points[1].body"] == "b"
    src = spark.createDataFrame([(1, "BLEU 28.4")], "deck_id long, source string")
    assert [(r.value, r.severity) for r in D.ungrounded_numbers(f, src).collect()] == [("29.1", "P1")]
    assert [r.flag for r in D.deck_flags(f).collect()] == ["[UNVERIFIED]"]
    assert {(r.slide, r.field, r.severity) for r in D.spec_problems(s).collect()} == {(1, "source_ref", "warn"), (3, "layout", "error")}
    assert D.notes_handout(s).first().handout.startswith("## Slide 1 — T  _(0:30)_")


def test_layout_mix(spark):
    rows = [(1, i, x) for i, x in enumerate(["bullets", "bullets", "bullets", "section", "bullets", "equation"])]
    r = D.layout_mix(spark.createDataFrame(rows, "deck_id long, slide long, layout string")).first()
    assert (r.slides, r.bullets, r.max_run) == (6, 4, 3) and abs(r.bullet_ratio - 4 / 6) < 1e-12


def test_geometry(spark):
    rects = [(1, float(a), float(b), float(c), float(d)) for a, b, c, d in ((100, 540, 200, 590), (60, 530, 120, 560), (300, 550, 500, 598), (100, 100, 500, 200))]
    caps = spark.createDataFrame([(1, 7, "figure", 100.0, 600.0, 400.0, 620.0, 800.0), (2, 8, "table", 0.0, 10.0, 5.0, 20.0, 800.0)], "page_id long, caption_id long, kind string, x0 double, y0 double, x1 double, y1 double, page_h double")
    got = {r.caption_id: (r.x0, r.y0, r.x1, r.y1) for r in G.region_grow(caps, spark.createDataFrame(rects, "page_id long, x0 double, y0 double, x1 double, y1 double")).collect()}
    assert got == {7: (60, 530, 500, 600), 8: (None,) * 4}
    blocks = spark.createDataFrame([(1, 1, 0, "Figure 1: The model"), (1, 1, 1, "Figure 1 shows a much longer sentence about it"), (1, 1, 2, "As in Figure 2"), (1, 1, 3, "TABLE III Results")], "doc_id long, page long, pos long, text string")
    assert {(r.kind, r.number, r.caption) for r in G.best_captions(G.captions(blocks)).collect()} == {("figure", "1", "Figure 1: The model"), ("table", "III", "TABLE III Results")}


def test_bib(spark):
    rows = {"arXiv:1706.03762v5": ("arxiv", "1706.03762"), "doi:10.1000/xyz": ("doi", "10.1000/xyz"), "Attention Is All": ("title", "Attention Is All")}
    for q, want in rows.items():
        assert tuple(value(spark, B.classified(F.lit(q)))) == want
    pairs = [("Attention Is All You Need", "attention is all you need", True), ("Attention Is All You Need", "Is Attention All You Need?", False), ("Deep residual learning", "Deep Residual Learning: for images", True), ("Short", "Short title", False)]
    df = spark.createDataFrame(pairs, "query string, result string, want boolean")
    assert all(r.matched == r.want for r in B.title_match(df).collect())


def test_parity(spark):
    cells = lambda want, found: value(spark, P.missing_cells(F.array(*map(F.lit, want)), F.array(*map(F.lit, found))))
    assert cells(["5", "9"], ["59"]) == ["5", "9"]
    assert cells(["5", "5"], ["5"]) == ["5"]
    assert cells(["a+b", "Total"], ["x", "total (a+b)", "a+b"]) == ["Total"]  # first fit takes the longer cell


def test_sources(spark, tmp_path):
    (tmp_path / "m.md").write_text("# T\nxxx\n")
    assert readers.manuscripts(spark, str(tmp_path / "m.md")).count() == 2
    for d in ("a", "a/slides"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "01-slide-x.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 640, 480))
    rows = readers.images(spark, str(tmp_path / "a")).collect()
    assert [(r.number, r.format, r.size.width, r.size.height) for r in rows] == [(1, "png", 640, 480)]
    prompts = spark.createDataFrame([("s1", ".md"), ("s1", ".txt"), ("s2", ".txt")], "stem string, suffix string")
    assert [(r.stem, r.suffix) for r in readers.pending(prompts, spark.createDataFrame([("s2", 20_000), ("s1", 9)], "stem string, bytes long")).collect()] == [("s1", ".md")]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, 1, "[TBD]"), (1, 2, "fine")], "doc_id long, line_no long, line string").write.parquet(str(tmp_path / "in"))
    q = line_findings(spark.readStream.schema("doc_id long, line_no long, line string").parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.category for r in spark.table("found").collect()] == ["placeholder"]


def test_audit_is_the_union_of_its_checks(spark):
    texts = [
        "# A Systematic Review\nXXX here, Cleerly et al.\n## 1.2 Part\n$$x$$\n#### Box 1\n$$y$$\n| Cleerly | a |\nWang et al. [1] and Li and Wu [2, 4-6] [9]\nWang et al. [1], Li and Wu [2], Kim et al. [3]\n"
        "## References\n[1] Wang A. doi:10.1234/a\n[2] Smith B. doi:10.1234/A.\n[2] Later C.\n more\n[3]  x\n[7] y 10.1234/a 10.1234/a",
        "Wang et al. [1] [2-3] [TBD]\nno bibliography, which may suggest growth",
        "## References\n[1] Nobody cites this\n[2] lower case only",
        "", None, "## References",
        "Kim et al. [1]\n## References\n1. 1234 no names\n## References\n[1] Kim C.",
    ]
    lines = M.lines_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    z = M.with_zones(lines)
    refs, cites = M.bibliography(z), M.citations(z)
    parts = [M.placeholders(lines), M.headings(lines), M.phrase_tells(lines), M.display_equations(lines), M.unsupported_systematic(lines), M.vendor_mentions(z)]
    parts += [M.missing_references(cites, refs), M.author_mismatches(z, refs), M.uncited_references(cites, refs), M.references_not_detected(cites, refs), M.duplicate_dois(refs)]
    want = sorted(tuple(r) for p in parts for r in p.collect())
    assert {w[2] for w in want} >= {"placeholder", "missing_reference", "author_citation_mismatch", "uncited_reference", "references_not_detected", "duplicate_doi", "display_equation_outside_box", "vendor_body_mention"}
    assert sorted(tuple(r) for r in M.audit(lines).collect()) == want
    assert M.audit(lines.where("false")).count() == 0
