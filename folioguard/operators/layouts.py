"""Decks as HTML: each registered layout is one expression over a slide's fields, so a deck compiles into one projection.

Formulas stay text between ``\\(``, ``\\)`` or ``\\[``, ``\\]`` in a span of class math, for a renderer in the browser. A slide that cannot be
shown (unknown layout, figure without file, malformed table) has no html, and a deck with such a slide has none either;
``deck.spec_problems`` says why.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioguard.functions import text as H
from folioguard.operators import tables as T

SPEC = (
    "meta STRUCT<title: STRING, language: STRING, theme: STRING>, slides ARRAY<STRUCT<layout: STRING, title: STRING, action_title: STRING, eyebrow: STRING, note: STRING, annotation: STRING, source_ref: STRING, "
    "speaker_notes: STRING, text: STRING, num: STRING, authors: VARIANT, affiliation: STRING, venue: STRING, presenter: STRING, current: INT, points: ARRAY<VARIANT>, points2: ARRAY<STRING>, "
    "questions: ARRAY<STRING>, items: ARRAY<STRING>, entries: ARRAY<STRING>, equations: ARRAY<STRUCT<latex: STRING, num: STRING, numbered: BOOLEAN>>, "
    f"figure: STRUCT<src: STRING, caption: STRING, cite: STRING, alt: STRING, fit: STRING, hero: BOOLEAN>, table: {T.TABLE_STRUCT}>>"
)
# Classes of a slide by layout, themes, and the files and settings of a page.
CLASSES = {"paper-title": "s-paper-title", "section": "s-section", "outline-agenda": "s-agenda", "equation": "s-equation", "results-table": "s-results", "two-column": "s-two-col", "critique-concerns": "s-critique", "discussion-questions": "s-discussion", "bullets": "s-bullets", "references": "s-references", "assertion-evidence": "s-ae"}
THEMES = ("journal-club", "conference")
WIDE = 2.2
SINGLE_LIST = 4
STYLES = ("katex.min.css", "tokens.css", "viewport-base.css", "base-theme.css")
SCRIPTS = """<script src="assets/reveal.js"></script>
<script src="assets/notes.js"></script>
<script>
Reveal.initialize({ width: 1920, height: 1080, margin: 0.0, center: false,
  controls: true, progress: true, hash: true, slideNumber: 'c/t', transition: 'none',
  plugins: [ RevealNotes ] });
</script>"""


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def _tag(name: str, inner: Column, cls: str | None = None) -> Column:
    return F.concat(F.lit(f'<{name} class="{cls}">' if cls else f"<{name}>"), inner, F.lit(f"</{name}>"))


def _if(c: Column, html: Column) -> Column:
    """``html`` where the text ``c`` is filled, else nothing."""
    return F.when(_filled(c), html).otherwise("")


def formula(latex: Column, display: Column) -> Column:
    inner = F.when(display, F.concat(F.lit("\\["), H.escape_html(latex), F.lit("\\]"))).otherwise(F.concat(F.lit("\\("), H.escape_html(latex), F.lit("\\)")))
    return F.concat(F.when(display, '<span class="math display">').otherwise('<span class="math inline">'), inner, F.lit("</span>"))


def rich_text(s: Column) -> Column:
    """Prose escaped, emphasis as spans, formulas marked; null is empty."""
    part = lambda p: F.when(p["kind"] == "prose", H.render_emphasis(H.escape_html(p["text"]))).otherwise(formula(p["text"], p["kind"] == "display"))
    return F.array_join(F.transform(H.math_segments(s), part), "")


def _each(items: Column, html) -> Column:
    return F.coalesce(F.array_join(F.transform(items, html), ""), F.lit(""))


def _plain(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _cite(c: Column) -> Column:
    return F.when(_filled(c), F.concat(F.lit(' <span class="cite">['), H.escape_html(c), F.lit("]</span>"))).otherwise("")


def _figure(f: Column, ratio: Column, caption: Column) -> Column:
    """Null without a file. A picture as wide as WIDE times its height is sized by its ratio."""
    alt = F.coalesce(F.nullif(f["alt"], F.lit("")), F.nullif(caption, F.lit("")), F.lit("figure"))
    fit = F.when(f["fit"] == "cover", "cover").otherwise("contain")
    wide = F.when(ratio >= WIDE, F.format_string(' class="wide" style="--fig-ar:%.2f"', ratio)).otherwise("")
    image = F.concat(F.lit('<img src="'), H.escape_html(f["src"]), F.lit('" alt="'), H.escape_html(alt), F.lit('"'), wide, F.lit(' style="object-fit:'), fit, F.lit('">'))
    return F.when(_filled(f["src"]), _tag("figure", F.concat(image, _if(caption, _tag("figcaption", F.concat(H.escape_html(caption), _cite(f["cite"]))))), "s-figure"))


def _inner(c) -> dict[str, Column]:
    """What stands inside a slide, by layout; ``c`` gives a field of the slide."""
    title = F.coalesce(F.nullif(c("action_title"), F.lit("")), c("title"))
    bar = _tag("div", F.concat(_if(c("eyebrow"), _tag("div", H.escape_html(c("eyebrow")), "s-eyebrow")), _tag("h2", rich_text(title), "s-action-title")), "s-title-bar")
    ref = _tag("span", H.escape_html(c("source_ref")), "cite")
    source = _if(c("source_ref"), _tag("div", ref, "s-source"))
    body = lambda *inner: _tag("div", F.concat(*inner), "s-body")
    item = lambda s: _tag("li", rich_text(s))
    small = lambda field, cls: _if(c(field), _tag("div", H.escape_html(c(field)), cls))
    listed = lambda field, get=lambda x: x: _tag("ul", _each(c(field), lambda x: item(get(x))))

    names = F.try_variant_get(c("authors"), "$", "array<string>")
    authors = F.coalesce(F.array_join(names, ", "), _plain(c("authors")))
    figure = c("figure")
    hero = F.coalesce(figure["hero"], F.lit(False))
    shown = F.when(figure.isNull(), "").otherwise(_figure(figure, c("ratio"), F.when(~hero, figure["caption"])))
    # The caption of a figure that fills the slide stands in the foot, and its alternative text is still "figure".
    credit = F.array_join(F.array_compact(F.array(F.when(_filled(figure["caption"]), F.concat(H.escape_html(figure["caption"]), _cite(figure["cite"]))), F.when(_filled(c("source_ref")), ref))), " · ")
    foot = F.when(hero & (credit != ""), _tag("div", credit, "s-source")).otherwise(source)
    beside = F.when(figure.isNull(), listed("points2")).otherwise(_figure(figure, c("ratio"), figure["caption"]))
    number = lambda e: F.when(F.coalesce(e["numbered"], F.lit(False)), _tag("span", F.concat(F.lit("("), H.escape_html(e["num"]), F.lit(")")), "eq-num")).otherwise("")
    point = lambda p: _tag("div", F.concat(*(_tag("div", rich_text(F.try_variant_get(p, f"$.{k}", "string")), k) for k in ("head", "body"))), "pt")
    step = lambda s, i: F.concat(F.when(i.eqNullSafe(c("current")), '<li class="cur">').otherwise('<li class="">'), rich_text(s), F.lit("</li>"))
    entries = F.concat(F.when(F.coalesce(F.size(c("entries")), F.lit(0)) < SINGLE_LIST, '<ol class="single">').otherwise("<ol>"), _each(c("entries"), item), F.lit("</ol>"))
    left = F.when(c("points").isNotNull(), listed("points", _plain)).otherwise(rich_text(c("text")))
    return {
        "paper-title": F.concat(_tag("h1", rich_text(c("title"))), _if(authors, _tag("div", H.escape_html(authors), "authors")), small("affiliation", "affil"), small("venue", "venue"), small("presenter", "presenter")),
        "section": F.concat(small("num", "num"), _tag("h2", rich_text(c("title")))),
        "outline-agenda": F.concat(bar, body(_tag("ol", _each(c("items"), step)))),
        "assertion-evidence": F.concat(bar, body(shown, _if(c("annotation"), _tag("div", rich_text(c("annotation")), "s-annotation"))), foot),
        "equation": F.concat(bar, body(_each(c("equations"), lambda e: _tag("div", F.concat(formula(F.coalesce(e["latex"], F.lit("")), F.lit(True)), number(e)), "eq")), _if(c("note"), _tag("div", rich_text(c("note")), "note"))), source),
        "results-table": F.concat(bar, body(T.html_of(c("table"))), source),
        "two-column": F.concat(bar, body(_tag("div", F.concat(_tag("div", left, "col-text"), _tag("div", beside, "col-fig")), "cols")), source),
        "critique-concerns": F.concat(bar, body(_each(c("points"), point)), source),
        "discussion-questions": F.concat(bar, body(listed("questions"))),
        "bullets": F.concat(bar, body(listed("points", _plain)), source),
        "references": F.concat(bar, body(entries)),
    }


def slides_to_render(decks: DataFrame) -> DataFrame:
    """deck_id, slide (from 1) and the fields of SPEC's slides, from decks (deck_id, spec JSON)."""
    rows = decks.select("deck_id", F.posexplode(F.from_json("spec", SPEC)["slides"]).alias("k", "s"))
    return rows.select("deck_id", (F.col("k") + 1).cast("long").alias("slide"), "s.*")


def slide_html(slides: DataFrame, pictures: DataFrame | None = None) -> DataFrame:
    """deck_id, slide, html of ``slides_to_render``; ``pictures`` (deck_id, src, size: struct<width, height>) tells the shape of figures."""
    if pictures is None:
        slides = slides.withColumn("ratio", F.lit(None).cast("double"))
    else:
        ratio = (F.col("size.width") / F.col("size.height")).alias("ratio")
        known = pictures.select(F.col("deck_id").alias("_deck"), F.col("src").alias("_src"), ratio)
        slides = slides.join(known, (F.col("deck_id") == F.col("_deck")) & (F.col("figure.src") == F.col("_src")), "left").drop("_deck", "_src")
    html = F.lit(None).cast("string")
    for layout, inner in _inner(F.col).items():
        cls = F.lit(CLASSES[layout])
        if layout == "assertion-evidence":
            cls = F.when(F.coalesce(F.col("figure.hero"), F.lit(False)), f"{CLASSES[layout]} {CLASSES[layout]}--hero").otherwise(cls)
        notes = _if(F.col("speaker_notes"), _tag("aside", H.escape_html(F.col("speaker_notes")), "notes"))
        whole = F.concat(F.lit(f'<section data-layout="{layout}"><div class="slide-inner '), cls, F.lit('">'), inner, F.lit("</div>"), notes, F.lit("</section>"))
        html = F.when(F.col("layout") == layout, whole).otherwise(html)
    return slides.select("deck_id", "slide", html.alias("html"))


def deck_html(decks: DataFrame, printed: bool = False, pictures: DataFrame | None = None, untitled: str = "Slides") -> DataFrame:
    """deck_id, html: the page of each deck (deck_id, spec JSON), to present or to print. Decks without slides give a page without slides."""
    meta = decks.select("deck_id", F.from_json("spec", SPEC)["meta"].alias("meta"))
    parts = slide_html(slides_to_render(decks), pictures).groupBy("deck_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slide", "html"))), lambda s: s["html"]), "\n").alias("body"), F.bool_or(F.col("html").isNull()).alias("broken")
    )
    rows = meta.join(parts, "deck_id", "left")
    title = F.regexp_replace(F.coalesce(F.nullif(F.col("meta.title"), F.lit("")), F.lit(untitled)), "[<>]", "")
    theme = F.when(F.col("meta.theme").isin(*THEMES), F.col("meta.theme")).otherwise(THEMES[0])
    link = lambda name: F.concat(F.lit('<link rel="stylesheet" href="assets/'), name, F.lit('">'))
    names = [*([] if printed else ["reveal.css"]), *STYLES]
    links = F.array_join(F.array(*(link(F.lit(n)) for n in names), link(F.concat(theme, F.lit(".css"))), *([link(F.lit("print.css"))] if printed else [])), "\n")
    html = F.concat(
        F.lit('<!doctype html>\n<html lang="'), F.coalesce(F.nullif(F.col("meta.language"), F.lit("")), F.lit("en")), F.lit('">\n<head>\n<meta charset="utf-8">\n<meta name="viewport" content="width=device-width, initial-scale=1">\n<title>'),
        title, F.lit("</title>\n"), links, F.lit('\n</head>\n<body>\n<div class="reveal"><div class="slides">\n'), F.coalesce("body", F.lit("")), F.lit("\n</div></div>\n" + ("" if printed else SCRIPTS) + "\n</body>\n</html>"),
    )
    return rows.select("deck_id", F.when(~F.coalesce("broken", F.lit(False)), html).alias("html"))
