"""Deck audits. A deck is JSON; its slides are rows, and its texts the relation ``fields``
(deck_id, slide, layout, field, text) that most audits read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioguard.functions import text as H

# Fixed values.
LAYOUTS = ("paper-title", "section", "outline-agenda", "assertion-evidence", "two-column", "equation", "results-table", "critique-concerns", "discussion-questions", "bullets", "references")
REQUIRED = {"paper-title": "title", "section": "title", "outline-agenda": "items", "equation": "equations", "results-table": "table", "critique-concerns": "points", "discussion-questions": "questions", "bullets": "points", "references": "entries"}
FACTUAL = ("assertion-evidence", "results-table", "equation", "two-column")
VOID_EXEMPT = ("paper-title", "section", "equation", "references", "assertion-evidence")
SLIDE_IMAGE = r"(?i)^(\d+)-slide-.*\.(?:png|jpg|jpeg)$"
DECK = (
    "meta STRUCT<title: STRING>, slides ARRAY<STRUCT<layout: STRING, title: STRING, action_title: STRING, note: STRING, annotation: STRING, source_ref: STRING, "
    "speaker_notes: STRING, points: ARRAY<VARIANT>, questions: ARRAY<STRING>, items: ARRAY<STRING>, entries: ARRAY<STRING>, equations: ARRAY<VARIANT>, "
    "figure: STRUCT<src: STRING, caption: STRING, cite: STRING, hero: BOOLEAN>, table: STRUCT<caption: STRING, footnote: STRING, rows: ARRAY<ARRAY<VARIANT>>>, "
    "authors: VARIANT, affiliation: STRING, venue: STRING, presenter: STRING, num: STRING, eyebrow: STRING, text: STRING, points2: ARRAY<STRING>>>"
)
PAIRS = "array<struct<field:string,text:string>>"


def slides_of(decks: DataFrame) -> DataFrame:
    """deck_id, slide (from 1) and the fields of DECK, from decks (deck_id, spec JSON). Decks without slides give no rows; see ``deck_problems``."""
    rows = decks.select("deck_id", F.posexplode(F.from_json("spec", DECK)["slides"]).alias("k", "s"))
    return rows.select("deck_id", (F.col("k") + 1).cast("long").alias("slide"), "s.*")


def deck_problems(decks: DataFrame) -> DataFrame:
    """deck_id, severity, category of decks (deck_id, spec JSON) that cannot be read as an object, or have no slides."""
    read = F.try_parse_json("spec")
    slides = F.size(F.from_json("spec", DECK)["slides"])
    found = F.when(F.coalesce(~F.schema_of_variant(read).startswith("OBJECT"), F.lit(True)), "unreadable").when(F.coalesce(slides, F.lit(0)) <= 0, "no-slides")
    return decks.select("deck_id", F.lit("P0").alias("severity"), found.alias("category")).where("category IS NOT NULL")


def _pair(name: Column, text: Column) -> Column:
    return F.struct(name.alias("field"), text.alias("text"))


def _at(name: str, *places: Column) -> Column:
    return F.concat(F.lit(name), *(x for i in places for x in (F.lit("["), i.cast("string"), F.lit("]"))))


def _many(name: str, c: Column) -> Column:
    return F.coalesce(F.transform(c, lambda x, i: _pair(_at(name, i), x)), F.array().cast(PAIRS))


def cell_text(cell: Column) -> Column:
    """A table cell's text: the value of an object, else the cell itself."""
    return F.when(F.schema_of_variant(cell).startswith("OBJECT"), F.try_variant_get(cell, "$.v", "string")).otherwise(F.try_variant_get(cell, "$", "string"))


def audited(slides: DataFrame) -> Column:
    """array<struct<field, text>> of a slide's audited texts, blank ones included."""
    one = lambda name, text: F.array(_pair(F.lit(name), text))

    def point(p: Column, i: Column) -> Column:
        head, body = (F.try_variant_get(p, f"$.{k}", "string") for k in ("head", "body"))
        split = F.schema_of_variant(p).startswith("OBJECT")
        return F.when(split, F.array(_pair(F.concat(_at("points", i), F.lit(".head")), head), _pair(F.concat(_at("points", i), F.lit(".body")), body))).otherwise(F.array(_pair(_at("points", i), F.try_variant_get(p, "$", "string"))))

    def cell(r: Column, i: Column) -> Column:
        value = lambda c: F.coalesce(F.try_variant_get(c, "$.v", "string"), F.try_variant_get(c, "$", "string"))
        return F.transform(r, lambda c, j: _pair(_at("table", i, j), value(c)))

    none = F.array().cast(PAIRS)
    return F.concat(
        *(one(n, F.col(n)) for n in ("action_title", "title", "note", "annotation")),
        F.coalesce(F.flatten(F.transform("points", point)), none),
        *(_many(n, F.col(n)) for n in ("questions", "items", "entries")),
        one("figure.caption", F.col("figure.caption")),
        one("figure.cite", F.col("figure.cite")),
        one("table.caption", F.col("table.caption")),
        one("table.footnote", F.col("table.footnote")),
        F.coalesce(F.flatten(F.transform(F.col("table.rows"), cell)), none),
    )


def fields(slides: DataFrame) -> DataFrame:
    """All audited texts of the slides; blank ones are left out."""
    rows = slides.select("deck_id", "slide", "layout", F.explode(audited(slides)).alias("f"))
    return rows.select("deck_id", "slide", "layout", "f.field", "f.text").where("text IS NOT NULL AND trim(text) <> ''")


def deck_flags(fields: DataFrame) -> DataFrame:
    return fields.select("deck_id", "slide", "field", F.explode(H.flags(F.col("text"))).alias("flag"))


def ungrounded_numbers(fields: DataFrame, sources: DataFrame) -> DataFrame:
    """Numbers of two characters or more that the deck's source (deck_id, source) does not contain.

    Tokens are made once and meet their deck's source as they are; a deck without a source grounds nothing.
    """
    audited = fields.where("field <> 'figure.cite' AND NOT startswith(field, 'entries[')")
    tokens = audited.select("deck_id", "slide", "layout", "field", F.explode(H.number_tokens(F.col("text"))).alias("value")).where("length(value) >= 2")
    met = tokens.join(sources.select("deck_id", H.rejoin_decimals(H.map_superscripts(F.col("source"))).alias("source")), "deck_id", "left")
    missing = met.where(~F.coalesce(F.contains("source", "value"), F.lit(False)))
    factual = F.col("field").startswith("table[") | F.col("layout").isin("results-table", "equation")
    return missing.select("deck_id", "slide", "field", "value", F.when(factual, "P1").otherwise("P2").alias("severity"))


def longest_run(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """``group``, max_run: the longest run of one value in order (gaps and islands)."""
    w = Window.partitionBy(group).orderBy(order)
    island = F.row_number().over(w) - F.row_number().over(Window.partitionBy(group, value).orderBy(order))
    return rows.withColumn("island", island).groupBy(group, value, "island").count().groupBy(group).agg(F.max("count").alias("max_run"))


def _longest(values: Column) -> Column:
    """The longest run of one value (null included) in an array."""
    zero = F.struct(F.lit(None).cast("string").alias("v"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("best"))

    def step(a: Column, v: Column) -> Column:
        n = F.when((a["n"] > 0) & a["v"].eqNullSafe(v), a["n"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(v.alias("v"), n.alias("n"), F.greatest(a["best"], n).alias("best"))

    return F.aggregate(values, zero, step, lambda a: a["best"])


def layout_mix(slides: DataFrame, group: str = "deck_id", order: str = "slide", layout: str = "layout", bullet: str = "bullets") -> DataFrame:
    """``group``, slides, bullets, max_run (the longest run of one layout), bullet_ratio; one exchange."""
    own = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(layout).alias("l")))).alias("x")
    rows = slides.groupBy(group).agg(F.count("*").alias("slides"), F.count_if(F.col(layout) == bullet).alias("bullets"), own)
    return rows.select(group, "slides", "bullets", _longest(F.col("x.l")).alias("max_run"), (F.col("bullets") / F.col("slides")).alias("bullet_ratio"))


def layout_counts(slides: DataFrame) -> DataFrame:
    """deck_id, layout, slides: how many slides of a deck have each layout."""
    return slides.groupBy("deck_id", "layout").agg(F.count("*").alias("slides"))


def emphasis_over(fields: DataFrame, most: int = 2) -> DataFrame:
    """Slides with more than ``most`` added roles; key is free."""
    roles = fields.select("deck_id", "slide", F.explode(H.emphasis_roles(F.col("text"))).alias("role")).where("role <> 'key'").distinct()
    return roles.groupBy("deck_id", "slide").agg(F.count("*").alias("added")).where(F.col("added") > most)


def emoji_audit(fields: DataFrame) -> DataFrame:
    return fields.select("deck_id", "slide", "field", F.array_join(H.emojis(F.col("text")), "").alias("chars")).where("chars <> ''")


def _crowding() -> Column:
    chars = F.length(H.strip_emphasis(F.col("figure.caption"))) + F.length(H.strip_emphasis(F.col("annotation")))
    return F.when((F.col("layout") == "assertion-evidence") & F.col("figure").isNotNull(), chars.cast("long"))


def figure_crowding(slides: DataFrame, most: int = 240) -> DataFrame:
    return slides.select("deck_id", "slide", _crowding().alias("chars")).where(F.col("chars") > most)


def _problems(slides: DataFrame) -> Column:
    """array<struct<field, severity>> of a slide's problems."""

    def empty(name: str) -> Column:
        c = F.col(name)
        kind = slides.schema[name].dataType.typeName()
        return F.coalesce(F.size(c) == 0, F.lit(True)) if kind == "array" else c.isNull() if kind == "struct" else F.coalesce(F.trim(c) == "", F.lit(True))

    p = lambda field, severity: F.struct(F.lit(field).alias("field"), F.lit(severity).alias("severity"))
    known = F.col("layout").isin(*LAYOUTS)
    checks = [F.when(~F.coalesce(known, F.lit(False)), p("layout", "error"))]
    checks += [F.when((F.col("layout") == k) & empty(f), p(f, "error")) for k, f in REQUIRED.items()]
    checks += [F.when(F.col("layout").isin(*FACTUAL) & empty("source_ref"), p("source_ref", "warn")), F.when(known & F.col("figure.hero") & ~empty("annotation"), p("annotation", "error"))]
    return F.array_compact(F.array(*checks))


def spec_problems(slides: DataFrame) -> DataFrame:
    """Unknown layouts, missing fields, absent provenance, annotated hero figures."""
    rows = slides.select("deck_id", "slide", "layout", F.explode(_problems(slides)).alias("p"))
    return rows.select("deck_id", "slide", "layout", "p.field", "p.severity")


def talk_timing(notes: DataFrame, group: str, floor: float = 0.5) -> DataFrame:
    """Per ``group``: slides, minutes (each slide at least ``floor``) and slides without notes, of (group, notes)."""
    spoken = F.greatest(H.minutes(F.col("notes")), F.lit(floor))
    return notes.groupBy(group).agg(F.count("*").alias("slides"), F.sum(spoken).alias("minutes"), F.count_if(F.coalesce(F.col("notes"), F.lit("")) == "").alias("without_notes"))


def budget_verdict(minutes: Column, budget: Column) -> Column:
    r = minutes / budget
    return F.when(r > 1.15, "over").when(r < 0.6, "under").otherwise("within")


def notes_handout(slides: DataFrame) -> DataFrame:
    """deck_id, handout: Markdown with each slide's title, time and notes."""
    spoken = F.greatest(H.minutes(F.col("speaker_notes")), F.lit(0.5))
    title = H.strip_inline_math(F.coalesce(F.nullif("action_title", F.lit("")), F.nullif("title", F.lit("")), F.concat(F.lit("("), "layout", F.lit(")"))))
    part = F.concat(F.lit("## Slide "), F.col("slide").cast("string"), F.lit(" — "), title, F.lit("  _("), H.clock(spoken), F.lit(")_\n"), F.coalesce(F.nullif("speaker_notes", F.lit("")), F.lit("_[no notes — add a spoken script]_")))
    rows = slides.select("deck_id", "slide", part.alias("part"))
    return rows.groupBy("deck_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slide", "part"))), lambda x: x["part"]), "\n\n").alias("handout"))


def deck_reviews(slides: DataFrame, sources: DataFrame) -> DataFrame:
    """deck_id, slides, bullets, max_run, findings (array<struct<severity, category>>) of every deck, in one pass.

    A slide's checks are one array each; the slides of a deck meet once, by deck_id, and its source (deck_id,
    source) once. What is gathered per deck are findings, distinct numbers and layouts, not its texts.
    """
    hit = lambda severity, category: F.struct(severity.alias("severity"), F.lit(category).alias("category"))
    always = lambda severity, category: lambda _: hit(F.lit(severity), category)
    once = lambda when, severity, category: F.array_compact(F.array(F.when(when, hit(F.lit(severity), category))))
    texts = F.filter(audited(slides), lambda f: f["text"].isNotNull() & (F.trim(f["text"]) != ""))
    rows = slides.select("deck_id", "slide", "layout", texts.alias("f"), _crowding().alias("chars"), _problems(slides).alias("problems"))
    roles = F.array_distinct(F.flatten(F.transform("f", lambda f: H.emphasis_roles(f["text"]))))
    found = F.concat(
        F.transform(F.flatten(F.transform("f", lambda f: H.flags(f["text"]))), always("P2", "flag")),
        once(F.size(F.array_remove(roles, "key")) > 2, "P3", "emphasis"),
        F.transform(F.filter("f", lambda f: F.size(H.emojis(f["text"])) > 0), always("P3", "emoji")),
        once(F.col("chars") > 240, "P3", "crowding"),
        F.transform(F.filter("problems", lambda p: p["severity"] == "error"), always("P0", "spec")),
    )
    grounded = F.filter("f", lambda f: (f["field"] != "figure.cite") & ~f["field"].startswith("entries["))
    factual = lambda f: F.when(f["field"].startswith("table[") | F.coalesce(F.col("layout").isin("results-table", "equation"), F.lit(False)), "P1").otherwise("P2")
    tokens = F.flatten(F.transform(grounded, lambda f: F.transform(F.filter(H.number_tokens(f["text"]), lambda v: F.length(v) >= 2), lambda v: F.struct(v.alias("value"), factual(f).alias("severity")))))
    rows = rows.select("deck_id", "slide", "layout", found.alias("found"), tokens.alias("tokens"))
    some = lambda c: F.flatten(F.collect_list(F.when(F.size(c) > 0, F.col(c)))).alias(c)
    layouts = F.array_sort(F.collect_list(F.struct("slide", "layout"))).alias("x")
    decks = rows.groupBy("deck_id").agg(F.count("*").alias("slides"), F.count_if(F.col("layout") == "bullets").alias("bullets"), some("found"), some("tokens"), layouts)
    decks = decks.select("deck_id", "slides", "bullets", "found", "tokens", F.array_distinct("tokens.value").alias("asked"), _longest(F.col("x.layout")).alias("max_run"))
    met = decks.join(sources.select("deck_id", H.rejoin_decimals(H.map_superscripts(F.col("source"))).alias("source")), "deck_id", "left")
    missing = F.filter("asked", lambda v: ~F.coalesce(F.contains("source", v), F.lit(False)))
    numbers = F.element_at(F.transform(F.array(missing), lambda m: F.transform(F.filter("tokens", lambda t: F.array_contains(m, t["value"])), lambda t: hit(t["severity"], "number"))), 1)
    nudges = F.concat(once(F.col("bullets") / F.col("slides") > F.expr("1 / 3D"), "P3", "bullets"), once(F.col("max_run") >= 4, "P3", "run"))
    return met.select("deck_id", "slides", "bullets", "max_run", F.concat("found", numbers, nudges).alias("findings"))


def qa_findings(slides: DataFrame, sources: DataFrame) -> DataFrame:
    """deck_id, severity, category of every check of a deck, the deck-wide nudges included."""
    return deck_reviews(slides, sources).select("deck_id", F.explode("findings").alias("f")).select("deck_id", "f.*")


def _gate() -> Column:
    return F.when(F.col("p0") > 0, "BLOCK").when(F.col("p1") > 0, "REVIEW").otherwise("PASS").alias("gate")


def gated(reviews: DataFrame) -> DataFrame:
    """``deck_reviews`` with p0 to p3, the findings of each severity, and gate."""
    n = lambda k: F.size(F.filter("findings", lambda f: f["severity"] == f"P{k}")).cast("long").alias(f"p{k}")
    return reviews.select("*", *(n(k) for k in range(4))).select("*", _gate())


def qa_gate(findings: DataFrame, decks: DataFrame) -> DataFrame:
    """deck_id, p0 to p3, gate: BLOCK on P0, REVIEW on P1, else PASS; decks without findings pass."""
    counts = findings.groupBy("deck_id").agg(*(F.count_if(F.col("severity") == f"P{k}").alias(f"p{k}") for k in range(4)))
    rows = decks.select("deck_id").distinct().join(counts, "deck_id", "left").na.fill(0)
    return rows.withColumn("gate", _gate())


def qa_report(findings: DataFrame) -> DataFrame:
    """deck_id, report of findings (deck_id, severity, stage, check, slide, detail): P0 first, with the number of each severity; slide 0 or null is the deck."""
    where = F.when(F.coalesce("slide", F.lit(0)) > 0, F.concat(F.lit("slide "), F.col("slide").cast("string"))).otherwise("deck")
    line = F.concat(F.lit("  • ("), "stage", F.lit("/"), "check", F.lit(") "), where, F.lit(": "), F.coalesce("detail", F.lit("")))
    rows = findings.where(F.col("severity").isin("P0", "P1", "P2", "P3")).groupBy("deck_id", "severity").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("slide", F.lit(0)).alias("s"), line.alias("line")))).alias("x"))
    part = F.concat(F.lit("["), "severity", F.lit("] "), F.size("x").cast("string"), F.lit("\n"), F.array_join("x.line", "\n"))
    return rows.groupBy("deck_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("severity", part.alias("part")))), lambda x: x["part"]), "\n\n").alias("report"))


def dashboard(manifest: DataFrame, reviews: DataFrame, parity: DataFrame) -> DataFrame:
    """One row per deck of the manifest, from ``gated`` reviews; missing decks and P0 or parity findings fail hard. parity: deck_id, issues."""
    rows = manifest.join(reviews.select("deck_id", "gate", "slides", "max_run"), "deck_id", "left").join(parity, "deck_id", "left")
    issues = F.coalesce("issues", F.lit(-1))
    status = F.when(F.col("gate").isNull(), "MISSING").otherwise(F.col("gate"))
    return rows.select("deck_id", status.alias("status"), F.coalesce("slides", F.lit(0)).alias("slides"), F.coalesce("max_run", F.lit(0)).alias("max_run"), issues.cast("long").alias("parity"), (status.isin("MISSING", "BLOCK") | (issues > 0)).alias("hard_fail"))


def canvas_voids(measures: DataFrame) -> DataFrame:
    """slide_id, check for bodies (layout, has_body, bottom, right) that leave the stage empty."""
    rows = measures.where(F.col("has_body") & ~F.col("layout").isin(*VOID_EXEMPT))
    checks = F.array_compact(F.array(F.when(1080 - F.col("bottom") > 400, "vertical-void"), F.when(F.col("right") < 0.62 * 1920, "horizontal-void")))
    return rows.select("slide_id", F.explode(checks).alias("check"))


def legibility(images: DataFrame, meta: DataFrame) -> DataFrame:
    """image_id, check, px for figures whose text gets too small.

    images: image_id, src, rendered, natural, natural_h; meta: key, min_font_pt, w, h. If the crop
    has the region's shape within a fifth, the smallest text's size on the slide decides (under 12 px);
    else a source of 1600 px or more shown below 0.45 of its size.
    """
    rows = images.where("rendered > 0").withColumn("key", H.crop_key(F.col("src"))).join(meta.where("w > 0 AND h > 0"), "key", "left")
    ratio, box = F.col("natural") / F.col("natural_h"), F.col("w") / F.col("h")
    trusted = (F.col("min_font_pt") > 0) & F.coalesce(F.when(F.col("natural_h") > 0, F.abs(ratio - box) <= 0.2 * box), F.lit(True))
    px = F.col("min_font_pt") * F.col("rendered") / F.col("w")
    small = F.when(F.coalesce(trusted, F.lit(False)), F.when(px < 12, "figure-text-illegible")).otherwise(F.when((F.col("natural") >= 1600) & (F.col("rendered") / F.col("natural") < 0.45), "figure-compressed"))
    return rows.select("image_id", small.alias("check")).where("check IS NOT NULL")


def html_problems(pages: DataFrame, files: DataFrame) -> DataFrame:
    """page_id, check, detail of built pages (page_id, html) against known layouts and present files (page_id, src)."""
    rows = lambda c, severity, check, most=None: pages.select("page_id", F.explode(F.slice(c, 1, most) if most else c).alias("detail"), F.lit(severity).alias("severity"), F.lit(check).alias("check"))
    html = F.col("html")
    unknown = F.filter(H.data_layouts(html), lambda x: ~x.isin(*LAYOUTS))
    missing = rows(H.image_sources(html), "P1", "missing-image").where(~F.col("detail").rlike("^https?://")).join(files.select("page_id", F.col("src").alias("detail")), ["page_id", "detail"], "left_anti")
    katex = pages.withColumn("n", H.katex_errors(html)).where("n > 0").select("page_id", F.col("n").cast("string").alias("detail"), F.lit("P1").alias("severity"), F.lit("katex").alias("check"))
    out = rows(unknown, "P0", "layout-lock").unionByName(rows(F.array_distinct(H.html_placeholders(html)), "P1", "placeholder")).unionByName(missing)
    return out.unionByName(katex).unionByName(rows(H.unrendered_math(html), "P2", "unrendered-math", 3))


def render_findings(measures: DataFrame, font_floor: float = 18.0, slack: float = 2.0) -> DataFrame:
    """slide_id, check, severity of measured slides (slide_id, overflow_x, overflow_y, katex_errors, broken_images, min_font)."""
    hit = lambda when, check, severity: F.when(when, F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity")))
    checks = F.array_compact(F.array(
        hit(F.col("overflow_y") > slack, "overflow-y", "P1"), hit(F.col("overflow_x") > slack, "overflow-x", "P1"), hit(F.col("katex_errors") > 0, "katex-error", "P1"),
        hit(F.col("broken_images") > 0, "broken-image", "P1"), hit(F.col("min_font") < font_floor, "font-too-small", "P2"),
    ))
    return measures.select("slide_id", F.explode(checks).alias("c")).select("slide_id", "c.*")


def equations_of(slides: DataFrame) -> DataFrame:
    """deck_id, slide, eq (from 0), latex, num of the slides' equations (variants)."""
    rows = slides.select("deck_id", "slide", F.posexplode("equations").alias("eq", "e"))
    return rows.select("deck_id", "slide", F.col("eq").cast("long").alias("eq"), F.try_variant_get("e", "$.latex", "string").alias("latex"), F.try_variant_get("e", "$.num", "string").alias("num"))


def aesthetics(scores: DataFrame, floor: int = 18, lowest: int = 2) -> DataFrame:
    """deck_id, mean, rework, weakest of scored slides (deck_id, slide, dims: map of name to score or null).

    rework: slides below ``floor`` in total or with a score up to ``lowest``; totals leave null scores out and are scaled to six dimensions.
    weakest: the three slides with the smallest totals. Partial results are three slides each, never a deck.
    """
    own = F.filter(F.map_values("dims"), lambda v: v.isNotNull())
    total = F.aggregate(own, F.lit(0.0), lambda a, v: a + v) / F.size(own) * 6
    rows = scores.select("deck_id", "slide", own.alias("own"), total.alias("total")).where(F.size("own") > 0)
    bad = (F.col("total") < floor) | F.exists("own", lambda v: v <= lowest)
    rank = F.row_number().over(Window.partitionBy("deck_id").orderBy("total", "slide"))
    rows = rows.withColumn("k", rank)
    weakest = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= 3, F.struct("k", "slide")))), lambda x: x["slide"].cast("string")), ",")
    return rows.groupBy("deck_id").agg(F.avg("total").alias("mean"), F.count_if(bad).alias("rework"), weakest.alias("weakest"))


def review_findings(decks: DataFrame, reports: DataFrame) -> DataFrame:
    """deck_id, check, severity: decks without a report (deck_id, report JSON), with an unreadable one, or with open rework."""
    rows = decks.select("deck_id").distinct().join(reports.withColumn("there", F.lit(True)), "deck_id", "left")
    rework = F.try_variant_get(F.try_parse_json("report"), "$.rework", "array<variant>")
    hit = lambda check, severity: F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"))
    found = F.when(F.col("there").isNull(), hit("aesthetics-not-run", "P3")).when(rework.isNull(), hit("aesthetics-report-invalid", "P2")).when(F.size(rework) > 0, hit("aesthetics-rework-open", "P2"))
    return rows.select("deck_id", found.alias("f")).where("f IS NOT NULL").select("deck_id", "f.*")


def contain_scale(width: Column, height: Column, box_w: Column, box_h: Column) -> Column:
    """Scale at which a picture just fits its box; null without an area."""
    return F.when((width > 0) & (height > 0), F.least(box_w / width, box_h / height))


def wrapped(text: Column, most: Column) -> Column:
    """Lines of at most ``most`` characters, filled word by word; a longer word has a line to itself."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def step(a: Column, w: Column) -> Column:
        longer = F.concat(a["line"], F.lit(" "), w)
        same = F.struct(a["done"].alias("done"), F.when(a["line"] == "", w).otherwise(longer).alias("line"))
        return F.when((a["line"] == "") | (F.length(longer) <= most), same).otherwise(F.struct(F.array_append(a["done"], a["line"]).alias("done"), w.alias("line")))

    return F.aggregate(words, start, step, lambda a: F.when(a["line"] == "", a["done"]).otherwise(F.array_append(a["done"], a["line"])))


def slide_images(files: DataFrame, prompts: DataFrame) -> DataFrame:
    """deck_id, place, number, name, folder, prompted of picture files (deck_id, folder, name) of slides.

    Folders are the deck's root ('') and 'slides'; of one name the root's file counts. prompted: a prompt (deck_id, stem)
    of that name exists. Slides are placed by number, those with the same one by name.
    """
    number = F.regexp_extract("name", SLIDE_IMAGE, 1)
    one = files.where((number != "") & F.col("folder").isin("", "slides")).groupBy("deck_id", "name").agg(F.min("folder").alias("folder"))
    rows = one.select("deck_id", "name", "folder", number.try_cast("int").alias("number"), F.regexp_replace("name", r"\.[^.]*$", "").alias("stem"))
    rows = rows.join(prompts.select("deck_id", "stem", F.lit(True).alias("prompted")).distinct(), ["deck_id", "stem"], "left")
    place = F.row_number().over(Window.partitionBy("deck_id").orderBy("number", "name"))
    return rows.select("deck_id", place.alias("place"), "number", "name", "folder", F.coalesce("prompted", F.lit(False)).alias("prompted"))
