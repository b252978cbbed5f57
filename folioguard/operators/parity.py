"""Parity of a deck's specification with an extract of the built slides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioguard.functions import text as H
from folioguard.operators.deck import PAIRS, _many, _pair, cell_text


def _unmatched(wanted: Column, found: Column) -> Column:
    """Places (from 0) of the ``wanted`` texts without a ``found`` text that contains them as a whole; a found text serves once, first fit.

    Both are normalised once, before any is compared.
    """
    left = F.transform(found, lambda c: H.normalised(c))
    asked = F.transform(wanted, lambda w, i: F.struct(i.alias("i"), H.normalised(w).alias("w")))
    start = F.struct(left.alias("left"), F.array().cast("array<int>").alias("missing"))

    def step(a: Column, want: Column) -> Column:
        at = F.array_position(F.transform(a["left"], lambda c: H.contains_whole(c, want["w"])), True)
        rest = F.filter(a["left"], lambda _, i: i + 1 != at)
        return F.when(at > 0, F.struct(rest.alias("left"), a["missing"].alias("missing"))).otherwise(F.struct(a["left"].alias("left"), F.array_append(a["missing"], want["i"]).alias("missing")))

    return F.aggregate(asked, start, step, lambda a: a["missing"])


def missing_cells(expected: Column, found: Column) -> Column:
    """Expected cells without a found cell that contains them as a whole; a found cell serves once, first fit."""
    return F.transform(_unmatched(expected, found), lambda i: F.get(expected, i))


def expected_texts(slides: DataFrame) -> Column:
    """array<struct<field, text>> that a slide of the specification shows as text, by layout; blank ones are left out."""
    one = lambda name, c: F.array(_pair(F.lit(name), c))
    names = F.try_variant_get("authors", "$", "array<string>")
    authors = F.coalesce(F.array_join(names, ", "), F.try_variant_get("authors", "$", "string"))
    title = F.coalesce(F.nullif("action_title", F.lit("")), F.col("title"))
    bar = F.concat(one("eyebrow", F.col("eyebrow")), one("title", title))
    cells = F.flatten(F.transform(F.col("table.rows"), lambda r: F.transform(r, cell_text)))
    parts = lambda k: F.transform("points", lambda p: F.try_variant_get(p, f"$.{k}", "string"))
    heads = F.flatten(F.transform(F.arrays_zip(parts("head").alias("h"), parts("body").alias("b")), lambda p, i: F.array(_pair(F.format_string("points[%d].head", i), p["h"]), _pair(F.format_string("points[%d].body", i), p["b"]))))
    points = _many("points", F.transform("points", lambda p: F.try_variant_get(p, "$", "string")))
    own = {
        "bullets": points,
        "outline-agenda": _many("items", F.col("items")),
        "assertion-evidence": F.concat(one("figure.caption", F.nullif("figure.caption", F.lit(""))), one("annotation", F.col("annotation"))),
        "equation": one("note", F.col("note")),
        "results-table": F.concat(one("table.caption", F.col("table.caption")), _many("table.cell", cells), one("table.footnote", F.col("table.footnote"))),
        "two-column": F.concat(points, one("text", F.col("text")), _many("points2", F.col("points2"))),
        "critique-concerns": F.coalesce(heads, F.array().cast(PAIRS)),
        "discussion-questions": _many("questions", F.col("questions")),
        "references": _many("entries", F.col("entries")),
    }
    cover = F.concat(one("title", F.col("title")), one("authors", authors), one("affiliation", F.col("affiliation")), one("venue", F.col("venue")), one("presenter", F.col("presenter")))
    every = F.when(F.col("layout") == "paper-title", cover).when(F.col("layout") == "section", F.concat(one("num", F.col("num")), one("title", F.col("title"))))
    for layout, c in own.items():
        every = every.when(F.col("layout") == layout, F.concat(bar, c))
    return F.filter(every.otherwise(bar), lambda f: f["text"].isNotNull() & (F.trim(f["text"]) != ""))


def parity_findings(slides: DataFrame, built: DataFrame) -> DataFrame:
    """deck_id, slide, kind, field: what a deck's slides hold and the built ones lack.

    built: deck_id, slide (from 1), text, notes, cells (array, null if unknown), has_picture, has_table. Decks with another number of
    slides get a slide-count finding at slide 0, and slides that only one side has are not compared. Where cells
    are known, table cells are matched with cells, each of which serves once.
    """
    b = built.select("deck_id", "slide", *(F.col(c).alias("b_" + c) for c in ("text", "notes", "cells", "has_picture", "has_table")))
    rows = slides.select("deck_id", "slide", "layout", "speaker_notes", F.col("figure.src").alias("src"), F.col("table").isNotNull().alias("tabled"), expected_texts(slides).alias("want"))
    rows = rows.join(b.hint("merge"), ["deck_id", "slide"]).withColumns({"shown": H.normalised(F.col("b_text")), "said": H.normalised(F.col("b_notes"))})
    by_cell = lambda f: f["field"].startswith("table.cell[") & F.col("b_cells").isNotNull()
    cells = F.filter("want", by_cell)
    rows = rows.withColumns({"cells": cells, "texts": F.filter("want", lambda f: ~by_cell(f))})
    lost = F.transform(_unmatched(F.transform("cells", lambda f: f["text"]), F.coalesce("b_cells", F.array().cast("array<string>"))), lambda i: F.get("cells", i)["field"])
    asked = F.transform("texts", lambda f: F.struct(f["field"].alias("field"), H.normalised(f["text"]).alias("text")))  # once, however often a search mentions it
    gone = F.transform(F.filter(asked, lambda f: ~H.contains_whole(F.col("shown"), f["text"])), lambda f: f["field"])
    hit = lambda kind, field: F.struct(F.lit(kind).alias("kind"), field.alias("field"))
    none, notes = F.lit(""), F.coalesce("speaker_notes", F.lit(""))
    whole = F.array_compact(F.array(
        F.when((notes != "") & ~H.contains_whole(F.col("said"), H.normalised(notes)), hit("missing-notes", none)),
        F.when((F.coalesce("src", F.lit("")) != "") & ~F.coalesce("b_has_picture", F.lit(False)), hit("missing-figure", none)),
        F.when((F.col("layout") == "results-table") & F.col("tabled") & ~F.coalesce("b_has_table", F.lit(False)), hit("missing-table", none)),
    ))
    texts = F.transform(F.concat(gone, lost), lambda f: hit("missing-text", f))
    found = rows.select("deck_id", "slide", F.explode(F.concat(texts, whole)).alias("f")).select("deck_id", "slide", "f.kind", "f.field")
    counts = slide_count_mismatches(slides, built).select("deck_id", F.lit(0).cast("long").alias("slide"), F.lit("slide-count").alias("kind"), F.concat_ws("/", "expected", "built").alias("field"))
    return found.unionByName(counts)


def text_parity(expected: DataFrame, built: DataFrame) -> DataFrame:
    """deck_id, slide, field of expected texts (deck_id, slide, field, text) that the built slide (text) lacks."""
    text = H.normalised(F.col("text"))  # below the join, as its condition would form them again at each mention
    rows = expected.select("deck_id", "slide", "field", text.alias("asked")).join(built.select("deck_id", "slide", text.alias("shown")).hint("merge"), ["deck_id", "slide"])
    return rows.where(~H.contains_whole(F.col("shown"), F.col("asked"))).select("deck_id", "slide", "field")


def slide_count_mismatches(expected: DataFrame, built: DataFrame) -> DataFrame:
    """deck_id, expected, built where the numbers of slides differ."""
    n = lambda df, name: df.groupBy("deck_id").agg(F.countDistinct("slide").alias(name))
    return n(expected, "expected").join(n(built, "built").hint("merge"), "deck_id", "full").na.fill(0).where("expected <> built")
