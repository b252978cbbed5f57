"""What a page parser delivers, as relations: blocks, spans, pictures, drawings and positioned text items.

Parsing itself happens elsewhere; these readers filter and join its rows as page checks need them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioguard.functions import text as H

BOX = ("x0", "y0", "x1", "y1")
# Captions at the start of a line, with continuation lines.
_REST = r"[.:\s]+([^\n]+(?:\n(?![A-Z]{2,}|\d+\.|Fig|Table)[^\n]+)*)"
FIGURE_CAPTION = r"(?i)(?:^|\n)\s*Fig(?:ure|\.)?\s*(\d+)" + _REST
UPPER_CAPTION = r"(?:^|\n)\s*FIGURE\s+(\d+)" + _REST
TABLE_CAPTION = r"(?i)(?:^|\n)\s*Table\s+([IVXLCDM\d]+)" + _REST


def ingest_of(pages: DataFrame, meta: DataFrame) -> DataFrame:
    """doc_id, n_pages, full_text, title, arxiv_id of pages (doc_id, page, text) and meta (doc_id, title).

    The id is the stamp of the first page; others may be those of cited papers. An empty title is none.
    """
    texts = F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text"))))
    rows = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"), texts.alias("p")).join(meta.select("doc_id", F.nullif("title", F.lit("")).alias("title")), "doc_id", "left")
    return rows.select("doc_id", "n_pages", F.array_join("p.text", "\n").alias("full_text"), "title", H.arxiv_id(F.get("p.text", 0), True).alias("arxiv_id"))


def page_blocks(blocks: DataFrame) -> DataFrame:
    """page_id, text, box of text blocks (page_id, type, spans: array<string>, x0, y0, x1, y1); type 0 is text, blank ones go."""
    rows = blocks.where(F.coalesce("type", F.lit(0)) == 0).withColumn("text", F.array_join("spans", " "))
    return rows.where(F.trim("text") != "").select("page_id", "text", *BOX)


def letter_spans(spans: DataFrame) -> DataFrame:
    """Spans (page_id, text, font, size, box) of one character: candidates for panel labels."""
    return spans.withColumn("text", F.trim("text")).where(F.length("text") == 1)


def sized_spans(spans: DataFrame) -> DataFrame:
    """page_id, size, box of the spans that are not blank and have a size."""
    return spans.where((F.trim("text") != "") & (F.col("size") > 0)).select("page_id", "size", *BOX)


def content_rects(blocks: DataFrame, images: DataFrame, drawings: DataFrame) -> DataFrame:
    """page_id, kind, box of all content. Drawings (with page_w) thinner than a point and page-wide rules go."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    drawn = drawings.where((w > 1) & (h > 1) & ~((w > 0.9 * F.col("page_w")) & (h < 3)))
    parts = [d.select("page_id", F.lit(k).alias("kind"), *BOX) for k, d in (("text", blocks), ("image", images), ("drawing", drawn))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def page_text(items: DataFrame, near: float = 5.0, line: float = 8.0) -> DataFrame:
    """page_id, text of positioned items (page_id, x, y, str; y grows upwards).

    From the top, items within ``near`` of the first of their row form a row, read from left to right;
    a new line begins where an item is more than ``line`` from the first item of its line. Anchoring rows makes
    the order total. One page is one group; pages are small.
    """
    top = F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("ny"), "x", "str")))

    def anchored(rows: Column, most: float) -> Column:
        """Each element with g, the place where its group began."""
        kind = "array<struct<g:double,ny:double,x:double,str:string>>"
        zero = F.struct(F.array().cast(kind).alias("out"), F.lit(None).cast("double").alias("g"))

        def step(a: Column, r: Column) -> Column:
            g = F.when(a["g"].isNull() | (F.abs(r["ny"] - a["g"]) > most), r["ny"]).otherwise(a["g"])
            return F.struct(F.array_append(a["out"], F.struct(g.alias("g"), r["ny"].alias("ny"), r["x"].alias("x"), r["str"].alias("str"))).alias("out"), g.alias("g"))

        return F.aggregate(rows, zero, step, lambda a: a["out"])

    by_row = F.transform(F.array_sort(F.transform(anchored(F.col("items"), near), lambda r: F.struct(r["g"].alias("g"), r["x"].alias("x"), r["ny"].alias("ny"), r["str"].alias("str")))), lambda r: F.struct(r["ny"].alias("ny"), r["x"].alias("x"), r["str"].alias("str")))
    rows = items.where("y IS NOT NULL AND x IS NOT NULL").select("page_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.coalesce("str", F.lit("")).alias("str"))
    rows = rows.groupBy("page_id").agg(top.alias("items")).withColumn("items", by_row)
    lines = F.filter(anchored(F.col("items"), line), lambda r: F.trim(r["str"]) != "")
    zero = F.struct(F.lit("").alias("text"), F.lit(None).cast("double").alias("g"))
    joined = F.aggregate(lines, zero, lambda a, r: F.struct(F.concat(a["text"], F.when(a["g"].isNull(), "").when(a["g"] == r["g"], " ").otherwise("\n"), r["str"]).alias("text"), r["g"].alias("g")), lambda a: a["text"])
    return rows.select("page_id", joined.alias("text"))


def text_captions(pages: DataFrame, most: int = 300) -> DataFrame:
    """page_id, kind, number, caption of captions in page texts (page_id, text); white space collapsed, at most ``most`` characters.

    A line that begins with two letters ends a caption; for captions in capitals, only two capitals do, so
    such a caption may be found twice, once shorter. ``pick_captions`` chooses.
    """

    def found(pattern: str, kind: str) -> Column:
        both = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), 1).alias("number"), F.regexp_extract_all("text", F.lit(pattern), 2).alias("caption"))
        return F.transform(both, lambda c: F.struct(F.lit(kind).alias("kind"), c["number"].alias("number"), F.substring(F.regexp_replace(F.trim(c["caption"]), r"\s+", " "), 1, most).alias("caption")))

    rows = pages.where("text IS NOT NULL").select("page_id", F.explode(F.concat(found(FIGURE_CAPTION, "figure"), found(UPPER_CAPTION, "figure"), found(TABLE_CAPTION, "table"))).alias("c"))
    return rows.select("page_id", "c.*")
