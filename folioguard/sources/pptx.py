"""Slides of PPTX files as rows.

A PPTX file is a ZIP folder of XML parts. Python opens the folder and walks the XML, one file at a time, and gives one row
for each text, table cell, picture and note; everything after that is Spark. Only shapes that stand on the slide itself count,
as in its own list of shapes: what is grouped is one shape without text. Pictures in placeholders and films are no
pictures. Slides come in the order of the presentation, whatever their file names.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The namespaces of the format.
DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
SLIDE = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
RELATION = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"
SHAPE = "slide long, shape int, kind string, part int, text string"


def pptx_files(spark: SparkSession, path: str) -> DataFrame:
    """deck_id (the path), content of the PPTX files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pptx").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("deck_id"), "content")


class _Parts:
    """The XML parts of one file and what they link to."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))

    def read(self, name: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.zip.read(name))

    def links(self, name: str) -> dict[str, tuple[str, str]]:
        """Id of each link of a part: its kind and the part that it leads to."""
        folder, base = posixpath.split(name)
        try:
            found = self.read(f"{folder}/_rels/{base}.rels".lstrip("/"))
        except KeyError:
            return {}
        inside = (r for r in found.iter(RELATION) if r.get("TargetMode") != "External")
        return {r.get("Id", ""): (r.get("Type", "").rsplit("/", 1)[-1], posixpath.normpath(posixpath.join("/", folder, r.get("Target", "")))[1:]) for r in inside}

    def linked(self, name: str, kind: str) -> str | None:
        return next((to for k, to in self.links(name).values() if k == kind), None)


def _text(body: ElementTree.Element | None) -> str:
    """Paragraphs on lines of their own; a break inside one is a vertical tab."""
    lines = []
    for p in body.iterfind(f"{DRAWING}p") if body is not None else ():
        runs = (x for x in p if x.tag in (f"{DRAWING}r", f"{DRAWING}fld", f"{DRAWING}br"))
        lines.append("".join("\v" if x.tag == f"{DRAWING}br" else x.findtext(f"{DRAWING}t") or "" for x in runs))
    return "\n".join(lines)


def _shapes(tree: ElementTree.Element) -> Iterator[tuple[int, str, int, str | None]]:
    for i, shape in enumerate(tree):
        if shape.tag == f"{SLIDE}sp" and (body := shape.find(f"{SLIDE}txBody")) is not None:
            yield i, "text", 0, _text(body)
        elif shape.tag == f"{SLIDE}pic":
            own = shape.find(f"{SLIDE}nvPicPr/{SLIDE}nvPr")
            films = ("videoFile", "audioFile", "quickTimeFile", "wavAudioFile")
            if own is None or own.find(f"{SLIDE}ph") is None and all(own.find(DRAWING + f) is None for f in films):
                yield i, "picture", 0, None
        elif shape.tag == f"{SLIDE}graphicFrame" and (table := shape.find(f"{DRAWING}graphic/{DRAWING}graphicData/{DRAWING}tbl")) is not None:
            yield i, "table", 0, None
            for k, cell in enumerate(table.iterfind(f"{DRAWING}tr/{DRAWING}tc")):
                yield i, "cell", k, _text(cell.find(f"{DRAWING}txBody"))


def _notes(page: ElementTree.Element) -> str:
    """The text of the first body placeholder of a page of notes."""
    for shape in page.iterfind(f"{SLIDE}cSld/{SLIDE}spTree/{SLIDE}sp"):
        holder = shape.find(f"{SLIDE}nvSpPr/{SLIDE}nvPr/{SLIDE}ph")
        if holder is not None and holder.get("type") == "body":
            return _text(shape.find(f"{SLIDE}txBody"))
    return ""


def _file(content: bytes) -> Iterator[tuple[int | None, int | None, str, int | None, str | None]]:
    """SHAPE of one file; a file that is no presentation gives one row, of kind ``unreadable``."""
    rows: list[tuple] = []
    try:
        parts = _Parts(content)
        deck = parts.linked("", "officeDocument") or "ppt/presentation.xml"
        links = parts.links(deck)
        for n, entry in enumerate(parts.read(deck).iterfind(f"{SLIDE}sldIdLst/{SLIDE}sldId"), 1):
            name = links[entry.get(f"{LINK}id", "")][1]
            tree = parts.read(name).find(f"{SLIDE}cSld/{SLIDE}spTree")
            rows.append((n, None, "slide", None, None))
            rows += ((n, *s) for s in (_shapes(tree) if tree is not None else ()))
            if page := parts.linked(name, "notesSlide"):
                rows.append((n, None, "notes", None, _notes(parts.read(page))))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, NotImplementedError, RuntimeError, TypeError, EOFError):
        return iter([(None, None, "unreadable", None, None)])
    return iter(rows)


def _shape_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["deck_id", *(c.split()[0] for c in SHAPE.split(", "))]
    for batch in batches:
        for deck_id, content in zip(batch.deck_id, batch.content):
            yield pd.DataFrame([(deck_id, *r) for r in _file(content)], columns=names).astype({"slide": "Int64", "shape": "Int32", "part": "Int32"})


def pptx_shapes(files: DataFrame) -> DataFrame:
    """deck_id and SHAPE of files (deck_id, content): kinds slide, text, table, cell, picture, notes, or unreadable (one row, no slide)."""
    kind = files.schema["deck_id"].dataType.simpleString()
    return files.select("deck_id", "content").mapInPandas(_shape_batches, f"deck_id {kind}, {SHAPE}")


def built_slides(shapes: DataFrame) -> DataFrame:
    """deck_id, slide, text, notes, cells, has_picture, has_table of ``pptx_shapes``, as ``parity.parity_findings`` takes them.

    Texts and cells of a slide are joined in the order of its shapes. Unreadable files have no slides, so parity reports their number.
    """
    own = lambda *kinds: F.array_sort(F.collect_list(F.when(F.col("kind").isin(*kinds), F.struct("shape", "part", "text"))))
    has = lambda kind: F.bool_or(F.col("kind") == kind)
    return shapes.where("slide IS NOT NULL").groupBy("deck_id", "slide").agg(
        F.array_join(F.transform(own("text", "cell"), lambda s: s["text"]), " \n ").alias("text"), F.coalesce(F.max(F.when(F.col("kind") == "notes", F.col("text"))), F.lit("")).alias("notes"),
        F.transform(own("cell"), lambda s: s["text"]).alias("cells"), has("picture").alias("has_picture"), has("table").alias("has_table"),
    )


def unreadable(shapes: DataFrame) -> DataFrame:
    """deck_id of files that are no presentations."""
    return shapes.where("kind = 'unreadable'").select("deck_id")
