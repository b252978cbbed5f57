"""Manuscripts, decks, inventories and images as DataFrames. Only Spark's readers touch the paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioguard.functions import text as H
from folioguard.operators.manuscript import lines_of

STEM = r"^(.*/)?([^/]*?)(\.[^./]*)?$"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def manuscripts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path), line_no, line of text files."""
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))
    return lines_of(docs)


def decks(spark: SparkSession, path: str) -> DataFrame:
    """deck_id (the path), spec (JSON)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("deck_id"), F.col("value").alias("spec"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """path, number (of its name), stem, format, size of the picture files; the first folder wins for equal names."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg}").option("recursiveFileLookup", "true").load(path)
    rows = files.select("path", F.regexp_extract("path", STEM, 2).alias("stem"), H.image_format(F.col("content")).alias("format"), H.png_size(F.col("content")).alias("size"))
    rows = rows.withColumn("number", F.regexp_extract("stem", r"^(\d+)-", 1).try_cast("int"))
    first = F.row_number().over(Window.partitionBy("stem").orderBy(F.length("path"), "path"))
    return rows.withColumn("k", first).where("k = 1").drop("k")


INGEST = "n_pages INT, full_text STRING, meta STRUCT<title: STRING, arxiv_id: STRING>"
FIGURE = (
    "id STRING, kind STRING, number STRING, label STRING, caption STRING, page INT, caption_bbox ARRAY<DOUBLE>, figure_bbox ARRAY<DOUBLE>, min_font_pt DOUBLE, "
    "panels ARRAY<STRUCT<label: STRING, bbox: ARRAY<DOUBLE>>>"
)


def _whole(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias(name), F.col("value"))


def ingests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path), n_pages, full_text ("" if absent), title, arxiv_id of ingest files; all null but the path for unreadable ones."""
    rows = _whole(spark, path, "doc_id").select("doc_id", F.from_json("value", INGEST).alias("v"), F.try_parse_json("value").isNotNull().alias("there"))
    return rows.select("doc_id", "v.n_pages", F.when(F.col("there"), F.coalesce("v.full_text", F.lit(""))).alias("full_text"), "v.meta.title", "v.meta.arxiv_id")


def figures(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path) and FIGURE of each record of inventory files."""
    rows = _whole(spark, path, "doc_id").select("doc_id", F.explode(F.from_json("value", f"ARRAY<STRUCT<{_struct(FIGURE)}>>")).alias("f"))
    return rows.select("doc_id", "f.*")


def figure_meta(records: DataFrame) -> DataFrame:
    """key, min_font_pt, w, h of localized records of ``figures``, as ``deck.legibility`` takes them."""
    box = F.col("figure_bbox")
    return records.where(box.isNotNull()).select(F.col("id").alias("key"), "min_font_pt", (box[2] - box[0]).alias("w"), (box[3] - box[1]).alias("h"))


def bib_queries(spark: SparkSession, path: str | None = None, asked: tuple[str, ...] = ()) -> DataFrame:
    """query: those ``asked`` for, then those of files that hold a JSON array of texts."""
    own = spark.createDataFrame([(q,) for q in asked], "query string")
    return own if path is None else own.unionByName(_whole(spark, path, "file").select(F.explode(F.from_json("value", "ARRAY<STRING>")).alias("query")))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """deck_id and folder of each deck of corpus files (JSON: {"decks": [{"name", "dir"}]} or the array itself)."""
    entry = "ARRAY<STRUCT<name: STRING, dir: STRING>>"
    v = F.try_parse_json("value")
    rows = _whole(spark, path, "file").select(F.explode(F.coalesce(F.try_variant_get(v, "$.decks", entry), F.try_variant_get(v, "$", entry))).alias("d"))
    return rows.select(F.col("d.name").alias("deck_id"), F.col("d.dir").alias("folder"))


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """stem, suffix, path of the prompt files (.md, .txt) of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{md,txt}").load(path)
    return files.select(F.regexp_extract("path", STEM, 2).alias("stem"), F.regexp_extract("path", STEM, 3).alias("suffix"), "path")


def _struct(ddl: str) -> str:
    """``ddl`` of columns as that of a struct's fields."""
    return T.StructType.fromDDL(ddl).simpleString()[len("struct<") : -1]


def pending(prompts: DataFrame, outputs: DataFrame, least: int = 10_000) -> DataFrame:
    """Prompts (stem, suffix) without an output (stem, bytes) of more than ``least`` bytes; md beats txt."""
    best = F.row_number().over(Window.partitionBy("stem").orderBy((F.col("suffix") == ".md").desc()))
    return prompts.withColumn("k", best).where("k = 1").drop("k").join(outputs.where(F.col("bytes") > least), "stem", "left_anti")
