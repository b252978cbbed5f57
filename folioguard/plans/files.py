"""Queries of the file readers: each writes files from a given table, one for each key, and reads them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioguard.plans.catalogue import _query
from folioguard.sources import readers as R
from folioguard.sources.folders import write_files
from folioguard.sources.readers import table
from folioguard.sources.scratch import scratch_path


def _files(rows: DataFrame, name: str) -> str:
    """Write rows (k, value), one file for each k, and give the folder."""
    path = scratch_path(rows.sparkSession, name)
    write_files(rows, path)
    return path


def _key(path: str):
    return F.regexp_extract(path, "/([0-9]+)$", 1).cast("long")


def _suppliers(spark, sf, value: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.expr(value).alias("value"))


@_query("""SELECT s_suppkey AS k, CASE WHEN s_suppkey % 7 > 0 THEN s_suppkey % 30 END AS n_pages, CASE WHEN s_suppkey % 7 > 0 THEN CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'Text of ' || s_name END END AS full_text,
  CASE WHEN s_suppkey % 7 > 0 THEN s_name END AS title, CASE WHEN s_suppkey % 7 > 0 AND s_suppkey % 2 = 0 THEN '2401.' || (10000 + s_suppkey) END AS arxiv_id FROM supplier""")
def ingest_files(spark, sf):
    """Every seventh file is cut off; every third has no text."""
    value = """CASE WHEN s_suppkey % 7 = 0 THEN '{"n_pages": 3, "full' ELSE concat('{"n_pages": ', s_suppkey % 30, CASE WHEN s_suppkey % 3 > 0 THEN concat(', "full_text": "Text of ', s_name, '"') ELSE '' END,
      ', "meta": {"title": "', s_name, '"', CASE WHEN s_suppkey % 2 = 0 THEN concat(', "arxiv_id": "2401.', 10000 + s_suppkey, '"') ELSE '' END, '}}') END"""
    rows = R.ingests(spark, _files(_suppliers(spark, sf, value), "ingest"))
    return rows.select(_key("doc_id").alias("k"), "n_pages", "full_text", "title", "arxiv_id")


FIGURE_FILES = """SELECT s_suppkey AS k, i, CASE WHEN i % 2 = 0 THEN 'figure' ELSE 'table' END AS kind, (s_suppkey + i) % 3 > 0 AS localized FROM supplier, (SELECT unnest([0, 1, 2]) AS i) WHERE i < s_suppkey % 4"""


@_query(f"SELECT k, kind || '-' || i AS id, kind, CAST(i AS VARCHAR) AS number, CASE WHEN localized THEN CAST(k + 0.5 AS DOUBLE) END AS x1, CASE WHEN localized AND i = 0 THEN 'a' END AS panel FROM ({FIGURE_FILES})")
def figure_files(spark, sf):
    """Inventories of no to three records; some are not localized, and some have panels."""
    one = """transform(sequence(0, CAST(s_suppkey % 4 AS INT)), i -> concat('{"id": "', CASE WHEN i % 2 = 0 THEN 'figure' ELSE 'table' END, '-', i, '", "kind": "', CASE WHEN i % 2 = 0 THEN 'figure' ELSE 'table' END, '", "number": "', i, '", "figure_bbox": ',
      CASE WHEN (s_suppkey + i) % 3 > 0 THEN concat('[0, 0, ', s_suppkey, '.5, 9]') ELSE 'null' END, ', "panels": [', CASE WHEN i = 0 AND (s_suppkey + i) % 3 > 0 THEN '{"label": "a", "bbox": [0, 0, 1, 1]}' ELSE '' END, ']}'))"""
    rows = R.figures(spark, _files(_suppliers(spark, sf, f"concat('[', array_join(slice({one}, 1, CAST(s_suppkey % 4 AS INT)), ','), ']')"), "figures"))
    return rows.select(_key("doc_id").alias("k"), "id", "kind", "number", F.get("figure_bbox", 2).alias("x1"), F.get("panels", 0)["label"].alias("panel"))


@_query("SELECT 'Study of ' || s_name AS query FROM supplier UNION ALL SELECT '10.1234/p' || s_suppkey FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT unnest(['asked', 'twice'])")
def bib_query_files(spark, sf):
    value = """concat('["Study of ', s_name, '"', CASE WHEN s_suppkey % 2 = 0 THEN concat(', "10.1234/p', s_suppkey, '"') ELSE '' END, ']')"""
    return R.bib_queries(spark, _files(_suppliers(spark, sf, value), "queries"), ("asked", "twice"))


@_query("SELECT s_name AS deck_id, 'decks/' || s_suppkey AS folder FROM supplier UNION ALL SELECT s_name || ' B', NULL FROM supplier WHERE s_suppkey % 3 = 0")
def manifest_files(spark, sf):
    """Manifests as an object with decks, or as the array itself; a deck may lack its folder."""
    decks = """concat('[{"name": "', s_name, '", "dir": "decks/', s_suppkey, '"}', CASE WHEN s_suppkey % 3 = 0 THEN concat(', {"name": "', s_name, ' B", "note": 1}') ELSE '' END, ']')"""
    return R.manifest(spark, _files(_suppliers(spark, sf, f"CASE WHEN s_suppkey % 2 = 0 THEN {decks} ELSE concat('{{\"decks\": ', {decks}, '}}') END"), "manifest"))


@_query("SELECT o_custkey % 100 AS k, row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY o_orderkey) AS line_no, 'Order ' || o_orderkey AS line FROM orders")
def manuscript_files(spark, sf):
    """A manuscript file for each hundredth of the customers, a line for each order; the file ends with a line end, which is no line."""
    own = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 100).alias("k")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("o"))
    path = _files(own.select("k", F.array_join(F.transform("o", lambda x: F.concat(F.lit("Order "), x.cast("string"))), "\n").alias("value")), "manuscripts")
    return R.manuscripts(spark, path).select(_key("doc_id").alias("k"), "line_no", "line")
