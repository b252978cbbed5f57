"""Queries of crowded pages and of titles that nearly agree, with the SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioguard.operators import bib as B
from folioguard.operators import geometry as G
from folioguard.plans import catalogue as C
from folioguard.plans import inputs as I
from folioguard.plans.catalogue import _query, _sql

# A page for each supplier, with all its lines as rects: bands of them, apart by more than growing bridges, and some tall ones.
CROWDED = """SELECT l_suppkey AS page_id, CAST(l_partkey % 7 * 90 AS DOUBLE) AS x0, CAST(l_orderkey % 10 * 100 + l_linenumber * 2 AS DOUBLE) AS y0, CAST(l_partkey % 7 * 90 + 40 + l_quantity AS DOUBLE) AS x1,
  CAST(l_orderkey % 10 * 100 + l_linenumber * 2 + l_quantity / 2 + CASE WHEN l_partkey % 199 = 0 THEN 60 ELSE 0 END AS DOUBLE) AS y1 FROM lineitem"""
PLACES = """SELECT s_suppkey AS page_id, s_suppkey AS caption_id, CASE WHEN s_suppkey % 2 = 0 THEN 'table' ELSE 'figure' END AS kind, CAST(s_suppkey % 5 * 110 AS DOUBLE) AS x0, CAST(s_suppkey % 9 * 100 + 50 AS DOUBLE) AS y0,
  CAST(s_suppkey % 5 * 110 + 60 AS DOUBLE) AS x1, CAST(s_suppkey % 9 * 100 + 60 AS DOUBLE) AS y1, CAST(1000 AS DOUBLE) AS page_h FROM supplier"""


@_query(C.ORACLES["region_grow"].replace(I.RECTS, CROWDED).replace(I.CAPTIONS, PLACES))
def crowded_regions(spark, sf):
    return G.region_grow(_sql(spark, sf, PLACES, "supplier"), _sql(spark, sf, CROWDED, "lineitem"))


@_query(f"""WITH RECURSIVE r AS ({I.RECTS}), c AS ({I.CAPTIONS}),
p AS (SELECT DISTINCT caption_id, c.page_h, r.x0, r.y0, r.x1, r.y1, CASE kind WHEN 'figure' THEN c.y0 - r.y1 ELSE r.y0 - c.y1 END AS gap FROM c JOIN r USING (page_id)
  WHERE least(c.x1, r.x1) - greatest(c.x0, r.x0) > 0 AND CASE kind WHEN 'figure' THEN c.y0 - r.y1 ELSE r.y0 - c.y1 END >= -2),
s AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY caption_id ORDER BY gap, x0, y0, x1, y1) = 1),
g AS (SELECT caption_id, page_h, x0, y0, x1, y1, 0 AS k, true AS moved FROM s WHERE gap <= 0.5 * page_h
  UNION ALL SELECT caption_id, page_h, least(x0, a), least(y0, b), greatest(x1, d), greatest(y1, e), k + 1, a < x0 OR b < y0 OR d > x1 OR e > y1 FROM (
    SELECT g.caption_id, g.page_h, g.x0, g.y0, g.x1, g.y1, k, min(p.x0) AS a, min(p.y0) AS b, max(p.x1) AS d, max(p.y1) AS e FROM g JOIN p ON p.caption_id = g.caption_id
      AND least(g.x1, p.x1) - greatest(g.x0, p.x0) > 0 AND greatest(g.y0, p.y0) - least(g.y1, p.y1) <= 0.10 * g.page_h WHERE moved GROUP BY ALL))
SELECT caption_id, x0, y0, x1, y1 FROM g QUALIFY row_number() OVER (PARTITION BY caption_id ORDER BY k DESC) = 1""")
def caption_regions(spark, sf):
    return G.associated_region(C.caps(spark, sf), C.rects(spark, sf))


# A record for each customer; its query is the title itself, a longer one, one without a character or two, a beginning, or another title.
TITLES = """SELECT c_custkey, c_custkey % 6 AS k, concat('On ', md5(CAST(c_custkey AS STRING))) AS t FROM customer"""
ASKED = """CASE k WHEN 0 THEN upper(t) WHEN 1 THEN concat(t, ': a survey') WHEN 2 THEN concat(substr(t, 1, 17), substr(t, 19)) WHEN 3 THEN concat(substr(t, 1, 10), substr(t, 12, 13), substr(t, 26)) WHEN 4 THEN substr(t, 1, 20) ELSE concat(substr(t, 1, 8), 'zzzz', substr(t, 13)) END"""
NEAR = f"SELECT c_custkey AS query_id, c_custkey AS record_id, CASE k WHEN 0 THEN 1 WHEN 2 THEN round(68.0 / 69, 9) WHEN 3 THEN round(66.0 / 68, 9) END AS ratio FROM ({TITLES.replace('STRING', 'VARCHAR')}) WHERE k < 5"


def titles(spark, sf):
    rows = _sql(spark, sf, TITLES, "customer")
    return rows.select(F.col("c_custkey").alias("query_id"), F.expr(ASKED).alias("title")), rows.select(F.col("c_custkey").alias("record_id"), F.col("t").alias("title"))


@_query(NEAR)
def near_titles(spark, sf):
    return B.near_titles(*titles(spark, sf)).withColumn("ratio", F.round("ratio", 9))


@_query(f"SELECT c_custkey AS query_id, record_id, record_id IS NOT NULL AS resolved FROM customer LEFT JOIN ({NEAR}) ON query_id = c_custkey")
def resolved_titles(spark, sf):
    return B.resolve_titles(*titles(spark, sf))
