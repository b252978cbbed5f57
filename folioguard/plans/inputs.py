"""Inputs derived from the star-schema tables, in SQL that Spark and DuckDB both read."""

MANUSCRIPTS = """
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, sub, line) AS line_no, line FROM (
  SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS sub,
    CASE WHEN doc_id % 7 = 0 THEN '# A Systematic Review of Parts' ELSE '# A Narrative Review of Parts' END AS line FROM li
  UNION ALL SELECT DISTINCT doc_id, CAST(0 AS BIGINT), CAST(1 AS BIGINT), CASE WHEN doc_id % 4 = 0 THEN '### 2.1 Units' ELSE '#### Box of units' END FROM li WHERE doc_id % 2 = 0
  UNION ALL SELECT DISTINCT doc_id, CAST(0 AS BIGINT), CAST(2 AS BIGINT), '$$ a = b $$' FROM li WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, CAST(1 AS BIGINT), n * 10 + s % 10,
    concat(who, ' et al. [', CAST(n AS STRING), CASE WHEN p % 23 = 0 THEN ', 2-3' ELSE '' END, '] reported ', CAST(q AS STRING), ' units',
      CASE WHEN p % 17 = 0 THEN ' [TBD].' WHEN p % 19 = 0 THEN ', which may suggest growth.' WHEN p % 29 = 0 THEN ' on Cleerly.' ELSE '.' END) FROM li
  UNION ALL SELECT DISTINCT doc_id, CAST(2 AS BIGINT), CAST(0 AS BIGINT), '## References' FROM li WHERE doc_id % 25 <> 0
  UNION ALL SELECT doc_id, CAST(3 AS BIGINT), n * 10 + s % 10,
    concat('[', CAST(n AS STRING), '] ', bib, ' A, Jones B. Part study. doi:10.1234/p', CAST(p % 40 AS STRING)) FROM li WHERE (doc_id + n) % 11 <> 0 AND doc_id % 25 <> 0
  UNION ALL SELECT DISTINCT doc_id, CAST(4 AS BIGINT), CAST(0 AS BIGINT), '[99] Brown C. Never cited. doi:10.1234/zz99' FROM li WHERE doc_id % 3 = 0 AND doc_id % 25 <> 0
) raw
"""
LI = """
SELECT doc_id, n, s, p, q,
  CASE s % 5 WHEN 0 THEN 'Wang' WHEN 1 THEN 'Zhang' WHEN 2 THEN 'Kumar' WHEN 3 THEN 'Smith' ELSE 'Sato' END AS who,
  CASE (s + CASE WHEN p % 13 = 0 THEN 1 ELSE 0 END) % 5 WHEN 0 THEN 'Wang' WHEN 1 THEN 'Zhang' WHEN 2 THEN 'Kumar' WHEN 3 THEN 'Smith' ELSE 'Sato' END AS bib
FROM (SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS n, l_suppkey AS s, l_partkey AS p, CAST(l_quantity AS BIGINT) AS q FROM lineitem) base
"""
# The same lines in Spark's steps: a document's rows meet, its first row brings the lines that a document has once, and texts follow.
LI_ROWS = "SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS n, l_suppkey AS s, l_partkey AS p, CAST(l_quantity AS BIGINT) AS q FROM lineitem"
FIRST_ROWS = "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n, s, p, q) = 1 AS once FROM {li}"
NUMBERED_LINES = """
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, sub, line) AS line_no, line FROM (SELECT doc_id, inline(array(
  CASE WHEN once THEN named_struct('k', 0L, 'sub', 0L, 'line', CASE WHEN doc_id % 7 = 0 THEN '# A Systematic Review of Parts' ELSE '# A Narrative Review of Parts' END) END,
  CASE WHEN once AND doc_id % 2 = 0 THEN named_struct('k', 0L, 'sub', 1L, 'line', CASE WHEN doc_id % 4 = 0 THEN '### 2.1 Units' ELSE '#### Box of units' END) END,
  CASE WHEN once AND doc_id % 3 = 0 THEN named_struct('k', 0L, 'sub', 2L, 'line', '$$ a = b $$') END,
  named_struct('k', 1L, 'sub', n * 10 + s % 10, 'line', concat(who, ' et al. [', CAST(n AS STRING), CASE WHEN p % 23 = 0 THEN ', 2-3' ELSE '' END, '] reported ', CAST(q AS STRING), ' units',
    CASE WHEN p % 17 = 0 THEN ' [TBD].' WHEN p % 19 = 0 THEN ', which may suggest growth.' WHEN p % 29 = 0 THEN ' on Cleerly.' ELSE '.' END)),
  CASE WHEN once AND doc_id % 25 <> 0 THEN named_struct('k', 2L, 'sub', 0L, 'line', '## References') END,
  CASE WHEN (doc_id + n) % 11 <> 0 AND doc_id % 25 <> 0 THEN named_struct('k', 3L, 'sub', n * 10 + s % 10, 'line', concat('[', CAST(n AS STRING), '] ', bib, ' A, Jones B. Part study. doi:10.1234/p', CAST(p % 40 AS STRING))) END,
  CASE WHEN once AND doc_id % 3 = 0 AND doc_id % 25 <> 0 THEN named_struct('k', 4L, 'sub', 0L, 'line', '[99] Brown C. Never cited. doi:10.1234/zz99') END))
  FROM (SELECT *, CASE s % 5 WHEN 0 THEN 'Wang' WHEN 1 THEN 'Zhang' WHEN 2 THEN 'Kumar' WHEN 3 THEN 'Smith' ELSE 'Sato' END AS who,
    CASE (s + CASE WHEN p % 13 = 0 THEN 1 ELSE 0 END) % 5 WHEN 0 THEN 'Wang' WHEN 1 THEN 'Zhang' WHEN 2 THEN 'Kumar' WHEN 3 THEN 'Smith' ELSE 'Sato' END AS bib FROM {li})) raw WHERE k IS NOT NULL
"""
#: The number of a line's slide, as the queries of decks have it.
SLIDE_NO = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate)"
SLIDES = """
SELECT l_orderkey AS deck_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS slide,
  CASE l_suppkey % 6 WHEN 0 THEN 'bullets' WHEN 1 THEN 'assertion-evidence' WHEN 2 THEN 'results-table' WHEN 3 THEN 'section' WHEN 4 THEN 'critique-concerns' ELSE CASE WHEN l_partkey % 5 = 0 THEN 'mystery' ELSE 'bullets' END END AS layout,
  CASE WHEN l_partkey % 9 = 0 THEN ' ' ELSE concat('Part ', CAST(l_partkey AS STRING), ' ==p|up== ==w|down== ', CASE WHEN l_partkey % 4 = 0 THEN '==best==' ELSE '==k|key==' END, CASE WHEN l_partkey % 11 = 0 THEN ' [UNVERIFIED value]' ELSE '' END) END AS title,
  concat('moved ', CAST(CAST(l_quantity AS BIGINT) AS STRING), ' units', CASE WHEN l_partkey % 13 = 0 THEN ' 🚀' ELSE '' END) AS point,
  CAST(CAST(l_quantity AS BIGINT) * 3 AS STRING) AS cell,
  CASE WHEN l_suppkey % 3 = 0 THEN 'Sec. 2' END AS source_ref,
  repeat('long caption ', CAST(l_quantity AS INT)) AS caption,
  l_linenumber % 2 = 0 AS hero,
  CASE WHEN l_partkey % 6 = 0 THEN 'a remark' END AS annotation
FROM lineitem
"""
SOURCES = "SELECT o_orderkey AS deck_id, concat('Orders of ', CAST(o_custkey AS STRING), ' came to 12', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), ' or 3. 5') AS source FROM orders"
#: Boxes: one caption per order and one rect per line of it, on a page of 800 x 1000.
CAPTIONS = """
SELECT o_orderkey AS page_id, o_orderkey AS caption_id, CASE WHEN o_custkey % 3 = 0 THEN 'table' ELSE 'figure' END AS kind,
  CAST(100 AS DOUBLE) AS x0, CAST(400 + o_custkey % 200 AS DOUBLE) AS y0, CAST(500 AS DOUBLE) AS x1, CAST(420 + o_custkey % 200 AS DOUBLE) AS y1, CAST(1000 AS DOUBLE) AS page_h FROM orders
"""
RECTS = """
SELECT l_orderkey AS page_id, CAST(l_suppkey % 7 * 60 AS DOUBLE) AS x0, CAST(l_partkey % 20 * 50 AS DOUBLE) AS y0,
  CAST(l_suppkey % 7 * 60 + 80 + l_quantity AS DOUBLE) AS x1, CAST(l_partkey % 20 * 50 + 20 + l_quantity AS DOUBLE) AS y1, CAST(1000 AS DOUBLE) AS page_h, l_quantity / 4 AS size FROM lineitem
"""
BLOCKS = """
SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS pos,
  concat(CASE l_partkey % 6 WHEN 0 THEN 'Figure ' WHEN 1 THEN 'Fig. ' WHEN 2 THEN 'TABLE ' WHEN 3 THEN 'Tab. ' WHEN 4 THEN '  fig ' ELSE 'As in Figure ' END,
    CASE WHEN l_suppkey % 4 = 0 THEN 'IV' ELSE CAST(l_suppkey % 3 + 1 AS STRING) END, CASE l_partkey % 5 WHEN 0 THEN ': The ' WHEN 1 THEN '. A ' WHEN 2 THEN ' shows ' WHEN 3 THEN ' Results ' ELSE ' ' END,
    repeat('part  ', CAST(l_quantity AS INT) % 7)) AS text FROM lineitem
"""
PAGES = """
SELECT l_partkey * 100000 + l_orderkey AS page_id,
  concat('<section data-layout="', CASE l_suppkey % 3 WHEN 0 THEN 'bullets' WHEN 1 THEN 'section' ELSE 'mystery' END, '"><img class="f" src="figures/', CAST(l_partkey % 50 AS STRING), '.png">',
    CASE WHEN l_partkey % 5 = 0 THEN '<span class="katex-error">x</span>' ELSE '' END, CASE WHEN l_partkey % 7 = 0 THEN ' costs $a+b$ and $c$ ' ELSE '' END, CASE WHEN l_partkey % 11 = 0 THEN '&lt; Presenter &gt; &lt;eos&gt;' ELSE '' END, '</section>') AS html,
  concat('figures/', CAST(l_partkey % 50 AS STRING), '.png') AS src, l_partkey % 50 < 30 AS there
FROM (SELECT DISTINCT l_partkey, l_orderkey, min(l_suppkey) OVER (PARTITION BY l_partkey, l_orderkey) AS l_suppkey FROM lineitem) d
"""
BIB = """
SELECT o_orderkey AS record_id,
  CASE o_orderkey % 3 WHEN 0 THEN concat('arXiv:', CAST(1000 + o_custkey % 9000 AS STRING), '.', CAST(10000 + o_orderkey % 90000 AS STRING), 'v2') WHEN 1 THEN concat('doi:10.1234/p', CAST(o_custkey AS STRING)) ELSE concat('A Study: of ', CAST(o_custkey % 97 AS STRING), ' parts!') END AS query,
  CAST(1990 + o_custkey % 30 AS STRING) AS year, concat('Study ', CAST(o_custkey AS STRING)) AS title, CASE WHEN o_custkey % 2 = 0 THEN 'Journal' END AS venue,
  CASE WHEN o_orderkey % 4 = 0 THEN concat('10.1234/p', CAST(o_custkey AS STRING)) END AS doi, CASE WHEN o_orderkey % 5 = 0 THEN concat(CAST(1000 + o_custkey % 9000 AS STRING), '.', CAST(10000 + o_orderkey % 90000 AS STRING)) END AS arxiv,
  CASE WHEN o_custkey % 5 = 0 THEN 'Ana O''Neil' WHEN o_custkey % 5 = 1 THEN 'Bo Li' WHEN o_custkey % 5 = 2 THEN '' ELSE 'Çem Ö' END AS first, CASE WHEN o_custkey % 3 = 0 THEN 8 ELSE 2 END AS n_authors
FROM orders
"""
