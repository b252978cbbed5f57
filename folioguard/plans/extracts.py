"""Queries of panels, parity, tables, orders, reports and text helpers, with the SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioguard.functions import text as H
from folioguard.operators import bib as B
from folioguard.operators import deck as D
from folioguard.operators import geometry as G
from folioguard.operators import manuscript as M
from folioguard.operators import parity as P
from folioguard.operators import protocol as R
from folioguard.operators import reports as W
from folioguard.operators import tables as T
from folioguard.plans import catalogue as C
from folioguard.plans.catalogue import _query, _sql
from folioguard.sources import extracted as X
from folioguard.sources import readers
from folioguard.sources.readers import table

# Letters of a page: seven places in three columns, two fonts, some capitals and some a little off their row.
SPANS = """SELECT l_orderkey AS page_id, CASE WHEN l_partkey % 23 = 0 THEN upper(substr('abcdefg', CAST(l_linenumber AS INT), 1)) ELSE concat(' ', substr('abcdefg', CAST(l_linenumber AS INT), 1)) END AS text,
  CASE WHEN l_partkey % 10 = 0 THEN 'Bold' ELSE 'Text' END AS font, CASE WHEN l_partkey % 4 = 0 THEN CAST(9 AS DOUBLE) ELSE CAST(8.6 AS DOUBLE) END AS size,
  CAST(100 * ((l_linenumber - 1) % 3) + l_suppkey % 4 AS DOUBLE) AS x0, CAST(100 * floor((l_linenumber - 1) / 3) + l_partkey % 15 AS DOUBLE) AS y0,
  CAST(100 * ((l_linenumber - 1) % 3) + l_suppkey % 4 + 6 AS DOUBLE) AS x1, CAST(100 * floor((l_linenumber - 1) / 3) + l_partkey % 15 + 8 AS DOUBLE) AS y1 FROM lineitem"""
FIGURES = "SELECT o_orderkey AS fig_id, o_orderkey AS page_id, CAST(0 AS DOUBLE) AS x0, CAST(0 AS DOUBLE) AS y0, CAST(250 + o_custkey % 60 AS DOUBLE) AS x1, CAST(260 AS DOUBLE) AS y1 FROM orders"
PANELS = f"""WITH s AS ({SPANS}), f AS ({FIGURES}),
i AS (SELECT fig_id, f.x1 AS fx, f.y1 AS fy, font, round_even(size, 0) AS size, trim(text) AS label, s.y0 AS y, s.x0 AS x FROM f JOIN s USING (page_id) WHERE trim(text) IN ('a', 'b', 'c', 'd', 'e', 'f', 'g', 'h') AND (s.x0 + s.x1) / 2 <= f.x1 + 2),
l AS (SELECT fig_id, fx, fy, font, size, label, min(y) AS y, arg_min(x, ROW(y, x)) AS x, ascii(label) - 96 AS k FROM i GROUP BY ALL),
n AS (SELECT *, coalesce(max(k) FILTER (k = r) OVER (PARTITION BY fig_id, font, size), 0) AS run FROM (SELECT *, row_number() OVER (PARTITION BY fig_id, font, size ORDER BY k) AS r FROM l)),
b AS (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY fig_id ORDER BY run DESC, size DESC, font) AS best FROM n) WHERE best = 1 AND run >= 3 AND k <= run),
p AS (SELECT a.fig_id, a.label, a.x AS x0, a.y AS y0,
  coalesce(min(o.x) FILTER (o.x > a.x + 0.045 * a.fx AND abs(o.y - a.y) <= 0.045 * a.fy), any_value(a.fx)) AS x1,
  coalesce(min(o.y) FILTER (o.y > a.y + 0.045 * a.fy AND abs(o.x - a.x) <= 0.045 * a.fx), any_value(a.fy)) AS y1 FROM b a JOIN b o USING (fig_id) GROUP BY a.fig_id, a.label, a.x, a.y)"""


def panels(spark, sf):
    return G.panel_boxes(_sql(spark, sf, FIGURES, "orders"), _sql(spark, sf, SPANS, "lineitem"))


@_query(PANELS + " SELECT * FROM p")
def panel_boxes(spark, sf):
    return panels(spark, sf)


@_query(PANELS + ", q AS (SELECT o_orderkey AS fig_id, chr(CAST(97 + o_custkey % 5 AS INTEGER)) AS label FROM orders) SELECT fig_id, label, greatest(0, x0 - 1) AS x0, greatest(0, y0 - 1) AS y0, least(260, x1 + 1) AS x1, least(255, y1 + 1) AS y1, x0 IS NOT NULL AS found FROM q JOIN p USING (fig_id, label) UNION ALL SELECT fig_id, label, NULL, NULL, NULL, NULL, false FROM q ANTI JOIN p USING (fig_id, label)")
def panel_clip(spark, sf):
    asked = table(spark, sf, "orders").select(F.col("o_orderkey").alias("fig_id"), F.char((97 + F.col("o_custkey") % 5).cast("long")).alias("label"))
    pages = asked.select("fig_id", F.lit(260.0).alias("page_w"), F.lit(255.0).alias("page_h"))
    return G.panel_clips(asked, panels(spark, sf), pages)


# Decks of five layouts and what was built of them, with one defect for each divisor of p.
PARITY = """SELECT l_orderkey AS deck_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS slide,
  CASE l_suppkey % 5 WHEN 0 THEN 'bullets' WHEN 1 THEN 'assertion-evidence' WHEN 2 THEN 'results-table' WHEN 3 THEN 'paper-title' ELSE 'section' END AS layout, l_partkey AS p, CAST(CAST(l_quantity AS BIGINT) AS STRING) AS n FROM lineitem"""


def parity_decks(spark, sf):
    rows = _sql(spark, sf, PARITY, "lineitem")
    spec = F.expr("""concat('{"layout":"', layout, '","title":"Part k', p, '",', CASE layout
      WHEN 'bullets' THEN concat('"points":["', n, ' units","==k|five=="],"speaker_notes":"', CASE WHEN p % 3 = 0 THEN concat('say k', p) ELSE '' END, '"')
      WHEN 'assertion-evidence' THEN concat('"eyebrow":"Top","figure":{"src":"f.png","caption":"cap $', n, '$"},"annotation":" "')
      WHEN 'results-table' THEN concat('"table":{"rows":[["', n, '",{"v":"', n, '","bold":true}],["9"]]}')
      WHEN 'paper-title' THEN concat('"authors":', CASE WHEN p % 2 = 0 THEN '["Ann","Bob"]' ELSE '"Ann, Bob"' END, ',"affiliation":"Lab"')
      ELSE concat('"num":"', n, '"') END, '}')""")
    decks = rows.select("deck_id", "slide", spec.alias("spec")).groupBy("deck_id").agg(F.array_sort(F.collect_list(F.struct("slide", "spec"))).alias("x"))
    slides = D.slides_of(decks.select("deck_id", F.concat(F.lit('{"slides":['), F.array_join("x.spec", ","), F.lit("]}")).alias("spec")))
    text = F.expr("""concat(CASE WHEN p % 7 = 0 THEN 'untitled' ELSE concat('PART  k', p) END, ' ', CASE layout WHEN 'bullets' THEN concat(n, ' units; five') WHEN 'assertion-evidence' THEN concat('top cap ', n) WHEN 'paper-title' THEN 'Ann, Bob at Lab' WHEN 'section' THEN n ELSE 'see table' END)""")
    cells = F.when((F.col("layout") == "results-table") & (F.col("p") % 17 > 0), F.when(F.col("p") % 5 == 0, F.array("n", F.lit("x9"))).otherwise(F.array(F.lit("9"), "n", "n")))
    built = rows.where("p % 19 > 0").select(
        "deck_id", "slide", text.alias("text"), F.when(F.col("p") % 11 > 0, F.concat(F.lit("Say  k"), "p")).alias("notes"), cells.alias("cells"), (F.col("p") % 13 > 0).alias("has_picture"), (F.col("p") % 13 > 0).alias("has_table")
    )
    return slides, built


PARITY_SQL = f"""WITH a AS ({PARITY.replace("STRING", "VARCHAR")}), b AS (SELECT * FROM a WHERE p % 19 > 0), c AS (SELECT *, unnest(CASE WHEN p % 17 = 0 THEN CASE WHEN n = '9' THEN [0, 1, 2] ELSE [0, 1, 2] END WHEN p % 5 = 0 THEN [1, 2] WHEN n = '9' THEN [] ELSE [] END) AS i FROM b WHERE layout = 'results-table')
SELECT deck_id, slide, 'missing-text' AS kind, 'title' AS field FROM b WHERE p % 7 = 0
UNION ALL SELECT deck_id, slide, 'missing-text', concat('table.cell[', i, ']') FROM c
UNION ALL SELECT deck_id, slide, 'missing-notes', '' FROM b WHERE layout = 'bullets' AND p % 3 = 0 AND p % 11 = 0
UNION ALL SELECT deck_id, slide, CASE layout WHEN 'results-table' THEN 'missing-table' ELSE 'missing-figure' END, '' FROM b WHERE p % 13 = 0 AND layout IN ('results-table', 'assertion-evidence')
UNION ALL SELECT deck_id, 0, 'slide-count', concat(count(*), '/', count(*) FILTER (p % 19 > 0)) FROM a GROUP BY deck_id HAVING count(*) FILTER (p % 19 = 0) > 0"""


@_query(PARITY_SQL)
def parity_findings(spark, sf):
    return P.parity_findings(*parity_decks(spark, sf))


@_query("SELECT deck_id, count(*) AS expected, count(*) FILTER (p % 19 > 0) AS built FROM (SELECT l_orderkey AS deck_id, l_partkey AS p FROM lineitem) GROUP BY deck_id HAVING count(*) FILTER (p % 19 = 0) > 0")
def slide_counts(spark, sf):
    return P.slide_count_mismatches(*parity_decks(spark, sf))


SPEC = """SELECT p_partkey AS table_id, p_size % 8 + 1 AS k, p_partkey % 2 = 0 AS captioned, p_partkey % 3 = 0 AS noted, p_partkey % 4 = 0 AS headed, p_partkey % 10 > 0 AS fine FROM part"""


def table_specs(spark, sf):
    spec = F.expr("""CASE WHEN fine THEN concat('{"columns":["A & B",{"label":"Acc","unit":"%"}],"row_header":', CAST(headed AS STRING), CASE WHEN captioned THEN ',"caption":"Best <1>"' ELSE '' END, CASE WHEN noted THEN ',"footnote":"n"' ELSE '' END,
      ',"rows":[', array_join(array_repeat('["m<1",{"v":"28.4","bold":true}],["x",7]', CAST(k AS INT)), ','), ']}') ELSE '{"rows":[]}' END""")
    return _sql(spark, sf, SPEC, "part").select("table_id", spec.alias("spec"))


@_query(f"""SELECT table_id, CASE WHEN fine THEN concat('<table class="results', CASE WHEN 2 * k <= 6 THEN ' roomy' ELSE '' END, '">', CASE WHEN captioned THEN '<caption>Best &lt;1&gt;</caption>' ELSE '' END, '<thead><tr><th>A &amp; B</th><th>Acc<span class="u">%</span></th></tr></thead><tbody>',
  repeat(CASE WHEN headed THEN '<tr><th>m&lt;1</th><td><strong>28.4</strong></td></tr><tr><th>x</th><td>7</td></tr>' ELSE '<tr><td>m&lt;1</td><td><strong>28.4</strong></td></tr><tr><td>x</td><td>7</td></tr>' END, k), '</tbody>', CASE WHEN noted THEN '<tfoot><tr><td colspan="2">n</td></tr></tfoot>' ELSE '' END, '</table>') END AS html FROM ({SPEC})""")
def table_html(spark, sf):
    return T.as_html(table_specs(spark, sf))


@_query(f"""WITH s AS (SELECT * FROM ({SPEC}) WHERE fine), r AS (SELECT *, unnest(range(1, 2 * k + 1)) AS row FROM s)
SELECT table_id, 0 AS row, i AS col, ['A & B', 'Acc (%)'][i + 1] AS text, true AS bold, 'center' AS align FROM s, range(2) t(i)
UNION ALL SELECT table_id, row, 0, CASE row % 2 WHEN 1 THEN 'm<1' ELSE 'x' END, false, CASE WHEN headed THEN 'left' ELSE 'right' END FROM r
UNION ALL SELECT table_id, row, 1, CASE row % 2 WHEN 1 THEN '28.4' ELSE '7' END, row % 2 = 1, 'right' FROM r""")
def table_rows(spark, sf):
    return T.table_rows(table_specs(spark, sf))


MARKED = "SELECT p_partkey, concat('see ==k|', p_name, '== & ==p|up==, ==w|a=b==, ==plain ', CAST(p_size AS STRING), '== x==y') AS t FROM part"


@_query(f"""SELECT p_partkey, concat('see <span class="key">', p_name, '</span> &amp; <span class="pos">up</span>, <span class="warn">a=b</span>, <span class="metric">plain ', p_size, '</span> x==y') AS html FROM part""")
def emphasis_html(spark, sf):
    return _sql(spark, sf, MARKED, "part").select("p_partkey", H.render_emphasis(H.escape_html(F.col("t"))).alias("html"))


@_query("SELECT p_partkey, unnest(CASE p_partkey % 3 WHEN 0 THEN [{'i': 0, 'kind': 'prose', 'text': 'cost '}, {'i': 1, 'kind': 'inline', 'text': 'a_1'}, {'i': 2, 'kind': 'display', 'text': p_name || chr(10) || 'x'}, {'i': 3, 'kind': 'prose', 'text': ' end $5'}] WHEN 1 THEN [{'i': 0, 'kind': 'prose', 'text': p_name}] ELSE [{'i': 0, 'kind': 'inline', 'text': 'b'}] END, recursive := true) FROM part")
def math_parts(spark, sf):
    text = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat('cost $a_1$$$', p_name, '\\nx$$ end $5') WHEN 1 THEN p_name ELSE '$b$' END")
    return table(spark, sf, "part").select("p_partkey", F.posexplode(H.math_segments(text)).alias("i", "s")).select("p_partkey", "i", "s.kind", "s.text")


SOURCES = "SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN '1706.03762v2' WHEN 1 THEN ' 2101.00001 ' WHEN 2 THEN 'https://ArXiv.org/abs/2101.12345v3' WHEN 3 THEN 'papers/My Paper (1).v2.pdf' WHEN 4 THEN '.hidden' WHEN 5 THEN 'http://x.org/2101.00001.pdf' ELSE '%%%' END AS arg, o_orderkey % 7 IN (3, 4) AS there FROM orders"


@_query("SELECT o_orderkey, CASE o_orderkey % 7 WHEN 3 THEN 'file' WHEN 4 THEN 'file' WHEN 5 THEN 'unknown' WHEN 6 THEN 'unknown' ELSE 'arxiv' END AS kind, CASE o_orderkey % 7 WHEN 0 THEN '1706.03762' WHEN 1 THEN '2101.00001' WHEN 2 THEN '2101.12345' END AS arxiv_id, CASE o_orderkey % 7 WHEN 0 THEN '1706' WHEN 1 THEN '_2101' WHEN 2 THEN '2101' WHEN 3 THEN 'My_Paper_1_v2' WHEN 4 THEN '_hidden' WHEN 5 THEN '2101_00001' ELSE '_' END AS stem FROM orders")
def source_kinds(spark, sf):
    return _sql(spark, sf, SOURCES, "orders").select("o_orderkey", H.source_kind(F.col("arg"), F.col("there")).alias("s"), H.source_stem(F.col("arg")).alias("stem")).select("o_orderkey", "s.*", "stem")


INVENTORY = C.ORACLES["inventory_best"]


@_query(f"SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, kind, number) AS place FROM ({INVENTORY})")
def inventory_places(spark, sf):
    return G.inventory_order(C.inventory_best(spark, sf))


@_query(f"SELECT doc_id, kind, number, row_number() OVER (PARTITION BY doc_id ORDER BY kind <> 'figure', CASE number WHEN 'IV' THEN 4 ELSE CAST(number AS INTEGER) END, number) AS place FROM ({INVENTORY})")
def figure_places(spark, sf):
    return G.figure_order(C.inventory_best(spark, sf)).select("doc_id", "kind", "number", "place")


@_query(f"SELECT doc_id, count(*) FILTER (kind = 'figure') AS n_figures, count(*) FILTER (kind = 'table') AS n_tables, count(*) FILTER (localized) AS n_localized, count(*) FILTER (NOT localized) AS n_flagged FROM ({INVENTORY}) GROUP BY doc_id")
def bundle_counts(spark, sf):
    return G.bundle_counts(C.inventory_best(spark, sf))


SPECS = """SELECT o_orderkey AS deck_id, CASE o_orderkey % 6 WHEN 0 THEN '{"slides":[]}' WHEN 1 THEN '{"slides":[{"layout":"bullets"}]}' WHEN 2 THEN 'not json' WHEN 3 THEN '{"title":"x"}' WHEN 4 THEN '[1]' END AS spec FROM orders"""


@_query("SELECT o_orderkey AS deck_id, 'P0' AS severity, CASE WHEN o_orderkey % 6 IN (0, 3) THEN 'no-slides' ELSE 'unreadable' END AS category FROM orders WHERE o_orderkey % 6 <> 1")
def deck_problems(spark, sf):
    return D.deck_problems(_sql(spark, sf, SPECS, "orders"))


@_query(C.SLIDES + " SELECT deck_id, layout, count(*) AS slides FROM s GROUP BY ALL")
def layout_counts(spark, sf):
    return D.layout_counts(C.slides(spark, sf))


REPORTED = "SELECT l_orderkey AS deck_id, concat('P', CAST(l_partkey % 5 AS STRING)) AS severity, CASE WHEN l_suppkey % 2 = 0 THEN 'spec' ELSE 'verify' END AS stage, 'size' AS check_, CASE WHEN l_partkey % 3 > 0 THEN l_linenumber END AS slide, concat('part ', CAST(l_partkey AS STRING)) AS detail FROM lineitem"


@_query(f"SELECT deck_id, string_agg(concat('[', severity, '] ', n, chr(10), body), chr(10) || chr(10) ORDER BY severity) AS report FROM (SELECT deck_id, severity, count(*) AS n, string_agg(line, chr(10) ORDER BY s, line) AS body FROM (SELECT *, coalesce(slide, 0) AS s, concat('  • (', stage, '/size) ', CASE WHEN slide > 0 THEN concat('slide ', slide) ELSE 'deck' END, ': ', detail) AS line FROM ({REPORTED})) WHERE severity < 'P4' GROUP BY ALL) GROUP BY deck_id")
def qa_report(spark, sf):
    return D.qa_report(_sql(spark, sf, REPORTED, "lineitem").withColumnRenamed("check_", "check"))


@_query(C.ALL + " SELECT doc_id, string_agg(concat('- **', severity, '** ', category, ' (', CASE line_no WHEN 0 THEN 'global' ELSE concat('line ', line_no) END, '): ', detail), chr(10) ORDER BY CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END, category, line_no, detail) AS report FROM f GROUP BY doc_id")
def audit_markdown(spark, sf):
    return M.markdowns(M.audits(C.lines(spark, sf)))


TALK = "SELECT conv_id AS deck_id, CAST(turn AS BIGINT) AS slide, CASE WHEN turn % 2 = 0 THEN 'bullets' ELSE 'section' END AS layout, CASE WHEN turn % 3 = 0 THEN '' ELSE concat('Turn $t_', CAST(turn AS STRING), '$ ==k|on==') END AS action_title, CASE WHEN turn % 3 = 0 AND turn % 2 = 0 THEN '' ELSE role END AS title, text AS speaker_notes FROM conversations"


@_query(f"WITH t AS ({TALK.replace('STRING', 'VARCHAR')}), m AS (SELECT *, CAST(round(greatest(coalesce({C.WORDS.replace('text', 'speaker_notes')}, 0), 0.5) * 60) AS BIGINT) AS sec, CASE WHEN action_title <> '' THEN concat('Turn t_', slide, ' on') WHEN title <> '' THEN title ELSE concat('(', layout, ')') END AS head FROM t) SELECT deck_id, string_agg(concat('## Slide ', slide, ' — ', head, '  _(', sec // 60, ':', lpad(CAST(sec % 60 AS VARCHAR), 2, '0'), ')_', chr(10), coalesce(nullif(speaker_notes, ''), '_[no notes — add a spoken script]_')), chr(10) || chr(10) ORDER BY slide) AS handout FROM m GROUP BY deck_id")
def notes_handout(spark, sf):
    return D.notes_handout(_sql(spark, sf, TALK, "conversations"))


EQUATIONS = """SELECT o_orderkey AS deck_id, concat('{"slides":[{"layout":"bullets"},{"layout":"equation","equations":[{"latex":"x_', CAST(o_custkey AS STRING), '","num":"1"},{"latex":"y"}', CASE WHEN o_custkey % 2 = 0 THEN ',{"num":3}' ELSE '' END, ']}]}') AS spec FROM orders"""


@_query("SELECT o_orderkey AS deck_id, 2 AS slide, 0 AS eq, concat('x_', o_custkey) AS latex, '1' AS num FROM orders UNION ALL SELECT o_orderkey, 2, 1, 'y', NULL FROM orders UNION ALL SELECT o_orderkey, 2, 2, NULL, '3' FROM orders WHERE o_custkey % 2 = 0")
def equations(spark, sf):
    return D.equations_of(D.slides_of(_sql(spark, sf, EQUATIONS, "orders")))


@_query("SELECT p_partkey, list_reduce(list_filter(regexp_split_to_array(p_name || ' ' || p_type, '\\s+'), lambda w: w <> ''), lambda a, w: CASE WHEN length(regexp_extract(a, '[^\\n]*$')) + 1 + length(w) <= 12 THEN a || ' ' || w ELSE a || chr(10) || w END) AS lines, CASE WHEN p_size % 9 > 0 THEN least(1600 / (p_size % 9 * 100), 800 / (p_size * 10)) END AS scale FROM part")
def title_fit(spark, sf):
    scale = D.contain_scale(F.col("p_size") % 9 * 100, F.col("p_size") * 10, F.lit(1600), F.lit(800))
    return table(spark, sf, "part").select("p_partkey", F.array_join(D.wrapped(F.concat("p_name", F.lit("  "), "p_type"), F.lit(12)), "\n").alias("lines"), scale.alias("scale"))


@_query("WITH p AS (SELECT concat('s', p_size) AS stem, bool_or(p_partkey % 3 = 0) AS md FROM part GROUP BY p_size) SELECT stem, CASE WHEN md THEN '.md' ELSE '.txt' END AS suffix FROM p WHERE stem NOT IN (SELECT concat('s', s_nationkey) FROM supplier WHERE s_suppkey * 500 > 10000)")
def pending_prompts(spark, sf):
    prompts = table(spark, sf, "part").select(F.concat(F.lit("s"), "p_size").alias("stem"), F.when(F.col("p_partkey") % 3 == 0, ".md").otherwise(".txt").alias("suffix")).distinct()
    outputs = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_nationkey").alias("stem"), (F.col("s_suppkey") * 500).alias("bytes"))
    return readers.pending(prompts, outputs)


@_query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN 'jpg' WHEN 2 THEN 'webp' ELSE 'png' END AS format, CASE WHEN o_orderkey % 5 IN (0, 4) AND o_custkey % 200 > 0 THEN o_custkey % 200 END AS width, CASE WHEN o_orderkey % 5 IN (0, 4) AND o_custkey % 200 > 0 THEN 513 END AS height FROM orders")
def image_kinds(spark, sf):
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452000000"), F.lpad(F.hex(F.col("o_custkey") % 200), 2, "0"), F.lit("00000201"))
    k = F.col("o_orderkey") % 5
    content = F.unhex(F.when(k == 1, "FFD8FFE0").when(k == 2, "524946460000000057454250").when(k == 3, "00112233").otherwise(png))
    rows = table(spark, sf, "orders").select("o_orderkey", H.image_format(content).alias("format"), H.probed_size(content).alias("s"))
    return rows.select("o_orderkey", "format", "s.width", "s.height")


@_query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '2101.00001' WHEN 1 THEN '1234.5678' END AS stamp, CASE o_orderkey % 4 WHEN 0 THEN '2101.00001' WHEN 1 THEN '1234.5678' WHEN 2 THEN '1999.12345' END AS any_id FROM orders")
def arxiv_ids(spark, sf):
    text = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'see arXiv:1999.12345 or arXiv:2101.00001v3 [cs.CL] 1 Jan' WHEN 1 THEN 'ARXIV:1234.5678 [x]' WHEN 2 THEN 'as in arXiv:1999.12345v2, later' ELSE 'arXiv 12' END")
    return table(spark, sf, "orders").select("o_orderkey", H.arxiv_id(text, True).alias("stamp"), H.arxiv_id(text).alias("any_id"))


@_query("SELECT p_partkey, regexp_replace(p_name || '/é-' || p_size, '[^\\p{L}\\p{N}_]+', '_', 'g') AS slug, CASE p_size % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.webp' ELSE '.png' END AS ext, concat('out.d/pic', CASE p_size % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.webp' ELSE '.png' END) AS path, CASE p_size % 4 WHEN 0 THEN 14 WHEN 1 THEN 1990 WHEN 2 THEN 4 END AS roman, concat('&lt;', p_name, '&gt;&amp;&quot;&#39;') AS html, CAST(round(CAST(p_size AS DOUBLE) / 1920 * 13.333, 3) AS DOUBLE) AS inches FROM part")
def text_helpers(spark, sf):
    k = F.col("p_size") % 4
    mime = F.when(k == 0, "image/jpg").when(k == 1, "image/webp").when(k == 2, "image/png").otherwise("x")
    path = F.when(k == 3, "out.d/pic").otherwise("out.d/pic.bin")
    return table(spark, sf, "part").select(
        "p_partkey", H.slug(F.concat("p_name", F.lit("/é-"), F.col("p_size").cast("string"))).alias("slug"), H.extension_for_mime(mime).alias("ext"), H.with_extension(path, mime).alias("path"),
        H.roman(F.when(k == 0, "XIV").when(k == 1, "MCMXC").when(k == 2, "IV").otherwise("12")).alias("roman"), H.escape_html(F.concat(F.lit("<"), "p_name", F.lit(">&\"'"))).alias("html"), H.px_to_inches(F.col("p_size")).alias("inches"),
    )


@_query("SELECT l_orderkey AS deck_id, count(*) BETWEEN 5 AND 9 AS agenda, count(*) BETWEEN 4 AND 5 AS points FROM lineitem GROUP BY ALL")
def size_rules(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("deck_id")).agg(F.collect_list("l_partkey").alias("x"))
    return rows.select("deck_id", R.agenda_size(F.col("x")).alias("agenda"), R.key_points_fine(F.size("x")).alias("points"))


@_query(f"SELECT kind, count(*) AS queries, count(*) FILTER (resolved) AS resolved FROM ({C.ORACLES['bib_resolve']}) GROUP BY kind")
def resolved_counts(spark, sf):
    return B.resolved_counts(C.bib_resolve(spark, sf))


PLACE = "list_position([" + ", ".join(f"'{c}'" for c in W.SCANNERS) + "], category)"


@_query(C.ALL + f""", g AS (SELECT doc_id, string_agg(concat('{{"severity":"', severity, '","category":"', category, '","line_no":', line_no, ',"detail":"', detail, '"}}'), ',' ORDER BY {PLACE}, line_no, detail) AS items FROM f GROUP BY doc_id),
c AS (SELECT doc_id, string_agg(concat('"', severity, '":', n), ',' ORDER BY CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END) AS summary FROM (SELECT doc_id, severity, count(*) AS n FROM f GROUP BY ALL) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS refs FROM refs GROUP BY doc_id)
SELECT d.doc_id, concat('{{"file":', d.doc_id, ',"reference_count":', coalesce(refs, 0), ',"findings":[', coalesce(items, ''), '],"summary":{{', coalesce(summary, ''), '}}}}') AS report FROM (SELECT DISTINCT doc_id FROM lines) d LEFT JOIN g USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)""")
def audit_json(spark, sf):
    return W.audited_documents(M.audits(C.lines(spark, sf)))


@_query(C.GATE + " SELECT deck_id, CASE gate WHEN 'BLOCK' THEN 2 WHEN 'REVIEW' THEN 1 ELSE 0 END AS status, concat('{\"p0\":', p0, ',\"p1\":', p1, ',\"p2\":', p2, ',\"p3\":', p3, '}') AS summary, p0 + p1 + p2 + p3 AS findings FROM gates")
def review_json(spark, sf):
    rows = W.review_documents(D.gated(D.deck_reviews(C.slides(spark, sf), C.sources(spark, sf))))
    n = F.size(F.from_json(F.get_json_object("report", "$.findings"), "array<string>")).cast("long")
    return rows.select("deck_id", "status", F.get_json_object("report", "$.summary").alias("summary"), n.alias("findings"))


@_query("SELECT o_orderkey AS query, CASE WHEN o_custkey % 3 > 0 THEN concat('  [ok]  k', o_custkey, ': Ref.') ELSE concat('  [UNVERIFIED] ', o_orderkey) END AS line FROM orders")
def reference_lines(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("query"), (F.col("o_custkey") % 3 > 0).alias("resolved"), F.concat(F.lit("k"), "o_custkey").alias("key"), F.lit("Ref.").alias("reference"))
    return W.reference_lines(rows).withColumn("query", F.col("query").cast("long"))


PAGED = "SELECT o_orderkey AS doc_id, k AS page, CASE WHEN k = 1 AND o_custkey % 3 = 0 THEN concat('arXiv:2101.', CAST(10000 + o_custkey AS STRING), 'v1 [cs] Jan') WHEN k = 2 THEN 'cites arXiv:1999.99999 [x]' WHEN k = 1 THEN concat('Page of ', CAST(o_custkey AS STRING)) END AS text FROM orders CROSS JOIN (SELECT 3 AS k UNION ALL SELECT 1 AS k UNION ALL SELECT 2 AS k) t WHERE k <= o_custkey % 4"


def ingests(spark, sf):
    meta = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("T"), "o_custkey")).otherwise("").alias("title"))
    return X.ingest_of(_sql(spark, sf, PAGED, "orders"), meta)


INGESTS = f"SELECT doc_id, n_pages, full_text, CASE WHEN o_custkey % 2 = 0 THEN concat('T', o_custkey) END AS title, CASE WHEN o_custkey % 3 = 0 THEN concat('2101.', 10000 + o_custkey) END AS arxiv_id FROM (SELECT doc_id, count(*) AS n_pages, string_agg(coalesce(text, ''), chr(10) ORDER BY page) AS full_text FROM ({PAGED.replace('STRING', 'VARCHAR')}) GROUP BY doc_id) JOIN orders ON o_orderkey = doc_id"


@_query(INGESTS)
def ingest_documents(spark, sf):
    return ingests(spark, sf)


@_query(f"""SELECT i.doc_id, concat('{{"doc_id":', i.doc_id, ',"n_pages":', n_pages, ',"title":', coalesce('"' || title || '"', 'null'), ',"arxiv_id":', coalesce('"' || arxiv_id || '"', 'null'), ',"n_figures":', coalesce(n_figures, 0), ',"n_tables":', coalesce(n_tables, 0), ',"n_localized":', coalesce(n_localized, 0), ',"n_flagged":', coalesce(n_flagged, 0), '}}') AS manifest FROM ({INGESTS}) i LEFT JOIN ({C.ORACLES.get('bundle_counts', '')}) b ON b.doc_id = i.doc_id""")
def bundle_manifests(spark, sf):
    return W.bundles(ingests(spark, sf), G.bundle_counts(C.inventory_best(spark, sf)))


FILES = """SELECT l_orderkey AS deck_id, CASE l_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'slides' ELSE 'old' END AS folder,
  concat(CAST(l_linenumber AS STRING), CASE WHEN l_partkey % 9 = 0 THEN '-page-' ELSE '-slide-' END, CASE WHEN l_partkey % 2 = 0 THEN 'x.y' ELSE 'z' END, CASE l_partkey % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' WHEN 2 THEN '.jpeg' ELSE '.gif' END) AS name FROM lineitem"""


@_query(f"WITH f AS ({FILES.replace('STRING', 'VARCHAR')}), o AS (SELECT deck_id, name, min(folder) AS folder, CAST(string_split(name, '-')[1] AS INTEGER) AS number FROM f WHERE contains(name, '-slide-') AND NOT ends_with(name, '.gif') AND folder <> 'old' GROUP BY deck_id, name) SELECT deck_id, row_number() OVER (PARTITION BY deck_id ORDER BY number, name) AS place, number, name, folder, number % 2 = 0 AND contains(name, 'x.y.') AS prompted FROM o")
def slide_images(spark, sf):
    files = _sql(spark, sf, FILES, "lineitem")
    prompts = table(spark, sf, "orders").select(F.col("o_orderkey").alias("deck_id"), F.explode(F.array(*(F.lit(f"{k}-slide-x.y") for k in (2, 4, 6, 8)))).alias("stem"))
    return D.slide_images(files, prompts)
