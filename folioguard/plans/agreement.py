"""Queries of edits, quantities, digests and bundles, with the SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioguard.operators import consistency as K
from folioguard.operators import edits as E
from folioguard.operators import mapping as M
from folioguard.operators import placement as T
from folioguard.plans import catalogue as C
from folioguard.plans.catalogue import _query, _sql
from folioguard.sources import bundles as B
from folioguard.sources.readers import table
from folioguard.sources.scratch import scratch_path

# A deck for each order, a slide for each of its lines, and a log that depends on the order.
DECKS = "SELECT l_orderkey AS deck_id, count(*) AS n, l_orderkey % 5 AS c FROM lineitem GROUP BY l_orderkey"


def edited(spark, sf):
    decks = _sql(spark, sf, DECKS, "lineitem")
    slides = decks.select("deck_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("position")).withColumn("slug", F.concat(F.lit("s"), "position"))
    log = F.expr("""array_compact(array(named_struct('step', 1L, 'op', 'insert', 'slug', 'new', 'position', 2L, 'new_slug', CAST(NULL AS STRING)),
      CASE WHEN c < 3 THEN named_struct('step', 2L, 'op', 'delete', 'slug', 's1', 'position', CAST(NULL AS BIGINT), 'new_slug', CAST(NULL AS STRING)) END,
      CASE WHEN c BETWEEN 1 AND 3 THEN named_struct('step', 3L, 'op', 'move', 'slug', 's3', 'position', -7L, 'new_slug', CAST(NULL AS STRING)) END,
      CASE WHEN c > 1 THEN named_struct('step', 4L, 'op', 'rename', 'slug', 's2', 'position', CAST(NULL AS BIGINT), 'new_slug', 'key') END,
      CASE WHEN c = 4 THEN named_struct('step', 5L, 'op', 'insert', 'slug', 'new', 'position', 1L, 'new_slug', CAST(NULL AS STRING)) END,
      CASE WHEN c = 0 THEN named_struct('step', 6L, 'op', 'delete', 'slug', 'nope', 'position', CAST(NULL AS BIGINT), 'new_slug', CAST(NULL AS STRING)) END))""")
    return E.replayed(slides, decks.select("deck_id", F.explode(log).alias("e")).select("deck_id", "e.*"))


@_query(f"""WITH a AS (SELECT *, list_transform(range(1, n + 1), lambda i: 's' || i) AS s FROM ({DECKS})),
b AS (SELECT *, list_filter(s[1:1] || ['new'] || s[2:], lambda x: c >= 3 OR x <> 's1') AS t FROM a),
d AS (SELECT *, CASE WHEN c BETWEEN 1 AND 3 AND n >= 3 THEN ['s3'] || list_filter(t, lambda x: x <> 's3') ELSE t END AS u FROM b),
e AS (SELECT deck_id, unnest(u) AS slug, generate_subscripts(u, 1) AS k, c FROM d),
f AS (SELECT deck_id, CASE WHEN slug <> 'new' THEN printf('%02d-slide-', CAST(slug[2:] AS BIGINT)) || slug END AS old_stem, printf('%02d-slide-', k) || CASE WHEN slug = 's2' AND c > 1 THEN 'key' ELSE slug END AS new_stem FROM e)
SELECT deck_id, CASE WHEN old_stem IS NULL THEN 'create' WHEN old_stem = new_stem THEN 'keep' ELSE 'rename' END AS action, old_stem, new_stem FROM f UNION ALL SELECT deck_id, 'remove', '01-slide-s1', NULL FROM a WHERE c < 3""")
def deck_edits(spark, sf):
    return E.file_changes(edited(spark, sf))


@_query(f"SELECT deck_id, CASE c WHEN 4 THEN 5 ELSE 6 END AS step FROM ({DECKS}) WHERE c IN (0, 4) UNION ALL SELECT deck_id, 3 FROM ({DECKS}) WHERE c BETWEEN 1 AND 3 AND n < 3 UNION ALL SELECT deck_id, 4 FROM ({DECKS}) WHERE c > 1 AND n < 2")
def ignored_edits(spark, sf):
    return E.ignored_edits(edited(spark, sf))


@_query(C.LINES + """, q AS (SELECT doc_id, line_no, lower(regexp_extract(line, '^(\\w+) et al', 1)) AS entity, CAST(regexp_extract(line, 'reported (\\d+) units', 1) AS BIGINT) AS amount FROM lines WHERE contains(line, ' et al. ['))
SELECT doc_id, entity, 'unit' AS unit, array_to_string(list_sort(list(DISTINCT amount)), ',') AS amounts, array_to_string(list_sort(list(DISTINCT line_no)), ',') AS lines FROM q GROUP BY doc_id, entity HAVING count(DISTINCT amount) > 1""")
def conflicting_quantities(spark, sf):
    found = K.conflicting_quantities(C.lines(spark, sf))
    return found.select("doc_id", "entity", "unit", F.array_join(F.transform("amounts", lambda a: a.cast("long").cast("string")), ",").alias("amounts"), F.array_join(F.transform("lines", lambda n: n.cast("string")), ",").alias("lines"))


DIGESTED = "SELECT o_orderkey AS paper_id, o_custkey AS c, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders"


@_query(f"""WITH d AS ({DIGESTED}), w AS (SELECT *, CAST(v + 1 AS VARCHAR) AS n FROM d WHERE c % 3 = 0 AND v + 1 <> c AND v + 1 <> 12)
SELECT paper_id, '$.results.key_metrics[1].value' AS path, n AS value, n AS missing FROM w
UNION ALL SELECT paper_id, '$.results.key_metrics[1].unit', 'USD', 'USD' FROM d WHERE c % 4 = 0
UNION ALL SELECT paper_id, '$.method.equations[0].latex', 'x = 13.5', '13.5' FROM d WHERE c % 5 = 0
UNION ALL SELECT paper_id, '$.limitations[0][1]', 'no limits', 'no limits' FROM d WHERE c % 7 = 0""")
def digest_grounding(spark, sf):
    rows = _sql(spark, sf, DIGESTED, "orders")
    digest = F.expr("""concat('{"problem":"Many  ORDERS","gap":"[UNVERIFIED 99]","contributions":[],"method":{"one_idea":null,"equations":[{"id":"77","latex":"', CASE WHEN c % 5 = 0 THEN 'x = 13.5' ELSE 'x = 12' END, '","source_ref":"p. 98"}]},
      "results":{"key_metrics":[{},{"name":"total","value":', CASE WHEN c % 3 = 0 THEN v + 1 ELSE v END, ',"unit":"', CASE WHEN c % 4 = 0 THEN 'USD' ELSE 'EUR' END, '"}]},"limitations":[[" ","', CASE WHEN c % 7 = 0 THEN 'no limits' ELSE 'x' END, '"]],"language":"zz","asset_inventory":[{"factual":true}]}')""")
    source = F.expr("concat('We saw many orders of ', c, ' with a total of ', v, ' EUR; x = 12.')")
    return K.ungrounded_leaves(rows.select("paper_id", digest.alias("digest")), rows.select("paper_id", source.alias("source")))


# Bundles of two sources each that share a file name, written twice; what changes in between follows from the key.
@_query("""SELECT concat('paper_', s_suppkey // 2, CASE WHEN s_suppkey % 2 = 1 THEN '_2' ELSE '' END) AS bundle, CASE WHEN s_suppkey % 3 = 0 THEN 'written' ELSE 'unchanged' END AS state,
  concat('{"pages":', s_suppkey % 9, CASE WHEN s_suppkey % 3 = 0 THEN '0' ELSE '' END, '}') AS ingest, CASE WHEN s_suppkey % 4 = 0 THEN CASE WHEN s_suppkey % 3 = 0 THEN '' END ELSE concat('["', s_name, '"]') END AS figures FROM supplier""")
def bundle_folders(spark, sf):
    rows = table(spark, sf, "supplier").select(
        F.expr("concat('in/', CASE WHEN s_suppkey % 2 = 0 THEN 'a' ELSE 'b' END, '/paper ', CAST(floor(s_suppkey / 2) AS BIGINT), '.pdf')").alias("source"), "s_suppkey",
        F.expr("""concat('{"pages":', s_suppkey % 9, '}')""").alias("ingest"), F.expr("""CASE WHEN s_suppkey % 12 = 0 OR s_suppkey % 4 > 0 THEN concat('["', s_name, '"]') END""").alias("figures"), F.lit("{}").alias("manifest"),
    )
    path = scratch_path(spark, "bundles")
    B.write_bundles(B.bundle_files(rows), path)
    changed = F.col("s_suppkey") % 3 == 0
    again = rows.withColumns({"ingest": F.when(changed, F.replace("ingest", F.lit("}"), F.lit("0}"))).otherwise(F.col("ingest")), "figures": F.when(F.col("s_suppkey") % 12 > 0, F.col("figures"))})
    state = B.write_bundles(B.bundle_files(again), path)
    there = B.read_bundles(spark, path).groupBy("bundle").agg(*(F.max(F.when(F.col("file") == f, F.col("content"))).alias(f) for f in ("ingest", "figures")))
    return state.join(there, "bundle")


# A slide for each line of an order, a figure for each line of every third part. Topic words are those of the table.
PAGES = """SELECT l_orderkey AS deck_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS slide, l_partkey AS p,
  concat(CASE l_partkey % 5 WHEN 0 THEN 'The framework of ' WHEN 1 THEN 'Main results on ' WHEN 2 THEN 'Ablation: ' ELSE 'On ' END, 'part ', substr('abcdefghijklmnopqrstuvwxyz', CAST(l_partkey % 20 + 1 AS INT), 4), ' from ', substr('zyxwvutsrqponmlkjihgfedcba', CAST(l_suppkey % 20 + 1 AS INT), 5)) AS text,
  concat(CASE l_suppkey % 4 WHEN 0 THEN 'Our architecture with ' WHEN 1 THEN 'Comparison of ' ELSE 'Seen: ' END, substr('abcdefghijklmnopqrstuvwxyz', CAST(l_partkey % 20 + 1 AS INT), 4), ' part') AS caption FROM lineitem"""
MAPPED = f"""WITH RECURSIVE s AS ({PAGES}), f AS (SELECT deck_id, slide AS fig_id, caption FROM s WHERE p % 3 = 0),
t AS (SELECT 's' AS kind, deck_id, slide AS id, text FROM s UNION ALL SELECT 'f', deck_id, fig_id, caption FROM f),
w AS (SELECT kind, deck_id, id, unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS term FROM t),
i AS (SELECT term, ln((1 + (SELECT count(*) FROM t)) / (1 + count(DISTINCT (kind, deck_id, id)))) + 1 AS idf FROM w GROUP BY term),
n AS (SELECT kind, deck_id, id, term, count(*) * any_value(idf) AS w FROM w JOIN i USING (term) GROUP BY ALL),
u AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY kind, deck_id, id)) AS v FROM n),
c AS (SELECT a.deck_id, a.id AS fig_id, b.id AS slide, sum(a.v * b.v) AS cosine FROM u a JOIN u b ON a.kind = 'f' AND b.kind = 's' AND a.deck_id = b.deck_id AND a.term = b.term GROUP BY ALL),
k AS (SELECT *, CASE WHEN contains(lower(text), 'architecture') OR contains(lower(text), 'framework') THEN 'Methods' WHEN contains(lower(text), 'comparison') OR contains(lower(text), 'results') THEN 'Results' WHEN contains(lower(text), 'ablation') THEN 'Analysis' END AS topic FROM t),
g AS (SELECT a.deck_id, a.id AS fig_id, b.id AS slide, 1 AS agree FROM k a JOIN k b ON a.kind = 'f' AND b.kind = 's' AND a.deck_id = b.deck_id AND a.topic = b.topic),
p AS (SELECT *, row_number() OVER (PARTITION BY deck_id ORDER BY score DESC, fig_id, slide) AS r FROM (SELECT deck_id, fig_id, slide, round(least(1, 0.5 * coalesce(agree, 0) + 0.5 * coalesce(cosine, 0)), 6) AS score FROM c FULL JOIN g USING (deck_id, fig_id, slide))),
z AS (SELECT deck_id, CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS fs, CAST([] AS BIGINT[]) AS ss, NULL::BIGINT AS fig_id, NULL::BIGINT AS slide, NULL::DOUBLE AS score, false AS taken FROM (SELECT DISTINCT deck_id FROM p)
  UNION ALL SELECT deck_id, r, CASE WHEN ok THEN list_append(fs, fig_id) ELSE fs END, CASE WHEN ok THEN list_append(ss, slide) ELSE ss END, fig_id, slide, score, ok
  FROM (SELECT z.deck_id, p.r, fs, ss, p.fig_id, p.slide, p.score, NOT list_contains(fs, p.fig_id) AND NOT list_contains(ss, p.slide) AS ok FROM z JOIN p ON p.deck_id = z.deck_id AND p.r = z.r + 1)),
h AS (SELECT deck_id, fig_id, slide, score FROM z WHERE taken)
SELECT deck_id, fig_id, slide, coalesce(score, 0) AS score, CASE WHEN score > 0.8 THEN 'auto' WHEN score >= 0.5 THEN 'review' ELSE 'skip' END AS band FROM f LEFT JOIN h USING (deck_id, fig_id)"""


@_query(MAPPED)
def mapped_figures(spark, sf):
    rows = C.numbered(spark, sf, PAGES)
    return M.mapped_figures(rows.where("p % 3 = 0").select("deck_id", F.col("slide").alias("fig_id"), "caption"), rows.select("deck_id", "slide", "text"))


# A page for each part, of two sizes, with titles of up to six lines; some pictures have no area.
TEMPLATES = """SELECT p_partkey AS page_id, CAST(repeat(concat(p_name, ' '), CAST(p_size % 28 AS INT)) AS STRING) AS title, repeat(concat(p_type, ' '), CAST(p_size % 40 AS INT)) AS caption,
  p_size % 9 * 100 AS figure_w, p_size * 20 AS figure_h, CASE WHEN p_partkey % 2 = 0 THEN 1920 ELSE 1280 END AS width, CASE WHEN p_partkey % 2 = 0 THEN 1080 ELSE 720 END AS height FROM part"""
_WRAP = "len(list_filter(string_split(coalesce(list_reduce(list_filter(string_split({text}, ' '), lambda w: w <> ''), lambda a, w: CASE WHEN length(regexp_extract(a, '[^\\n]*$')) + 1 + length(w) <= {most} THEN a || ' ' || w ELSE a || chr(10) || w END), ''), chr(10)), lambda w: w <> ''))"


@_query(f"""WITH p AS (SELECT *, CASE WHEN width = 1920 THEN 48 ELSE 32 END AS tf, CASE WHEN width = 1920 THEN 24 ELSE 16 END AS cf, CASE WHEN width = 1920 THEN 20 ELSE 13 END AS pad, CASE WHEN width = 1920 THEN 80 ELSE 53 END AS edge FROM ({TEMPLATES.replace('STRING', 'VARCHAR').replace('AS INT)', 'AS INTEGER)')})),
l AS (SELECT *, CASE WHEN trim(title) = '' THEN 0 ELSE {_WRAP.format(text='title', most=72)} END AS tn, CASE WHEN trim(caption) = '' THEN 0 ELSE {_WRAP.format(text='caption', most=136)} END AS cn FROM p),
r AS (SELECT *, CAST(edge + tn * tf * 1.3 + 2 * pad AS DOUBLE) AS below, CAST(height - edge - (edge + tn * tf * 1.3 + 2 * pad) - 2 * pad AS DOUBLE) AS room FROM l),
s AS (SELECT *, CASE WHEN least(height * 0.65, room) > 0 AND figure_w > 0 AND figure_h > 0 THEN least(width * 0.85 / figure_w, least(height * 0.65, room) / figure_h) END AS s FROM r)
SELECT page_id, tf AS title_font, tn AS title_lines, cn AS caption_lines, CASE WHEN cn > 0 THEN round(CAST(height - edge + (cn - 1) * cf * 1.4 AS DOUBLE), 6) END AS last_y, round((width - figure_w * s) / 2, 6) AS x, round(below + (room - figure_h * s) / 2, 6) AS y,
  round(figure_w * s + 2 * pad, 6) AS frame_w, round(figure_h * s + 2 * pad, 6) AS frame_h FROM s""")
def template_places(spark, sf):
    rows = T.template_places(_sql(spark, sf, TEMPLATES, "part"))
    six = lambda c: F.round(F.col(c).cast("double"), 6)
    return rows.select(
        "page_id", "title_font", F.size("titles").cast("long").alias("title_lines"), F.size("captions").cast("long").alias("caption_lines"), F.round(F.try_element_at("captions", F.lit(-1))["y"], 6).alias("last_y"),
        six("figure.x").alias("x"), six("figure.y").alias("y"), six("frame.w").alias("frame_w"), six("frame.h").alias("frame_h"),
    )
