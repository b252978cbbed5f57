"""Queries of the prose rules, charts, page extracts and reports, with the SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioguard.operators import bib as B
from folioguard.operators import charts as C
from folioguard.operators import deck as D
from folioguard.operators import protocol as P
from folioguard.plans.catalogue import _query, _sql
from folioguard.sources import extracted as X
from folioguard.sources.readers import table


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


BODY = "SELECT l_orderkey AS doc_id, l_linenumber AS line_no, concat('Shown before (', CASE l_suppkey % 3 WHEN 0 THEN 'Wang' WHEN 1 THEN 'Kumar' ELSE 'Sato' END, CASE l_partkey % 3 WHEN 0 THEN ' et al.' WHEN 1 THEN ' & Jones' ELSE '' END, ', ', CAST(2000 + l_partkey % 9 AS STRING), ')', CASE WHEN l_partkey % 7 = 0 THEN ' and better [1, 3-6]' WHEN l_partkey % 5 = 0 THEN ' with lower cost [2]' ELSE ' [TBD]' END) AS line FROM lineitem"
ENTRIES = "SELECT l_orderkey AS doc_id, concat(CASE l_suppkey % 3 WHEN 0 THEN 'Wang' WHEN 1 THEN 'Kumar' ELSE 'Sato' END, ' A, Jones B. (', CAST(2000 + (l_partkey + l_linenumber % 2) % 9 AS STRING), '). Part study.') AS entry FROM lineitem"


@_query(f"""WITH b AS ({BODY}), e AS ({ENTRIES}), c AS (SELECT DISTINCT doc_id, regexp_extract(line, '\\(([A-Z][a-z]+)', 1) AS surname, regexp_extract(line, '(\\d{{4}})\\)', 1) AS year FROM b),
r AS (SELECT DISTINCT doc_id, split_part(entry, ' ', 1) AS surname, regexp_extract(entry, '\\((\\d{{4}})', 1) AS year FROM e)
SELECT *, 'orphan-citation' AS kind FROM (SELECT * FROM c EXCEPT SELECT * FROM r) UNION ALL SELECT *, 'orphan-reference' FROM (SELECT * FROM r EXCEPT SELECT * FROM c)""")
def author_year_orphans(spark, sf):
    return P.author_year_orphans(_sql(spark, sf, BODY, "lineitem"), _sql(spark, sf, ENTRIES, "lineitem"))


@_query(f"SELECT doc_id, line_no, '[TBD]' AS stub FROM ({BODY}) WHERE contains(line, '[TBD]')")
def stub_markers(spark, sf):
    return P.stub_markers(_sql(spark, sf, BODY, "lineitem"))


@_query(f"SELECT doc_id, line_no, CAST(CASE WHEN contains(line, 'better') THEN 5 ELSE 1 END AS BIGINT) AS citations FROM ({BODY}) WHERE contains(line, 'better') OR contains(line, 'lower')")
def direction_claims(spark, sf):
    return P.direction_claims(_sql(spark, sf, BODY, "lineitem"))


@_query(f"SELECT doc_id, line_no, CAST(5 AS BIGINT) AS refs FROM ({BODY}) WHERE contains(line, '[1, 3-6]')")
def crowded_brackets(spark, sf):
    return P.crowded_brackets(_sql(spark, sf, BODY, "lineitem"))


AUTHORS = "SELECT l_partkey AS k, l_orderkey * 10 + l_linenumber AS record_id, CASE l_suppkey % 6 WHEN 0 THEN 'Zhang H,Wang L,Chen Y,Liu Q' WHEN 1 THEN 'Zhang H,Wang L,Chen Y' WHEN 4 THEN 'Zhang H,Smith J,Patel R,Sato K' WHEN 5 THEN 'Zhang H,Wang L,Chen Y,Smith J' WHEN 2 THEN 'Smith J,Johnson A,Williams M,Okonkwo D' ELSE 'Patel R,kumar A,Singh P,Sharma N' END AS who FROM lineitem"


@_query(f"SELECT record_id FROM ({AUTHORS}) WHERE who LIKE 'Zhang%Liu Q' OR who LIKE 'Patel%'")
def generic_authors(spark, sf):
    return P.generic_authors(_sql(spark, sf, AUTHORS, "lineitem").withColumn("authors", F.split("who", ",")))


@_query("SELECT l_partkey AS entity, count(DISTINCT l_returnflag || l_linestatus) AS descriptions FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_returnflag || l_linestatus) > 1")
def inconsistent_entities(spark, sf):
    return P.inconsistent_entities(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("entity"), F.concat("l_returnflag", "l_linestatus").alias("description")))


VERDICT = "SELECT o_orderkey AS doc_id, concat(repeat('This is currently the most used. ', CAST(o_custkey % 4 AS INT)), CASE WHEN o_custkey % 3 = 0 THEN 'The next 10 years will tell.' ELSE 'It has yet to demonstrate use.' END) AS text FROM orders"


@_query("SELECT o_orderkey AS doc_id, o_custkey % 4 + 1 AS verdicts, o_custkey % 4 + 1 >= 3 AS enough FROM orders")
def verdict_sentences(spark, sf):
    return P.verdict_sentences(_sql(spark, sf, VERDICT, "orders"))


REVIEW = "SELECT l_orderkey AS doc_id, l_partkey % 5 AS issue, l_suppkey % 3 AS pass, CASE l_partkey % 5 WHEN 0 THEN 'hard' WHEN 1 THEN 'drift' ELSE 'other' END AS kind FROM lineitem"


@_query(f"""SELECT *, CASE WHEN hard_errors >= 5 OR drift >= 10 THEN 'reset' WHEN hard_errors > 0 OR hard_fixes > 0 THEN 'in place' ELSE 'none' END AS strategy, hard_errors = 0 AS ships FROM (
SELECT doc_id, count(*) FILTER (p >= 2) AS hard_fixes, count(*) FILTER (issue = 0) AS hard_errors, count(*) FILTER (issue = 1) AS drift FROM (SELECT doc_id, issue, count(DISTINCT pass) AS p FROM ({REVIEW}) GROUP BY ALL) GROUP BY doc_id)""")
def review_synthesis(spark, sf):
    return P.review_synthesis(_sql(spark, sf, REVIEW, "lineitem"))


PAPERS = "SELECT p_partkey AS paper_id, CASE WHEN p_size > 5 THEN p_brand END AS axis, p_type AS family FROM part"


@_query(f"SELECT axis, family, count(*) AS papers FROM ({PAPERS}) GROUP BY ALL")
def literature_matrix(spark, sf):
    return P.literature_matrix(_sql(spark, sf, PAPERS, "part"))


@_query("SELECT count(*) AS papers, count(*) FILTER (p_size <= 5) AS unmapped, count(*) FILTER (p_size <= 5) <= 0.3 * count(*) AS fits FROM part")
def taxonomy_fits(spark, sf):
    return P.taxonomy_fits(_sql(spark, sf, PAPERS, "part"))


FOUND = "SELECT o_custkey AS key, o_orderstatus <> 'P' AS on_topic, o_totalprice > 100000 AS has_text, o_orderpriority < '4' AS eligible FROM orders"


@_query(f"WITH k AS (SELECT key, bool_or(on_topic) AS a, bool_or(has_text) AS b, bool_or(eligible) AS c, count(*) AS n FROM ({FOUND}) GROUP BY key) SELECT CAST(sum(n) AS BIGINT) AS identified, count(*) AS deduplicated, count(*) FILTER (a) AS screened, count(*) FILTER (a AND b) AS full_text, count(*) FILTER (a AND b AND c) AS included FROM k")
def screening_flow(spark, sf):
    return P.screening_flow(_sql(spark, sf, FOUND, "orders"))


_STYLES = ", ".join("{'n': " + " + ".join(f"CAST(contains(t, ' {w} ') AS BIGINT)" for w in ws) + f", 'k': {-k}, 'style': '{s}'}}" for k, (s, ws) in enumerate(P.STYLES.items()))


@_query(f"SELECT doc_id, CASE WHEN b.n > 0 THEN b.style ELSE 'blueprint' END AS style, b.n AS signals FROM (SELECT doc_id, list_max([{_STYLES}]) AS b FROM (SELECT doc_id, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM documents))")
def auto_style(spark, sf):
    return P.auto_style(table(spark, sf, "documents"))


CAPTIONED = "SELECT l_orderkey * 10 + l_linenumber AS fig_id, CASE l_partkey % 4 WHEN 0 THEN 'table' ELSE 'figure' END AS kind, CASE l_suppkey % 6 WHEN 0 THEN 'Network architecture' WHEN 1 THEN 'Comparison of visual results' WHEN 2 THEN 'An ablation' WHEN 3 THEN 'Qualitative view' WHEN 4 THEN 'A concept' END AS caption FROM lineitem"


@_query(f"SELECT fig_id, CASE WHEN caption LIKE 'Net%' THEN 'Methods' WHEN caption LIKE 'Comp%' THEN 'Results' WHEN caption LIKE '%abl%' THEN 'Analysis' WHEN caption LIKE 'Qual%' THEN 'Qualitative Results' END AS topic, CASE WHEN kind = 'table' OR coalesce(caption, 'A concept') <> 'A concept' THEN 'extract' ELSE 'generate' END AS source FROM ({CAPTIONED})")
def figure_plan(spark, sf):
    return P.figure_plan(_sql(spark, sf, CAPTIONED, "lineitem"))


@_query("SELECT event_id, CASE WHEN value / 100 > 0.8 THEN 'auto' WHEN value / 100 >= 0.5 THEN 'review' ELSE 'skip' END AS band FROM events WHERE value IS NOT NULL")
def confidence_band(spark, sf):
    return table(spark, sf, "events").where("value IS NOT NULL").select("event_id", P.confidence_band(F.col("value") / 100).alias("band"))


@_query("SELECT l_orderkey AS deck_id, CASE WHEN n < lo THEN 'under' WHEN n > hi THEN 'over' ELSE 'within' END AS verdict FROM (SELECT *, CASE WHEN m >= 30 THEN 25 WHEN m >= 20 THEN 15 WHEN m >= 15 THEN 12 WHEN m >= 10 THEN 8 ELSE 5 END AS lo, CASE WHEN m >= 30 THEN 35 WHEN m >= 20 THEN 22 WHEN m >= 15 THEN 18 WHEN m >= 10 THEN 12 ELSE 7 END AS hi FROM (SELECT l_orderkey, count(*) AS n, max(l_quantity) AS m FROM lineitem GROUP BY l_orderkey))")
def slide_bands(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("deck_id")).agg(F.count("*").alias("n"), F.max("l_quantity").alias("m"))
    return rows.select("deck_id", P.slide_count_verdict(F.col("m"), F.col("n")).alias("verdict"))


RATINGS = "SELECT o_custkey AS proposal_id, CASE o_orderkey % 7 " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(P.RUBRIC)) + " END AS section, 1 + CAST(o_orderkey / 8 AS BIGINT) % 5 AS rating FROM orders"
RATINGS = RATINGS.replace("CAST(o_orderkey / 8 AS BIGINT)", "CAST(floor(o_orderkey / 8.0) AS BIGINT)")
_WEIGHT = "CASE section " + " ".join(f"WHEN '{s}' THEN {w}" for s, w in P.RUBRIC.items()) + " END"


@_query(f"SELECT proposal_id, sum({_WEIGHT} * rating) / sum({_WEIGHT}) AS average, min(rating) AS lowest, sum({_WEIGHT} * rating) / sum({_WEIGHT}) >= 3.5 AND min(rating) >= 3 AND count(DISTINCT section) = 6 AS passes FROM ({RATINGS}) WHERE section IS NOT NULL GROUP BY proposal_id")
def rubric_result(spark, sf):
    return P.rubric_result(_sql(spark, sf, RATINGS, "orders"))


SECTIONS = "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Abstract' WHEN 1 THEN 'Methodology' ELSE 'Timeline' END AS section, text FROM documents"


@_query(f"SELECT *, CASE WHEN words < CASE section WHEN 'Abstract' THEN 150 WHEN 'Methodology' THEN 500 ELSE 200 END * 0.9 THEN 'under' WHEN words > CASE section WHEN 'Methodology' THEN 800 ELSE 300 END * 1.1 THEN 'over' ELSE 'within' END AS verdict FROM (SELECT doc_id, section, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f\\x0B]+')) AS BIGINT) AS words FROM ({SECTIONS}))")
def word_budgets(spark, sf):
    return P.word_budgets(_sql(spark, sf, SECTIONS, "documents"))


@_query("SELECT l_orderkey AS doc_id, count(*) AS refs, count(*) FILTER (year(l_shipdate) > 1991) AS recent, count(*) FILTER (year(l_shipdate) > 1991) >= 0.6 * count(*) AS current FROM lineitem GROUP BY l_orderkey".replace("1991", "1992"))
def recency(spark, sf):
    return P.recency(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.year("l_shipdate").alias("year")), 1997)


@_query("SELECT doc_id, ref_no FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY md5(concat_ws(':', CAST(doc_id AS VARCHAR), CAST(ref_no AS VARCHAR))), ref_no) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM (SELECT o_custkey AS doc_id, o_orderkey AS ref_no FROM orders)) WHERE k <= ceil(n * 0.2)")
def spot_checks(spark, sf):
    return P.spot_checks(table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ref_no")))


ROWS = "SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS line_no, CASE WHEN o_orderkey % 4 > 0 THEN '| a | b |' ELSE 'text' END AS line FROM orders"


@_query(f"SELECT *, tables <= 4 AND long_tables = 0 AS fine FROM (SELECT doc_id, count(*) AS tables, count(*) FILTER (c > 20) AS long_tables FROM (SELECT doc_id, i, count(*) AS c FROM (SELECT doc_id, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i FROM ({ROWS}) WHERE line <> 'text') GROUP BY ALL) GROUP BY doc_id)")
def table_limits(spark, sf):
    return P.table_limits(_sql(spark, sf, ROWS, "orders"))


for _name, _words in {"title_cliches": P.TITLE_CLICHES, "prose_cliches": P.PROSE_CLICHES, "slide_cliches": P.SLIDE_CLICHES}.items():
    def _cliches(spark, sf, words=_words):
        made = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.element_at(F.array(*(F.lit(w.upper()) for w in words)), (F.pmod("doc_id", F.lit(len(words))) + 1).cast("int")))
        return P.cliches(table(spark, sf, "documents").select("doc_id", made.alias("text")), words)

    _cliches.__name__ = _name
    _query(f"WITH t AS (SELECT doc_id, lower(coalesce(text, '') || ' ' || upper({_list(_words)}[doc_id % {len(_words)} + 1])) AS text FROM documents) SELECT doc_id, phrase FROM t, (SELECT unnest({_list(_words)}) AS phrase) WHERE contains(text, phrase)")(_cliches)


@_query("SELECT l_orderkey AS deck_id, count(*) FILTER (l_discount < 0.08) AS passed, count(*) AS checks, count(*) FILTER (l_discount < 0.08) = count(*) AS faithful FROM lineitem GROUP BY l_orderkey")
def fidelity(spark, sf):
    return P.fidelity(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("deck_id"), F.col("l_linenumber").alias("check"), (F.col("l_discount") < 0.08).alias("ok")))


SLUGS = "SELECT l_orderkey AS deck_id, l_linenumber * 10 AS position, concat('part-', CAST(l_partkey % 50 AS STRING)) AS slug FROM lineitem"


@_query(f"SELECT deck_id, slug, concat(CASE WHEN k < 10 THEN '0' ELSE '' END, CAST(k AS VARCHAR), '-slide-', slug) AS file_stem, CASE WHEN k = 1 THEN 'cover' WHEN k = n THEN 'back-cover' ELSE 'content' END AS role, c > 1 AS repeated FROM (SELECT *, row_number() OVER (PARTITION BY deck_id ORDER BY position, slug) AS k, count(*) OVER (PARTITION BY deck_id) AS n, count(*) OVER (PARTITION BY deck_id, slug) AS c FROM ({SLUGS}))")
def renumbered(spark, sf):
    return P.renumbered(_sql(spark, sf, SLUGS, "lineitem"))


KINDS = "SELECT l_orderkey AS deck_id, CASE l_suppkey % 3 WHEN 0 THEN 'critique-concerns' WHEN 1 THEN 'discussion-questions' ELSE 'bullets' END AS layout FROM lineitem"


@_query(f"SELECT deck_id, layout FROM (SELECT DISTINCT deck_id FROM ({KINDS})), (SELECT unnest(['critique-concerns', 'discussion-questions']) AS layout) EXCEPT SELECT deck_id, layout FROM ({KINDS})")
def missing_layouts(spark, sf):
    return P.missing_layouts(_sql(spark, sf, KINDS, "lineitem"))


@_query("SELECT slide_id, words, CASE WHEN words < 40 THEN 'short' WHEN words > 120 THEN 'long' ELSE 'fine' END AS verdict FROM (SELECT conv_id * 1000 + turn AS slide_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9][A-Za-z0-9''’\\-]*')) AS BIGINT) AS words FROM conversations)")
def notes_length(spark, sf):
    return P.notes_length(table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("slide_id"), F.col("text").alias("notes")))


@_query("SELECT * FROM (SELECT doc_id AS fig_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f\\x0B]+')) AS BIGINT) AS words FROM documents) WHERE words > 100")
def long_captions(spark, sf):
    return P.long_captions(table(spark, sf, "documents").select(F.col("doc_id").alias("fig_id"), F.col("text").alias("caption")))


NAMED = "SELECT o_orderkey AS doc_id, CASE o_custkey % 4 WHEN 0 THEN 'a cardiac CT and its midline' WHEN 1 THEN 'CT angio' WHEN 2 THEN 'the centerline' END AS text FROM orders"
_CT = "coronary CT angiography (CCTA)"


@_query(f"SELECT doc_id, '{_CT}' AS term, 'cardiac CT' AS variant FROM ({NAMED}) WHERE text LIKE '%cardiac%' UNION ALL SELECT doc_id, 'centerline', 'midline' FROM ({NAMED}) WHERE text LIKE '%midline%' UNION ALL SELECT doc_id, '{_CT}', 'CT angio' FROM ({NAMED}) WHERE text LIKE '%angio'")
def avoided_terms(spark, sf):
    return P.avoided_terms(_sql(spark, sf, NAMED, "orders"))


FRONT = "SELECT o_orderkey AS doc_id, repeat('word ', CAST(5 + o_custkey % 15 AS INT)) AS title, CASE o_custkey % 4 WHEN 0 THEN 'We did it [1].' WHEN 1 THEN 'As said (Wang et al., 2020).' WHEN 2 THEN 'See Figure 2.' ELSE 'Plain.' END AS abstract FROM orders"


@_query("SELECT o_orderkey AS doc_id, 5 + o_custkey % 15 BETWEEN 10 AND 15 AS title_fine, o_custkey % 4 = 3 AS abstract_fine FROM orders")
def front_matter(spark, sf):
    return P.front_matter(_sql(spark, sf, FRONT, "orders"))


PARAGRAPHS = "SELECT o_orderkey AS doc_id, concat(repeat('A thing. ', CAST(o_custkey % 10 AS INT)), 'Why?', chr(10), chr(10), repeat('B is 1.5! ', CAST(o_custkey % 6 AS INT)), chr(10), ' ', chr(10), 'end') AS text FROM orders"


@_query("SELECT o_orderkey AS doc_id, 2 + CAST(o_custkey % 6 > 0 AS BIGINT) AS paragraphs, 1 + CAST(o_custkey % 10 + 1 NOT BETWEEN 4 AND 8 AS BIGINT) + CAST(o_custkey % 6 BETWEEN 1 AND 3 AS BIGINT) AS unusual FROM orders")
def paragraph_lengths(spark, sf):
    return P.paragraph_lengths(_sql(spark, sf, PARAGRAPHS, "orders"))


DIGESTS = "SELECT o_orderkey AS paper_id, concat('{\"problem\": \"', CASE WHEN o_custkey % 2 = 0 THEN 'p' ELSE ' ' END, '\", \"gap\": \"g\", \"thesis_claim\": \"t\", \"contributions\": [1], \"method\": {\"one_idea\": \"m\"}, \"results\": {\"key_metrics\": []}, \"ablations\": [1], \"asset_inventory\": [1], \"limitations\": ', CASE WHEN o_custkey % 3 = 0 THEN '[]' ELSE '[\"l\"]' END, ', \"language\": \"en\", \"notes_flags\": [', CASE o_custkey % 5 WHEN 0 THEN '\"[MISSING: problem]\", \"[UNVERIFIED problems]\"' WHEN 1 THEN '\"[MISSING limitations in sec. 5]\"' WHEN 2 THEN '\"limitations\"' ELSE '' END, ']}') AS digest FROM orders"


@_query("SELECT o_orderkey AS paper_id, unnest(list_filter(['bibliography', CASE WHEN o_custkey % 2 = 1 AND o_custkey % 5 > 0 THEN 'problem' END, CASE WHEN o_custkey % 3 = 0 AND o_custkey % 5 <> 1 THEN 'limitations' END], lambda x: x IS NOT NULL)) AS key FROM orders")
def digest_gaps(spark, sf):
    return P.digest_gaps(_sql(spark, sf, DIGESTS, "orders"))


SERIES = "SELECT o_orderkey AS chart_id, o_custkey % 5 AS c, o_custkey % 4 + 1 AS n, o_totalprice AS v FROM orders"


def _charts(spark, sf):
    rows = _sql(spark, sf, SERIES, "orders")
    k = F.sequence(F.lit(1).cast("long"), F.col("n"))
    one = F.transform(k, lambda i: F.struct(F.when(i == 2, "second").alias("name"), F.array_repeat("v", (F.when(i == 3, F.col("c")).otherwise(F.col("c") + 1)).cast("int")).alias("values"), F.when(i == 4, "#123456").alias("color")))
    return rows.select("chart_id", F.transform(F.sequence(F.lit(0).cast("long"), "c"), lambda i: F.format_string("category %d", i)).alias("categories"), one.alias("series"))


_COLORS = _list(C.PALETTE)


@_query(f"SELECT chart_id, k - 1 AS k, CASE WHEN k = 2 THEN 'second' ELSE concat('series', CAST(k AS VARCHAR)) END AS name, CASE WHEN k = 4 THEN '#123456' ELSE {_COLORS}[k] END AS color, CAST(CASE WHEN k = 3 THEN c ELSE c + 1 END AS BIGINT) AS n_values, CASE WHEN k = 3 THEN concat(CAST(c AS VARCHAR), ' values for ', CAST(c + 1 AS VARCHAR), ' categories') END AS error FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM ({SERIES}))")
def chart_series(spark, sf):
    return C.chart_series(_charts(spark, sf)).withColumn("n_values", F.size("values").cast("long")).drop("values")


# Categories from none to eleven, with labels of up to sixteen characters.
TICKS = "SELECT o_orderkey AS chart_id, o_custkey % 12 AS c, o_custkey % 17 AS w, o_custkey % 4 + 1 AS n FROM orders"


@_query(f"SELECT chart_id, CAST(CASE WHEN c > 8 OR (c > 0 AND w > 14) THEN 15 ELSE 0 END AS INTEGER) AS rotation, n * c <= 12 AS labelled FROM ({TICKS})")
def chart_labels(spark, sf):
    rows = _sql(spark, sf, TICKS, "orders").select("chart_id", F.array_repeat(F.expr("repeat('x', CAST(w AS INT))"), F.col("c").cast("int")).alias("categories"), F.array_repeat("n", F.col("n").cast("int")).alias("series"))
    return rows.select("chart_id", C.tick_rotation(F.col("categories")).alias("rotation"), C.labels_bars(F.col("series"), F.col("categories")).alias("labelled"))


SPANS = "SELECT l_orderkey AS page_id, CASE WHEN l_partkey % 3 = 0 THEN ' a ' WHEN l_partkey % 3 = 1 THEN 'word' ELSE '  ' END AS text, 'f' AS font, CAST(l_quantity % 4 AS DOUBLE) AS size, CAST(l_suppkey % 9 AS DOUBLE) AS x0, CAST(l_partkey % 70 AS DOUBLE) AS y0, CAST(l_suppkey % 9 + l_quantity AS DOUBLE) AS x1, CAST(l_partkey % 70 + l_linenumber - 1 AS DOUBLE) AS y1, CAST(50 AS DOUBLE) AS page_w, l_suppkey % 2 AS type FROM lineitem"


@_query(f"SELECT page_id, 'a' AS text, size FROM ({SPANS}) WHERE text = ' a '")
def letter_spans(spark, sf):
    return X.letter_spans(_sql(spark, sf, SPANS, "lineitem")).select("page_id", "text", "size")


@_query(f"SELECT page_id, size, x0, y0, x1, y1 FROM ({SPANS}) WHERE text <> '  ' AND size > 0")
def sized_spans(spark, sf):
    return X.sized_spans(_sql(spark, sf, SPANS, "lineitem"))


@_query(f"WITH s AS ({SPANS}) SELECT page_id, 'text' AS kind, x0, y0, x1, y1 FROM s WHERE type = 0 AND text <> '  ' UNION ALL SELECT page_id, 'image', x0, y0, x1, y1 FROM s UNION ALL SELECT page_id, 'drawing', x0, y0, x1, y1 FROM s WHERE x1 - x0 > 1 AND y1 - y0 > 1 AND NOT (x1 - x0 > 45 AND y1 - y0 < 3)")
def content_rects(spark, sf):
    s = _sql(spark, sf, SPANS, "lineitem")
    return X.content_rects(X.page_blocks(s.withColumn("spans", F.array("text"))), s, s)


ITEMS = "SELECT l_orderkey AS page_id, l_linenumber * 20 + CASE WHEN l_suppkey % 2 = 0 THEN 3 ELSE 0 END AS y, l_partkey AS x, concat('w', CAST(l_partkey AS STRING)) AS str FROM lineitem"


@_query(f"SELECT page_id, string_agg(t, chr(10) ORDER BY k DESC) AS text FROM (SELECT page_id, y // 20 AS k, string_agg(str, ' ' ORDER BY x, y DESC) AS t FROM ({ITEMS}) GROUP BY ALL) GROUP BY page_id")
def page_text(spark, sf):
    return X.page_text(_sql(spark, sf, ITEMS, "lineitem"))


PAGE_TEXTS = "SELECT o_orderkey AS page_id, concat('Intro', chr(10), CASE WHEN o_custkey % 2 = 0 THEN '  Figure ' ELSE 'FIGURE ' END, CAST(o_custkey % 9 AS STRING), ': A  view', chr(10), 'of parts', chr(10), 'TABLE IV. Sums', chr(10), '(in units)', chr(10), 'RESULTS follow') AS text FROM orders"


@_query("SELECT o_orderkey AS page_id, 'figure' AS kind, CAST(o_custkey % 9 AS VARCHAR) AS number, 'A view' AS caption FROM orders UNION ALL SELECT o_orderkey, 'figure', CAST(o_custkey % 9 AS VARCHAR), 'A view of parts' FROM orders WHERE o_custkey % 2 = 1 UNION ALL SELECT o_orderkey, 'table', 'IV', 'Sums (in units)' FROM orders")
def text_captions(spark, sf):
    return X.text_captions(_sql(spark, sf, PAGE_TEXTS, "orders"))


@_query("WITH m AS (SELECT event_id AS slide_id, event_id % 5 AS oy, event_id % 7 AS ox, event_id % 3 AS k, event_id % 4 - 2 AS b, 10 + event_id % 15 AS f FROM events) SELECT slide_id, 'overflow-y' AS \"check\", 'P1' AS severity FROM m WHERE oy > 2 UNION ALL SELECT slide_id, 'overflow-x', 'P1' FROM m WHERE ox > 2 UNION ALL SELECT slide_id, 'katex-error', 'P1' FROM m WHERE k > 0 UNION ALL SELECT slide_id, 'broken-image', 'P1' FROM m WHERE b > 0 UNION ALL SELECT slide_id, 'font-too-small', 'P2' FROM m WHERE f < 18")
def render_findings(spark, sf):
    i = F.col("event_id")
    return D.render_findings(table(spark, sf, "events").select(i.alias("slide_id"), (i % 5).alias("overflow_y"), (i % 7).alias("overflow_x"), (i % 3).alias("katex_errors"), (i % 4 - 2).alias("broken_images"), (i % 15 + 10).alias("min_font")))


SCORED = "SELECT o_custkey AS deck_id, o_orderkey AS slide, 1 + o_orderkey % 4 AS a, CASE WHEN o_custkey % 2 = 0 THEN 3 + o_orderkey % 2 END AS b FROM orders"


@_query(f"SELECT deck_id, round(avg(t), 9) AS mean, count(*) FILTER (t < 18 OR a <= 2) AS rework, string_agg(CAST(slide AS VARCHAR), ',' ORDER BY k) FILTER (k <= 3) AS weakest FROM (SELECT *, row_number() OVER (PARTITION BY deck_id ORDER BY t, slide) AS k FROM (SELECT *, (a + coalesce(b, 0)) / CASE WHEN b IS NULL THEN 1 ELSE 2 END * 6 AS t FROM ({SCORED}))) GROUP BY deck_id")
def aesthetics(spark, sf):
    rows = _sql(spark, sf, SCORED, "orders").withColumn("dims", F.create_map(F.lit("a"), "a", F.lit("b"), "b"))
    return D.aesthetics(rows).withColumn("mean", F.round("mean", 9))


REPORTS = "SELECT o_orderkey AS deck_id, CASE o_custkey % 4 WHEN 0 THEN '{\"rework\": []}' WHEN 1 THEN '{\"rework\": [{\"slide\": 3}]}' WHEN 2 THEN '{\"rework\": ' ELSE '{\"mean\": 2}' END AS report, o_orderstatus <> 'P' AS there FROM orders"


@_query(f"SELECT deck_id, CASE WHEN NOT there THEN 'aesthetics-not-run' WHEN report LIKE '%slide%' THEN 'aesthetics-rework-open' ELSE 'aesthetics-report-invalid' END AS \"check\", CASE WHEN there THEN 'P2' ELSE 'P3' END AS severity FROM ({REPORTS}) WHERE NOT (there AND report LIKE '%[]%')")
def review_findings(spark, sf):
    rows = _sql(spark, sf, REPORTS, "orders")
    return D.review_findings(rows, rows.where("there").select("deck_id", "report"))


@_query("SELECT o_orderkey AS record_id, concat('Study ', CAST(o_custkey AS VARCHAR)) AS title, CASE WHEN o_custkey % 2 = 0 THEN 'Ana Li; Roe' ELSE '' END AS authors, CASE o_custkey % 3 WHEN 0 THEN '2019' WHEN 1 THEN '2021' END AS year, CASE WHEN o_custkey % 2 = 0 THEN 'inproceedings' ELSE 'article' END AS type FROM orders")
def crossref_entry(spark, sf):
    msg = _sql(spark, sf, """SELECT o_orderkey AS record_id, concat('{"title": ["Study ', CAST(o_custkey AS STRING), '"]', CASE WHEN o_custkey % 2 = 0 THEN ', "type": "proceedings-article", "author": [{"given": "Ana", "family": "Li"}, {"family": "Roe"}]' ELSE '' END,
      CASE o_custkey % 3 WHEN 0 THEN ', "issued": {"date-parts": [[2019, 3]]}, "created": {"date-parts": [[2020]]}' WHEN 1 THEN ', "issued": {"date-parts": [[null]]}, "created": {"date-parts": [[2021]]}' ELSE '' END, '}') AS m FROM orders""", "orders")
    return msg.select("record_id", B.crossref_entry(F.col("m")).alias("e")).select("record_id", "e.title", F.array_join("e.authors", "; ").alias("authors"), "e.year", "e.type")


@_query("SELECT o_orderkey AS record_id, 'Study of parts' AS title, 'Ana Li; Bo Roe' AS authors, '2020' AS year, concat('2001.', CAST(10000 + o_custkey % 90000 AS VARCHAR)) AS arxiv, CASE WHEN o_custkey % 2 = 0 THEN '10.1/x' END AS doi, CASE WHEN o_custkey % 2 = 0 THEN 'J. Parts' ELSE 'arXiv preprint' END AS venue FROM orders WHERE o_custkey % 5 > 0")
def atom_entry(spark, sf):
    feed = _sql(spark, sf, """SELECT o_orderkey AS record_id, concat('<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><title>q</title>', CASE WHEN o_custkey % 5 > 0 THEN concat('<entry><id>http://arxiv.org/abs/2001.', CAST(10000 + o_custkey % 90000 AS STRING), 'v2</id><published>2020-01-02T00:00:00Z</published><title>Study
      of parts</title><author><name>Ana Li</name></author><author><name>Bo Roe</name></author>', CASE WHEN o_custkey % 2 = 0 THEN '<arxiv:doi>10.1/x</arxiv:doi><arxiv:journal_ref>J. Parts</arxiv:journal_ref>' ELSE '' END, '</entry><entry><id>other</id></entry>') ELSE '' END, '</feed>') AS x FROM orders""", "orders")
    return feed.select("record_id", B.atom_entry(F.col("x")).alias("e")).where("e IS NOT NULL").select("record_id", "e.title", F.array_join("e.authors", "; ").alias("authors"), "e.year", "e.arxiv", "e.doi", "e.venue")
