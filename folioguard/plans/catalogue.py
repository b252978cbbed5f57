"""Every registered query with the SQL that DuckDB runs for the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioguard.functions import text as H
from folioguard.operators import bib as B
from folioguard.operators import deck as D
from folioguard.operators import geometry as G
from folioguard.operators import manuscript as M
from folioguard.operators import parity as P
from folioguard.plans import inputs as I
from folioguard.sources.readers import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _sql(spark: SparkSession, sf: str, sql: str, *tables: str) -> DataFrame:
    """``sql`` over tables passed as DataFrames, so no view of the session is touched."""
    sql = sql.replace("{", "{{").replace("}", "}}")
    for t in tables:
        sql = re.sub(rf"FROM {t}\b", "FROM {" + t + "}", sql)
    return spark.sql(sql, **{t: table(spark, sf, t) for t in tables})


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of MANUSCRIPTS: only columns of the table are shuffled, and texts are made of them where a document's rows have met."""
    return spark.sql(I.NUMBERED_LINES, li=spark.sql(I.FIRST_ROWS, li=_spread(_sql(spark, sf, I.LI_ROWS, "lineitem"), "doc_id")))


def _spread(rows: DataFrame, key: str, most: int = 250_000) -> DataFrame:
    """``rows`` by ``key`` in all shuffle partitions, and in more if one would get over ``most`` rows: they are narrow, and fewer would hold too much once texts are made of them."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-rows.count() // most)), key)


def numbered(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    """``sql`` over lineitem, with its number of slides taken from the rows before texts are made of them."""
    rows = spark.sql(f"SELECT *, {I.SLIDE_NO} AS slide_no FROM {{rows}}", rows=_spread(table(spark, sf, "lineitem"), "l_orderkey"))
    assert I.SLIDE_NO in sql
    return spark.sql(sql.replace("{", "{{").replace("}", "}}").replace(I.SLIDE_NO, "slide_no").replace("FROM lineitem", "FROM {numbered}"), numbered=rows)


LINES = f"WITH li AS ({I.LI}), lines AS ({I.MANUSCRIPTS})"
ZONES = LINES + """, z AS (SELECT *, min(CASE WHEN line = '## References' THEN line_no END) OVER (PARTITION BY doc_id) AS h FROM lines),
body AS (SELECT * FROM z WHERE h IS NULL OR line_no < h),
refs AS (SELECT doc_id, n AS ref_no, arg_max(trim(regexp_extract(line, '^\\[\\d+\\]\\s*(.+)', 1)), line_no) AS entry FROM (SELECT *, CAST(regexp_extract(line, '^\\[(\\d+)\\]', 1) AS BIGINT) AS n FROM z WHERE line_no > h) GROUP BY doc_id, n),
raw AS (SELECT doc_id, line_no, CAST(regexp_extract(line, '\\[(\\d+)', 1) AS BIGINT) AS n, contains(line, ', 2-3]') AS more FROM body WHERE contains(line, ' et al. [')),
cites AS (SELECT doc_id, line_no, unnest(CASE WHEN more THEN [n, 2, 3] ELSE [n] END) AS n FROM raw)
"""


def _parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    z = M.with_zones(lines(spark, sf))
    return z, M.bibliography(z), M.citations(z)


@_query(LINES + " SELECT doc_id, line_no, line FROM lines")
def manuscript_lines(spark, sf):
    return M.lines_of(lines(spark, sf).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text")))


@_query(ZONES + " SELECT doc_id, ref_no, entry FROM refs")
def bibliography(spark, sf):
    return _parts(spark, sf)[1]


@_query(ZONES + " SELECT doc_id, line_no, n FROM cites")
def citation_markers(spark, sf):
    return _parts(spark, sf)[2]


FINDINGS = {
    "missing_reference": "SELECT doc_id, 'high' AS severity, 'missing_reference' AS category, line_no, CAST(n AS VARCHAR) AS detail FROM cites c WHERE doc_id IN (SELECT doc_id FROM refs) AND NOT EXISTS (SELECT 1 FROM refs r WHERE r.doc_id = c.doc_id AND r.ref_no = c.n)",
    "uncited_reference": "SELECT doc_id, 'low' AS severity, 'uncited_reference' AS category, CAST(0 AS BIGINT) AS line_no, concat(count(*), ': ', array_to_string(list_sort(list(ref_no))[1:20], ',')) AS detail FROM refs r WHERE NOT EXISTS (SELECT 1 FROM cites c WHERE c.doc_id = r.doc_id AND c.n = r.ref_no) GROUP BY doc_id",
    "references_not_detected": "SELECT doc_id, 'low' AS severity, 'references_not_detected' AS category, CAST(0 AS BIGINT) AS line_no, CAST(count(*) AS VARCHAR) AS detail FROM cites WHERE doc_id NOT IN (SELECT doc_id FROM refs) GROUP BY doc_id",
    "author_mismatch": "SELECT w.doc_id, 'high' AS severity, 'author_citation_mismatch' AS category, w.line_no, concat(w.who, ' ', w.n) AS detail FROM (SELECT doc_id, line_no, lower(regexp_extract(line, '^(\\w+) et al', 1)) AS who, CAST(regexp_extract(line, 'et al\\. \\[(\\d+)\\]', 1) AS BIGINT) AS n FROM body WHERE regexp_matches(line, 'et al\\. \\[\\d+\\]')) w JOIN refs r ON r.doc_id = w.doc_id AND r.ref_no = w.n WHERE NOT contains(lower(entry[1:80]), w.who)",
    "placeholder_findings": "SELECT doc_id, 'critical' AS severity, 'placeholder' AS category, line_no, line AS detail FROM lines WHERE contains(line, '[TBD]')",
    "heading_findings": "SELECT doc_id, 'medium' AS severity, CASE WHEN starts_with(line, '####') THEN 'h4_heading' ELSE 'numbered_heading' END AS category, line_no, line AS detail FROM lines WHERE line IN ('### 2.1 Units', '#### Box of units')",
    "llm_tells": "SELECT doc_id, 'low' AS severity, 'llm_tell' AS category, line_no, 'may suggest' AS detail FROM lines WHERE contains(lower(line), 'may suggest')",
    "vendor_mentions": "SELECT doc_id, 'high' AS severity, 'vendor_body_mention' AS category, line_no, 'Cleerly' AS detail FROM body WHERE regexp_matches(line, '(^|\\W)Cleerly(\\W|$)')",
    "display_equations": "SELECT doc_id, 'medium' AS severity, 'display_equation_outside_box' AS category, line_no, line AS detail FROM (SELECT *, last_value(CASE WHEN regexp_matches(line, '^#{1,4}\\s') THEN contains(lower(line), 'box') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS box FROM lines) WHERE contains(line, '$$') AND NOT coalesce(box, false)",
    "unsupported_systematic": "SELECT doc_id, 'critical' AS severity, 'unsupported_systematic_claim' AS category, CAST(0 AS BIGINT) AS line_no, 'PRISMA, eligibility criteria, search strategy, screening, risk of bias, data extraction' AS detail FROM lines WHERE line_no = 1 AND contains(line, 'Systematic Review')",
    "duplicate_doi": "SELECT doc_id, 'high' AS severity, 'duplicate_doi' AS category, CAST(0 AS BIGINT) AS line_no, concat(doi, ' x', count(*)) AS detail FROM (SELECT doc_id, lower(regexp_extract(entry, '10\\.1234/\\w+')) AS doi FROM refs) WHERE doi <> '' GROUP BY doc_id, doi HAVING count(*) > 1",
}
CALLS = {
    "missing_reference": lambda l, z, r, c: M.missing_references(c, r), "uncited_reference": lambda l, z, r, c: M.uncited_references(c, r), "references_not_detected": lambda l, z, r, c: M.references_not_detected(c, r),
    "author_mismatch": lambda l, z, r, c: M.author_mismatches(z, r), "placeholder_findings": lambda l, z, r, c: M.placeholders(l), "heading_findings": lambda l, z, r, c: M.headings(l), "llm_tells": lambda l, z, r, c: M.phrase_tells(l),
    "vendor_mentions": lambda l, z, r, c: M.vendor_mentions(z), "display_equations": lambda l, z, r, c: M.display_equations(l), "unsupported_systematic": lambda l, z, r, c: M.unsupported_systematic(l), "duplicate_doi": lambda l, z, r, c: M.duplicate_dois(r),
}
for _name, _call in CALLS.items():
    QUERIES[_name] = lambda spark, sf, f=_call: f(lines(spark, sf), *_parts(spark, sf))
    ORACLES[_name] = ZONES + FINDINGS[_name]

ALL = ZONES + ", f AS (" + " UNION ALL ".join(f"({x})" for x in FINDINGS.values()) + ")"


@_query(ALL + " SELECT doc_id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, count(*) AS findings FROM f GROUP BY doc_id")
def finding_summary(spark, sf):
    return M.summaries(M.audits(lines(spark, sf)))


@_query(ALL + " SELECT doc_id, bool_or(severity IN ('critical', 'high')) AS failed FROM f GROUP BY doc_id")
def finding_gate(spark, sf):
    return M.gates(M.audits(lines(spark, sf)))


@_query("SELECT doc_id, CAST(len(t) AS BIGINT) AS tokens, array_to_string(t, ' ') AS numbers FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '⁰¹²³⁴⁵⁶⁷⁸⁹', '0123456789'), '[0-9]+(?:\\.[0-9]+)?') AS t FROM documents) WHERE len(t) > 0")
def number_tokens(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", H.number_tokens(F.col("text")).alias("t")).where("size(t) > 0")
    return rows.select("doc_id", F.size("t").cast("long").alias("tokens"), F.array_join("t", " ").alias("numbers"))


WORDS = "CAST(len(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9''’\\-]*')) AS DOUBLE) / 130"


@_query(f"SELECT conv_id, count(*) AS slides, round(sum(greatest({WORDS}, 0.5)), 9) AS minutes, count(*) FILTER (coalesce(text, '') = '') AS without_notes FROM conversations GROUP BY conv_id")
def talk_timing(spark, sf):
    return D.talk_timing(table(spark, sf, "conversations").withColumnRenamed("text", "notes"), "conv_id").withColumn("minutes", F.round("minutes", 9))


@_query(f"SELECT conv_id, CASE WHEN m / 3 > 1.15 THEN 'over' WHEN m / 3 < 0.6 THEN 'under' ELSE 'within' END AS verdict FROM (SELECT conv_id, sum(greatest({WORDS}, 0.5)) AS m FROM conversations GROUP BY conv_id)")
def talk_budget(spark, sf):
    t = D.talk_timing(table(spark, sf, "conversations").withColumnRenamed("text", "notes"), "conv_id")
    return t.select("conv_id", D.budget_verdict(F.col("minutes"), F.lit(3.0)).alias("verdict"))


RUNS = "SELECT {g} AS g, max(c) AS max_run FROM (SELECT {g}, {v}, i, count(*) AS c FROM (SELECT {g}, {v}, row_number() OVER (PARTITION BY {g} ORDER BY {o}) - row_number() OVER (PARTITION BY {g}, {v} ORDER BY {o}) AS i FROM {t}) GROUP BY ALL) GROUP BY {g}"


@_query(f"SELECT g AS user_id, max_run FROM ({RUNS.format(g='user_id', v='event_type', o='event_id', t='events')})")
def longest_run(spark, sf):
    return D.longest_run(table(spark, sf, "events"), "user_id", "event_id", "event_type")


@_query("SELECT page_id, CAST(len(regexp_extract_all(html, '<h[1-6][^>]*>')) AS BIGINT) AS headings, CAST(len(regexp_extract_all(html, '<a [^>]*href=\"([^\"]+)\"', 1)) AS BIGINT) AS links, list_distinct(regexp_extract_all(html, '<a [^>]*href=\"([^\"]+)\"', 1)).len() AS targets FROM pages")
def html_links(spark, sf):
    links = F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]+)"'), 1)
    return table(spark, sf, "pages").select("page_id", F.regexp_count("html", F.lit("<h[1-6][^>]*>")).cast("long").alias("headings"), F.size(links).cast("long").alias("links"), F.size(F.array_distinct(links)).cast("long").alias("targets"))


def built(spark, sf):
    return _sql(spark, sf, I.PAGES, "lineitem")


@_query(f"""WITH p AS ({I.PAGES})
SELECT page_id, 'mystery' AS detail, 'P0' AS severity, 'layout-lock' AS check FROM p WHERE contains(html, 'mystery')
UNION ALL SELECT page_id, src, 'P1', 'missing-image' FROM p WHERE NOT there
UNION ALL SELECT page_id, '1', 'P1', 'katex' FROM p WHERE contains(html, 'katex-error')
UNION ALL SELECT page_id, unnest(['$a+b$', '$c$']), 'P2', 'unrendered-math' FROM p WHERE contains(html, '$')
UNION ALL SELECT page_id, '<Presenter>', 'P1', 'placeholder' FROM p WHERE contains(html, 'Presenter')""")
def html_validate(spark, sf):
    pages = built(spark, sf)
    return D.html_problems(pages, pages.where("there")).select("page_id", "detail", "severity", "check")


SLIDES = f"WITH s AS ({I.SLIDES}), src AS ({I.SOURCES})"
FIELDS = SLIDES + """, f AS (SELECT deck_id, slide, layout, 'title' AS field, title AS text FROM s WHERE trim(title) <> ''
UNION ALL SELECT deck_id, slide, layout, 'annotation', annotation FROM s WHERE annotation IS NOT NULL
UNION ALL SELECT deck_id, slide, layout, 'points[0]', point FROM s WHERE layout <> 'critique-concerns'
UNION ALL SELECT deck_id, slide, layout, 'points[1].head', point FROM s WHERE layout <> 'critique-concerns'
UNION ALL SELECT deck_id, slide, layout, 'points[1].body', 'body' FROM s WHERE layout <> 'critique-concerns'
UNION ALL SELECT deck_id, slide, layout, 'figure.caption', caption FROM s WHERE layout = 'assertion-evidence'
UNION ALL SELECT deck_id, slide, layout, 'table[0][0]', cell FROM s WHERE layout = 'results-table'
UNION ALL SELECT deck_id, slide, layout, 'table[0][1]', cell FROM s WHERE layout = 'results-table'
UNION ALL SELECT deck_id, slide, layout, 'table[1][0]', 'row' FROM s WHERE layout = 'results-table')
"""


def slides(spark, sf):
    """The derived decks, by way of JSON and the deck schema."""
    s = numbered(spark, sf, I.SLIDES)
    first = F.concat(F.lit('"'), "point", F.lit('"'))
    points = F.when(F.col("layout") != "critique-concerns", F.concat(F.lit("["), first, F.lit(',{"head":'), first, F.lit(',"body":"body"}]'))).otherwise("null")
    cells = F.concat(F.lit('[["'), "cell", F.lit('",{"v":"'), "cell", F.lit('","bold":true}],["row"]]'))
    quoted = lambda c: F.coalesce(F.concat(F.lit('"'), F.col(c), F.lit('"')), F.lit("null"))
    spec = F.concat(
        F.lit('{"layout":'), quoted("layout"), F.lit(',"title":'), quoted("title"), F.lit(',"annotation":'), quoted("annotation"), F.lit(',"source_ref":'), quoted("source_ref"), F.lit(',"points":'), points,
        F.lit(',"figure":'), F.when(F.col("layout") == "assertion-evidence", F.concat(F.lit('{"src":"a.png","caption":'), quoted("caption"), F.lit(',"hero":'), F.col("hero").cast("string"), F.lit("}"))).otherwise("null"),
        F.lit(',"table":'), F.when(F.col("layout") == "results-table", F.concat(F.lit('{"rows":'), cells, F.lit("}"))).otherwise("null"), F.lit("}"),
    )
    decks = s.select("deck_id", "slide", spec.alias("spec")).groupBy("deck_id").agg(F.array_sort(F.collect_list(F.struct("slide", "spec"))).alias("x"))
    return D.slides_of(decks.select("deck_id", F.concat(F.lit('{"slides":['), F.array_join("x.spec", ","), F.lit("]}")).alias("spec")))


def sources(spark, sf):
    return _sql(spark, sf, I.SOURCES, "orders")


@_query(FIELDS + " SELECT * FROM f")
def fields_flatten(spark, sf):
    return D.fields(slides(spark, sf))


DECKS = {
    "deck_flags": "SELECT deck_id, slide, field, '[UNVERIFIED value]' AS flag FROM f WHERE contains(text, '[UNVERIFIED value]')",
    "emphasis_over": "SELECT deck_id, slide, CAST(3 AS BIGINT) AS added FROM f WHERE contains(text, '==best==')",
    "emoji_audit": "SELECT deck_id, slide, field, '🚀' AS chars FROM f WHERE contains(text, '🚀')",
    "figure_crowding": "SELECT deck_id, slide, CAST(length(caption) + length(coalesce(annotation, '')) AS BIGINT) AS chars FROM s WHERE layout = 'assertion-evidence' AND length(caption) + length(coalesce(annotation, '')) > 240",
    "spec_problems": "SELECT deck_id, slide, layout, field, severity FROM (SELECT *, unnest(CASE WHEN layout = 'mystery' THEN ['layout error'] ELSE list_filter([CASE WHEN layout = 'section' AND trim(title) = '' THEN 'title error' END, CASE WHEN layout = 'critique-concerns' THEN 'points error' END, CASE WHEN layout IN ('assertion-evidence', 'results-table') AND source_ref IS NULL THEN 'source_ref warn' END, CASE WHEN layout = 'assertion-evidence' AND hero AND annotation IS NOT NULL THEN 'annotation error' END], lambda x: x IS NOT NULL) END) AS p, split_part(p, ' ', 1) AS field, split_part(p, ' ', 2) AS severity FROM s)",
    "ungrounded_numbers": "SELECT deck_id, slide, field, value, CASE WHEN starts_with(field, 'table[') OR layout = 'results-table' THEN 'P1' ELSE 'P2' END AS severity FROM (SELECT *, unnest(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?')) AS value FROM f) t LEFT JOIN src USING (deck_id) WHERE length(value) >= 2 AND NOT contains(regexp_replace(coalesce(source, ''), '([0-9]+\\.)\\s+([0-9]+)', '\\1\\2', 'g'), value)",
}
DECK_CALLS = {
    "deck_flags": lambda s, src: D.deck_flags(D.fields(s)), "emphasis_over": lambda s, src: D.emphasis_over(D.fields(s)), "emoji_audit": lambda s, src: D.emoji_audit(D.fields(s)),
    "figure_crowding": lambda s, src: D.figure_crowding(s), "spec_problems": lambda s, src: D.spec_problems(s), "ungrounded_numbers": lambda s, src: D.ungrounded_numbers(D.fields(s), src),
}
for _name, _call in DECK_CALLS.items():
    QUERIES[_name] = lambda spark, sf, f=_call: f(slides(spark, sf), sources(spark, sf))
    ORACLES[_name] = FIELDS + DECKS[_name]

MIX = f", mix AS (SELECT deck_id, slides, bullets, max_run, bullets / slides AS bullet_ratio FROM (SELECT deck_id, count(*) AS slides, count(*) FILTER (layout = 'bullets') AS bullets FROM s GROUP BY deck_id) JOIN (SELECT g AS deck_id, max_run FROM ({RUNS.format(g='deck_id', v='layout', o='slide', t='s')})) USING (deck_id))"


@_query(SLIDES + MIX + " SELECT * FROM mix")
def layout_mix(spark, sf):
    return D.layout_mix(slides(spark, sf))


GATE = FIELDS + MIX + ", q AS (" + " UNION ALL ".join([f"SELECT deck_id, severity FROM ({DECKS['ungrounded_numbers']})", f"SELECT deck_id, 'P2' FROM ({DECKS['deck_flags']})"] + [f"SELECT deck_id, 'P3' FROM ({DECKS[k]})" for k in ("emphasis_over", "emoji_audit", "figure_crowding")] + ["SELECT deck_id, 'P3' FROM mix WHERE bullet_ratio > 1 / 3", "SELECT deck_id, 'P3' FROM mix WHERE max_run >= 4", f"SELECT deck_id, 'P0' FROM ({DECKS['spec_problems']}) WHERE severity = 'error'"]) + """),
g AS (SELECT deck_id, count(*) FILTER (severity = 'P0') AS p0, count(*) FILTER (severity = 'P1') AS p1, count(*) FILTER (severity = 'P2') AS p2, count(*) FILTER (severity = 'P3') AS p3 FROM (SELECT * FROM q UNION ALL SELECT DISTINCT deck_id, '' FROM s) GROUP BY deck_id),
gates AS (SELECT *, CASE WHEN p0 > 0 THEN 'BLOCK' WHEN p1 > 0 THEN 'REVIEW' ELSE 'PASS' END AS gate FROM g)
"""


@_query(GATE + " SELECT * FROM gates")
def qa_gate(spark, sf):
    return D.gated(D.deck_reviews(slides(spark, sf), sources(spark, sf))).select("deck_id", "p0", "p1", "p2", "p3", "gate")


@_query(GATE + ", par AS (SELECT deck_id, count(*) FILTER (slide % 10 = 0) AS issues FROM s GROUP BY deck_id HAVING count(*) > 1) SELECT o_orderkey AS deck_id, coalesce(gate, 'MISSING') AS status, coalesce(slides, 0) AS slides, coalesce(max_run, 0) AS max_run, coalesce(issues, -1) AS parity, coalesce(gate, 'MISSING') IN ('MISSING', 'BLOCK') OR coalesce(issues, -1) > 0 AS hard_fail FROM orders LEFT JOIN gates ON gates.deck_id = o_orderkey LEFT JOIN mix ON mix.deck_id = o_orderkey LEFT JOIN par ON par.deck_id = o_orderkey")
def corpus_dashboard(spark, sf):
    s = slides(spark, sf)
    reviews = D.gated(D.deck_reviews(s, sources(spark, sf)))
    parity = s.groupBy("deck_id").agg(F.count_if(F.col("slide") % 10 == 0).alias("issues"), F.count("*").alias("n")).where("n > 1").drop("n")
    manifest = table(spark, sf, "orders").select(F.col("o_orderkey").alias("deck_id"))
    return D.dashboard(manifest, reviews, parity)


def caps(spark, sf):
    return _sql(spark, sf, I.CAPTIONS, "orders")


def rects(spark, sf):
    return _sql(spark, sf, I.RECTS, "lineitem")


CAP = f"WITH b AS ({I.BLOCKS}), c AS (SELECT *, regexp_extract(text, '^\\s*((?i:Figure|Fig\\.?|Table|Tab\\.?))\\s+([0-9]+|[IVXLCDM]+)', 2) AS number, CASE WHEN starts_with(lower(trim(text)), 'fig') THEN 'figure' ELSE 'table' END AS kind, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS caption, ltrim(regexp_replace(text, '^\\s*(?i:Figure|Fig\\.?|Table|Tab\\.?)\\s+(?:[0-9]+|[IVXLCDM]+)', '')) AS rest FROM b), k AS (SELECT *, CASE WHEN rest[1:1] IN (':', '.') THEN 2 WHEN rest <> '' AND upper(rest[1:1]) = rest[1:1] THEN 1 ELSE 0 END AS score FROM c WHERE number <> '')"


def blocks(spark, sf):
    return _sql(spark, sf, I.BLOCKS, "lineitem")


@_query(CAP + " SELECT doc_id, page, kind, number, arg_max(caption, ROW(score, length(caption), -pos)) AS caption, max(score) AS score FROM k GROUP BY ALL")
def captions_best(spark, sf):
    return G.best_captions(G.captions(blocks(spark, sf)))


@_query(CAP + " SELECT doc_id, kind, number, arg_max(page, r) AS page, arg_max(caption, r) AS caption, arg_max(pos % 2 = 0, r) AS localized FROM (SELECT *, ROW(pos % 2 = 0, length(caption), -page, -pos) AS r FROM k) GROUP BY ALL")
def inventory_best(spark, sf):
    found = G.captions(blocks(spark, sf)).withColumn("localized", F.col("pos") % 2 == 0)
    # One candidate per page first, so that ties between pages are decided by the page.
    rank = F.struct("localized", F.length("caption"), -F.col("pos"))
    one = found.groupBy("doc_id", "page", "kind", "number").agg(F.max_by(F.struct("caption", "localized"), rank).alias("r")).select("doc_id", "page", "kind", "number", "r.*")
    return G.best_inventory(one)


@_query(CAP + " SELECT doc_id, kind, number, arg_max(caption, ROW(length(caption) >= 12, length(caption), -pos)) AS caption, count(*) AS mentions FROM k GROUP BY ALL")
def caption_pick(spark, sf):
    return G.pick_captions(G.captions(blocks(spark, sf)))


RECT = f"WITH r AS ({I.RECTS}), c AS ({I.CAPTIONS})"


@_query(RECT + " SELECT page_id, x0, y0, x1, y1 FROM r WHERE y1 > 60 AND y0 < 940")
def margin_filter(spark, sf):
    return G.strip_margins(rects(spark, sf)).select("page_id", "x0", "y0", "x1", "y1")


@_query(RECT + " SELECT caption_id AS box_id, greatest(0, x0 - 12) AS x0, greatest(0, y0 - 4 - 0.02 * (y1 - y0)) AS y0, least(800, x1 + 12) AS x1, CASE WHEN y1 % 2 = 0 THEN y1 + 1.5 ELSE least(1000, y1 + 4 + 0.02 * (y1 - y0)) END AS y1 FROM c".replace("x0 - 12", "x0 - (4 + 0.02 * (x1 - x0))").replace("x1 + 12", "x1 + (4 + 0.02 * (x1 - x0))").replace("y0 - 4 - 0.02 * (y1 - y0)", "y0 - (4 + 0.02 * (y1 - y0))").replace("y1 + 4 + 0.02 * (y1 - y0)", "y1 + (4 + 0.02 * (y1 - y0))"))
def clip_rects(spark, sf):
    boxes = caps(spark, sf).select(F.col("caption_id").alias("box_id"), "x0", "y0", "x1", "y1", F.lit(800.0).alias("page_w"), "page_h", F.when(F.col("y1") % 2 == 0, F.col("y1") + 3).alias("cap_y0"))
    return G.clip_boxes(boxes)


@_query(RECT + " SELECT caption_id AS box_id, min(CASE WHEN (r.x0 + r.x1) / 2 BETWEEN c.x0 AND c.x1 AND (r.y0 + r.y1) / 2 BETWEEN c.y0 - 300 AND c.y1 THEN floor(r.size) END) AS min_font FROM c LEFT JOIN r USING (page_id) GROUP BY caption_id")
def min_font(spark, sf):
    boxes = caps(spark, sf).withColumnRenamed("caption_id", "box_id").withColumn("y0", F.col("y0") - 300)
    return G.min_font(boxes, rects(spark, sf).withColumn("size", F.floor("size").cast("double")).where("size >= 0").withColumn("size", F.when(F.col("size") > 0, F.col("size")).otherwise(F.lit(1e-9))))


@_query(f"""WITH RECURSIVE r AS ({I.RECTS}), c AS ({I.CAPTIONS}),
g AS (SELECT caption_id, page_id, kind, page_h, x0 AS cx0, y0 AS cy0, x1 AS cx1, y1 AS cy1, x0 AS gx0, CASE kind WHEN 'figure' THEN y0 ELSE y1 END AS gy0, x1 AS gx1, CASE kind WHEN 'figure' THEN y0 ELSE y1 END AS gy1, 0 AS k, true AS moved FROM c
 UNION ALL SELECT caption_id, page_id, kind, page_h, cx0, cy0, cx1, cy1, least(gx0, coalesce(a, gx0)), least(gy0, coalesce(b, gy0)), greatest(gx1, coalesce(d, gx1)), greatest(gy1, coalesce(e, gy1)), k + 1, coalesce(a < gx0 OR b < gy0 OR d > gx1 OR e > gy1, false) FROM (
  SELECT caption_id, g.page_id, kind, g.page_h, cx0, cy0, cx1, cy1, gx0, gy0, gx1, gy1, k, min(r.x0) AS a, min(r.y0) AS b, max(r.x1) AS d, max(r.y1) AS e FROM g LEFT JOIN r ON r.page_id = g.page_id
   AND CASE kind WHEN 'figure' THEN r.y1 <= cy0 + 2 ELSE r.y0 >= cy1 - 2 END AND least(gx1, r.x1) - greatest(gx0, r.x0) > 0 AND greatest(gy0, r.y0) - least(gy1, r.y1) <= 0.038 * g.page_h
  WHERE moved GROUP BY ALL)),
l AS (SELECT caption_id, kind, page_h, gx0 AS x0, CASE kind WHEN 'figure' THEN gy0 ELSE greatest(gy0, cy1) END AS y0, gx1 AS x1, CASE kind WHEN 'figure' THEN least(gy1, cy0) ELSE gy1 END AS y1, CASE kind WHEN 'figure' THEN gy0 < cy0 - 1 ELSE gy1 > cy1 + 1 END AS moved_any FROM (SELECT *, row_number() OVER (PARTITION BY caption_id ORDER BY k DESC) AS z FROM g) WHERE z = 1),
ok AS (SELECT *, moved_any AND y1 - y0 <= CASE kind WHEN 'figure' THEN 0.85 ELSE 0.5 END * page_h AS fine FROM l)
SELECT caption_id, CASE WHEN fine THEN x0 END AS x0, CASE WHEN fine THEN y0 END AS y0, CASE WHEN fine THEN x1 END AS x1, CASE WHEN fine THEN y1 END AS y1 FROM ok""")
def region_grow(spark, sf):
    return G.region_grow(caps(spark, sf), rects(spark, sf))


@_query(RECT + " SELECT caption_id, gap, rx0, ry0, rx1, ry1 FROM (SELECT caption_id, CASE kind WHEN 'figure' THEN c.y0 - r.y1 ELSE r.y0 - c.y1 END AS gap, r.x0 AS rx0, r.y0 AS ry0, r.x1 AS rx1, r.y1 AS ry1, row_number() OVER (PARTITION BY caption_id ORDER BY CASE kind WHEN 'figure' THEN c.y0 - r.y1 ELSE r.y0 - c.y1 END, r.x0, r.y0, r.x1, r.y1) AS k FROM c JOIN r USING (page_id) WHERE CASE kind WHEN 'figure' THEN c.y0 - r.y1 ELSE r.y0 - c.y1 END BETWEEN -2 AND 500 AND least(c.x1, r.x1) - greatest(c.x0, r.x0) > 0) WHERE k = 1")
def nearest_rect(spark, sf):
    return G.nearest_rect(caps(spark, sf), rects(spark, sf))


@_query("WITH l AS (SELECT DISTINCT l_orderkey AS fig_id, CAST(l_suppkey % 2 AS VARCHAR) AS style, CAST(l_linenumber AS BIGINT) AS k FROM lineitem WHERE l_linenumber <= 8) SELECT fig_id, style, CAST(coalesce(max(k) FILTER (k = r), 0) AS INTEGER) AS run FROM (SELECT *, row_number() OVER (PARTITION BY fig_id, style ORDER BY k) AS r FROM l) GROUP BY fig_id, style")
def panels(spark, sf):
    letters = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("fig_id"), (F.col("l_suppkey") % 2).cast("string").alias("style"), F.char((F.col("l_linenumber") + 96).cast("long")).alias("letter"))
    return G.panel_runs(letters)


MEAS = "SELECT o_orderkey AS slide_id, CASE o_custkey % 3 WHEN 0 THEN 'bullets' WHEN 1 THEN 'section' ELSE 'two-column' END AS layout, o_custkey % 5 > 0 AS has_body, o_custkey % 1080 AS bottom, o_custkey * 7 % 1920 AS right_edge FROM orders"


@_query(f"WITH m AS ({MEAS}), k AS (SELECT * FROM m WHERE has_body AND layout <> 'section') SELECT slide_id, 'vertical-void' AS check FROM k WHERE 1080 - bottom > 400 UNION ALL SELECT slide_id, 'horizontal-void' FROM k WHERE right_edge < 0.62 * 1920")
def canvas_voids(spark, sf):
    return D.canvas_voids(_sql(spark, sf, MEAS, "orders").withColumnRenamed("right_edge", "right"))


IMGS = "SELECT o_orderkey AS image_id, concat('figures/', CAST(o_custkey % 40 AS STRING), '.png') AS src, CAST(300 + o_custkey % 900 AS DOUBLE) AS rendered, CAST(800 + o_custkey * 3 % 2400 AS DOUBLE) AS natural_w, CAST(600 + o_custkey % 5 * 200 AS DOUBLE) AS natural_h FROM orders"


@_query(f"""WITH i AS ({IMGS}), m AS (SELECT CAST(k AS VARCHAR) AS key, CASE WHEN k % 4 > 0 THEN 4.0 + k % 7 END AS min_font_pt, 200.0 + k * 5 AS w, 150.0 + k % 3 * 80 AS h FROM range(30) t(k)), j AS (SELECT *, coalesce(min_font_pt > 0 AND abs(natural_w / natural_h - w / h) <= 0.2 * (w / h), false) AS trusted FROM i LEFT JOIN m ON key = regexp_extract(src, '(\\d+)\\.png', 1)) SELECT * FROM (SELECT image_id, CASE WHEN trusted THEN CASE WHEN min_font_pt * rendered / w < 12 THEN 'figure-text-illegible' END WHEN natural_w >= 1600 AND rendered / natural_w < 0.45 THEN 'figure-compressed' END AS "check" FROM j) WHERE "check" IS NOT NULL""")
def legibility(spark, sf):
    k = F.col("id")
    meta = spark.range(30).select(k.cast("string").alias("key"), F.when(k % 4 > 0, F.lit(4.0) + k % 7).alias("min_font_pt"), (F.lit(200.0) + k * 5).alias("w"), (F.lit(150.0) + k % 3 * 80).alias("h"))
    return D.legibility(_sql(spark, sf, IMGS, "orders").withColumnRenamed("natural_w", "natural"), meta)


BIBS = f"WITH b AS ({I.BIB})"


def bibs(spark, sf):
    return _sql(spark, sf, I.BIB, "orders")


CLASS = ", c AS (SELECT *, CASE record_id % 3 WHEN 0 THEN 'arxiv' WHEN 1 THEN 'doi' ELSE 'title' END AS kind, regexp_replace(query, '^(arXiv:|doi:)|v2$', '', 'g') AS value FROM b)"


@_query(BIBS + CLASS + " SELECT record_id, kind, value FROM c")
def bib_classify(spark, sf):
    return bibs(spark, sf).select("record_id", B.classified(F.col("query")).alias("c")).select("record_id", "c.*")


def _authors():
    return F.when(F.col("first") != "", F.array_repeat("first", F.col("n_authors"))).otherwise(F.array().cast("array<string>"))


@_query(BIBS + " SELECT record_id, concat(CASE first WHEN 'Ana O''Neil' THEN 'oneil' WHEN 'Bo Li' THEN 'li' ELSE 'anon' END, year) AS key FROM b")
def bib_keys(spark, sf):
    return bibs(spark, sf).withColumn("authors", _authors()).select("record_id", B.bib_key(F.col("authors"), F.col("year")).alias("key"))


@_query(BIBS + " SELECT record_id, concat_ws(' ', CASE WHEN first = '' THEN NULL WHEN n_authors > 6 THEN concat(first, ', ', first, ', ', first, ' et al.') ELSE concat(first, ', ', first) END, '(' || year || ')', title || '.', venue || '.', coalesce('https://doi.org/' || doi, 'arXiv:' || arxiv)) AS reference FROM b")
def bib_format(spark, sf):
    rows = bibs(spark, sf).withColumn("authors", _authors())
    return rows.select("record_id", B.reference(*(F.col(c) for c in ("authors", "year", "title", "venue", "doi", "arxiv"))).alias("reference"))


@_query(BIBS + CLASS + ", r AS (SELECT kind, key, min(record_id) AS record_id FROM (SELECT 'arxiv' AS kind, arxiv AS key, record_id FROM b WHERE arxiv IS NOT NULL UNION ALL SELECT 'doi', doi, record_id FROM b WHERE doi IS NOT NULL UNION ALL SELECT 'title', lower(title), record_id FROM b) GROUP BY kind, key) SELECT c.query, c.kind, c.value, r.record_id, r.record_id IS NOT NULL AS resolved FROM c LEFT JOIN r ON r.kind = c.kind AND r.key = CASE c.kind WHEN 'title' THEN trim(regexp_replace(lower(c.value), '[^a-z0-9]+', ' ', 'g')) ELSE lower(c.value) END")
def bib_resolve(spark, sf):
    b = bibs(spark, sf)
    return B.resolve(b.select("query"), b)


@_query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 2 THEN l > 0 ELSE l >= 15 OR 2.0 * l / (2 * l + CASE p_partkey % 3 WHEN 0 THEN 9 ELSE 1 END) >= 0.95 END AS matched
FROM (SELECT p_partkey, length(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'))) AS l FROM part)""")
def title_match(spark, sf):
    pairs = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("query"), F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, ": a survey").when(F.col("p_partkey") % 3 == 1, "s").otherwise("")).alias("result"))
    return B.title_match(pairs).select("p_partkey", "matched")


NUMBERS = "SELECT l_orderkey AS deck_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS slide, CAST(CAST(l_quantity AS BIGINT) AS STRING) AS q FROM lineitem"


@_query(f"SELECT deck_id, slide, 'cell' AS field FROM ({NUMBERS.replace('STRING', 'VARCHAR')}) WHERE length(q) > 1")
def parity_text(spark, sf):
    """Every expected number stands on its slide only inside a longer one if it has two digits."""
    rows = _sql(spark, sf, NUMBERS, "lineitem")
    expected = rows.select("deck_id", "slide", F.lit("cell").alias("field"), F.col("q").alias("text"))
    built = rows.select("deck_id", "slide", F.when(F.length("q") > 1, F.concat(F.lit("7"), "q")).otherwise(F.concat(F.lit("(=="), "q", F.lit("==)"))).alias("text"))
    return P.text_parity(expected, built)


@_query("""SELECT l_orderkey AS deck_id, coalesce(string_agg(q, ',' ORDER BY q) FILTER (k > 1), '') AS missing
FROM (SELECT l_orderkey, q, row_number() OVER (PARTITION BY l_orderkey, q) AS k FROM (SELECT l_orderkey, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS q FROM lineitem)) GROUP BY l_orderkey""")
def parity_cells(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_quantity").cast("long").cast("string"))).alias("want"), F.array_sort(F.collect_set(F.concat(F.lit("n "), F.col("l_quantity").cast("long").cast("string")))).alias("cells"))
    return li.select(F.col("l_orderkey").alias("deck_id"), F.array_join(P.missing_cells(F.col("want"), F.col("cells")), ",").alias("missing"))
