"""Every alternative of the line rules, planted beside lines that only look like it, with SQL written from the rules."""

from __future__ import annotations

from folioguard.operators import manuscript as M
from folioguard.operators import protocol as P
from folioguard.plans.catalogue import _query, _spread, _sql

PLANTED = (
    # Placeholders.
    "value xxx here", "XXX", "axxx", "xxxx", "see [TBD] now", "[tbd]", "TBD", "a x):xxx b", "DOI: 10.1000/xx", "doi:10.1000/x", "doi: 10.1000.a_b/xxxx", "To be added later", "to be  added", "TO BE DECLARED", "figure placeholder", "[Figure placeholder]", "figure place",
    # Headings.
    "## 2 Methods", "### 2.1. Data", "#### 2.1.3 Parts", "# 1 Title", "##### 1 Deep", "##2 Tight", "#### Notes", "  ## 3 Indented", "####Tight", "## Methods 2",
    # Phrases.
    "It has shown promising results", "This MAY SUGGEST so", "Interestingly, it rose", "interestingly it rose", "In recent years, it rose", "in recent years it rose", "It is worth noting that", "worth noting", "demonstrates the effectiveness of it", "may offer significant advantages", "may offer advantages",
    # Vendors.
    "HeartFlow did", "heartflow did", "by Cleerly.", "Cleerlys", "Caristo/Keya", "Keyas", "(Shukun)", "Shukun2", "DeepVessel", "DeepVessel_2", "CaRi-Heart and CaRi-Plaque", "CaRi-Hearts", "| Cleerly | x |", "| Cleerly", "_Keya",
    # Stubs.
    "10.xxxx/1", "XXXX", "[UNVERIFIED] x", "[UNVERIFIED: x]", "doi:10.abc/x", "forthcoming DOI", "Forthcoming DOI",
    # Directions with citations.
    "Higher doses [1]", "lower [2, 3-4]", "an increased rate [5]", "decreased [6] and [7]", "BETTER [8]", "worse [9]", "higher without a number", "betterment [1]", "flower [1]", "better [0]", "same [1]",
)
LINES = "SELECT o_orderkey AS doc_id, CAST(o_custkey % 100 + 1 AS BIGINT) AS line_no, CASE o_orderkey % {n} {cases} END AS line FROM orders".format(
    n=len(PLANTED), cases=" ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(PLANTED))
)
FOUND = "SELECT doc_id, '{severity}' AS severity, {category} AS category, line_no, {detail} AS detail FROM (" + LINES.replace("{", "{{").replace("}", "}}") + ") WHERE {when}"


# Fixed values, stated here again so that a wrong list in the operators does not pass.
SAID = "['has shown promising', 'may suggest', 'interestingly,', 'in recent years,', 'it is worth noting', 'demonstrates the effectiveness of', 'may offer significant advantages']"
NAMED = "['HeartFlow', 'Cleerly', 'Caristo', 'Keya', 'Shukun', 'DeepVessel', 'CaRi-Heart', 'CaRi-Plaque']"


def lines(spark, sf):
    return _sql(spark, sf, LINES, "orders")


@_query(FOUND.format(severity="critical", category="'placeholder'", detail="line", when=r"regexp_matches(line, '(?i)\bxxx\b|\[tbd\]|x\):xxx|doi:\s*10\.[a-z0-9_.-]+/xx+|to be added|to be declared|figure placeholder')"))
def planted_placeholders(spark, sf):
    return M.placeholders(lines(spark, sf))


@_query(FOUND.format(severity="medium", category="'numbered_heading'", detail="trim(line)", when=r"regexp_matches(trim(line), '^#{2,4}\s+[0-9]+(\.[0-9]+)*\.?\s')") + " UNION ALL " + FOUND.format(severity="medium", category="'h4_heading'", detail="trim(line)", when="starts_with(trim(line), '#### ')"))
def planted_headings(spark, sf):
    return M.headings(lines(spark, sf))


@_query(FOUND.format(severity="low", category="'llm_tell'", detail=f"unnest(list_filter({SAID}, lambda p: contains(lower(line), p)))", when="true"))
def planted_tells(spark, sf):
    return M.phrase_tells(lines(spark, sf))


@_query(FOUND.format(severity="high", category="'vendor_body_mention'", detail=f"unnest(list_filter({NAMED}, lambda v: regexp_matches(line, '(^|[^A-Za-z0-9_])' || v || '($|[^A-Za-z0-9_])')))", when="NOT (starts_with(line, '|') AND ends_with(line, '|'))"))
def planted_vendors(spark, sf):
    return M.vendor_mentions(M.with_zones(lines(spark, sf)))


@_query(f"SELECT * FROM (SELECT doc_id, line_no, regexp_extract(line, 'xxx|XXXX|\\[TBD\\]|\\[UNVERIFIED\\]|doi:10\\.[a-z]+/x|forthcoming DOI|10\\.xxxx') AS stub FROM ({LINES})) WHERE stub <> ''")
def planted_stubs(spark, sf):
    return P.stub_markers(lines(spark, sf))


@_query(f"SELECT doc_id, line_no, CAST(CASE line WHEN 'lower [2, 3-4]' THEN 3 WHEN 'decreased [6] and [7]' THEN 2 ELSE 1 END AS BIGINT) AS citations FROM ({LINES}) WHERE regexp_matches(line, '(?i)\\b(higher|lower|increased|decreased|better|worse)\\b') AND regexp_matches(line, '\\[[1-9]')")
def planted_directions(spark, sf):
    return P.direction_claims(lines(spark, sf))


# Bibliographies under every kind of heading, with continuation lines, both styles of numbers and a repeated one.
TITLES = ("## References", "# REFERENCE LIST", "### Reference", "## Bibliography and notes", "## Works Cited:", "## literature cited", "## 参考文献", "## 引用文献：", "## 参考资料", "## 参考书目", "## Referenced work", "## 参考文献表")
DOCS = "SELECT o_orderkey AS doc_id, o_custkey AS c, o_orderkey % {n} AS k, CASE o_orderkey % {n} {cases} END AS title FROM orders".format(n=len(TITLES), cases=" ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(TITLES)))


@_query(f"WITH d AS (SELECT * FROM ({DOCS}) WHERE k < {len(TITLES) - 2}) SELECT doc_id, 1 AS ref_no, concat('Wang A, Li B. Study ', c, '. Later entry.') AS entry FROM d UNION ALL SELECT doc_id, 2, 'Xu C. and its second line third line' FROM d UNION ALL SELECT doc_id, 12, '' FROM d UNION ALL SELECT doc_id, 14, 'Kim D.' FROM d")
def planted_entries(spark, sf):
    text = "concat('Body [1]\\n[9] no entry\\n', title, '\\nnot an entry yet\\n[1] First.\\n2. Xu C.\\n  and its second line\\n\\n third line  \\n[12] \\n  [14]Kim D.\\n[1] Wang A, Li B. Study ', CAST(c AS STRING), '.\\nLater entry.')"
    docs = _spread(_sql(spark, sf, DOCS, "orders"), "doc_id", 50_000).selectExpr("doc_id", f"{text} AS text")  # ten lines of each
    return M.bibliography(M.with_zones(M.lines_of(docs)))
