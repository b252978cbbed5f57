"""Results as JSON documents: audits, reviews of decks, resolved bibliographies and source bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioguard.operators.manuscript import RANKS

# The order in which scanners report.
SCANNERS = (
    "placeholder", "numbered_heading", "h4_heading", "llm_tell", "display_equation_outside_box", "unsupported_systematic_claim", "vendor_body_mention", "missing_reference", "author_citation_mismatch",
    "uncited_reference", "references_not_detected", "duplicate_doi",
)


def _counts(severities: Column, order: tuple[str, ...]) -> Column:
    """map of severity to number, those that occur, in ``order``."""
    n = lambda s: F.size(F.filter(severities, lambda x: x == s))
    return F.map_from_entries(F.array_compact(F.array(*(F.when(n(s) > 0, F.struct(F.lit(s).alias("k"), n(s).alias("v"))) for s in order))))


def _audit_report(found: Column) -> Column:
    """The JSON document of a row with doc_id and reference_count; found: findings with their place among the scanners first."""
    items = F.transform(found, lambda x: F.struct(x["severity"].alias("severity"), x["category"].alias("category"), x["line_no"].alias("line_no"), x["detail"].alias("detail")))
    severities = F.transform(found, lambda x: x["severity"])
    report = F.struct(F.col("doc_id").alias("file"), F.coalesce("reference_count", F.lit(0)).alias("reference_count"), items.alias("findings"), _counts(severities, tuple(RANKS)).alias("summary"))
    return F.to_json(report).alias("report")


def _placed(of=F.col) -> Column:
    place = F.array_position(F.array(*map(F.lit, SCANNERS)), of("category"))
    return F.struct(place.alias("place"), *(of(c).alias(c) for c in ("line_no", "detail", "severity", "category")))


def audit_documents(docs: DataFrame, findings: DataFrame, refs: DataFrame) -> DataFrame:
    """doc_id, report: one JSON document per doc_id of ``docs``, with file, reference_count, findings in the order of scanners, and summary."""
    found = findings.groupBy("doc_id").agg(F.array_sort(F.collect_list(_placed())).alias("f"))
    counts = refs.groupBy("doc_id").agg(F.count("*").alias("reference_count"))
    both = docs.select("doc_id").distinct().join(counts, "doc_id", "left").join(found, "doc_id", "left")
    none = F.array().cast(found.schema["f"].dataType)
    return both.withColumn("f", F.coalesce("f", none)).select("doc_id", _audit_report(F.col("f")))


def audited_documents(audits: DataFrame) -> DataFrame:
    """``audit_documents`` of ``manuscript.audits``, whose rows have all that a report takes."""
    rows = audits.select("doc_id", "reference_count", F.array_sort(F.transform("findings", lambda f: _placed(lambda c: f[c]))).alias("f"))
    return rows.select("doc_id", _audit_report(F.col("f")))


def review_documents(reviews: DataFrame) -> DataFrame:
    """deck_id, report, status of ``deck.gated`` reviews: findings by severity and category as JSON, and 2, 1 or 0 for BLOCK, REVIEW, PASS."""
    report = F.struct(F.col("deck_id"), F.array_sort("findings").alias("findings"), F.struct("p0", "p1", "p2", "p3").alias("summary"), F.col("gate"))
    status = F.when(F.col("gate") == "BLOCK", 2).when(F.col("gate") == "REVIEW", 1).otherwise(0)
    return reviews.select("deck_id", F.to_json(report).alias("report"), status.alias("status"))


def reference_lines(resolved: DataFrame) -> DataFrame:
    """query, line of resolved queries (query, resolved, key, reference): '[ok]  key: reference', else '[UNVERIFIED] query'."""
    ok = F.concat(F.lit("  [ok]  "), F.coalesce("key", F.lit("")), F.lit(": "), F.coalesce("reference", F.lit("")))
    return resolved.select("query", F.when(F.col("resolved"), ok).otherwise(F.concat(F.lit("  [UNVERIFIED] "), "query")).alias("line"))


def bundles(ingests: DataFrame, counts: DataFrame) -> DataFrame:
    """doc_id, manifest: a source's pages, title, id and ``geometry.bundle_counts`` as JSON; zeros without figures."""
    rows = ingests.join(counts, "doc_id", "left").na.fill(0, ["n_figures", "n_tables", "n_localized", "n_flagged"])
    fields = F.struct("doc_id", "n_pages", "title", "arxiv_id", "n_figures", "n_tables", "n_localized", "n_flagged")
    return rows.select("doc_id", F.to_json(fields, {"ignoreNullFields": "false"}).alias("manifest"))


def write_documents(rows: DataFrame, column: str, path: str) -> None:
    """JSON documents of ``column``, one a line, to files under ``path``."""
    rows.select(column).write.mode("overwrite").text(path)
