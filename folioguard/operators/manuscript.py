"""Manuscript audit: lines (doc_id, line_no, line) to findings (doc_id, severity, category, line_no, detail).

A manuscript is a partition of rows. Windows run inside one document only; rule tables are constants.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioguard.functions import text as H

# Rules that results depend on.
PLACEHOLDERS = (r"\bxxx\b", r"\[TBD\]", r"x\):xxx", r"doi:\s*10\.[A-Za-z0-9_.-]+/x{2,}", "to be added", "to be declared", "figure placeholder", r"\[Figure placeholder\]")
#: Each match of PLACEHOLDERS has one of these, in lower case; each claim one of those.
PLACEHOLDER_PARTS = ("xxx", "[tbd]", "/xx", "to be added", "to be declared", "figure placeholder")
CLAIM_PARTS = ("systematic", "meta")
HEADINGS_LATIN = ("references", "reference list", "reference", "bibliography", "works cited", "literature cited")
HEADINGS_CJK = ("参考文献", "引用文献", "参考资料", "参考书目")
TELLS = ("has shown promising", "may suggest", "interestingly,", "in recent years,", "it is worth noting", "demonstrates the effectiveness of", "may offer significant advantages")
VENDORS = ("HeartFlow", "Cleerly", "Caristo", "Keya", "Shukun", "DeepVessel", "CaRi-Heart", "CaRi-Plaque")
SUPPORT = ("PRISMA", "eligibility criteria", "search strategy", "screening", "risk of bias", "data extraction")
NEGATIONS = (r"not\s+(?:intended\s+as\s+)?(?:a\s+)?systematic\s+review", r"not\s+(?:intended\s+as\s+)?(?:a\s+)?meta-?analysis", r"rather\s+than\s+a\s+systematic\s+review", r"narrative\s+rather\s+than")
SELF_CLAIMS = (
    r"\b(?:we|the\s+authors?)\b[^.\n]{0,80}?\b(?:conduct(?:ed)?|perform(?:ed)?|present(?:ed)?|report(?:ed)?|undert(?:ook|ake)|carr(?:y|ied)\s+out)\b[^.\n]{0,40}?\b(systematic\s+review|meta-?analysis)\b",
    r"\b(?:this|the\s+present|our)\s+(?:\w+\s+){0,2}?(systematic\s+review|meta-?analysis)\b",
    r"\b(systematic\s+review|meta-?analysis)\b[^.\n]{0,30}?\b(?:was|were)\s+(?:conducted|performed|undertaken|carried\s+out|registered)\b",
)
ENTRY = r"^\s*(?:\[(\d+)\]|(\d+)\.)\s*(.+)"
DOI = r"\b10\.\d{4,9}/[-._;()/:A-Za-z0-9]+\b"
RANKS = {"critical": 4, "high": 3, "medium": 2, "low": 1}
BREAKS = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\x{2028}\x{2029}]"


def lines_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line, numbered from 1; a last empty piece is no line."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), BREAKS)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.size(parts).alias("n"), F.posexplode(parts).alias("k", "line"))
    return rows.where("NOT (line = '' AND k = n - 1)").select("doc_id", (F.col("k") + 1).cast("long").alias("line_no"), "line")


def with_zones(lines: DataFrame) -> DataFrame:
    """``lines`` with zone: body, heading (the first reference heading) or refs."""
    text = H.heading(F.col("line"))
    low = F.lower(text)
    said = low.isin(*HEADINGS_LATIN) | F.array_contains(F.array(*(low.startswith(t + " ") for t in HEADINGS_LATIN)), True) | text.isin(*HEADINGS_CJK)
    is_ref = F.when(F.contains("line", F.lit("#")), F.coalesce(said, F.lit(False))).otherwise(False)
    first = F.min(F.when(is_ref, F.col("line_no"))).over(Window.partitionBy("doc_id"))
    zone = F.when(first.isNull() | (F.col("line_no") < first), "body").when(F.col("line_no") == first, "heading").otherwise("refs")
    return lines.withColumn("zone", zone)


def _with_entries(zoned: DataFrame) -> DataFrame:
    """``zoned`` with no (the number that a line of the references starts with), entry_no (entries so far, 0 before the first) and part."""
    no = F.coalesce(*(F.nullif(F.regexp_extract("line", ENTRY, k), F.lit("")).try_cast("long") for k in (1, 2)))
    rows = zoned.withColumn("no", F.when(F.col("zone") == "refs", no))
    own = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    part = F.trim(F.when(F.col("no").isNotNull(), F.regexp_extract("line", ENTRY, 3)).otherwise(F.col("line")))
    return rows.withColumns({"entry_no": F.count("no").over(own), "part": F.when(F.col("zone") == "refs", part)})


def _entry_text() -> F.Column:
    """The parts of an entry's lines, in order; an aggregate."""
    parts = F.array_sort(F.collect_list(F.when((F.col("part") != "") | F.col("no").isNotNull(), F.struct("line_no", "part"))))
    return F.trim(F.array_join(F.transform(parts, lambda x: x["part"]), " "))


def bibliography(zoned: DataFrame) -> DataFrame:
    """doc_id, ref_no, entry: continuation lines are joined; of a repeated number the last entry counts."""
    rows = _with_entries(zoned).where("entry_no > 0")
    entries = rows.groupBy("doc_id", "entry_no").agg(F.max("no").alias("ref_no"), _entry_text().alias("entry"))
    return entries.groupBy("doc_id", "ref_no").agg(F.max_by("entry", "entry_no").alias("entry"))


def citations(zoned: DataFrame) -> DataFrame:
    """doc_id, line_no, n for each number cited in the body."""
    return zoned.where("zone = 'body'").select("doc_id", "line_no", F.explode(H.citation_numbers(F.col("line"))).alias("n"))


def _finding(df: DataFrame, severity: str, category: str, line_no="line_no", detail=None) -> DataFrame:
    line = F.col(line_no) if isinstance(line_no, str) else line_no
    return df.select("doc_id", F.lit(severity).alias("severity"), F.lit(category).alias("category"), line.cast("long").alias("line_no"), (F.lit("") if detail is None else detail).alias("detail"))


def _hit(severity: str, category: str, detail: F.Column) -> F.Column:
    return F.struct(F.lit(severity).alias("severity"), F.lit(category).alias("category"), F.col("line_no").cast("long").alias("line_no"), F.coalesce(detail, F.lit("")).alias("detail"))


def _hits(*hits: F.Column) -> F.Column:
    """The hits that are there; null without any, so that a line without a hit costs no array."""
    return F.when(F.coalesce(*hits).isNotNull(), F.array_compact(F.array(*hits)))


def _any(low: F.Column, parts: tuple[str, ...]) -> F.Column:
    out = F.contains(low, F.lit(parts[0]))
    for p in parts[1:]:
        out = out | F.contains(low, F.lit(p))
    return out


def _exploded(rows: DataFrame, hits: list[F.Column]) -> DataFrame:
    """Findings out of the hits of a line."""
    return rows.select("doc_id", F.explode(_hits(*hits)).alias("h")).select("doc_id", "h.severity", "h.category", "h.line_no", "h.detail")


def placeholder_hits(low: F.Column | None = None) -> list[F.Column]:
    """``low``, here and below, is the lower-cased line, if there is a column of it. What costs little to find decides first whether a pattern is tried."""
    said = _any(F.lower("line") if low is None else low, PLACEHOLDER_PARTS) & F.col("line").rlike("(?i)" + "|".join(f"(?:{p})" for p in PLACEHOLDERS))
    return [F.when(said, _hit("critical", "placeholder", H.excerpt(F.col("line"))))]


def heading_hits() -> list[F.Column]:
    t, about, some = F.trim("line"), H.excerpt(F.col("line")), F.contains("line", F.lit("##"))
    numbered = some & t.rlike(r"^#{2,4}\s+\d+(?:\.\d+)*\.?\s+")
    return [F.when(numbered, _hit("medium", "numbered_heading", about)), F.when(some & t.startswith("#### "), _hit("medium", "h4_heading", about))]


def tell_hits(phrases: tuple[str, ...] = TELLS, low: F.Column | None = None) -> list[F.Column]:
    low = F.lower("line") if low is None else low
    return [F.when(F.contains(low, F.lit(p)), _hit("low", "llm_tell", F.lit(p))) for p in phrases]


def vendor_hits(vendors: tuple[str, ...] = VENDORS) -> list[F.Column]:
    """Reads ``zone``. Each pattern is a constant, so it is compiled once."""
    t = F.trim("line")
    prose = (F.col("zone") == "body") & ~(t.startswith("|") & t.endswith("|"))
    edge = lambda v: F.contains("line", F.lit(v)) & F.col("line").rlike(rf"(?<![A-Za-z0-9_])\Q{v}\E(?![A-Za-z0-9_])")
    return [F.when(edge(v) & prose, _hit("high", "vendor_body_mention", F.lit(v))) for v in vendors]


def equation_hits() -> list[F.Column]:
    """Reads ``box``."""
    return [F.when(F.contains("line", F.lit("$$")) & ~F.col("box"), _hit("medium", "display_equation_outside_box", H.excerpt(F.col("line"))))]


def with_box(lines: DataFrame) -> DataFrame:
    """``lines`` with box: the last heading of level 1 to 4 says 'box'."""
    level = F.contains("line", F.lit("#")) & (F.regexp_extract("line", r"^(#{1,4})\s+", 1) != "")
    own = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("box", F.coalesce(F.last(F.when(level, F.contains(F.lower("line"), F.lit("box"))), ignorenulls=True).over(own), F.lit(False)))


def placeholders(lines: DataFrame) -> DataFrame:
    return _exploded(lines, placeholder_hits())


def headings(lines: DataFrame) -> DataFrame:
    """Numbered H2 to H4 and H4 itself; a line may give both."""
    return _exploded(lines, heading_hits())


def phrase_tells(lines: DataFrame, phrases: tuple[str, ...] = TELLS) -> DataFrame:
    """One finding per line and phrase, by substring of the lower-cased line."""
    return _exploded(lines, tell_hits(phrases))


def vendor_mentions(zoned: DataFrame, vendors: tuple[str, ...] = VENDORS) -> DataFrame:
    """Vendors named in the body outside of tables; case matters, and word edges do."""
    return _exploded(zoned, vendor_hits(vendors))


def display_equations(lines: DataFrame) -> DataFrame:
    """'$$' where the last heading of level 1 to 4 does not say 'box'."""
    return _exploded(with_box(lines), equation_hits())


FRONT = 150


def _supported() -> list[F.Column]:
    """For each term of method, whether a line names it (no term spans lines)."""
    return [F.contains(F.lower("line"), F.lit(t.lower())) for t in SUPPORT]


def _claims_systematic(title: F.Column, front: F.Column) -> F.Column:
    """``title`` is the first line of ``front``."""
    some = _any(F.lower(front), CLAIM_PARTS)
    for p in NEGATIONS:
        front = F.regexp_replace(front, "(?i)" + p, " ")
    claim = title.rlike(r"^#\s") & title.rlike(r"(?i)\b(systematic\s+review|meta-?analysis)\b")
    for p in SELF_CLAIMS:
        claim = claim | front.rlike("(?i)" + p)
    return some & claim


def unsupported_systematic(lines: DataFrame) -> DataFrame:
    """Documents that call themselves systematic and lack terms of method; the detail lists the missing ones.

    Only the first FRONT lines of a document are put together, for the claims.
    """
    named = [F.bool_or(c).alias(f"t{k}") for k, c in enumerate(_supported())]
    front = F.array_sort(F.collect_list(F.when(F.col("line_no") <= FRONT, F.struct("line_no", "line"))))
    docs = lines.groupBy("doc_id").agg(front.alias("front"), *named)
    missing = F.array_compact(F.array(*(F.when(~F.col(f"t{k}"), F.lit(t)) for k, t in enumerate(SUPPORT))))
    claim = _claims_systematic(F.trim(F.try_element_at("front.line", F.lit(1))), F.array_join("front.line", "\n"))
    rows = docs.withColumn("missing", missing).where(claim & (F.size("missing") > 0))
    return _finding(rows, "critical", "unsupported_systematic_claim", F.lit(0), F.array_join("missing", ", "))


def missing_references(cites: DataFrame, refs: DataFrame) -> DataFrame:
    """Citations of numbers without an entry, once per occurrence, in documents that have a bibliography."""
    some = refs.select("doc_id").distinct()
    rows = cites.join(some, "doc_id", "left_semi").join(refs.select("doc_id", F.col("ref_no").alias("n")), ["doc_id", "n"], "left_anti")
    return _finding(rows, "high", "missing_reference", detail=F.col("n").cast("string"))


def uncited_references(cites: DataFrame, refs: DataFrame, most: int = 20) -> DataFrame:
    """Per document, the number of entries never cited and the first ``most`` of them."""
    rows = refs.join(cites.select("doc_id", F.col("n").alias("ref_no")), ["doc_id", "ref_no"], "left_anti")
    rows = rows.groupBy("doc_id").agg(F.count("*").alias("k"), F.array_join(F.slice(F.array_sort(F.collect_set("ref_no")), 1, most).cast("array<string>"), ",").alias("first"))
    return _finding(rows, "low", "uncited_reference", F.lit(0), F.concat(F.col("k").cast("string"), F.lit(": "), F.col("first")))


def references_not_detected(cites: DataFrame, refs: DataFrame) -> DataFrame:
    """Documents with citations and no bibliography; the detail counts the markers."""
    rows = cites.join(refs, "doc_id", "left_anti").groupBy("doc_id").agg(F.count("*").alias("k"))
    return _finding(rows, "low", "references_not_detected", F.lit(0), F.col("k").cast("string"))


def author_mismatches(zoned: DataFrame, refs: DataFrame) -> DataFrame:
    """'Name et al. [n]' whose entry n names other people; entries without names cannot tell."""
    said = zoned.where("zone = 'body'").select("doc_id", "line_no", F.explode(H.author_citations(F.col("line"))).alias("c")).select("doc_id", "line_no", "c.surname", F.col("c.n").alias("ref_no"))
    rows = said.join(refs.where("entry <> ''"), ["doc_id", "ref_no"]).withColumn("names", H.author_tokens(F.col("entry")))
    rows = rows.where((F.size("names") > 0) & ~F.array_contains("names", F.col("surname")))
    return _finding(rows, "high", "author_citation_mismatch", detail=F.concat(F.col("surname"), F.lit(" "), F.col("ref_no").cast("string")))


def duplicate_dois(refs: DataFrame) -> DataFrame:
    """DOIs that occur more than once in a bibliography, twice in one entry included."""
    rows = refs.select("doc_id", F.explode(F.regexp_extract_all("entry", F.lit(DOI), 0)).alias("doi"))
    rows = rows.groupBy("doc_id", F.rtrim(F.lower("doi"), F.lit(".")).alias("doi")).count().where("count > 1")
    return _finding(rows, "high", "duplicate_doi", F.lit(0), F.concat(F.col("doi"), F.lit(" x"), F.col("count").cast("string")))


def audit(lines: DataFrame, vendors: tuple[str, ...] = VENDORS) -> DataFrame:
    """All findings of all manuscripts, a row each; see ``audits``."""
    return audits(lines, vendors).select("doc_id", F.explode("findings").alias("f")).select("doc_id", "f.*")


def audits(lines: DataFrame, vendors: tuple[str, ...] = VENDORS) -> DataFrame:
    """doc_id, reference_count, findings of every manuscript, those without findings too, in one pass with one exchange, by doc_id.

    Windows give each line its zone, box and entry. The lines of an entry (and all lines before the first) are
    then put together, then the entries of a document; both aggregates group inside the partitions that the windows
    have made. What is gathered per document are findings, citations and entries, not its lines. A null doc_id is
    a document like any other.
    """
    low = F.col("low")
    z = with_zones(lines.withColumn("low", F.lower("line")))
    may = F.max((F.col("line_no") <= FRONT) & _any(low, CLAIM_PARTS)).over(Window.partitionBy("doc_id"))
    z = _with_entries(with_box(z.withColumn("may_claim", may)))
    line = F.col("line")
    hits = _hits(*placeholder_hits(low), *heading_hits(), *tell_hits(low=low), *equation_hits(), *vendor_hits(vendors))
    body = (F.col("zone") == "body") & F.contains(line, F.lit("["))
    gathered = {
        "hits": hits,
        "cites": F.when(body, F.transform(H.citation_numbers(line), lambda n: F.struct(F.col("line_no").cast("long").alias("line_no"), n.alias("n")))),
        "named": F.when(body, F.transform(H.author_citations(line), lambda c: F.struct(F.col("line_no").cast("long").alias("line_no"), c["n"].alias("n"), c["surname"].alias("surname")))),
    }
    # Claims and terms of method are looked for in documents that may claim something.
    terms = F.when(F.col("may_claim"), sum((F.when(F.contains(low, F.lit(t.lower())), 1 << k).otherwise(0) for k, t in enumerate(SUPPORT)), F.lit(0)))
    front = F.when(F.col("may_claim") & (F.col("line_no") <= FRONT), F.struct("line_no", "line"))
    rows = z.select("doc_id", "line_no", "no", "entry_no", "part", front.alias("front"), terms.alias("terms"), *(c.alias(k) for k, c in gathered.items()))
    together = lambda k: F.flatten(F.collect_list(F.when(F.size(k) > 0, F.col(k)))).alias(k)
    parts = rows.groupBy("doc_id", "entry_no").agg(*(together(k) for k in gathered), F.max("no").alias("ref_no"), _entry_text().alias("entry"), F.collect_list("front").alias("front"), F.bit_or("terms").alias("terms"))
    entry = F.when(F.col("entry_no") > 0, F.struct("ref_no", "entry_no", "entry"))
    docs = parts.groupBy("doc_id").agg(
        *(together(k) for k in gathered), F.array_sort(F.collect_list(entry)).alias("entries"), F.array_sort(F.flatten(F.collect_list("front"))).alias("front"), F.bit_or("terms").alias("terms")
    )
    # Of a repeated number the last entry counts.
    last = F.filter("entries", lambda e, i: ~F.coalesce(F.try_element_at("entries", i + 2)["ref_no"] == e["ref_no"], F.lit(False)))
    docs = docs.withColumn("refs", F.transform(last, lambda e: F.struct(e["ref_no"].alias("n"), e["entry"].alias("entry"), H.author_tokens(e["entry"]).alias("names"))))
    found = [F.col("hits"), _claim_findings(), _reference_findings(), _doi_findings()]
    # An array of one element, so that what is made of the findings does not find them again.
    return docs.select("doc_id", F.size("refs").cast("long").alias("reference_count"), F.explode(F.array(F.concat(*found))).alias("findings"))


_FOUND = "array<struct<severity:string,category:string,line_no:bigint,detail:string>>"


def _whole(severity: str, category: str, detail: F.Column) -> F.Column:
    return F.struct(F.lit(severity).alias("severity"), F.lit(category).alias("category"), F.lit(0).cast("long").alias("line_no"), detail.alias("detail"))


def _claim_findings() -> F.Column:
    missing = F.array_compact(F.array(*(F.when(F.col("terms").bitwiseAND(F.lit(1 << k)) == 0, F.lit(t)) for k, t in enumerate(SUPPORT))))
    claim = (F.size("front") > 0) & _claims_systematic(F.trim(F.try_element_at("front.line", F.lit(1))), F.array_join("front.line", "\n"))
    return F.array_compact(F.array(F.when(claim & (F.size(missing) > 0), _whole("critical", "unsupported_systematic_claim", F.array_join(missing, ", ")))))


def _let(value: F.Column, use) -> F.Column:
    """``use`` of ``value``, which is evaluated once, also where ``use`` names it inside of a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _reference_findings(most: int = 20) -> F.Column:
    """``missing_references``, ``author_mismatches``, ``uncited_references`` and ``references_not_detected`` of a document's cites, named and refs."""
    hit = lambda severity, category, c, detail: F.struct(F.lit(severity).alias("severity"), F.lit(category).alias("category"), c["line_no"].alias("line_no"), detail.alias("detail"))
    some = F.size("refs") > 0
    unknown = F.when(some, F.array_except("cites.n", "refs.n")).otherwise(F.array().cast("array<bigint>"))
    missing = _let(unknown, lambda u: F.when(F.size(u) > 0, F.transform(F.filter("cites", lambda c: F.array_contains(u, c["n"])), lambda c: hit("high", "missing_reference", c, c["n"].cast("string")))).otherwise(F.array().cast(_FOUND)))
    telling = F.filter("refs", lambda r: (r["entry"] != "") & (F.size(r["names"]) > 0))
    # A number has one entry, whose place is found among plain longs; a number without one has place 0, which holds nobody.
    names = lambda refs, c: F.try_element_at(refs["names"], F.nullif(F.array_position(refs["n"], c["n"]), F.lit(0).cast("long")).cast("int"))
    other = lambda refs, c: ~F.array_contains(names(refs, c), c["surname"])
    detail = lambda c: F.concat(c["surname"], F.lit(" "), c["n"].cast("string"))
    told = _let(telling, lambda t: F.struct(F.transform(t, lambda r: r["n"]).alias("n"), F.transform(t, lambda r: r["names"]).alias("names")))
    mismatch = _let(told, lambda refs: F.transform(F.filter("named", lambda c: F.coalesce(other(refs, c), F.lit(False))), lambda c: hit("high", "author_citation_mismatch", c, detail(c))))
    first = lambda u: F.concat(F.size(u).cast("string"), F.lit(": "), F.array_join(F.slice(u, 1, most).cast("array<string>"), ","))
    uncited = _let(F.array_sort(F.array_except("refs.n", "cites.n")), lambda u: F.array_compact(F.array(F.when(F.size(u) > 0, _whole("low", "uncited_reference", first(u))))))
    undetected = F.array_compact(F.array(F.when(~some & (F.size("cites") > 0), _whole("low", "references_not_detected", F.size("cites").cast("string")))))
    return F.concat(missing, mismatch, uncited, undetected)


def _doi_findings() -> F.Column:
    dois = F.flatten(F.transform("refs", lambda r: F.transform(F.regexp_extract_all(r["entry"], F.lit(DOI), 0), lambda d: F.rtrim(F.lower(d), F.lit(".")))))
    times = lambda s, d: F.size(F.filter(s, lambda x: x == d))
    return _let(dois, lambda s: F.transform(F.filter(F.array_distinct(s), lambda d: times(s, d) > 1), lambda d: _whole("high", "duplicate_doi", F.concat(d, F.lit(" x"), times(s, d).cast("string")))))


def rank(severity) -> F.Column:
    out = F.lit(0)
    for k, v in RANKS.items():
        out = F.when(severity == k, v).otherwise(out)
    return out


def severity_summary(findings: DataFrame) -> DataFrame:
    """Per document: findings of each severity (zeros included) and their number. ``summaries`` does it for ``audits``."""
    return findings.groupBy("doc_id").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in RANKS), F.count("*").alias("findings"))


def summaries(audits: DataFrame) -> DataFrame:
    """``severity_summary`` of ``audits``."""
    n = lambda s: F.size(F.filter("findings", lambda f: f["severity"] == s)).cast("long").alias(s)
    return audits.where(F.size("findings") > 0).select("doc_id", *map(n, RANKS), F.size("findings").cast("long").alias("findings"))


def gates(audits: DataFrame, fail_on: str = "high") -> DataFrame:
    """``gate`` of ``audits``."""
    severe = [s for s, r in RANKS.items() if r >= RANKS[fail_on]]
    return audits.where(F.size("findings") > 0).select("doc_id", F.arrays_overlap(F.col("findings.severity"), F.array(*map(F.lit, severe))).alias("failed"))


def gate(findings: DataFrame, fail_on: str = "high") -> DataFrame:
    """doc_id, failed: any finding at least as severe as ``fail_on``."""
    return findings.groupBy("doc_id").agg(F.bool_or(rank(F.col("severity")) >= RANKS[fail_on]).alias("failed"))


def _markdown(findings: F.Column) -> F.Column:
    text = lambda f: F.concat(F.lit("- **"), f["severity"], F.lit("** "), f["category"], F.lit(" ("), F.when(f["line_no"] == 0, "global").otherwise(F.concat(F.lit("line "), f["line_no"].cast("string"))), F.lit("): "), f["detail"])
    return F.array_join(F.transform(F.array_sort(findings), text), "\n").alias("report")


def _ranked(of=F.col) -> F.Column:
    return F.struct((-rank(of("severity"))).alias("r"), *(of(c).alias(c) for c in ("category", "line_no", "severity", "detail")))


def as_markdown(findings: DataFrame) -> DataFrame:
    """One report per document: findings from severe to mild, then by category and line; line 0 is global."""
    return findings.groupBy("doc_id").agg(_markdown(F.collect_list(_ranked())))


def markdowns(audits: DataFrame) -> DataFrame:
    """``as_markdown`` of ``audits``."""
    return audits.where(F.size("findings") > 0).select("doc_id", _markdown(F.transform("findings", lambda f: _ranked(lambda c: f[c]))))
