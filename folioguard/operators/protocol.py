"""Rules that are stated in prose for reviewers, proposal writers and deck authors, as operators.

Each takes plain relations and returns findings or measures. Rule tables are constants of this module; they
are turned into expressions, so nothing is joined that does not come from data. Null texts count as empty.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioguard.functions import text as H

# Patterns, word lists and limits that results depend on.
STUBS = r"xxx|XXXX|\[TBD\]|\[UNVERIFIED\]|doi:10\.[a-z]+/x|forthcoming DOI|10\.xxxx"
AUTHOR_YEAR = r"\(([A-Z][A-Za-z]+)(?: et al\.| & [A-Z][A-Za-z]+)?,? ([0-9]{4}[a-z]?)\)"
AUTHOR_ENTRY = r"^\s*([A-Z][A-Za-z]+)[^(]*\(([0-9]{4}[a-z]?)\)"
COMMON_SURNAMES = (("zhang", "wang", "chen", "liu"), ("smith", "johnson", "williams", "brown"), ("patel", "kumar", "singh", "sharma"), ("sato", "tanaka", "suzuki", "watanabe"))
DIRECTION = r"(?i)\b(?:higher|lower|increased|decreased|better|worse)\b"
VERDICTS = r"currently the most|has yet to demonstrate|best understood as|next [0-9]+ years will"
TITLE_CLICHES = ("delve into", "unlocking", "revolutionizing", "a deep dive", "navigating the landscape", "in today's world", "game-changing")
PROSE_CLICHES = (
    "over the past decade,", "in recent years,", "it is worth noting that", "importantly, it should be noted", "plays a crucial role", "plays a pivotal role", "plays a vital role",
    "delves into", "sheds light on", "paves the way for", "a testament to", "the ever-evolving landscape of", "aims to explore the fascinating world of",
    "众所周知", "不言而喻", "具有重要的理论意义和现实意义",
)
SLIDE_CLICHES = ("dive into", "explore", "journey", "let's look at", "let me show you", "exciting", "amazing", "revolutionary", "in conclusion", "to summarize")
STYLES = {
    "academic-paper": ("paper", "thesis", "defense", "conference", "ieee", "acm", "icml", "neurips", "cvpr", "acl", "aaai", "iclr"),
    "sketch-notes": ("tutorial", "learn", "education", "guide", "intro", "beginner"),
    "chalkboard": ("classroom", "teaching", "school", "chalkboard", "blackboard"),
    "blueprint": ("architecture", "system", "data", "analysis", "technical"),
    "vector-illustration": ("creative", "children", "kids", "cute", "illustration"),
    "intuition-machine": ("briefing", "bilingual", "infographic", "concept"),
    "minimal": ("executive", "minimal", "clean", "simple", "elegant"),
    "notion": ("saas", "product", "dashboard", "metrics", "productivity"),
    "corporate": ("investor", "quarterly", "business", "corporate", "proposal"),
    "bold-editorial": ("launch", "marketing", "keynote", "bold", "impact", "magazine"),
    "dark-atmospheric": ("entertainment", "music", "gaming", "creative", "atmospheric"),
    "editorial-infographic": ("explainer", "journalism", "science communication"),
    "fantasy-animation": ("story", "fantasy", "animation", "magical", "whimsical"),
    "pixel-art": ("gaming", "retro", "pixel", "developer", "nostalgia"),
    "scientific": ("biology", "chemistry", "medical", "pathway", "scientific"),
    "vintage": ("history", "heritage", "vintage", "expedition", "historical"),
    "watercolor": ("lifestyle", "wellness", "travel", "artistic", "natural"),
}
DEFAULT_STYLE = "blueprint"
SLIDE_TOPICS = {
    "Methods": ("architecture", "framework", "pipeline", "network"), "Results": ("comparison", "results", "performance"),
    "Analysis": ("ablation", "analysis"), "Qualitative Results": ("qualitative", "visual"),
}
EXTRACT = ("architecture", "framework", "pipeline", "overview", "structure", "comparison", "results", "performance", "evaluation", "ablation", "analysis", "study", "qualitative", "visual", "segmentation", "detection")
SLIDE_BANDS = ((5, 5, 7), (10, 8, 12), (15, 12, 18), (20, 15, 22), (30, 25, 35))
RUBRIC = {"Research Questions": 15, "Literature Review": 20, "Methodology": 25, "Academic Writing": 20, "Overall Coherence": 10, "Technical Accuracy": 10}
WORD_BUDGETS = {"Abstract": (150, 300), "Introduction": (500, 800), "Literature Review": (500, 1000), "Methodology": (500, 800), "Timeline": (200, 300), "Significance": (200, 400)}
JOURNAL_CLUB = ("critique-concerns", "discussion-questions")
TERMS = {"coronary CT angiography (CCTA)": ("cardiac CT", "CT angio"), "centerline": ("midline", "vessel line")}
DIGEST_KEYS = ("thesis_claim", "contributions", "problem", "gap", "method", "results", "ablations", "asset_inventory", "limitations", "bibliography", "language", "notes_flags")


def _text(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _any(text: Column, words) -> Column:
    return reduce(or_, (F.contains(text, F.lit(w)) for w in words))


def word_count(c: Column) -> Column:
    """Runs of other than white space."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"\S+")).cast("long")


def author_year_orphans(body: DataFrame, entries: DataFrame) -> DataFrame:
    """doc_id, surname, year, kind of citations without an entry and entries without a citation.

    body: doc_id, line; entries: doc_id, entry. Both sides are made distinct before one full join.
    """
    pairs = F.arrays_zip(F.regexp_extract_all("line", F.lit(AUTHOR_YEAR), 1).alias("surname"), F.regexp_extract_all("line", F.lit(AUTHOR_YEAR), 2).alias("year"))
    cited = body.select("doc_id", F.explode(pairs).alias("p")).select("doc_id", "p.surname", "p.year").distinct().withColumn("cited", F.lit(True))
    listed = entries.select("doc_id", F.regexp_extract("entry", AUTHOR_ENTRY, 1).alias("surname"), F.regexp_extract("entry", AUTHOR_ENTRY, 2).alias("year")).where("surname <> ''").distinct().withColumn("listed", F.lit(True))
    both = cited.join(listed, ["doc_id", "surname", "year"], "full").where("cited IS NULL OR listed IS NULL")
    return both.select("doc_id", "surname", "year", F.when(F.col("listed").isNull(), "orphan-citation").otherwise("orphan-reference").alias("kind"))


def stub_markers(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, line_no, line) that hold a stub, with the first of them."""
    return lines.select("doc_id", "line_no", F.regexp_extract(_text("line"), STUBS, 0).alias("stub")).where("stub <> ''")


def generic_authors(records: DataFrame) -> DataFrame:
    """Records (record_id, authors) of four authors who all have a common surname (first word of each) of one language."""
    surname = lambda a: F.lower(F.element_at(F.split(F.trim(a), r"\s+"), 1))
    all_of = lambda names: F.forall("authors", lambda a: surname(a).isin(*names))
    common = reduce(or_, map(all_of, COMMON_SURNAMES))
    return records.where((F.size("authors") == 4) & common).select("record_id")


def direction_claims(lines: DataFrame) -> DataFrame:
    """Lines that cite and speak of a direction: candidates for a check against the source."""
    n = F.size(H.citation_numbers(_text("line")))
    return lines.where(F.col("line").rlike(DIRECTION) & (n > 0)).select("doc_id", "line_no", n.cast("long").alias("citations"))


def inconsistent_entities(mentions: DataFrame) -> DataFrame:
    """entity, descriptions of entities (entity, description) that are described in more than one way."""
    return mentions.where("description IS NOT NULL").distinct().groupBy("entity").agg(F.count("*").alias("descriptions")).where("descriptions > 1")


def verdict_sentences(docs: DataFrame, least: int = 3) -> DataFrame:
    """doc_id, verdicts, enough of texts (doc_id, text)."""
    n = F.regexp_count(_text("text"), F.lit(VERDICTS)).cast("long")
    return docs.select("doc_id", n.alias("verdicts"), (n >= least).alias("enough"))


def review_synthesis(flags: DataFrame) -> DataFrame:
    """doc_id, hard_fixes, hard_errors, drift, strategy, ships.

    flags: doc_id, issue, pass, kind (hard, drift or other). An issue flagged by two passes is a hard fix. Five
    hard errors or ten drifts ask for a reset; a document ships only without hard errors.
    """
    issues = flags.groupBy("doc_id", "issue").agg(F.count_distinct("pass").alias("passes"), F.bool_or(F.col("kind") == "hard").alias("hard"), F.bool_or(F.col("kind") == "drift").alias("drift"))
    rows = issues.groupBy("doc_id").agg(F.count_if(F.col("passes") >= 2).alias("hard_fixes"), F.count_if("hard").alias("hard_errors"), F.count_if("drift").alias("drift"))
    strategy = F.when((F.col("hard_errors") >= 5) | (F.col("drift") >= 10), "reset").when((F.col("hard_errors") > 0) | (F.col("hard_fixes") > 0), "in place").otherwise("none")
    return rows.withColumns({"strategy": strategy, "ships": F.col("hard_errors") == 0})


def literature_matrix(papers: DataFrame) -> DataFrame:
    """axis, family, papers of (paper_id, axis, family); a null axis is unmapped."""
    return papers.groupBy("axis", "family").agg(F.count("*").alias("papers"))


def taxonomy_fits(papers: DataFrame, most: float = 0.3) -> DataFrame:
    """One row: papers, unmapped, fits (no more than the share ``most`` is unmapped; no papers fit)."""
    n, un = F.count("*"), F.count_if(F.col("axis").isNull())
    return papers.agg(n.alias("papers"), un.alias("unmapped"), (un <= most * n).alias("fits"))


def screening_flow(records: DataFrame) -> DataFrame:
    """One row: identified, deduplicated, screened, full_text, included of (key, on_topic, has_text, eligible)."""
    one = records.groupBy("key").agg(*(F.bool_or(F.coalesce(c, F.lit(False))).alias(c) for c in ("on_topic", "has_text", "eligible")), F.count("*").alias("n"))
    topic, text, fit = F.col("on_topic"), F.col("has_text"), F.col("eligible")
    return one.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("identified"), F.count("*").alias("deduplicated"), F.count_if(topic).alias("screened"), F.count_if(topic & text).alias("full_text"), F.count_if(topic & text & fit).alias("included"))


def auto_style(docs: DataFrame) -> DataFrame:
    """doc_id, style, signals: the style with most keywords in the text; the earlier in the table wins ties, none means the default."""
    plain = F.concat(F.lit(" "), H.normalised_title(F.col("text")), F.lit(" "))
    rows = docs.select("doc_id", plain.alias("plain"))
    hits = [F.struct(reduce(add, (F.contains("plain", F.lit(f" {w} ")).cast("long") for w in words)).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("style")) for k, (name, words) in enumerate(STYLES.items())]
    best = F.array_max(F.array(*hits))
    return rows.select("doc_id", best.alias("b")).select("doc_id", F.when(F.col("b.n") > 0, F.col("b.style")).otherwise(DEFAULT_STYLE).alias("style"), F.col("b.n").alias("signals"))


def slide_topic(text: Column) -> Column:
    """The first topic of the table that the text names, else null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda c, kv: c.when(_any(low, kv[1]), kv[0]), list(SLIDE_TOPICS.items())[1:], F.when(_any(low, SLIDE_TOPICS["Methods"]), "Methods"))


def figure_plan(captions: DataFrame) -> DataFrame:
    """fig_id, topic, source of (fig_id, kind, caption): first topic of the table named in it; extract or generate. Tables are extracted."""
    low = F.lower(_text("caption"))
    return captions.select("fig_id", slide_topic(F.col("caption")).alias("topic"), F.when((F.col("kind") == "table") | _any(low, EXTRACT), "extract").otherwise("generate").alias("source"))


def confidence_band(score: Column) -> Column:
    return F.when(score > 0.8, "auto").when(score >= 0.5, "review").otherwise("skip")


def slide_count_verdict(minutes: Column, slides: Column) -> Column:
    """under, within or over the band of the longest talk in the table that is not longer; the first band for shorter ones."""
    low = high = None
    for m, lo, hi in reversed(SLIDE_BANDS[1:]):
        low, high = (F.when(minutes >= m, lo), F.when(minutes >= m, hi)) if low is None else (low.when(minutes >= m, lo), high.when(minutes >= m, hi))
    low, high = low.otherwise(SLIDE_BANDS[0][1]), high.otherwise(SLIDE_BANDS[0][2])
    return F.when(slides < low, "under").when(slides > high, "over").otherwise("within")


def rubric_result(ratings: DataFrame) -> DataFrame:
    """proposal_id, average, lowest, passes of (proposal_id, section, rating); all sections must be rated."""
    weight = reduce(lambda c, kv: c.when(F.col("section") == kv[0], kv[1]), list(RUBRIC.items())[1:], F.when(F.col("section") == "Research Questions", RUBRIC["Research Questions"]))
    rows = ratings.withColumn("w", weight).where("w IS NOT NULL AND rating IS NOT NULL")
    out = rows.groupBy("proposal_id").agg((F.sum(F.col("w") * F.col("rating")) / F.sum("w")).alias("average"), F.min("rating").alias("lowest"), F.count_distinct("section").alias("n"))
    return out.select("proposal_id", "average", "lowest", ((F.col("average") >= 3.5) & (F.col("lowest") >= 3) & (F.col("n") == len(RUBRIC))).alias("passes"))


def word_budgets(sections: DataFrame, slack: float = 0.1) -> DataFrame:
    """doc_id, section, words, verdict of (doc_id, section, text) for the sections that have a budget."""
    n = word_count(F.col("text"))
    under, over = (reduce(or_, ((F.col("section") == s) & test(b) for s, b in WORD_BUDGETS.items())) for test in (lambda b: F.col("words") < b[0] * (1 - slack), lambda b: F.col("words") > b[1] * (1 + slack)))
    rows = sections.where(F.col("section").isin(*WORD_BUDGETS)).select("doc_id", "section", n.alias("words"))
    return rows.withColumn("verdict", F.when(under, "under").when(over, "over").otherwise("within"))


def recency(refs: DataFrame, now: int, years: int = 5, least: float = 0.6) -> DataFrame:
    """doc_id, refs, recent, current of (doc_id, year): whether the share of the last ``years`` is large enough."""
    recent = F.count_if(F.col("year") > now - years)
    return refs.where("year IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("refs"), recent.alias("recent"), (recent >= least * F.count("*")).alias("current"))


def spot_checks(refs: DataFrame, share: float = 0.2) -> DataFrame:
    """At least ``share`` of each document's references (doc_id, ref_no), by a hash, so that repeats choose alike."""
    own = Window.partitionBy("doc_id")
    rank = F.row_number().over(own.orderBy(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("ref_no").cast("string"))), "ref_no"))
    return refs.withColumns({"k": rank, "n": F.count("*").over(own)}).where(F.col("k") <= F.ceil(F.col("n") * share)).select("doc_id", "ref_no")


def crowded_brackets(lines: DataFrame, most: int = 4) -> DataFrame:
    """Lines with a bracket that cites more than ``most`` references, and how many it cites."""
    groups = F.transform(F.regexp_extract_all(_text("line"), F.lit(r"\[[0-9][0-9,\-\s]*\]"), 0), lambda b: F.size(H.citation_numbers(b)))
    return lines.select("doc_id", "line_no", F.coalesce(F.array_max(groups), F.lit(0)).cast("long").alias("refs")).where(F.col("refs") > most)


def table_runs(lines: DataFrame) -> DataFrame:
    """doc_id, first_line, rows of each run of consecutive lines that begin and end with a pipe."""
    rows = lines.where(F.trim("line").rlike(r"^\|[\s\S]*\|$")).select("doc_id", "line_no")
    island = F.col("line_no") - F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))
    return rows.withColumn("i", island).groupBy("doc_id", "i").agg(F.min("line_no").alias("first_line"), F.count("*").alias("rows")).drop("i")


def table_limits(lines: DataFrame, most: int = 4, longest: int = 20) -> DataFrame:
    """doc_id, tables, long_tables, fine of documents with tables."""
    out = table_runs(lines).groupBy("doc_id").agg(F.count("*").alias("tables"), F.count_if(F.col("rows") > longest).alias("long_tables"))
    return out.withColumn("fine", (F.col("tables") <= most) & (F.col("long_tables") == 0))


def cliches(rows: DataFrame, phrases: tuple[str, ...], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, phrase for each phrase in the lower-cased text."""
    low = F.lower(_text(text))
    return rows.select(key, F.explode(F.array_compact(F.array(*(F.when(F.contains(low, F.lit(p)), p) for p in phrases)))).alias("phrase"))


def fidelity(checks: DataFrame) -> DataFrame:
    """deck_id, passed, checks, faithful of (deck_id, check, ok); unknown counts as failed."""
    ok = F.count_if(F.coalesce("ok", F.lit(False)))
    return checks.groupBy("deck_id").agg(ok.alias("passed"), F.count("*").alias("checks"), (ok == F.count("*")).alias("faithful"))


def renumbered(slides: DataFrame) -> DataFrame:
    """deck_id, slug, file_stem, role, repeated of (deck_id, position, slug): numbered in order, slugs kept. Equal positions: by slug."""
    own = Window.partitionBy("deck_id")
    k, n = F.row_number().over(own.orderBy("position", "slug")), F.count("*").over(own)
    rows = slides.withColumns({"k": k, "n": n, "repeated": F.count("*").over(Window.partitionBy("deck_id", "slug")) > 1})
    role = F.when(F.col("k") == 1, "cover").when(F.col("k") == F.col("n"), "back-cover").otherwise("content")
    return rows.select("deck_id", "slug", F.concat(F.format_string("%02d", "k"), F.lit("-slide-"), "slug").alias("file_stem"), role.alias("role"), "repeated")


def missing_layouts(slides: DataFrame, required: tuple[str, ...] = JOURNAL_CLUB) -> DataFrame:
    """deck_id, layout of required layouts that a deck (deck_id, layout) has no slide of. No set is collected."""
    has = slides.groupBy("deck_id").agg(*(F.bool_or(F.coalesce(F.col("layout") == l, F.lit(False))).alias(f"h{k}") for k, l in enumerate(required)))
    return has.select("deck_id", F.explode(F.array_compact(F.array(*(F.when(~F.col(f"h{k}"), l) for k, l in enumerate(required))))).alias("layout"))


def notes_length(notes: DataFrame, low: int = 40, high: int = 120) -> DataFrame:
    """slide_id, words, verdict of (slide_id, notes); CJK characters count as words."""
    n = (F.size(F.regexp_extract_all(_text("notes"), F.lit(H.LATIN_WORD), 0)) + F.regexp_count(_text("notes"), F.lit(H.CJK))).cast("long")
    return notes.select("slide_id", n.alias("words")).withColumn("verdict", F.when(F.col("words") < low, "short").when(F.col("words") > high, "long").otherwise("fine"))


def agenda_size(items: Column) -> Column:
    return F.coalesce(F.size(items).between(5, 9), F.lit(False))


def long_captions(figures: DataFrame, most: int = 100) -> DataFrame:
    """fig_id, words of captions (fig_id, caption) of more than ``most`` words."""
    return figures.select("fig_id", word_count(F.col("caption")).alias("words")).where(F.col("words") > most)


def key_points_fine(bullets: Column) -> Column:
    return F.coalesce(bullets.between(4, 5), F.lit(False))


def avoided_terms(docs: DataFrame, terms: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """doc_id, term, variant for each variant to avoid that the text holds; letter case counts."""
    terms = TERMS if terms is None else terms
    found = [F.when(F.contains(_text("text"), F.lit(v)), F.struct(F.lit(t).alias("term"), F.lit(v).alias("variant"))) for t, vs in terms.items() for v in vs]
    return docs.select("doc_id", F.explode(F.array_compact(F.array(*found))).alias("f")).select("doc_id", "f.*")


def front_matter(docs: DataFrame) -> DataFrame:
    """doc_id, title_fine, abstract_fine of (doc_id, title, abstract): title of 10 to 15 words, abstract without citations and figures."""
    abstract = _text("abstract")
    bare = ~abstract.rlike(AUTHOR_YEAR) & (F.size(H.citation_numbers(abstract)) == 0) & ~abstract.rlike(r"!\[|(?i:\bfigure\s+\d)")
    return docs.select("doc_id", word_count(F.col("title")).between(10, 15).alias("title_fine"), bare.alias("abstract_fine"))


def paragraph_lengths(docs: DataFrame, low: int = 4, high: int = 8) -> DataFrame:
    """doc_id, paragraphs, unusual: paragraphs part at blank lines; sentences end in . ! or ? before white space or the end."""
    parts = F.filter(F.split(_text("text"), r"\n[ \t\r]*\n"), lambda p: F.trim(p) != "")
    odd = F.filter(parts, lambda p: ~F.regexp_count(p, F.lit(r"[.!?](?:\s|$)")).between(low, high))
    return docs.select("doc_id", F.size(parts).cast("long").alias("paragraphs"), F.size(odd).cast("long").alias("unusual"))


def digest_gaps(digests: DataFrame) -> DataFrame:
    """paper_id, key of a digest's keys (paper_id, digest JSON) without a value, unless one of its flags names the key."""
    value = lambda k: F.coalesce(F.get_json_object("digest", f"$.{k}"), F.lit(""))
    named = F.array_join(H.flags(value("notes_flags")), " ")
    open_ = lambda k: F.trim(value(k)).isin("", "[]", "{}", "null") & ~named.rlike(rf"(?<![A-Za-z0-9_]){k}(?![A-Za-z0-9_])")
    gaps = F.array_compact(F.array(*(F.when(open_(k), k) for k in DIGEST_KEYS if k != "notes_flags")))
    return digests.select("paper_id", F.explode(gaps).alias("key"))
