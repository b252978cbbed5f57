"""Agreement of what is written in several places: quantities of named things inside a manuscript, and values of a digest with its source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioguard.functions import text as H
from folioguard.sources.scratch import written

# Fixed values of our own: what counts as a named thing (two capitals or more, or an author with et al.), and units that are counted.
NAMED = r"[A-Z][A-Za-z0-9&-]*[A-Z][A-Za-z0-9&-]*(?![A-Za-z0-9])|[A-Z][a-z]+(?= et al)"
UNITS = ("%", "patients?", "subjects?", "participants?", "cases?", "images?", "scans?", "slices?", "volumes?", "cent(?:er|re)s?", "sites?", "units?", "parameters?", "layers?", "years?", "mm", "cm", "ms")
AMOUNT = r"\d(?<![A-Za-z0-9.\[]\d)[\d,]*(?:\.\d+)?"
SENTENCE_END = r"\s(?<=[;!?]\s|(?<! al)\.\s)\s*"
#: Levels of a digest that one pass takes apart.
LEVELS = 8
#: Keys of a digest whose values are not taken from the source.
OWN_KEYS = ("language", "notes_flags", "render_as", "kind", "factual", "resolved", "id", "key", "source_ref")


def quantities(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, entity, amount, unit: each amount with a unit belongs to the last named thing before it in its sentence.

    Names lose their signs and case, units their plural; thousands separators go. Amounts without a name before them are left out.
    """
    # One pass over a line finds names, amounts with their units, and white space where a sentence ends; most lines have no such amount.
    counted = rf"{AMOUNT}\s*(?i:{'|'.join(UNITS)})(?![A-Za-z0-9])"
    none = F.array().cast("array<struct<named:string,counted:string>>")

    def step(state: Column, w: Column) -> Column:
        kept = F.struct(state["last"].alias("last"), F.array_append(state["found"], F.struct(state["last"].alias("named"), w.alias("counted"))).alias("found"))
        return F.when(~w.between("0", ":"), F.struct(w.alias("last"), state["found"].alias("found"))).when(state["last"].between("A", "["), kept).otherwise(state)

    words = F.regexp_extract_all("line", F.lit(rf"{NAMED}|{counted}|{SENTENCE_END}"), 0)
    found = F.aggregate(words, F.struct(F.lit("").alias("last"), none.alias("found")), step, lambda s: s["found"])
    rows = lines.where(F.regexp_like("line", F.lit(counted))).select("doc_id", "line_no", F.explode(found).alias("q")).select("doc_id", "line_no", "q.*")
    unit = F.lower(F.regexp_replace("counted", r"^[0-9,.]+\s*", ""))
    unit = F.regexp_replace(F.replace(unit, F.lit("centre"), F.lit("center")), "(?<=[a-z]{3})s$", "")
    amount = F.translate(F.regexp_extract("counted", "^[0-9,.]+", 0), ",", "").try_cast("double")
    return rows.select("doc_id", "line_no", F.translate(F.lower("named"), "&-", "").alias("entity"), amount.alias("amount"), unit.alias("unit")).where("amount IS NOT NULL")


def conflicting_quantities(lines: DataFrame) -> DataFrame:
    """doc_id, entity, unit, amounts, lines (both ascending): things of a document that come with different amounts of one unit."""
    seen = quantities(lines).groupBy("doc_id", "entity", "unit").agg(F.collect_list(F.struct("amount", "line_no")).alias("seen"))
    several = lambda c: F.array_sort(F.array_distinct(F.col("seen." + c)))
    return seen.where(F.exists("seen", lambda x: x["amount"] != F.col("seen")[0]["amount"])).select("doc_id", "entity", "unit", several("amount").alias("amounts"), several("line_no").alias("lines"))


def _depth(digest: Column) -> Column:
    """How deep the brackets of a JSON text go, LEVELS + 1 at most; those inside of its strings do not count."""
    bare = F.regexp_replace(F.regexp_replace(digest, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', ""), r"[^\[\]{}]+", "")
    start = F.struct(bare.alias("left"), F.lit(0).alias("n"))
    less = lambda s, _: F.when(s["left"] == "", s).otherwise(F.struct(F.regexp_replace(s["left"], r"\[\]|\{\}", "").alias("left"), (s["n"] + 1).alias("n")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS + 1)), start, less, lambda s: s["n"])


def digest_leaves(digests: DataFrame) -> DataFrame:
    """paper_id, path, key, value: the leaves of digests (paper_id, digest JSON) of any depth; key is the last name on the path.

    Digests of up to LEVELS levels are taken apart in one pass, deeper ones a level at a time. Unreadable digests have no leaves; empty
    objects and arrays are none either.
    """
    sized = digests.where("digest IS NOT NULL").select("paper_id", "digest").withColumn("depth", _depth(F.col("digest")))
    deepest = sized.agg(F.max("depth")).first()[0] or 0
    rows = sized.where(F.col("depth") <= LEVELS).select("paper_id", F.lit("$").alias("path"), F.lit("").alias("key"), F.try_parse_json("digest").alias("v")).where("v IS NOT NULL")
    for _ in range(min(deepest, LEVELS)):
        rows = digests.sparkSession.sql(
            """SELECT paper_id, CASE WHEN e.pos IS NULL THEN path WHEN e.key IS NULL THEN concat(path, '[', e.pos, ']') ELSE concat(path, '.', e.key) END AS path, coalesce(e.key, t.key) AS key, coalesce(e.value, t.v) AS v
            FROM {t} t, LATERAL variant_explode_outer(v) e""", t=rows
        )
    kind = F.schema_of_variant("v")
    leaves = rows.where(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY")).select("paper_id", "path", "key", F.try_variant_get("v", "$", "string").alias("value"))
    return leaves if deepest <= LEVELS else leaves.unionByName(_leaves_in_rounds(sized.where(F.col("depth") > LEVELS)))


def _leaves_in_rounds(digests: DataFrame) -> DataFrame:
    """A level of all digests is taken apart at a time, so the rounds follow the depth."""
    rows = digests.select("paper_id", F.lit("$").alias("path"), F.lit("").alias("key"), F.try_parse_json("digest").alias("v")).where("v IS NOT NULL")
    done: list[DataFrame] = []
    while True:
        kind = F.schema_of_variant("v")
        rows = rows.withColumn("kind", F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").otherwise("leaf"))
        rows = written(rows.select("paper_id", "path", "key", "kind", F.to_json("v").alias("j")))
        done.append(rows.where("kind = 'leaf'").select("paper_id", "path", "key", F.try_variant_get(F.parse_json("j"), "$", "string").alias("value")))
        inner = rows.where("kind <> 'leaf'")
        if inner.isEmpty():
            return reduce(DataFrame.unionByName, done)
        rows = digests.sparkSession.sql(
            "SELECT paper_id, CASE WHEN kind = 'object' THEN concat(path, '.', e.key) ELSE concat(path, '[', e.pos, ']') END AS path, coalesce(e.key, t.key) AS key, e.value AS v FROM {t} t, LATERAL variant_explode(parse_json(j)) e", t=inner
        )


def ungrounded_leaves(digests: DataFrame, sources: DataFrame, own: tuple[str, ...] = OWN_KEYS) -> DataFrame:
    """paper_id, path, value, missing: values of digests that their source (paper_id, source) does not bear out.

    A value with numbers needs all of them among the source's numbers (``missing`` names those that are not, by value), any other value must
    stand in the source as a whole, white space, case and marks aside (``missing`` is then the value). Blank and null values, truth values, flagged ones
    ([MISSING ..]) and those of ``own`` keys are not looked up. Without a source nothing is borne out.
    """
    leaves = digest_leaves(digests).where(~F.col("key").isin(*own)).where("trim(value) <> '' AND value NOT IN ('true', 'false')")
    leaves = leaves.where(F.size(H.flags(F.col("value"))) == 0).withColumn("numbers", F.array_distinct(H.number_tokens(F.col("value"))))
    there = sources.select("paper_id", H.normalised(F.col("source")).alias("text"), F.array_distinct(H.number_tokens(H.rejoin_decimals(F.col("source")))).alias("n"))
    there = there.groupBy("paper_id").agg(F.collect_list("text").alias("texts"), F.flatten(F.collect_list("n")).alias("there"))
    rows = leaves.join(there.hint("merge"), "paper_id", "left")
    lost = F.array_except("numbers", F.coalesce("there", F.array().cast("array<string>")))
    borne = F.transform(F.array(H.normalised(F.col("value"))), lambda v: F.coalesce(F.exists("texts", lambda s: H.contains_whole(s, v)), F.lit(False)))[0]
    numbered = F.size("numbers") > 0
    missing = F.when(numbered, F.nullif(F.array_join(F.array_sort(lost), ","), F.lit(""))).otherwise(F.when(~borne, F.col("value")))
    found = rows.select("paper_id", "path", "value", missing.alias("missing"), numbered.alias("numbered")).where("missing IS NOT NULL")
    times = found.groupBy("paper_id", "path", "value", "missing", "numbered").agg(F.count("*").cast("int").alias("n"))  # one row for a value with numbers
    return times.select("paper_id", "path", "value", "missing", F.explode(F.array_repeat(F.lit(1), F.when(F.col("numbered"), 1).otherwise(F.col("n"))))).drop("col")
