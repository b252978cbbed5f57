"""Bibliography: classify queries, make keys and references, verify titles, resolve against records."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioguard.functions import text as H

# Ids, and the fields that hold a year.
ARXIV = r"(?i)^(?:arxiv:)?(\d{4}\.\d{4,5})(?:v\d+)?$"
DOI = r"(?i)^(?:doi:)?(10\.\d{4,9}/\S+)$"
#: The first of these that has a year decides.
YEAR_FIELDS = ("published-print", "published-online", "issued", "created")
#: Characters of a title from which on a longer one may extend it, and of the shortest parts that near titles share.
SPECIFIC = 15
GRAM = 4
#: From this ratio on, edits leave a title of any length one part of GRAM characters at least.
LEAST_RATIO = 0.94


def classified(q: Column) -> Column:
    """struct<kind, value>: arxiv id without version, DOI without prefix, or title."""
    q = F.trim(F.coalesce(q, F.lit("")))
    s = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    return F.when(q.rlike(ARXIV), s("arxiv", F.regexp_extract(q, ARXIV, 1))).when(q.rlike(DOI), s("doi", F.regexp_extract(q, DOI, 1))).otherwise(s("title", q))


def bib_key(authors: Column, year: Column) -> Column:
    """First author's last name in a-z, or anon, and the year."""
    family = F.regexp_replace(F.lower(F.element_at(F.split(F.trim(F.try_element_at(authors, F.lit(1))), r"\s+"), -1)), "[^a-z]", "")
    return F.concat(F.coalesce(F.nullif(family, F.lit("")), F.lit("anon")), F.coalesce(year, F.lit("")))


def reference(authors: Column, year: Column, title: Column, venue: Column, doi: Column, arxiv: Column) -> Column:
    """Authors (of more than six, three and et al.), year, title, venue and a link."""
    who = F.when(F.size(authors) > 6, F.concat(F.array_join(F.slice(authors, 1, 3), ", "), F.lit(" et al."))).otherwise(F.array_join(authors, ", "))
    some = lambda c: F.nullif(c, F.lit(""))
    tail = F.coalesce(F.concat(F.lit("https://doi.org/"), some(doi)), F.concat(F.lit("arXiv:"), some(arxiv)))
    return F.concat_ws(" ", some(who), F.concat(F.lit("("), some(year), F.lit(")")), F.concat(title, F.lit(".")), F.concat(some(venue), F.lit(".")), tail)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two texts; built-ins have no such measure."""
    import difflib

    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def title_match(pairs: DataFrame, threshold: float = 0.95) -> DataFrame:
    """``pairs`` (query, result) with matched: equal, a prefix of 15 characters or more, or a high ratio.

    The ratio runs only where the cheap rules leave it open and the lengths allow it: it is twice the matching characters
    over all of them, and no more than the shorter text can match.
    """
    a, b = H.normalised_title(F.col("query")), H.normalised_title(F.col("result"))
    rows = pairs.withColumns({"a": a, "b": b})
    short, long = F.when(F.length("a") <= F.length("b"), F.col("a")).otherwise(F.col("b")), F.when(F.length("a") <= F.length("b"), F.col("b")).otherwise(F.col("a"))
    some = (F.col("a") != "") & (F.col("b") != "")
    plain = some & ((F.col("a") == F.col("b")) | ((F.length(short) >= SPECIFIC) & F.startswith(long, short)))
    rows = rows.withColumn("plain", plain).withColumn("open", some & ~plain & (2 * F.length(short) >= threshold * (F.length("a") + F.length("b"))))
    ratio = sequence_ratio(F.when(F.col("open"), F.col("a")), F.when(F.col("open"), F.col("b")))
    return rows.withColumn("ratio", ratio).withColumn("matched", F.col("plain") | F.coalesce(F.col("ratio") >= threshold, F.lit(False))).drop("a", "b", "plain", "open", "ratio")


def _edits(n: Column, threshold: float) -> Column:
    """Most characters to insert or delete between a title of ``n`` characters and any that reaches ``threshold``: at most
    (1 - threshold) * (a + b), where the longer title has at most (2 - threshold) / threshold times the characters of the shorter."""
    return F.floor((1 - threshold) * (1 + (2 - threshold) / threshold) * n + 1e-9).cast("int")


def _grams(titles: DataFrame, threshold: float) -> DataFrame:
    """id, most, gram: parts of titles (id, t) as hashes of length, text and number of the occurrence, and how many of them a near title must meet.

    A pair meets by parts of the greatest length that its shorter title allows: edits spoil that many parts each at most, and one part is
    left. So a title is cut by its own length and by those of all shorter titles that it may be near to.
    """
    n = F.length("t")
    least = F.greatest(F.lit(1), F.ceil(n * (threshold / (2 - threshold)) - 1e-9).cast("int"))
    lengths = F.array_distinct(F.transform(F.sequence(least, n), lambda m: F.floor(m / (_edits(m, threshold) + 1)).cast("int")))
    rows = titles.select("id", "t", F.explode(lengths).alias("g"))
    parts = F.transform(F.sequence(F.lit(1), n - F.col("g") + 1), lambda i: F.substring(F.col("t"), i, F.col("g")))
    rows = rows.select("id", "g", (F.col("g") * _edits(n, threshold) + 1).alias("most"), parts.alias("parts"))
    number = F.transform("parts", lambda p, i: F.xxhash64("g", p, F.size(F.filter(F.slice("parts", 1, i), lambda x: x == p))))
    return rows.select("id", "g", "most", F.explode(number).alias("gram"))


def _rare_grams(grams: DataFrame, common: DataFrame) -> DataFrame:
    """id, gram for the rarest grams of each title and length, as many as any near title must meet."""
    rank = F.row_number().over(Window.partitionBy("id", "g").orderBy("n", "gram"))
    return grams.join(common.hint("merge"), "gram").withColumn("r", rank).where(F.col("r") <= F.col("most")).select("id", "gram")


def near_titles(queries: DataFrame, records: DataFrame, threshold: float = 0.95) -> DataFrame:
    """query_id, record_id, ratio (1 for equal titles, null for extended ones) of all pairs that ``title_match`` accepts.

    queries: query_id, title; records: record_id, title; ids are unique. Three joins find the pairs, none of them over all: equal titles, titles
    that extend another one (by its length and hash), and titles that share one of their rarest parts, whose ratio decides.
    Titles without letters or digits match nothing. Below LEAST_RATIO a short title may share no part with a near one, so
    no lower ``threshold`` is taken.
    """
    if threshold < LEAST_RATIO:
        raise ValueError(f"a threshold below {LEAST_RATIO} would lose pairs")
    side = lambda df, name: df.select(F.col(f"{name}_id").alias("id"), H.normalised_title(F.col("title")).alias("t")).where("t <> ''")
    q, r = side(queries, "query"), side(records, "record")
    pair = lambda c: (F.col("q.id").alias("query_id"), F.col("r.id").alias("record_id"), c.cast("double").alias("ratio"))
    equal = q.alias("q").join(r.alias("r").hint("merge"), "t").select(*pair(F.lit(1)))

    def begins(df: DataFrame) -> DataFrame:
        """A row for each beginning of SPECIFIC characters or more that is not the title itself."""
        n = F.explode(F.when(F.length("t") > SPECIFIC, F.sequence(F.lit(SPECIFIC), F.length("t") - 1)).otherwise(F.array().cast("array<int>")))
        return df.select("id", "t", n.alias("n")).withColumn("h", F.xxhash64(F.substring(F.col("t"), F.lit(1), F.col("n"))))

    whole = lambda df: df.where(F.length("t") >= SPECIFIC).withColumns({"n": F.length("t"), "h": F.xxhash64("t")})
    extends = [
        a.alias("q").join(b.alias("r").hint("merge"), ["n", "h"]).where(F.startswith(F.col(f"{long}.t"), F.col(f"{short}.t"))).select(*pair(F.lit(None)))
        for a, b, short, long in ((whole(q), begins(r), "q", "r"), (begins(q), whole(r), "r", "q"))
    ]
    a, b = _grams(q, threshold), _grams(r, threshold)
    common = a.unionByName(b).groupBy("gram").agg(F.count("*").alias("n"))
    a, b = _rare_grams(a, common), _rare_grams(b, common)
    ids = a.alias("q").join(b.alias("r").hint("merge"), "gram").select(F.col("q.id").alias("_q"), F.col("r.id").alias("_r")).distinct()
    met = ids.join(q.alias("q").hint("merge"), F.col("_q") == F.col("q.id")).join(r.alias("r").hint("merge"), F.col("_r") == F.col("r.id")).where(F.col("q.t") != F.col("r.t"))
    la, lb = F.length("q.t"), F.length("r.t")
    met = met.where(2 * F.least(la, lb) >= threshold * (la + lb)).where(~(F.least(la, lb) >= SPECIFIC) | ~(F.startswith(F.col("q.t"), F.col("r.t")) | F.startswith(F.col("r.t"), F.col("q.t"))))
    met = met.select(F.col("q.id").alias("query_id"), F.col("r.id").alias("record_id"), F.col("q.t").alias("a"), F.col("r.t").alias("b"))
    near = met.withColumn("ratio", sequence_ratio("a", "b")).where(F.col("ratio") >= threshold).select("query_id", "record_id", "ratio")
    return equal.unionByName(extends[0]).unionByName(extends[1]).unionByName(near)


def resolve_titles(queries: DataFrame, records: DataFrame, threshold: float = 0.95) -> DataFrame:
    """query_id, record_id, resolved: the best of ``near_titles`` for each query. Equal titles come first, then extended ones, then
    the highest ratio, then the smallest record_id; queries without one have a null record_id."""
    order = F.struct(F.when(F.col("ratio") == 1, 0).when(F.col("ratio").isNull(), 1).otherwise(2), -F.coalesce("ratio", F.lit(0.0)), "record_id")
    best = near_titles(queries, records, threshold).groupBy("query_id").agg(F.min_by("record_id", order).alias("record_id"))
    return queries.select("query_id").join(best.hint("merge"), "query_id", "left").withColumn("resolved", F.col("record_id").isNotNull())


def resolve(queries: DataFrame, records: DataFrame) -> DataFrame:
    """query, kind, value, record_id, resolved: by arXiv id, DOI, or normalised title, from ``records``."""
    q = queries.select("query", classified(F.col("query")).alias("c")).select("query", "c.kind", "c.value")
    key = F.when(F.col("kind") == "title", H.normalised_title(F.col("value"))).otherwise(F.lower("value"))
    keys = F.array_compact(F.array(*(F.when(v.isNotNull(), F.struct(F.lit(k).alias("kind"), v.alias("key"))) for k, v in (("arxiv", F.lower("arxiv")), ("doi", F.lower("doi")), ("title", F.nullif(H.normalised_title(F.col("title")), F.lit("")))))))
    r = records.select("record_id", F.explode(keys).alias("k")).select("k.kind", "k.key", "record_id").groupBy("kind", "key").agg(F.min("record_id").alias("record_id"))
    return q.withColumn("key", key).join(r, ["kind", "key"], "left").select("query", "kind", "value", "record_id", F.col("record_id").isNotNull().alias("resolved"))


def resolved_counts(resolved: DataFrame) -> DataFrame:
    """kind, queries, resolved of the rows of ``resolve``."""
    return resolved.groupBy("kind").agg(F.count("*").alias("queries"), F.count_if("resolved").alias("resolved"))


def crossref_entry(message: Column) -> Column:
    """struct<title, authors, year, venue, doi, type> of a work message (JSON text); null for bad JSON."""
    schema = "title ARRAY<STRING>, author ARRAY<STRUCT<given: STRING, family: STRING>>, `container-title` ARRAY<STRING>, DOI STRING, type STRING, " + ", ".join(f"`{k}` STRUCT<`date-parts`: ARRAY<ARRAY<INT>>>" for k in YEAR_FIELDS)
    m = F.from_json(message, schema)
    first = lambda c: F.get(c, 0)
    year = F.coalesce(*(F.nullif(first(first(m[k]["date-parts"])), F.lit(0)) for k in YEAR_FIELDS))
    authors = F.transform(F.coalesce(m["author"], F.array().cast("array<struct<given:string,family:string>>")), lambda a: F.concat_ws(" ", F.nullif(a["given"], F.lit("")), F.nullif(a["family"], F.lit(""))))
    kind = F.when(F.startswith(F.coalesce(m["type"], F.lit("")), F.lit("proceedings")), "inproceedings").otherwise("article")
    entry = F.struct(F.coalesce(first(m["title"]), F.lit("(untitled)")).alias("title"), authors.alias("authors"), year.cast("string").alias("year"), first(m["container-title"]).alias("venue"), m["DOI"].alias("doi"), kind.alias("type"))
    return F.when(F.try_parse_json(message).isNotNull(), entry)


#: Fixed value: the namespace of the fields that arXiv adds to a feed.
ARXIV_NS = "{http://arxiv.org/schemas/atom}"


def _feed_entry(xml: str | None) -> tuple | None:
    """A feed is parsed once, for all of its fields; built-ins would parse it again for each path."""
    import xml.etree.ElementTree as ET

    if not xml:
        return None
    root = ET.fromstring(xml)
    atom, name = root.tag[:-4], root.tag[-4:]
    entry = root.find(f"{atom}entry") if name == "feed" and atom[-1:] in ("", "}") else None
    if entry is None:
        return None
    said = lambda e: " ".join(("".join(e.itertext()) if len(e) else e.text or "").split())
    first = {e.tag: said(e) for e in reversed(entry)}
    names = [said(n) for e in entry if e.tag == f"{atom}author" for n in e if n.tag == f"{atom}name"]
    _, abstract, arxiv = first.get(f"{atom}id", "").partition("/abs/")
    venue, doi = (first.get(ARXIV_NS + k) for k in ("journal_ref", "doi"))
    return first.get(f"{atom}title", ""), names, first.get(f"{atom}published", "")[:4] or None, venue or "arXiv preprint", doi or None, abstract and arxiv.split("v")[0] or None


def atom_entry(xml: Column) -> Column:
    """struct<title, authors, year, venue, doi, arxiv> of a feed's first entry; null without one. Texts must be well-formed XML."""
    fields = "struct<title:string, authors:array<string>, year:string, venue:string, doi:string, arxiv:string>"
    # Marked as not deterministic so that a filter on the result is no reason to parse each feed a second time.
    return F.udf(_feed_entry, fields, useArrow=True).asNondeterministic()(xml)
