"""Operator 8 [native]: benchmark decontamination with a distributed positional inverted index.

Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z. A window is
``length`` consecutive words of an item; an item of fewer words, but not none, is one window.

1. The index holds a posting (term, document, position) for every word of every document. It is sharded by
   document: bucketed by its key, and sorted by term inside a bucket, so a term's list in a shard is one run.
   Texts are split into words once, to build it. It knows nothing of the benchmark and serves any other.
2. Frequencies of the test terms come from the index. Each window's terms are ranked, rarest first.
3. Offset-adjusted lists are intersected from the rarest term on: a posting of a window's rarest term gives a
   base, position minus offset, which survives if the lists of the other terms hold it at their own offsets. The
   lists of the ``anchors`` rarest terms are intersected over the whole index, the remaining ones in the
   cells of documents that are left, so lists of common words are only read there, and only their postings there are exchanged.
4. Proximity matches come from the same lists, rarest term first: ``near_windows`` finds the documents where a window's words
   stand close together in any order, ``proximity_matches`` the tightest spans of any words asked for.

Common words are never anchors unless a window has no others. Windows with equal words are looked up
once. Postings follow the documents, windows the test set; no document is collected and no pairs of
documents are formed. Grouping by document needs no exchange of postings, as shards hold whole documents.
A posting has the term's hash, by which lists are sorted and joined, and the word itself, which decides.

Null texts and texts without words have no words, so they are never hit; rows that repeat a doc_id are told
apart by a hash of their text, repetitions of one row get the same result. Columns with clashing names are ignored.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioguard.llm.common import BROADCAST_ROWS, BucketedTable, ascii_lower, nvl_text, raw_words, read_table, scratch, small_enough, stored, words

LENGTH = 10
ANCHORS = 2
#: Words that the words of a window may spread over, in any order, to be a proximity match of the query.
WITHIN = 20
#: Offsets of a window are bits of a long.
LONGEST = 62


def item_windows(items: DataFrame, length: int = LENGTH) -> DataFrame:
    """window and words, for each window of each item, with its item_id."""
    w = items.select("item_id", words(nvl_text("text")).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("at", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - length + 1))))
    w = w.select("item_id", F.slice("w", F.col("at"), F.lit(length)).alias("words"))
    return w.select("item_id", F.sha2(F.concat_ws(" ", "words"), 256).alias("window"), "words")


def document_keys(docs: DataFrame) -> DataFrame:
    """``docs`` with id (doc_id, 0 if null) and key (hash of the text; odd if doc_id is null), neither of them null."""
    key = F.xxhash64(nvl_text("text")).bitwiseAND(F.lit(-2)).bitwiseOR(F.col("doc_id").isNull().cast("long"))
    return docs.withColumns({"id": F.coalesce("doc_id", F.lit(0)).cast("long"), "key": key})


def _doc_id() -> Column:
    return F.when(F.col("key").bitwiseAND(F.lit(1)) == 0, F.col("id")).alias("doc_id")


class PositionalIndex(BucketedTable):
    """Postings ``term long, word string, id long, key long, pos int`` (from 0), sharded by document, sorted by term."""

    SCHEMA = T.StructType(
        [T.StructField("term", T.LongType()), T.StructField("word", T.StringType()), T.StructField("id", T.LongType()), T.StructField("key", T.LongType()), T.StructField("pos", T.IntegerType())]
    )
    BY, SORT = ("id", "key"), ("term",)
    CODEC = "zstd"

    def append(self, docs: DataFrame) -> None:
        """Add the postings of ``docs`` (doc_id, text). Documents that the index holds are not to be given again."""
        rows = document_keys(docs.select("doc_id", "text")).select("id", "key", F.col("text")).where("text IS NOT NULL").repartition(self.buckets, *self.BY)
        # Lower-cased word by word, as only the words that are not ASCII need the slow way.
        posts = rows.select("id", "key", F.posexplode(raw_words(F.col("text"))).alias("pos", "raw")).withColumn("word", ascii_lower(F.col("raw")))
        self._write(posts.withColumn("term", F.xxhash64("word")), self.name, "append")

    def counts(self, terms: DataFrame) -> DataFrame:
        """How often each of ``terms`` (word) occurs; 0 if never.

        Few terms are broadcast to the postings. With many, postings are counted before they meet the terms, so that a common
        word is a count per task by then, not a key with all of its postings.
        """
        asked, posts = terms.select(F.xxhash64("word").alias("term")).distinct(), self.read().select("term")
        if _few(asked, BROADCAST_ROWS):
            posts = posts.join(F.broadcast(asked), "term")
        found = posts.groupBy("term").count()
        return terms.join(found, F.xxhash64("word") == F.col("term"), "left").select("word", F.coalesce("count", F.lit(0)).alias("n"))

    def lengths(self) -> DataFrame:
        """id, key and n_words of the documents that have words."""
        return self.read().groupBy("id", "key").agg((F.max("pos") + 1).cast("long").alias("n_words"))


def ranked_terms(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """window, rank (0: rarest distinct term), word and one offset of it."""
    each = windows.select("window", F.posexplode("words").alias("offset", "word")).groupBy("window", "word").agg(F.min("offset").alias("offset"))
    ranked = each.join(counts, "word").groupBy("window").agg(F.array_sort(F.collect_list(F.struct("n", "word", "offset"))).alias("a"))
    return ranked.select("window", F.posexplode("a").alias("rank", "x")).select("window", "rank", "x.word", "x.offset", F.xxhash64("x.word").alias("term"))


def phrase_matches(index: PositionalIndex, windows: DataFrame, ranked: DataFrame, anchors: int = ANCHORS, length: int = LENGTH) -> DataFrame:
    """id, key, window, base, k: every place where all words of a window (window, words; at most ``length``) stand in a row."""
    lists = ranked.where(F.col("rank") < anchors)
    needed = lists.groupBy("window").agg(F.count("*").alias("needed"))
    lists = small_enough(lists.join(needed, "window"))
    met = index.read().join(lists, ["term", "word"]).withColumn("base", F.col("pos") - F.col("offset")).where("base >= 0")
    slots = F.bit_or(F.expr("shiftleft(1L, rank)"))
    bases = met.groupBy("id", "key", "window", "base").agg(F.max("needed").alias("needed"), slots.alias("slots")).where("bit_count(slots) = needed")
    bases = stored(bases.select("id", "key", "window", "base", F.floor(F.col("base") / length).cast("int").alias("cell")), "bases")
    # The other lists, in the cells that are left.
    posts = postings_in_cells(index, ranked, bases, length)
    places = windows.select("window", F.size("words").alias("k"), F.posexplode("words").alias("offset", "word"))
    both = bases.join(posts, ["id", "key", "cell"]).withColumn("offset", F.col("pos") - F.col("base")).where(F.col("offset").between(0, length - 1))
    both = both.join(small_enough(places), ["window", "offset", "word"])
    whole = both.groupBy("id", "key", "window", "base", "k").agg(F.bit_or(F.expr("shiftleft(1L, offset)")).alias("seen"))
    return whole.where("bit_count(seen) = k").select("id", "key", "window", "base", "k")


def postings_in_cells(index: PositionalIndex, ranked: DataFrame, found: DataFrame, size: int) -> DataFrame:
    """id, key, cell, pos, word: postings of the ``ranked`` terms in the cells of ``found`` (id, key, cell).

    A cell begins at each multiple of ``size`` and is twice as long. Cells go to the shards of their documents, however many they
    are, and postings stay where they lie: the setting lets a join by document and cell do with the sharding by document.
    """
    cells = found.select("id", "key", "cell").distinct()
    near = lambda df: small_enough(df) if _few(df) else df.hint("shuffle_hash")
    posts = index.read().join(small_enough(ranked.select("term", "word").distinct()), ["term", "word"], "left_semi").join(near(cells.select("id", "key").distinct()), ["id", "key"], "left_semi")
    place = F.floor(F.col("pos") / size).cast("int")
    posts = posts.select("id", "key", "pos", "word", F.explode(F.array(place, place - 1)).alias("cell")).join(near(cells), ["id", "key", "cell"], "left_semi")
    return stored(posts, "places", **{"spark.sql.requireAllClusterKeysForCoPartition": "false"})


def _few(df: DataFrame, rows: int = 20_000) -> bool:
    return df.limit(rows + 1).count() <= rows


def near_windows(index: PositionalIndex, ranked: DataFrame, within: int = WITHIN, anchors: int = ANCHORS) -> DataFrame:
    """id, key, window: the words of a window all stand, in any order, within ``within`` words of a document.

    A cell is twice as long and one begins at each multiple of ``within``, so such a span lies in the cell where it
    begins. The lists of the ``anchors`` rarest terms are intersected by cell over the whole index; the other terms are
    read in the cells that are left. What is gathered of a cell is at most its own places, which are then tried as beginnings.
    """
    place = F.floor(F.col("pos") / within).cast("int")
    in_cells = lambda df: df.withColumn("cell", F.explode(F.array(place, place - 1))).where("cell >= 0")
    k = ranked.groupBy("window").agg(F.count("*").cast("int").alias("k"))
    lists = small_enough(ranked.where(F.col("rank") < anchors).join(k, "window").withColumn("needed", F.least(F.col("k"), F.lit(anchors))).select("window", "term", "word", "rank", "needed"))
    met = in_cells(index.read().join(lists, ["term", "word"])).groupBy("id", "key", "window", "cell").agg(F.bit_or(F.expr("shiftleft(1L, rank)")).alias("slots"), F.max("needed").alias("needed"))
    met = stored(met.where("bit_count(slots) = needed").select("id", "key", "window", "cell"), "cells")
    posts = postings_in_cells(index, ranked, met, within)
    both = met.join(posts, ["id", "key", "cell"]).join(small_enough(ranked.join(k, "window").select("window", "word", "rank", "k")), ["window", "word"])
    held = both.groupBy("id", "key", "window", "cell").agg(F.max("k").alias("k"), F.bit_or(F.expr("shiftleft(1L, rank)")).alias("slots"), F.collect_list(F.struct("pos", "rank")).alias("p")).where("bit_count(slots) = k")
    reached = lambda x: F.size(F.array_distinct(F.transform(F.filter("p", lambda y: (y["pos"] >= x["pos"]) & (y["pos"] < x["pos"] + within)), lambda y: y["rank"])))
    return held.where(F.exists("p", lambda x: reached(x) == F.col("k"))).select("id", "key", "window").distinct()


def proximity_matches(index: PositionalIndex, asked: DataFrame, within: int) -> DataFrame:
    """query_id, doc_id, key, first, last: the tightest spans, of at most ``within`` words, that hold every one of a query's words.

    ``asked`` has query_id and words (in any order; at most LONGEST distinct ones). Only documents on the list of a
    query's rarest word are looked at. For each posting of a word, the last earlier or equal place of every other
    one is carried along the document, so a document's postings need one ordered pass, in its own shard.
    """
    terms = asked.select("query_id", F.explode(F.array_distinct("words")).alias("word")).where("word IS NOT NULL")
    ranked = terms.join(index.counts(terms.select("word").distinct()), "word").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("a"))
    ranked = stored(ranked.select("query_id", F.size("a").alias("k"), F.posexplode("a").alias("rank", "x")).select("query_id", "k", "rank", "x.word", F.xxhash64("x.word").alias("term")), "ranked")
    most = ranked.agg(F.coalesce(F.max("k"), F.lit(0))).first()[0]
    if most > LONGEST:
        raise ValueError(f"a query has {most} words, more than {LONGEST}")
    rarest = index.read().join(small_enough(ranked.where("rank = 0").select("query_id", "term", "word")), ["term", "word"]).select("query_id", "id", "key").distinct()
    posts = index.read().join(small_enough(ranked.where("rank IS NOT NULL")), ["term", "word"]).join(stored(rarest, "rarest"), ["query_id", "id", "key"], "left_semi")
    w = Window.partitionBy("id", "key", "query_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    seen = [F.last(F.when(F.col("rank") == r, F.col("pos")), ignorenulls=True).over(w) for r in range(most)] or [F.col("pos")]
    spans = posts.select("query_id", "id", "key", "k", F.col("pos").alias("last"), F.array(*seen).alias("s")).withColumn("s", F.slice("s", F.lit(1), F.col("k")))
    spans = spans.where(F.forall("s", lambda p: p.isNotNull())).withColumn("first", F.array_min("s")).where(F.col("last") - F.col("first") < within)
    spans = spans.groupBy("query_id", "id", "key", "first").agg(F.min("last").alias("last"))
    return spans.select("query_id", _doc_id(), "key", "first", "last")


def decontaminate(docs: DataFrame, items: DataFrame, length: int = LENGTH, anchors: int = ANCHORS, within: int | None = None) -> DataFrame:
    """One row per row of ``docs``: n_words, n_hit, n_items, items_sha256, contaminated; n_near if ``within`` is given."""
    return decontaminated_rows(docs, items, length, anchors, within=within).drop("tid")


def decontaminated_rows(docs: DataFrame, items: DataFrame, length: int = LENGTH, anchors: int = ANCHORS, name: str = "folioguard_postings", within: int | None = None) -> DataFrame:
    """``decontaminate`` with tid, the hash of the text, over an index made for the run."""
    index = PositionalIndex(docs.sparkSession, name, scratch(docs.sparkSession, "index"))
    index.append(docs)
    return contamination(docs, items, index, length, anchors, within)


def contamination(docs: DataFrame, items: DataFrame, index: PositionalIndex, length: int = LENGTH, anchors: int = ANCHORS, within: int | None = None) -> DataFrame:
    """``decontaminate`` with tid, out of an ``index`` that has been given ``docs``.

    With ``within``, n_near is added: the items of which a window's words all stand within so many words, in any order. Where
    ``within`` is not less than ``length``, these include all items that n_items counts.
    """
    if length > LONGEST or anchors > LONGEST:
        raise ValueError(f"windows of more than {LONGEST} words are not supported")
    each = stored(item_windows(items, length), "windows")
    windows = stored(each.select("window", "words").distinct(), "windows")
    ranked = stored(ranked_terms(windows, index.counts(windows.select(F.explode("words").alias("word")).distinct())), "terms")
    found = stored(phrase_matches(index, windows, ranked, anchors, length), "found")
    # Runs of hit words: bases are bounded by the document's own length.
    hits = found.groupBy("id", "key").agg(F.array_sort(F.collect_set(F.struct("base", "k"))).alias("hits"))
    state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    union = F.aggregate(
        "hits",
        state,
        lambda s, h: F.struct((s["n"] + F.greatest(F.lit(0), h["base"] + h["k"] - F.greatest(s["end"], h["base"]))).alias("n"), F.greatest(s["end"], h["base"] + h["k"]).alias("end")),
    )
    of = found.select("id", "key", "window").distinct().join(small_enough(each.select("window", F.col("item_id").cast("string").alias("item")).distinct()), "window")
    ids = of.groupBy("id", "key").agg(F.array_sort(F.collect_set("item")).alias("ids"))
    per_doc = hits.join(ids, ["id", "key"]).select("id", "key", union["n"].cast("long").alias("n_hit"), F.size("ids").cast("long").alias("n_items"), F.array_join("ids", ",").alias("ids"))
    rows = document_keys(docs.select("doc_id", "text")).select("doc_id", F.xxhash64(nvl_text("text")).alias("tid"), "id", "key")
    out = rows.join(index.lengths(), ["id", "key"], "left").join(per_doc, ["id", "key"], "left")
    n, zero = F.coalesce("n_hit", F.lit(0)), F.lit(0).cast("long")
    more = []
    if within is not None:
        near = near_windows(index, ranked, within, anchors).join(small_enough(each.select("window", F.col("item_id").cast("string").alias("item")).distinct()), "window")
        out = out.join(near.groupBy("id", "key").agg(F.count_distinct("item").alias("n_near")), ["id", "key"], "left")
        more = [F.coalesce("n_near", zero).alias("n_near")]
    return out.select(
        "doc_id", "tid", F.coalesce("n_words", zero).alias("n_words"), n.alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"),
        (n > 0).alias("contaminated"), *more,
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return decontaminated_rows(docs, read_table(spark, sf_dir, "benchmark"), name=f"op8_postings_{zlib.crc32(sf_dir.encode()):08x}", within=WITHIN).drop("tid")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP8_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 10) AS k, array_to_string(w[i:i+9], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, i, k, array_to_string(w[i:i+k-1], ' ') AS s
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw USING (s, k)),
h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY doc_id),
f AS (SELECT v, count(*) AS n FROM (SELECT unnest(w) AS v FROM d) GROUP BY v),
iw AS (SELECT s, string_split(s, ' ') AS ws FROM (SELECT DISTINCT s FROM bw)),
iv AS (SELECT s, any_value(ws) AS ws, arg_min(v, coalesce(n, 0)) AS v FROM (SELECT s, ws, unnest(ws) AS v FROM iw) LEFT JOIN f USING (v) GROUP BY s),
dp AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS v FROM d),
c AS (SELECT doc_id, s, ws, unnest(range(greatest(1, p - 19), p + 1)) AS a FROM dp JOIN iv USING (v)),
r AS (SELECT DISTINCT doc_id, s FROM c JOIN d USING (doc_id) WHERE list_has_all(w[a:a+19], ws)),
nn AS (SELECT doc_id, count(DISTINCT item_id) AS n FROM r JOIN bw USING (s) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated, coalesce(nn.n, 0) AS n_near
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN nn USING (doc_id)
"""
