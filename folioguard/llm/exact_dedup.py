"""Operator 9 [native]: exact deduplication against a persistent digest index.

The index is a table bucketed by digest, with as many buckets as the session has shuffle partitions when
it is made. New data is first reduced to one row per digest (partial aggregation runs before the shuffle,
so a text that fills a third of the table costs one row per task), then a sort-merge anti-join against
the index finds the digests that are new, and these are appended. The aggregate's exchange is the only
one: the join and the bucketed write take its partitions as they are, and the index is read by bucket. Files
are sorted by digest, but Spark does not rely on it and sorts the index side of a join again. ``compact`` leaves
one file per bucket.

Texts are equal when they are identical after deleting space, tab, line feed, vertical tab, form
feed and carriage return. Null counts as the empty text. Within equal texts, the row with the most
code points in the original text, then the smallest doc_id, stays (a null doc_id comes last), then that
with the smallest hash of its text; exact repetitions of that very row stay together, as nothing tells
them apart. Columns of the input with clashing names are ignored.

Entries are never changed. A text that an earlier batch has brought belongs to the row of that batch, whatever
its own length, and group_size counts the rows of the batch that brought the text.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioguard.llm.common import BucketedTable, nvl_text, read_table, scratch, stored

#: A digest with more than 1 / HOT_SHARE of all rows is hot; fewer than HOT_SHARE digests can be.
HOT_SHARE = 512
SPACE = " \t\n\x0b\x0c\r"


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(F.translate(text, SPACE, ""), 256))


def digest_rows(docs: DataFrame) -> DataFrame:
    """doc_id, tid (hash of the text), digest and n (code points) of every row."""
    text = nvl_text("text")
    return docs.select("doc_id", F.xxhash64(text).alias("tid"), digest(text).alias("digest"), F.length(text).alias("n"))


class DigestIndex(BucketedTable):
    """A table ``digest binary, keep_id long, keep_tid long, n_chars int, group_size long`` bucketed by digest."""

    SCHEMA = T.StructType(
        [T.StructField("digest", T.BinaryType()), T.StructField("keep_id", T.LongType()), T.StructField("keep_tid", T.LongType()), T.StructField("n_chars", T.IntegerType()), T.StructField("group_size", T.LongType())]
    )
    BY = SORT = ("digest",)

    def unseen(self, rows: DataFrame) -> DataFrame:
        """Of ``digest_rows``, the best row of each digest that the index does not hold, and how many rows have it."""
        first = F.min(F.struct((-F.col("n")).alias("minus"), F.col("doc_id").isNull(), "doc_id", "tid")).alias("m")
        new = rows.groupBy("digest").agg(first, F.count("*").alias("group_size"))
        new = new.select("digest", F.col("m.doc_id").alias("keep_id"), F.col("m.tid").alias("keep_tid"), (-F.col("m.minus")).alias("n_chars"), "group_size")
        return new.join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, docs: DataFrame) -> None:
        """Add the digests of ``docs`` that are new. Running it again with the same rows adds nothing."""
        self.append_rows(digest_rows(docs))

    def append_rows(self, rows: DataFrame) -> None:
        self._write(self.unseen(rows), self.name, "append")


def exact_dedup(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Every row of ``docs`` with the row that stays of its group, out of an index that has been given ``docs``.

    A row whose text the index has never been given is an error, not a row less.
    """
    return exact_rows(digest_rows(docs), index).drop("tid")


def exact_rows(rows: DataFrame, index: DigestIndex) -> DataFrame:
    """``exact_dedup`` of ``digest_rows``, with tid.

    Hot groups are joined by broadcast: there can be fewer than HOT_SHARE of them, whatever the input.
    """
    entries = index.read().withColumnRenamed("n_chars", "keep_chars")
    total = entries.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    hot = F.col("group_size") * HOT_SHARE > total
    met = rows.join(F.broadcast(entries.where(hot)), "digest", "left")
    first, rest = met.where("group_size is not null"), met.where("group_size is null").select(*rows.columns)
    both = first.unionByName(rest.join(entries.where(~hot), "digest", "left"))
    size = F.coalesce("group_size", F.raise_error(F.lit("a text is not in the index; append the documents first")).cast("long"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_chars")) & (F.col("tid") == F.col("keep_tid"))
    return both.select("doc_id", "keep_id", size.alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "tid")


def deduplicated_rows(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Append ``docs`` to ``index`` and return ``exact_rows``; each text is read and hashed once."""
    rows = stored(digest_rows(docs), "digests")
    index.append_rows(rows)
    return exact_rows(rows, index)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new index for each run, as the query is about the whole table; its name is that of the table."""
    index = DigestIndex(spark, f"op9_digests_{zlib.crc32(sf_dir.encode()):08x}", scratch(spark, "index"))
    return deduplicated_rows(read_table(spark, sf_dir, "documents"), index).drop("tid")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY length(t) DESC, doc_id)
"""
