"""Operator 3: packing into optimal length buckets.

The global histogram of document lengths (in words, rounded up to a multiple of ``pad_to``) goes to the
driver; it has one row per distinct length, so it is bounded by the longest text and not by the number
of documents. A dynamic program over it picks the bucket bounds with the least padding. Inside each
bucket, documents in the order of doc_id fill batches of at most ``budget`` tokens, each document padded
to the bucket's bound; a bucket whose bound exceeds the budget holds one document a batch.

The numbering needs no task that holds a whole bucket: rows are dealt out by ranges of (bucket,
doc_id), each range counts its rows per bucket, the counts (ranges x buckets) are summed up before
each range, and every range numbers its own rows from there.

Null and empty texts have no words and form the bucket of length 0 without padding, as one batch per
``budget`` documents. Ties of doc_id are ordered by the text's hash; equal rows are interchangeable. Rows
with a null doc_id come first. Columns of the input with clashing names are ignored by the query.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioguard.llm.common import nvl_text, raw_words, read_table, stored

BUCKETS = 16
BUDGET = 65_536
PAD_TO = 8


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` ranges of ``lengths`` (ascending, distinct) with the least total padding.

    Divide and conquer over the monotone split points: O(buckets * m * log m) for m lengths.
    """
    m = len(lengths)
    if m == 0:
        return []
    lengths, n = lengths.astype(np.float64), np.concatenate(([0.0], np.cumsum(counts, dtype=np.float64)))
    best = lengths * n[1:]  # one bucket for lengths 0..j; the sum of true lengths is constant
    back = []
    for _ in range(1, min(buckets, m)):
        new, cut = best.copy(), np.full(m, -1)
        jobs = [(0, m - 1, 0, m - 1)]
        while jobs:
            lo, hi, a, b = jobs.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)  # the previous bucket ends at i
            if len(i):
                cost = best[i] + lengths[j] * (n[j + 1] - n[i + 1])
                k = int(np.argmin(cost))
                if cost[k] < new[j]:
                    new[j], cut[j] = cost[k], i[k]
                k = int(i[k])
            else:
                k = a
            jobs += [(lo, j - 1, a, k), (j + 1, hi, k, b)]
        back.append(cut)
        best = new
    bounds, j = [], m - 1
    for cut in reversed(back):
        bounds.append(int(lengths[j]))
        if cut[j] < 0:
            # Fewer buckets were as good: the earlier rounds decide for the same j.
            bounds.pop()
            continue
        j = int(cut[j])
    bounds.append(int(lengths[j]))
    return sorted(set(bounds))


def with_lengths(docs: DataFrame, pad_to: int = PAD_TO) -> DataFrame:
    """``docs`` with n_tokens (words) and padded (n_tokens rounded up)."""
    n = F.size(raw_words(nvl_text("text"))).cast("long")
    return docs.withColumn("n_tokens", n).withColumn("padded", F.ceil(F.col("n_tokens") / pad_to) * pad_to)


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, pad_to: int = PAD_TO) -> DataFrame:
    """doc_id, n_tokens, bucket_length, batch (number inside the bucket), slot (place in the batch), batch_docs."""
    rows = docs.select("doc_id", F.xxhash64(nvl_text("text")).alias("tie"), "text")
    rows = stored(with_lengths(rows, pad_to).select("doc_id", "tie", "n_tokens", "padded"), "lengths")
    histogram = rows.groupBy("padded").count().orderBy("padded").toArrow()
    lengths = histogram.column("padded").to_numpy()
    some = lengths > 0
    bounds = ([0] if len(lengths) and lengths[0] == 0 else []) + optimal_bounds(lengths[some], histogram.column("count").to_numpy()[some], buckets)
    bound = F.coalesce(*(F.when(F.col("padded") <= b, F.lit(b)) for b in bounds)) if bounds else F.lit(None)
    rows = rows.withColumn("bucket_length", bound.cast("long"))
    # Numbered by range; written so that the ranges stay what they are when counted and when numbered.
    ranged = stored(rows.repartitionByRange("bucket_length", "doc_id", "tie").withColumn("range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("bucket_length", "range").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("bucket_length").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    whole = F.sum("rows").over(Window.partitionBy("bucket_length"))
    counts = counts.select("bucket_length", "range", F.coalesce(before, F.lit(0)).alias("before"), whole.alias("whole"))
    own = F.row_number().over(Window.partitionBy("bucket_length", "range").orderBy("doc_id", "tie"))
    place = F.col("before") + F.col("own") - 1
    numbered = ranged.withColumn("own", own).join(counts, ["bucket_length", "range"])
    size = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("bucket_length"))))
    batch = F.floor(place / size)
    return numbered.select(
        "doc_id", "n_tokens", "bucket_length", batch.alias("batch"), (place - batch * size).alias("slot"), F.least(size, F.col("whole") - batch * size).alias("batch_docs")
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
