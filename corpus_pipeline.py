"""The corpus pipeline: five stages, applied one after the other to ``documents``.

Each stage takes the documents that its predecessor kept and returns those that it keeps, with the
columns of ``documents``; the last one returns the packing. The driver of a run writes each stage's
result as Parquet and reads it again, so no stage repeats another's work and a lost executor costs one
stage at most.

A stage decides about rows, not ids: rows are told apart by doc_id (null equals null) and text. Rows that
agree in both are repetitions, of which the stages that pick one of a group leave one. A null text counts as
empty: it is scored like other texts, equals the empty text, has no words, no links and no benchmark
passage, and is packed without tokens. Rows with neither doc_id nor text hold nothing to compare or to
tell them apart by; the three stages after the classifier pass them on. Ties go to the smallest doc_id (null last),
then the smallest hash of the text. Tables without rows give no rows. Columns beside those of ``documents`` are dropped.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioguard.llm.common import nvl_text, read_table, scratch, stored
from folioguard.llm.decontamination import decontaminated_rows
from folioguard.llm.exact_dedup import DigestIndex, deduplicated_rows
from folioguard.llm.packing import pack
from folioguard.llm.quality import THRESHOLD, fit, score_quality
from folioguard.llm.set_join import jaccard_rows

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keep(docs: DataFrame, kept: DataFrame, once: bool = True) -> DataFrame:
    """The rows of ``docs`` that ``kept`` names by doc_id and tid, the hash of the text; repetitions ``once``, or as often as they are.

    Which rows are repeated is found among the names, so texts meet a second shuffle only where they are.
    """
    bare = F.col("doc_id").isNull() & F.col("text").isNull()
    named = kept.groupBy("doc_id", "tid").agg(F.count("*").alias("_rows")).withColumnsRenamed({"doc_id": "_doc_id", "tid": "_tid"})
    named, docs = stored(named, "named"), docs.select(*COLUMNS)
    rows = docs.where(~bare)
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.xxhash64(nvl_text("text")) == F.col("_tid"))
    again = named.where("_rows > 1")
    if not once or again.isEmpty():
        return rows.join(named, same, "left_semi").unionByName(docs.where(bare))
    one = rows.join(again, same).groupBy("_doc_id", "_tid").agg(F.min(F.struct(*COLUMNS)).alias("r")).select("r.*")
    return rows.join(named.where("_rows = 1"), same, "left_semi").unionByName(one).unionByName(docs.where(bare))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; the model is fitted on this stage's input."""
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    return score_quality(docs, model, COLUMNS).where(F.col("score") >= THRESHOLD).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    index = DigestIndex(spark, f"pipeline_digests_{zlib.crc32(sf_dir.encode()):08x}", scratch(spark, "index"))
    return _keep(docs, deduplicated_rows(docs, index).where("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect, one stays: that with the smallest doc_id."""
    return _keep(docs, jaccard_rows(docs).where("kept"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a word inside a benchmark window go."""
    return _keep(docs, decontaminated_rows(docs, read_table(spark, sf_dir, "benchmark")).where("not contaminated"), once=False)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packing of what is left."""
    return pack(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("n-gram jaccard join", near), ("benchmark decontamination", benchmark), ("packing", packing)]
#: The classifier and the packing cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k}")
    return docs
