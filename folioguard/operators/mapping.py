"""Figures mapped to slides: captions and slide texts compared by weighted terms and topic, one slide for each figure at most."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioguard.operators.protocol import confidence_band, slide_topic

TERM = r"[a-z]{3,}"
#: Shares of the score that agreement in topic and in terms have, and decimals that count.
TOPIC_SHARE = 0.5
DECIMALS = 6
UNIT = 10**DECIMALS
#: Figures or slides of a deck that one task maps by itself, and different terms whose frequencies it is given; more of either meet by joins.
DECK = 512
VOCABULARY = 200_000


def _weights(rows: DataFrame, key: str, idf: DataFrame) -> DataFrame:
    """deck_id, key, term, w: the terms of each text with weights of length 1."""
    counts = rows.select("deck_id", key, F.explode(F.regexp_extract_all(F.lower("text"), F.lit(TERM), 0)).alias("term")).groupBy("deck_id", key, "term").agg(F.count("*").alias("n"))
    own = Window.partitionBy("deck_id", key)
    return counts.join(idf, "term").withColumn("w", F.col("n") * F.col("idf")).withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(own)))


def mapping_scores(captions: DataFrame, slides: DataFrame) -> DataFrame:
    """deck_id, fig_id, slide, score (above 0) of captions (deck_id, fig_id, caption) and slides (deck_id, slide, text) of one deck.

    Half of the score is the cosine of term weights (count times inverse frequency over all captions and slides), half the agreement
    in the topic that both name. Pairs without a common term or topic are not formed. Scores are rounded, so ties do not depend on the order of sums.
    """
    return _joined_scores(*_texts(captions, slides), _frequencies(*_texts(captions, slides)))


def _texts(captions: DataFrame, slides: DataFrame) -> tuple[DataFrame, DataFrame]:
    return captions.select("deck_id", "fig_id", F.coalesce("caption", F.lit("")).alias("text")), slides.select("deck_id", "slide", F.coalesce("text", F.lit("")).alias("text"))


def _frequencies(a: DataFrame, b: DataFrame) -> DataFrame:
    """term, idf over all texts of both."""
    texts = a.select("text").unionByName(b.select("text"))
    terms = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), 0))
    total = texts.agg(F.count("*").alias("total"))
    found = texts.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(total))  # one row
    return found.select("term", (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1).alias("idf"))


def _joined_scores(a: DataFrame, b: DataFrame, idf: DataFrame) -> DataFrame:
    """``mapping_scores`` of texts whose terms have the frequencies ``idf``."""
    x, y = _weights(a, "fig_id", idf), _weights(b, "slide", idf).withColumnRenamed("w", "v")
    cosine = x.join(y, ["deck_id", "term"]).groupBy("deck_id", "fig_id", "slide").agg(F.sum(F.col("w") * F.col("v")).alias("cosine"))
    named = lambda rows, key: rows.select("deck_id", key, slide_topic(F.col("text")).alias("topic")).where("topic IS NOT NULL")
    agree = named(a, "fig_id").join(named(b, "slide"), ["deck_id", "topic"]).select("deck_id", "fig_id", "slide", F.lit(1).alias("agree"))
    both = cosine.join(agree, ["deck_id", "fig_id", "slide"], "full")
    score = TOPIC_SHARE * F.coalesce("agree", F.lit(0)) + (1 - TOPIC_SHARE) * F.coalesce("cosine", F.lit(0.0))
    return both.select("deck_id", "fig_id", "slide", F.round(F.least(F.lit(1.0), score), DECIMALS).alias("score"))


def _best_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs by deck and in the order of their scores; of each deck, each figure and each slide once."""
    deck, figures, slides = None, set(), set()
    for batch in batches:
        keep = []
        for own, fig_id, slide in zip(*(batch.column(c).to_pylist() for c in ("deck_id", "fig_id", "slide"))):
            if own != deck:
                deck, figures, slides = own, set(), set()
            keep.append(fig_id not in figures and slide not in slides)
            if keep[-1]:
                figures.add(fig_id), slides.add(slide)
        yield batch.filter(pa.array(keep, pa.bool_()))


def _values(column: pa.Array) -> list:
    """The column's values, null as None; pyarrow's own way is several times slower for plain ones."""
    plain = pa.types.is_integer(column.type) or pa.types.is_string(column.type) or pa.types.is_boolean(column.type)
    return column.to_pandas(integer_object_nulls=True).tolist() if plain else column.to_pylist()


def _mapped_decks(idf: dict[str, float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts by deck (deck_id, fig_id or slide, figure, topic, text in lower case) to deck_id, fig_id, slide, score of each figure."""

    def weights(text: str) -> dict[str, float]:
        w = {t: n * idf[t] for t, n in Counter(re.findall(TERM, text)).items()}
        length = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / length for t, x in w.items()}

    def best(figures: list, slides: list, vector: Callable) -> dict:
        pairs = []
        shown = [(slide, topic, vector(text)) for slide, topic, text in slides]
        for fig_id, topic, text in figures:
            x = vector(text)
            for slide, other, y in shown:
                agree, cosine = topic is not None and topic == other, 0.0
                for t in x.keys() & y.keys():
                    cosine += x[t] * y[t]
                if agree or cosine:
                    pairs.append((-int((TOPIC_SHARE * agree + (1 - TOPIC_SHARE) * cosine) * UNIT + 0.5), fig_id, slide))
        taken, slides_taken = {}, set()
        for score, fig_id, slide in sorted(pairs):
            if fig_id not in taken and slide not in slides_taken:
                taken[fig_id] = (slide, -score / UNIT)
                slides_taken.add(slide)
        return taken

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deck, figures, slides, out, schema = None, [], [], [], None
        vector = lru_cache(1 << 14)(weights)

        def end() -> None:
            taken = best(figures, slides, vector) if figures and deck is not None else {}
            out.extend((deck, fig_id, *taken.get(fig_id, (None, 0.0))) for fig_id, _, _ in figures)
            figures.clear(), slides.clear()

        def rows() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [[]] * 4, schema)], schema=schema)
            out.clear()
            return batch

        for batch in batches:
            schema = schema or pa.schema([*(batch.schema.field(c) for c in ("deck_id", "fig_id", "slide")), pa.field("score", pa.float64())])
            for own, fig_id, slide, figure, topic, text in zip(*(_values(batch.column(c)) for c in ("deck_id", "fig_id", "slide", "figure", "topic", "text"))):
                if own != deck:
                    end()
                    deck = own
                (figures if figure else slides).append((fig_id if figure else slide, topic, text))
            yield rows()
        if schema:
            end()
            yield rows()

    return run


def mapped_figures(captions: DataFrame, slides: DataFrame) -> DataFrame:
    """deck_id, fig_id, slide, score, band of every caption: its slide, if one is left for it, and how far the mapping is to be trusted.

    The best pair of a deck comes first, then the best of what is left; ties go to the smaller fig_id, then slide. Captions without a slide have score 0 and
    are skipped. fig_id is unique in a deck, and so is slide. Decks of up to DECK figures and slides are mapped whole by a task, larger ones by joins.
    """
    a, b = _texts(captions, slides)
    idf = _frequencies(a, b)
    terms = idf.limit(VOCABULARY + 1).collect()
    if len(terms) > VOCABULARY:
        return _mapped_by_joins(a, b, idf)
    large = [rows.groupBy("deck_id").count().where(F.col("count") > DECK).select("deck_id") for rows in (a, b)]
    if all(rows.isEmpty() for rows in large):
        return _mapped_in_tasks(a, b, terms)
    large = large[0].unionByName(large[1]).hint("merge")
    few, many = ([rows.join(large, "deck_id", how) for rows in (a, b)] for how in ("left_anti", "left_semi"))
    return _mapped_in_tasks(*few, terms).unionByName(_mapped_by_joins(*many, idf))


def _mapped_in_tasks(a: DataFrame, b: DataFrame, terms: list) -> DataFrame:
    """The texts of a deck meet in one task, which scores and chooses its pairs."""
    both = a.withColumn("figure", F.lit(True)).unionByName(b.withColumn("figure", F.lit(False)), allowMissingColumns=True)
    rows = both.select("deck_id", "fig_id", "slide", "figure", slide_topic(F.col("text")).alias("topic"), F.lower("text").alias("text"))
    met = rows.repartition(F.xxhash64("deck_id")).sortWithinPartitions("deck_id")  # a hash of its own: no partitioning is taken over from below a union
    schema = met.select("deck_id", "fig_id", "slide", F.lit(None).cast("double").alias("score")).schema
    chosen = met.mapInArrow(_mapped_decks({r.term: r.idf for r in terms}), schema)
    return chosen.withColumn("band", confidence_band(F.col("score")))


def _mapped_by_joins(a: DataFrame, b: DataFrame, idf: DataFrame) -> DataFrame:
    """The same by joins of terms. The pairs of a deck pass one task in order; what it holds are the figures and slides taken."""
    scores = _joined_scores(a, b, idf)
    ordered = scores.repartition("deck_id").sortWithinPartitions("deck_id", F.col("score").desc(), "fig_id", "slide")
    chosen = ordered.mapInArrow(_best_first, scores.schema)
    rows = a.select("deck_id", "fig_id").join(chosen, ["deck_id", "fig_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return rows.withColumn("band", confidence_band(F.col("score")))
