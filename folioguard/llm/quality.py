"""Operator 5: quality classifier on random Fourier features of document statistics.

Statistics of the whole text (shares of character classes, word and line lengths, repetition of words
and lines) are standardised and mapped to D random Fourier features, which approximate a
Gaussian kernel. Each partition of the labelled rows sums its part of the normal equations; the sum is
solved with a ridge. Isotonic regression on a fold that the ridge has not seen turns the values
into probabilities. lang, source, doc_id and labels are never inputs of a score.

Folds by crc32(doc_id as text) mod 5: 0 held out, 1 calibration, 2 to 4 ridge. At most ``sample``
labelled rows (about; chosen by a hash of doc_id) are learned from, a documented bound, so everything
that reaches the driver is bounded too: 8 partial sums of D x D and the calibration fold's values.

Null and empty texts have all statistics zero and get a score like any other. Labels that are null are
ignored; several labels of a document count by their mean. Equal texts have equal scores, and ties in the
calibration fold count as one value, so scores do not depend on the order of rows. A null doc_id is held
out. Without both labels among the rows to learn from, every score is the share of label 1 (0.5 without
any). Repeated rows get a row each. Rows that repeat a labelled doc_id are all learned from, but for documents that
repeat them so often that the bound would not hold (``labelled_sample``). Columns of the input with clashing
names are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioguard.llm.common import LOWER, Rolling, buffers, chunks, read_table, separated, stored, word_hashes

SAMPLE = 40_000
FEATURES = 384
#: Width of the kernel, in standardised statistics, and the ridge per row.
GAMMA = 0.04
RIDGE = 1e-3
THRESHOLD = 0.3
#: Values that agree so far are ties.
DECIMALS = 9
PIECE = 1 << 20

#: Character classes, by byte: upper, lower, digit, space, line feed, sentence marks, exclamation, symbols, bars, others, non-ASCII.
_GROUPS = [range(65, 91), range(97, 123), range(48, 58), b" \t\r", b"\n", b".,;:?", b"!", b"#$%&*@^~_+=<>", b"|", b"'\"()[]{}/\\-`"]
CLASS = np.full(256, len(_GROUPS), np.uint8)
for _k, _g in enumerate(_GROUPS):
    CLASS[list(_g)] = _k
N_CLASSES = len(_GROUPS) + 1
N_STATS = N_CLASSES + 14


def _sum(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``starts`` (n + 1 offsets); empty ranges give 0."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    return total[starts[1:]] - total[starts[:-1]]


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n documents: number of distinct values and the count of the most frequent one."""
    order = np.lexsort((h, doc))
    d, v = doc[order], h[order]
    new = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (v[1:] != v[:-1])))) if len(d) else np.zeros(0, np.int64)
    times = np.diff(np.concatenate((new, [len(d)])))
    most = np.zeros(n)
    np.maximum.at(most, d[new], times)
    return np.bincount(d[new], minlength=n).astype(float), most


def statistics(data: np.ndarray, at: np.ndarray, rolling: Rolling) -> np.ndarray:
    """One row of N_STATS statistics per text."""
    out = np.zeros((len(at) - 1, N_STATS))
    for i, j in chunks(at, PIECE):
        n = j - i
        x, own = separated(data, at, i, j)
        if len(x) > len(rolling.power):
            rolling = Rolling(51, len(x))
        size = np.maximum(1, np.diff(own) - 1).astype(float)
        kind = CLASS[x]
        s = out[i:j]
        for k in range(N_CLASSES):
            s[:, k] = _sum(kind == k, own) / size
        s[:, N_CLASSES - 1] = np.maximum(0, s[:, N_CLASSES - 1] - 1 / size)  # the separator
        a, h = word_hashes(x, rolling)
        inside = _sum((kind <= 2) | (x >= 128), own)
        doc = np.searchsorted(own, a, side="right") - 1
        count = np.bincount(doc, minlength=n).astype(float)
        some = np.maximum(1, count)
        gap = np.minimum(np.concatenate((a[1:], [len(x)]))[: len(a)], own[doc + 1]) - a  # a word and what follows it in its text
        end = np.minimum(gap, 40).astype(float)
        distinct, most = _distinct(doc, h, n)
        k = N_CLASSES
        s[:, k] = np.log1p(size - 1)
        s[:, k + 1] = np.log1p(count)
        s[:, k + 2] = inside / some
        s[:, k + 3] = np.bincount(doc, end, n) / some
        s[:, k + 4] = np.sqrt(np.maximum(0, np.bincount(doc, end * end, n) / some - s[:, k + 3] ** 2))
        s[:, k + 5] = distinct / some
        s[:, k + 6] = most / some
        s[:, k + 7] = np.bincount(doc, gap <= 3, n) / some
        # Words followed by two or more characters that are no space.
        after = np.minimum(a + 1, len(x) - 1)
        s[:, k + 8] = np.bincount(doc, (kind[after] == 0), n) / some
        pair = (kind[:-1] >= 5) & (kind[:-1] < N_CLASSES - 1) & (x[:-1] == x[1:])
        s[:, k + 9] = _sum(np.concatenate((pair, [False])), own) / some
        # Lines: their number, repetition and length.
        lines = np.flatnonzero(np.concatenate(([True], (x[:-1] == 10) | (x[:-1] == 0))))
        ends = np.concatenate((lines[1:], [len(x)])) - 1
        full = ends - lines > 1
        lines, ends = lines[full], ends[full]
        ldoc = np.searchsorted(own, lines, side="right") - 1
        lcount = np.maximum(1, np.bincount(ldoc, minlength=n)).astype(float)
        s[:, k + 10] = _distinct(ldoc, rolling.of(rolling.sums(LOWER[x]), lines, ends), n)[0] / lcount
        s[:, k + 11] = np.log1p(size / lcount)
        # Repetition of pairs of words.
        two = doc[1:] == doc[:-1]
        pairs, often = _distinct(doc[1:][two], (h[1:] * np.uint64(3) + h[:-1])[two], n)
        s[:, k + 12] = pairs / np.maximum(1, count - 1)
        s[:, k + 13] = often / np.maximum(1, count - 1)
        s[np.diff(own) == 1] = 0
    return out


@dataclass
class Kernel:
    """Random Fourier features of standardised statistics, a linear model on them, and its calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    phase: np.ndarray
    beta: np.ndarray | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8) @ self.weight + self.phase
        return np.concatenate((np.cos(z) * np.sqrt(2 / len(self.phase)), np.ones((len(z), 1))), axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        """Values of the linear model; rounded, as the last bits of a matrix product depend on a row's place in it."""
        return np.round(self.features(stats) @ self.beta, DECIMALS)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return calibrated(self.knots, self.raw(stats))


def isotonic(value: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the increasing least-squares fit of ``label`` to ``value`` (pool adjacent violators).

    Labels of equal values are summed first, so the fit is a function of the pairs and not of their order.
    """
    values, where = np.unique(value, return_inverse=True)
    blocks: list[list[float]] = []
    for v, n, y in zip(values.tolist(), np.bincount(where).tolist(), np.bincount(where, label).tolist(), strict=True):
        blocks.append([v * n, float(n), y])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            v2, n2, y2 = blocks.pop()
            blocks[-1][0] += v2
            blocks[-1][1] += n2
            blocks[-1][2] += y2
    b = np.array(blocks)
    return b[:, 0] / b[:, 1], b[:, 2] / b[:, 1]


def calibrated(knots: tuple[np.ndarray, np.ndarray], raw: np.ndarray) -> np.ndarray:
    """Probabilities, linear between the knots; a thousandth of the raw order breaks ties on plateaus."""
    with np.errstate(over="ignore"):
        return np.clip(0.999 * np.interp(raw, *knots) + 0.001 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)


def fold(doc_id: str | Column) -> Column:
    return F.coalesce(F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")) % 5, F.lit(0)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """text, y, fold of about ``sample`` labelled rows at most, none of them held out.

    The labels' sample is bounded by ``sample``, so it is broadcast and the texts are not shuffled. Where documents
    repeat labelled doc_ids so often that over twice ``sample`` rows meet it, one row of each doc_id is taken.
    """
    y = labels.where(F.col(label).isNotNull() & (fold("doc_id") > 0)).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    n = y.count()
    if n > sample:
        y = y.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    met = docs.select("doc_id", "text").join(F.broadcast(y), "doc_id")
    if met.select("doc_id").count() > 2 * sample:
        met = met.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("t.text", "y", "doc_id")
    return met.select("text", "y", fold("doc_id").alias("fold"))


def _stat_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rolling = Rolling(51, 2 * PIECE)
    for batch in batches:
        stats = statistics(*buffers(batch.column("text")), rolling)
        yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("fold"), pa.array(list(stats), pa.list_(pa.float64()))], names=["y", "fold", "x"])


def _gram_batches(kernel: Kernel) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(kernel.phase) + 2
        total = np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                z = kernel.features(np.array(batch.column("x").to_pylist()))
                z = np.concatenate((z, batch.column("y").to_numpy(zero_copy_only=False)[:, None]), axis=1)
                total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["g"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, features: int = FEATURES) -> Kernel | float:
    """The model of ``labels`` (doc_id, ``label``), or a constant score if there is nothing to learn."""
    rows = labelled_sample(docs, labels, label, sample).mapInArrow(_stat_batches, "y int, fold int, x array<double>")
    rows = stored(rows, "statistics")
    moments = rows.select("y", F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v"), F.stddev_pop("v"), F.avg("y"), F.min("y"), F.max("y")).orderBy("k").collect()
    if not moments or moments[0][4] == moments[0][5]:
        return float(moments[0][3]) if moments else 0.5
    rng = np.random.default_rng(7)
    scale = np.array([max(m[2], 1e-6) for m in moments])
    kernel = Kernel(np.array([m[1] for m in moments]), scale, rng.normal(0, np.sqrt(2 * GAMMA), (N_STATS, features)), rng.uniform(0, 2 * np.pi, features))
    has = {(r.y, r.c) for r in rows.select("y", (F.col("fold") == 1).alias("c")).distinct().collect()}
    own = len(has) == 4  # else too few rows for a fold of their own
    ridge_rows = rows.where("fold > 1") if own else rows
    d = features + 2
    parts = ridge_rows.coalesce(8).mapInArrow(_gram_batches(kernel), "g binary").collect()
    g = sum(np.frombuffer(p.g).reshape(d, d) for p in parts)
    n = g[-2, -2]
    kernel.beta = np.linalg.solve(g[:-1, :-1] + RIDGE * n / features * np.eye(d - 1), g[:-1, -1])
    calibration = (rows.where("fold = 1") if own else rows).select("x", "y").toArrow()
    raw = kernel.raw(np.array(calibration.column("x").to_pylist()))
    kernel.knots = isotonic(raw, calibration.column("y").to_numpy().astype(float))
    return kernel


def _score_batches(model: Kernel | float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(51, 2 * PIECE)
        for batch in batches:
            data, at = buffers(batch.column("text"))
            score = np.full(len(at) - 1, model) if isinstance(model, float) else model.score(statistics(data, at, rolling))
            keep = [c for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(score, pa.float64())], names=[*keep, "score"])

    return run


def score_quality(docs: DataFrame, model: Kernel | float, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of ``docs`` (doc_id, text) with ``score`` for every row; no shuffle."""
    asked = docs.select(*dict.fromkeys([*columns, "text"]))
    schema = T.StructType([*asked.schema.fields, T.StructField("score", T.DoubleType())])
    return asked.mapInArrow(_score_batches(model), schema).select(*columns, "score")


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    scored = score_quality(docs, fit(docs, labels, "quality", sample))
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
