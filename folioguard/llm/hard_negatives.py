"""Operator 11: hard-negative mining by dual-tree search.

Vectors are scaled and floored to integers, so scores are exact inner products. Rows are ordered by label and by the
leaf of a splitting tree that is fitted on a bounded sample (``SAMPLE`` rows, those with the least hashes), dealt
out by ranges of that order, and cut into blocks of one label inside each task: while a block holds more than
``block`` rows, it is halved along its widest direction. Blocks are the leaves of a tree whose upper levels take ``FAN``
neighbours each; a node knows the mean, the radius and the largest norm of its vectors and the range of its labels. Candidates
have one tree, anchors another with smaller blocks.

A search goes down both trees level by level. A pair of nodes whose labels allow it stays as long as its interval of inner
products ([c.c' - r, c.c' + r] with r = |c| r' + r |c'| + r r', cut at the product of norms) meets the scores that some
anchor below still needs; so one test drops whole groups of anchors and candidates. Pairs of blocks that are left are scored exactly.

1. A narrow search keeps, for each anchor node, only the ``BEAM`` most promising candidate nodes; its scores give each anchor a
   lower bound of its ``k``-th positive.
2. The full search for positives needs scores from that bound on.
3. The full search for negatives needs scores between ``floor`` times the least positive and the greatest one.

The best of each anchor are taken per task first, then by window. Vectors shorter than the longest count as padded with
zeros. Scores must fit 64 bits, else the run fails. Rows with a null label, a null vector, or a null, NaN or infinite component
take no part; neither do rows without vec_id. Exact repetitions of a row count once; different rows of one vec_id are
rows of their own, ordered by label and content. Equal vectors are split by vec_id, so any number of them is spread over
blocks. No rows or no anchors give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioguard.llm.common import read_table, stored

SAMPLE = 16_384
#: Rows of a leaf of the fitted tree, of a block of candidates and of a block of anchors; rows that a task splits at once.
LEAF = 128
BLOCK = 2_048
ANCHOR_BLOCK = 256
PIECE = 32_768
FAN = 16
BEAM = 4
POSITIVES = 5
NEGATIVES = 5
SCALE = 256
#: Scores of negatives lie between FLOOR percent of the positive's score and all of it.
FLOOR = 80
SHARE = (FLOOR // math.gcd(FLOOR, 100), 100 // math.gcd(FLOOR, 100))
#: Anchors whose best a task holds at once.
HELD = 50_000
EXACT = 1 << 53
BLOCKS = "pid int, seq int, label long, n int, center binary, radius double, norm double, ids binary, keys binary, vectors binary"
FOUND = "anchor_id long, akey long, slot int, other_id long, okey long, score long"


def prepared(vectors: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """vec_id, label, q (the floored components) and key (a hash of label and vector) of the rows that take part, each once."""
    x, rows = F.col("x"), vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("x"))
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~bad)
    rows = rows.select("vec_id", "label", F.transform(x, lambda e: F.floor(e * SCALE)).alias("q"))
    rows = rows.withColumn("key", F.xxhash64("label", "q"))
    return rows.groupBy("vec_id", "key").agg(F.first("label").alias("label"), F.first("q").alias("q"))


class SplitTree:
    """A binary tree of half-spaces, fitted on a sample; gives each vector the number of its leaf, left to right."""

    def __init__(self, sample: np.ndarray, leaf: int = LEAF):
        self.nodes: list[tuple[np.ndarray, float, int, int]] = []
        self.leaves = 0
        self.root = self._grow(sample, leaf)

    def _grow(self, x: np.ndarray, leaf: int) -> int:
        """The node's number; a leaf is a negative one."""
        direction, cut = widest(x) if len(x) > leaf else (None, 0.0)
        if direction is None:
            self.leaves += 1
            return -self.leaves
        left = x @ direction < cut
        own = len(self.nodes)
        self.nodes.append((direction, cut, 0, 0))
        self.nodes[own] = (direction, cut, self._grow(x[left], leaf), self._grow(x[~left], leaf))
        return own

    def place(self, x: np.ndarray) -> np.ndarray:
        out, jobs = np.zeros(len(x), np.int32), [(self.root, np.arange(len(x)))]
        while jobs:
            node, rows = jobs.pop()
            if node < 0:
                out[rows] = -node - 1
            elif len(rows):
                direction, cut, a, b = self.nodes[node]
                left = x[rows] @ direction < cut
                jobs += [(a, rows[left]), (b, rows[~left])]
        return out


def widest(x: np.ndarray) -> tuple[np.ndarray | None, float]:
    """The direction in which ``x`` varies most, nearly, and the median along it; None if all are equal or no cut divides them."""
    y = x - x.mean(axis=0)
    direction = y[np.argmax((y * y).sum(axis=1))]
    for _ in range(4):  # power steps
        size = np.linalg.norm(direction)
        if size == 0:
            return None, 0.0
        direction = y.T @ (y @ (direction / size))
    size = np.linalg.norm(direction)
    if not size:
        return None, 0.0
    at = x @ (direction / size)
    cut = float(np.median(at))
    return (direction / size, cut) if 0 < (at < cut).sum() < len(x) else (None, 0.0)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as rows of ``dim`` numbers, padded with zeros."""
    sizes, out = np.diff(column.offsets.to_numpy()), np.zeros((len(column), dim), np.int64)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy()
    return out


def _placed_batches(tree: SplitTree, dim: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.place(matrix(batch.column("q"), dim).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

    return run


def _halves(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Row numbers of blocks of at most ``most`` rows; neighbours in the list are neighbours in space. Equal vectors are cut in order."""
    out, jobs = [], [np.arange(len(x))]
    while jobs:
        rows = jobs.pop()
        if len(rows) <= most:
            out.append(rows)
            continue
        direction, cut = widest(x[rows])
        if direction is None:
            jobs += [rows[len(rows) // 2 :], rows[: len(rows) // 2]]
        else:
            left = x[rows] @ direction < cut
            jobs += [rows[~left], rows[left]]
    return out


def _block_batches(dim: int, most: int, dtype: str) -> Callable:
    """Blocks of one label out of rows in order of (label, leaf, vec_id); PIECE rows at once are split."""

    def blocks(label: int, ids: np.ndarray, keys: np.ndarray, q: np.ndarray) -> Iterator[dict]:
        x = q.astype(np.float64)
        for rows in _halves(x, most):
            own = x[rows]
            center = own.mean(axis=0)
            # A little more than computed, as the interval must hold in spite of rounding.
            radius = float(np.sqrt(((own - center) ** 2).sum(axis=1).max())) * (1 + 1e-9) + 1e-6
            norm = float(np.sqrt((own * own).sum(axis=1).max())) * (1 + 1e-9) + 1e-6
            order = rows[np.lexsort((keys[rows], ids[rows]))]
            yield {"label": label, "n": len(rows), "center": center.tobytes(), "radius": radius, "norm": norm, "ids": ids[order].tobytes(), "keys": keys[order].tobytes(), "vectors": q[order].astype(dtype).tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, seq, held = TaskContext.get().partitionId(), 0, None
        schema = pa.schema([("pid", pa.int32()), ("seq", pa.int32()), ("label", pa.int64()), ("n", pa.int32()), ("center", pa.binary()), ("radius", pa.float64()), ("norm", pa.float64()), ("ids", pa.binary()), ("keys", pa.binary()), ("vectors", pa.binary())])

        def out(label: int, *arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal seq
            for b in blocks(label, *arrays):
                yield pa.RecordBatch.from_pylist([b | {"pid": pid, "seq": seq}], schema)
                seq += 1

        for batch in batches:
            labels = batch.column("label").to_numpy()
            ids, keys, q = batch.column("vec_id").to_numpy(), batch.column("key").to_numpy(), matrix(batch.column("q"), dim)
            edges = [0, *(np.flatnonzero(labels[1:] != labels[:-1]) + 1), len(labels)]
            for i, j in zip(edges, edges[1:]):
                if i == j:
                    continue
                if held is not None and held[0] == labels[i]:
                    held = (held[0], *(np.concatenate((a, b[i:j])) for a, b in zip(held[1:], (ids, keys, q))))
                else:
                    if held is not None:
                        yield from out(*held)
                    held = (int(labels[i]), ids[i:j], keys[i:j], q[i:j])
                while len(held[1]) >= PIECE:
                    yield from out(held[0], *(a[:PIECE] for a in held[1:]))
                    held = (held[0], *(a[PIECE:] for a in held[1:]))
        if held is not None and len(held[1]):
            yield from out(*held)

    return run


def block_table(placed: DataFrame, dim: int, most: int, dtype: str) -> DataFrame:
    """Blocks with their place ``node`` in the order of all."""
    rows = placed.repartitionByRange("label", "leaf", "vec_id", "key").sortWithinPartitions("label", "leaf", "vec_id", "key")
    blocks = stored(rows.mapInArrow(_block_batches(dim, most, dtype), BLOCKS), "blocks")
    counts = blocks.groupBy("pid").agg(F.count("*").alias("blocks"))
    # One row for each task of the write, whatever the number of rows.
    before = counts.select("pid", (F.sum("blocks").over(Window.orderBy("pid")) - F.col("blocks")).alias("before"))
    return stored(blocks.join(F.broadcast(before), "pid").withColumn("node", F.col("before") + F.col("seq")).drop("pid", "seq", "before"), "blocks")


NODE = ["node", "n", "center", "radius", "norm", "low", "high", "need_low", "need_high"]
ABOVE = "node long, n long, center binary, radius double, norm double, low long, high long, need_low double, need_high double, children binary, numbers array<long>, labels array<long>"
#: Numbers of a child in ``children``, after its center: radius, norm, need_low, need_high, n.
EXTRA = 5


def _join_nodes(rows: pd.DataFrame) -> pd.DataFrame:
    """One level up: mean, radius and norm of up to FAN nodes, and what the search needs to know of each."""
    rows = rows.sort_values("node")
    centers = np.stack([np.frombuffer(c) for c in rows.center])
    center = np.average(centers, axis=0, weights=rows.n)
    radius = float((np.linalg.norm(centers - center, axis=1) + rows.radius).max()) * (1 + 1e-9)
    children = np.column_stack((centers, rows.radius, rows.norm, rows.need_low, rows.need_high, rows.n))
    return pd.DataFrame(
        {
            "node": [rows.parent.iloc[0]], "n": [int(rows.n.sum())], "center": [center.tobytes()], "radius": [radius], "norm": [float(rows.norm.max())], "low": [rows.low.min()], "high": [rows.high.max()],
            "need_low": [rows.need_low.min()], "need_high": [rows.need_high.max()], "children": [children.tobytes()], "numbers": [rows.node.tolist()], "labels": [[*rows.low, *rows.high]],
        }
    )


def levels(leaves: DataFrame, height: int) -> list[DataFrame]:
    """The levels above ``leaves`` (NODE), lowest first; each node holds its children."""
    out, below = [], leaves
    for _ in range(height):
        level = stored(below.withColumn("parent", F.floor(F.col("node") / FAN)).groupBy("parent").applyInPandas(_join_nodes, ABOVE), "level")
        out.append(level)
        below = level.select(*NODE)
    return out


def _children_batches(dim: int, same: bool, beam: bool) -> Callable:
    """Pairs of children whose interval and labels allow a result; with ``beam``, also how promising each is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], []]
            for row in zip(*(batch.column(c) for c in ("a_children", "a_numbers", "a_labels", "c_children", "c_numbers", "c_labels"))):
                a, c = (np.frombuffer(x.as_buffer()).reshape(-1, dim + EXTRA) for x in (row[0], row[3]))
                (al, ah), (cl, ch) = (np.array(x.as_py()).reshape(2, -1) for x in (row[2], row[5]))
                dots = a[:, :dim] @ c[:, :dim].T
                (ra, na), (rc, nc) = a[:, dim : dim + 2].T, c[:, dim : dim + 2].T
                ma, mc = (np.linalg.norm(x[:, :dim], axis=1) for x in (a, c))
                spread = (ma[:, None] * rc + ra[:, None] * mc + ra[:, None] * rc) * (1 + 1e-9) + 1e-6
                most = na[:, None] * nc
                high, low = np.minimum(dots + spread, most), np.maximum(dots - spread, -most)
                single = (al == ah)[:, None] & (cl == ch) & (al[:, None] == cl)
                met = (al[:, None] <= ch) & (cl <= ah[:, None]) if same else ~single
                met &= (high >= a[:, dim + 2, None]) & (low <= a[:, dim + 3, None])
                i, j = np.nonzero(met)
                for o, x in zip(out, (np.array(row[1].as_py())[i], np.array(row[4].as_py())[j], dots[i, j])):
                    o.append(x)
            columns = [np.concatenate(o) if o else np.zeros(0) for o in out]
            names = ["a", "c", "dot"]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0].astype(np.int64)), pa.array(columns[1].astype(np.int64)), pa.array(columns[2])][: 3 if beam else 2], names=names[: 3 if beam else 2])

    return run


def descend(anchors: list[DataFrame], candidates: list[DataFrame], dim: int, same: bool, beam: int = 0) -> DataFrame:
    """Pairs (a, c) of blocks that may hold results: with equal labels, if ``same``, or with different ones."""
    top = [x[-1].select(F.col("node").alias(n)) for x, n in ((anchors, "a"), (candidates, "c"))]
    pairs = top[0].join(top[1], F.col("a") == F.col("c"))  # both trees end in one node, 0
    for a, c in zip(reversed(anchors), reversed(candidates)):
        a, c = (x.select(F.col("node").alias(n), *(F.col(f).alias(f"{n}_{f}") for f in ("children", "numbers", "labels"))) for x, n in ((a, "a"), (c, "c")))
        pairs = pairs.join(a, "a").join(c, "c").mapInArrow(_children_batches(dim, same, beam > 0), "a long, c long" + ", dot double" * (beam > 0))
        if beam:
            best = F.row_number().over(Window.partitionBy("a").orderBy(F.col("dot").desc(), "c"))
            pairs = pairs.withColumn("r", best).where(F.col("r") <= beam).select("a", "c")
        pairs = stored(pairs, "pairs")
    return pairs


def _score_batches(dim: int, dtype: str, same: bool, exact: bool, k: int) -> Callable:
    """The best of each anchor (and slot) among the pairs of blocks of a task."""
    kind = np.float64 if exact else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[tuple]] = {}

        def flush() -> pa.RecordBatch:
            rows = [(*who, *r) for who, best in held.items() for r in best]
            held.clear()
            columns = zip(*rows) if rows else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=["anchor_id", "akey", "slot", "other_id", "okey", "score"])

        for batch in batches:
            for r in range(len(batch)):
                ids, keys, cids, ckeys = (np.frombuffer(batch.column(n)[r].as_buffer(), np.int64) for n in ("a_ids", "a_keys", "c_ids", "c_keys"))
                x, y = (np.frombuffer(batch.column(n)[r].as_buffer(), dtype).reshape(-1, dim).astype(kind) for n in ("a_vectors", "c_vectors"))
                scores = np.rint(x @ y.T).astype(np.int64) if exact else x @ y.T
                if same:
                    bounds = np.frombuffer(batch.column("a_low")[r].as_buffer(), np.int64)
                    for i in range(len(ids)):
                        s = scores[i]
                        other = (s >= bounds[i]) & ((cids != ids[i]) | (ckeys != keys[i]))
                        _merge(held, (int(ids[i]), int(keys[i]), 0), np.flatnonzero(other), s, cids, ckeys, k)
                else:
                    slots = np.frombuffer(batch.column("a_positives")[r].as_buffer(), np.int64).reshape(len(ids), -1)
                    for i in range(len(ids)):
                        s = scores[i]
                        for slot, p in enumerate(slots[i].tolist()):
                            if p >= 0:  # no score lies between FLOOR percent of a negative score and that score
                                band = np.flatnonzero((SHARE[1] * s >= SHARE[0] * p) & (s <= p))
                                _merge(held, (int(ids[i]), int(keys[i]), slot), band, s, cids, ckeys, k)
            if len(held) > HELD:
                yield flush()
        if held:
            yield flush()

    return run


def _merge(held: dict, who: tuple, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, keys: np.ndarray, k: int) -> None:
    """Keep the k best of what is held for ``who`` and of ``rows``; the block's rows are in order of (id, key)."""
    if not len(rows):
        return
    own = score[rows]
    if len(rows) > k:
        least = np.partition(own, len(own) - k)[len(own) - k]
        rows = rows[own >= least]
        rows = rows[np.argsort(-score[rows], kind="stable")[:k]]
    new = [(int(ids[j]), int(keys[j]), int(score[j])) for j in rows]
    old = held.get(who)
    held[who] = sorted([*old, *new] if old else new, key=lambda r: (-r[2], r[0], r[1]))[:k]


def score_pairs(pairs: DataFrame, anchors: DataFrame, candidates: DataFrame, dim: int, dtype: str, same: bool, exact: bool, k: int) -> DataFrame:
    """The k best rows of each anchor and slot (FOUND) out of pairs of blocks. ``anchors`` holds what the scoring asks for beside the block."""
    sides = []
    for x, n in ((anchors, "a"), (candidates, "c")):
        named = {c: f"{n}_{c}" for c in ("ids", "keys", "vectors", "low", "positives") if c in x.columns}
        sides.append(x.select(F.col("node").alias(n), *(F.col(c).alias(d) for c, d in named.items())))
    met = pairs.join(sides[0], "a").join(sides[1], "c").drop("a", "c")
    found = met.mapInArrow(_score_batches(dim, dtype, same, exact, k), FOUND)
    place = F.row_number().over(Window.partitionBy("anchor_id", "akey", "slot").orderBy(F.col("score").desc(), "other_id", "okey"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _needs(blocks: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The blocks of anchors with, in the order of their rows, each anchor's k best scores as bytes (missing: least long)."""
    slots = found.groupBy("anchor_id", "akey").agg(F.sort_array(F.collect_list("score"), asc=False).alias("scores"))
    rows = blocks.select("node", F.posexplode(F.col("members")).alias("pos", "m")).select("node", "pos", F.col("m.id").alias("anchor_id"), F.col("m.key").alias("akey"))
    met = rows.join(slots, ["anchor_id", "akey"], "left")

    def lists(rows: pd.DataFrame) -> pd.DataFrame:
        out = np.full((len(rows), k), np.iinfo(np.int64).min)
        for i, s in enumerate(rows.sort_values("pos").scores):
            if s is not None:
                out[i, : len(s)] = s
        full = out[:, k - 1]
        some = out[out[:, 0] > np.iinfo(np.int64).min]
        least = [r[r > np.iinfo(np.int64).min][-1] for r in some]
        return pd.DataFrame({
            "node": [rows.node.iloc[0]], "low": [full.astype(np.int64).tobytes()], "positives": [out.tobytes()], "kth": [float(full.min())],
            "least": [float(min(least)) if least else float("inf")], "most": [float(some.max()) if least else float("-inf")],
        })

    return stored(met.groupBy("node").applyInPandas(lists, "node long, low binary, positives binary, kth double, least double, most double"), "needs")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [[{"id": i, "key": k} for i, k in zip(*(np.frombuffer(x.as_buffer(), np.int64).tolist() for x in pair))] for pair in zip(batch.column("ids"), batch.column("keys"))]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(rows, pa.list_(pa.struct([("id", pa.int64()), ("key", pa.int64())])))], names=["node", "members"])


def hard_negatives(
    vectors: DataFrame, is_anchor: str, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES,
    block: int = BLOCK, anchor_block: int = ANCHOR_BLOCK, sample: int = SAMPLE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``is_anchor`` is a condition on vec_id."""
    rows = stored(prepared(vectors, vec_id, vector, label), "vectors")
    size = rows.agg(F.max(F.size("q")).alias("dim"), F.max(F.expr("aggregate(q, 0L, (m, e) -> greatest(m, abs(e)))")).alias("most"), F.count_if(F.expr(is_anchor)).alias("anchors")).first()
    none = vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not size.dim or not size.anchors:
        return none
    dim, reach = size.dim, size.dim * size.most * size.most
    if SHARE[1] * reach >= 1 << 63:
        raise ValueError("scores do not fit 64 bits")
    exact, dtype = reach < EXACT, "<i2" if size.most < 1 << 15 else "<i4" if size.most < 1 << 31 else "<i8"
    drawn = rows.orderBy(F.xxhash64("vec_id", "key"), "vec_id", "key").limit(sample).select("q").toArrow()
    tree = SplitTree(matrix(drawn.column("q").combine_chunks(), dim).astype(np.float64))
    placed = stored(rows.mapInArrow(_placed_batches(tree, dim), "vec_id long, key long, label long, q array<long>, leaf int"), "placed")
    a, c = block_table(placed.where(is_anchor), dim, anchor_block, dtype), block_table(placed, dim, block, dtype)
    height, nodes = 1, max(x.agg(F.max("node")).first()[0] for x in (a, c)) + 1
    while FAN**height < nodes:
        height += 1

    def tree_of(blocks: DataFrame, low, high) -> list[DataFrame]:
        cols = [F.col(x) for x in ("node", "n", "center", "radius", "norm")]
        return levels(blocks.select(*cols, F.col("label").alias("low"), F.col("label").alias("high"), low.cast("double").alias("need_low"), high.cast("double").alias("need_high")), height)

    inf = F.lit(float("inf"))
    c_tree = tree_of(c, -inf, inf)
    members = a.join(a.select("node", "ids", "keys").mapInArrow(_members, "node long, members array<struct<id:long,key:long>>"), "node")
    members = stored(members.select("node", "members"), "members")

    def search(a_tree: list[DataFrame], asked: DataFrame, same: bool, k: int, beam: int = 0) -> DataFrame:
        return score_pairs(descend(a_tree, c_tree, dim, same, beam), a.join(asked, "node"), c, dim, dtype, same, exact, k)

    nothing = found = vectors.sparkSession.createDataFrame([], "anchor_id long, akey long, score long")
    asked = _needs(members, nothing, positives)
    for beam in (BEAM, 0):
        blocks = a.join(asked.select("node", "kth"), "node")
        found = stored(search(tree_of(blocks, F.when(F.col("kth") < -(2.0**62), -inf).otherwise(F.col("kth")), inf), asked.select("node", "low"), True, positives, beam), "positives")
        asked = _needs(members, found, positives)
    blocks = a.join(asked.select("node", "least", "most"), "node")
    low, high = F.when(F.col("least") < 0, 0.0).otherwise(F.col("least") * (FLOOR / 100) - 1), F.col("most")
    met = search(tree_of(blocks, low, high), asked.select("node", "positives"), False, negatives)
    chosen = found.select("anchor_id", "akey", (F.col("rank") - 1).alias("slot"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return met.join(chosen, ["anchor_id", "akey", "slot"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.select("vec_id", "embedding", label.alias("label")), "vec_id % 100 = 0")


OP11_SQL = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.other_id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id)
QUALIFY row_number() OVER w <= 5
"""
