"""Operator 2: similarity join on word shingles by chosen paths.

Documents with the same words in the same order form one class; classes are compared, not copies. A
class's shingles (``n`` words; a text of fewer words, but not none, is one shingle) are embedded by
minhash values. In each run, classes are split by a sampled token, the value at one coordinate;
buckets of more than ``bucket`` classes are split again by a coordinate that depends on the path so far, up
to ``depth`` times. Every run has coordinates of its own, so that runs fail independently. Buckets are compared pair by pair; one that stays larger is dealt out as pairs of
blocks of ``bucket`` classes, so nothing is left out. As similar sets share a coordinate with probability of
their similarity, a run keeps a pair at the threshold t together with probability t**depth at least,
and runs are repeated until the expected recall reaches ``recall``: log(1 - recall) / log(1 - t**depth).

In a bucket, lengths and 8-bit minhash signatures rule out most pairs (a pair at the threshold is ruled
out with a probability below 1e-6); the rest is compared exactly on the sets of whole texts, which are
only made for classes that need them. A pair is compared in the first run that brings it together, so
links are counted once and never shuffled: buckets send back, per class, the number of links and the
smallest class that it is connected to. Connected components of these give the groups.

Texts without words (null, empty) have no shingles and no links; their group is themselves. Rows with a
null doc_id belong to their words' class and are compared like others; a group without any doc_id has a null
class_id. Rows that repeat a doc_id are told apart by their text. Columns of the input with clashing names
are ignored. Classes and shingles are compared by hashes of 128 and 64 bits: at 10**13 shingles some 3 pairs
of different ones collide, which changes a similarity by one shingle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioguard.llm.common import Rolling, buffers, chunks, mix, nvl_text, read_table, separated, stored, table64, word_hashes
from folioguard.llm.components import components

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
BUCKET = 256
DEPTH = 3
#: Minhash values of a signature, and the coordinates that a path chooses from at each depth after the first.
HASHES = 64
CHOICES = 2
PIECE = 1 << 19
SKETCH = "doc_id long, tid long, cls binary, n int, keys array<long>, sig binary"


def runs_for(threshold: float, depth: int, recall: float) -> int:
    """Runs are independent: none shares a coordinate with another (see ``coordinates``)."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth))


def coordinates(runs: int, depth: int) -> int:
    """Minhash values that ``path_keys`` chooses from: per run, one for the first depth and CHOICES for each other."""
    return runs * (1 + CHOICES * (depth - 1))


def least_matches(threshold: float) -> int:
    """Signature bytes that must agree: five standard deviations below the expectation at the threshold."""
    return max(0, math.floor(HASHES * threshold - 5 * math.sqrt(HASHES * threshold * (1 - threshold))))


def shingle_sets(data: np.ndarray, at: np.ndarray, i: int, j: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows i to j: 16 bytes of class each (as 2 x uint64), sorted distinct shingles, and their offsets."""
    x, own = separated(data, at, i, j)
    a, h = word_hashes(x, Rolling(71, len(x)))
    rows = j - i
    doc = np.searchsorted(own, a, side="right") - 1
    first = np.searchsorted(doc, np.arange(rows + 1))
    # Class: two hashes of the words and their places.
    place = (np.arange(len(a)) - first[doc]).astype(np.uint64)
    cls = np.zeros((rows, 2), np.uint64)
    for k, salt in enumerate(table64(72, 2)):
        total = np.concatenate(([np.uint64(0)], np.cumsum(mix(h ^ mix(place + salt)), dtype=np.uint64)))
        cls[:, k] = mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64))
    odd = table64(73, n)
    if len(h) >= n:
        s = sum((h[k : len(h) - n + 1 + k] * odd[k] for k in range(1, n)), h[: len(h) - n + 1] * odd[0])
        whole = doc[n - 1 :] == doc[: len(doc) - n + 1]
        s, sdoc = mix(s[whole]), doc[: len(doc) - n + 1][whole]
    else:
        s, sdoc = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < n))
    s, sdoc = np.concatenate((s, cls[short, 0])), np.concatenate((sdoc, short))
    order = np.lexsort((s, sdoc))
    s, sdoc = s[order], sdoc[order]
    new = np.concatenate(([True], (s[1:] != s[:-1]) | (sdoc[1:] != sdoc[:-1]))) if len(s) else np.zeros(0, bool)
    s, sdoc = s[new], sdoc[new]
    return cls, s, np.searchsorted(sdoc, np.arange(rows + 1))


def minhashes(s: np.ndarray, off: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """``hashes`` minima per set (empty sets: zeros)."""
    out = np.zeros((len(off) - 1, hashes), np.uint64)
    some = np.flatnonzero(np.diff(off) > 0)
    if len(some):
        for k, (a, b) in enumerate(zip(table64(74, hashes), table64(75, hashes), strict=True)):
            out[some, k] = np.minimum.reduceat((s * a + b) >> np.uint64(24), off[:-1][some])
    return out


def path_keys(values: np.ndarray, runs: int, depth: int) -> np.ndarray:
    """The bucket of each set in each run at depths 1 to ``depth`` (rows x runs x depth).

    Each run has ``coordinates(1, depth)`` columns of ``values`` of its own, so the runs miss a pair independently.
    """
    rows = np.arange(len(values))
    own = coordinates(1, depth)
    out = np.zeros((len(values), runs, depth), np.uint64)
    for r, salt in enumerate(table64(76, runs)):
        at = np.full(len(values), r * own)
        key = np.full(len(values), salt)
        for d in range(depth):
            key = mix(key ^ mix(values[rows, at] + np.uint64(d + 1)))
            out[:, r, d] = key
            at = r * own + 1 + CHOICES * d + (key % np.uint64(CHOICES)).astype(np.int64)
    return out


def _sketch_batches(n: int, runs: int, depth: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column("text"))
            for i, j in chunks(at, PIECE):
                cls, s, off = shingle_sets(data, at, i, j, n)
                values = minhashes(s, off, max(HASHES, coordinates(runs, depth)))
                keys = path_keys(values, runs, depth).reshape(j - i, -1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i),
                        batch.column("tid").slice(i, j - i),
                        pa.array([c.tobytes() for c in cls], pa.binary()),
                        pa.array(np.diff(off), pa.int32()),
                        pa.array(list(keys), pa.list_(pa.int64())),
                        pa.array([v.tobytes() for v in (values[:, :HASHES] & np.uint64(255)).astype(np.uint8)], pa.binary()),
                    ],
                    names=["doc_id", "tid", "cls", "n", "keys", "sig"],
                )

    return run


def leaves(reps: DataFrame, runs: int, depth: int, bucket: int) -> DataFrame:
    """cls, run, leaf, size: the final bucket of each class in each run, if it has company there."""
    rows = reps.select("cls", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"), "keys")
    rows = rows.select("cls", "run", F.slice("keys", F.col("run") * depth + 1, depth).alias("keys"))
    found = None
    for d in range(depth):
        key = rows.withColumn("leaf", F.col("keys")[d])
        # Written, so that the join has an exchange of its own and a hot bucket's rows can be split.
        sizes = stored(key.groupBy("run", "leaf").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
        met = stored(key.join(sizes, ["run", "leaf"]), "paths")
        last = d == depth - 1
        done = met.where(F.lit(True) if last else F.col("size") <= bucket).select("cls", "run", "leaf", "size")
        found = done if found is None else found.unionByName(done)
        rows = met.where(F.col("size") > bucket).select("cls", "run", "keys")
        if last or rows.isEmpty():
            return found


def _pairs(task: np.ndarray, block: np.ndarray, n: np.ndarray, sig: np.ndarray, leaf: np.ndarray, run: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows i < j of one task that are to be compared. ``task`` is sorted; blocks -1: all pairs, else only across."""
    left, right, least = [], [], least_matches(t)
    earlier = np.arange(leaf.shape[1])[None, :]
    for d in range(1, len(task)):
        i = np.flatnonzero(task[d:] == task[:-d])
        if not len(i):
            break
        j = i + d
        low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        ok = (low >= t * high - 1e-9) & ((block[i] < 0) | (block[i] != block[j]))
        i, j = i[ok], j[ok]
        ok = (sig[i] == sig[j]).sum(1) >= least
        i, j = i[ok], j[ok]
        met = (leaf[i] == leaf[j]) & (leaf[i] != 0) & (earlier < run[i][:, None])
        ok = ~met.any(1)
        left.append(i[ok]), right.append(j[ok])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


TASK = "run int, leaf long, b1 int, b2 int, block int, cls binary, doc_id long, tid long, copies long, n int, sig binary, leaves array<long>"
TASK_KEY = ["run", "leaf", "b1", "b2"]
_TASK_ARROW = pa.schema(
    [("run", pa.int32()), ("leaf", pa.int64()), ("b1", pa.int32()), ("b2", pa.int32()), ("block", pa.int32()), ("cls", pa.binary()), ("doc_id", pa.int64()), ("tid", pa.int64()), ("copies", pa.int64())]
    + [("n", pa.int32()), ("sig", pa.binary()), ("leaves", pa.list_(pa.int64()))]
)


def _task_starts(table: pa.Table) -> np.ndarray:
    """For each row whether it is the first one of its task; rows are sorted by task."""
    keys = [table.column(k).to_numpy() for k in TASK_KEY]
    return np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0)))


def _whole_tasks(batches: Iterator[pa.RecordBatch], most: int = 4096, size: int = 1 << 25) -> Iterator[pa.Table]:
    """Tables of whole tasks, of about ``most`` rows or ``size`` bytes; one task is never cut. The input is sorted by task."""
    held, rows, held_bytes = [], 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows, held_bytes = rows + batch.num_rows, held_bytes + batch.nbytes
        if rows >= most or held_bytes >= size:
            table = pa.Table.from_batches(held).combine_chunks()
            last = int(np.flatnonzero(_task_starts(table))[-1])
            if last:
                yield table.slice(0, last)
                # Copied, so that the part already handed out is freed.
                rest = table.take(pa.array(np.arange(last, rows))).combine_chunks()
                held, rows, held_bytes = rest.to_batches(), rest.num_rows, rest.nbytes
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _arrays(table: pa.Table) -> tuple:
    """What ``_pairs`` takes, from rows sorted by task."""
    col = lambda k: table.column(k).to_numpy()
    block = np.where(col("b1") != col("b2"), col("block"), -1)
    data, at = buffers(table.column("sig"))
    path = pc.list_flatten(table.column("leaves")).to_numpy()
    n = table.num_rows
    return np.cumsum(_task_starts(table)), block, col("n"), data[at[0] : at[-1]].reshape(n, -1), path.reshape(n, -1), col("run")


def _candidate_batches(t: float) -> Callable:
    """Of each task, the rows that are part of a pair to be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_tasks(batches):
            i, j = _pairs(*_arrays(table), t)
            keep = np.unique(np.concatenate((i, j)))
            if len(keep):
                yield from table.take(pa.array(keep)).cast(_TASK_ARROW).to_batches()

    return run


def _set_batches(n: int) -> Callable:
    """The rows asked for in ``want`` with the set of the document, if the text is the class's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column("text"))
            want = batch.column("want")
            for i, j in chunks(at, PIECE):
                cls, s, off = shingle_sets(data, at, i, j, n)
                part = want.slice(i, j - i)
                asked = pa.RecordBatch.from_struct_array(part.flatten())
                row = np.repeat(np.arange(j - i), pc.list_value_length(part).to_numpy())
                own, place = buffers(asked.column("cls"))
                ok = (own[place[0] : place[-1]].reshape(-1, 16) == cls.view(np.uint8).reshape(j - i, 16)[row]).all(1)
                asked, row = asked.filter(pa.array(ok)), row[ok]
                if asked.num_rows:
                    sets = pa.array([s[off[k] : off[k + 1]].tobytes() for k in range(j - i)], pa.binary()).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*(asked.column(k).cast(t) for k, t in zip(_TASK_ARROW.names, _TASK_ARROW.types, strict=True)), sets], names=[*_TASK_ARROW.names, "shingles"])

    return run


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sorted ``sets`` i and j. Many pairs are counted by matrix products."""
    if len(i) <= 3 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    ok = count[token] > 1
    row, token, width = row[ok], shared[token[ok]], int((count > 1).sum())
    total = np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, width, 4096):
        x = np.zeros((len(sets), min(4096, width - a)), np.float32)
        part = (token >= a) & (token < a + 4096)
        x[row[part], token[part] - a] = 1
        total += x @ x.T
    return total[i, j].astype(np.int64)


def _connected(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row that the pairs connect it to."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verify_batches(t: float) -> Callable:
    """Per class of a task: its links there, and the smallest class that they connect it to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_tasks(batches):
            task, block, *_ = _arrays(table)
            own, at = buffers(table.column("cls"))
            kinds = np.rec.fromarrays([task, block, *own[at[0] : at[-1]].reshape(-1, 16).copy().view(np.uint64).T])
            table = table.take(pa.array(np.sort(np.unique(kinds, return_index=True)[1])))  # repeated rows of the input bring a class again
            task, *rest = _arrays(table)
            i, j = _pairs(task, *rest, t)
            if not len(i):
                continue
            data, at = buffers(table.column("shingles"))
            sets = [data[at[k] : at[k + 1]].view(np.uint64) for k in range(table.num_rows)]
            size = np.diff(at) // 8
            both = np.zeros(len(i), np.int64)
            order = np.argsort(task[i], kind="stable")
            for pairs in np.split(order, np.flatnonzero(np.diff(task[i][order])) + 1):
                rows, local = np.unique(np.concatenate((i[pairs], j[pairs])), return_inverse=True)
                both[pairs] = overlaps([sets[k] for k in rows], *np.split(local, 2))
            ok = both >= t * (size[i] + size[j] - both) - 1e-9
            i, j = i[ok], j[ok]
            links, docs = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
            copies = table.column("copies").to_numpy()
            for a, b in ((i, j), (j, i)):
                np.add.at(links, a, 1)
                np.add.at(docs, a, copies[b])
            keep = np.flatnonzero(links)
            if len(keep):
                cls = table.column("cls").combine_chunks()
                yield pa.RecordBatch.from_arrays(
                    [cls.take(pa.array(keep)), cls.take(pa.array(_connected(len(sets), i, j)[keep])), pa.array(links[keep]), pa.array(docs[keep])], names=["cls", "root", "links", "docs"]
                )

    return run


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, n: int = WORDS, bucket: int = BUCKET, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text).

    class_id: smallest doc_id of the documents that links connect, copies included; copy_id: smallest
    doc_id of those with the same words; n_copies: how many those are; n_links: how many other
    classes of copies are at least as similar as ``threshold``; n_linked: how many documents those hold.
    """
    return jaccard_rows(docs, threshold, n, bucket, depth, recall).drop("tid", "kept")


def jaccard_rows(docs: DataFrame, threshold: float = THRESHOLD, n: int = WORDS, bucket: int = BUCKET, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """``jaccard_join`` with tid, the hash of the text, and kept: of the rows that links connect, the one with the
    smallest doc_id (null last), then tid, is kept; rows without words all are. Repetitions of one row share kept."""
    runs = runs_for(threshold, depth, recall)
    docs = docs.select("doc_id", "text", F.xxhash64(nvl_text("text")).alias("tid"))
    sketches = stored(docs.mapInArrow(_sketch_batches(n, runs, depth), SKETCH), "sketches")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tid").alias("r")
    reps = sketches.where("n > 0").groupBy("cls").agg(F.min(first).alias("r"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("n", "keys", "sig")))
    reps = stored(reps, "reps")
    found = leaves(reps.select("cls", "keys"), runs, depth, bucket)
    own = found.groupBy("cls").agg(F.map_from_entries(F.collect_list(F.struct("run", F.struct("leaf", "size").alias("x")))).alias("m"))
    rows = reps.select("cls", "r.doc_id", "r.tid", "copies", "n", "sig").join(own, "cls")
    rows = rows.withColumn("leaves", F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.coalesce(F.try_element_at("m", r)["leaf"], F.lit(0).cast("long"))))
    rows = rows.select("*", F.explode("m").alias("run", "x")).select("*", "x.leaf", F.ceil(F.col("x.size") / bucket).cast("int").alias("blocks"))
    rows = rows.withColumn("block", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("cls"), F.col("blocks"))).otherwise(0).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"b1": F.least("block", "other"), "b2": F.greatest("block", "other")})
    columns = _TASK_ARROW.names
    candidates = rows.select(*columns).repartition(*TASK_KEY).sortWithinPartitions(*TASK_KEY).mapInArrow(_candidate_batches(threshold), TASK)
    want = candidates.groupBy("doc_id", "tid").agg(F.collect_list(F.struct(*columns)).alias("want"))
    # Rows without an id are found by their text, of which one is enough.
    texts = docs.where("doc_id is not null").unionByName(docs.where("doc_id is null").groupBy("tid").agg(F.first("text").alias("text")), allowMissingColumns=True)
    sets = texts.join(want, texts.doc_id.eqNullSafe(want.doc_id) & (texts.tid == want.tid)).select("text", "want").mapInArrow(_set_batches(n), f"{TASK}, shingles binary")
    links = stored(sets.repartition(*TASK_KEY).sortWithinPartitions(*TASK_KEY).mapInArrow(_verify_batches(threshold), "cls binary, root binary, links long, docs long"), "links")
    roots = components(links.select(F.col("cls").alias("u"), F.col("root").alias("v")))
    counted = links.groupBy("cls").agg(F.sum("links").alias("n_links"), F.sum("docs").alias("n_linked"))
    info = reps.select("cls", "r", F.col("copies").alias("n_copies"))
    info = info.join(counted, "cls", "left").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    groups = info.where("root is not null").groupBy("root").agg(F.min("r").alias("g"))
    info = info.join(groups, "root", "left").select("cls", F.col("r.doc_id").alias("copy_id"), "n_copies", F.coalesce("g", "r").alias("g"), "n_links", "n_linked")
    info = stored(info, "classes")
    out = sketches.select("doc_id", "tid", "cls", "n").join(info.withColumn("worded", F.lit(True)), (sketches.cls == info.cls) & (sketches.n > 0), "left")
    stays = F.col("doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("tid") == F.col("g.tid"))
    return out.select(
        "doc_id",
        F.when(F.col("worded"), F.col("g.doc_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(F.col("worded"), F.col("copy_id")).otherwise(F.col("doc_id")).alias("copy_id"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        "tid",
        F.when(F.col("worded"), stays).otherwise(F.lit(True)).alias("kept"),
    )


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read_table(spark, sf_dir, "documents"))
