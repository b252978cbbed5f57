"""Operator 1: removal of repeated substrings with a collection BWT built column by column.

A byte goes if a string of ``width`` bytes that covers it also starts anywhere else. Three steps
make that exact and bounded:

1. Routing. Each window of ``width`` bytes belongs to its minimizer, the ``K``-gram with the
   smallest hash inside it (leftmost of ties). That is a function of the window's bytes, so equal
   windows share the minimizer and its offset. Consecutive windows with one minimizer form a
   segment of at most 2 * width - K bytes; every window lies in exactly one segment.
2. Segments whose minimizer occurs twice or more are collapsed to distinct ones and, whole
   minimizers together, form document collections of bounded size. Each collection's BWT and common
   prefixes are built column-wise: all segments are aligned at the minimizer, and each round
   inserts one symbol of every segment. A round reads the file that the last one wrote, front to back: the
   BWT (the symbol before each suffix, in the order of suffixes), common prefixes and segment numbers. The
   BWT decides: its stable partition by symbol is the order of the suffixes that begin one column
   earlier, and range minima of the prefixes give theirs. The round writes the next file with the BWT of that column,
   whose symbols come from files of the segments' own columns, read front to back as well. All files lie in the
   shared folder; in memory are one column (a few bytes a segment) and the repeats found. As equal windows
   always stand in the same column, suffixes of different columns need not be interleaved: a file is the part of the
   collection's BWT that belongs to its column.
3. Windows with a common prefix of ``width`` with a neighbour, or in a segment that occurs more
   than once, are repeated; their runs go back to the documents by join.

A minimizer with more than ``hot`` distinct segments (one line in a third of all documents) is dealt
out again by the hash of each single window, which collapses fully.

Null and empty texts: nothing is removed. Rows that repeat a doc_id stay apart by their text; equal
rows count as separate occurrences and get the same result; however many they are, two of them go through the
three steps, and the result is joined back to all. Columns of the input with clashing names
are ignored; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioguard.llm.common import Rolling, buffers, chunks, mix, nvl_text, read_table, scratch, stored, table64

WIDTH = 200
#: Length of the minimizing substrings: 2**5.
K = 32
#: Most distinct segments of one minimizer in a collection (about 60 MB); more are dealt out by window.
HOT = 50_000
#: Segments in a collection, but for the rest of its last minimizer; a round's file has 8 bytes for each.
BATCH = 32_768
#: Segments in one file of columns, and entries that are read at a time.
BLOCK = 4096
PIECE = 1 << 16
SLICE = 1 << 19
SEGMENT = "doc_id long, tid long, start long, n int, lead int, key long, h long"


def _minimizers(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window start of ``x``: place of the window's minimizer; and the hash at each place."""
    h, step, base = table64(11)[x], 1, int(table64(12, 1)[0])
    while step < K:
        h = h[:-step] * np.uint64(base) + h[step:]
        base, step = base * base & ((1 << 64) - 1), step * 2
    h = mix(h)
    w, n = width - K + 1, len(h)
    packed = (h & ~np.uint64((1 << 20) - 1)) | np.arange(n, dtype=np.uint64)
    rows = -(-n // w)
    a = np.full(rows * w, np.uint64((1 << 64) - 1))
    a[:n] = packed
    a = a.reshape(rows, w)
    ahead = np.minimum.accumulate(a, axis=1).ravel()
    back = np.minimum.accumulate(a[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - w + 1
    return (np.minimum(back[:m], ahead[w - 1 : w - 1 + m]) & np.uint64((1 << 20) - 1)).astype(np.int64), h


def segments(x: np.ndarray, at: np.ndarray, width: int, rolling: Rolling) -> tuple[np.ndarray, ...]:
    """Row, start in the row, windows, minimizer's offset, minimizer and content hash of each segment."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(x) < width:
        return none
    place, h = _minimizers(x, width)
    p = np.arange(len(place))
    row = np.searchsorted(at, p, side="right") - 1
    good = p + width <= at[row + 1]
    new = good & np.concatenate(([True], (place[1:] != place[:-1]) | (row[1:] != row[:-1]) | ~good[:-1]))
    a = np.flatnonzero(new)
    if not len(a):
        return none
    n = np.add.reduceat(good, a)
    key = h[place[a]]
    return row[a], a - at[row[a]], n, place[a] - a, key, rolling.of(rolling.sums(x), a, a + n + width - 1)


def _windows(x: np.ndarray, at: np.ndarray, width: int, rolling: Rolling, other: Rolling) -> tuple[np.ndarray, ...]:
    """As ``segments``, with a segment for each window and its content hash as minimizer."""
    p = np.arange(max(0, len(x) - width + 1))
    row = np.searchsorted(at, p, side="right") - 1
    p, row = (v[p + width <= at[row + 1]] for v in (p, row))
    one = np.ones(len(p), np.int64)
    return row, p - at[row], one, one * 0, other.of(other.sums(x), p, p + width), rolling.of(rolling.sums(x), p, p + width)


def _slices(data: np.ndarray, at: np.ndarray, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, offset in it, bytes and offsets of pieces of about SLICE bytes; long texts are cut with overlap."""
    for i, j in chunks(at, SLICE):
        if j - i > 1 or at[j] - at[i] <= SLICE:
            yield i, 0, data[at[i] : at[j]], at[i : j + 1] - at[i]
            continue
        n = int(at[j] - at[i])
        for s in range(0, max(1, n - width + 1), SLICE):
            x = data[at[i] + s : min(at[i] + s + SLICE + width - 1, at[j])]
            yield i, s, x, np.array([0, len(x)])


def _rows(batch: pa.RecordBatch, parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    row, start, n, lead, key, h = (np.concatenate(v) for v in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 6
    take = pa.array(row, pa.int64())
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id").take(take), batch.column("tid").take(take), pa.array(start, pa.int64()), pa.array(n, pa.int32()), pa.array(lead, pa.int32())]
        + [pa.array(v.astype(np.uint64).view(np.int64), pa.int64()) for v in (key, h)],
        names=["doc_id", "tid", "start", "n", "lead", "key", "h"],
    )


def _segment_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(21, SLICE + 2 * width)
        for batch in batches:
            data, at = buffers(batch.column("text"))
            for i, s, x, own in _slices(data, at, width):
                r = segments(x, own, width, rolling)
                if len(r[0]):
                    yield _rows(batch, [(r[0] + i, r[1] + s, *r[2:])])

    return run


def _cut(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, pa.StructArray, np.ndarray, np.ndarray]]:
    """Rows, segments, bytes and offsets of the segments in the batch's column ``want``, some thousands at a time."""
    data, at = buffers(batch.column("text"))
    want = batch.column("want")
    row, flat = np.repeat(np.arange(len(want)), pc.list_value_length(want).to_numpy()), want.flatten()
    for k in range(0, len(flat), 4 * BLOCK):
        part, r = flat.slice(k, 4 * BLOCK), row[k : k + 4 * BLOCK]
        a = at[r] + part.field("start").to_numpy()
        size = part.field("n").to_numpy() + width - 1
        off = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        yield r, part, data[np.arange(off[-1]) + np.repeat(a - off[:-1], size)], off


def _window_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, other = Rolling(31, 1 << 22), Rolling(41, 1 << 22)
        for batch in batches:
            for row, part, x, off in _cut(batch, width):
                if len(x) >= len(rolling.power):
                    rolling, other = Rolling(31, len(x)), Rolling(41, len(x))
                r = _windows(x, off, width, rolling, other)
                yield _rows(batch, [(row[r[0]], r[1] + part.field("start").to_numpy()[r[0]], *r[2:])])

    return run


def _string_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part, x, off in _cut(batch, width):
                s = pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])
                names = ("key", "h", "count", "n", "lead")
                yield pa.RecordBatch.from_arrays([*(part.field(k) for k in names), s], names=[*names, "s"])

    return run


class Collection:
    """A document collection in files of the shared folder, and the rounds that build its BWT column by column.

    Texts stand so that their offset ``lead`` falls into one column. Symbols are byte + 1; 0 is no symbol.
    Files are written and read front to back; they are gone on exit.
    """

    def __init__(self, folder: str, width: int):
        self.fs, path = fs.FileSystem.from_uri(folder)
        self.path, self.width = f"{path}/{uuid.uuid4().hex}", width
        self.left, self.columns = width - K, 2 * width - K
        self.blocks: list[int] = []
        self.parts: list[tuple[np.ndarray, ...]] = []

    def __enter__(self):
        self.fs.create_dir(self.path, recursive=True)
        return self

    def __exit__(self, *_):
        self.fs.delete_dir(self.path)

    def __len__(self) -> int:
        return sum(self.blocks)

    def add(self, info: tuple[np.ndarray, ...], data: np.ndarray, at: np.ndarray) -> None:
        """Texts with their ``info`` (key, h, count, n, lead); their symbols go to files of columns, the last column first."""
        for i in range(0, len(at) - 1, BLOCK):
            j = min(i + BLOCK, len(at) - 1)
            part = tuple(v[i:j] for v in info)
            size = np.diff(at[i : j + 1])
            row = np.repeat(np.arange(j - i), size)
            column = self.left - part[4][row] + np.arange(at[j] - at[i]) - (at[i:j] - at[i])[row]
            x = np.zeros((self.columns, j - i), np.uint16)
            x[self.columns - 1 - column, row] = data[at[i] : at[j]].astype(np.uint16) + 1
            with self.fs.open_output_stream(f"{self.path}/columns{len(self.blocks)}") as out:
                out.write(x.tobytes())
            self.blocks.append(j - i)
            self.parts.append(part)

    def _write(self, c: int, bwt: np.ndarray, lcp: np.ndarray, text: np.ndarray) -> None:
        with self.fs.open_output_stream(f"{self.path}/bwt{c}") as out:
            for i in range(0, len(bwt), PIECE):
                for v, t in ((bwt, np.uint16), (lcp, np.int16), (text, np.int32)):
                    out.write(v[i : i + PIECE].astype(t).tobytes())

    def _read(self, c: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts, left = [], len(self)
        with self.fs.open_input_stream(f"{self.path}/bwt{c}") as f:
            while left:
                n = min(left, PIECE)
                parts.append([np.frombuffer(f.read(n * np.dtype(t).itemsize), t) for t in (np.uint16, np.int16, np.int32)])
                left -= n
        self.fs.delete_file(f"{self.path}/bwt{c}")
        return tuple(np.concatenate(v) for v in zip(*parts, strict=True))

    def rounds(self, first: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each column from the last to ``first``: its number, and the common prefixes (``width`` at most) and texts of its suffixes, in their order."""
        m = len(self)
        streams = [self.fs.open_input_stream(f"{self.path}/columns{k}") for k in range(len(self.blocks))]
        column = lambda: np.concatenate([np.frombuffer(f.read(2 * n), np.uint16) for f, n in zip(streams, self.blocks, strict=True)])
        try:
            self._write(self.columns, column(), np.zeros(m, np.int16), np.arange(m))
            for c in range(self.columns - 1, first - 1, -1):
                symbol, lcp, text = self._read(c + 1)
                before = column() if c else np.zeros(m, np.uint16)
                perm = np.argsort(symbol, kind="stable")
                lcp, text = _prefixes(symbol[perm], perm, lcp, self.width), text[perm]
                self._write(c, before[text], lcp, text)
                yield c, lcp, text
        finally:
            for f in streams:
                f.close()

    def repeats(self) -> pa.RecordBatch:
        """key, h and runs of repeated windows (struct<a, b>, b exclusive) of each text that has any.

        Columns come from the last on, so a text's runs are open until a window that is not repeated closes them.
        """
        key, h, count, n, lead = (np.concatenate(v) for v in zip(*self.parts, strict=True))
        end, out = np.full(len(self), -1), []
        first = self.left - int(lead.max())
        for c, lcp, text in self.rounds(first):
            full = lcp >= self.width
            twice = full | np.concatenate((full[1:], [False])) | (count[text] > 1)
            start = c - self.left + lead
            flag = np.zeros(len(end), bool)
            flag[text[twice]] = True
            flag &= (start >= 0) & (start < n)
            done = np.flatnonzero(~flag & (end >= 0))
            out.append((done, start[done] + 1, end[done]))
            end[done] = -1
            new = flag & (end < 0)
            end[new] = start[new] + 1
        done = np.flatnonzero(end >= 0)
        out.append((done, first - self.left + lead[done], end[done]))
        row, a, b = (np.concatenate(v) for v in zip(*out, strict=True))
        order = np.lexsort((a, row))
        row, a, b = row[order], a[order], b[order]
        at = np.searchsorted(row, np.arange(len(end) + 1))
        runs = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["a", "b"]))
        once = np.zeros(len(end), bool)
        once[np.unique(np.stack((key, h)), axis=1, return_index=True)[1]] = True  # repeated rows of the input bring a segment again
        batch = pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(h, pa.int64()), runs], names=["key", "h", "runs"])
        return batch.filter(pa.array(once & (np.diff(at) > 0)))


def _prefixes(symbol: np.ndarray, perm: np.ndarray, lcp: np.ndarray, width: int) -> np.ndarray:
    """Common prefixes of neighbours after the stable partition ``perm``: one more than the least of the last round's between them."""
    m = len(symbol)
    new = np.zeros(m, np.int16)
    same = np.flatnonzero((symbol[1:] == symbol[:-1]) & (symbol[1:] > 0)) + 1
    if not len(same):
        return new
    a, b = perm[same - 1] + 1, perm[same] + 1
    level = np.frexp((b - a).astype(np.float64))[1] - 1
    low = lcp
    for k in range(int(level.max()) + 1):
        if k:
            low = np.minimum(low[: len(low) - (1 << (k - 1))], low[1 << (k - 1) :])
        at = np.flatnonzero(level == k)
        new[same[at]] = np.minimum(low[a[at]], low[b[at] - (1 << k)])
    new[same] = np.minimum(new[same] + 1, width)
    return new


def _repeat_batches(width: int, folder: str, most: int):
    """Whole minimizers together, of about ``most`` segments, form a collection; the input is sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ExitStack() as stack:
            held, last = None, None
            for batch in batches:
                key, h, count, n, lead = (batch.column(k).to_numpy() for k in ("key", "h", "count", "n", "lead"))
                data, at = buffers(batch.column("s"))
                i = 0
                while i < len(key):
                    if held is not None and len(held) >= most and key[i] != last:
                        yield held.repeats()
                        stack.close()
                        held = None
                    if held is None:
                        held = stack.enter_context(Collection(folder, width))
                    # Up to the bound, and then to the end of the minimizer.
                    j = min(len(key), i + max(1, most - len(held)))
                    j += int(np.argmax(np.append(key[j:] != key[j - 1], True)))
                    held.add(tuple(v[i:j] for v in (key, h, count, n, lead)), data, at[i : j + 1])
                    last, i = key[j - 1], j
            if held is not None:
                yield held.repeats()

    return run


def _finish_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column("text"))
            removed, spans, digest = [], [], []
            for i, found in enumerate(batch.column("found").to_pylist()):
                text = data[at[i] : at[i + 1]]
                if not found:
                    removed.append(0), spans.append(0), digest.append(hashlib.sha256(text).hexdigest())
                    continue
                edge = np.zeros(len(text) + 1, np.int32)
                for f in found:
                    for r in f["runs"]:
                        edge[f["start"] + r["a"]] += 1
                        edge[f["start"] + r["b"] - 1 + width] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                digest.append(hashlib.sha256(text[~gone]).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return run


def _repeated(made: DataFrame, name: str) -> DataFrame:
    """The segments whose key occurs at least twice; counts are summed before the shuffle.

    The keys are written first: joined as a plain table, a hot key can be split by adaptive execution.
    """
    keys = stored(made.groupBy("key").count().where("count > 1").select("key"), "keys")
    return stored(made.join(keys, "key", "left_semi").select("doc_id", "tid", "start", "n", "lead", "key", "h"), name)


def _with_text(docs: DataFrame, wanted: DataFrame, struct: list[str]) -> DataFrame:
    """Each document that has wanted segments, with the list of them (a document's own, so bounded by its length)."""
    lists = wanted.groupBy("doc_id", "tid").agg(F.collect_list(F.struct(*struct)).alias("want"))
    on = docs.doc_id.eqNullSafe(lists.doc_id) & (docs.tid == lists.tid)
    return docs.join(lists, on).select(docs.doc_id, docs.tid, docs.text, lists.want)


def _twice_at_most(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, tid) with two of each row that is repeated: two are enough to make all its windows repeated ones.

    Rows that stand alone are not shuffled, and repetitions are reduced before they are.
    """
    again = docs.groupBy("doc_id", "tid").count().where("count > 1").select(F.col("doc_id").alias("_doc_id"), F.col("tid").alias("_tid"))
    again = stored(again, "again")
    if again.isEmpty():
        return docs
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("tid") == F.col("_tid"))
    one = docs.join(again, same, "left_semi").groupBy("doc_id", "tid").agg(F.first("text").alias("text"))
    two = one.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).select("doc_id", "text", "tid")
    return docs.join(again, same, "left_anti").unionByName(two)


def substring_dedup(docs: DataFrame, width: int = WIDTH, hot: int = HOT, batch: int = BATCH) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_bytes, n_removed, n_spans, kept_sha256.

    ``width`` must be at least 2 * K. ``hot`` and ``batch`` bound memory and do not change results.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", nvl_text("text").alias("text")).withColumn("tid", F.xxhash64("text"))
    folder = scratch(spark, "bwt")
    long_docs = _twice_at_most(docs.where(F.octet_length("text") >= width))
    found = _repeated(long_docs.mapInArrow(_segment_batches(width), SEGMENT), "segments")
    classes = found.groupBy("key", "h").agg(F.count("*").alias("count"), F.min(F.struct("doc_id", "tid", "start", "n", "lead")).alias("at"))
    classes = stored(classes.select("key", "h", "count", "at.*"), "classes")
    heavy = stored(classes.groupBy("key").count().where(F.col("count") > hot).select("key"), "heavy")
    if not heavy.isEmpty():
        again = found.join(heavy, "key", "left_semi")
        made = _with_text(long_docs, again, ["start", "n"]).mapInArrow(_window_batches(width), SEGMENT)
        found2 = _repeated(made, "windows")
        classes2 = found2.groupBy("key", "h").agg(F.count("*").alias("count"), F.min(F.struct("doc_id", "tid", "start", "n", "lead")).alias("at")).select("key", "h", "count", "at.*")
        found, classes = (a.join(heavy, "key", "left_anti").unionByName(b) for a, b in ((found, found2), (classes, classes2)))
    strings = _with_text(long_docs, classes, ["key", "h", "count", "start", "n", "lead"]).mapInArrow(_string_batches(width), "key long, h long, count long, n int, lead int, s binary")
    repeats = strings.repartition("key").sortWithinPartitions("key").mapInArrow(_repeat_batches(width, folder, batch), "key long, h long, runs array<struct<a:int,b:int>>")
    repeats = stored(repeats, "repeats")
    spans = found.join(repeats, ["key", "h"]).groupBy("doc_id", "tid").agg(F.collect_list(F.struct("start", "runs")).alias("found"))
    on = docs.doc_id.eqNullSafe(spans.doc_id) & (docs.tid == spans.tid)
    return docs.join(spans, on, "left").select(docs.doc_id, docs.text, spans.found).mapInArrow(
        _finish_batches(width), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read_table(spark, sf_dir, "documents"))
