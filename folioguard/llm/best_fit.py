"""Operator 13: best-fit packing by a grouping genetic algorithm on islands.

Documents become token ids (a public tokenizer and an end id) and pieces of at most ``size`` tokens; only
longer documents are cut. A text is split at blanks and at borders that no token crosses; each
distinct part is encoded once by the tokenizer itself and texts are put together from the parts' ids.
Texts that hold the string of a special token are encoded whole.

Pieces of full length are sequences of their own. All others are dealt out to shards of about ``shard``
pieces. Each shard is packed by ``islands`` populations, each in a task of its own. A chromosome gives
every piece its bin. Crossover injects whole well-filled bins of one parent into the other, takes out
the bins that held the same pieces, and puts displaced pieces where they fit best; mutation dissolves the
emptiest bin and some others. After each epoch an island's elite moves to the next one of its shard.
A shard ends early once it needs no more bins than the lower bound L2 of Martello and Toth. Then each shard
gives back its emptiest bins, one in ``GIVE_BACK`` and one at least, and these pieces are dealt out and packed anew, until
one shard holds them. So each shard's last, half-filled bin is filled up by others'.

Null and empty texts hold the end id alone. Repeated rows are packed one by one; doc_id may be null. No rows give no
rows. Columns with clashing names are ignored. Sequence ids have no order and no gapless numbers.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioguard.llm.common import LOWER, buffers, chunks, nvl_text, read_table, stored

SIZE = 4096
END = 1
SHARD = 8192
ISLANDS = 2
POPULATION = 6
GENERATIONS = 12
EPOCHS = 3
GIVE_BACK = 10
#: Distinct parts whose ids a Python worker remembers; beyond that it forgets all and starts anew.
REMEMBERED = 1_000_000
PIECE = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"
STATE = "shard long, island int, uids binary, lengths binary, population binary, best binary, bins int, filled double, done boolean"

SPACE, DIGIT, LETTER, SIGN, QUOTE, OTHER = range(6)


def _kinds() -> np.ndarray:
    kind = np.full(256, OTHER, np.uint8)
    kind[:128] = SIGN
    kind[[9, 10, 11, 12, 13, 32]] = SPACE
    kind[48:58] = DIGIT
    kind[65:91] = kind[97:123] = LETTER
    kind[39] = QUOTE
    return kind


KIND = _kinds()


def _splits() -> np.ndarray:
    """Whether a token always ends between bytes of two kinds: digits are single tokens, words hold letters only, and
    runs of signs end at a letter, unless the sign is the quote of a contraction. Beside other bytes nothing is known."""
    out = np.zeros((6, 6), bool)
    out[SPACE], out[:, SPACE] = True, True
    out[DIGIT, :OTHER] = out[:OTHER, DIGIT] = True
    out[LETTER, [SIGN, QUOTE]] = out[SIGN, LETTER] = True
    return out


#: By the kinds of two neighbouring bytes, 8 * left + right.
SPLITS = np.pad(_splits(), ((0, 2), (0, 2))).ravel()
#: What byte-level models call each byte: printable Latin-1 as it is, the others from U+0100 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_NAMES = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in set(_SHOWN))}


class PartEncoder:
    """Token ids of many texts at once, by a dictionary of their parts."""

    def __init__(self, path: str | None):
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.starts, self.sizes = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def _plain(self, part: bytes) -> str | None:
        """The part as the model sees it, if it is one word of Latin letters that normalising only lower-cases."""
        if part.isalpha():  # ASCII, lower-cased before
            return part.decode()
        text = part.decode()
        if text.isalpha() and max(text) < "\u0250" and "\u0130" not in text:
            return text.lower().encode().decode("latin-1").translate(BYTE_NAMES)
        return None

    def _learn(self, parts: list[bytes]) -> None:
        """Plain words go to the tokenizer's model, all others through the whole tokenizer, which takes four times as long."""
        words = [self._plain(p) for p in parts]
        rest = iter(self.tokenizer.encode_batch([p.decode() for p, w in zip(parts, words) if w is None], add_special_tokens=False))
        tokenize = self.tokenizer.model.tokenize
        encoded = [next(rest).ids if w is None else [t.id for t in tokenize(w)] for w in words]
        sizes = np.array([len(e) for e in encoded], np.int64)
        flat, n = np.array([i for e in encoded for i in e], np.uint32), len(self.known)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while n + len(parts) > len(self.starts):
            self.starts, self.sizes = (np.concatenate((a, np.zeros_like(a))) for a in (self.starts, self.sizes))
        self.ids[self.used : self.used + len(flat)] = flat
        self.starts[n : n + len(parts)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[n : n + len(parts)] = sizes
        self.used += len(flat)
        self.known.update((p, n + k) for k, p in enumerate(parts))

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, and where each text's ids start (n + 1 places)."""
        x, own = data[at[0] : at[-1]], at - at[0]
        if not len(x):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        kind = KIND[x]
        keep = kind != SPACE
        first = np.empty(len(x), bool)
        first[0] = True
        first[1:] = SPLITS[(kind[:-1] << 3) | kind[1:]]
        first[own[:-1][own[:-1] < len(x)]] = True
        first = np.flatnonzero(first & keep)
        packed = LOWER[x[keep]]
        offsets = np.append(np.cumsum(keep, dtype=np.int32)[first] - 1, len(packed)).astype(np.int32)
        parts = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]).dictionary_encode()
        distinct = parts.dictionary.to_pylist()
        if len(self.known) + len(distinct) > REMEMBERED:
            self.forget()
        if new := [p for p in distinct if p not in self.known]:
            self._learn(new)
        code = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[parts.indices.to_numpy()]
        sizes = self.sizes[code]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.starts[code] - (ends - sizes), sizes) + np.arange(total)]
        return ids, np.concatenate(([0], ends))[np.searchsorted(first, own)]


def _piece_batches(path: str | None, size: int, end: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail = PartEncoder(path), np.array([end], "<u4")
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            data, at = buffers(batch.column("text"))
            whole = np.zeros(len(batch), bool)
            for s in encoder.special:
                whole |= pc.fill_null(pc.match_substring(batch.column("text"), s), False).to_numpy(zero_copy_only=False)
            for i, j in chunks(at, 4 << 20):
                ids, starts = encoder.encode(data, at[i : j + 1])
                rows: list[tuple] = []
                for k in range(i, j):
                    own = ids[starts[k - i] : starts[k - i + 1]]
                    if whole[k]:
                        own = np.array(encoder.tokenizer.encode(batch.column("text")[k].as_py(), add_special_tokens=False).ids, np.uint32)
                    own = np.concatenate((own, tail)).astype("<u4")
                    rows += ((k, p, a, min(size, len(own) - a), zlib.crc32(own[a : a + size].tobytes())) for p, a in enumerate(range(0, len(own), size)))
                row, piece, start, length, crc = map(np.array, zip(*rows))
                uids = uid + np.arange(len(row))
                uid += len(row)
                columns = [pa.array(uids), batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["uid", "doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """uid, doc_id, piece, start, length, ids_crc32 of every piece. uid tells rows apart as long as the result is stored, not computed twice."""
    return docs.select("doc_id", nvl_text("text").alias("text")).mapInArrow(_piece_batches(tokenizer, size, end), PIECE)


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """L2 of Martello and Toth: bins that any packing needs."""
    big, small = np.sort(lengths[2 * lengths > size]), np.sort(lengths[2 * lengths <= size])
    up_to = [np.concatenate(([0], np.cumsum(x))) for x in (big, small)]
    k = np.concatenate(([0], np.unique(small)))
    beside = np.searchsorted(big, size - k, side="right")  # large pieces with room for one of length k
    room = beside * size - up_to[0][beside]
    rest = up_to[1][-1] - up_to[1][np.searchsorted(small, k)]
    return len(big) + max(0, int((-(-(rest - room) // size)).max()))


class Packer:
    """One island: chromosomes of the pieces of a shard, whose lengths are in descending order."""

    def __init__(self, lengths: np.ndarray, size: int, seed: list[int]):
        self.lengths, self.size, self.rng = lengths, size, np.random.default_rng(seed)
        self.list, self.bound = lengths.tolist(), lower_bound(lengths, size)

    def fills(self, bins: np.ndarray) -> np.ndarray:
        return np.bincount(bins, self.lengths).astype(np.int64)

    def fitness(self, bins: np.ndarray) -> tuple[int, float]:
        """Fewer bins first, then fuller ones."""
        fill = self.fills(bins) / self.size
        return -len(fill), float((fill * fill).sum())

    def put(self, bins: np.ndarray, items: np.ndarray, fill: np.ndarray) -> np.ndarray:
        """Put ``items``, in their order, into the bin with the least room that suffices, or into a new one."""
        free = sorted(((self.size - f) << 24) | k for k, f in enumerate(fill.tolist()) if f < self.size)
        n, to = len(fill), []
        for i in items.tolist():
            length = self.list[i]
            k = bisect_left(free, length << 24)
            if k < len(free):
                room, b = free[k] >> 24, free[k] & 0xFFFFFF
                del free[k]
            else:
                room, b, n = self.size, n, n + 1
            to.append(b)
            if room > length:
                insort(free, ((room - length) << 24) | b)
        bins[items] = to
        return bins

    def start(self, count: int) -> list[np.ndarray]:
        """Best fit by descending length, then in other orders: lengths blurred more and more."""
        n, out = len(self.lengths), []
        for k in range(count):
            order = np.arange(n) if not k else np.argsort(-self.lengths * self.rng.uniform(1 - k / count, 1, n), kind="stable")
            out.append(self.put(np.empty(n, np.int64), order, np.zeros(0, np.int64)))
            if not k and out[0].max() + 1 <= self.bound:
                break
        return out

    def _without(self, bins: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``bins`` renumbered without the bins in ``gone`` (-1 for their pieces), and what fills the rest."""
        number = np.where(gone, -1, np.cumsum(~gone) - 1)
        return number[bins], self.fills(bins)[~gone]

    def crossover(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        fill = self.fills(b)
        picked = (fill >= np.median(fill)) & (self.rng.random(len(fill)) < 0.3)
        injected = picked[b]
        hit = np.zeros(int(a.max()) + 1, bool)
        hit[a[injected]] = True
        child, rest = self._without(a, hit)
        child[injected] = len(rest) + (np.cumsum(picked) - 1)[b[injected]]
        return self.put(child, np.flatnonzero(child < 0), np.concatenate((rest, fill[picked])))

    def mutate(self, bins: np.ndarray) -> np.ndarray:
        fill = self.fills(bins)
        gone = self.rng.random(len(fill)) < 2 / len(fill)
        gone[np.argmin(fill)] = True
        child, rest = self._without(bins, gone)
        return self.put(child, np.flatnonzero(child < 0), rest)

    def evolve(self, population: list[np.ndarray], generations: int, count: int) -> list[np.ndarray]:
        """The population, best first, after ``generations`` times ``count`` children, or once a chromosome meets the bound."""
        ranked = sorted(((self.fitness(p), k, p) for k, p in enumerate(population)), key=lambda r: (r[0], -r[1]), reverse=True)
        made = len(ranked)
        for _ in range(generations * count):
            if -ranked[0][0][0] <= self.bound or len(ranked) < 2:
                break
            a, b = (min(self.rng.integers(0, len(ranked), 2)) for _ in "ab")
            child = self.crossover(ranked[a][2], ranked[b][2]) if a != b else ranked[a][2]
            child = self.mutate(child)
            made += 1
            entry = (self.fitness(child), made, child)
            if entry[0] > ranked[-1][0] and all(entry[0] != r[0] for r in ranked):
                ranked[-1] = entry
                ranked.sort(key=lambda r: (r[0], -r[1]), reverse=True)
        return [r[2] for r in ranked]


def _shards(rows: pd.DataFrame) -> pd.DataFrame:
    """One row for a shard: its pieces in descending order of length, as bytes."""
    rows = rows.sort_values(["length", "uid"], ascending=[False, True])
    return pd.DataFrame({"shard": [rows.shard.iloc[0]], "uids": [rows.uid.to_numpy(np.int64).tobytes()], "lengths": [rows.length.to_numpy(np.int32).tobytes()]})


def _island_batches(size: int, population: int, generations: int, epoch: int) -> Callable:
    """Start or go on with each island's population; the elite of another island, if any, joins it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if not row["done"]:
                    lengths = np.frombuffer(row["lengths"], np.int32).astype(np.int64)
                    packer = Packer(lengths, size, [row["shard"], row["island"], epoch])
                    own = row["population"]
                    own = [np.array(p, np.int64) for p in np.frombuffer(own, np.int32).reshape(-1, len(lengths))] if own else packer.start(population)
                    if row.get("elite"):
                        own.append(np.frombuffer(row["elite"], np.int32).astype(np.int64))
                    own = packer.evolve(own, generations, population)[:population]
                    bins, filled = packer.fitness(own[0])
                    row |= {"population": np.array(own, np.int32).tobytes(), "best": own[0].astype(np.int32).tobytes(), "bins": -bins, "filled": filled, "done": -bins <= packer.bound}
                columns = [f.strip().split() for f in STATE.split(",")]
                kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
                yield pa.RecordBatch.from_arrays([pa.array([row[n]], kinds[k]) for n, k in columns], names=[n for n, _ in columns])

    return run


def _placed_batches(size: int, round_no: int, last: bool) -> Callable:
    """Each piece's sequence and offset; ``again`` for pieces of the bins that a shard gives back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                uids, lengths, bins = (np.frombuffer(row[n], t) for n, t in (("uids", np.int64), ("lengths", np.int32), ("best", np.int32)))
                order = np.argsort(bins, kind="stable")
                fill = np.bincount(bins, lengths).astype(np.int64)
                before = np.cumsum(lengths[order], dtype=np.int64) - lengths[order]
                offset = before - (np.cumsum(fill) - fill)[bins[order]]
                back = np.zeros(len(fill), bool)
                if not last:
                    back[np.argsort(fill, kind="stable")[: max(1, len(fill) // GIVE_BACK)]] = True
                sequence = (round_no << 56) + (row["shard"] << 20) + bins[order].astype(np.int64)
                columns = [uids[order], lengths[order].astype(np.int64), sequence, offset, back[bins[order]]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["uid", "length", "sequence_id", "offset", "again"])

    return run


def packed_shards(short: DataFrame, shards: int, round_no: int, size: int, islands: int, population: int, generations: int, epochs: int) -> DataFrame:
    """uid, length, sequence_id, offset, again of one round over ``short`` (uid, length)."""
    rows = short.select(F.pmod(F.xxhash64("uid", F.lit(round_no)), F.lit(shards)).alias("shard"), "uid", "length")
    state = rows.groupBy("shard").applyInPandas(_shards, "shard long, uids binary, lengths binary")
    state = state.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    state = state.select("*", F.lit(None).cast("binary").alias("population"), F.lit(None).cast("binary").alias("elite"), F.lit(False).alias("done"))
    for epoch in range(epochs):
        state = stored(state.repartition("shard", "island").mapInArrow(_island_batches(size, population, generations, epoch), STATE), "islands")
        # A shard is done as soon as one of its islands is.
        ended = state.groupBy("shard").agg(F.bool_or("done").alias("ended"))
        if epoch == epochs - 1 or ended.where("not ended").isEmpty():
            break
        elites = state.select("shard", ((F.col("island") + 1) % islands).alias("island"), F.col("best").alias("elite"))
        state = state.drop("done").join(ended.withColumnRenamed("ended", "done"), "shard").join(elites, ["shard", "island"])
    best = state.groupBy("shard").agg(F.max_by(F.struct("uids", "lengths", "best"), F.struct(-F.col("bins"), F.col("filled"), -F.col("island"))).alias("r"))
    schema = "uid long, length long, sequence_id long, offset long, again boolean"
    return stored(best.select("shard", "r.*").mapInArrow(_placed_batches(size, round_no, shards == 1), schema), "placed")


def best_fit_pack(
    docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end: int = END, shard: int = SHARD,
    islands: int = ISLANDS, population: int = POPULATION, generations: int = GENERATIONS, epochs: int = EPOCHS,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row of ``docs``."""
    cut = stored(pieces(docs, tokenizer, size, end), "pieces")
    full, short = cut.where(F.col("length") >= size), cut.where(F.col("length") < size)
    placed, rest, n, round_no = None, short.select("uid", "length"), short.count(), 1
    while n:
        shards = max(1, n // shard)
        done = packed_shards(rest, shards, round_no, size, islands, population, generations, epochs)
        rest = done.where("again").select("uid", "length")
        left = rest.count()
        if left > 0.9 * n:  # nothing would be won by dealing the same pieces out again
            left, final = 0, done
        else:
            final = done.where("not again")
        final = final.select("uid", "sequence_id", "offset")
        placed, n, round_no = final if placed is None else placed.unionByName(final), left, round_no + 1
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    out = full.select(*columns, (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return out if placed is None else out.unionByName(short.join(placed, "uid").select(*columns, "sequence_id", "offset"))


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(read_table(spark, sf_dir, "documents"))
