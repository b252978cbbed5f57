"""Operator 7: toxicity of text restored from a noisy channel.

1. A character language model (trigrams over a-z, word edge and 'other') is counted over all documents;
   each task sends its partial counts, at most STATES**3 rows.
2. Words that writers may have disguised (digits and signs for letters at any place, spelled-out letters and
   signs with separators of any width, separators other than blanks in a word, repeated letters) are turned into a lattice of readings, and Viterbi search picks
   the reading with the best product of language model and channel. A word with one reading is its own
   decoding, so only words with a choice are searched.
3. Evidence is learned from labelled documents: whole words and word beginnings of 4 to 6 bytes, each with
   the lower bound of its precision for toxic documents. A document's value is the noisy-or of its
   distinct evidence in the restored text; isotonic regression on a fold of its own calibrates it.

Folds by crc32(doc_id as text) mod 5: 0 held out, 1 calibration, 2 to 4 evidence. At most ``sample``
labelled rows (about; by hash of doc_id) are learned from. lang, source, doc_id and labels are never
inputs of a score. Null and empty texts have no evidence; null labels are ignored; without both labels every
score is the share of label 1 (0.0 without any). Documents with the same evidence have the same score, in any
order of rows. A null doc_id is held out. Texts are read whole; repeated rows get a row each;
columns of the input with clashing names are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioguard.llm.common import LOWER, WORD, Rolling, buffers, chunks, mix, read_table, separated, stored
from folioguard.llm.quality import DECIMALS, SAMPLE, calibrated, fold, isotonic, labelled_sample

THRESHOLD = 0.5
PIECE = 1 << 20
BEGINNINGS = (4, 5, 6)
#: Evidence: least lower bound of its precision, and least number of documents.
LEAST, LEAST_DOCS, CAUTION = 0.3, 3, 6.0
STATES = 28
EDGE, OTHER = 0, 27
STATE = np.array([LOWER[b] - 96 if chr(b).isascii() and chr(b).isalpha() else OTHER if b >= 128 or 48 <= b <= 57 else EDGE for b in range(256)], dtype=np.int64)

#: The letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
#: Channel costs, in nats: a sign for a letter, a letter dropped from a run, one of a pair dropped, a separator
#: dropped in a spelled-out run and inside a word, a sign kept in a word, at its end, and standing alone.
COST_LEET, COST_RUN, COST_PAIR, COST_GAP, COST_SPLIT, COST_KEPT, COST_TAIL, COST_LONE = 0.5, 0.3, 6.0, 0.5, 3.0, 6.0, 2.0, 1.0
#: Signs that are punctuation at the beginning or end of a word, unless the model prefers a letter; at its end also
#: three equal ones. The model sees nothing of them but the word's edge.
PLAIN = "!|+"
PLAIN_END = re.compile(r"(?:[!|+]|([$@])\1\1+)+\Z")
_SIGN = "".join(map(re.escape, LEET))
_UNIT, _GAP, _MARK = f"[A-Za-z{_SIGN}]", rf"[^A-Za-z0-9{_SIGN}\x80-\U0010ffff]", rf"[^\x00-\x20A-Za-z0-9{_SIGN}\x7f-\U0010ffff]"
#: Letters, repeated or not, and signs with separators of any width between them.
SPELLED = re.compile(
    rf"(?:(?<![A-Za-z])(?i:(?P<first>[A-Za-z])(?P=first)*)|(?<![A-Za-z0-9])[{_SIGN}])(?:{_GAP}+(?:(?i:(?P<more>[A-Za-z])(?P=more)*)|[{_SIGN}])){{2,}}(?<![{_SIGN}](?=[0-9]))(?![A-Za-z])"
)
#: Words that hold a sign beside a letter, a letter twice in a row, or separators other than blanks.
SOLID = rf"(?<!{_UNIT})(?={_UNIT}*(?:[A-Za-z][{_SIGN}]|[{_SIGN}][A-Za-z]|(?i:(?P<twice>[a-z])(?P=twice))|[A-Za-z]{_MARK}+[A-Za-z])){_UNIT}+(?:{_MARK}+{_UNIT}+)*"
DISGUISED = re.compile(f"{SPELLED.pattern}|{SOLID}", re.ASCII)
_IS_LEET = np.array([chr(b) in LEET for b in range(256)])
_IS_LETTER = np.array([chr(b).isascii() and chr(b).isalpha() for b in range(256)])
#: Decodings of longer disguises are made alike, but not remembered.
REMEMBERED = 64


def _hits(x: np.ndarray) -> np.ndarray:
    """Bytes of which every disguise holds one, as each kind has one of these patterns."""
    letter, leet, word, low = _IS_LETTER[x], _IS_LEET[x], WORD[x] > 0, LOWER[x]
    unit = letter | leet
    gap = ~word & ~leet
    hit = np.zeros(len(x), bool)
    hit[1:] |= (letter[1:] & leet[:-1]) | (leet[1:] & letter[:-1]) | (letter[1:] & (low[1:] == low[:-1]))
    # A letter or sign between separators, as in the middle of a spelled-out run, and a separator inside a word.
    hit[1:-1] |= unit[1:-1] & gap[:-2] & gap[2:]
    hit[1:-1] |= gap[1:-1] & letter[:-2] & (x[1:-1] > 32) & (x[2:] > 32)
    return np.flatnonzero(hit)


def suspects(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows whose bytes may hold a disguise; no disguise escapes."""
    return np.unique(np.searchsorted(at, _hits(x), side="right") - 1)


def suspect_spans(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the parts of texts that may hold a disguise; each disguise lies in one of them.

    Texts are cut at blanks that no disguise reaches over. One with blanks in it has single letters or signs between them, repeated
    or not, so a blank beside two letters that differ is such a cut. A part keeps the blanks at its ends, because a disguise
    depends on the characters beside it.
    """
    hit = _hits(x)
    differ = np.zeros(len(x) + 4, bool)  # differ[k + 2]: the letters k and k + 1 of one text differ
    if len(x) > 1:
        letter, low = _IS_LETTER[x], LOWER[x]
        differ[2 : len(x) + 1] = letter[:-1] & letter[1:] & (low[:-1] != low[1:])
        differ[at[1:-1] + 1] = False
    blank = np.flatnonzero(x == 32)
    cut = blank[differ[blank] | differ[blank + 3]]
    begins, ends = np.sort(np.concatenate((at[:-1], cut))), np.sort(np.concatenate((at[1:], cut + 1)))
    b = begins[np.searchsorted(begins, hit, side="right") - 1]
    e = ends[np.searchsorted(ends, hit, side="right")]
    first = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))) if len(b) else np.zeros(0, np.int64)
    return b[first], e[first]


class Channel:
    """Viterbi decoding under the trigram model ``cost`` (negative logarithms, STATES x STATES x STATES)."""

    def __init__(self, cost: np.ndarray):
        self.cost = cost.tolist()
        self.seen: dict[str, str] = {}
        self.parts: dict[bytes, bytes] = {}

    def readings(self, text: str) -> list[list[tuple]]:
        """For each place of ``text``, the strings it may have meant, their costs, and the states that the model is to see for them, if others than their own."""
        lattice: list[list[tuple]] = []
        i, spaced = 0, bool(SPELLED.fullmatch(text))  # in spelled-out text a pair is a run
        head, end = len(text) - len(text.lstrip(PLAIN)), len(text.rstrip("".join(LEET)))
        tail = len(PLAIN_END.sub("", text))
        while i < len(text):
            c = text[i].lower()
            j = i + 1
            if c.isalpha():
                while j < len(text) and text[j].lower() == c:
                    j += 1
                lattice.append([(c, 0.0)] if j - i == 1 else [(c * 2, 0.0), (c, COST_PAIR)] if j - i == 2 and not spaced else [(c, COST_RUN), (c * 2, COST_RUN)])
            elif c in LEET:
                kept = (c, COST_LONE) if spaced else (c, 0.0, ()) if i < head or i >= tail else (c, COST_TAIL if i >= end else COST_KEPT)
                lattice.append([(a, COST_LEET) for a in LEET[c]] + [kept])
            else:
                while j < len(text) and not text[j].isalpha() and text[j] not in LEET:
                    j += 1
                lattice.append([("", COST_GAP if spaced else COST_SPLIT), (text[i:j], 0.0, (EDGE,))])
            i = j
        return lattice

    def decode(self, text: str) -> str:
        if text not in self.seen:
            if len(self.seen) > 100_000:
                self.seen.clear()
            if len(text) > REMEMBERED:
                return self._decode(text)
            self.seen[text] = self._decode(text)
        return self.seen[text]

    def _decode(self, text: str) -> str:
        # Readings so far are linked lists, so that paths share them and a long run costs linear time.
        paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(EDGE, EDGE): (0.0, None)}
        for choices in [*self.readings(text), [("\n", 0.0)]]:
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, done) in paths.items():
                for s, own, *state in choices:
                    total, p, q = cost + own, a, b
                    for k in state[0] if state else [OTHER if ch in LEET else EDGE if not ch.isalpha() else ord(ch) - 96 for ch in s]:
                        total += self.cost[p][q][k]
                        p, q = q, k
                    if (p, q) not in new or total < new[p, q][0]:
                        new[p, q] = (total, (done, s))
            paths = new
        least = min(cost for cost, _ in paths.values())
        return min(self._text(done) for cost, done in paths.values() if cost == least)[:-1]

    @staticmethod
    def _text(done: tuple | None) -> str:
        parts = []
        while done is not None:
            done, s = done
            parts.append(s)
        return "".join(reversed(parts))

    def restore(self, text: str) -> str:
        """``text`` with its disguises decoded; what reads as itself stays as it is written."""

        def read(m: re.Match) -> str:
            new = self.decode(m[0]) if re.search("[A-Za-z]", m[0]) else m[0]  # rows of single numbers stay
            return m[0] if new == m[0].lower() else new

        return DISGUISED.sub(read, text)

    def restore_part(self, part: bytes) -> bytes:
        """``restore`` of a part of a text."""
        new = self.parts.get(part)
        if new is None:
            text = part.decode("utf-8", "replace")
            read = self.restore(text)
            new = part if read == text else read.encode("utf-8")
            if len(self.parts) > 100_000:
                self.parts.clear()
            if len(part) <= REMEMBERED:
                self.parts[part] = new
        return new


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(STATES**3, np.int64)
    for batch in batches:
        data, at = buffers(batch.column("text"))
        for i, j in chunks(at, PIECE):
            s = STATE[separated(data, at, i, j)[0]]
            if len(s) > 2:
                total += np.bincount((s[:-2] * STATES + s[1:-1]) * STATES + s[2:], minlength=STATES**3)
    code = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(code, pa.int32()), pa.array(total[code], pa.int64())], names=["code", "n"])


def language_model(docs: DataFrame) -> np.ndarray:
    """Negative log probabilities of the third character after two, counted over all of ``docs``."""
    rows = docs.select("text").mapInArrow(_count_batches, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(STATES**3)
    n[rows.column("code").to_numpy()] = rows.column("n").to_numpy()
    n = n.reshape(STATES, STATES, STATES)
    two = n.sum(0)
    back = (two + 0.1) / (two.sum(1, keepdims=True) + 0.1 * STATES)
    return -np.log((n + 5 * back[None]) / (n.sum(2, keepdims=True) + 5))


def evidence_hashes(x: np.ndarray, own: np.ndarray, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of each word and word beginning of the separated texts ``x``."""
    low = LOWER[x]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], WORD[x], [0])).astype(np.int8)))
    a, b = edge[::2], edge[1::2]
    sums = rolling.sums(low)
    doc = np.searchsorted(own, a, side="right") - 1
    docs, hashes = [doc], [rolling.of(sums, a, b)]
    for k in BEGINNINGS:
        longer = b - a > k
        docs.append(doc[longer])
        hashes.append(mix(rolling.of(sums, a[longer], a[longer] + k) ^ np.uint64(k)))
    return np.concatenate(docs), np.concatenate(hashes)


def _restored(data: np.ndarray, at: np.ndarray, channel: Channel) -> tuple[np.ndarray, np.ndarray]:
    """The texts with disguises decoded, in the form of ``buffers``."""
    parts, more, last = [], np.zeros(len(at) - 1, np.int64), int(at[0])
    for i, j in chunks(at, PIECE):
        base = int(at[i])
        x = data[base : at[j]]
        begins, ends = suspect_spans(x, at[i : j + 1] - base)
        raw = x.tobytes()
        for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
            new = channel.restore_part(raw[b:e])
            if new != raw[b:e]:
                # A blank at an end is never changed, and the next part may share it.
                head, tail = raw[b] == 32, raw[e - 1] == 32
                new = new[head : len(new) - tail]
                b, e = base + b + head, base + e - tail
                parts += [data[last:b], np.frombuffer(new, np.uint8)]
                more[np.searchsorted(at, b, side="right") - 1] += len(new) - (e - b)
                last = e
    if not parts:
        return data, at
    parts.append(data[last : at[-1]])
    return np.concatenate(parts), np.concatenate(([0], np.cumsum(np.diff(at) + more)))


def _evidence_batches(cost: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, channel = Rolling(61, 2 * PIECE), Channel(cost)
        for batch in batches:
            data, at = _restored(*buffers(batch.column("text")), channel)
            y = batch.column("y").to_numpy(zero_copy_only=False)
            for i, j in chunks(at, PIECE):
                x, own = separated(data, at, i, j)
                doc, h = evidence_hashes(x, own, rolling if len(x) < len(rolling.power) else Rolling(61, len(x)))
                order = np.lexsort((doc, h))
                doc, h = doc[order], h[order]
                new = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))) if len(h) else np.zeros(0, bool)
                doc, h = doc[new], h[new]
                first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
                toxic = np.add.reduceat(y[i:j][doc], first) if len(h) else first
                n = np.diff(np.concatenate((first, [len(h)])))
                yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64), pa.int64()), pa.array(n, pa.int64()), pa.array(toxic, pa.int64())], names=["h", "n", "toxic"])

    return run


@dataclass
class Model:
    cost: np.ndarray
    hashes: np.ndarray
    logs: np.ndarray
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def raw(self, data: np.ndarray, at: np.ndarray, channel: Channel, rolling: Rolling) -> np.ndarray:
        """Noisy-or of the distinct evidence of each text, as minus the log of the rest, restored first."""
        out = np.zeros(len(at) - 1)
        data, at = _restored(data, at, channel)
        for i, j in chunks(at, PIECE):
            x, own = separated(data, at, i, j)
            doc, h = evidence_hashes(x, own, rolling if len(x) < len(rolling.power) else Rolling(61, len(x)))
            if not len(self.hashes) or not len(h):
                continue
            k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            met = self.hashes[k] == h
            pairs = np.unique(np.stack((doc[met], k[met])), axis=1)
            out[i:j] = np.bincount(pairs[0], self.logs[pairs[1]], j - i)
        return np.round(out, DECIMALS)


def _raw_batches(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, channel = Rolling(61, 2 * PIECE), Channel(model.cost)
        for batch in batches:
            raw = model.raw(*buffers(batch.column("text")), channel, rolling)
            score = raw if model.knots is None else calibrated(model.knots, raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=[batch.schema.names[0], "score"])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model | float:
    rows = stored(labelled_sample(docs, labels, label, sample), "labelled")
    share = {(r.f, r.y): r.n for r in rows.groupBy((F.col("fold") == 1).alias("f"), "y").agg(F.count("*").alias("n")).collect()}
    if len({y for _, y in share}) < 2:
        return 1.0 if share and {y for _, y in share} == {1} else 0.0
    own = len(share) == 4
    cost = language_model(docs)
    learn = rows.where("fold > 1") if own else rows
    found = learn.select("text", "y").mapInArrow(_evidence_batches(cost), "h long, n long, toxic long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    # Lower bound of a precision: with CAUTION added to the documents, as in a Wilson interval.
    low = F.col("toxic") / (F.col("n") + CAUTION)
    kept = found.select("h", low.alias("low"), "n").where((F.col("low") >= LEAST) & (F.col("n") >= LEAST_DOCS)).toArrow()
    h, low = kept.column("h").to_numpy().view(np.uint64), kept.column("low").to_numpy()
    order = np.argsort(h)
    model = Model(cost, h[order], -np.log1p(-np.minimum(low[order], 0.999)))
    values = (rows.where("fold = 1") if own else rows).select(F.col("y"), "text").mapInArrow(_raw_batches(model), "y int, score double").toArrow()
    model.knots = isotonic(values.column("score").to_numpy(), values.column("y").to_numpy().astype(float))
    return model


def classify_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; scoring does not shuffle."""
    model = fit_toxicity(docs, labels, "toxic", sample)
    rows = docs.select("doc_id", "text")
    scored = rows.select("doc_id", F.lit(model).alias("score")) if isinstance(model, float) else rows.mapInArrow(_raw_batches(model), "doc_id long, score double")
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def restore_texts(docs: DataFrame) -> DataFrame:
    """doc_id and the text with disguises decoded, under the language model of ``docs`` themselves."""
    cost = language_model(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = Channel(cost)
        for batch in batches:
            texts = [None if t is None else channel.restore(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
