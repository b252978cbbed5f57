"""Operator 10: secret scan. Keyword automaton, anchored patterns near its hits, embedded checksums.

An Aho-Corasick automaton over the ASCII-lower-cased text finds where a keyword starts. A pattern is
only tried at those places, in order, and skips places inside its last match, which gives the same
leftmost non-overlapping matches as a search from every position. Hexadecimal digests have no
keyword; their runs are found by their own scan. Kinds with an embedded checksum (GitHub and npm
tokens: CRC-32 in base 62 of the first 30 characters; card numbers: Luhn) are only kept if it holds.

Kinds, in the order of ties: assign, access, hex, then github, npm, card, pem. Offsets count code
points, ends are exclusive. Null and empty texts have no spans; texts of any length are read whole;
repeated rows each get their row; columns of the input with clashing names are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from folioguard.llm.common import buffers, read_table

BASE = ("assign", "access", "hex")
#: The patterns of each kind and the keywords that start them.
PATTERNS = {
    "assign": rb"(?i:(?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": rb"AKIA[A-Z0-9]+",
    "github": rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])",
    "npm": rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])",
    "card": rb"(?<![0-9])[3-6][0-9]{12,18}(?![0-9])",
    "pem": rb"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----",
}
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "pem": ("-----begin ",),
}
HEX = re.compile(rb"[0-9a-f]{24,}")
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def token_checksum(body: bytes) -> bytes:
    """CRC-32 of the token's body as six base-62 digits."""
    n, out = zlib.crc32(body), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = DIGITS[d] + out
    return out.encode()


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = (d - 48) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


KEEP = {
    "assign": lambda m: len(m[1]) >= 6,
    "access": lambda m: len(m[0]) >= 20,
    "github": lambda m: token_checksum(m[1]) == m[2],
    "npm": lambda m: token_checksum(m[1]) == m[2],
    "card": lambda m: luhn(m[0]),
    "pem": lambda m: True,
}


class Scanner:
    """The automaton and patterns, built once per Python worker."""

    def __init__(self):
        import ahocorasick

        self.words = ahocorasick.Automaton()
        for kind, keys in KEYWORDS.items():
            for k in keys:
                self.words.add_word(k, (kind, len(k)))
        self.words.make_automaton()
        self.patterns = {k: re.compile(p) for k, p in PATTERNS.items()}

    def scan(self, text: bytes) -> list[tuple[int, int, str]]:
        """Byte start, end and kind of every span, by start, then kind."""
        found: list[tuple[int, int, int]] = []
        order = {k: i for i, k in enumerate((*BASE, *(k for k in PATTERNS if k not in BASE)))}
        starts: dict[str, list[int]] = {}
        # One character per byte, so offsets are bytes.
        for end, (kind, n) in self.words.iter(text.lower().decode("latin-1")):
            starts.setdefault(kind, []).append(end - n + 1)
        for kind, places in starts.items():
            last, match = 0, self.patterns[kind].match
            for at in sorted(set(places)):
                if at >= last and (m := match(text, at)):
                    last = m.end()
                    if KEEP[kind](m):
                        found.append((at, order[kind], last))
        found += [(m.start(), order["hex"], m.end()) for m in HEX.finditer(text)]
        if re.search(rb"[0-9]{13}", text):
            found += [(m.start(), order["card"], m.end()) for m in self.patterns["card"].finditer(text) if luhn(m[0])]
        names = list(order)
        return [(a, b, names[k]) for a, k, b in sorted(found)]


def code_points(text: bytes, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans in code points instead of bytes."""
    if not spans or text.isascii():
        return spans
    places, out, last, n = sorted({p for a, b, _ in spans for p in (a, b)}), {}, 0, 0
    for p in places:
        n += len(text[last:p].decode("utf-8"))
        out[p], last = n, p
    return [(out[a], out[b], k) for a, b, k in spans]


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    join = lambda spans: ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
    for batch in batches:
        data, at = buffers(batch.column("text"))
        rows = []
        for i in range(len(at) - 1):
            text = data[at[i] : at[i + 1]].tobytes()
            spans = code_points(text, scanner.scan(text))
            base = [s for s in spans if s[2] in BASE]
            rows.append((*(sum(s[2] == k for s in base) for k in BASE), hashlib.sha256(join(base).encode()).hexdigest(), join(spans)))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.string()] * 2, strict=True))],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of ``docs`` (doc_id, text); no shuffle."""
    return docs.select("doc_id", "text").mapInArrow(_scan_batches, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read_table(spark, sf_dir, "documents"))
