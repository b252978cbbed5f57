"""Operator 12: difference of two snapshots, with keys that changed, by invertible Bloom lookup tables.

Each row of a snapshot is an entry: 64 bits for its key and 64 for its whole content. Entries are dealt out
to partitions by their own hash, so a key that many rows share is spread. A partition's table has a
fixed number of cells, and each cell the sums over its entries of the number of rows, of the entry's halves
and of a check of both; being sums, tables of two snapshots are subtracted cell by cell, and what both have
vanishes, repeated rows included. A cell that then holds one entry (the sums are multiples of one entry that
agrees with its check and belongs there) is peeled off, until the table is empty. Only tables travel between the
snapshots, and their size follows the difference, not the rows. Partitions whose table does not come out empty
are tried again with ``GROWTH`` times the cells.

Entries with rows left over on one side are looked up in the snapshots; each must be found with as many rows as
was decoded, or the run fails. Leftover rows pair by equal key first (i-th with i-th in the order of content where
a key is repeated), the rest by equal text, i-th smallest key with i-th smallest key. Both numberings deal out by ranges,
so neither a repeated key nor a common text needs one task. Columns are compared by SHA-256.

Nulls are values of their own, in keys too, and equal only nulls; null keys come last. Empty text is not null. Empty
snapshots make every row an insert or a delete. Other columns than ``key`` and ``columns`` are ignored, so names cannot clash.
Rows that agree in 128 bits count as equal: at 10**12 rows fewer than one in 10**14 runs meets such a pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioguard.llm.common import mix, read_table, stored

#: Entries of a partition, and cells of its first table and of each further try in terms of the last.
ROWS = 16_384
CELLS = 4_096
GROWTH = 4
TRIES = 12
PLACES = 3
FIELDS = 7
LOW = np.uint64(0xFFFFFFFF)


def _value_hash(columns: list[str], salt: int) -> Column:
    """64 bits of the columns' values; null is told from every value, and borders between values count."""
    parts = [x for c in columns for x in (F.col(c).isNull(), F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(-1)), F.col(c))]
    return F.xxhash64(F.lit(salt), *parts)


def entries(snapshot: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """k and d, the entry of each row: its key and its whole content."""
    return snapshot.withColumns({"k": _value_hash([key], 1), "d": _value_hash([key, *columns], 2)})


def check_of(k: np.ndarray, d: np.ndarray) -> np.ndarray:
    return mix(k * np.uint64(0x9E3779B97F4A7C15) ^ mix(d))


def places(k: np.ndarray, d: np.ndarray, cells: int) -> np.ndarray:
    """PLACES cells of each entry, each in a share of its own of the table."""
    share, h = cells // PLACES, check_of(d, k)
    return np.stack([mix(h + np.uint64(j + 1)) % np.uint64(share) + np.uint64(j * share) for j in range(PLACES)]).astype(np.int64)


def build(k: np.ndarray, d: np.ndarray, n: np.ndarray, cells: int) -> np.ndarray:
    """The table of entries that ``n`` rows each have: FIELDS sums for each cell."""
    check, out = check_of(k, d), np.zeros((FIELDS, cells), np.int64)
    halves = [np.ones(len(k), np.int64)] + [(x >> np.uint64(32) * np.uint64(s) & LOW).astype(np.int64) for x in (k, d, check) for s in (1, 0)]
    for at in places(k, d, cells):
        for f, half in enumerate(halves):
            np.add.at(out[f], at, half * n)
    return out


def peel(table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """k, d, rows (negative for the subtracted side) of the entries that come off, and whether the table came out empty."""
    table, cells = table.copy(), table.shape[1]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    look = np.arange(cells)
    while len(look):
        n = table[0, look]
        look, n = look[n != 0], n[n != 0]
        whole, left = np.divmod(table[1:, look], n)
        fits = (left == 0).all(axis=0) & (whole >= 0).all(axis=0) & (whole <= int(LOW)).all(axis=0)
        look, n, whole = look[fits], n[fits], whole[:, fits].astype(np.uint64)
        k, d, check = (whole[i] << np.uint64(32) | whole[i + 1] for i in (0, 2, 4))
        pure = (check == check_of(k, d)) & (places(k, d, cells) == look).any(axis=0)
        k, d, n = k[pure], d[pure], n[pure]
        _, first = np.unique(np.stack((k, d)), axis=1, return_index=True)
        k, d, n = k[first], d[first], n[first]
        if not len(k):
            break
        found.append((k, d, n))
        table -= build(k, d, n, cells)
        look = np.unique(places(k, d, cells))
    k, d, n = (np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(zip(*found) if found else ((), (), ()), (np.uint64, np.uint64, np.int64)))
    return k, d, n, not table.any()


def _table_groups(cells: int) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        k, d = (group.column(c).to_numpy().view(np.uint64) for c in ("k", "d"))
        table = build(k, d, group.column("n").to_numpy(), cells)
        return pa.table({"part": group.column("part")[:1].cast(pa.int64()), "cells": pa.array([table.tobytes()], pa.binary())})

    return run


def tables(counted: DataFrame, cells: int) -> DataFrame:
    """part, cells: the table of each partition of ``counted`` (part, k, d, n)."""
    return counted.groupBy("part").applyInArrow(_table_groups(cells), "part long, cells binary")


def _peel_batches(cells: int) -> Callable:
    """One row for each decoded entry; a partition whose table is not empty gives one row with ok = false instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, old, new in zip(*(batch.column(c) for c in ("part", "old", "new"))):
                a, b = (np.frombuffer(x.as_buffer() or b"", np.int64) if x.is_valid else np.zeros(FIELDS * cells, np.int64) for x in (old, new))
                k, d, n, ok = peel((a - b).reshape(FIELDS, cells))
                if not ok:
                    k, d, n = np.zeros(1, np.uint64), np.zeros(1, np.uint64), np.zeros(1, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(k), part.as_py())), pa.array(k.view(np.int64)), pa.array(d.view(np.int64)), pa.array(n), pa.array(np.full(len(k), ok))], names=["part", "k", "d", "n", "ok"]
                )

    return run


def difference(old: DataFrame, new: DataFrame, rows: int = ROWS, cells: int = CELLS) -> DataFrame:
    """k, d, n of the entries that one of two tables of entries (k, d) has more rows of; n < 0: ``new`` has more."""
    parts = max(1, old.count() // rows)
    part = F.pmod(F.xxhash64("k", "d"), F.lit(parts)).alias("part")
    # Repeated rows are counted before they meet in a partition.
    sides = [stored(x.groupBy(part, "k", "d").agg(F.count("*").alias("n")), "entries") for x in (old, new)]
    out, cells = None, max(PLACES, cells // PLACES * PLACES)
    for _ in range(TRIES):
        a, b = (tables(x, cells).withColumnRenamed("cells", name) for x, name in zip(sides, ("old", "new")))
        peeled = stored(a.hint("merge").join(b, "part", "full").mapInArrow(_peel_batches(cells), "part long, k long, d long, n long, ok boolean"), "peeled")
        good = peeled.where("ok").select("k", "d", "n")
        out = good if out is None else out.unionByName(good)
        failed = peeled.where("not ok").select("part")
        if failed.isEmpty():
            return out
        sides = [x.join(failed.hint("merge"), "part", "left_semi") for x in sides]
        cells *= GROWTH
    raise RuntimeError(f"tables of {cells // GROWTH} cells did not decode")


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with i, the place (from 1) inside its group in the given order, nulls last; no task needs a whole group.

    Rows are dealt out by ranges of (group, order); each range numbers its own and adds what earlier ranges hold of the group.
    """
    by = [F.col(c).asc_nulls_last() for c in [*group, *order]]
    ranged = stored(rows.repartitionByRange(*by).withColumn("range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(*group, "range").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("range", F.coalesce(before, F.lit(0)).alias("before"), *(F.col(c).alias(f"_{c}") for c in group)).withColumnRenamed("range", "_range")
    same = F.col("range") == F.col("_range")
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    own = F.row_number().over(Window.partitionBy(*group, "range").orderBy(*(F.col(c).asc_nulls_last() for c in order)))
    met = ranged.withColumn("own", own).join(counts.hint("merge"), same)
    return met.withColumn("i", F.col("before") + F.col("own")).select(*rows.columns, "i")


def _side(snapshot: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, k, d and the columns' SHA-256 (c0, c1, ...; null for null), beside what ``row_hash`` names."""
    e = entries(snapshot, key, columns)
    return e.select(F.col(key).alias("key"), "k", "d", *(F.unhex(F.sha2(F.col(c).cast("string"), 256)).alias(f"c{i}") for i, c in enumerate(columns)), row_sha256(columns).alias("row_sha256"))


def row_sha256(columns: list[str]) -> Column:
    """SHA-256 of the columns' texts, one below the other, null as ``~``."""
    return F.sha2(F.concat_ws("\n", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns)), 256)


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str], content: str, rows: int = ROWS, cells: int = CELLS) -> DataFrame:
    """key, old_key, op, changed, row_sha256 for every pair of rows and every row without one.

    ``content`` is the column whose equality pairs rows that have no partner by key.
    """
    c = [f"c{i}" for i in range(len(columns))]
    by_content = f"c{columns.index(content)}"
    a, b = (stored(_side(x, key, columns), "side") for x in (old, new))
    differ = difference(a.select("k", "d"), b.select("k", "d"), rows, cells)
    differ = stored(differ.select(F.col("k").alias("_k"), F.col("d").alias("_d"), "n"), "differ")

    def split(side: DataFrame, sign: int) -> tuple[DataFrame, DataFrame]:
        """Rows left over on this side, and those that have an equal on the other."""
        more = differ.where(F.col("n") * sign > 0).select("_k", "_d", F.abs("n").alias("n"))
        met = side.join(more.hint("merge"), (F.col("k") == F.col("_k")) & (F.col("d") == F.col("_d")), "left").drop("_k", "_d")
        equal, some = met.where("n is null"), stored(met.where("n is not null"), "found")
        seen = some.groupBy("k", "d", "n").agg(F.count("*").alias("rows"))
        found, asked = seen.agg(F.count("*"), F.count_if(F.col("rows") < F.col("n"))).first(), more.count()
        if found[0] != asked or found[1]:
            raise RuntimeError(f"of {asked} decoded entries {found[0]} were found, {found[1]} of them with too few rows")
        again = seen.where(F.col("rows") > F.col("n")).select("k", "d").limit(1)
        if again.isEmpty():
            return some.drop("n"), equal.drop("n")
        i = numbered(some, ["k", "d"], ["key"])
        return i.where("i <= n").drop("n", "i"), equal.unionByName(i.where("i > n").drop("i")).drop("n")

    gone, _ = split(a, 1)
    come, same = split(b, -1)
    pairs, op = [same.select("key", F.col("key").alias("old_key"), F.lit("same").alias("op"), F.lit("").alias("changed"), "row_sha256")], "update"
    for on, order in (("k", ["d"]), (by_content, ["key", "d"])):
        x, y = numbered(gone, [on], order), numbered(come, [on], order)
        x = x.withColumnsRenamed({n: f"old_{n}" for n in x.columns})
        met = y.hint("merge").join(x, y[on].eqNullSafe(x[f"old_{on}"]) & (y.i == x.old_i), "full")
        met = stored(met, "met")
        both = met.where("i is not null and old_i is not null")
        changed = F.array_join(F.array_compact(F.array(*(F.when(~F.col(h).eqNullSafe(F.col(f"old_{h}")), F.lit(name)) for h, name in zip(c, columns)))), ",")
        pairs.append(both.select("key", "old_key", F.lit(op).alias("op"), changed.alias("changed"), "row_sha256"))
        gone = met.where("i is null").select(*(F.col(f"old_{n}").alias(n) for n in gone.columns))
        come, op = met.where("old_i is null").select(*come.columns), "rekey"
    empty, none = F.lit("").alias("changed"), F.lit(None).cast("string").alias("row_sha256")
    out = come.select("key", F.lit(None).cast("long").alias("old_key"), F.lit("insert").alias("op"), empty, "row_sha256")
    out = out.unionByName(gone.select("key", F.col("key").alias("old_key"), F.lit("delete").alias("op"), empty, none))
    for p in pairs:
        out = out.unionByName(p)
    return out


COLUMNS = ["text", "lang", "source"]


def later_snapshot(docs: DataFrame) -> DataFrame:
    """The snapshot that the query compares with: what happens to a row follows from the CRC-32 of its id."""
    fate, other = F.crc32(F.col("doc_id").cast("string")) % 16, F.lit(-1) - F.col("doc_id")
    keys = F.when(fate == 0, F.array().cast("array<long>")).when(fate.isin(3, 4), F.array(other)).when(fate == 5, F.array(F.col("doc_id"), other)).otherwise(F.array("doc_id"))
    return docs.select(
        F.explode(keys).alias("doc_id"),
        F.when(fate == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("+"))).otherwise(F.col("text")).alias("text"),
        F.when(fate == 2, F.col("source")).otherwise(F.col("lang")).alias("lang"),
        F.when(fate == 2, F.col("lang")).when(fate == 4, F.lit(None)).otherwise(F.col("source")).alias("source"),
    )


def op12_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", *COLUMNS)
    return snapshot_diff(docs, later_snapshot(docs), "doc_id", COLUMNS, "text")


#: CRC-32 (reflected polynomial 0xEDB88320) over the decimal digits, bit by bit.
OP12_SQL = r"""
WITH steps AS (
  SELECT doc_id, text, lang, source,
    xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [256 + CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0]))),
      lambda a, b: CASE WHEN b >= 256 THEN xor(a, b - 256) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 16 AS f
  FROM documents),
old AS (SELECT doc_id AS key, text, lang, source FROM documents),
new AS (
  SELECT CASE WHEN f IN (3, 4) THEN -1 - doc_id ELSE doc_id END AS key,
    CASE WHEN f = 1 THEN coalesce(text, '') || '+' ELSE text END AS text,
    CASE WHEN f = 2 THEN source ELSE lang END AS lang,
    CASE WHEN f = 2 THEN lang WHEN f = 4 THEN NULL ELSE source END AS source
  FROM steps WHERE f IS DISTINCT FROM 0
  UNION ALL SELECT -1 - doc_id, text, lang, source FROM steps WHERE f = 5),
keyed AS (SELECT n.key, o.key AS old_key, n.text, n.lang, n.source, o.text AS t, o.lang AS l, o.source AS s, true AS by_key FROM new n JOIN old o ON n.key IS NOT DISTINCT FROM o.key),
o2 AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY key) AS i FROM old WHERE key NOT IN (SELECT key FROM keyed)),
n2 AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY key) AS i FROM new WHERE key NOT IN (SELECT key FROM keyed)),
rest AS (SELECT n2.key, o2.key AS old_key, n2.text, n2.lang, n2.source, o2.text AS t, o2.lang AS l, o2.source AS s, n2.i AS ni, o2.i AS oi
  FROM n2 FULL JOIN o2 ON n2.text IS NOT DISTINCT FROM o2.text AND n2.i = o2.i),
pairs AS (
  SELECT *, 1 AS ni, 1 AS oi FROM keyed
  UNION ALL SELECT key, old_key, text, lang, source, t, l, s, false, ni, oi FROM rest),
said AS (
  SELECT *, array_to_string(list_filter([CASE WHEN text IS DISTINCT FROM t THEN 'text' END, CASE WHEN lang IS DISTINCT FROM l THEN 'lang' END, CASE WHEN source IS DISTINCT FROM s THEN 'source' END], lambda x: x IS NOT NULL), ',') AS c
  FROM pairs)
SELECT CASE WHEN ni IS NULL THEN old_key ELSE key END AS key, old_key,
  CASE WHEN oi IS NULL THEN 'insert' WHEN ni IS NULL THEN 'delete' WHEN NOT by_key THEN 'rekey' WHEN c = '' THEN 'same' ELSE 'update' END AS op,
  CASE WHEN oi IS NULL OR ni IS NULL THEN '' ELSE c END AS changed,
  CASE WHEN ni IS NOT NULL THEN sha256(coalesce(text, '~') || chr(10) || coalesce(lang, '~') || chr(10) || coalesce(source, '~')) END AS row_sha256
FROM said
"""
