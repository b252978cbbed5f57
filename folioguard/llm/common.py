"""Helpers that the training-data operators share.

Texts reach Python only as Arrow buffers: ``buffers`` exposes a string column as one UTF-8 byte
array with offsets, so kernels work on whole batches and never on one row at a time.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

M64 = (1 << 64) - 1
#: Rows and bytes up to which a side may be broadcast; checked by counting, never assumed.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
#: Property of the tables that ``BucketedTable`` may register anew.
MARK = "folioguard.bucketed"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; ``spark.checkpoint.dir`` names it.

    Only a local master may do without that setting (tests); it gets a folder of its own.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        conf = getattr(spark, "_folioguard_shared", None)
        if not conf:
            conf = "file://" + tempfile.mkdtemp(prefix="folioguard-")
            spark._folioguard_shared = conf
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(conf)
    return conf.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """The file system that holds ``path``, and the path as Hadoop's class."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses.

    All paths of a session lie in one folder, which its driver deletes when it ends.
    """
    run = getattr(spark, "_folioguard_run", None)
    if run is None or not run.startswith(shared_dir(spark)):
        run = spark._folioguard_run = f"{shared_dir(spark)}/folioguard-run-{uuid.uuid4().hex}"
        fs, p = hadoop_path(spark, run)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return f"{run}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **more: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts the lineage. ``more`` are settings of the write."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    with shuffles_dropped(spark, **more):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession, **more: str) -> Iterator[None]:
    """A write's own shuffle files are of no use after it; inside, Spark drops them at once.

    ``more`` are further settings of the write. All are put back as they were. They only tell how rows are
    exchanged, how files are written and when they are deleted, so another query of the session that starts meanwhile gets the same rows.
    """
    settings = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | more
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def nvl_text(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else; pure ASCII texts take the fast built-in."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def raw_words(c: Column) -> Column:
    """The runs of digits, letters and non-ASCII characters of the text, in order, in their own case."""
    return F.array_remove(F.split(c, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")


def words(c: Column) -> Column:
    """``raw_words`` of the lower-cased text."""
    return raw_words(ascii_lower(c))


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows of ``size`` bytes together, else as it is.

    The count stops at ``rows`` + 1. Without the hint the planner joins by shuffling both sides.
    """
    width = F.lit(0)
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        own = F.octet_length(f.name) if kind in ("string", "binary") else F.octet_length(F.concat_ws(" ", f.name)) if kind == "array<string>" else F.size(f.name) * 64 if kind.startswith("array") else F.lit(8)
        width = width + F.coalesce(own, F.lit(0))
    n, total = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= size else df


class BucketedTable:
    """A table in files under ``path``, bucketed by columns, each file sorted by others.

    Its files lie in a folder per version that also names the buckets, so another session opens the same
    table by the path; ``name`` is what the session's catalog calls it.
    """

    SCHEMA: T.StructType
    BY: tuple[str, ...]
    SORT: tuple[str, ...]
    CODEC = "snappy"

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int | None = None):
        """Open the table under ``path``, or create it empty with ``buckets`` (by default the session's shuffle partitions)."""
        self.spark, self.name, self.path = spark, name, path.rstrip("/")
        self.version, self.buckets = max(self._versions(), default=(0, buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))))
        self._register()

    def _folder(self) -> str:
        return f"{self.path}/v{self.version}-b{self.buckets}"

    def _versions(self) -> list[tuple[int, int]]:
        """Versions that were written to the end, with their buckets."""
        fs, p = hadoop_path(self.spark, self.path)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        found = [m for n in names if (m := re.fullmatch(r"v(\d+)-b(\d+)", n)) and fs.exists(hadoop_path(self.spark, f"{self.path}/{n}/_SUCCESS")[1])]
        return [(int(m[1]), int(m[2])) for m in found]

    def _register(self) -> None:
        if self.spark.catalog.tableExists(self.name):
            if MARK not in {r.key for r in self.spark.sql(f"SHOW TBLPROPERTIES {self.name}").collect()}:
                raise ValueError(f"{self.name} is a table of another kind")
            self.spark.sql(f"DROP TABLE {self.name}")  # of an external table the files stay
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.SCHEMA.fields)
        self.spark.sql(f"CREATE TABLE {self.name} ({columns}) USING parquet CLUSTERED BY ({', '.join(self.BY)}) INTO {self.buckets} BUCKETS LOCATION '{self._folder()}' TBLPROPERTIES ('{MARK}' = 'true')")

    def _write(self, df: DataFrame, name: str, mode: str) -> None:
        """Write rows that are dealt out by bucket, each task's sorted.

        Spark's own sort for bucketed writes compares (bucket, column) pairs, and in a task that has one bucket each
        comparison goes to the rows. Sorted by one column they are sorted by radix; the second setting lets the writer
        take them as they are.
        """
        with shuffles_dropped(self.spark, **{"spark.sql.maxConcurrentOutputFileWriters": "16"}):
            rows = df.select(*self.SCHEMA.names).sortWithinPartitions(*self.SORT)
            rows.write.format("parquet").option("compression", self.CODEC).bucketBy(self.buckets, *self.BY).option("path", self._folder()).mode(mode).saveAsTable(name)

    def read(self) -> DataFrame:
        return self.spark.read.table(self.name)

    def compact(self) -> None:
        """Write the table anew, one sorted file per bucket. The version before stays, for queries that read it; older ones go."""
        fs, p = hadoop_path(self.spark, self._folder())
        if not fs.exists(p):
            return
        # Read as plain files: dealt out by bucket, a bucketed scan would do without the exchange and then not be read by bucket.
        rows, last = self.spark.read.schema(self.SCHEMA).parquet(self._folder()).repartition(self.buckets, *self.BY), self.version
        self.version = last + 1
        self._write(rows, f"{self.name}__next", "overwrite")
        self.spark.sql(f"DROP TABLE {self.name}__next")
        self._register()
        for version, buckets in self._versions():
            if version < last:
                fs.delete(hadoop_path(self.spark, f"{self.path}/v{version}-b{buckets}")[1], True)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)), at


def chunks(at: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``most`` bytes together; a longer text stands alone."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (values are fixed)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def table64(seed: int, n: int = 256) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, M64, n, dtype=np.uint64) | np.uint64(1)


class Rolling:
    """Hashes of any substring from one running sum over the bytes, modulo 2**64."""

    def __init__(self, seed: int, most: int):
        self.table, base = table64(seed), int(table64(seed + 1, 1)[0])
        inverse = pow(base, -1, 1 << 64)
        self.power = np.concatenate(([np.uint64(1)], np.cumprod(np.full(most, base, np.uint64))))
        self.inverse = np.concatenate(([np.uint64(1)], np.cumprod(np.full(most, inverse, np.uint64))))

    def sums(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate(([np.uint64(0)], np.cumsum(self.table[x] * self.power[: len(x)], dtype=np.uint64)))

    def of(self, sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((sums[b] - sums[a]) * self.inverse[a] + (b - a).astype(np.uint64))


def separated(data: np.ndarray, at: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts of rows i to j with a zero byte after each, and where each starts (j - i + 1 offsets)."""
    own = at[i : j + 1] - at[i]
    x = np.zeros(int(own[-1]) + j - i, np.uint8)
    row = np.repeat(np.arange(j - i), np.diff(own))
    x[np.arange(int(own[-1])) + row] = data[at[i] : at[j]]
    return x, own + np.arange(j - i + 1)


def word_hashes(x: np.ndarray, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of the bytes; words as in ``words``."""
    word = WORD[x]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], word, [0])).astype(np.int8)))
    a, b = edge[::2], edge[1::2]
    return a, rolling.of(rolling.sums(LOWER[x]), a, b)


WORD = np.array([int(48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)], dtype=np.uint8)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
