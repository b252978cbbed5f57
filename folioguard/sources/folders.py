"""Many small files, written and read where the rows are: no list of them passes the driver, and no job moves them one by one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that files are dealt out to, so that each can be listed by a task of its own.
SHARDS = 64


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme, as tasks need it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def shard(name: str):
    """The shard of column ``name``, as part of a path."""
    return F.concat(F.lit("shard="), F.pmod(F.crc32(F.col(name).cast("string")), F.lit(SHARDS)).cast("string"))


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` by ``key`` over all shuffle partitions: files take time, however few bytes they have."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def put(files: fs.FileSystem, path: str, content: str | None) -> None:
    """A file of ``content`` and the end of a line, as Spark's text writer puts it."""
    with files.open_output_stream(path) as out:
        out.write(((content or "") + "\n").encode())


def run(rows: DataFrame, work: Callable[[fs.FileSystem, str, dict], None], path: str) -> None:
    """``work`` for each row, with the file system and the folder of ``path``; it may be repeated, as tasks are."""
    root = qualified(rows.sparkSession, path)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = opened(root)
        for batch in batches:
            for row in batch.to_pylist():
                work(files, base, row)
            yield pa.record_batch({"n": pa.array([batch.num_rows], pa.int64())})

    rows.mapInArrow(each, "n long").agg(F.sum("n")).collect()


def write_files(rows: DataFrame, path: str, suffix: str = "") -> None:
    """Write rows (k, value), a file named by k for each row: ``path``/shard=../k."""

    def work(files: fs.FileSystem, base: str, row: dict) -> None:
        files.create_dir(f"{base}/{row['folder']}", recursive=True)
        put(files, f"{base}/{row['folder']}/{row['k']}{suffix}", row["value"])

    run(spread(rows.select("k", "value", shard("k").alias("folder")), "k"), work, path)
