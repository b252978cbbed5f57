"""Source bundles as folders: one for each source, rewritten only when its content changes."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioguard.functions import text as H
from folioguard.sources import folders
from folioguard.sources.scratch import written

FILES = ("ingest", "figures", "manifest")
PART = "part-0.txt"


def bundle_files(sources: DataFrame) -> DataFrame:
    """bundle, file, content of sources (source, and JSON texts named as FILES). A bundle is named by its source's file name; sources with
    one name are numbered in their order from the second on. Null contents are no files."""
    rows = sources.withColumn("stem", H.source_stem(F.col("source")))
    k = F.row_number().over(Window.partitionBy("stem").orderBy("source"))
    name = F.when(F.col("k") > 1, F.concat("stem", F.lit("_"), F.col("k").cast("string"))).otherwise(F.col("stem"))
    files = F.array(*(F.struct(F.lit(f).alias("file"), F.col(f).alias("content")) for f in FILES))
    return rows.withColumn("k", k).select(name.alias("bundle"), F.explode(files).alias("f")).select("bundle", "f.*").where("content IS NOT NULL")


def _content(files: fs.FileSystem, folder: str) -> dict[str, str]:
    """What lies in the folder of a bundle, by file; without the end of the line that the writer puts."""
    found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=True))
    there = {}
    for f in found:
        name = f.path.rsplit("/", 2)[-2]
        if f.is_file and f.base_name == PART and name.startswith("file="):
            with files.open_input_stream(f.path) as s:
                there[unquote(name[len("file=") :])] = s.read().decode().removesuffix("\n")
    return there


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """bundle, file, content of what ``write_bundles`` has written; no rows if there is nothing. A task lists a shard."""
    root, schema = folders.qualified(spark, path), pa.schema([(n, pa.string()) for n in ("bundle", "file", "content")])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = folders.opened(root)
        for batch in batches:
            for k in batch.column("id").to_pylist():
                for f in files.get_file_info(fs.FileSelector(f"{base}/shard={k}", allow_not_found=True)):
                    there = _content(files, f.path)
                    yield pa.record_batch([pa.array([unquote(f.base_name[len("bundle=") :])] * len(there)), pa.array(there.keys(), pa.string()), pa.array(there.values(), pa.string())], schema=schema)

    return spark.range(0, folders.SHARDS, 1, folders.SHARDS).mapInArrow(each, "bundle string, file string, content string")


def write_bundles(files: DataFrame, path: str) -> DataFrame:
    """Write ``bundle_files`` to ``path``/shard=../bundle=../file=..; returns bundle, state (written, unchanged).

    The task that holds a bundle compares it with what is there, and only bundles that differ in a file are written, as a whole; all others
    are left alone. States are kept before the folders change that they follow from, so a repeated task writes the same files again.
    A file that a bundle no longer has is removed with an empty one in its place. Bundles that are not among ``files`` stay.
    """
    root = folders.qualified(files.sparkSession, path)
    held = folders.spread(files.select("bundle", F.struct("file", "content").alias("f")), "bundle").groupBy("bundle").agg(F.collect_list("f").alias("files"))
    held = written(held.withColumn("folder", F.concat(folders.shard("bundle"), F.lit("/bundle="))))  # before any folder is looked at, as contents may fail
    entry = pa.list_(pa.struct([("file", pa.string()), ("content", pa.string())]))
    schema = pa.schema([("bundle", pa.string()), ("folder", pa.string()), ("state", pa.string()), ("files", entry)])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on, base = folders.opened(root)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                folder = row["folder"] + quote(row["bundle"])
                new, old = {f["file"]: f["content"] or "" for f in row["files"]}, _content(on, f"{base}/{folder}")
                emptied = {f: "" for f, content in old.items() if f not in new and content}
                same = not emptied and all(f in old and old[f] == content for f, content in new.items())
                put = [] if same else [{"file": f, "content": content} for f, content in (new | emptied).items()]
                out.append({"bundle": row["bundle"], "folder": folder, "state": "unchanged" if same else "written", "files": put})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    def write(on: fs.FileSystem, base: str, row: dict) -> None:
        for f in row["files"]:
            folder = f"{base}/{row['folder']}/file={quote(f['file'])}"
            on.create_dir(folder, recursive=True)
            folders.put(on, f"{folder}/{PART}", f["content"])

    state = written(held.mapInArrow(compared, "bundle string, folder string, state string, files array<struct<file: string, content: string>>"))
    folders.run(state.where("state = 'written'"), write, path)
    return state.select("bundle", "state")
