"""Intermediate tables of operators that go on in rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, shared by driver and executors; only a local master may do without, as in tests."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not hasattr(spark, "_folioguard_rounds"):
        spark._folioguard_rounds = "file://" + tempfile.mkdtemp(prefix="folioguard-rounds-")
    return spark._folioguard_rounds


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path that no other run uses; what lies there goes when the driver ends."""
    path = f"{scratch_folder(spark)}/folioguard-{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table of its own, without lineage."""
    path = scratch_path(df.sparkSession, "round")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
