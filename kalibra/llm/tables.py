"""Shared tables: reading inputs and cutting lineage through the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_local: dict[str, str] = {}  # temporary folders of local sessions, by application


def shared_root(spark: SparkSession) -> str:
    """This application's part of the folder in ``spark.checkpoint.dir``.

    Where that is unset, a local session (tests) gets a temporary folder; on a cluster other machines would not see
    one, so this raises.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if context.applicationId not in _local:
            _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="kalibra-shared-")
        root = _local[context.applicationId]
    return f"{root}/kalibra-{context.applicationId}"


def release(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application. Results that are still to be read need them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a reader of it.

    Later plans read the files instead of recomputing what made them, also after an executor is lost. The files stay
    until ``release``, since results are read from them when the caller runs them.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_shared(spark: SparkSession, name: str, data: bytes) -> str:
    """Write a small file to the shared folder, whatever store that is; returns its path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return path.toString()
