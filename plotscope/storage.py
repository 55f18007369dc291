"""Cutting lineage through a written table in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
_local_folder: dict[str, tempfile.TemporaryDirectory] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only on a local master it may be unset:
    then one temporary folder per application, removed when the process ends."""
    folder = spark.conf.get(_CONF, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_CONF} to a folder that every executor can read")
    app = spark.sparkContext.applicationId
    if app not in _local_folder:
        _local_folder[app] = tempfile.TemporaryDirectory(prefix="plotscope-", ignore_cleanup_errors=True)
    return _local_folder[app].name


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back, so later steps neither recompute it nor
    depend on the executors that produced it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
