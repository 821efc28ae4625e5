"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import warnings
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local session may lack it and then gets a new folder of this
    machine; a cluster's executors would not see that one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='tesserine-')}"
        warnings.warn(f"spark.checkpoint.dir is not set; using {at}", stacklevel=2)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


_listed: list[list[DataFrame]] = []


@contextmanager
def listed(into: list[DataFrame]):
    """Append the tables that scratch() writes meanwhile to a list, so that they can be dropped together."""
    _listed.append(into)
    try:
        yield into
    finally:
        _listed.pop()


def scratch(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again. It cuts the lineage and
    outlives lost executors."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._scratch = at
    for own in _listed:
        own.append(out)
    return out


def drop_scratch(*frames: DataFrame) -> None:
    """Remove tables that scratch() wrote, once nothing reads them any more."""
    for df in frames:
        jvm, at = df.sparkSession._jvm, df._scratch
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
