"""Folders that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession, what: str) -> str:
    """A new name in the folder of spark.checkpoint.dir; in local sessions only, that may be unset, and one is made here."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("askloom.work.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="askloom-")
        spark.conf.set("askloom.work.dir", root)
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Writes df to a new folder and reads it back."""
    path = work_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables above this many bytes are read as they are stored.
SMALL_TABLE = 256 << 20


def spread_out(df: DataFrame) -> DataFrame:
    """A small stored table with less than a split for each core (one file, one row group) is dealt to all cores; others are
    left as they are, whatever the number of cores."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = int(df._jdf.queryExecution().analyzed().stats().sizeInBytes())
    return df.repartition(cores) if size < min(cores * split, SMALL_TABLE) else df
