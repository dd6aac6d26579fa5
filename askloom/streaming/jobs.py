"""Streams: continuous ingest into a table of batches, and live latency dashboards.

A table of batches has versions (sources.versions): a version lists the folders of its batches. A folder holds the rows that
a batch gave, and the keys that it had: a key of a newer batch hides the rows of the older ones, also if the newer one gave none.
A batch that is run again adds nothing; one that fails leaves nothing that readers see. After COMPACT batches the rows that
count are written as one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askloom.operators.report import latency_stats, recent
from askloom.schemas import DEFAULT
from askloom.sources import storage, versions

#: Batches that a table holds before they are written as one.
COMPACT = 32
#: The column of a batch's number in stored rows and keys.
BATCH = "_batch"


def _put(rows: DataFrame, keys: DataFrame, table: str, number: int) -> str:
    """Writes a batch's rows and keys to a new folder; its name."""
    folder = f"batch={number}-{uuid.uuid4().hex[:12]}"
    for part, df in (("rows", rows), ("keys", keys)):
        df.withColumn(BATCH, F.lit(number).cast("long")).write.parquet(f"{table}/{folder}/{part}")
    return folder


def _commit(spark: SparkSession, table: str, key: str, folders: list[str], last: int, after: int) -> int:
    return versions.commit(spark, table, {"key": key, "folders": folders, "last": last}, after)


def ingest_stream(source: DataFrame, work: Callable[[DataFrame], DataFrame], table: str, checkpoint: str, key: str, deleted: Column | None = None, compact_after: int = COMPACT):
    """Applies `work` to each micro-batch; its rows take the place of all older rows of the batch's keys.

    A version of a key from which `work` makes no row removes the key's rows; so does a row for which `deleted` is true
    (those are not given to `work`). Within a batch all rows of a key are one version.
    """
    spark = source.sparkSession

    def add(batch: DataFrame, number: int) -> None:
        after = versions.current(spark, table)
        info = versions.manifest(spark, table, after)
        if number <= info.get("last", -1):
            return
        gone = F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)
        keys = batch.select(key).distinct()
        folder = _put(work(batch.filter(~gone)), keys, table, number)
        after = _commit(spark, table, key, [*info.get("folders", []), folder], number, after)
        if len(info.get("folders", [])) + 1 >= compact_after:
            compact(spark, table)

    return source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _current(spark: SparkSession, table: str, info: dict) -> tuple[DataFrame, DataFrame]:
    """(the rows that count, with their batch; the newest batch of each key)."""
    rows = spark.read.parquet(*[f"{table}/{f}/rows" for f in info["folders"]])
    keys = spark.read.parquet(*[f"{table}/{f}/keys" for f in info["folders"]])
    rows = rows.filter(F.col(info["key"]).isNotNull())
    newest = keys.groupBy(info["key"]).agg(F.max(BATCH).alias(BATCH))
    if len(info["folders"]) == 1:
        return rows, newest
    # keys with an older batch are few beside all rows, which need no shuffle where these fit a broadcast
    hidden = storage.materialize(keys.join(newest.withColumnRenamed(BATCH, "_newest"), info["key"]).filter(F.col(BATCH) < F.col("_newest")).select(info["key"], BATCH).distinct(), "hidden")
    return rows.join(hidden, [info["key"], BATCH], "left_anti"), newest


def latest(spark: SparkSession, table: str, query=None) -> DataFrame:
    """The rows of each key from its newest committed batch (of several with one key in a batch, all)."""
    info = versions.manifest(spark, table)
    if not info:
        raise FileNotFoundError(f"no batch of {table} was committed")
    return _current(spark, table, info)[0].drop(BATCH)


def compact(spark: SparkSession, table: str, to: str | None = None) -> None:
    """Writes the rows that count as one batch: in the place of the table's batches, or as another table."""
    after = versions.current(spark, table)
    info = versions.manifest(spark, table, after)
    rows, newest = _current(spark, table, info)
    kept = rows.select(info["key"]).distinct()
    folder = _put(rows.drop(BATCH), newest.drop(BATCH).join(kept, info["key"], "left_semi"), to or table, info["last"])
    _commit(spark, to or table, info["key"], [folder], info["last"], versions.current(spark, to) if to else after)


def clear(spark: SparkSession, table: str) -> list[str]:
    """Deletes the folders that the newest version does not name: those of compacted and of failed batches."""
    used = set(versions.manifest(spark, table).get("folders", []))
    fs, place = versions.file_system(spark, table)
    gone = [s.getPath().getName() for s in fs.listStatus(place) if s.getPath().getName().startswith("batch=") and s.getPath().getName() not in used]
    for name in gone:
        fs.delete(versions.file_system(spark, f"{table}/{name}")[1], True)
    return gone


# --- dashboards -----------------------------------------------------------------------------------------------------


def latency_stream(history: DataFrame, name: str, checkpoint: str):
    """The one-row latency report on the whole history, renewed with every batch, as an in-memory table of this name."""
    return latency_stats(history).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recent_stream(history: DataFrame, table: str, checkpoint: str, limit: int = DEFAULT.history_limit, tie: str = "id"):
    """Keeps the newest `limit` entries of a stream of history rows: each batch's newest are merged with those kept. State
    and every batch's part in it are bounded by the limit; `recent_rows` reads what is kept."""
    spark = history.sparkSession

    def add(batch: DataFrame, number: int) -> None:
        after = versions.current(spark, table)
        info = versions.manifest(spark, table, after)
        if number <= info.get("last", -1):
            return
        new = recent(batch, limit, tie)
        both = new.unionByName(spark.read.parquet(f"{table}/data/{info['folders'][0]}")) if info else new
        folder = versions.new_folder()
        recent(both, limit, tie).write.parquet(f"{table}/data/{folder}")
        _commit(spark, table, tie, [folder], number, after)
        versions.clear(spark, table, keep=2)

    return history.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recent_rows(spark: SparkSession, table: str) -> DataFrame:
    """What recent_stream keeps: latency_stats of it is the live report."""
    return spark.read.parquet(f"{table}/data/{versions.manifest(spark, table)['folders'][0]}")


def read_parquet_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
