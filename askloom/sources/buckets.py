"""A stored table whose rows lie in buckets by a hash of a column, written by part.

The table has versions (sources.versions). A version lists, for each bucket that has rows, the folders of its rows:
an upsert or a delete reads and writes only the buckets that its keys fall into, an insert of new keys only adds folders.
Spark sees the bucket as a partition column, so a filter or a join on it prunes folders (`nearest.in_documents`).
Rows are written with rebalancing hints: small buckets share a task, large ones are split.

Rows of one key must agree in the column of the buckets (a chunk's document, say). The driver holds a row a bucket.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askloom.sources import versions

BUCKET = "bucket"


def bucket_of(column: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column.cast("string")), F.lit(buckets)).cast("int")


def number_of(table: DataFrame) -> int:
    """The number of buckets of a table that `read` gave."""
    return int(table.schema[BUCKET].metadata["buckets"])


def _put(rows: DataFrame, path: str, by: str, buckets: int) -> tuple[str, list[int]]:
    """Writes rows to a new folder; its name, and the buckets in it."""
    folder = versions.new_folder()
    placed = rows.drop(BUCKET).withColumn(BUCKET, bucket_of(F.col(by), buckets))
    placed.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/data/{folder}")
    fs, place = versions.file_system(rows.sparkSession, f"{path}/data/{folder}")
    names = [s.getPath().getName() for s in fs.listStatus(place)]
    return folder, [int(n.removeprefix(f"{BUCKET}=")) for n in names if n.startswith(f"{BUCKET}=")]


def _commit(spark: SparkSession, path: str, info: dict, live: dict[str, list[str]], after: int) -> int:
    live = {b: f for b, f in live.items() if f}
    folders = sorted(f"{f}/{BUCKET}={b}" for b, fs in live.items() for f in fs)
    return versions.commit(spark, path, info | {"live": live, "folders": folders}, after)


def create(rows: DataFrame, path: str, key: str, by: str, buckets: int = 64) -> int:
    """Makes `rows` the table's content: its number of buckets, key and column of the buckets are fixed until the next one.
    The rows may come from the table itself. The new version's number."""
    spark, after = rows.sparkSession, versions.current(rows.sparkSession, path)
    info = {"key": key, "by": by, "buckets": buckets, "schema": rows.drop(BUCKET).schema.json()}
    folder, found = _put(rows, path, by, buckets)
    return _commit(spark, path, info, {str(b): [folder] for b in found}, after)


def read(spark: SparkSession, path: str, version: int | None = None, only: list[int] | None = None) -> DataFrame:
    """The rows of a version (the newest), with their buckets; of some buckets only, if `only` names them."""
    info = versions.manifest(spark, path, version)
    if not info:
        raise FileNotFoundError(f"no table at {path}")
    places = [f"{path}/data/{folder}/{BUCKET}={b}" for b, folders in sorted(info["live"].items()) if only is None or int(b) in only for folder in folders]
    whole = T.StructType([*T.StructType.fromJson(json.loads(info["schema"])).fields, T.StructField("part", T.StringType()), T.StructField(BUCKET, T.IntegerType())])
    stored = spark.read.schema(whole).option("basePath", f"{path}/data").parquet(*places) if places else spark.createDataFrame([], whole)
    return stored.drop("part").withMetadata(BUCKET, {"buckets": info["buckets"]})


def touched(rows: DataFrame, by: str, buckets: int) -> list[int]:
    return sorted(r[BUCKET] for r in rows.select(bucket_of(F.col(by), buckets).alias(BUCKET)).distinct().collect())  # a row a bucket


def change(spark: SparkSession, path: str, incoming: DataFrame, mode: str = "upsert") -> int:
    """A new version with the incoming rows: they replace rows of their keys (upsert), or only new keys are added (ignore).
    Only the buckets of the incoming rows are read, and of those only an upsert's are written again."""
    from askloom.operators import index

    after = versions.current(spark, path)
    info = versions.manifest(spark, path, after)
    found = touched(incoming, info["by"], info["buckets"])
    old = read(spark, path, after, found).drop(BUCKET)
    live = dict(info["live"])
    if mode == "ignore":
        folder, filled = _put(index.new_rows(old, incoming, info["key"]), path, info["by"], info["buckets"])
        live |= {str(b): [*live.get(str(b), []), folder] for b in filled}
    else:
        folder, filled = _put(index.append(old, incoming, info["key"], mode), path, info["by"], info["buckets"])
        live |= {str(b): [folder] if b in filled else [] for b in {*found, *filled}}
    return _commit(spark, path, {k: info[k] for k in ("key", "by", "buckets", "schema")}, live, after)


def delete(spark: SparkSession, path: str, ids: DataFrame) -> int:
    """A new version without the rows whose bucket column has one of these values (ids of that column)."""
    after = versions.current(spark, path)
    info = versions.manifest(spark, path, after)
    found = touched(ids, info["by"], info["buckets"])
    left = read(spark, path, after, found).drop(BUCKET).join(ids.select(info["by"]), info["by"], "left_anti")
    folder, filled = _put(left, path, info["by"], info["buckets"])
    live = dict(info["live"]) | {str(b): [folder] if b in filled else [] for b in found}
    return _commit(spark, path, {k: info[k] for k in ("key", "by", "buckets", "schema")}, live, after)


def reset(spark: SparkSession, path: str) -> int:
    """A new version without rows; the schema, key and buckets stay, and it can be written to."""
    after = versions.current(spark, path)
    info = versions.manifest(spark, path, after)
    if not info:
        raise FileNotFoundError(f"no table at {path}")
    return _commit(spark, path, {k: info[k] for k in ("key", "by", "buckets", "schema")}, {}, after)
