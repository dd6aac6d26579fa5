"""Small helpers that several operators use: the shared folder and written tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word in the word contracts: space and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir; else, in local sessions only, one made here."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("askloom.shared.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="askloom-")
        spark.conf.set("askloom.shared.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/askloom-{what}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends at a table that outlives executors."""
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.askloom_path = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Deletes written tables that no later step reads: what was made of them is itself written."""
    for table in tables:
        if path := getattr(table, "askloom_path", None):
            jvm, session = table.sparkSession._jvm, table.sparkSession
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(session._jsc.hadoopConfiguration()).delete(place, True)


def rows(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    """A small literal table, kept in the plan so that no Python runs on executors."""
    names = [x.strip().split() for x in schema.split(",")]
    structs = [F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(row, names, strict=True)]) for row in values]
    empty = spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in names])
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs))) if structs else empty


def hash60(column: Column | str, salt: str) -> Column:
    """Uniform long in [0, 2^60) from md5, the same in any SQL engine."""
    text = F.coalesce(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(F.concat(text, F.lit(f":{salt}")).cast("binary")), 1, 15), 16, 10).cast("long")


def spread(key: Column, parts: Column) -> Column:
    """Maps a 60-bit uniform key to one of `parts` equal ranges, in order; exact in 64-bit integers."""
    return F.shiftright(F.shiftright(key, 29).cast("long") * parts.cast("long"), 31)


def crc_unsigned(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long")


def pick(columns: list[str], wanted: list[str]) -> list[str]:
    """The wanted columns, checked to be there."""
    missing = [c for c in wanted if c not in columns]
    if missing:
        raise ValueError(f"missing columns {missing} in {columns}")
    return wanted
