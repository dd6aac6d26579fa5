"""Corpus folders: all files of a folder tree, those of no bytes too, each with the reason why it is refused; only the
contents of accepted files are read.

The listing is a data source of its own ("corpus_folder"): the driver lists the upper levels of the tree until there are
LEAST folders or no more levels, and each of these is listed by a task, with all below it. Contents are read by tasks, too,
a few MB at a time. Paths are those of pyarrow's file systems (local paths, file:, hdfs:, s3:, gs:).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from askloom.functions import text as tx
from askloom.schemas import DEFAULT, Config
from askloom.sources import readers

#: Folders to list by tasks at least, rows in a batch of the listing, and bytes of contents in a batch.
LEAST, ROWS, BATCH_BYTES = 64, 8192, 8 << 20
LISTING = T.StructType([T.StructField("path", T.StringType()), T.StructField("size_bytes", T.LongType()), T.StructField("modified", T.TimestampType())])


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _hidden(name: str) -> bool:
    return name.startswith(".")


class Part(InputPartition):
    """Folders to list: their own files only, or all below them."""

    def __init__(self, folders: list[str], below: bool) -> None:
        super().__init__((tuple(folders), below))


class FolderReader(DataSourceReader):
    def __init__(self, path: str, least: int) -> None:
        self.path, self.least = path, least

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = _system(self.path)
        level, done = [root], []
        while len(level) < self.least:
            inner = [f.path for p in level for f in system.get_file_info(fs.FileSelector(p)) if f.type == fs.FileType.Directory and not _hidden(f.base_name)]
            if not inner:
                break
            done += level
            level = inner
        return [Part([p], False) for p in sorted(done)] + [Part([p], True) for p in sorted(level)]

    def read(self, partition: InputPartition) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        folders, below = partition.value
        system, _ = _system(self.path)
        todo, rows = list(folders), []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.timestamp("us", "UTC")))], names=LISTING.names)

        while todo:
            for f in sorted(system.get_file_info(fs.FileSelector(todo.pop())), key=lambda f: f.path):
                if _hidden(f.base_name):
                    continue
                if f.type == fs.FileType.File:
                    rows.append((f.path, f.size, f.mtime))
                    if len(rows) == ROWS:
                        yield batch()
                        rows = []
                elif below and f.type == fs.FileType.Directory:
                    todo.append(f.path)
        if rows:
            yield batch()


class CorpusFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpus_folder"

    def schema(self) -> T.StructType:
        return LISTING

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return FolderReader(self.options["path"], int(self.options.get("least", LEAST)))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_bytes, modified) of all files below a folder but hidden ones; paths as its file system has them."""
    spark.dataSource.register(CorpusFolder)
    return spark.read.format("corpus_folder").option("path", path).load()


def scan(spark: SparkSession, path: str, config: Config = DEFAULT) -> DataFrame:
    """(path, filename, extension, size_bytes, modified, code, content) of all files of a folder tree but hidden ones.

    code says why a file is refused by its name or size (unsupported_file_type, file_too_large, empty_file); content is null
    then, and the file is not opened. A file that is gone when it is read has the code processing_failed.
    """
    name = tx.basename(F.col("path"))
    files = listing(spark, path).select("path", name.alias("filename"), tx.file_extension(name).alias("extension"), "size_bytes", "modified")
    marked = files.withColumn("code", readers.reject_code(F.col("extension"), F.col("size_bytes"), config=config))
    schema = T.StructType([*marked.schema.fields, T.StructField("content", T.BinaryType())])

    def contents(batches):
        import pyarrow as pa

        system, _ = _system(path)
        for batch in batches:
            paths, sizes, codes = (batch.column(k).to_pylist() for k in (0, 3, 5))
            at = 0
            while at < len(paths):
                bodies, held, first = [], 0, at
                while at < len(paths) and (at == first or held + (0 if codes[at] else sizes[at]) <= BATCH_BYTES):
                    bodies.append(None)
                    if codes[at] is None:
                        try:
                            with system.open_input_stream(paths[at]) as source:
                                bodies[-1] = source.read()
                            held += len(bodies[-1])
                        except FileNotFoundError:
                            codes[at] = "processing_failed"
                    at += 1
                part = batch.slice(first, at - first)
                yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(codes[first:at], pa.string()), pa.array(bodies, pa.binary())], names=schema.names)

    # the listing is in the order of folders; large and small files are dealt to all tasks
    return marked.repartition(F.xxhash64("path")).mapInArrow(contents, schema)


def ingested(files: DataFrame, config: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """scan()'s files -> (segments of the text files, rejects with reasons), blank texts among the rejects."""
    texts = files.filter("code IS NULL AND extension = 'txt'")
    decoded = texts.withColumn("text", readers.decode_text(F.col("content")))
    blank = tx.strip(F.coalesce("text", F.lit(""))) == ""
    good = decoded.filter(~blank).select(F.col("path").alias("doc_id"), "filename", F.lit(None).cast("int").alias("page"), F.lit(0).alias("seq"), "text")
    refused = files.filter("code IS NOT NULL").select("filename", "code").union(decoded.filter(blank).select("filename", F.lit("empty_file")))
    return good, readers.with_reasons(refused, config)


def write_files(rows: DataFrame, path: str) -> DataFrame:
    """rows(filename, content) as files of a folder, written by tasks; a filename may have folders. The number of files and of
    bytes. A repeated task writes its files again, with the same contents."""

    def write(batches):
        import pyarrow as pa

        system, root = _system(path)
        made, bytes_, folders = 0, 0, set()
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                place = f"{root}/{name}"
                if (parent := place.rpartition("/")[0]) not in folders:
                    system.create_dir(parent, recursive=True)
                    folders.add(parent)
                with system.open_output_stream(place) as out:
                    out.write(content or b"")
                made, bytes_ = made + 1, bytes_ + len(content or b"")
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.int64()), pa.array([bytes_], pa.int64())], names=["files", "bytes"])

    return rows.select("filename", "content").mapInArrow(write, "files long, bytes long").agg(F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
