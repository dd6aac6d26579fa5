"""Chunking: one document to many overlapping windows of its text, with exact offsets.

A document is cut into pieces that tile it (a separator stays in front of the piece that follows it, and counts), from
coarse to fine separators, and neighbouring pieces are put together up to the chunk size. A window takes up the end of the
one before it, from a word's end on, if both fit.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askloom.operators import clean
from askloom.schemas import DEFAULT, Config

# Separators from coarse to fine; below them, single characters.
SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ")

#: Texts whose chunks become one Arrow batch.
ROWS_AT_ONCE = 64


def _pieces(text: str, low: int, high: int, size: int, level: int = 0) -> Iterator[tuple[int, int]]:
    """Spans of at most `size` that tile text[low:high]."""
    if high - low <= size:
        if high > low:
            yield low, high
        return
    if level == len(SEPARATORS):
        yield from ((k, min(k + size, high)) for k in range(low, high, size))
        return
    cuts, at = [low], text.find(SEPARATORS[level], low + 1, high)
    while at >= 0:
        cuts.append(at)
        at = text.find(SEPARATORS[level], at + len(SEPARATORS[level]), high)
    if len(cuts) == 1:
        yield from _pieces(text, low, high, size, level + 1)
        return
    start = low
    for begin, end in zip(cuts, [*cuts[1:], high], strict=True):
        if end - start <= size:
            continue
        if begin > start:
            yield start, begin
        start = begin
        if end - begin > size:
            yield from _pieces(text, begin, end, size, level + 1)
            start = end
    if high > start:
        yield start, high


def windows(text: str, size: int = DEFAULT.chunk_size, overlap: int = DEFAULT.chunk_overlap) -> list[tuple[int, int]]:
    """Spans of the chunks, stripped of white space; blank ones are left out."""
    found: list[tuple[int, int]] = []
    start = end = 0
    for begin, stop in _pieces(text, 0, len(text), size):
        if stop - start > size:
            found.append((start, end))
            tail = max(start, end - overlap)
            while tail < end and not text[tail].isspace():
                tail += 1
            carried = overlap > 0 and text[tail:end].strip() and stop - tail <= size
            start = tail if carried else begin
        end = stop
    found.append((start, end))
    out = []
    for a, b in found:
        body = text[a:b]
        a += len(body) - len(body.lstrip())
        if body := body.strip():
            out.append((a, a + len(body)))
    return out


def chunk_texts(docs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """docs(clean_text, anything else) -> the other columns and chunk_index, text, char_start, char_end; one task a text.

    A column `pages` (spans of the text's pages, in order) becomes `page`: the page in which a chunk starts.
    """
    paged = "pages" in docs.columns
    others = [f for f in docs.schema.fields if f.name not in ("clean_text", "pages")]
    size, overlap = config.chunk_size, config.chunk_overlap

    def run(batches):
        import pyarrow as pa

        names = [f.name for f in others] + ["chunk_index", "text", "char_start", "char_end"] + ["page"] * paged
        kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32())
        for batch in batches:
            for at in range(0, len(batch), ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                texts = part.column(len(others)).to_pylist()
                spans = part.column(len(others) + 1).to_pylist() if paged else [None] * len(texts)
                rows, found = [], []
                for k, (text, pages) in enumerate(zip(texts, spans, strict=True)):
                    place = page_finder(pages or [])
                    for i, (a, b) in enumerate(windows(text or "", size, overlap)):
                        rows.append(k)
                        found.append((i, text[a:b], a, b, place(a)))
                if rows:
                    rest = pa.RecordBatch.from_arrays(part.columns[: len(others)], names=names[: len(others)]).take(pa.array(rows)).columns if others else []
                    new = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*rest, *new[: 4 + paged]], names=names)

    new = [T.StructField("chunk_index", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("char_start", T.IntegerType()), T.StructField("char_end", T.IntegerType())]
    schema = T.StructType([*others, *new, *[T.StructField("page", T.IntegerType())] * paged])
    return docs.select(*[f.name for f in others], "clean_text", *["pages"] * paged).mapInArrow(run, schema)


def page_finder(pages: list[dict]):
    """A function: offset to the page whose span holds it, else the last page; None without pages."""
    starts = [p["start"] for p in pages]

    def place(at: int) -> int | None:
        k = bisect_right(starts, at) - 1
        return pages[k]["page"] if k >= 0 and at < pages[k]["end"] else pages[-1]["page"] if pages else None

    return place


def register(spark: SparkSession, name: str = "chunks_of", table_name: str = "chunk_table", config: Config = DEFAULT) -> None:
    """The chunker for SQL, as two table functions.

    Of a text:   SELECT ... FROM t, LATERAL chunks_of(t.text)
    Of a table (its key and its text, in this order), in Arrow batches:   SELECT * FROM chunk_table(TABLE(SELECT doc_id, text FROM t))

    Spark takes Arrow table functions with table arguments only, not in LATERAL, and with a fixed result: keys are strings.
    """
    size, overlap = config.chunk_size, config.chunk_overlap

    class Chunks:
        def eval(self, text: str):
            for i, (a, b) in enumerate(windows(text or "", size, overlap)):
                yield i, text[a:b], a, b

    class ChunkTable:
        def eval(self, batch):
            import pyarrow as pa

            kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32())
            names = ["doc_id", "chunk_index", "text", "char_start", "char_end"]
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                keys, texts = part.column(0).cast(pa.string()).to_pylist(), part.column(1).to_pylist()
                found = [(key, i, text[a:b], a, b) for key, text in zip(keys, texts, strict=True) for i, (a, b) in enumerate(windows(text or "", size, overlap))]
                if found:
                    yield pa.table([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    spark.udtf.register(name, F.udtf(Chunks, returnType="chunk_index int, text string, char_start int, char_end int"))
    spark.udtf.register(table_name, F.arrow_udtf(ChunkTable, returnType="doc_id string, chunk_index int, text string, char_start int, char_end int"))


def chunk_id(doc_id, index):
    return F.format_string("%s::%05d", doc_id, index)


def assembled(segments: DataFrame) -> DataFrame:
    """segments(doc_id, filename, page, seq, text) -> doc_id, filename, segments in order: the one shuffle of texts."""
    row = F.struct("seq", "page", "text")
    return segments.groupBy("doc_id").agg(F.any_value("filename").alias("filename"), F.array_sort(F.collect_list(row)).alias("segments"))


def as_documents(files: DataFrame) -> DataFrame:
    """files(doc_id, filename, text) of one segment and no pages each, in the form of assembled(): no shuffle."""
    row = F.struct(F.lit(0).alias("seq"), F.lit(None).cast("int").alias("page"), "text")
    return files.select("doc_id", "filename", F.array(row).alias("segments"))


def chunk_documents(segments: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """segments(doc_id, filename, page, seq, text), or documents with an array of `segments` (one row each; they are not
    shuffled) -> chunks: cleaned, cut, with pages and bibliography flags. Texts are read once."""
    docs = segments if "segments" in segments.columns else assembled(segments)
    return cut_documents(clean.whole_documents(docs.select("doc_id", "filename", "segments"), config.min_occurrences), config)


def cut_documents(docs: DataFrame, config: Config = DEFAULT, keep: tuple[str, ...] = ()) -> DataFrame:
    """Cleaned documents(doc_id, filename, clean_text, pages, ref_start, keep...) -> chunks, each with the kept columns."""
    middle = (F.col("char_start") + F.col("char_end")) / 2
    return chunk_texts(docs, config).select(
        chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"), "doc_id", "filename", "chunk_index", "text", "char_start", "char_end",
        F.length("text").alias("char_count"), "page", F.coalesce(middle >= F.col("ref_start"), F.lit(False)).alias("is_reference"), *keep,
    )
