"""Sources: corpus folders, decoded text, word boxes, structured blocks, and the JSON stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askloom.functions import text as tx
from askloom.schemas import DEFAULT, HISTORY, REGISTRY, Config
from askloom.sources import versions

# The characters that windows-1252 has at bytes 0x80 to 0x9F; five bytes have none.
_CP1252 = {
    0x80: 0x20AC, 0x82: 0x201A, 0x83: 0x0192, 0x84: 0x201E, 0x85: 0x2026, 0x86: 0x2020, 0x87: 0x2021, 0x88: 0x02C6, 0x89: 0x2030,
    0x8A: 0x0160, 0x8B: 0x2039, 0x8C: 0x0152, 0x8E: 0x017D, 0x91: 0x2018, 0x92: 0x2019, 0x93: 0x201C, 0x94: 0x201D, 0x95: 0x2022,
    0x96: 0x2013, 0x97: 0x2014, 0x98: 0x02DC, 0x99: 0x2122, 0x9A: 0x0161, 0x9B: 0x203A, 0x9C: 0x0153, 0x9E: 0x017E, 0x9F: 0x0178,
}


def scan_corpus(spark: SparkSession, path: str, config: Config = DEFAULT) -> DataFrame:
    """(filename, extension, size_bytes, modified, content) of the files with an allowed extension, by Spark's file reader.

    Dot files are skipped; so are files of no bytes, which that reader does not list: `folder.scan` does, and reads no
    file that will be refused.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = files.select(tx.basename(F.col("path")).alias("filename"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), "content")
    return named.withColumn("extension", tx.file_extension(F.col("filename"))).filter(~F.col("filename").startswith(".") & F.col("extension").isin(*config.extensions))


def reject_code(extension: Column, size: Column, text: Column | None = None, config: Config = DEFAULT) -> Column:
    """Why an upload is refused, or null: the first reason that holds."""
    blank = (size == 0) if text is None else ((size == 0) | (tx.strip(F.coalesce(text, F.lit(""))) == ""))
    return (
        F.when(~F.coalesce(F.lower(extension).isin(*config.extensions), F.lit(False)), "unsupported_file_type")
        .when(size > config.max_upload_bytes, "file_too_large").when(F.coalesce(blank, F.lit(True)), "empty_file")
    )


def split_rejects(files: DataFrame, code: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejects(filename, code))."""
    marked = files.withColumn("code", code)
    return marked.filter(F.col("code").isNull()).drop("code"), marked.filter(F.col("code").isNotNull()).select("filename", "code")


def with_reasons(rejects: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """rejects(filename, code) with a sentence for people, in the form of the reject table."""
    allowed = ", ".join("." + e for e in config.extensions)
    reason = (
        F.when(F.col("code") == "unsupported_file_type", F.concat(F.lit("Files of type '."), tx.file_extension(F.col("filename")), F.lit(f"' are not read, only {allowed}.")))
        .when(F.col("code") == "file_too_large", F.lit(f"The file has more than {config.max_upload_bytes // 1024**2} MB."))
        .when(F.col("code") == "empty_file", F.lit("The file holds no text.")).when(F.col("code") == "processing_failed", F.lit("No text was left after cleaning."))
    )
    return rejects.select("filename", "code", reason.alias("reason"))


def decode_text(content: Column) -> Column:
    """Bytes to text: UTF-8 with or without mark, UTF-16 with a mark, else windows-1252, else ISO-8859-1."""
    raw = content.cast("string")
    marked = F.hex(F.substring(content, 1, 2)).isin("FFFE", "FEFF")
    latin = F.decode(content, "ISO-8859-1")
    windows = F.translate(latin, "".join(map(chr, _CP1252)), "".join(map(chr, _CP1252.values())))
    undefined = latin.rlike("[\\u0081\\u008D\\u008F\\u0090\\u009D]")
    return (
        F.when(F.is_valid_utf8(raw), F.regexp_replace(raw, "^\\uFEFF", "")).when(marked, F.decode(content, "UTF-16"))
        .when(undefined, latin).otherwise(windows)
    )


def text_segments(files: DataFrame) -> DataFrame:
    """files(doc_id, filename, content) -> one segment without a page for each text file."""
    return files.select("doc_id", "filename", F.lit(None).cast("int").alias("page"), F.lit(0).alias("seq"), decode_text(F.col("content")).alias("text"))


def page_counts(segments: DataFrame) -> DataFrame:
    """Pages of each document, and whether all of them are blank."""
    filled = tx.strip(F.coalesce("text", F.lit(""))) != ""
    return segments.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("page_count"), (~F.max(filled)).alias("blank"))


# --- word boxes -----------------------------------------------------------------------------------------------------

# What counts as a body word, a page to look at, and a gutter.
MIN_WORD, MIN_WORDS, GAP_SHARE, SEARCH, CENTRE = 4, 40, 0.01, (0.30, 0.72), (0.40, 0.62)


def gutters(words: DataFrame) -> DataFrame:
    """words(doc_id, page, page_width, text, x0, x1, top) -> (doc_id, page, gutter_start, gutter_end) of two-column pages.

    The widest empty vertical band of the search range, by gaps between covered bins.
    """
    page = ["doc_id", "page"]
    body = words.filter((F.length("text") >= MIN_WORD) & (F.col("page_width") > 0))
    enough = body.groupBy(page).agg(F.count(F.lit(1)).alias("n"), F.max("page_width").alias("width")).filter(F.col("n") >= MIN_WORDS).withColumn("bins", F.col("width").cast("int"))
    low, high = F.greatest(F.lit(0), F.col("x0").cast("int")), F.least(F.col("bins"), F.col("x1").cast("int")) - 1
    # boxes of the same columns are alike: each span of bins is taken apart once a page
    boxes = body.join(enough.select(*page, "bins"), page).filter(low <= high).select(*page, low.alias("low"), high.alias("high")).distinct()
    covered = boxes.select(*page, F.explode(F.sequence("low", "high")).alias("bin"))
    edges = enough.select(*page, F.explode(F.array(F.lit(-1), F.col("bins"))).alias("bin"))
    after = F.lead("bin").over(Window.partitionBy(*page).orderBy("bin"))
    gaps = covered.union(edges).distinct().withColumn("next", after).filter("next > bin + 1").join(enough.select(*page, "width"), page)
    start = F.greatest(F.col("bin") + 1, (F.col("width") * SEARCH[0]).cast("int"))
    wide = gaps.withColumn("start", start).withColumn("length", F.col("next") - F.col("start"))
    wide = wide.filter((F.col("start") < (F.col("width") * SEARCH[1]).cast("int")) & (F.col("length") >= F.greatest(F.lit(3), (F.col("width") * GAP_SHARE).cast("int"))))
    best = wide.groupBy(*page).agg(F.max_by(F.struct("start", "length", "width"), F.struct("length", -F.col("start"))).alias("gap"))
    centre = (F.col("gap.start") + F.col("gap.length") / 2) / F.col("gap.width")
    return best.filter(centre.between(*CENTRE)).select(*page, F.col("gap.start").alias("gutter_start"), (F.col("gap.start") + F.col("gap.length")).alias("gutter_end"))


def reading_order(words: DataFrame) -> DataFrame:
    """words -> (doc_id, page, text): line by line, the left column before the right one where there are two."""
    page = ["doc_id", "page"]
    placed = words.join(gutters(words), page, "left").withColumn("column", F.coalesce((F.col("x0") >= F.col("gutter_end")).cast("int"), F.lit(0)))
    lines = placed.groupBy(*page, "column", "top").agg(F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY x0, text)").alias("line"))
    columns = lines.groupBy(*page, "column").agg(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY top)").alias("part"))
    return columns.groupBy(*page).agg(F.expr("listagg(part, '\n\n') WITHIN GROUP (ORDER BY column)").alias("text"))


# --- structured blocks ----------------------------------------------------------------------------------------------


def flatten_blocks(blocks: DataFrame) -> DataFrame:
    """blocks(doc_id, seq, kind, style, text, cells) -> (doc_id, text): headings of level 1 marked, table rows joined."""
    body = tx.strip(F.coalesce("text", F.lit("")))
    cells = F.transform(F.coalesce("cells", F.array().cast("array<string>")), lambda c: tx.strip(F.coalesce(c, F.lit(""))))
    row = F.when(F.exists(cells, lambda c: c != ""), F.array_join(cells, " | ")).otherwise(F.lit(""))
    line = F.when(F.col("kind") == "table_row", row).when((F.lower("style") == "heading 1") & (body != ""), F.concat(F.lit("## "), body)).otherwise(body)
    return blocks.select("doc_id", "seq", line.alias("line")).filter("line <> ''").groupBy("doc_id").agg(F.expr("listagg(line, '\n\n') WITHIN GROUP (ORDER BY seq)").alias("text"))


def dispatch(files: DataFrame, pages: DataFrame, blocks: DataFrame, config: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(segments, rejects) of files(doc_id, filename, extension, size_bytes, content) of all formats.

    Plain text is decoded; paged formats take their texts from pages(doc_id, page, text) and structured ones from blocks,
    which other tools extract. Unknown formats are rejected.
    """
    good, rejects = split_rejects(files, reject_code(F.col("extension"), F.col("size_bytes"), config=config))
    of = lambda kind: good.filter(F.lower("extension") == kind)
    plain = text_segments(of("txt"))
    paged = of("pdf").select("doc_id", "filename").join(pages, "doc_id").select("doc_id", "filename", F.col("page").cast("int").alias("page"), F.col("page").cast("int").alias("seq"), "text")
    whole = flatten_blocks(blocks.join(of("docx").select("doc_id"), "doc_id", "left_semi"))
    structured = of("docx").select("doc_id", "filename").join(whole, "doc_id").select("doc_id", "filename", F.lit(None).cast("int").alias("page"), F.lit(0).alias("seq"), "text")
    return plain.unionByName(paged).unionByName(structured), rejects


# --- stores ---------------------------------------------------------------------------------------------------------


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; entries that do not parse are skipped. Of a folder that write_registry wrote, the newest version."""
    info = versions.manifest(spark, path)
    place = f"{path}/data/{info['folders'][0]}" if info else path
    return spark.read.schema(REGISTRY).option("mode", "DROPMALFORMED").json(place)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY).option("mode", "DROPMALFORMED").json(path)


def write_registry(registry: DataFrame, path: str) -> None:
    """The registry as JSON lines, newest first: files in order, each in order. A new version: the rows may come from the
    stored registry itself, and a failed job leaves that as it was."""
    spark, after, folder = registry.sparkSession, versions.current(registry.sparkSession, path), versions.new_folder()
    in_order = registry.select([f.name for f in REGISTRY if f.name in registry.columns])
    in_order.orderBy(F.desc("uploaded_at"), "id").write.json(f"{path}/data/{folder}")
    versions.commit(spark, path, {"folders": [folder]}, after)


def append_history(entries: DataFrame, path: str) -> None:
    """Adds answered questions to the stored history; what is there stays."""
    entries.select([f.name for f in HISTORY]).write.mode("append").json(path)
