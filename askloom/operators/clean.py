"""Corpus cleaning: furniture, page spans and the start of the bibliography.

Segments are rows (doc_id, page, seq, text). Detection runs on lines that are already repaired (characters, hyphens,
blanks), so a line that repair changes is still recognised. There are line-table jobs for segments wherever they are, and
column functions for documents that are one row each: `whole_documents` cleans those without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askloom.functions import text as tx
from askloom.schemas import DEFAULT


def boilerplate(segments: DataFrame, min_occurrences: int = DEFAULT.min_occurrences) -> DataFrame:
    """(doc_id, line): running headers and footers, rules, and page markers where a document has three or more."""
    rows = segments.select("doc_id", F.split("text", "\n").alias("lines"))
    n_lines = rows.groupBy("doc_id").agg(F.sum(F.size("lines")).alias("n_lines")).filter(F.col("n_lines") >= min_occurrences)
    counts = (
        rows.select("doc_id", F.explode("lines").alias("line"))
        .select("doc_id", tx.strip(F.col("line")).alias("line"))
        .filter("line <> ''")
        .groupBy("doc_id", "line")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(n_lines, "doc_id")
    )
    often = F.col("n") >= F.greatest(F.lit(min_occurrences), F.floor(F.col("n_lines") * 0.05))
    short = (F.length("line") < 90) | tx.is_rule(F.col("line"))
    repeated = counts.filter(often & short).select("doc_id", "line")
    markers = counts.filter(tx.is_page_marker(F.col("line")))
    paged = markers.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).filter("k >= 3")
    return repeated.union(markers.join(paged, "doc_id", "left_semi").select("doc_id", "line")).distinct()


def drop_furniture(segments: DataFrame, furniture: DataFrame) -> DataFrame:
    """segments without the given lines of their document; blank lines stay, then blanks are collapsed again."""
    sets = furniture.groupBy("doc_id").agg(F.collect_set("line").alias("furniture"))
    kept = F.filter(F.split("text", "\n"), lambda x: (tx.strip(x) == "") | ~F.array_contains(F.col("furniture"), tx.strip(x)))
    text = F.when(F.col("furniture").isNull(), F.col("text")).otherwise(tx.collapse_whitespace(F.array_join(kept, "\n")))
    return segments.join(sets, "doc_id", "left").withColumn("text", text).drop("furniture")


def clean_segments(segments: DataFrame, min_occurrences: int = DEFAULT.min_occurrences) -> DataFrame:
    """The full pass: repair each segment, find furniture over the document, remove it segment by segment, strip."""
    repaired = segments.withColumn("text", tx.clean_basic(F.coalesce("text", F.lit(""))))
    out = drop_furniture(repaired, boilerplate(repaired, min_occurrences))
    return out.withColumn("text", tx.strip(F.col("text")))


def spans(segments: DataFrame) -> DataFrame:
    """Adds start and end of each non-blank segment in the document's text (segments joined by a blank line)."""
    before = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0))
    return segments.filter(tx.strip(F.col("text")) != "").withColumn("start", start.cast("int")).withColumn("end", (start + F.length("text")).cast("int"))


def documents(segments: DataFrame) -> DataFrame:
    """(doc_id, clean_text, pages): segments joined in order, with the span of each numbered page."""
    whole = F.expr("listagg(text, '\n\n') WITHIN GROUP (ORDER BY seq)")
    pages = F.array_sort(F.collect_list(F.when(F.col("page").isNotNull(), F.struct("start", "end", "page"))))
    return spans(segments).groupBy("doc_id").agg(whole.alias("clean_text"), pages.alias("pages"))


def page_of(start: Column, pages: Column) -> Column:
    """The page whose span holds an offset, else the last page; null without pages."""
    holds = F.filter(pages, lambda p: (p["start"] <= start) & (start < p["end"]))
    return F.coalesce(F.get(holds, F.lit(0))["page"], F.get(pages, F.size(pages) - 1)["page"])


def with_pages(chunks: DataFrame, page_spans: DataFrame) -> DataFrame:
    """chunks(doc_id, char_start, ...) joined with (doc_id, page, start, end) by range; beyond the last page, that one."""
    last = page_spans.groupBy("doc_id").agg(F.max_by("page", "start").alias("last_page"))
    inside = (F.col("c.doc_id") == F.col("p.doc_id")) & (F.col("char_start") >= F.col("start")) & (F.col("char_start") < F.col("end"))
    found = chunks.alias("c").join(page_spans.alias("p"), inside, "left").select("c.*", F.col("p.page").alias("page"))
    return found.join(last, "doc_id", "left").withColumn("page", F.coalesce("page", "last_page")).drop("last_page")


def reference_start(docs: DataFrame, sample_lines: int = 40, ratio: float = 0.15) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, ref_start): offset of the last heading that a list of citations follows.

    Of the next `sample_lines` non-blank lines (three at least) a share of `ratio` must look like entries. Only documents
    that have such a heading are taken apart into lines.
    """
    heading = "(?m)" + tx.REFERENCE_HEADING
    lines = docs.filter(F.col("text").rlike(heading)).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    in_order = Window.partitionBy("doc_id").orderBy("pos")
    offset = F.coalesce(F.sum(F.length("line") + 1).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    following = in_order.rowsBetween(1, sample_lines)
    entry = tx.is_citation_entry(F.col("line")).cast("double")
    looked = (
        lines.withColumn("offset", offset)
        .filter(tx.strip(F.col("line")) != "")
        .withColumn("share", F.avg(entry).over(following))
        .withColumn("ahead", F.count(F.lit(1)).over(following))
    )
    hits = looked.filter(tx.is_reference_heading(F.col("line")) & (F.col("ahead") >= 3) & (F.col("share") >= ratio))
    found = hits.groupBy("doc_id").agg(F.max("offset").cast("int").alias("ref_start"))
    return docs.select("doc_id").join(found, "doc_id", "left")


# --- documents that are one row each --------------------------------------------------------------------------------


def furniture_of(sorted_lines: Column, n_lines: Column, min_occurrences: int = DEFAULT.min_occurrences) -> Column:
    """The furniture of one document, from its stripped, non-blank lines in order: equal lines are neighbours, so a line
    that occurs k times stands k - 1 places further, too. Both arguments should be columns, not computations."""
    k = F.greatest(F.lit(min_occurrences), F.floor(n_lines * 0.05).cast("int"))
    often = F.filter(sorted_lines, lambda x, i: (F.get(sorted_lines, i + k - 1) == x) & ((F.length(x) < 90) | tx.is_rule(x)))
    markers = F.array_distinct(F.filter(sorted_lines, tx.is_page_marker))
    found = F.array_union(often, F.when(F.size(markers) >= 3, markers).otherwise(F.array().cast("array<string>")))
    return F.when(n_lines >= min_occurrences, found).otherwise(F.array().cast("array<string>"))


def reference_start_of(text: Column, sample_lines: int = 40, ratio: float = 0.15) -> Column:
    """As reference_start, for one text; should be a column, not a computation."""
    lines = F.split(text, "\n")
    numbered = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("line"))), lambda r: tx.strip(r["line"]) != "")

    def starts(rows: Column) -> Column:
        ahead = lambda i: F.slice(rows, i + 2, F.lit(sample_lines))
        share = lambda x: F.size(F.filter(x, lambda r: tx.is_citation_entry(r["line"]))) / F.size(x)
        marked = F.transform(rows, lambda r, i: F.when(tx.is_reference_heading(r["line"]) & (F.size(ahead(i)) >= 3) & (share(ahead(i)) >= ratio), r["i"]))
        last = F.array_max(marked)
        return F.when(last == 0, F.lit(0)).when(last > 0, F.length(F.array_join(F.slice(lines, F.lit(1), last), "\n")) + 1)

    # the rows are bound once, by a transform over an array of one
    return F.when(text.rlike("(?m)" + tx.REFERENCE_HEADING), F.get(F.transform(F.array(numbered), starts), F.lit(0))).cast("int")


def whole_documents(docs: DataFrame, min_occurrences: int = DEFAULT.min_occurrences) -> DataFrame:
    """docs(segments: array of (seq, page, text) in order, anything else) -> the other columns, clean_text, pages and
    ref_start: the same as clean_segments, documents and reference_start, in one pass over the rows."""
    others = [c for c in docs.columns if c != "segments"]
    repaired = F.transform("segments", lambda s: F.struct(s["page"].alias("page"), tx.clean_basic(F.coalesce(s["text"], F.lit(""))).alias("text")))
    lines = F.flatten(F.transform("repaired", lambda s: F.split(s["text"], "\n")))
    solid = F.array_sort(F.filter(F.transform("lines", tx.strip), lambda x: x != ""))
    out = docs.withColumn("repaired", repaired).withColumn("lines", lines).withColumn("n_lines", F.size("lines")).withColumn("sorted", solid)
    out = out.withColumn("furniture", furniture_of(F.col("sorted"), F.col("n_lines"), min_occurrences))

    def without(text: Column) -> Column:
        kept = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(F.col("furniture"), tx.strip(x)))
        return F.when(F.size("furniture") == 0, text).otherwise(tx.collapse_whitespace(F.array_join(kept, "\n")))

    kept = F.filter(F.transform("repaired", lambda s: F.struct(s["page"].alias("page"), tx.strip(without(s["text"])).alias("text"))), lambda s: s["text"] != "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,page:int>>").alias("spans"))
    span = lambda s, x: F.struct(s["at"].alias("start"), (s["at"] + F.length(x["text"])).alias("end"), x["page"].alias("page"))
    placed = F.aggregate("kept", start, lambda s, x: F.struct((s["at"] + F.length(x["text"]) + 2).alias("at"), F.concat(s["spans"], F.array(span(s, x))).alias("spans")))
    out = out.withColumn("kept", kept).withColumn("clean_text", F.array_join(F.transform("kept", lambda s: s["text"]), "\n\n"))
    out = out.withColumn("pages", F.array_sort(F.filter(placed["spans"], lambda p: p["page"].isNotNull())))
    # a generator of one row: the filter stays above it, where it finds the text made, and is not pushed into its making
    made = out.select(*others, F.inline(F.array(F.struct("clean_text", "pages"))))
    return made.filter("clean_text <> ''").withColumn("ref_start", reference_start_of(F.col("clean_text")))
