from pyspark.sql import functions as F

from askloom.operators import clean


def segments(spark, *texts):
    return spark.createDataFrame([("d", k + 1, k, t) for k, t in enumerate(texts)], "doc_id string, page int, seq int, text string")


def bibliography(body: int, tail: str) -> str:
    return "\n".join(f"{k}. Section {k}\nThe finding number {k} is told here [1]." for k in range(1, body + 1)) + tail


ENTRIES = "\nReferences\n" + "\n".join(f"[{k}] A. Author, a title\n   of the work, 20{k:02d}." for k in range(1, 6))


def test_page_markers_go(spark):
    text = "A paragraph that stays.\n" + "\n".join(f"Page {k} of 20" for k in range(1, 21))
    out = clean.clean_segments(segments(spark, text)).first()["text"]
    assert out == "A paragraph that stays."


def test_running_header_is_found_over_all_pages(spark):
    pages = [f"My Journal\npage text number {k}" for k in range(5)]
    out = [r["text"] for r in clean.clean_segments(segments(spark, *pages)).orderBy("seq").collect()]
    assert out == [f"page text number {k}" for k in range(5)]


def test_short_documents_have_no_boilerplate(spark):
    assert clean.boilerplate(segments(spark, "x\nx\nx")).count() == 0


def test_reference_start(spark):
    cases = {
        "yes": bibliography(12, ENTRIES), "none": bibliography(12, ""), "prose": "We follow the references given.\n" + bibliography(12, ""),
        "heading only": bibliography(12, "\nReferences\nThis is prose.\nMore prose.\nAnd more."), "empty": "", "null": None,
    }
    docs = spark.createDataFrame(list(cases.items()), "doc_id string, text string")
    got = {r["doc_id"]: r["ref_start"] for r in clean.reference_start(docs).collect()}
    assert got.pop("yes") == cases["yes"].index("References")
    assert set(got.values()) == {None} and len(got) == 5


def test_spans_and_pages(spark):
    whole = clean.documents(segments(spark, "first page", "", "third")).first()
    assert whole["clean_text"] == "first page\n\nthird"
    assert [(p["start"], p["end"], p["page"]) for p in whole["pages"]] == [(0, 10, 1), (12, 17, 3)]
    spans = clean.spans(segments(spark, "first page", "", "third")).select("doc_id", "page", "start", "end")
    starts = spark.createDataFrame([("d", x) for x in (0, 9, 12, 99)], "doc_id string, char_start int")
    got = {r["char_start"]: r["page"] for r in clean.with_pages(starts, spans).collect()}
    assert got == {0: 1, 9: 1, 12: 3, 99: 3}
    row = clean.documents(segments(spark, "first page", "third")).select(clean.page_of(F.lit(13), F.col("pages")).alias("p")).first()
    assert row["p"] == 2
