import pytest
from pyspark.sql import functions as F

from askloom.functions import text as tx
from askloom.operators import answer, lifecycle, report, retrieve
from askloom.schemas import EMPTY_CORPUS, NO_ANSWER

HIT = "question_id int, question string, rank int, chunk_id string, doc_id string, filename string, chunk_index int, page int, text string, score double, is_reference boolean"


def hits(spark, *rows):
    """(rank, filename, page, text, score, is_reference) of question 1."""
    question = "what is retrieval grounding"
    return spark.createDataFrame([(1, question, r, f"{f}::{r}", f, f, r, p, t, s, ref) for r, f, p, t, s, ref in rows], HIT)


PROSE = "Retrieval grounding checks that the context supports an answer."
CITATION = "[1] A. Author, Retrieval grounding in practice, a long citation of the work."


def test_demotion(spark):
    df = hits(spark, (1, "a.txt", 1, "x", 0.60, True), (2, "b.txt", 1, "y", 0.42, False), (3, "c.txt", 1, "z", 0.04, False)).drop("rank")
    got = {r["chunk_id"]: (r["rank"], r["score"]) for r in retrieve.rerank(df).collect()}
    assert got == {"b.txt::2": (1, 0.42), "a.txt::1": (2, 0.21)}


def test_context_labels(spark):
    out = answer.contexts(hits(spark, (1, "a.txt", 3, PROSE, 0.5, False), (2, "b.txt", None, CITATION, 0.4, True))).first()
    assert out["context"].startswith("[Source 1] file: a.txt | chunk 1 | page 3\n" + PROSE + "\n\n[Source 2] file: b.txt | chunk 2 | bibliography\n")
    assert out["coverage_text"].startswith("a.txt 3 Retrieval")


def test_never_quotes_citations(spark):
    both = hits(spark, (1, "a.txt", 3, PROSE, 0.5, False), (2, "b.txt", None, CITATION, 0.4, True))
    assert answer.extract(both).first()["answer"] == PROSE
    assert answer.extract(both.filter("is_reference")).count() == 0


def test_sources_stay_apart(spark):
    two = hits(spark, (1, "a.txt", 1, "Grounding starts here with one unterminated text", 0.5, False), (2, "b.txt", 1, "Retrieval goes on there with another such text", 0.4, False))
    rows = answer.sentence_rows(two).orderBy("rank").collect()
    assert [(r["filename"], r["sentence"][:9]) for r in rows] == [("a.txt", "Grounding"), ("b.txt", "Retrieval")]


def test_headings_are_not_glued(spark):
    text = "2 Related Work\n" + PROSE
    rows = [r["sentence"] for r in answer.sentence_rows(hits(spark, (1, "a.txt", 1, text, 0.5, False))).collect()]
    assert rows == [PROSE]


def test_contained_sentences_go(spark):
    rows = hits(spark, (1, "a.txt", 1, PROSE, 0.5, False), (2, "b.txt", 1, "In short: " + PROSE[0].lower() + PROSE[1:], 0.4, False), (3, "c.txt", 1, "Grounding is another matter here.", 0.3, False))
    assert answer.extract(rows).first()["answer"] == PROSE + " Grounding is another matter here."


def test_budget(one):
    text = "First sentence here. Second sentence here. Third one."
    assert one(lambda c: answer.within_budget(c, 45), text) == "First sentence here. Second sentence here."
    assert one(lambda c: answer.within_budget(c, 5), "abcdefgh") == "abcdefgh"
    assert one(lambda c: answer.within_budget(c, 500), text) == text


def test_filename_counts_for_coverage(one):
    cover = lambda a, b: tx.coverage(tx.content_terms(a), tx.content_terms(b))
    assert one(cover, "what is dav?", "Experiment_5_DAV.docx 1 body") == 1.0
    assert one(cover, "what is dav?", "1 body") == 0.0


def questions(spark, *texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts, 1)], "question_id int, question string")


def test_answers(spark):
    found = hits(spark, (1, "a.txt", 1, PROSE, 0.6, False), (2, "b.txt", 2, "Something else altogether is told in this line.", 0.2, False))
    asked = questions(spark, "what is retrieval grounding", "who wrote quantum gravity")
    got = {r["question_id"]: r for r in answer.answer(asked, found, 9).collect()}
    assert got[1]["grounded"] and got[1]["answer"] == PROSE and len(got[1]["sources"]) == 2
    assert got[1]["confidence"] == pytest.approx(0.45 * 0.8 + 0.35 + 0.2) and got[1]["confidence_label"] == "High confidence"
    assert got[2]["abstained"] and got[2]["answer"] == NO_ANSWER and not got[2]["sources"] and got[2]["confidence"] == 0
    assert answer.answer(asked, found.limit(0), 0).first()["answer"] == EMPTY_CORPUS
    echo = answer.answer(asked, found, 9, model=lambda: lambda prompts: [p[-7:] for p in prompts]).filter("question_id = 1").first()
    assert echo["answer"] == "Answer:"


def test_questions_are_checked(spark):
    good, bad = retrieve.validate(questions(spark, "ok", "  ", None, "x" * 2001))
    assert good.count() == 1 and {r["code"] for r in bad.collect()} == {"invalid_question"} and bad.count() == 3


def test_reports(spark):
    history = spark.createDataFrame([(1, 10.0, "2024-01-01"), (2, 31.0, "2024-01-02")], "id int, response_time_ms double, day string").select("id", "response_time_ms", F.col("day").cast("timestamp").alias("created_at"))
    row = report.latency_stats(history).first()
    assert (row["questions_asked"], row["average_response_time_ms"], row["fastest_response_ms"]) == (2, 20.5, 10.0)
    none = report.latency_stats(history.limit(0)).first()
    assert (none["average_response_time_ms"], none["fastest_response_ms"], none["last_question_at"]) == (0.0, None, None)
    assert [r["id"] for r in report.recent(history, 1).collect()] == [2]
    assert report.outcome(spark.createDataFrame([(None,), ("empty_file",)], "code string")).first()["message"] == "1 document(s) processed, 1 failed"


SEGMENT = "doc_id string, filename string, page int, seq int, text string"


def test_lifecycle(spark):
    rows = [("d1", "one.txt", 1, 0, "Grounding " * 80 + "ends."), ("d2", "two.txt", None, 0, "Retrieval is a search. " * 40), ("d3", "three.md", None, 0, "x"), ("d4", "four.txt", None, 0, " ")]
    made = lifecycle.ingest(spark.createDataFrame(rows, SEGMENT))
    assert {(r["filename"], r["code"]) for r in made.rejects.collect()} == {("three.md", "unsupported_file_type"), ("four.txt", "empty_file")}
    assert {(r["id"], r["status"]) for r in made.registry.collect()} == {("d1", "ready"), ("d2", "ready")}
    ids = lambda corpus: sorted({r["doc_id"] for r in corpus.vectors.select("doc_id").collect()})
    chunks = lambda corpus: sorted((r["chunk_id"], r["text"]) for r in corpus.vectors.select("chunk_id", "text").collect())
    assert chunks(lifecycle.rebuild(made)) == chunks(made)
    gone = lifecycle.delete(made, spark.createDataFrame([("d1",)], "doc_id string"))
    assert ids(gone) == ["d2"] and ids(lifecycle.rebuild(gone)) == ["d2"]
    again = lifecycle.upload(made, spark.createDataFrame([("d9", "one.txt", 1, 0, rows[0][4])], SEGMENT))
    assert ids(again) == ["d2", "d9"]
    empty, counts = lifecycle.reset(made)
    assert counts["documents"] == 2 and empty.vectors.count() == 0
    assert ids(lifecycle.reindex(made, spark.createDataFrame([("d2",)], "doc_id string"))) == ["d1", "d2"]
