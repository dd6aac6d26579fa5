from hypothesis import given, settings
from hypothesis import strategies as st

from askloom.operators import chunk

SENTENCE = "The quick brown fox jumps over the lazy dog near the river bank. "


@given(st.text(alphabet="ab .,;?!\n", max_size=3000), st.integers(5, 120), st.integers(0, 40))
@settings(max_examples=200, deadline=None)
def test_windows_are_exact(text, size, overlap):
    found = chunk.windows(text, size, overlap)
    assert all(0 < b - a <= size and text[a:b] == text[a:b].strip() for a, b in found)
    covered = set().union(*(range(a, b) for a, b in found)) if found else set()
    assert all(text[k].isspace() for k in range(len(text)) if k not in covered)
    assert [a for a, _ in found] == sorted(a for a, _ in found)


@given(st.text(alphabet="ab .\n", max_size=2000), st.integers(1, 60))
@settings(max_examples=200, deadline=None)
def test_pieces_tile(text, size):
    pieces = list(chunk._pieces(text, 0, len(text), size))
    assert "".join(text[a:b] for a, b in pieces) == text
    assert all(0 < b - a <= size for a, b in pieces)


def test_sections_overlap():
    found = chunk.windows("\n\n".join([SENTENCE * 3] * 4), 500, 100)
    assert len(found) > 1
    assert any(b[0] < a[1] for a, b in zip(found, found[1:]))


def test_long_run_of_words():
    text = "word " * 400
    assert sum(len(text[a:b].split()) for a, b in chunk.windows(text)) >= 400


def test_documents(spark):
    rows = [("d1", "a.txt", 1, 0, SENTENCE * 2), ("d1", "a.txt", 2, 1, SENTENCE * 20), ("d2", "b.txt", None, 0, " \n "), ("d3", "c.txt", None, 0, None)]
    segments = spark.createDataFrame(rows, "doc_id string, filename string, page int, seq int, text string")
    got = chunk.chunk_documents(segments).orderBy("chunk_index").collect()
    assert {r["doc_id"] for r in got} == {"d1"}
    assert [r["chunk_index"] for r in got] == list(range(len(got)))
    assert {r["page"] for r in got} <= {1, 2} and got[0]["page"] == 1
    assert got[0]["chunk_id"] == "d1::00000" and all(r["char_count"] <= 500 for r in got)


def test_bibliography_chunks_are_flagged(spark):
    body = "\n".join(f"{k}. Section {k}\nThe finding number {k} is told here at some length, so that chunks fill [1]." for k in range(1, 21))
    entries = "\nReferences\n" + "\n".join(f"[{k}] A. Author, a title of some length\nof the work, 20{k:02d}." for k in range(1, 9))
    segments = spark.createDataFrame([("d", "a.txt", None, 0, body + entries)], "doc_id string, filename string, page int, seq int, text string")
    got = chunk.chunk_documents(segments).orderBy("chunk_index").collect()
    assert any(r["is_reference"] for r in got) and not got[0]["is_reference"]


def test_table_function(spark):
    chunk.register(spark, "chunks_of")
    spark.createDataFrame([(1, "word " * 300)], "id int, body string").createOrReplaceTempView("bodies")
    assert spark.sql("SELECT id, c.* FROM bodies, LATERAL chunks_of(body) c").count() > 1
