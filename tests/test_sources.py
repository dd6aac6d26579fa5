import json

import pytest
from pyspark.sql import functions as F

from askloom.schemas import WORDS
from askloom.sources import readers
from askloom.streaming import jobs


@pytest.mark.parametrize(
    "content, text",
    [
        ("plain é".encode(), "plain é"), (b"\xef\xbb\xbfmarked", "marked"), ("wide é".encode("utf-16"), "wide é"), ("“q” é €".encode("cp1252"), "“q” é €"),
        (b"\x81\xe9", "\x81é"), (b"", ""),
    ],
)
def test_decoding(spark, content, text):
    df = spark.createDataFrame([(bytearray(content),)], "content binary")
    assert df.select(readers.decode_text(F.col("content")).alias("t")).first()["t"] == text


def test_corpus_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, body in (("a.txt", "one"), ("sub/b.TXT", "two"), ("c.md", "no"), (".hidden.txt", "no"), ("blank.txt", " \n")):
        (tmp_path / name).write_text(body)
    files = readers.scan_corpus(spark, str(tmp_path))
    assert sorted(r["filename"] for r in files.collect()) == ["a.txt", "b.TXT", "blank.txt"]
    decoded = files.withColumn("text", readers.decode_text(F.col("content")))
    good, bad = readers.split_rejects(decoded, readers.reject_code(F.col("extension"), F.col("size_bytes"), F.col("text")))
    assert good.count() == 2 and [tuple(r) for r in bad.collect()] == [("blank.txt", "empty_file")]
    segments = readers.text_segments(good.withColumn("doc_id", F.col("filename")))
    assert {r["text"] for r in segments.collect()} == {"one", "two"}


def words(spark, rows):
    return spark.createDataFrame([("d", 1, 612.0, t, float(a), float(b), float(top)) for t, a, b, top in rows], WORDS)


def test_two_columns(spark):
    left = [(f"left{k:02d}", 40, 290, 12 * k) for k in range(40)]
    right = [(f"right{k:02d}", 320, 560, 12 * k) for k in range(40)]
    page = words(spark, left + right)
    gap = readers.gutters(page).first()
    assert 290 <= gap["gutter_start"] < gap["gutter_end"] <= 320
    lines = readers.reading_order(page).first()["text"].split("\n")
    assert lines[:40] == [w[0] for w in left] and lines[41:] == [w[0] for w in right]


def test_one_column(spark):
    page = words(spark, [(f"full{k:02d}", 40, 570, 12 * k) for k in range(45)])
    assert readers.gutters(page).count() == 0
    assert readers.reading_order(page).first()["text"].startswith("full00\nfull01")


def test_blocks(spark):
    rows = [("d", 0, "paragraph", "Heading 1", " Title ", None), ("d", 1, "paragraph", "Normal", "body", None), ("d", 2, "table_row", None, None, ["a ", "", "b"]), ("d", 3, "table_row", None, None, [" ", None]), ("d", 4, "footer", None, "foot", None)]
    blocks = spark.createDataFrame(rows, "doc_id string, seq int, kind string, style string, text string, cells array<string>")
    assert readers.flatten_blocks(blocks).first()["text"] == "## Title\n\nbody\n\na |  | b\n\nfoot"


def test_stores(spark, tmp_path):
    entry = {"id": "h1", "question": "q", "confidence": 0.5, "sources": [{"filename": "a.txt", "chunk_index": 1}]}
    (tmp_path / "h.json").write_text(json.dumps(entry) + "\n{broken\n")
    rows = readers.read_history(spark, str(tmp_path / "h.json")).collect()
    assert len(rows) == 1 and rows[0]["sources"][0]["filename"] == "a.txt"
    (tmp_path / "r.json").write_text(json.dumps({"id": "d1", "status": "ready", "chunk_count": 3}) + "\n[\n")
    assert [r["chunk_count"] for r in readers.read_registry(spark, str(tmp_path / "r.json")).collect()] == [3]


def test_stream_replays_do_not_double(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string").coalesce(1).write.parquet(str(source))
    spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string").coalesce(1).write.mode("append").parquet(str(source))
    stream = jobs.read_parquet_stream(spark, str(source), spark.read.parquet(str(source)).schema, 1)
    running = jobs.ingest_stream(stream, lambda rows: rows, str(tmp_path / "table"), str(tmp_path / "checkpoint"), "id")
    running.awaitTermination()
    got = jobs.latest(spark, str(tmp_path / "table"), running)
    assert sorted(r["id"] for r in got.collect()) == [1, 2, 3]


def test_page_counts(spark):
    segments = spark.createDataFrame([("d", 1, " "), ("d", 2, "x"), ("e", 1, None)], "doc_id string, page int, text string")
    assert {r["doc_id"]: (r["page_count"], r["blank"]) for r in readers.page_counts(segments).collect()} == {"d": (2, False), "e": (1, True)}


def test_folder_scan(spark, tmp_path):
    """Files of no bytes and too large ones are listed and not opened; hidden files and folders are not listed."""
    from dataclasses import replace

    from askloom.schemas import DEFAULT
    from askloom.sources import folder

    files = {
        "a.txt": b"words here", "deep/er/b.TXT": b"more words", "deep/empty.txt": b"", "deep/blank.txt": b" \n\t", "big.txt": b"x" * 101, "c.md": b"no", ".d.txt": b"hidden",
        ".git/e.txt": b"hidden", "f": b"no extension", "g.pdf": b"%PDF", "sp ace/ü.txt": "grün".encode(),
    }
    rows = spark.createDataFrame([(n, bytearray(c)) for n, c in files.items()], "filename string, content binary").repartition(3)
    assert tuple(folder.write_files(rows, f"{tmp_path}/in").first()) == (len(files), sum(map(len, files.values())))
    for locked in ("deep/empty.txt", "big.txt", "c.md"):
        (tmp_path / "in" / locked).chmod(0)
    config = replace(DEFAULT, max_upload_bytes=100)
    for least in (1, folder.LEAST):
        folder.FolderReader(f"{tmp_path}/in", least).partitions()
    got = {r["path"].removeprefix(f"{tmp_path}/in/"): r for r in folder.scan(spark, f"file://{tmp_path}/in", config).collect()}
    code = {k: r["code"] for k, r in got.items()}
    assert code == {
        "a.txt": None, "deep/er/b.TXT": None, "deep/empty.txt": "empty_file", "deep/blank.txt": None, "big.txt": "file_too_large", "c.md": "unsupported_file_type",
        "f": "unsupported_file_type", "g.pdf": None, "sp ace/ü.txt": None,
    }
    assert all((r["content"] is None) == (r["code"] is not None) and (r["content"] is None or bytes(r["content"]) == files[k]) for k, r in got.items())
    good, rejects = folder.ingested(folder.scan(spark, f"{tmp_path}/in", config), config)
    assert sorted(r["text"] for r in good.collect()) == ["grün", "more words", "words here"]
    assert {r["filename"]: r["code"] for r in rejects.collect()}["blank.txt"] == "empty_file"
    (tmp_path / "none").mkdir()
    assert folder.scan(spark, f"{tmp_path}/none").count() == 0


def test_a_wide_tree_is_listed_by_tasks(spark, tmp_path):
    from askloom.sources import folder

    for k in range(9):
        (tmp_path / f"d{k % 3}" / f"e{k}").mkdir(parents=True)
        (tmp_path / f"d{k % 3}" / f"e{k}" / "x.txt").write_text("x")
        (tmp_path / f"d{k % 3}" / f"{k}.txt").write_text("y")
    parts = folder.FolderReader(str(tmp_path), 5).partitions()
    assert len(parts) == 1 + 3 + 9
    listed = [r["path"] for r in folder.listing(spark, str(tmp_path)).collect()]
    assert len(listed) == len(set(listed)) == 18


def test_columns_of_a_page_are_taken_apart_once(spark):
    """The gutter comes from the distinct spans of a page's boxes, however many words stand in them."""
    from pyspark.sql import functions as F

    words = spark.range(800).select(F.lit(1).alias("doc_id"), F.lit(0).alias("page"), F.lit(612.0).alias("page_width"), F.lit("word").alias("text"), (F.when(F.col("id") % 2 == 0, 40.0).otherwise(330.0)).alias("x0"), (F.when(F.col("id") % 2 == 0, 280.0).otherwise(570.0)).alias("x1"), F.floor(F.col("id") / 2).cast("double").alias("top"))
    found = readers.gutters(words)
    assert [tuple(r) for r in found.collect()] == [(1, 0, 280, 330)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert any("Aggregate" in after for after in plan.split("Generate explode(sequence")[1:2]) and "Aggregate" in plan.split("Generate explode(sequence")[1].split("Join")[0]
