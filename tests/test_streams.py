"""Streams of versions and deletes, compaction, replays, and the retained history."""

import pytest
from pyspark.sql import functions as F

from askloom.operators import chunk, report
from askloom.sources import versions
from askloom.streaming import jobs


@pytest.fixture
def feed(spark, tmp_path):
    """A function that adds rows (id, v, gone) to a stream's source and runs it."""
    schema = "id int, v string, gone boolean"

    def run(rows, compact_after=jobs.COMPACT, work=lambda batch: batch.filter("v <> ''").select("id", "v")):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = jobs.read_parquet_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)
        jobs.ingest_stream(source, work, f"{tmp_path}/t", f"{tmp_path}/c", "id", F.col("gone"), compact_after).awaitTermination()
        return sorted((r["id"], r["v"]) for r in jobs.latest(spark, f"{tmp_path}/t").collect())

    run.table = f"{tmp_path}/t"
    return run


def test_blank_versions_and_deletes(feed):
    assert feed([(1, "a", False), (1, "b", False), (2, "c", None), (3, "d", False)]) == [(1, "a"), (1, "b"), (2, "c"), (3, "d")]
    assert feed([(1, "", False), (2, "e", False)]) == [(2, "e"), (3, "d")]
    assert feed([(3, "x", True), (4, "f", False)]) == [(2, "e"), (4, "f")]
    assert feed([(3, "back", False), (2, "", False)]) == [(3, "back"), (4, "f")]


def test_a_blank_document_has_no_chunks(spark, tmp_path):
    def run(text):
        rows = spark.createDataFrame([("d1", "a.txt", text)], "doc_id string, filename string, text string")
        rows.write.mode("append").parquet(f"{tmp_path}/in")
        source = jobs.read_parquet_stream(spark, f"{tmp_path}/in", rows.schema)
        jobs.ingest_stream(source, lambda b: chunk.chunk_documents(chunk.as_documents(b)), f"{tmp_path}/t", f"{tmp_path}/c", "doc_id").awaitTermination()
        return jobs.latest(spark, f"{tmp_path}/t").count()

    assert run("A text of some words.") == 1
    assert run(" \n ") == 0


def test_compaction_in_place(spark, feed):
    for k in range(5):
        got = feed([(k, f"v{k}", False), (0, "" if k == 4 else f"w{k}", False)], compact_after=3)
    assert got == [(k, f"v{k}") for k in range(1, 4)] + [(4, "v4")]
    assert len(versions.manifest(spark, feed.table)["folders"]) < 3
    assert jobs.clear(spark, feed.table)
    assert feed([(9, "z", False)]) == [*got, (9, "z")]


def test_a_batch_that_runs_again_adds_nothing(spark, feed, monkeypatch):
    feed([(1, "a", False)])
    before = versions.manifest(spark, feed.table)
    real = versions.manifest
    monkeypatch.setattr(versions, "manifest", lambda s, p, v=None: real(s, p, v) | {"last": 5})
    feed([(1, "b", False)])
    monkeypatch.undo()
    assert versions.manifest(spark, feed.table) == before


def test_a_failed_batch_shows_nothing(spark, feed):
    first = feed([(1, "a", False)])

    @F.udf("string")
    def fail(v):
        raise ValueError("lost")

    with pytest.raises(Exception, match="lost"):
        feed([(1, "b", False), (2, "c", False)], work=lambda batch: batch.select("id", fail("v").alias("v")))
    assert sorted((r["id"], r["v"]) for r in jobs.latest(spark, feed.table).collect()) == first
    assert feed([(3, "d", False)]) == [(1, "b"), (2, "c"), (3, "d")]


def test_retained_report_equals_the_batch_one(spark, tmp_path):
    rows = spark.range(1200).select(F.col("id"), (F.col("id") * 7919 % 1000 / 10).alias("response_time_ms"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=(F.col("id") * 31 % 700).cast("int"))).alias("created_at"))
    for part in range(3):
        rows.filter(F.col("id") % 3 == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = jobs.read_parquet_stream(spark, f"{tmp_path}/in", rows.schema, 1)
        jobs.recent_stream(source, f"{tmp_path}/t", f"{tmp_path}/c").awaitTermination()
        so_far = rows.filter(F.col("id") % 3 <= part)
        assert report.latency_stats(jobs.recent_rows(spark, f"{tmp_path}/t")).first() == report.latency_stats(report.recent(so_far)).first()
    assert jobs.recent_rows(spark, f"{tmp_path}/t").count() == 500


def test_latest_shuffles_no_rows(spark, tmp_path):
    """The rows that count are found without a shuffle of rows, also where newer batches hide some."""
    for k, keys in enumerate(([1, 2, 3], [2, 4], [2])):
        spark.createDataFrame([(i, k) for i in keys], "id int, v int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = jobs.read_parquet_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
        jobs.ingest_stream(source, lambda rows: rows, f"{tmp_path}/table", f"{tmp_path}/checkpoint", "id").awaitTermination()
        found = jobs.latest(spark, f"{tmp_path}/table")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan
        assert "HashAggregate" not in plan
    assert sorted(map(tuple, found.collect())) == [(1, 0), (2, 2), (3, 0), (4, 1)]
