"""The registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.llm import decontaminate, html_text, jaccard_join, mixing, near_vectors, oracles, quality, resampling, search, secrets_scan, sharding, token_store, url_filter, warc
from askloom.sources.storage import spread_out

#: Rules of the URL contract: (verdict, host, path).
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread_out(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs).select("doc_id", "size", "source", "source_size", "target", "taken")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.groups(table(spark, sf_dir, "documents"), width=4, percent=85)


def op3_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pq_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"), 0.98, reach=1.0)


def op5_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_suffix_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_html_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is a bad outcome if the label with its number says low quality or toxic."""
    labels = table(spark, sf_dir, "labels")
    bad = ((F.col("quality") == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return url_filter.judge(table(spark, sf_dir, "pages"), outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_store.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op11_lemp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def op12_char_cnn_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds are listed as assign, access, hex and net (the network's)."""
    out = secrets_scan.report(table(spark, sf_dir, "documents"))

    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{secrets_scan.KINDS[kind]}")

    counts = [count(kind) for kind in range(3)]
    return out.select("doc_id", *counts, F.sha2(secrets_scan.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), secrets_scan.listed(F.col("spans")).alias("spans"))


def op13_bit_sliced_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, min_words=20)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_jaccard_join, op3_quality_qda, op4_pq_near_vectors, op5_kd_tree_shards, op6_huffman_tokens, op7_suffix_decontaminate, op8_html_line_blocks, op9_url_reputation, op10_warc_bundles, op11_lemp_search, op12_char_cnn_secrets, op13_bit_sliced_resampling)}
ORACLES = oracles.ORACLES
