import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from askloom.operators import index, vectorize


def by_hand(text, dimension=384):
    out = [0.0] * dimension
    for feature, n in vectorize.features(text).items():
        v = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "big")
        out[v % dimension] += (1 if v >= 2**63 else -1) * (1 + math.log(n))
    norm = math.sqrt(sum(x * x for x in out))
    return [x / norm for x in out] if norm else [1.0] + [0.0] * (dimension - 1)


def test_features():
    assert vectorize.features("Ab abc") == {"w:ab": 1, "w:abc": 1, "b:ab_abc": 1, "c:ab": 1, "c:^ab": 1, "c:abc": 1, "c:bc$": 1}


def test_hashing_model(spark):
    texts = ["the red fox, the red dog", "", None, "a"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["embedding"] for r in vectorize.embed(rows).collect()}
    for k, t in enumerate(texts):
        assert np.allclose(got[k], by_hand(t or ""), atol=1e-6)


def test_md5_variant_has_unit_vectors(spark):
    rows = spark.createDataFrame([(1, "red fox red"), (2, "..."), (3, "")], "doc_id int, text string")
    got = vectorize.hashed_md5(rows).groupBy("doc_id").agg(F.sum(F.col("value") ** 2).alias("n"), F.count("*").alias("k")).collect()
    assert {r["doc_id"]: round(r["n"], 9) for r in got} == {1: 1.0, 2: 1.0, 3: 1.0}
    tf = {r["feature"]: r["n"] for r in vectorize.term_frequencies(rows.filter("doc_id = 1")).collect()}
    assert tf == dict(vectorize.features("red fox red"))


def test_md5_variant_shuffles_no_features(spark):
    """Rows of one key are counted in their task; repeated and null keys are joined, with the same results."""
    texts = ["red fox red", "...", "", "the fox_12 é K\u212a abc", "a a a bb", "fox red", "red", None]
    rows = spark.createDataFrame([(k if k != 5 else 0, t) for k, t in enumerate(texts)] + [(None, "red fox"), (None, "a bb")], "doc_id int, text string").repartition(3)
    rows = rows.filter("text IS NOT NULL")
    values = lambda df: sorted((-1 if r["doc_id"] is None else r["doc_id"], r["bucket"], round(r["value"], 9)) for r in df.collect())
    assert values(vectorize.hashed_md5(rows)) == values(vectorize.joined_md5(rows))
    plan = vectorize.sparse_vectors(rows, vectorize.Md5Model)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "hashpartitioning" not in plan
    model = vectorize.Md5Model()
    model.remember = 3  # forgotten words are hashed again
    assert np.allclose([model([t or ""])[0] for t in texts * 2], vectorize.Md5Model()([t or "" for t in texts * 2]), atol=1e-12)


def test_models_agree_with_hand_made_features():
    """Lists of many texts at once: odd letters, short and very long words, empty texts; md5 in arrays is hashlib's."""
    texts = ["", "a", "ab ab", "\u0130STANBUL \u212a x", "é à 12", "A_b\na b", "x" * 300 + " y" * 3, "word" * 14 + " a", "...", "it's a red, red fox"] * 30
    assert np.allclose(vectorize.HashingModel()(texts), [by_hand(t) for t in texts], atol=1e-12)
    features = [b"f" * k for k in range(130)] + [bytes([k]) for k in range(256)]
    model = vectorize.Md5Model()
    assert model.values(features).tolist() == [int.from_bytes(hashlib.md5(f).digest()[:8], "big") for f in features]
    assert len(model.values([])) == 0 and model([]).shape == (0, 384)


def test_models_get_their_own_number_of_texts(spark):
    """The hashing model says how many texts it takes at once; a model of one's own gets 32, or what is asked for."""

    class Count:
        def __call__(self, texts):
            return [[float(len(texts))]] * len(texts)

    class Own(Count):
        batch = 256

    rows = spark.range(40).coalesce(1).select(F.col("id").cast("string").alias("text"))
    most = lambda *more: max(r["embedding"][0] for r in vectorize.embed(rows, "text", *more).collect())
    assert (most(Count), most(Count, 7), most(Own)) == (32, 7, 40)


VECTORS = [("a1", "doc_a", [0.11, 0.23, 0.37] * 4), ("b1", "doc_b", [0.31, 0.17, 0.41] * 4), ("z", "doc_z", [0.0] * 12), ("n", None, None), ("w", "doc_w", [1.0] * 5)]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(VECTORS, "chunk_id string, doc_id string, embedding array<float>").repartition(3)


def ask(spark, *rows):
    return spark.createDataFrame(rows, "question_id int, document_id string, embedding array<float>")


def test_self_query(spark, vectors):
    hits = index.knn(vectors, ask(spark, (1, None, VECTORS[0][2])), 2, document="doc_id").orderBy("rank").collect()
    assert hits[0]["chunk_id"] == "a1" and hits[0]["score"] == pytest.approx(1.0, abs=1e-3) and hits[1]["chunk_id"] == "b1"


def test_document_filter(spark, vectors):
    q = VECTORS[1][2]
    hits = index.knn(vectors, ask(spark, (1, "doc_a", q), (2, "none", q), (3, None, None)), 5, document="doc_id").collect()
    assert [(r["question_id"], r["chunk_id"]) for r in hits] == [(1, "a1")]


def test_other_widths_match_nothing(spark, vectors):
    assert index.knn(vectors.filter("chunk_id = 'w'"), ask(spark, (1, None, VECTORS[0][2])), 5, document="doc_id").count() == 0


def test_a_longer_vector_hides_nothing(spark):
    rows = [(k, [1.0, k / 10, -0.5]) for k in range(6)] + [(90, [1.0] * 5), (91, [1.0, 2.0]), (92, None)]
    rows = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    asked = ask(spark, (1, None, [1.0, 0.2, -0.5]), (2, None, [1.0] * 5), (3, None, [1.0, 2.0])).coalesce(1)
    for search in (index.knn, index.knn_lsh):
        got = sorted((r["question_id"], r["rank"], r["vec_id"]) for r in search(rows, asked, 1, "vec_id").collect())
        assert got == [(1, 1, 2), (2, 1, 90), (3, 1, 91)]
    exact = {r["vec_id"] for r in index.knn(rows, asked.filter("question_id = 1"), 9, "vec_id").collect()}
    assert exact == set(range(6))


def test_knn_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((700, 8)).round(1)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)
    asked = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").cast("int").alias("question_id"), F.lit(None).cast("string").alias("document_id"), "embedding")
    got = {(r["question_id"], r["rank"]): r["vec_id"] for r in index.knn(rows, asked, 5, "vec_id", block=4).collect()}
    x = x.astype(np.float32).astype(float)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for q in range(0, 700, 50):
        score = np.round(u @ u[q], 6)
        for r, j in enumerate(np.lexsort((np.arange(700), -score))[:5], 1):
            assert got[q, r] == j


def test_lsh_recall(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 16))
    x = np.concatenate([base + 0.05 * rng.standard_normal(base.shape) for _ in range(8)])
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    asked = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("question_id"), "embedding")
    exact = {(r["question_id"], r["vec_id"]) for r in index.knn(rows, asked, 5, "vec_id").collect()}
    near = {(r["question_id"], r["vec_id"]) for r in index.knn_lsh(rows, asked, 5, "vec_id").collect()}
    assert len(exact & near) / len(exact) >= 0.9


def test_lsh_joins_no_pairs(spark):
    """Candidates share a band; they are compared in the task, in blocks, and the plan has no join."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.standard_normal((400, 12)), np.repeat(rng.standard_normal((1, 12)), 200, axis=0), np.zeros((2, 12))])
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(9000, None), (9001, [])], "vec_id long, embedding array<double>").repartition(3)
    asked = rows.filter("vec_id % 7 = 0").select(F.col("vec_id").alias("question_id"), "embedding")
    u = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    sign = (u @ np.random.default_rng(11).standard_normal((5 * 4, 12)).astype(np.float32).T > 0).reshape(-1, 5, 4)
    want = []
    for q in range(0, len(x), 7):
        near = np.flatnonzero((sign == sign[q]).all(axis=2).any(axis=1))
        score = np.round(u[near] @ u[q], 6)
        want += [(q, int(near[j]), r) for r, j in enumerate(np.lexsort((near, -score))[:5], 1)]
    for block in (30, 4096):
        found = index.knn_lsh(rows, asked, 5, "vec_id", bands=5, bits=4, block=block)
        assert sorted((r["question_id"], r["vec_id"], r["rank"]) for r in found.collect()) == sorted(want)
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_upsert_and_ignore(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "chunk_id int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "y")], "chunk_id int, v string")
    values = lambda df: sorted((r["chunk_id"], r["v"]) for r in df.collect())
    assert values(index.append(old, new)) == [(1, "a"), (2, "x"), (3, "y")]
    assert values(index.append(old, new, mode="ignore")) == [(1, "a"), (2, "b"), (3, "y")]
    assert values(index.merge_latest(new, old, "chunk_id")) == [(1, "a"), (2, "x"), (3, "y")]
    with pytest.raises(ValueError):
        index.append(old, new, mode="other")


def test_status_and_preview(spark, vectors):
    row = index.status(vectors.filter("chunk_id in ('a1', 'b1')")).first()
    assert (row["status"], row["rows"], row["dimension"]) == ("ready", 2, 12)
    assert index.status(vectors.limit(0)).first()["status"] == "empty"
    rows = spark.createDataFrame([("d", k) for k in range(40)], "doc_id string, chunk_index int")
    assert index.preview(rows, 99).count() == 25 and index.preview(rows, 0).count() == 1
    kept = rows.select(index.sanitize_metadata(F.create_map(F.lit("a"), F.lit(None).cast("string"), F.lit("b"), F.lit("x"))).alias("m")).first()["m"]
    assert kept == {"b": "x"}
