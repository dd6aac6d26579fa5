"""Operator 3: document quality by regularised quadratic discriminant analysis.

Every whole text gets a vector of transformed statistics. Class means and covariances come from sums over all labelled
training rows (no sample); covariances are shrunk towards their diagonal and the pooled diagonal, factored once
(Cholesky), and a text's score is the logistic of the difference of its two log densities and the log prior odds.

Defined results: a null or empty text is scored like any other (all counts 0); documents without a label are scored and
not learned from; of several labels of a document the highest counts; without both classes in the labels every score is
the share of label 1 (0.5 without labels); an empty table gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askloom.llm import _words
from askloom.llm._shared import crc_unsigned, materialize

NAMES = (
    "words", "word_length", "upper", "digits", "closing", "marks", "symbols", "above_ascii",
    "line_length", "repeat_next", "distinct", "top_word", "distinct_lines", "short_words",
)
SHRINK, FLOOR = 0.1, 1e-3


def _among(chars: str) -> np.ndarray:
    return np.isin(np.arange(256), [ord(c) for c in chars])


_CLASSES = (
    _among("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _among("0123456789"), _among(".,;:"), _among("!?"),
    _among("#$%&*|<>{}[]^~=+_\\@/"), np.arange(256) >= 0x80,
)


#: Usual shares of these classes among the bytes of a text.
USUAL = (0.03, 0.005, 0.03, 0.001, 0.001, 0.03)


def features(texts) -> np.ndarray:
    """A pyarrow string array -> one row of statistics a text."""
    raw, offsets = _words.flat(texts)
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)

    counts = np.zeros((n, 256))
    for k in range(n):
        for at in range(offsets[k], offsets[k + 1], _words.PIECE):
            counts[k] += np.bincount(raw[at : min(at + _words.PIECE, offsets[k + 1])], minlength=256)

    def share(a: np.ndarray, b: np.ndarray, usual: float, weight: float) -> np.ndarray:
        """Log odds of a of b; `weight` counts of the usual share keep short texts from being extreme."""
        return np.log((a + weight * usual) / (b - a + weight * (1 - usual)))

    starts, ends, first = _words.spans(raw, offsets, _words.NOT_SPACE)
    words = np.diff(first).astype(np.float64)
    code = _words.hashes(_words.LOWER[raw], starts, ends)
    owner = np.repeat(np.arange(n), np.diff(first))

    def by_text(flags: np.ndarray, cuts: np.ndarray = first) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (total[cuts[1:]] - total[cuts[:-1]]).astype(np.float64)

    same_next = np.zeros(len(code), bool)
    same_next[1:] = (code[1:] == code[:-1]) & (owner[1:] == owner[:-1])
    distinct, top = np.zeros(n), np.zeros(n)
    line_kind = np.arange(256) != 10
    l_starts, l_ends, l_first = _words.spans(raw, offsets, line_kind)
    l_code = _words.hashes(raw, l_starts, l_ends)
    lines, own_lines = np.diff(l_first).astype(np.float64), np.zeros(n)
    for k in range(n):
        if first[k + 1] > first[k]:
            ordered = np.sort(code[first[k] : first[k + 1]])
            edges = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
            distinct[k], top[k] = len(edges) - 1, np.diff(edges).max()
            own_lines[k] = len(np.unique(l_code[l_first[k] : l_first[k + 1]]))
    lengths = ends - starts
    out = [np.log1p(words), np.log((by_text(lengths) + 100) / (words + 20))]
    out += [share(counts @ c, size, usual, 100) for c, usual in zip(_CLASSES, USUAL, strict=True)]
    out += [np.log((size + 200) / (lines + 1)), share(by_text(same_next), words, 0.01, 20), share(distinct, words, 0.8, 20), share(top, words, 0.05, 20), share(own_lines, lines, 0.9, 2), share(by_text(lengths <= 2), words, 0.2, 20)]
    return np.stack(out, axis=1)


def _vectors(column) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)[column.offset * len(NAMES) :][: len(column) * len(NAMES)].reshape(-1, len(NAMES)) if len(column) else np.zeros((0, len(NAMES)))


def with_features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """docs(text, keep...) -> keep..., x: the statistics of every text."""

    def run(batches):
        import pyarrow as pa

        from askloom.llm.token_store import batches_of

        for batch in batches:
            texts = batch.column(len(keep))
            for a, b in batches_of(texts):
                x = features(texts.slice(a, b - a))
                vectors = pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(NAMES), dtype=np.int32), x.ravel())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(len(keep))), vectors], names=[*keep, "x"])

    slim = docs.select(*[F.col(f"`{c}`") for c in keep], "text")
    schema = T.StructType([*slim.schema.fields[:-1], T.StructField("x", T.ArrayType(T.DoubleType()))])
    return slim.mapInArrow(run, schema)


def fit(rows: DataFrame, shrink: float = SHRINK, floor: float = FLOOR) -> dict:
    """rows(y 0/1, x) -> the model. Each task adds up its rows' products; sums of fixed size reach the driver."""
    d = len(NAMES)

    def sums(batches):
        import pyarrow as pa

        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            y, x = batch.column(0).to_numpy(zero_copy_only=False), _vectors(batch.column(1))
            for c in (0, 1):
                z = x[y == c]
                total[c] += np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).ravel()])
        place = np.arange(total.size, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total.ravel())], names=["at", "v"])

    got = np.zeros(2 * (1 + d + d * d))
    for r in rows.select("y", "x").mapInArrow(sums, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        got[r["at"]] = r["v"]
    got = got.reshape(2, -1)
    n = got[:, 0]
    if n.min() < 1:
        return {"prior": float(n[1] / n.sum()) if n.sum() else 0.5}
    mean = got[:, 1 : 1 + d] / n[:, None]
    cov = got[:, 1 + d :].reshape(2, d, d) / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    pooled = np.diag(np.maximum((cov * n[:, None, None]).sum(axis=0).diagonal() / n.sum(), floor))
    model = {"mean": mean, "odds": float(np.log(n[1] / n[0])), "factor": [], "log_det": []}
    for c in (0, 1):
        weight = max(shrink, d / (d + n[c]))
        s = (1 - weight) * cov[c] + weight * (0.5 * np.diag(cov[c].diagonal()) + 0.5 * pooled) + floor * np.eye(d)
        lower = np.linalg.cholesky(s)
        model["factor"].append(np.linalg.inv(lower))
        model["log_det"].append(2 * np.log(lower.diagonal()).sum())
    return model


def probability(x: np.ndarray, model: dict) -> np.ndarray:
    if "prior" in model:
        return np.full(len(x), model["prior"])
    dense = [-0.5 * (((x - model["mean"][c]) @ model["factor"][c].T) ** 2).sum(axis=1) - 0.5 * model["log_det"][c] for c in (0, 1)]
    return 1 / (1 + np.exp(np.clip(dense[0] - dense[1] - model["odds"], -500, 500)))


def apply(rows: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """rows(keep..., x) -> keep..., score."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            score = probability(_vectors(batch.column(len(keep))), model)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(score)], names=[*keep, "score"])

    slim = rows.select(*[F.col(f"`{c}`") for c in keep], "x")
    return slim.mapInArrow(run, T.StructType([*slim.schema.fields[:-1], T.StructField("score", T.DoubleType())]))


def held_out(doc_id, folds: int = 5):
    return F.coalesce(crc_unsigned(doc_id.cast("string")) % folds == 0, F.lit(False))


def train(vectors: DataFrame, labels: DataFrame, folds: int = 5) -> dict:
    """vectors(doc_id, x), labels(doc_id, quality): learns from the labels whose documents are not held out."""
    y = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    return fit(vectors.join(y, "doc_id").filter(~held_out(F.col("doc_id"), folds)))


def score(docs: DataFrame, labels: DataFrame, limit: float = 0.3, folds: int = 5) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, quality) -> doc_id, held_out, score, predicted."""
    vectors = materialize(with_features(docs, ["doc_id"]), "quality")
    out = apply(vectors, train(vectors, labels, folds), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, limit: float = 0.3, folds: int = 5) -> DataFrame:
    """The documents that the classifier accepts, with all their columns; texts are not shuffled."""
    vectors = materialize(with_features(docs, ["doc_id"]), "quality")
    return docs.filter(scorer(train(vectors, labels, folds))(F.col("text")) >= limit)


def scorer(model: dict):
    """A column function: texts to scores. Only texts go to Python, and only scores come back."""

    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from askloom.llm.token_store import batches_of

        for texts in batches:
            found = [probability(features(texts.slice(a, b - a)), model) for a, b in batches_of(texts)]
            yield pa.array(np.concatenate([np.zeros(0), *found]))

    return score
