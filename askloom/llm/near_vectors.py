"""Operator 4: near-duplicate vectors by product quantisation.

Equal vectors are one point with a count. A coarse quantiser deals the points of a label into inverted lists of about
LIST_SIZE, so that a label has as many as its size needs (a power of FOUR, MAX_LISTS at most); a point is also sent to every
list whose border is within `reach` of it, which finds a pair unless its difference points along that border's normal more
than `reach` (reach = 1, the default, finds every pair; 0.6 of the radius is about five standard deviations for differences
without a direction in 64 dimensions, and sends fewer copies). In a list, codes of the residuals in eight subspaces give table-lookup distances; as
the error of each code is stored, no pair within the radius is lost there. Exact cosines in double precision decide.

The quantisers, one for each number of lists, are fitted on one bounded sample (SAMPLE rows and SAMPLE_BYTES at most, the
smallest hashes); every row is indexed. Lists are cut into blocks of BLOCK points; queries stream past a block, so a task
holds one block whatever the group.

Defined results: rows with a null label, or a null, empty, zero or non-finite vector, link with nothing; vectors of
different lengths link with nothing; repeated rows count as vectors; other columns are left out; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.llm._components import connected
from askloom.llm._shared import materialize

SAMPLE, SAMPLE_BYTES, LIST_SIZE, FOUR, MAX_LISTS, BLOCK, SUBSPACES, CODES, QUERIES_AT_ONCE, PAIRS_AT_ONCE = 200_000, 128 << 20, 1024, 4, 4096, 4096, 8, 64, 512, 1 << 16
#: Groups (labels and widths) of which the sizes are broadcast; more are joined.
FEW_GROUPS = 65_536


def _kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds if len(x) > k else 0):
        near = np.concatenate([((centers**2).sum(1) - 2 * x[a : a + 8192] @ centers.T).argmin(1) for a in range(0, len(x), 8192)])
        order = np.argsort(near, kind="stable")
        used, head = np.unique(near[order], return_index=True)
        centers[used] = np.add.reduceat(x[order], head, axis=0) / np.diff(np.append(head, len(x)))[:, None]
    return centers


def _centers(x: np.ndarray, k: int) -> np.ndarray:
    """k centres; many of them in two steps, first CODES, then some in the cell of each by its size."""
    if k <= CODES:
        return _kmeans(x, k)
    top = _kmeans(x, CODES)
    home = np.concatenate([((top**2).sum(1) - 2 * x[a : a + 8192] @ top.T).argmin(1) for a in range(0, len(x), 8192)])
    return np.concatenate([_kmeans(part, max(1, round(k * len(part) / len(x)))) for c in range(len(top)) if len(part := x[home == c])])


def fit(sample: np.ndarray, lists: int) -> dict:
    """Coarse centres and a code book of residuals for each subspace, from unit vectors."""
    centers = _centers(sample, min(lists, len(sample)))
    home = np.concatenate([((centers**2).sum(1) - 2 * sample[a : a + 8192] @ centers.T).argmin(1) for a in range(0, len(sample), 8192)])
    residual = sample - centers[home]
    parts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
    return {"centers": centers, "parts": parts, "books": [_kmeans(residual[:, p], min(CODES, len(sample)), seed=7 + i) for i, p in enumerate(parts)]}


def unit(column, width: int) -> np.ndarray:
    """An Arrow list column as unit vectors in double precision, padded with zeros to `width`."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    scale = np.abs(out).max(axis=1, keepdims=True, initial=0)
    out /= np.where(scale > 0, scale, 1)
    return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-300)


def encode(x: np.ndarray, home: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the residuals, and each point's distance to its decoded form."""
    residual = x - model["centers"][home]
    codes, error = np.zeros((len(x), len(model["parts"])), np.uint8), np.zeros(len(x))
    for m, (part, book) in enumerate(zip(model["parts"], model["books"], strict=True)):
        sub = residual[:, part]
        codes[:, m] = ((book**2).sum(1) - 2 * sub @ book.T).argmin(1)
        error += ((sub - book[codes[:, m]]) ** 2).sum(1)
    return codes, np.sqrt(error)


def table_distances(q: np.ndarray, center: np.ndarray, codes: np.ndarray, model: dict) -> np.ndarray:
    """Distances of queries to coded points of one list, by lookups in the queries' tables."""
    out = np.zeros((len(q), len(codes)))
    residual = q - center
    for m, (part, book) in enumerate(zip(model["parts"], model["books"], strict=True)):
        sub = residual[:, part]
        table = (sub**2).sum(1)[:, None] - 2 * sub @ book.T + (book**2).sum(1)
        out += table[:, codes[:, m]]
    return np.sqrt(np.maximum(out, 0))


class _Block:
    """The home points of a block, and what the queries that passed have found."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, x: np.ndarray, center: np.ndarray, model: dict, least: float) -> None:
        self.ids, self.n, self.x, self.center, self.model, self.least = ids, n, x, center, model, least
        residual_home = np.zeros(len(ids), np.int64)
        self.codes, self.error = encode(x, residual_home, {**model, "centers": center[None]})
        self.radius = np.sqrt(2 - 2 * least)
        self.links, self.label, self.parent, self.outside = n - 1, np.arange(len(ids)), np.arange(len(ids)), []

    def _find(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = self.parent[k]
        return int(k)

    def pass_by(self, ids: np.ndarray, n: np.ndarray, x: np.ndarray) -> None:
        near = table_distances(x, self.center, self.codes, self.model) <= self.radius + self.error + 1e-9
        linked = near
        a, b = np.nonzero(near)
        for k in range(0, len(a), PAIRS_AT_ONCE):
            s = slice(k, k + PAIRS_AT_ONCE)
            linked[a[s], b[s]] = np.einsum("ij,ij->i", x[a[s]], self.x[b[s]]) >= self.least
        linked &= ids[:, None] != self.ids
        self.links = self.links + n @ linked
        hit = linked.any(axis=1)
        if not hit.any():
            return
        linked, ids = linked[hit], ids[hit]
        first = np.where(linked, self.label, len(self.ids)).min(axis=1)
        # every label that a query meets joins the smallest one that it meets
        for row, low in zip(linked, first, strict=True):
            met = np.unique(self.label[row])
            for k in met[met != low]:
                a, b = self._find(int(k)), self._find(int(low))
                self.parent[max(a, b)] = min(a, b)
        self.label = np.array([self._find(k) for k in range(len(self.parent))])
        self.outside.append((ids, first))

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        roots = np.array([self._find(k) for k in range(len(self.parent))], np.int64)
        a, b = [self.ids], [self.ids[roots]]
        for ids, first in self.outside:
            a.append(ids)
            b.append(self.ids[roots[first]])
        a, b = np.concatenate(a), np.concatenate(b)
        return a[a != b], b[a != b]


FOUND = "a long, b long, n_links long"


def _points(vectors: DataFrame) -> DataFrame:
    """vectors(vec_id, embedding, label) that can link, with a key that equal vectors share."""
    x = F.col("embedding")
    fine = x.isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) & F.exists(x, lambda v: v != 0)
    zeroed = F.transform(x, lambda v: F.when(v == 0, F.lit(0).cast(vectors.schema["embedding"].dataType.elementType)).otherwise(v))
    return vectors.filter(fine).select("vec_id", "label", zeroed.alias("embedding")).withColumn("group", F.xxhash64("label", F.size("embedding"))).withColumn("key", F.struct("group", F.xxhash64("embedding").alias("h1"), F.hash("embedding").alias("h2")))


def near_duplicates(vectors: DataFrame, least: float = 0.98, reach: float = 1.0) -> DataFrame:
    """vectors(vec_id, embedding, label) -> vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    rows = materialize(_points(vectors), "vectors")
    points = materialize(rows.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.any_value("embedding").alias("embedding")).select("rep", "n", "key.group", "embedding"), "points")
    most = F.least(F.lit(float(MAX_LISTS)), F.ceil(F.col("n") / LIST_SIZE).cast("double"))
    sizes = materialize(points.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("width")).select("group", "width", F.ceil(F.log(most) / float(np.log(FOUR)) - 1e-9).cast("int").alias("level")), "vector-groups")
    stats = sizes.agg(F.count(F.lit(1)).alias("groups"), F.max("width").alias("width"), F.collect_set("level").alias("levels")).first()
    if not stats["groups"]:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    width, lists = stats["width"], FOUR ** max(stats["levels"])
    rows_at_most = min(SAMPLE, 40 * lists + 4096, max(1024, SAMPLE_BYTES // (8 * width)))
    sample = points.orderBy(F.xxhash64("rep", F.lit(3))).limit(rows_at_most).select("embedding").toArrow().column(0).combine_chunks()
    sample = unit(sample, width)
    shared = spark.sparkContext.broadcast({level: fit(sample, FOUR**level) for level in stats["levels"]})  # size bounded by MAX_LISTS
    levels = sizes.select("group", "level")
    points = points.join(F.broadcast(levels) if stats["groups"] <= FEW_GROUPS else levels, "group").select("rep", "n", "group", "embedding", "level")
    margin = reach * float(np.sqrt(2 - 2 * least))

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            level_of = batch.column(4).to_numpy()
            for level, at in ((v, k) for v in np.unique(level_of) for k in range(0, len(batch), 1024)):
                part = batch.slice(at, 1024)
                part = part.filter(pa.array(level_of[at : at + 1024] == level))
                if not len(part):
                    continue
                centers = shared.value[int(level)]["centers"]
                x = unit(part.column(3), width)
                d = (centers**2).sum(1) - 2 * x @ centers.T
                home = d.argmin(1)
                gap = np.sqrt(np.maximum((centers**2).sum(1) + (centers[home] ** 2).sum(1)[:, None] - 2 * centers[home] @ centers.T, 1e-18))
                row, to = np.nonzero((d - d[np.arange(len(d)), home][:, None]) / (2 * gap) <= margin)
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(to.astype(np.int32)), pa.array(to == home[row])], names=["rep", "n", "group", "embedding", "level", "list", "home"])

    kind = rows.schema["embedding"].dataType.simpleString()
    dealt = points.mapInArrow(deal, f"rep long, n long, group long, embedding {kind}, level int, list int, home boolean")
    # blocks of a list: home points go to one, queries to all of them
    blocks = dealt.filter("home").groupBy("group", "list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    counted = dealt.join(materialize(blocks, "lists"), ["group", "list"])
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    as_query = counted.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("query", F.lit(True))
    as_home = counted.filter("home").withColumn("block", own).withColumn("query", F.lit(False))
    columns = ["group", "list", "block", "query", "rep", "n", "embedding", "level"]
    ordered = as_home.select(columns).union(as_query.select(columns)).repartition("group", "list", "block").sortWithinPartitions("group", "list", "block", "query")

    def search(batches):
        import pyarrow as pa

        at, block, homes, level = None, None, [], 0

        def build():
            ids, n, x = (np.concatenate(c) for c in zip(*homes, strict=True))
            model = shared.value[level]
            return _Block(ids, n, x, model["centers"][at[1]], model, least)

        def result():
            a, b = block.edges()
            nothing = np.zeros(len(a), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([block.ids, a])), pa.array(np.concatenate([block.ids, b])), pa.array(np.concatenate([block.links, nothing]).astype(np.int64))], names=["a", "b", "n_links"])

        for batch in batches:
            if not len(batch):
                continue
            keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            for a, b in zip([0, *change], [*change, len(batch)], strict=True):
                here, query = tuple(int(k[a]) for k in keys[:3]), bool(keys[3][a])
                if here != at:
                    if block is not None:
                        yield result()
                    at, block, homes = here, None, []
                part = batch.slice(a, b - a)
                ids, n = part.column(4).to_numpy(), part.column(5).to_numpy()
                x = unit(part.column(6), width)
                if not query:
                    level = int(part.column(7)[0].as_py())
                    homes.append((ids, n, x))
                    continue
                if not homes:
                    continue
                block = block or build()
                for k in range(0, len(ids), QUERIES_AT_ONCE):
                    s = slice(k, k + QUERIES_AT_ONCE)
                    block.pass_by(ids[s], n[s], x[s])
        if block is not None:
            yield result()

    found = materialize(ordered.mapInArrow(search, FOUND), "vector-links")
    counts = found.filter("a = b").groupBy("a").agg(F.sum("n_links").alias("n_links"))
    roots = connected(found.filter("a <> b").select("a", "b")).withColumnRenamed("id", "a")
    per_point = counts.join(roots, "a", "left").select(F.col("a").alias("rep"), "n_links", F.coalesce("component", "a").alias("component"))
    reps = points.select("rep", "n").join(per_point, "rep").select("rep", "n_links", "component")
    members = rows.select("vec_id", "key").join(rows.groupBy("key").agg(F.min("vec_id").alias("rep")), "key").select("vec_id", "rep").join(reps, "rep").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component").alias("component"))
    out = vectors.select("vec_id").join(members, "vec_id", "left").withColumn("component_id", F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
