"""Approximate nearest vectors: a stored neighbour graph for each shard of the vectors, searched by tasks.

Building: vectors are dealt to shards of about SHARD by a hash of their key; a task finds each one's NEAR nearest in its
shard (blocked products), keeps of them those that no kept one hides (nearer to it than the vector is), and adds the edges back.
One in STEP vectors has edges among those, too, so that walks get from one cluster to another.
Vectors, keys and edges of a shard are one Arrow file in the shared folder; a table that Spark commits lists the files, so
repeated tasks do no harm.

Search: a task takes a shard past every block of queries. A query begins with one in STEP * STEP vectors, walks over the
upper edges, and from there over all. It holds the `beam` best vectors it has met, expands the best ones that it has not, and
ends when there are none, or when it has met `most` vectors of the shard: that many are its
candidates at most. Scores are exact. A query meets vectors of its own width only. k hits a query and task are shuffled.

Exact search: the k-th score that a walk (or an earlier shard of the task) gave is a query's bar. The vectors of a shard are
parted by their nearest pivots, one in STEP vectors; a query is multiplied with those of every pivot whose angle and radius
let a vector reach the bar, so nothing is missed. What the walk met doesn't limit it.

Queries with a document are for `nearest.knn_stored`, which is exact and reads that document's buckets only.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askloom.operators import nearest
from askloom.sources import storage

#: Vectors in a shard, nearest ones that are looked at, edges kept, edges with those added back, and queries at once.
SHARD, NEAR, EDGES, MOST_EDGES, AT_ONCE = 16_384, 48, 16, 32, 256
#: Vectors for one with upper edges, width of the beam, vectors expanded at once, and vectors a query may meet in a shard.
STEP, BEAM, WIDTH, MOST = 16, 48, 4, 2_000
#: What bounds and bars of the exact check leave to rounding, and the share of parts in reach from which all are multiplied.
SLACK, DENSE = 1e-5, 0.1


# --- a shard --------------------------------------------------------------------------------------------------------


def nearest_of(unit: np.ndarray, near: int = NEAR) -> np.ndarray:
    """For each row its `near` nearest others, nearest first."""
    n = len(unit)
    near = min(near, n - 1)
    out = np.empty((n, near), np.int32)
    for a in range(0, n, nearest.VECTORS_AT_ONCE):
        score = unit[a : a + nearest.VECTORS_AT_ONCE] @ unit.T
        score[np.arange(len(score)), np.arange(a, a + len(score))] = -np.inf
        part = np.argpartition(-score, near - 1, axis=1)[:, :near] if near else np.zeros((len(score), 0), np.int64)
        out[a : a + len(score)] = np.take_along_axis(part, np.argsort(-np.take_along_axis(score, part, 1), axis=1, kind="stable"), 1)
    return out


def spread_edges(unit: np.ndarray, near: np.ndarray, edges: int = EDGES) -> np.ndarray:
    """Of the nearest those that no kept one hides, filled up to half of `edges` with the nearest; -1 where there are fewer."""
    n, width = near.shape
    out = np.full((n, edges), -1, np.int32)
    for a in range(0, n, AT_ONCE):
        who = near[a : a + AT_ONCE]
        them = unit[who]
        to_point = np.einsum("nkd,nd->nk", them, unit[a : a + AT_ONCE])
        between = np.einsum("nkd,njd->nkj", them, them)
        kept, count = np.zeros(who.shape, bool), np.zeros(len(who), np.int64)
        for k in range(width):
            take = ~(kept & (between[:, k] > to_point[:, k, None])).any(axis=1) & (count < edges)
            kept[:, k] = take
            count += take
        for k in range(width):
            take = ~kept[:, k] & (count < edges // 2)
            kept[:, k] |= take
            count += take
        order = np.argsort(~kept, axis=1, kind="stable")[:, :edges]
        out[a : a + len(who), : order.shape[1]] = np.where(np.take_along_axis(kept, order, 1), np.take_along_axis(who, order, 1), -1)
    return out


def both_ways(edges: np.ndarray, most: int = MOST_EDGES) -> np.ndarray:
    """Edges and their reverses, own ones first, at most `most` a row."""
    n, width = edges.shape
    own = edges.ravel() >= 0
    source, target = np.repeat(np.arange(n, dtype=np.int64), width)[own], edges.ravel()[own].astype(np.int64)
    pairs, first = np.unique(np.concatenate([source * n + target, target * n + source]), return_index=True)
    order = np.lexsort((first, first >= len(source), pairs // n))
    source, target = (pairs // n)[order], (pairs % n)[order]
    place = np.arange(len(source)) - np.searchsorted(source, source)
    out = np.full((n, most), -1, np.int32)
    fits = place < most
    out[source[fits], place[fits]] = target[fits]
    return out


def graph_of(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edges of each vector, upper edges of one in STEP), as places, -1 for none."""

    def among(some: np.ndarray) -> np.ndarray:
        return both_ways(spread_edges(some, nearest_of(some))) if len(some) else np.zeros((0, MOST_EDGES), np.int32)

    above = np.full((len(unit), MOST_EDGES), -1, np.int32)
    upper = among(unit[::STEP])
    above[::STEP] = np.where(upper >= 0, upper * STEP, -1)
    return among(unit), above


def walk(unit: np.ndarray, edges: np.ndarray, above: np.ndarray, queries: np.ndarray, beam: int = BEAM, most: int = MOST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the best vectors of each query, -1 for none; their scores; how many vectors it met)."""
    n, q = len(unit), len(queries)
    start = np.arange(0, n, STEP * STEP)[:most]
    seen = np.zeros((q, n), bool)
    seen[:, start] = True
    score = np.round(queries @ unit[start].T, 6)
    order = np.argsort(-score, axis=1, kind="stable")[:, :beam]
    place = np.full((q, beam), -1, np.int64)
    best = np.full((q, beam), -np.inf)
    place[:, : order.shape[1]], best[:, : order.shape[1]] = start[order], np.take_along_axis(score, order, 1)
    met = np.full(q, len(start))
    for graph in (above, edges):
        done = place < 0
        while len(open_ := np.flatnonzero((~done).any(axis=1) & (met < most))):
            waiting = np.where(done[open_], -np.inf, best[open_])
            pick = np.argsort(-waiting, axis=1, kind="stable")[:, :WIDTH]
            real = np.isfinite(np.take_along_axis(waiting, pick, 1))
            done[open_[:, None], pick] = True
            around = np.where(real[:, :, None], graph[place[open_[:, None], pick]], -1).reshape(len(open_), -1)
            row, at = np.nonzero((around >= 0) & ~seen[open_[:, None], np.maximum(around, 0)])
            pair = np.unique(row * n + around[row, at])
            row, node = pair // n, pair % n
            # a query at its limit takes the first of them only
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            fits = rank < most - met[open_][row]
            row, node, rank = row[fits], node[fits], rank[fits]
            if not len(row):
                continue
            seen[open_[row], node] = True
            count = np.bincount(row, minlength=len(open_))
            met[open_] += count
            new_place, new_score = np.full((len(open_), count.max()), -1, np.int64), np.full((len(open_), count.max()), -np.inf)
            new_place[row, rank], new_score[row, rank] = node, np.round(np.einsum("ij,ij->i", queries[open_[row]], unit[node]), 6)
            all_place, all_score = np.concatenate([place[open_], new_place], axis=1), np.concatenate([best[open_], new_score], axis=1)
            all_done = np.concatenate([done[open_], new_place < 0], axis=1)
            order = np.argsort(-all_score, axis=1, kind="stable")[:, :beam]
            place[open_], best[open_], done[open_] = (np.take_along_axis(x, order, 1) for x in (all_place, all_score, all_done))
    return place, best, met


# --- the exact check ------------------------------------------------------------------------------------------------


def parted(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the vectors, those of a pivot together; where each pivot's begin, and the end; the largest angle between
    each pivot and a vector of it)."""
    pivots = unit[::STEP]
    owner, angle = np.zeros(len(unit), np.int64), np.zeros(len(unit))
    for a in range(0, len(unit), nearest.VECTORS_AT_ONCE):
        score = unit[a : a + nearest.VECTORS_AT_ONCE] @ pivots.T
        at = score.argmax(axis=1)
        owner[a : a + len(at)], angle[a : a + len(at)] = at, np.arccos(np.clip(score[np.arange(len(at)), at], -1, 1))
    radius = np.zeros(len(pivots))
    np.maximum.at(radius, owner, angle)
    order = np.argsort(owner, kind="stable")
    return order, np.searchsorted(owner[order], np.arange(len(pivots) + 1)), radius


def reaching(unit: np.ndarray, parts: tuple[np.ndarray, np.ndarray, np.ndarray], queries: np.ndarray, bar: np.ndarray, k: int):
    """(rows of queries, places of vectors, scores) of all pairs that may belong to the k best: none at or above the bar is
    left out. `bar` rises."""
    order, starts, radius = parts
    angle = np.arccos(np.clip(queries @ unit[::STEP].T, -1, 1))
    reached = np.cos(np.maximum(angle - radius, 0)) + SLACK >= bar[:, None]
    if reached.mean() > DENSE:  # hardly a part is out of reach: all of them in long runs
        runs = [(np.arange(len(queries)), order[a : a + nearest.VECTORS_AT_ONCE]) for a in range(0, len(order), nearest.VECTORS_AT_ONCE)]
    else:
        runs = [(np.flatnonzero(reached[:, p]), order[starts[p] : starts[p + 1]]) for p in np.flatnonzero(reached.any(axis=0))]
    for who, them in runs:
        scores = np.round(queries[who] @ unit[them].T, 6)
        if scores.shape[1] >= k:
            bar[who] = np.maximum(bar[who], np.partition(scores, -k, axis=1)[:, -k])
        row, at = np.nonzero(scores >= bar[who][:, None] - SLACK)
        if len(row):
            yield who[row], them[at], scores[row, at]


# --- the index ------------------------------------------------------------------------------------------------------


def build(vectors: DataFrame, key: str = "chunk_id", shard: int = SHARD) -> DataFrame:
    """vectors(key, embedding) -> the index: one row a shard (its file, width and size), as a written table. Null and empty
    vectors, and those with null or infinite components, are left out."""
    spark = vectors.sparkSession
    folder, kept = storage.work_folder(spark, "graph"), vectors.select(key, "embedding").filter(F.size("embedding") > 0)
    shards = max(1, -(-kept.count() // shard))
    key_type = nearest.batch_types(T.StructType([vectors.schema[key]]))[0]

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs, ipc

        held: dict[int, list] = {}

        def put(width: int):
            keys, unit = [k for ks, _ in held[width] for k in ks], np.concatenate([x for _, x in held[width]])
            name = f"{folder}/{uuid.uuid4().hex}.arrow"
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]) for x in (unit, *graph_of(unit))]
            table = pa.table([pa.array(keys, key_type), *lists], names=["key", "vector", "edges", "above"])
            system, path = fs.FileSystem.from_uri(name)
            system.create_dir(path.rpartition("/")[0], recursive=True)
            with system.open_output_stream(path) as out, ipc.new_file(out, table.schema) as writer:
                writer.write_table(table)
            held[width] = []
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([width], pa.int32()), pa.array([len(keys)], pa.int64())], names=["file", "width", "size"])

        for batch in batches:
            for width in np.unique(nearest.sizes(batch.column(1))).tolist():
                x, ok = nearest.matrix(batch.column(1), width)
                keys, x = batch.column(0).filter(ok).to_pylist(), x[ok]
                for a in range(0, len(keys), shard):
                    held.setdefault(width, []).append((keys[a : a + shard], x[a : a + shard]))
                    if sum(len(k) for k, _ in held[width]) >= 2 * shard:
                        yield put(width)
        for width in list(held):
            if held[width]:
                yield put(width)

    # a shard holds less than twice its size, so that the last one isn't a rest
    dealt = kept.repartition(shards, F.xxhash64(key)).sortWithinPartitions(key) if shards > 1 else kept.coalesce(1).sortWithinPartitions(key)
    return storage.materialize(dealt.mapInArrow(run, "file string, width int, size long"), "graph_files")


def search(index: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", key_type: T.DataType | None = None, beam: int = BEAM, most: int = MOST, block: int = nearest.QUERY_BLOCK, exact: bool = False) -> DataFrame:
    """index of build(), queries(question_id, embedding) -> question_id, key, score, rank, distance: of the vectors that the
    walks met, the k best, with exact scores; with `exact` the k best of all vectors (ties go to the smaller key)."""
    spark: SparkSession = index.sparkSession
    schema = T.StructType([T.StructField("question_id", queries.schema["question_id"].dataType), T.StructField(key, key_type or T.StringType()), T.StructField("score", T.DoubleType())])
    load = nearest.query_blocks(queries.select("question_id", "embedding"), block)
    beam = max(beam, k)

    def run(batches):
        seen = nearest.Collector(k)
        for batch in batches:
            for name, width in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = None
                for number, some in load():
                    if some.rows.shape[1] != width:
                        continue
                    if shard is None:
                        shard = read_shard(name)
                        parts = parted(shard[1]) if exact else None
                    keys, *graph = shard
                    for a in range(0, len(some.ids), AT_ONCE):
                        asked = some.rows[a : a + AT_ONCE]
                        place, score, _ = walk(*graph, asked, beam, most)
                        if exact:
                            bar = seen.bar(number, len(some.ids))[a : a + AT_ONCE]
                            np.maximum(bar, score[:, k - 1], out=bar)
                            for row, at, found in reaching(graph[0], parts, asked, bar, k):
                                seen.add(number, some.ids, (row + a, found, keys[at]))
                            continue
                        row, at = np.nonzero(place >= 0)
                        seen.add(number, some.ids, (row + a, score[row, at], keys[place[row, at]]))
                    if seen.held > nearest.HELD:
                        yield from seen.drain(schema)
        yield from seen.drain(schema)

    files = index.select("file", "width").repartition(spark.sparkContext.defaultParallelism * 2, "file")
    return nearest.ranked(files.mapInArrow(run, schema), k, key)


def read_shard(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, unit vectors, edges and upper edges."""
    from pyarrow import fs, ipc

    system, path = fs.FileSystem.from_uri(name)
    with system.open_input_file(path) as source:
        table = ipc.open_file(source).read_all().combine_chunks()
    flat = lambda c: table.column(c).combine_chunks().flatten().to_numpy().reshape(len(table), -1)
    return np.array(table.column("key").to_pylist()), flat("vector"), flat("edges"), flat("above")
