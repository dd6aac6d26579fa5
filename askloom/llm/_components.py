"""Connected components of an edge table: tasks join their own edges to stars, then large-star and small-star steps join
the tasks' stars, each round written out."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.llm._shared import materialize, release

#: Edges that a task joins at once.
AT_ONCE = 1 << 20


def local_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id that it reaches by these edges), for those that reach a smaller one."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = place[: len(a)], place[len(a) :], np.arange(len(ids))
    while True:
        lower = label.copy()
        np.minimum.at(lower, a, label[b])
        np.minimum.at(lower, b, label[a])
        np.minimum.at(lower, label, lower)
        lower = lower[lower]
        if (lower == label).all():
            return ids[label < np.arange(len(ids))], ids[label[label < np.arange(len(ids))]]
        label = lower


def _joined(batches):
    import pyarrow as pa

    def flush(held):
        u, v = local_stars(*(np.concatenate(c) for c in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    held, n = [], 0
    for batch in batches:
        held.append(tuple(c.to_numpy() for c in batch.columns))
        n += len(batch)
        if n >= AT_ONCE:
            yield flush(held)
            held, n = [], 0
    if n:
        yield flush(held)


def _stars(edges: DataFrame) -> DataFrame:
    """One round. edges(u, v) with u > v -> the same kind, distinct, with every node nearer to its smallest; written."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # the smallest neighbours are written, so that Spark sees plain shuffles on both sides of the joins and splits a node of
    # many links
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    large = materialize(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v"), "large")
    lower = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "lower")
    small = large.join(lower, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = materialize(small.union(lower.select("u", F.col("m").alias("v"))).distinct().mapInArrow(_joined, "u long, v long"), "edges")
    release(least, large, lower)
    return out


def connected(pairs: DataFrame) -> DataFrame:
    """pairs(a, b) -> id, component: the smallest id that links reach. Nodes without a link to another are left out.

    Rounds of stars go on until nothing changes, or what is left are no more edges than a task joins at once.
    """
    edges = pairs.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    # all edges of a node from above meet in one task, so that a task leaves little more than its nodes
    edges, before = materialize(edges.repartition("u").mapInArrow(_joined, "u long, v long").distinct(), "edges"), None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("u", "v"), 20))).first()
        if now == before:
            break
        before, last = now, edges
        few = now[0] <= AT_ONCE
        edges = materialize(last.coalesce(1).mapInArrow(_joined, "u long, v long"), "edges") if few else _stars(last)
        release(last)
        if few:
            break
    out = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    out.askloom_path = edges.askloom_path
    return out
