"""Operator 5: k-d tree sharding, as DataFrame operations only.

A node holds a run of shards. It is split along the metadata dimension in which its texts are widest, at the weighted
quantile that gives each side its part of the bytes, until every node is one shard. A quantile comes from two sums: of the
steps of all dimensions, and of the ties in the step where the cut falls; at most (4 * STEPS + TIES) sums a node reach the
driver, however many documents there are.

Equal texts are one point of the tree, with the bytes of all of them and the place of their smallest document, so that they
share a shard. Texts whose copies take more than a LARGE-th of a shard would make shards uneven: they (at most LARGE * shards)
are first dealt to the emptiest shards, the largest first, and the tree fills what they leave. A text whose copies alone
exceed a shard is the only one that is parted, by a hash of doc_id.

Every row follows the cuts by its own place. Copies that the cuts would part are listed, and a join (Spark checks the size
of the list) puts them where their smallest document is. Dimensions: bytes (logarithm), doc_id, source and language (hashed),
each on a scale of STEPS over the whole table; ties in a step are broken by the text's checksum.

Defined results: a null text has no bytes and equals an empty one; nulls in a dimension are its lowest step; equal rows share
a shard, and have different slots; very long texts count by their size only; `shard_documents` replaces a column `shard`,
other columns stay as they are, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askloom.llm._shared import crc_unsigned, hash60, materialize, rows, spread

STEPS, TIES, LARGE = 1 << 10, 1 << 13, 32
OVERHEAD = 8
TEXT = ["text_hash", "text_crc32", "size"]
#: A cut: the node's first shard, dimension, step * TIES + tie from which rows go right, number of shards on the left.
Cut = tuple[int, int, int, int]


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def points(docs: DataFrame) -> DataFrame:
    """Adds size, text_crc32, text_hash, order_key and raw coordinates to rows with doc_id, text, source and lang."""

    def hashed(name: str) -> Column:
        return F.when(F.col(name).isNull(), 0).otherwise(F.shiftright(hash60(name, "dim"), 50)).cast("long")

    return docs.withColumns(
        {
            "size": size_of(F.col("text")), "text_crc32": crc_unsigned(F.col("text")), "text_hash": F.xxhash64(F.coalesce("text", F.lit(""))),
            "order_key": hash60("doc_id", "shard"), "at_id": F.col("doc_id").cast("double"), "at_source": hashed("source"), "at_lang": hashed("lang"),
        }
    )


def keys(bounds: dict) -> Column:
    """The keys of a row along each dimension (step * TIES + tie), from bounds of the whole table."""

    def step(value: Column, low, high) -> Column:
        if low is None or high <= low:
            return F.lit(0).cast("long")
        return F.coalesce(F.least(F.lit(STEPS - 1), F.floor((value - F.lit(float(low))) * (STEPS / float(high - low)))), F.lit(0)).cast("long")

    at = [step(F.ln(F.col("size")), bounds["log_low"], bounds["log_high"]), step(F.col("at_id"), bounds["id_low"], bounds["id_high"]), F.col("at_source"), F.col("at_lang")]
    tie = F.shiftright("text_crc32", 19).cast("long")
    return F.array(*[(a * TIES + tie).cast("long") for a in at])


def placed(pts: DataFrame, levels: list[list[Cut]], bounds: dict, shards: int) -> DataFrame:
    """Follows the cuts for every row: adds keys and node, the first shard of its run. No shuffle."""
    out = pts.withColumn("keys", keys(bounds)).withColumn("node", F.lit(0))
    for level in levels:
        by_node = {first: cut for first, *cut in level}
        dim, cut, left = (F.array(*[F.lit(by_node.get(k, (0, None, 0))[i]).cast("long") for k in range(shards)]) for i in range(3))
        here = lambda values: F.get(values, F.col("node"))
        right = F.get(F.col("keys"), here(dim).cast("int")) >= here(cut)
        out = out.withColumn("node", (F.col("node") + F.when(right, here(left)).otherwise(0)).cast("int"))
    return out


def crossing(sums: list[tuple[int, int]], goal: float) -> tuple[int, int, int]:
    """(key, bytes before it, its bytes) where the sums over ordered (key, bytes) reach the goal."""
    before = 0
    for key, n in sums[:-1]:
        if before + n >= goal:
            return key, before, n
        before += n
    return sums[-1][0], before, sums[-1][1]


def tree(groups: DataFrame, room: list[float], bounds: dict) -> list[list[Cut]]:
    """Cuts of each level, for groups(bytes, size, text_crc32, coordinates) and the bytes that each shard has room for."""
    shards = len(room)
    nodes, levels = [(0, shards)], []
    while any(n > 1 for _, n in nodes):
        at = placed(groups, levels, bounds, shards)
        steps = F.transform("keys", lambda k: F.floor(k / TIES).cast("int"))
        sums = at.select("node", "bytes", F.posexplode(steps).alias("dim", "step")).groupBy("node", "dim", "step").agg(F.sum("bytes").alias("bytes")).collect()
        ordered = sorted((r["node"], r["dim"], r["step"], r["bytes"]) for r in sums)
        found = {key: [x[2:] for x in part] for key, part in groupby(ordered, key=lambda x: x[:2])}
        aims = {}
        for first, n in nodes:
            if n > 1 and (first, 0) in found:
                dim = max(range(4), key=lambda d: (found[first, d][-1][0] - found[first, d][0][0], -d))
                here, left = sum(room[first : first + n]), sum(room[first : first + n // 2])
                goal = sum(b for _, b in found[first, dim]) * (left / here if here else (n // 2) / n)
                step, before, _ = crossing(found[first, dim], goal)
                aims[first] = (dim, step, goal - before)
        dim, step = (F.array(*[F.lit(aims.get(k, (0, -1))[i]).cast("long") for k in range(shards)]) for i in (0, 1))
        key = F.get(F.col("keys"), F.get(dim, F.col("node")).cast("int"))
        tie = F.when(F.floor(key / TIES) == F.get(step, F.col("node")), (key % TIES).cast("int"))
        ties = at.groupBy("node", tie.alias("tie")).agg(F.sum("bytes").alias("bytes")).collect()
        inner = {node: [x[1:] for x in part] for node, part in groupby(sorted((r["node"], r["tie"], r["bytes"]) for r in ties if r["tie"] is not None), key=lambda x: x[0])}
        level, below = [], []
        for first, n in nodes:
            if first not in aims:
                below.append((first, 1))
                continue
            dim_at, step_at, goal = aims[first]
            tie_at, before, size = crossing(inner[first], goal)
            level.append((first, dim_at, step_at * TIES + tie_at + (before + size - goal < goal - before), n // 2))
            below += [(first, n // 2), (first + n // 2, n - n // 2)]
        nodes = below
        levels.append(level)
    return levels


def dealt(pieces: list[tuple[int, tuple]], shards: int, rest: int) -> tuple[dict, list[float]]:
    """(bytes, name) of the pieces of large groups -> their shards, the largest first to the emptiest; and the room that
    remains in each shard for `rest` bytes, so that all come out even."""
    loads = [(0, k) for k in range(shards)]
    where = {}
    for size, name in sorted(pieces, key=lambda p: (-p[0], p[1])):
        load, k = heapq.heappop(loads)
        where[name] = k
        heapq.heappush(loads, (load + size, k))
    by_load, level, filled = sorted(loads), 0.0, 0
    for n, (load, _) in enumerate(by_load, 1):  # the level to which `rest` fills the n emptiest shards
        filled += load
        level = (rest + filled) / n
        if n == shards or level <= by_load[n][0]:
            break
    return where, [max(0.0, level - load) for load, _ in sorted(loads, key=lambda x: x[1])]


def sharded(rows_: DataFrame, pts: DataFrame, shards: int) -> DataFrame:
    """rows_ with the columns of points() -> the same rows with `node`, their shard; pts: the points of all rows, written."""
    spark = pts.sparkSession
    first = F.min(F.struct("doc_id", "at_id", "at_source", "at_lang"))
    groups = materialize(pts.groupBy(*TEXT).agg(F.sum("size").alias("bytes"), first.alias("first")).select(*TEXT, "bytes", "first.at_id", "first.at_source", "first.at_lang"), "shard-groups")
    bounds = groups.agg(F.sum("bytes").alias("total"), F.ln(F.min("size")).alias("log_low"), F.ln(F.max("size")).alias("log_high"), F.min("at_id").alias("id_low"), F.max("at_id").alias("id_high")).first().asDict()
    total = bounds["total"] or 0
    target = max(1.0, total / shards)
    large = {tuple(r[:3]): r["bytes"] for r in groups.filter(F.col("bytes") > target / LARGE).select(*TEXT, "bytes").collect()}
    parts = {t: -(-2 * int(b) // int(target)) if b > target else 1 for t, b in large.items()}
    table = [(*t, parts[t]) for t in large]
    names = "text_hash long, text_crc32 long, size long, parts long"
    piece = spread(F.col("order_key"), F.col("parts"))
    pieces = [(b, (t, 0)) for t, b in large.items() if parts[t] == 1]
    if several := [x for x in table if x[3] > 1]:
        found = pts.join(F.broadcast(rows(spark, several, names)), TEXT).groupBy(*TEXT, piece.alias("piece")).agg(F.sum("size").alias("bytes"))
        pieces += [(r["bytes"], (tuple(r[:3]), r["piece"])) for r in found.collect()]
    where, room = dealt(pieces, shards, total - sum(large.values()))
    small = groups.filter(F.col("bytes") <= target / LARGE)
    levels = tree(small, room, bounds)
    own = placed(pts, levels, bounds, shards)
    torn = own.groupBy(*TEXT).agg(F.min("node").alias("low"), F.max("node").alias("high"), F.min(F.struct("doc_id", "at_id", "at_source", "at_lang", "node")).alias("first"))
    torn = materialize(torn.filter("low <> high").select(*TEXT, F.col("first.node").alias("together")), "shard-copies")
    fixed = [(*t, parts[t], F.array(*[F.lit(where.get((t, k), 0)) for k in range(parts[t])])) for t in large]
    out = placed(rows_, levels, bounds, shards).join(torn, TEXT, "left")
    if fixed:
        by_name = spark.range(0, 1, 1, 1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("text_hash"), F.lit(b).cast("long").alias("text_crc32"), F.lit(c).cast("long").alias("size"), F.lit(n).cast("long").alias("parts"), at.alias("where")) for a, b, c, n, at in fixed])))
        out = out.join(F.broadcast(by_name), TEXT, "left").withColumn("together", F.coalesce(F.get("where", piece.cast("int")), "together"))
    return out.withColumn("node", F.coalesce("together", "node").cast("int"))


def slots(sharded: DataFrame) -> DataFrame:
    """Gapless numbers from 0 in each shard: counts of key ranges first, then the order within a range."""
    per = sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).select("shard", F.ceil(F.sqrt("n")).cast("long").alias("ranges"))
    ranged = sharded.join(per, "shard").withColumn("range", spread(F.col("order_key"), F.col("ranges")))
    counts = ranged.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(w), F.lit(0))).drop("n")
    inner = Window.partitionBy("shard", "range").orderBy("order_key", F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    return ranged.join(starts, ["shard", "range"]).withColumn("slot", (F.col("start") + F.row_number().over(inner) - 1).cast("long")).drop("range", "ranges", "start")


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """docs with doc_id, text, source, lang -> the same rows and columns with `shard`."""
    names = [c for c in docs.columns if c != "shard"]
    slim = docs.select("doc_id", "text", "source", "lang")
    pts = materialize(points(slim).drop("text", "source", "lang"), "shard-points")
    body = points(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "doc_id", "text", "source", "lang")).drop("text", "source", "lang")
    return sharded(body, pts, shards).select("row.*", F.col("node").alias("shard"))


def assign(docs: DataFrame, shards: int = 24) -> DataFrame:
    """docs(doc_id, text, source, lang) -> doc_id, size, text_crc32, shard, slot."""
    pts = materialize(points(docs.select("doc_id", "text", "source", "lang")).drop("text", "source", "lang"), "shard-points")
    at = materialize(sharded(pts, pts, shards).select("doc_id", "size", "text_crc32", "order_key", F.col("node").alias("shard")), "sharded")
    return slots(at).select("doc_id", "size", "text_crc32", "shard", "slot")
