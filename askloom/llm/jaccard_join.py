"""Operator 2: exact n-gram Jaccard join and its connected groups.

Shingle sets live in metric spaces: the size of the symmetric difference, and the Jaccard distance. Whole documents as
pivots cannot part a corpus (unlike texts all have distance 1, so every window would reach every region); therefore the
first regions have sets of shingles as pivots, and whole documents are the pivots inside them.

1. Cells. The shingles of a text fall into K hash classes, and the content of a class is a pivot: texts that agree on the
   class lie in its cell. Texts within the limit differ in at most D shingles, so (triangle inequality, class by class)
   in at most D classes: a text sent to the cells of its first D + 1 classes, in one order for all texts (fullest first,
   then by hash), meets every text that it links with. K follows the size; a text near a step of K is sent for both.
2. Regions. Texts that share a cell, and whose sizes have no gap that a link can't span, directly or in steps, form a
   region; others cannot link. Equal sets are one member.
3. Voronoi recursion. Inside a region, pivots are drawn from its members by hash. A member goes to its nearest pivot, or to
   the outer region if all are farther than 1 - r (r: the largest Jaccard distance of a link). By the triangle inequality
   it also visits every pivot that is not farther than the nearest by more than 2 r, if it shares a shingle with it, and the
   outer region if no pivot is nearer than 1 - 2 r. Regions of more than BLOCK members are split so by Spark; every task
   splits its own regions on, until they have LEAF members or stop shrinking. Regions of more than LARGE members are first
   taken apart by cells and sketches of their sets (parities of classes), which lose no link. A region that Spark cannot shrink is cut into
   blocks that all its members pass.
4. Join. In what is left, counts of common shingles over posting lists give every exact similarity; links join members, and
   only one row a member leaves the task.

Hot cells: those of many texts, found in a sample, are joined by an aggregate and a broadcast of their leaders (at most
2 * SAMPLED / HOT of them); what the sample misses takes the common path. Neither path leaves a row out.

Shingles are 64-bit hashes of word runs. Defined results: a text with fewer words than a shingle is one shingle; a text
without words (or null) has an empty set and links with nothing; equal texts link; very long texts are taken whole, one at a
time; rows without doc_id never stand for their group; repeated rows get the same result; other columns stay as they are; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askloom.llm import _words
from askloom.llm._components import connected
from askloom.llm._shared import materialize, release

BLOCK, LEAF, PIVOTS, SHRINKS, SPREAD, LARGE = 2048, 8, 32, 0.8, 2, 16_384
#: Rows of cells that are sampled for hot ones, and how many of them make a cell hot.
SAMPLED, HOT = 1_000_000, 500
_U = np.uint64


def shingle_sets(texts, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z lower-cased."""
    raw, offsets = _words.flat(texts)
    raw = _words.LOWER[raw]
    starts, ends, first = _words.spans(raw, offsets, _words.NOT_SPACE)
    code = _words.hashes(raw, starts, ends)
    every = _words.runs(code, width)
    for a, b in zip(first[:-1], first[1:], strict=True):
        yield np.unique(every[a : b - width + 1]) if b - a >= width else _words.runs(code[a:b], b - a) if b > a else np.zeros(0, _U)


def level_of(size: int, percent: int) -> int:
    """log2 of the number of classes for sets of this size: a tenth more than may differ, or more."""
    least = -(-11 * (100 - percent) * size // (10 * percent))
    return max(0, least - 1).bit_length()


def cells(shingles: np.ndarray, percent: int) -> np.ndarray:
    return np.concatenate([names for _, names in cells_by_level(shingles, percent)])


def cells_by_level(shingles: np.ndarray, percent: int) -> list[tuple[int, np.ndarray]]:
    """The cells to which a set is sent: those of its own size, and of the sizes of larger sets that it may link with."""
    n = len(shingles)
    most = (100 - percent) * n // percent
    out = []
    for level in range(level_of(n, percent), level_of(100 * n // percent, percent) + 1):
        kind = (shingles >> _U(64 - level)).astype(np.int64) if level else np.zeros(n, np.int64)
        head = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
        load = np.diff(np.append(head, n))
        name = _words.mix(np.add.reduceat(_words.mix(shingles + _U(0x51ED2701)), head) + _U(level))
        names = name[np.lexsort((name, -load))][: most + 1]
        if (rest := most + 1 - len(head)) > 0:  # classes without shingles come last
            empty = np.setdiff1d(np.arange(1 << level), kind[head]).astype(_U)
            names = np.concatenate([names, np.sort(_words.mix(_words.mix(empty + _U(0xE3779B1)) + _U(level)))[:rest]])
        out.append((level, names))
    return out


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    mixed = _words.mix(shingles)
    return tuple(int(x.view(np.int64)) for x in (np.add.reduce(mixed, dtype=_U, keepdims=True)[0], np.add.reduce(_words.mix(mixed ^ _U(0xA5A5A5A5)), dtype=_U, keepdims=True)[0]))


#: Steps of size for the largest ratio of linked sets' sizes; sets whose steps differ by more than GAP don't link.
STEPS, GAP = 4, 5


def sized(names: np.ndarray, size: int, percent: int) -> np.ndarray:
    """Names of cells, their last eight bits replaced by the step of the set's size (the last step has all larger ones)."""
    step = min(255, int(STEPS * np.log(max(size, 1)) / np.log(100 / percent) + 1e-9)) if percent < 100 else 0
    return (names & ~_U(255)) | _U(step)


SETS = "doc_id long, n long, f1 long, f2 long, cells array<long>, text_hash long"


def described(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n, fingerprint of the set, cells, hash of the text."""
    from askloom.llm.token_store import batches_of

    def run(batches):
        for batch in batches:
            for a, b in batches_of(batch.column(1)):
                n, f1, f2, where = [], [], [], []
                for s in shingle_sets(batch.column(1).slice(a, b - a), width):
                    p, q = fingerprint(s)
                    n.append(len(s)), f1.append(p), f2.append(q)
                    where.append(sized(cells(s, percent), len(s), percent).view(np.int64) if len(s) else np.zeros(0, np.int64))
                offsets = np.concatenate([[0], np.cumsum([len(w) for w in where])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(offsets, np.concatenate(where))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), lists, batch.column(2).slice(a, b - a)], names=["doc_id", "n", "f1", "f2", "cells", "text_hash"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text")).mapInArrow(run, SETS)


def _same_cell(batches):
    """Rows (cell, rep) in order -> (rep, first rep of its run) for all but the first, each pair once a batch. A run ends with
    its cell, or where the sizes have a gap that no link spans."""
    last_cell, first = None, None

    def apart(a, b):
        return (a >> 8 != b >> 8) | (b - a > GAP)

    for batch in batches:
        if not len(batch):
            continue
        cell, rep = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        head = np.concatenate([[True], apart(cell[:-1], cell[1:])])
        leader = rep[np.maximum.accumulate(np.where(head, np.arange(len(cell)), 0))]
        if last_cell is not None and not apart(last_cell, cell[0]):
            leader[: int(np.argmax(np.append(head[1:], True))) + 1] = first
        last_cell, first = cell[-1], leader[-1]
        pairs = np.unique(np.stack([rep, leader], axis=1)[rep != leader], axis=0)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def parities(shingles: np.ndarray, level: int) -> bytes:
    """Whether each of 4 * 2^level classes (64 at least) holds an odd number of shingles, as bits."""
    bits = max(6, level + 2)
    odd = np.bincount((_words.mix(shingles + _U(0x2545F491)) >> _U(64 - bits)).astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(odd.astype(bool)).tobytes()


COMPARED = 256


def _compatible(percent: int):
    """Rows (region, cell, n, doc_id, parities), in order, of cells of COMPARED members at most -> pairs that join the
    members of a cell which may link."""

    def joined(n: np.ndarray, ids: np.ndarray, odd: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        bits = np.frombuffer(b"".join(odd), _U).reshape(len(ids), -1)
        label = np.arange(len(ids))
        for k in range(len(ids) - 1):
            most = (n[k] + n[k + 1 :]) * (100 - percent) // (100 + percent)
            may = (100 * n[k] >= percent * n[k + 1 :]) & (np.bitwise_count(bits[k + 1 :] ^ bits[k]).sum(axis=1) <= most)
            if may.any():
                met = np.unique(np.append(label[k + 1 :][may], label[k]))
                label[np.isin(label, met)] = met[0]
        moved = label != np.arange(len(ids))
        return ids[moved], ids[label[moved]]

    def run(batches):
        at, n, ids, odd = None, [], [], []
        for batch in batches:
            a, b = [], []

            def close():
                if len(ids) > 1:
                    x, y = joined(np.array(n), np.array(ids), odd)
                    a.append(x), b.append(y)

            for region, cell, size, doc, bits in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if (region, cell) != at:
                    close()
                    at, n, ids, odd = (region, cell), [], [], []
                n.append(size), ids.append(doc), odd.append(bits)
            if a:
                pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
        if len(ids) > 1:
            x, y = joined(np.array(n), np.array(ids), odd)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    return run


def _crowded(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs that join the members of crowded cells whose sizes allow a link, whatever their parities: sizes fall into
    buckets so that only neighbouring ones can link, and members join the smallest doc_id of their bucket."""
    bucket = F.floor(F.log("n") / float(np.log(100 / percent)) + 1e-9)
    placed = rows.select("region", "cell", bucket.alias("bucket"), "doc_id")
    first = materialize(placed.groupBy("region", "cell", "bucket").agg(F.min("doc_id").alias("first")), "cell-buckets")
    members = placed.join(first, ["region", "cell", "bucket"]).select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    above = first.select("region", "cell", (F.col("bucket") - 1).alias("bucket"), F.col("first").alias("next"))
    return members.union(first.join(above, ["region", "cell", "bucket"]).select("first", "next")).filter("a <> b")


# --- the join in a block --------------------------------------------------------------------------------------------


class Postings:
    """Posting lists of some sets."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.size = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets) if sets else np.zeros(0, _U)
        order = np.argsort(every, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.size)[order]
        self.shingle, self.at = np.unique(every[order], return_index=True)
        self.at = np.append(self.at, len(every))

    def common(self, shingles: np.ndarray) -> np.ndarray:
        """How many shingles each set shares with the given one."""
        if not len(self.shingle):
            return np.zeros(len(self.size), np.int64)
        place = np.searchsorted(self.shingle, shingles)
        place = place[(place < len(self.shingle)) & (self.shingle[np.minimum(place, len(self.shingle) - 1)] == shingles)]
        count = self.at[place + 1] - self.at[place]
        entries = np.repeat(self.at[place] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        return np.bincount(self.owner[entries], minlength=len(self.size))

    def distances(self, shingles: np.ndarray) -> np.ndarray:
        both = self.common(shingles)
        return 1 - both / np.maximum(self.size + len(shingles) - both, 1)

    def linked(self, shingles: np.ndarray, percent: int) -> np.ndarray:
        both = self.common(shingles)
        return np.flatnonzero(100 * both >= percent * (self.size + len(shingles) - both)) if len(shingles) else np.zeros(0, np.int64)


def visits(distance: np.ndarray, percent: int) -> np.ndarray:
    """Distances to pivots (rows: members) -> the regions that each member visits, the outer one last.

    If y links with x and lives at the pivot p, then d(x, p) <= d(y, p) + r < 1 and d(x, p) <= d(y, q) + r <= d(x, q) + 2 r
    for every pivot q; if y lives outside, then d(x, p) >= d(y, p) - r >= 1 - 2 r for all pivots. A nearest pivot of which
    the member is no neighbour is visited only on these grounds.
    """
    r, eps = 1 - percent / 100, 1e-9
    nearest = distance.min(axis=1, keepdims=True)
    inner = (distance - nearest <= 2 * r + eps) & (distance < 1 - eps)
    return np.concatenate([inner, nearest >= 1 - 2 * r - eps], axis=1)


def homes(distance: np.ndarray, percent: int) -> np.ndarray:
    """The region where each member lives: that of its nearest pivot, or the outer one (the number of pivots)."""
    return np.where(distance.min(axis=1) < percent / 100, distance.argmin(axis=1), distance.shape[1])


class Block:
    """Some sets, and the groups that links have formed."""

    def __init__(self, ids: np.ndarray, sets: list[np.ndarray], percent: int) -> None:
        self.ids, self.sets, self.percent = ids, sets, percent
        self.parent = list(range(len(sets)))
        self.visitors: list[tuple[int, int]] = []
        self.all: Postings | None = None

    def find(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = self.parent[k]
        return k

    def join(self) -> None:
        self._near(np.arange(len(self.sets)))

    def _near(self, members: np.ndarray) -> None:
        """Joins the linked sets among members: by Voronoi regions, or by counts where they are few or don't part."""
        if len(members) > LEAF:
            drawn = np.argsort(_words.mix(self.ids[members].astype(_U)))[: min(PIVOTS, -(-len(members) // LEAF))]
            pivots = Postings([self.sets[k] for k in members[drawn]])
            distance = np.stack([pivots.distances(self.sets[k]) for k in members])
            seen = visits(distance, self.percent)
            seen[np.arange(len(members)), homes(distance, self.percent)] = True
            if seen.sum(axis=0).max() <= SHRINKS * len(members) and seen.sum() <= SPREAD * len(members):
                for k in range(len(drawn) + 1):
                    self._near(members[seen[:, k]])
                return
        lists = Postings([self.sets[k] for k in members])
        for k in members:
            for other in lists.linked(self.sets[k], self.percent):
                self._unite(int(k), int(members[other]))

    def linked(self, shingles: np.ndarray) -> np.ndarray:
        self.all = self.all or Postings(self.sets)
        return self.all.linked(shingles, self.percent)

    def pass_by(self, doc: int, shingles: np.ndarray) -> None:
        hits = self.linked(shingles)
        if len(hits):
            for other in hits[1:]:
                self._unite(int(hits[0]), int(other))
            self.visitors.append((doc, int(hits[0])))

    def _unite(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        roots = np.array([self.find(k) for k in range(len(self.parent))], np.int64)
        a = np.concatenate([self.ids, np.array([d for d, _ in self.visitors], np.int64)])
        b = np.concatenate([self.ids[roots], self.ids[[self.find(h) for _, h in self.visitors]] if self.visitors else np.zeros(0, np.int64)])
        return a[a != b], b[a != b]


def _joined(percent: int):
    """Rows (region, block, visits, doc_id, shingles), in order: a block's own members first, then what passes by."""

    def run(batches):
        at, ids, sets, block = None, [], [], None

        def result():
            done = block
            if done is None:
                done = Block(np.array(ids, np.int64), sets, percent)
                done.join()
            a, b = done.edges()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            for region, part, visits, doc, body in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if (region, part) != at:
                    if ids:
                        yield result()
                    at, ids, sets, block = (region, part), [], [], None
                shingles = np.frombuffer(body, _U)
                if not visits:
                    ids.append(doc), sets.append(shingles)
                elif ids:
                    if block is None:
                        block = Block(np.array(ids, np.int64), sets, percent)
                        block.join()
                    block.pass_by(doc, shingles)
        if ids:
            yield result()

    return run


# --- regions --------------------------------------------------------------------------------------------------------

def _refined(docs: DataFrame, part: DataFrame, width: int, percent: int) -> DataFrame:
    """Takes the regions of part(rep, region, f1, f2) apart by cells and parities: (rep, part) of the members that may link
    with another."""

    def levels(shingles: np.ndarray) -> list[dict]:
        return [{"names": names.view(np.int64), "odd": parities(shingles, level)} for level, names in cells_by_level(shingles, percent)]

    rows = _member_rows(docs, part, width, "levels", "array<struct<names: array<long>, odd: binary>>", levels)
    cells = rows.select("region", F.col("rep").alias("doc_id"), "n", F.explode("levels").alias("l")).select("region", "doc_id", "n", "l.odd", F.explode("l.names").alias("cell"))
    crowded = materialize(cells.groupBy("region", "cell").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > COMPARED).select("region", "cell"), "crowded-cells")
    few = cells.join(crowded, ["region", "cell"], "left_anti").select("region", "cell", "n", "doc_id", "odd")
    pairs = few.repartition("region", "cell").sortWithinPartitions("region", "cell", "n", "doc_id").mapInArrow(_compatible(percent), "a long, b long")
    found = connected(pairs.union(_crowded(cells.drop("odd").join(crowded, ["region", "cell"], "left_semi"), percent)))
    named = materialize(found.union(found.select("component", "component").distinct()).select(F.col("id").alias("rep"), F.col("component").alias("part")), "parts")
    release(rows, crowded, found)
    return named


PIVOTED = "region long, part long, here boolean, doc_id long, links array<long>"


def _pivoted(members: DataFrame, big: DataFrame, percent: int, block: int) -> DataFrame:
    """Pivots of the regions big(region, members), drawn from members(region, here, doc_id, shingles): the Voronoi region
    of each member, those that it visits, and the pivots that it links with."""
    of = members.join(big, "region")
    share = F.least(F.lit(float(PIVOTS)), F.ceil(4 * F.col("members") / block)) / F.col("members")
    drawn = of.filter(F.pmod(F.xxhash64("doc_id", "region"), F.lit(1 << 40)) < share * float(1 << 40))
    # each salt has its own copy of the region's pivots, so that a region's members are dealt to many tasks
    salts = F.ceil(F.col("members") / block).cast("int")
    columns = ["region", "salt", "pivot", "doc_id", "shingles"]
    pivots = drawn.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).withColumn("pivot", F.lit(0)).select(columns)
    salted = of.withColumn("salt", F.pmod(F.xxhash64("doc_id"), salts).cast("int")).withColumn("pivot", F.lit(1)).select(columns)

    def run(batches):
        at, ids, sets, lists = None, [], [], None
        for batch in batches:
            rows = []
            for region, salt, member, doc, body in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if (region, salt) != at:
                    at, ids, sets, lists = (region, salt), [], [], None
                shingles = np.frombuffer(body, _U)
                if not member:
                    ids.append(doc), sets.append(shingles)
                elif not ids:
                    rows.append((region, region, True, doc, []))
                else:
                    lists = lists or Postings(sets)
                    distance = lists.distances(shingles)[None]
                    linked = [ids[k] for k in lists.linked(shingles, percent)]
                    home = int(homes(distance, percent)[0])
                    seen = visits(distance, percent)[0]
                    seen[home] = True
                    for k in np.flatnonzero(seen):
                        pivot = ids[k] if k < len(ids) else ~region
                        name = int(_words.mix(np.array([region, pivot]).astype(_U)).sum(dtype=_U).astype(np.int64))
                        rows.append((region, name, bool(k == home), doc, linked if k == home else []))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["region", "part", "here", "doc_id", "links"])

    ordered = pivots.union(salted).repartition("region", "salt").sortWithinPartitions("region", "salt", "pivot", "doc_id")
    return materialize(ordered.mapInArrow(run, PIVOTED), "pivoted")


def _split(members: DataFrame, percent: int, block: int) -> tuple[DataFrame, DataFrame | None]:
    """Voronoi recursion: all regions, none above block but those that no longer shrink; and the links with pivots."""
    done, edges = [], None
    while True:
        sizes = members.groupBy("region").agg(F.count(F.lit(1)).alias("members"))
        big = materialize(sizes.filter(F.col("members") > block), "big-regions")
        if big.isEmpty():
            done.append(members)
            break
        done.append(members.join(big.select("region"), "region", "left_anti"))
        seen = _pivoted(members, big, percent, block)
        linked = seen.select(F.explode("links").alias("a"), F.col("doc_id").alias("b")).filter("a <> b")
        edges = linked if edges is None else edges.union(linked)
        largest = seen.groupBy("region", "part").agg(F.count(F.lit(1)).alias("k")).groupBy("region").agg(F.max("k").alias("k"), F.sum("k").alias("all"))
        fine = (F.col("k") <= SHRINKS * F.col("members")) & (F.col("all") <= SPREAD * F.col("members"))
        shrunk = materialize(big.join(largest, "region").filter(fine).select("region"), "shrunk-regions")
        here = members.join(big.select("region"), "region", "left_semi").select("region", "here", "doc_id", "shingles")
        done.append(here.join(shrunk, "region", "left_anti"))
        parts = seen.join(shrunk, "region", "left_semi").select("region", "part", "here", "doc_id")
        members = materialize(here.drop("here").join(parts, ["region", "doc_id"]).select(F.col("part").alias("region"), "here", "doc_id", "shingles"), "regions")
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return out, edges


def _blocks(split: DataFrame, edges: DataFrame | None, block: int) -> DataFrame:
    """Rows (region, block, visits, doc_id, shingles): the members that stay in a block, and those that pass it.

    In a region above block, the largest group that links with pivots have formed is settled: its members need not meet
    one another. They pass the blocks of the others, which pass one another.
    """
    slim = split.select("region", "here", "doc_id")
    sizes = slim.groupBy("region").agg(F.count_if("here").alias("members"))
    big = materialize(sizes.filter(F.col("members") > block).select("region"), "large-regions")
    columns = ["region", "block", "visits", "doc_id", "shingles"]
    small = split.join(big, "region", "left_anti").withColumn("block", F.lit(0)).withColumn("visits", ~F.col("here")).select(columns)
    if big.isEmpty():
        return small
    formed = connected(edges)
    named = materialize(formed.union(formed.select("component", "component").distinct()).select(F.col("id").alias("doc_id"), "component"), "formed")
    inside = split.join(big, "region").join(named, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    counts = inside.filter("here").groupBy("region", "component").agg(F.count(F.lit(1)).alias("k"))
    top = counts.groupBy("region").agg(F.max_by("component", F.struct("k", "component")).alias("top"), F.sum("k").alias("all"), F.max("k").alias("settled"))
    placed = inside.join(materialize(top.select("region", "top", F.ceil((F.col("all") - F.col("settled")) / block).cast("int").alias("blocks")), "tops"), "region")
    open_ = F.col("here") & (F.col("component") != F.col("top"))
    placed = placed.filter("blocks > 0").withColumn("open", open_).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    staying = placed.filter("open").withColumn("block", F.col("own")).withColumn("visits", F.lit(False)).select(columns)
    stops = F.when(F.col("open"), F.col("own")).otherwise(F.col("blocks"))
    passing = placed.filter(stops > 0).withColumn("block", F.explode(F.sequence(F.lit(0), stops - 1))).withColumn("visits", F.lit(True)).select(columns)
    return small.union(staying).union(passing)


#: Members (four numbers each) whose regions are sent to all tasks, 16 MB; those of more are joined by a shuffle of their sets.
SENT_MEMBERS = 500_000

#: Bits of the filter on member ids: 16 a member, in parts of 2^20, 2^29 (64 MB) at most. A full filter only lets more pass.
FILTER_PART, FILTER_MOST = 20, 29


def _id_filter(ids: DataFrame) -> np.ndarray:
    """Bits that are set for every id of ids(rep). Each part is made by one task; what reaches the driver is bounded."""
    count = ids.count()
    size = 1 << min(FILTER_MOST, max(FILTER_PART, (16 * count).bit_length()))
    place = F.pmod(F.xxhash64("rep"), F.lit(size))

    def fill(batches):
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(0).to_numpy()
            for k in np.unique(at >> FILTER_PART):
                bits = parts.setdefault(int(k), np.zeros(1 << FILTER_PART, bool))
                bits[at[(at >> FILTER_PART) == k] & ((1 << FILTER_PART) - 1)] = True
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([np.packbits(b).tobytes() for b in parts.values()], pa.binary())], names=["part", "bits"])

    spread = ids.select(place.alias("at")).distinct().repartition(F.shiftright("at", FILTER_PART))
    out = np.zeros(size // 8, np.uint8)
    step = (1 << FILTER_PART) // 8
    for r in spread.mapInArrow(fill, "part long, bits binary").collect():
        out[r["part"] * step : (r["part"] + 1) * step] |= np.frombuffer(r["bits"], np.uint8)
    return out


def _member_rows(docs: DataFrame, wanted: DataFrame, width: int, name: str, kind: str, make) -> DataFrame:
    """rep, region, n and make(shingles) of wanted(rep, region, f1, f2), from the texts that pass the filter, written; no
    text is shuffled."""
    bits = docs.sparkSession.sparkContext.broadcast(_id_filter(wanted))

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        from askloom.llm.token_store import batches_of

        value = to_arrow_type(schema[name].dataType)
        for batch in batches:
            at = batch.column(2).to_numpy() & (8 * len(bits.value) - 1)
            passed = batch.filter(pa.array((bits.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1))
            for a, b in batches_of(passed.column(1)):
                found = list(shingle_sets(passed.column(1).slice(a, b - a), width))
                prints = [fingerprint(s) for s in found]
                columns = [passed.column(0).slice(a, b - a), *(pa.array([p[k] for p in prints], pa.int64()) for k in (0, 1)), pa.array([len(s) for s in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([make(s) for s in found], value)], names=["rep", "f1", "f2", "n", name])

    ids = F.col("doc_id").cast("long")
    texts = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(ids.alias("rep"), "text", F.xxhash64(ids).alias("h"))
    schema = T.StructType.fromDDL(f"rep long, f1 long, f2 long, n long, {name} {kind}")
    sent = F.broadcast(wanted) if wanted.count() <= SENT_MEMBERS else wanted
    found = texts.mapInArrow(run, schema).join(sent, ["rep", "f1", "f2"]).select("rep", "region", "n", name)
    out = materialize(found, name)
    bits.unpersist()
    return out


def links(docs: DataFrame, described_: DataFrame, width: int, percent: int, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(f1, f2, rep) of all sets, and pairs (a, b) of representatives that span the groups of linked sets."""
    reps = described_.filter("n > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"))
    sent = described_.filter("n > 0 AND doc_id IS NOT NULL").select(F.explode("cells").alias("cell"), "doc_id")
    share = min(1.0, SAMPLED / max(1, described_.agg(F.sum(F.size("cells"))).first()[0] or 0))
    place = F.shiftright("cell", 8)  # without the step of the size
    sent = sent.withColumn("place", place)
    hot = sent.sample(share, seed=1).groupBy("place").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= HOT).select("place")
    hot = materialize(hot, "hot-cells")
    some = not hot.isEmpty()
    hot = F.broadcast(hot)  # at most 2 * SAMPLED / HOT rows
    others = sent.join(hot, "place", "left_anti") if some else sent
    near = others.select("cell", "doc_id").repartition(place).sortWithinPartitions("cell", "doc_id").mapInArrow(_same_cell, "a long, b long")
    if some:
        leaders = F.broadcast(materialize(sent.join(hot, "place").groupBy("place").agg(F.min("doc_id").alias("first")), "hot-leaders"))
        near = near.union(sent.join(leaders, "place").filter("doc_id <> first").select("doc_id", "first"))
    regions = connected(near)
    whole = regions.union(regions.select("component", "component").distinct()).select(F.col("id").alias("doc_id"), F.col("component").alias("region"))
    member = described_.filter("n > 0").select("doc_id", "f1", "f2").join(whole, "doc_id").groupBy("region", "f1", "f2").agg(F.min("doc_id").alias("rep"))
    several = member.groupBy("region").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("region")
    wanted = materialize(member.join(several, "region").select("rep", "region", "f1", "f2"), "region-members")
    release(regions)

    big = materialize(wanted.groupBy("region").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > LARGE).select("region"), "big-regions")
    if not big.isEmpty():
        part = materialize(wanted.join(big, "region", "left_semi").select("rep", "region", "f1", "f2"), "big-members")
        named = _refined(docs, part, width, percent)
        apart = part.join(named, "rep").select("rep", F.col("part").alias("region"), "f1", "f2")
        before, wanted = wanted, materialize(wanted.join(big, "region", "left_anti").select("rep", "region", "f1", "f2").union(apart), "region-members")
        release(before, part, named)
    sets = _member_rows(docs, wanted, width, "shingles", "binary", lambda s: s.tobytes())
    members = sets.select("region", F.lit(True).alias("here"), F.col("rep").alias("doc_id"), "shingles")
    split, edges = _split(members, percent, block)
    ordered = _blocks(split, edges, block).repartition("region", "block").sortWithinPartitions("region", "block", "visits", "doc_id")
    pairs = ordered.mapInArrow(_joined(percent), "a long, b long")
    pairs = materialize(pairs if edges is None else pairs.union(edges), "links")
    release(wanted, big, sets)
    return reps, pairs


def _grouped(docs: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n, f1, f2, text_hash, component (null for empty sets and groups without an id)."""
    table = materialize(described(docs, width, percent), "shingles")
    reps, pairs = links(docs, table, width, percent, block)
    roots = connected(pairs)
    release(pairs)
    named = reps.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("f1", "f2", F.coalesce("component", "rep").alias("component"))
    # a doc_id with several texts belongs to the groups of all of them
    rows = table.select("doc_id", "n", "f1", "f2", "text_hash").join(named, ["f1", "f2"], "left")
    out = materialize(rows.withColumn("component", F.when(F.col("n") > 0, F.col("component"))), "grouped")
    release(table, roots)
    return out


def groups(docs: DataFrame, width: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, a row for each row of docs."""
    rows = _grouped(docs, width, percent, block)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _parted(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of docs whose doc_id and text hash are among keys(_id, _hash), a written table; the other rows). Keys of up to
    SENT_MEMBERS rows go to all tasks; of more, a filter on their ids does, and only the texts that pass it are shuffled."""
    same = [F.col("doc_id").cast("long").eqNullSafe(keys["_id"]), F.xxhash64("text") == keys["_hash"]]
    if keys.count() <= SENT_MEMBERS:
        sent = F.broadcast(keys)
        return docs.join(sent, same, "left_semi"), docs.join(sent, same, "left_anti")
    bits = docs.sparkSession.sparkContext.broadcast(_id_filter(keys.select(F.col("_id").alias("rep"))))

    @F.arrow_udf(T.BooleanType())
    def known(hashes: pa.Array) -> pa.Array:
        at = hashes.to_numpy(zero_copy_only=False) & (8 * len(bits.value) - 1)
        return pa.array((bits.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1)

    passed = known(F.xxhash64(F.col("doc_id").cast("long")))
    some = docs.filter(passed)
    return some.join(keys, same, "left_semi"), docs.filter(~passed).union(some.join(keys, same, "left_anti"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row, with all its columns, of each group: with the smallest doc_id, then the smallest hash of the text.

    Rows with an empty set all stay. Rows without doc_id are apart: one of those in a group stays beside the group's row
    with a doc_id, and one of those with equal sets where there is none.
    """
    grouped = _grouped(docs, width, percent, BLOCK)
    marks = grouped.filter("n > 0").select("doc_id", "component", "text_hash", *(F.when(F.col("component").isNull(), F.col(f)).alias(f) for f in ("f1", "f2")))
    marks = materialize(marks, "marks")
    release(grouped)
    group = ["doc_id", "component", "f1", "f2"]
    texts = marks.filter("doc_id IS NULL OR doc_id = component").groupBy(*group, "text_hash").agg(F.count(F.lit(1)).alias("rows"))
    first = texts.groupBy(*group).agg(F.min("text_hash").alias("first"), F.sum("rows").alias("all")).filter(F.col("all") > 1)
    both = texts.alias("t").join(first.alias("f"), [F.col(f"t.{g}").eqNullSafe(F.col(f"f.{g}")) for g in group])
    repeated = materialize(both.select("t.doc_id", "text_hash", (F.col("text_hash") == F.col("first")).alias("stays"), "rows"), "repeated")
    extra = marks.filter("doc_id <> component").select("doc_id", "text_hash").distinct().union(repeated.filter("NOT stays").select("doc_id", "text_hash"))

    def keys(df: DataFrame) -> DataFrame:
        return df.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))

    gone = materialize(keys(extra), "copies")
    release(marks)
    out = _parted(docs, gone)[1].select(docs.columns)
    once = keys(repeated.filter("stays AND rows > 1"))
    if once.isEmpty():
        return out
    again, others = _parted(out, materialize(once, "repeated-once"))
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    of_text = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.xxhash64(*hashed))
    first = again.withColumn("_k", F.row_number().over(of_text)).filter("_k = 1")
    return others.select(docs.columns).union(first.select(docs.columns))
