"""Mixing, sharding and URL reputation against plain Python."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import pytest

from askloom.llm import mixing, sharding, url_filter

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=400):
    rows = []
    for k in range(n):
        source = None if k % 37 == 0 else "hot" if k % 3 == 0 else f"s{k % 5}"
        rows.append((k, " ".join(["word"] * (k * 7919 % 90)), "en" if k % 4 else None, source, k))
    rows += [rows[3], rows[3], (None, "no id here", "en", "s1", 1), (900, None, "de", "s2", None), (901, "", None, "none left", 0), (902, " \t\n", "de", "blank", 3)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def water_fill(sizes, weights=(3, 1, 2), share=1.5, epochs=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        rate = left / sum(weight[s] for s in free)
        over = {s for s in free if rate * weight[s] >= epochs * sizes[s]}
        if not over:
            return target | {s: rate * weight[s] for s in free}
        for s in over:
            target[s] = epochs * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mix(spark):
    rows = corpus()
    got = mixing.mix(frame(spark, rows)).collect()
    sizes, size = defaultdict(int), lambda t: len(WORD.findall(t or ""))
    for r in rows:
        sizes[r[3]] += size(r[1])
    aim = water_fill(dict(sizes))
    taken = defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(aim[r["source"]])
    for s, total in taken.items():
        assert abs(total - aim[s]) <= 0.5
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(frame(spark, rows[::-1])).collect()))


def test_mixed_documents(spark):
    rows = corpus()
    docs = frame(spark, rows).withColumnRenamed("n_chars", "size")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words, wanted = defaultdict(int), defaultdict(int)
    for r in out.collect():
        words[r["source"]] += len(WORD.findall(r["text"]))
    for r in mixing.mix(frame(spark, rows)).collect():
        wanted[r["source"]] += r["taken"]
    assert {k: v for k, v in wanted.items() if v} == dict(words)


def test_mix_of_nothing(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    assert mixing.mixed_documents(frame(spark, [(1, None, None, "a", 0)])).count() == 0


def test_shards(spark):
    rows = corpus(1500)
    got = sharding.assign(frame(spark, rows), 24).collect()
    assert len(got) == len(rows)
    total, slots = defaultdict(int), defaultdict(list)
    sums = sorted((zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 8) for r in rows)
    assert sums == sorted((r["text_crc32"], r["size"]) for r in got)
    for r in got:
        total[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(total) == set(range(24))
    assert max(total.values()) - min(total.values()) <= 3 * max(r["size"] for r in got)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_equal_rows_and_clashing_names(spark):
    rows = [(7, "same", "en", "a", 4)] * 50
    docs = frame(spark, rows).withColumnRenamed("n_chars", "node")
    out = sharding.shard_documents(docs, 6)
    assert out.columns == [*docs.columns, "shard"] and out.count() == 50
    assert sharding.assign(frame(spark, []), 24).count() == 0
    few = sharding.assign(frame(spark, rows[:1]), 24).collect()
    assert [r["slot"] for r in few] == [0]


URLS = [
    (0, "https://a.example.org/es/1", None, None), (1, "http://EXAMPLE.org/en/12?q#f", "example.org/en/1", "block"), (2, "http://x.org/", "org/", "allow"), (3, "http://y.com/fr/a", "com/fr/", "allow"),
    (4, "http://y.com/de/", "com/de/", "block"), (5, "http://notcom/fr/", None, "allow"), (6, None, None, "allow"), (7, "no scheme", None, "allow"), (8, "http://z.org", None, "allow"), (9, "http://q.com?x=/fr/", None, "allow"),
]
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def test_url_rules(spark):
    pages = spark.createDataFrame([(k, u) for k, u, _, _ in URLS], "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {r["page_id"]: r for r in url_filter.judge(pages, none, RULES).collect()}
    assert got[0]["rule"] == "example.org/es/" and got[0]["verdict"] == "block"
    for k, _, rule, verdict in URLS[1:]:
        assert (got[k]["rule"], got[k]["verdict"]) == (rule, verdict), k
    assert (got[1]["host"], got[1]["path"]) == ("example.org", "/en/12")
    assert (got[6]["host"], got[6]["path"]) == ("", "") == (got[7]["host"], got[7]["path"])
    assert (got[9]["host"], got[9]["path"]) == ("q.com", "")
    assert url_filter.judge(pages.limit(0), none, RULES).count() == 0


def test_reputation(spark):
    def outcomes():
        for host, bad, n in (("spam.net", 38, 40), ("fine.net", 1, 60), ("www.fine.net", 0, 3), ("new.spam.net", 0, 0), ("few.net", 2, 2), ("other.com", 5, 50)):
            for k in range(max(n, 1)):
                yield host, (int(k < bad) if n else None)

    rows = [(k, f"http://{h}/p", b) for k, (h, b) in enumerate(outcomes())]
    pages = spark.createDataFrame([(k, u) for k, u, _ in rows], "page_id long, url string")
    labels = spark.createDataFrame([(k, b) for k, _, b in rows if b is not None] + [(0, 1)], "page_id long, bad int")
    got = {r["host"]: r for r in url_filter.judge(pages, labels, []).select("host", "verdict", "rate", "lower").distinct().collect()}
    assert got["spam.net"]["verdict"] == "block" and got["fine.net"]["verdict"] == "allow" and got["other.com"]["verdict"] == "allow"
    assert got["www.fine.net"]["rate"] < got["few.net"]["rate"] < 1  # shrunk to its domain, and not to 1
    assert got["new.spam.net"]["rate"] > got["www.fine.net"]["rate"]  # without labels: as its domain
    assert all(0 <= r["lower"] <= r["rate"] <= 1 and not math.isnan(r["rate"]) for r in got.values())


def test_hash_is_plain_md5(spark):
    from askloom.llm._shared import hash60

    df = spark.createDataFrame([(5,), (None,)], "doc_id long")
    got = [r[0] for r in df.select(hash60("doc_id", "mix")).collect()]
    assert got == [int(hashlib.md5(f"{x}:mix".encode()).hexdigest()[:15], 16) for x in ("5", "")]
