"""Jaccard join, quality, decontamination and tokens against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from askloom.llm import decontaminate, jaccard_join, quality, token_store

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string"


def texts(seed=1):
    """Groups of copies with few and many changes, tiny and empty texts, repeated rows, and a passage in many texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(2, 5))) for _ in range(300)]
    passage = rng.choices(vocabulary, k=30)
    out = []
    for base in range(25):
        words = rng.choices(vocabulary, k=rng.choice([1, 3, 4, 7, 12, 40, 150, 400]))
        for copy in range(rng.choice([1, 1, 3, 8])):
            changed = [w if rng.random() > 0.02 * copy / 2 else rng.choice(vocabulary) for w in words]
            out.append(" ".join([w.upper() if rng.random() < 0.1 else w for w in changed] + (passage if base % 2 else [])))
    out += [None, "", " \n\t ", "one", "One", "one two", out[0], out[0]]
    rng.shuffle(out)
    return [(k * 3 + 1, t) for k, t in enumerate(out)]


def jaccard_groups(rows, width, percent):
    sets = {}
    for k, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    group = {k: k for k in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {k: low if g == high else g for k, g in group.items()}
    return {k: (len(sets[k]), group[k]) for k in sets}


@pytest.mark.parametrize("width, percent, block", [(4, 85, 2048), (5, 80, 2048), (4, 85, 3), (2, 50, 4)])
def test_jaccard(spark, width, percent, block):
    rows = texts()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.groups(docs, width, percent, block).collect()}
    assert got == jaccard_groups(rows, width, percent)


def test_jaccard_members_by_shuffle(spark, monkeypatch):
    """Many members are joined by a shuffle, few by a broadcast: the same groups."""
    monkeypatch.setattr(jaccard_join, "SENT_MEMBERS", 0)
    rows = texts(4)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.groups(docs, 4, 85).collect()}
    assert got == jaccard_groups(rows, 4, 85)


def test_keeps_one_by_filter(spark, monkeypatch):
    """Of many copies only the texts that a filter on ids lets pass are shuffled: the same rows stay."""
    rows = [*texts(5), *texts(5)[:40], (None, texts(5)[0][1]), (None, texts(5)[0][1])]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = sorted(map(str, jaccard_join.one_of_each(docs, 4, 85).collect()))
    monkeypatch.setattr(jaccard_join, "SENT_MEMBERS", 0)
    assert sorted(map(str, jaccard_join.one_of_each(docs, 4, 85).collect())) == want


def test_sizes_that_link_have_near_steps():
    for percent in (50, 80, 85, 99, 100):
        step = lambda n: int(jaccard_join.sized(np.array([2**64 - 1], np.uint64), n, percent)[0] & np.uint64(255))  # noqa: B023, E731
        for n in [*range(1, 400), 5000, 10**6, 10**9]:
            most = 100 * n // percent
            assert 0 <= step(most) - step(n) <= jaccard_join.GAP
    assert int(jaccard_join.sized(np.array([2**64 - 1], np.uint64), 7, 80)[0]) >> 8 == 2**56 - 1


def test_cells_meet():
    """Sets within the limit share a cell, whatever their sizes."""
    rng = np.random.default_rng(2)
    for size in [*range(1, 40), 77, 300]:
        for percent in (85, 80, 60):
            x = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            room = (100 - percent) * len(x) // 100
            lost = int(rng.integers(0, room + 1))
            y = np.unique(np.concatenate([x[lost:], rng.integers(0, 2**64, max(0, (100 * (len(x) - lost)) // percent - len(x)), dtype=np.uint64)]))
            both = len(np.intersect1d(x, y))
            if 100 * both >= percent * (len(x) + len(y) - both):
                assert np.intersect1d(jaccard_join.cells(x, percent), jaccard_join.cells(y, percent)).size


def test_jaccard_keeps_one(spark):
    docs = spark.createDataFrame([(2, "a b c d e f", "x"), (1, "A b c d e f", "y"), (5, "", "z"), (None, "a b c d e f", "n"), (2, "a b c d e f", "x")], SCHEMA + ", component_id string")
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "5", "None"]
    assert jaccard_join.groups(docs.limit(0)).count() == 0
    assert {(r["doc_id"], r["component_id"]) for r in jaccard_join.groups(docs).collect()} == {(1, 1), (2, 1), (5, 5), (None, 1)}


def test_jaccard_keeps_one_of_repeated_rows(spark):
    body = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty more"
    other = "an unlike text of some eight or nine words"
    rows = [
        (1, body, "x"), (1, body, "x"), (1, body, "y"), (1, body + " yet", "x"), (2, body, "x"), (3, body + " yet", "x"),  # one group
        (4, other, "x"), (4, other + " that differ", "x"),  # an id of a group, twice
        (2, "text of another group under the id of a copy", "x"),
        (None, body, "n"), (None, body, "n"), (None, "rows without any number at all here", "n"), (None, "rows without any number at all here", "n"),
        (5, "", "x"), (5, "", "x"),
    ]
    docs = spark.createDataFrame(rows, SCHEMA + ", source string").repartition(3)
    kept = [(r["doc_id"], (r["text"] or "")[:4]) for r in jaccard_join.one_of_each(docs).collect()]
    assert sorted(kept, key=str) == sorted([(1, "one "), (4, "an u"), (2, "text"), (None, "one "), (None, "rows"), (5, ""), (5, "")], key=str)


def test_quality(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for k in range(600):
        words = ["".join(rng.choices("aeiourtn", k=rng.randint(2, 8))) for _ in range(rng.randint(5, 80))]
        good = k % 4 > 0
        rows.append((k, " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words) if k % 8 else " ".join(words[:1] * 40), "src"))
        if k < 500:
            labels.append((k, int(good)))
    rows += [(9001, None, "a"), (9002, "", "b"), (9003, "x " * 20000, "c"), (5, rows[5][1], "d")]
    docs = spark.createDataFrame(rows, SCHEMA + ", score string").repartition(3)
    marks = spark.createDataFrame([*labels, labels[0], (None, 1), (3, None)], "doc_id long, quality int")
    got = quality.score(docs, marks).collect()
    assert len(got) == len(rows)
    truth = dict(labels)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    kept = quality.keep_good(docs, marks)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in got if r["predicted"])


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in quality.score(docs, none).collect()] == [0.5, 0.5]
    assert quality.score(docs.limit(0), none).count() == 0


def contamination(docs, items, window=10):
    windows, widths = {}, set()
    for item, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add(str(item))
            widths.add(n)
    out = {}
    for k, t in docs:
        w, hit, found = ALNUM.findall((t or "").translate(LOWER)), set(), set()
        for n in widths:
            for i in range(len(w) - n + 1):
                if items_ := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= items_
        out[k] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("block_words", [2_000_000, 20])
def test_contamination(spark, monkeypatch, block_words):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block_words)
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcé1", k=rng.randint(1, 3))) for _ in range(12)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([3, 4, 9, 10, 11, 25])))) for k in range(14)] + [(20, None), (21, "!!"), (22, "a b c d e f g h i j a b c d e f g h i j")]
    items.append((30, items[0][1].upper()))
    docs = []
    for k in range(120):
        words = rng.choices(vocabulary, k=rng.randint(0, 60))
        if k % 2:
            body = ALNUM.findall(rng.choice(items)[1] or "")
            words[3:3] = body[rng.randint(0, 2) :]
        docs.append((k, rng.choice([" ", ", ", "-"]).join(words)))
    docs += [(500, None), (501, ""), (502, "?!")]
    d, b = spark.createDataFrame(docs, SCHEMA + "").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.report(d, b).collect()}
    want = contamination(docs, items)
    assert {k: (r["n_words"], r["n_hit"], r["items"]) for k, r in got.items()} == want
    words = {k: ALNUM.findall((t or "").translate(LOWER)) for k, t in [*docs]}
    named = {str(k): ALNUM.findall((t or "").translate(LOWER)) for k, t in items}
    for k, r in got.items():
        for m in r["matches"]:
            assert words[k][m["doc_from"] : m["doc_from"] + m["words"]] == named[m["item_id"]][m["item_from"] : m["item_from"] + m["words"]]
    clean = decontaminate.clean(d.withColumnRenamed("doc_id", "matches"), b)
    assert sorted(r["matches"] for r in clean.collect()) == sorted(k for k, v in want.items() if not v[1])


def test_contamination_of_nothing(spark):
    d, b = spark.createDataFrame([(1, "a b c")], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(d, b).first()["n_hit"] == 0
    assert decontaminate.clean(d, b).count() == 1 and decontaminate.report(d.limit(0), b).count() == 0
    nameless = spark.createDataFrame([(None, "a b c")], "item_id long, text string")
    r = decontaminate.report(d, nameless).first()
    assert (r["n_hit"], r["items"]) == (3, [])


def test_one_item_id_digest():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


@pytest.fixture(scope="module")
def vocabulary():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path("word_bpe_49k.json")


ODD = ["<|endoftext|> a", "A<|ENDOFTEXT|>b", "it's DON'T we'LL 'S s's", "", None, " \n", "é ́x", "Σς ΑΣ", "a b c", "x—y…,", "12abc3,4", "İstanbul KK", "日本語、テキスト", "a|b<c>d", "foo_bar-baz(qux)", "😀😀 hi!", "ﬁ ẞ ß ÿ÷×", "word " * 5000]


def test_tokens(spark, vocabulary):
    from tokenizers import Tokenizer

    rows = [(k * 7 % 19 if k else None, t) for k, t in enumerate(ODD)]
    docs = spark.createDataFrame([*rows, rows[3]], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in token_store.round_trip(docs, vocabulary, ids_per_file=2000).collect()), key=lambda r: (r[1], r[2]))
    plain, start = Tokenizer.from_file(vocabulary), 0
    expected = {}
    for k, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        expected[k] = (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    keys = [-1 if r[0] is None else r[0] for r in got]
    assert keys == sorted(keys) and len(got) == len(rows) + 1
    for k, at, n, crc in got:
        assert at == start and (n, crc) == expected[k]
        start += n


def test_no_documents(spark, vocabulary):
    assert token_store.round_trip(spark.createDataFrame([], SCHEMA), vocabulary).count() == 0


def test_code_is_optimal_and_limited():
    import heapq

    rng = np.random.default_rng(1)
    counts = np.concatenate([rng.integers(0, 1000, 300), [0, 10**9]])
    lengths = token_store.code_lengths(counts)
    heap = [(int(c), k, 0) for k, c in enumerate(counts) if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a[0] + b[0]
        heapq.heappush(heap, (a[0] + b[0], a[1], 0))
    assert int((lengths * counts).sum()) == cost and lengths.max() <= 16
    steep = token_store.code_lengths(np.array([2**k for k in range(40)]))
    assert steep.max() <= 16 and sum(2.0 ** -int(x) for x in steep) <= 1
    codes = token_store.canonical_codes(lengths)
    words = sorted(format(c, f"0{n}b") for c, n in zip(codes, lengths) if n)
    assert not any(b.startswith(a) for a, b in zip(words, words[1:]))
