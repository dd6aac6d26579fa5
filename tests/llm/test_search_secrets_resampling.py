"""Ranked search, secret scans and importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from askloom.llm import queries, resampling, search, secrets_scan

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, item int, score string"


def words(text):
    return ALNUM.findall((text or "").translate(LOWER))


def corpus(n=300, seed=3):
    """Texts of many lengths with passages of the items, copies, repeated rows, nulls and one very long text."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeéÀ9", k=rng.randint(1, 7))) for _ in range(500)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(1, 40)))) for k in range(25)]
    items += [(25, None), (26, ""), (27, "... --"), (None, "No id " + items[0][1]), (3, items[3][1]), (4, "another text"), (28, "Zebra zebra unheard")]
    out = []
    for _ in range(n):
        text = rng.choices(vocabulary, k=int(rng.paretovariate(0.8) * 5) % 400)
        if rng.random() < 0.3:
            text += (rng.choice(items)[1] or "").split()
        out.append(" ".join(w.upper() if rng.random() < 0.2 else w for w in text))
    out += [None, "", " ,.; ", "é", "x" * 5000, " ".join(rng.choices(vocabulary, k=60_000)), out[0], out[1], out[1]]
    docs = [(k * 7 + 1, t) for k, t in enumerate(out)]
    docs += [docs[5], docs[5], (None, out[2]), (None, out[3])]
    rng.shuffle(docs)
    return docs, items


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, 0, "clash") for r in rows], SCHEMA).repartition(parts)


# --- ranked search ---


def plain_search(docs, items, k):
    counts = [(d, Counter(words(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n_docs, total = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        hits = []
        for d, c, n in counts:
            m = 100 - 75 + (75 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in words(text) if t in c)
            if score > 0:
                hits.append((-score, d is None, d or 0, d))
        out += [(item, r, h[3], -h[0]) for r, h in enumerate(sorted(hits)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("k, block_words", [(10, 400_000), (3, 60)])
def test_search(spark, k, block_words, monkeypatch):
    monkeypatch.setattr(search, "FIRST", 20)
    docs, items = corpus()
    asked = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    got = search.search(frame(spark, docs), asked, k, block_words).collect()
    assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got), key=str) == plain_search(docs, items, k)


def test_search_empty(spark):
    docs, items = corpus(5)
    none = spark.createDataFrame([], SCHEMA)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert search.search(none, asked).count() == 0
    assert search.search(frame(spark, docs), asked.filter("false")).count() == 0
    assert search.search(frame(spark, [(1, None), (2, "-")]), asked).count() == 0


def test_search_prunes_without_loss():
    """Buckets, lengths and coordinate bounds leave most vectors out, and every score that counts is found."""
    rng = np.random.default_rng(4)
    n, terms = 6000, 400
    block = search.Items([(k, " ".join(f"t{t:03}" for t in rng.choice(terms, 8, replace=False))) for k in range(40)] + [(99, " ".join(f"t{t:03}" for t in range(terms)))])
    weights = rng.integers(100, 9000, len(block.codes))
    rows = [np.sort(rng.choice(len(block.codes), rng.integers(1, 30), replace=False)) for _ in range(n)]
    cuts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    flat, impacts = np.concatenate(rows), rng.integers(1, 10**6, cuts[-1])
    length = np.sqrt(np.add.reduceat((impacts * weights[flat]).astype(float) ** 2, cuts[:-1]))
    seen = search.Searcher(block, weights, np.ones(len(block.ids)), 5)
    for a in range(0, n, 2000):
        b = a + 2000
        seen.run(list(range(a, b)), length[a:b], cuts[a : b + 1] - cuts[a], flat[cuts[a] : cuts[b]], impacts[cuts[a] : cuts[b]])
    for i, best in enumerate(seen.best):
        q = np.zeros(len(weights), np.int64)
        q[block.terms[i]] = block.times[i] * weights[block.terms[i]]
        score = np.add.reduceat(impacts * q[flat], cuts[:-1])
        order = sorted(range(n), key=lambda d: (-score[d], d))[:5]
        assert best == [(int(score[d]), d) for d in order if score[d] > 0]
    assert seen.scored < 0.5 * n * len(block.ids)


# --- secrets ---


def plain_base(text):
    text, out = text or "", []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def secret_texts(seed=6):
    rng = random.Random(seed)
    key = lambda n, a="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789": "".join(rng.choices(a, k=n))
    out = [None, "", "no findings here", "pässwörd token = ", "token: abc12", "token: abc123", "é" * 30 + " Secret='" + key(30) + "' é", "TOKEN=" + key(20) + " apikey:" + key(9) + " API_KEY = \"" + key(12) + '"',
           "AKIA" + key(15, "ABCDEFGH0123") + " and AKIA" + key(16, "ABCDEFGH0123") + "x", key(24, "0123456789abcdef") + "g" + key(23, "0123456789abcdef"),
           "token = " + key(40, "0123456789abcdef") + "token=" + key(7), "toKen=abcdefgh paſsword=abcdefgh", "x" * 200_000 + " password = " + key(3000), "token" + " " * 5000 + "= " + key(8), "secret secret: secret: secretsecret"]
    for _ in range(60):
        out.append(" ".join(rng.choice(["the", "größe", "token", "=", "password:", key(8), key(30, "0123456789abcdef"), "AKIA" + key(16, "ABC123"), "\n", "user-guide-of-the-north-wing", "mail2@example.com"]) for _ in range(rng.randint(1, 30))))
    rows = list(enumerate(out))
    return [*rows, rows[7], rows[7], (None, rows[8][1])]


def test_secrets_base(spark):
    rows = secret_texts()
    got = secrets_scan.report(frame(spark, rows)).collect()
    found = sorted((r["doc_id"] if r["doc_id"] is not None else -1, [tuple(s) for s in r["base"]]) for r in got)
    assert found == sorted((k if k is not None else -1, plain_base(t)) for k, t in rows)
    for r in got:
        base = {tuple(s) for s in r["base"]}
        added = [tuple(s) for s in r["spans"] if s["kind"] == 3]
        assert {tuple(s) for s in r["spans"]} - set(added) == base
        assert not any(a < e and s < b for s, _, e in base for a, _, b in added)


def test_secrets_learned(spark):
    """Credentials of shapes without a pattern are found, ordinary long tokens are not."""
    rng = random.Random(31)
    key = lambda n, a: "".join(rng.choices(a, k=n))
    base62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    planted = [(k, f"Wir setzen {rng.choice(['pwd', 'client key', 'Authorization: Bearer', 'signing_key'])} = {key(rng.randint(20, 44), base62)} und gehen weiter.") for k in range(150)]
    clean = [(1000 + k, f"See {rng.choice(['annual-report', 'user/guide', 'NorthWing'])}-{rng.choice(['summary', 'of-the-year', 'draft_version'])}-{rng.randint(1, 2030)} and write to office{k}@mail{k}.example.com.") for k in range(150)]
    got = {r["doc_id"]: len(r["spans"]) for r in secrets_scan.report(frame(spark, planted + clean)).collect()}
    assert sum(got[k] > 0 for k, _ in planted) >= 0.95 * len(planted)
    assert sum(got[k] > 0 for k, _ in clean) <= 0.02 * len(clean)


def test_secrets_model():
    """Held-out findings: recall as asked for; gradients agree with differences."""
    seen, labels = secrets_scan.made([], np.zeros(0, int))
    model = secrets_scan.Model(seen, labels)
    assert (model.recall >= 0.99).all() and (model.false <= 0.05).all()
    net = {k: v.astype(np.float64) for k, v in secrets_scan.fresh().items()}
    codes, inside, owner = secrets_scan.encode(seen[:6] + [(b"", b"a" * 500, b"")])
    assert inside[owner == 6].sum() >= 500 and set(owner) == set(range(7))
    slope = np.linspace(-1, 1, len(codes))
    grads = secrets_scan.backward(net, secrets_scan.forward(net, codes, inside)[1], slope)
    for name, at in (("conv", (3, 2)), ("dense", (5, 1)), ("out", (2, 0)), ("letters", (5, 3)), ("conv_b", (1,))):
        before, step = net[name][at], 1e-4
        sides = []
        for move in (step, -step):
            net[name][at] = before + move
            sides.append(float(secrets_scan.forward(net, codes, inside)[0].astype(np.float64) @ slope))
        net[name][at] = before
        assert (sides[0] - sides[1]) / (2 * step) == pytest.approx(float(grads[name][at]), rel=0.02, abs=2e-3)


def test_secrets_query(spark, tmp_path):
    rows = [r for r in secret_texts() if r[0] is not None]
    frame(spark, rows).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_char_cnn_secrets(spark, str(tmp_path)).collect()
    want = sorted((k, *(sum(s[1] == c for s in plain_base(t)) for c in range(3)), hashlib.sha256(",".join(f"{secrets_scan.KINDS[c]}:{a}:{b}" for a, c, b in plain_base(t)).encode()).hexdigest()) for k, t in rows)
    assert sorted((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == want
    for r in got:
        base = [s for s in r["spans"].split(",") if s and not s.startswith("net:")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r["base_sha256"]
    assert secrets_scan.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_secrets_all_findings_are_learned_from(spark, monkeypatch):
    """Every distinct finding is labelled, and shards learn together: thresholds are those of all held-out findings."""
    rng = random.Random(8)
    texts = [(k, f"token = {''.join(rng.choices('abcdefghkmnpqrst23456789', k=20))} in {k} of {''.join(rng.choices('aeioulnrst', k=22))}") for k in range(3300)]
    found = secrets_scan.materialize(secrets_scan.find(frame(spark, texts), ["doc_id"]), "found")
    seen = secrets_scan.labelled(found)
    assert {r["label"]: r["count"] for r in seen.groupBy("label").count().collect()} == {0: 3300, 1: 3300}
    rows = secrets_scan.materialize(secrets_scan.with_made(seen.limit(900), 3), "rows")
    assert rows.count() >= 900 + 3000 and rows.filter("NOT is_made").count() == 900
    monkeypatch.setattr(secrets_scan, "SHARD", 1500)
    monkeypatch.setattr(secrets_scan, "SORTED", 10)
    model = secrets_scan.fit(rows)
    held = [r for r in rows.collect() if secrets_scan.held_out(bytes(r["value"]))]
    findings, y = [(bytes(r["left"]), bytes(r["value"]), bytes(r["right"])) for r in held], np.array([r["label"] for r in held])
    number, makes = secrets_scan.numbers(model.net, findings), np.array([secrets_scan.make_of(v) for _, v, _ in findings])
    slope, offset = secrets_scan.calibrate(lambda w, aims: secrets_scan.newton_sums(number, y, w, aims), int(y.sum()), int((1 - y).sum()))
    assert (model.slope, model.offset) == pytest.approx((slope, offset), rel=1e-3)
    for make in range(4):
        good = np.sort(model.probability(number[(makes == make) & (y == 1)]))
        if len(good):
            assert model.thresholds[make] == pytest.approx(good[int((1 - secrets_scan.RECALL) * len(good))], rel=1e-3)
    assert model.secret(findings)[y == 1].mean() >= 0.98 and model.secret(findings)[y == 0].mean() <= 0.02


def test_secrets_shards_do_not_depend_on_partitions(spark, monkeypatch):
    """However many partitions there are, the shards make and learn from the same findings."""
    rng = random.Random(9)
    rows = [(k % 2, b"x = ", "".join(rng.choices("abcdef0123456789", k=30)).encode(), b" ") for k in range(400)]
    seen = spark.createDataFrame(rows, "label int, left binary, value binary, right binary")

    def learned():
        out = {}
        for n in (1, 3):
            made = secrets_scan.with_made(seen, n, 60)
            out[n] = sorted((r["label"], bytes(r["left"]), bytes(r["value"]), bytes(r["right"]), r["is_made"]) for r in made.collect()), secrets_scan.trained(seen, n, 0.5, 2)
        return out

    first = learned()
    assert {n: len(rows) for n, (rows, _) in first.items()} == {1: 800, 3: 800}
    plain = type(seen).repartition
    monkeypatch.setattr(type(seen), "repartition", lambda self, n, *cols: plain(self, max(n, 13), *cols))
    second = learned()
    for n in (1, 3):
        assert first[n][0] == second[n][0]
        for k, v in first[n][1].items():
            np.testing.assert_array_equal(v, second[n][1][k])
    monkeypatch.setattr(secrets_scan, "PART", 50)
    assert len(secrets_scan.with_made(seen, 3, 60).collect()) >= 800


# --- resampling ---


def plain_resample(docs, target, width, buckets, percent, min_words, seed):
    def bag(text):
        w = words(text)
        runs = [" ".join(w[i : i + k]) for k in range(1, width + 1) for i in range(len(w) - k + 1)]
        return len(w), Counter(zlib.crc32(r.encode()) % buckets for r in runs)

    bags = [(d, *bag(t)) for d, t in docs]
    s, t = Counter(), Counter()
    for *_, b in bags:
        s.update(b)
    for x in target:
        t.update(bag(x)[1])
    ss, tt = sum(s.values()), sum(t.values())
    out = []
    for d, n, b in bags:
        size = sum(b.values())
        total = sum(c * math.floor(1000 * math.log((t[k] + 1) * (ss + buckets) / ((s[k] + 1) * (tt + buckets)))) for k, c in b.items())
        weight = total // size if size else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, n, size, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = able[: percent * len(able) // 100]
    return sorted([(*r, k) for k, r in enumerate(drawn, 1)] + [(*r, None) for r in able[len(drawn) :]] + [(*r, None) for r in out if r[1] < min_words], key=str)


@pytest.mark.parametrize("width, buckets, percent", [(1, 10_000, 10), (2, 97, 50), (3, 1000, 100)])
def test_resample(spark, width, buckets, percent):
    docs, items = corpus()
    target = [t for _, t in items]
    got = resampling.resample(frame(spark, docs), spark.createDataFrame([(t,) for t in target], "text string"), percent, 20, width, buckets, 7).collect()
    rows = sorted(((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got), key=str)
    assert rows == plain_resample(docs, target, width, buckets, percent, 20, 7)


def test_resample_empty(spark):
    docs, _ = corpus(5)
    none, target = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "text string")
    assert resampling.resample(none, target).count() == 0
    assert resampling.resample(frame(spark, docs), target).count() == len(docs)


def test_drawn_documents(spark):
    docs, items = corpus()
    target = spark.createDataFrame([(t,) for _, t in items], "text string")
    drawn = resampling.drawn_documents(frame(spark, docs), target, percent=20)
    ids = {r["doc_id"] for r in resampling.resample(frame(spark, docs), target, 20).filter("rank IS NOT NULL").collect()}
    assert drawn.columns == ["doc_id", "text", "item", "score"] and {r["doc_id"] for r in drawn.collect()} == ids - {None}


def test_bit_slices():
    """Plane sums equal plain sums for counts and gains of any size and sign."""
    rng = np.random.default_rng(8)
    gains = np.where(rng.random(131) < 0.2, 0, rng.integers(-70_000, 70_000, 131))
    cuts = np.concatenate([[0], np.cumsum(rng.integers(0, 20, 700))])
    where, counts = rng.integers(0, 131, cuts[-1]), rng.integers(1, 2**31, cuts[-1])
    # a bag names a bucket once
    doc = np.repeat(np.arange(700), np.diff(cuts))
    _, first = np.unique(doc * 131 + where, return_index=True)
    doc, where, counts = doc[first], where[first], counts[first]
    cuts = np.searchsorted(doc, np.arange(701))
    got = resampling.sliced_sums(cuts, where, counts, resampling.signed_planes(gains), 131)
    assert got.tolist() == [int((counts[a:b] * gains[where[a:b]]).sum()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
