"""The methods against plain Python, and every registered corpus query on a small table."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from askloom.llm import _words, html_text, jaccard_join, quality, queries, sharding, token_store
from tests.llm.test_documents import contamination, jaccard_groups
from tests.llm.test_vectors_and_pages import brute_links

SMALL = "/root/testdata/sf0.001"


def table(spark, name):
    return [tuple(r) for r in spark.read.parquet(f"{SMALL}/{name}.parquet").collect()]


# --- words ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("piece", [1 << 22, 7, 1])
def test_words_in_pieces(monkeypatch, piece):
    import pyarrow as pa

    monkeypatch.setattr(_words, "PIECE", piece)
    texts = ["one two", "", None, " x", "y ", "tail", "z" * 300 + " " + "z" * 300 + " é", "one"]
    raw, offsets = _words.flat(pa.array(texts))
    starts, ends, first = _words.spans(raw, offsets, _words.NOT_SPACE)
    found = [raw[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
    assert [found[a:b] for a, b in zip(first, first[1:])] == [(t or "").split() for t in texts]
    code = _words.hashes(raw, starts, ends)
    assert len({(w, int(c)) for w, c in zip(found, code, strict=True)}) == len(set(found)) == len({int(c) for c in code})


# --- 2: Voronoi regions ---------------------------------------------------------------------------------------------


def test_regions_in_a_task(monkeypatch):
    """Unlike groups of near copies in one block part into regions, and no link is lost."""
    parted = []
    near = jaccard_join.Block._near
    monkeypatch.setattr(jaccard_join.Block, "_near", lambda self, members: (parted.append(len(members)), near(self, members))[1])
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 2**64, 60, dtype=np.uint64)
        for _ in range(int(rng.integers(1, 9))):
            kept = base[rng.random(60) > rng.choice([0.02, 0.1, 0.2])]
            sets.append(np.unique(np.concatenate([kept, rng.integers(0, 2**64, int(rng.integers(0, 6)), dtype=np.uint64)])))
    block = jaccard_join.Block(np.arange(len(sets)) * 7, sets, 80)
    block.join()
    root, plain = list(range(len(sets))), [frozenset(s.tolist()) for s in sets]
    for a in range(len(sets)):
        for b in range(a):
            both = len(plain[a] & plain[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    assert [block.find(k) for k in range(len(sets))] == root
    assert max(parted[1:]) <= 0.8 * parted[0]


def test_hot_and_crowded_cells(spark, monkeypatch):
    """The paths of hot cells and of crowded cells give the same groups."""
    monkeypatch.setattr(jaccard_join, "HOT", 3)
    monkeypatch.setattr(jaccard_join, "COMPARED", 2)
    monkeypatch.setattr(jaccard_join, "LARGE", 2)
    rng = random.Random(4)
    rows = []
    for base in range(12):
        words = [f"w{rng.randrange(80)}" for _ in range(60)]
        for copy in range(6):
            rows.append((len(rows), " ".join(w if rng.random() > 0.01 * copy else "new" + w for w in words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.groups(docs, 4, 85).collect()}
    assert got == jaccard_groups(rows, 4, 85)


# --- 3: discriminant ------------------------------------------------------------------------------------------------


def plain_features(text):
    body = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0d]+", body)
    lower = [w.lower() for w in words]
    lines = [x for x in body.split(b"\n") if x]
    odds = lambda a, b, usual, weight: math.log((a + weight * usual) / (b - a + weight * (1 - usual)))
    among = lambda chars: sum(body.count(c.encode()) for c in chars)
    counts = [among("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), among("0123456789"), among(".,;:"), among("!?"), among("#$%&*|<>{}[]^~=+_\\@/"), sum(b >= 0x80 for b in body)]
    top = max((lower.count(w) for w in set(lower)), default=0)
    n = len(words)
    return [
        math.log1p(n), math.log((sum(map(len, words)) + 100) / (n + 20)),
        *(odds(c, len(body), usual, 100) for c, usual in zip(counts, (0.03, 0.005, 0.03, 0.001, 0.001, 0.03))),
        math.log((len(body) + 200) / (len(lines) + 1)), odds(sum(a == b for a, b in zip(lower, lower[1:])), n, 0.01, 20), odds(len(set(lower)), n, 0.8, 20),
        odds(top, n, 0.05, 20), odds(len(set(lines)), len(lines), 0.9, 2), odds(sum(len(w) <= 2 for w in words), n, 0.2, 20),
    ]


def test_scores_from_plain_densities(spark):
    """Features, shrunk covariances and Mahalanobis distances by plain formulas, without a Cholesky factor."""
    docs, labels = table(spark, "documents"), dict(r[:2] for r in table(spark, "labels"))
    vectors = {r[0]: np.array(plain_features(r[1])) for r in docs}
    learned = [k for k in vectors if k in labels and zlib.crc32(str(k).encode()) % 5]
    d, parts = len(quality.NAMES), []
    groups = [np.array([vectors[k] for k in learned if labels[k] == y]) for y in (0, 1)]
    spread = [np.cov(g.T, bias=True) for g in groups]
    n = [len(g) for g in groups]
    pooled = np.diag(np.maximum((spread[0].diagonal() * n[0] + spread[1].diagonal() * n[1]) / sum(n), quality.FLOOR))
    for g, cov in zip(groups, spread, strict=True):
        weight = max(quality.SHRINK, d / (d + len(g)))
        s = (1 - weight) * cov + weight * (0.5 * np.diag(cov.diagonal()) + 0.5 * pooled) + quality.FLOOR * np.eye(d)
        parts.append((g.mean(axis=0), np.linalg.inv(s), np.linalg.slogdet(s)[1]))
    got = {r["doc_id"]: r["score"] for r in queries.op3_quality_qda(spark, SMALL).collect()}
    assert set(got) == set(vectors)
    for k, x in vectors.items():
        log_density = [-0.5 * (x - m) @ inverse @ (x - m) - 0.5 * log_det for m, inverse, log_det in parts]
        want = 1 / (1 + math.exp(min(500, max(-500, log_density[0] - log_density[1] - math.log(n[1] / n[0])))))
        assert got[k] == pytest.approx(want, abs=1e-6)


# --- 5: k-d tree ----------------------------------------------------------------------------------------------------


def kd_tree(rows, shards):
    """(text -> shard) of rows (doc_id, text, lang, source) whose texts are all small beside a shard."""
    hashed = lambda v, salt: int(hashlib.md5(f"{v}:{salt}".encode()).hexdigest()[:15], 16) >> 50 if v is not None else 0
    texts = {}
    for k, text, lang, source in rows:
        body = (text or "").encode()
        at = texts.setdefault(text or "", [0, (k, hashed(source, "dim"), hashed(lang, "dim")), len(body) + 8, zlib.crc32(body) >> 19])
        at[0] += at[2]
        at[1] = min(at[1], (k, hashed(source, "dim"), hashed(lang, "dim")))
    low, high = min(t[2] for t in texts.values()), max(t[2] for t in texts.values())
    first, last = min(t[1][0] for t in texts.values()), max(t[1][0] for t in texts.values())
    step = lambda v, a, b: min(1023, math.floor((v - a) * (1024 / (b - a)))) if b > a else 0
    points = [(name, n, [step(math.log(size), math.log(low), math.log(high)), step(ids[0], first, last), ids[1], ids[2]], tie) for name, (n, ids, size, tie) in texts.items()]
    where = {}

    def split(part, shard, n):
        if n == 1:
            where.update((p[0], shard) for p in part)
            return
        wide = [max(p[2][d] for p in part) - min(p[2][d] for p in part) for d in range(4)]
        dim = wide.index(max(wide))
        sums = defaultdict(int)
        for p in part:
            sums[p[2][dim] * 8192 + p[3]] += p[1]
        goal, before = sum(sums.values()) * (n // 2) / n, 0
        for key in sorted(sums):
            if before + sums[key] >= goal:
                cut = key + (before + sums[key] - goal < goal - before)
                break
            before += sums[key]
        split([p for p in part if p[2][dim] * 8192 + p[3] < cut], shard, n // 2)
        split([p for p in part if p[2][dim] * 8192 + p[3] >= cut], shard + n // 2, n - n // 2)

    split(points, 0, shards)
    return where


def test_tree(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LARGE", 0.1)  # no text is dealt out before the tree
    rng = random.Random(9)
    texts = [" ".join(rng.choices(["alpha", "be", "gamma delta"], k=rng.randint(20, 60))) + f" {k}" for k in range(900)]
    rows = [(k, rng.choice(texts), rng.choice(["en", "de", None]), rng.choice(["web", "book", "code", None])) for k in range(1400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = {(r["doc_id"]): r["shard"] for r in sharding.shard_documents(docs, 7).collect()}
    want = kd_tree(rows, 7)
    assert got == {k: want[text] for k, text, *_ in rows}


def test_equal_texts_share_a_shard(spark):
    """Also beside texts that are large by their copies or their length; only one that exceeds a shard is parted."""
    rng = random.Random(10)
    rows = [(k, f"text {rng.randint(0, 700)} " * 20, rng.choice(["en", "de"]), rng.choice("abc")) for k in range(2000)]
    rows += [(k, "copied text " * 25, "en", rng.choice("abc")) for k in range(2000, 2100)] + [(k, "very hot text " * 20, "de", "a") for k in range(2100, 3300)] + [(4000, "long " * 6000, "en", "b"), (4001, None, None, None), (4002, "", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = sharding.assign(docs, 12).collect()
    total, shards, copies = defaultdict(int), defaultdict(set), defaultdict(int)
    for r in got:
        total[r["shard"]] += r["size"]
        shards[r["text_crc32"], r["size"]].add(r["shard"])
        copies[r["text_crc32"], r["size"]] += r["size"]
    target = sum(total.values()) / 12
    assert len(got) == len(rows) and all(len(s) == 1 for k, s in shards.items() if copies[k] <= target)
    assert max(total.values()) < 1.06 * target and min(total.values()) > 0.94 * target


# --- 6: many files --------------------------------------------------------------------------------------------------


def test_many_files(spark):
    """A hot doc_id and many ranges: files of bounded size, in order."""
    vocabulary = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    rows = [(7 if k % 3 else k, f"the text number {k} of it") for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    from askloom.llm._shared import new_folder

    folder = new_folder(spark, "test")
    manifest = token_store.write_tokens(docs, folder, vocabulary, ids_per_file=12)
    files = manifest.collect()
    assert len(files) > 400 and max(f["ids"] for f in files) < 12 + 20 and sum(f["documents"] for f in files) == 900
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in token_store.read_tokens(manifest, folder).collect())
    assert [d for _, d, _ in got] == sorted(d for d, _ in rows)
    assert [s for s, *_ in got] == [0, *np.cumsum([n for *_, n in got])[:-1]]


def test_tokenizer_that_does_not_cut_at_spaces():
    from tokenizers import Tokenizer, models

    import pyarrow as pa

    tokenizer = Tokenizer(models.BPE(vocab={"a": 0, " ": 1, "b": 2, "a ": 3, "a b": 4}, merges=[("a", " "), ("a ", "b")]))
    from tempfile import NamedTemporaryFile

    with NamedTemporaryFile(suffix=".json") as file:
        tokenizer.save(file.name)
        encode = token_store.Encoder(file.name, 9)
    ids, stops = encode(pa.array(["a b", None, "b a b"]))
    assert ids.tolist() == [4, 9, 9, 2, 1, 4, 9] and stops.tolist() == [0, 2, 3, 7]


# --- 8: windows -----------------------------------------------------------------------------------------------------


def plain_main_lines(lines, lengths, flags):
    """Surge and dive by loops over each kind of line."""
    kinds, outside_counts = defaultdict(list), (sum(p for (_, p), f in zip(lengths, flags) if f[2] and f[3] and not f[0] and not f[1]), sum(p for (_, p), f in zip(lengths, flags) if not any(f[:3])))
    bounded = any(f[3] and not any(f[:3]) for f in flags) or outside_counts[0] > outside_counts[1]
    for i, ((whole, plain), (hard, form, mark, article)) in enumerate(zip(lengths, flags)):
        if not hard:
            outside = bool(bounded and not article)
            kinds[bool(form), bool(mark), outside].append((i, (whole if article else plain) / 32 ** (form + mark + outside)))
    sums = {k: [sum(w for _, w in x[max(0, i - 1) : i + 2]) for i in range(len(x))] for k, x in kinds.items()}
    peak, out = max((max(s) for s in sums.values()), default=0), set()
    for k, x in kinds.items():
        at = 0
        while at < len(x):
            end = at
            while end < len(x) and sums[k][end] > 1e-9:
                end += 1
            if end > at and (not any(k) or max(sums[k][at:end]) >= peak / 4):
                heavy = [j for j in range(at, end) if x[j][1] > 0]
                out |= {x[j][0] for j in range(heavy[0], heavy[-1] + 1)}
            at = max(end, at + 1)
    return [lines[i] for i in sorted(out)]


def random_page(rng):
    word = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit"]) for _ in range(n))
    out = []
    for _ in range(rng.randint(1, 25)):
        text = word(rng.choice([1, 2, 8, 60]))
        out.append(rng.choice([f"<p>{text}</p>", f"<div class='ad'>{text}</div>", f"<li><a href=/>{text}</a></li>", f"<nav>{text}</nav>", f"<form><p>{text}</p></form>", f"<div id=sidebar>{text}<p>{text}</p></div>"]))
        if rng.random() < 0.1:
            out.append(rng.choice(["<article>", "</article>", "<div class='widget'>"]))
    return "".join(out)


def test_lines_by_plain_windows(spark):
    rng = random.Random(12)
    pages = [random_page(rng) for _ in range(400)] + [r[2] for r in table(spark, "pages")]
    for page in pages:
        lines, lengths, flags = html_text.lines_of(page or "")
        assert html_text.main_lines(lines, lengths, flags) == plain_main_lines(lines, lengths.tolist(), flags.tolist())


def test_windows_decide_on_the_pages(spark, monkeypatch):
    """Without the surge threshold other text stays: on the given pages, which all have an article element, too."""
    pages = [r[2] for r in table(spark, "pages") if r[2]]
    before = [html_text.extract(p) for p in pages]
    monkeypatch.setattr(html_text, "SURGE", 0)
    after = [html_text.extract(p) for p in pages]
    assert sum(a != b for a, b in zip(after, before, strict=True)) > len(pages) // 2
    monkeypatch.undo()
    monkeypatch.setattr(html_text, "MARKS", frozenset())
    unnamed = [html_text.extract(p) for p in pages]
    assert unnamed == before  # the window sums, not the names of classes, part adverts from the article


def test_unnamed_blocks_beside_an_article():
    body = "".join(f"<p>{'A sentence of the article. ' * 6}</p>" for _ in range(4)) + "<p>The end.</p>"
    page = f"<div>Buy now</div><article><h1>Title</h1>{body}</article><div><p>Read this too</p><p>And that</p></div>"
    assert html_text.extract(page).startswith("Title\nA sentence") and html_text.extract(page).endswith("The end.")


# --- the registered queries -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = sorted(c[0] for c in want.description)
    at = [[c[0] for c in want.description].index(c) for c in columns]
    rounded = lambda row: str([round(x, 6) if isinstance(x, float) else x for x in row])
    want = sorted(rounded([r[i] for i in at]) for r in want.fetchall())
    got = queries.QUERIES[name](spark, SMALL).select(*columns).collect()
    assert sorted(rounded(r) for r in got) == want


def test_query_of_links(spark):
    docs = [r[:2] for r in table(spark, "documents")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op2_jaccard_join(spark, SMALL).collect()}
    assert got == jaccard_groups(docs, 4, 85)
    rows = table(spark, "embeddings")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in queries.op4_pq_near_vectors(spark, SMALL).collect()}
    assert got == brute_links(rows)


def test_query_of_shards(spark):
    docs = {r[0]: r for r in table(spark, "documents")}
    got = queries.op5_kd_tree_shards(spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    slots = defaultdict(list)
    for r in got:
        body = (docs[r["doc_id"]][1] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(body) + 8, zlib.crc32(body), "bytes", None)
        slots[r["shard"]].append(r["slot"])
    assert all(0 <= k < 24 and sorted(s) == list(range(len(s))) for k, s in slots.items())


def test_query_of_tokens(spark):
    from tokenizers import Tokenizer

    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    plain, start = Tokenizer.from_file(path), 0
    got = sorted(tuple(r) for r in queries.op6_huffman_tokens(spark, SMALL).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    want = []
    for k, text, *_ in sorted(table(spark, "documents")):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_query_of_contamination(spark):
    want = contamination([r[:2] for r in table(spark, "documents")], table(spark, "benchmark"))
    got = queries.op7_suffix_decontaminate(spark, SMALL).collect()
    assert len(got) == len(want)
    for r in got:
        words, hit, items = want[r["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (words, hit, len(items), hit > 0)
        assert r["items_sha256"] == hashlib.sha256(",".join(items).encode()).hexdigest()


def test_queries_of_pages(spark):
    pages = {r[0]: r for r in table(spark, "pages")}
    got = queries.op8_html_line_blocks(spark, SMALL).collect()
    assert sorted(r["page_id"] for r in got) == sorted(pages) and all(r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]][1] for r in got)
    for r in got:  # the given pages: all text is in the article element, each block without its markup
        inner = re.search(r"(?s)<article>(.*)</article>", pages[r["page_id"]][2])[1]
        import html

        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(b for b in blocks if b)
    first = {}
    for k, (_, _, body) in sorted(pages.items()):
        first.setdefault(body or "", k)
    for r in queries.op10_warc_bundles(spark, SMALL).collect():
        body = pages[r["page_id"]][2] or ""
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(body.encode()).digest()).decode() and r["payload_bytes"] == len(body.encode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first[body] == r["page_id"] else ("revisit", first[body]))


# --- the pipeline ---------------------------------------------------------------------------------------------------


def test_stages_with_odd_rows(spark):
    """Nulls, repeats, an empty and a very long text, an empty table and columns with clashing names."""
    import corpus_pipeline

    body = "some words of a text that is long enough to have shingles and more"
    rows = [(1, body, "en", "web", 3), (1, body, "en", "web", 3), (2, body, None, None, None), (None, body + " yet again", "en", "web", 1), (3, None, "en", None, 0), (4, "", "de", "web", 0), (5, "long " * 400_000, "en", "book", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    odd = docs
    for clash in ("shard", "score", "matches", "component", "node", "size", "taken", "row", "keys"):
        odd = odd.withColumn(clash, F.lit(clash))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SMALL)
        assert set(out.columns) == set(odd.columns), name
        assert all(r["taken"] == "taken" and r["keys"] == "keys" for r in out.collect())
    kept = corpus_pipeline.deduplicate(spark, docs, SMALL).collect()
    assert sorted(r["doc_id"] for r in kept if (r["text"] or "").startswith(body) and r["doc_id"] is not None) == [1]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0


# --- components -----------------------------------------------------------------------------------------------------


def test_components_by_stars(spark, monkeypatch):
    """The rounds of stars, which large edge tables take, against plain label propagation."""
    from askloom.llm import _components

    monkeypatch.setattr(_components, "AT_ONCE", 5)
    rng = random.Random(21)
    pairs = [(k, k + 1) for k in range(0, 60) if k % 13] + [(200, rng.randint(201, 300)) for _ in range(40)] + [(rng.randint(400, 600), rng.randint(400, 600)) for _ in range(90)]
    rng.shuffle(pairs)
    root = {x: x for p in pairs for x in p}
    for _ in range(len(root)):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    found = _components.connected(spark.createDataFrame(pairs, "a long, b long").repartition(4)).collect()
    assert {r["id"]: r["component"] for r in found} == {k: r for k, r in root.items() if k != r} and len(found) == sum(k != r for k, r in root.items())
