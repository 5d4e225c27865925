"""Operators against plain Python on the small tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash

from loomgraph.llm import decontaminate, fingerprints, html_extract, ngram_join, packing, queries, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def texts(spark, data):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}


def shingles(text):
    w = WORD.findall(text.translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(sets, percent=75):
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists, pairs = {}, {}
    for k, s in sets.items():
        for x in s:
            lists.setdefault(x, []).append(k)
    for v in lists.values():
        for i, a in enumerate(v):
            for b in v[:i]:
                pairs[a, b] = pairs.get((a, b), 0) + 1
    for (a, b), n in pairs.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {k: find(k) for k in sets}


def test_ngram_join(spark, data, texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    want = components(sets)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op4_ngram_join(spark, data).collect()}
    assert got == {k: (len(s), want[k]) for k, s in sets.items()}


def test_ngram_join_chain_of_near_copies(spark):
    """A chain whose ends don't link, a star, and many copies of one text."""
    base = [f"w{i}" for i in range(60)]
    chain = {k: " ".join(base[2 * k : 2 * k + 40]) for k in range(8)}
    star = {100 + k: " ".join(f"s{k}" if i == 7 * (k % 6) else f"v{i}" for i in range(50)) for k in range(12)}
    copies = {200 + k: "one text of a few words that is there often" for k in range(50)}
    docs = {**chain, **star, **copies}
    sets = {k: shingles(t) for k, t in docs.items()}
    want = components(sets)
    got = {r["key"]: r["component_id"] for r in ngram_join.shingle_groups(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert got == want


def test_drop_single_across_batches():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(0, 30))
        rows = sorted(zip(rng.integers(0, 8, n).tolist(), rng.integers(0, 4, n).tolist(), strict=True))
        often = {t: bool(t % 5 == 0) for t in range(8)}
        cuts = sorted(rng.integers(0, n + 1, 3).tolist())
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, n], strict=True)]
        batches = (pa.RecordBatch.from_arrays([pa.array([t for t, _ in p], pa.int64()), pa.array([m for _, m in p], pa.int64()), pa.array([10 * t + m for t, m in p], pa.int32()), pa.array([often[t] for t, _ in p], pa.bool_())], names=["token", "name", "pos", "often"]) for p in parts)
        got = [r for b in ngram_join._drop_single(batches) for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        distinct = sorted(set(rows))
        assert got == [r for r in distinct if often[r[0]] or sum(x[0] == r[0] for x in distinct) > 1]


def test_packing(spark, data, texts):
    coder = packing.Tokens(*packing.tokenizer_paths())
    rows = queries.op2_packing(spark, data).toPandas()
    by = {k: g.sort_values("start") for k, g in rows.groupby("doc_id")}
    assert by.keys() == texts.keys()
    for k, t in texts.items():
        ids = np.array([*coder.slow.encode(t, add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in by[k].itertuples():
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
        n = int(g.length.sum())
        assert n <= 2048
        padding += 0 if n & (n - 1) == 0 else 2048 - n
    assert padding == 0


def test_packing_ids(spark, texts):
    docs = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")
    pieces = packing.pack(docs).cache()
    ids = {(r["sequence_id"], r["offset"]): r["ids"] for r in packing.ids_of(docs, pieces).collect()}
    for r in pieces.collect():
        assert zlib.crc32(np.array(ids[r["sequence_id"], r["offset"]], dtype="<u4").tobytes()) == r["ids_crc32"]


def test_special_strings_and_long_space():
    coder = packing.Tokens(*packing.tokenizer_paths())
    for t in ("a <|endoftext|> b", " " * 5000 + "x", "x" * 3000, "é\n\n\n ça ’ll 12345 ", "don't we'll I'D"):
        assert coder.ids(t).tolist() == coder.slow.encode(t, add_special_tokens=False).ids


def test_pattern_counts_never_use_more_than_there_is():
    rng = np.random.default_rng(1)
    for size in (1, 3, 40, 600):
        h = {int(k): int(n) for k, n in zip(rng.choice(np.arange(1, 2048), size, False), rng.integers(1, 50, size), strict=True)}
        found = packing.patterns(h)
        used = dict.fromkeys(h, 0)
        for p, n in zip(found, packing.repeat_counts(h, found), strict=True):
            assert sum(p) == 2048 and n >= 0
            for a in p:
                used[a] += int(n)
        assert all(used[a] <= h[a] for a in h)


def test_patterns_fill_windows_without_cuts():
    h = {1024: 10, 1500: 7, 548: 7, 700: 4, 648: 4}
    slots, stream = packing.plan(h)
    assert sum(hi - lo for _, lo, hi, _, _ in slots) >= 28 and stream["length"] <= 4 * 2048


def test_fingerprints(spark, data, texts):
    fingerprints_rows = {r["doc_id"]: r for r in queries.op3_fingerprints(spark, data).collect()}
    order = sorted(texts, reverse=True)
    assert sorted(fingerprints_rows) == sorted(texts)
    for i, k in enumerate(order):
        t, after = texts[k], texts[order[(i + 1) % len(order)]]
        n = len(t) // 3
        r = fingerprints_rows[k]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest())
        assert r["near_next"] == fingerprints.likeness(r["fingerprint"], fingerprints_rows[order[(i + 1) % len(order)]]["fingerprint"])
    near = [r["near_edited"] for r in fingerprints_rows.values()]
    apart = [r["near_next"] for r in fingerprints_rows.values()]
    assert np.mean(near) > 0.3 and np.mean(apart) < 0.05


def test_fingerprint_buckets(spark, texts, monkeypatch):
    """Many small buckets give what one bucket gives."""
    docs = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")
    lexicon = fingerprints.fit_lexicon(docs)
    one = sorted(map(tuple, fingerprints.compare_with_edits(docs, lexicon).collect()))
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 7)
    assert sorted(map(tuple, fingerprints.compare_with_edits(docs, lexicon).collect())) == one


def test_sharding(spark, data, texts):
    rows = {r["doc_id"]: r for r in queries.op10_sharding(spark, data).collect()}
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def draw(k, s):  # Spark's xxhash64 chains: the hash of one value seeds the next
        h = xxhash.xxh64_intdigest(int(k).to_bytes(8, "little", signed=True), 42)
        h = xxhash.xxh64_intdigest(int(s).to_bytes(4, "little"), h)
        u = ((h >> 11) + 0.5) / 2.0**53
        return -np.log(u)

    for k, r in rows.items():
        draws = [draw(k, s) for s in range(25)]
        assert (r["shard"], r["grown_shard"]) == (int(np.argmin(draws[:24])), int(np.argmin(draws)))
        assert r["size"] == len(texts[k].encode()) + 8 and r["text_crc32"] == zlib.crc32(texts[k].encode())
    assert signed(1 << 63) == -(1 << 63)
    for s in range(24):
        slots = sorted(r["slot"] for r in rows.values() if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_weights(spark):
    n = spark.range(20000).withColumnRenamed("id", "doc_id").selectExpr("doc_id", "'t' AS text")
    got = {r["shard"]: r["count"] for r in sharding.assign_shards(n, shards=[1.0, 3.0]).groupBy("shard").count().collect()}
    assert abs(got[1] / 20000 - 0.75) < 0.02


def test_decontaminate(spark, bench):
    from .conftest import prose

    item = prose(99, 30).split()
    swapped = [f"q{i}" if i % 9 == 4 else w for i, w in enumerate(item)]
    docs = {1: prose(7, 50) + " " + " ".join(item) + " " + prose(8, 50), 2: prose(7, 50) + " " + " ".join(swapped) + " " + prose(8, 20), 3: prose(7, 200), 4: "some THREE word item here", 5: " ".join(item[:8])}
    rows = {(r["key"], r["item"]): r for r in decontaminate.find_contaminated(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), bench).collect()}
    assert set(rows) == {(1, 1), (2, 1), (4, 4)}
    assert (rows[1, 1]["doc_start"], rows[1, 1]["item_start"], rows[1, 1]["n_words"], rows[1, 1]["n_same"]) == (50, 0, 30, 30)
    assert rows[2, 1]["n_same"] == sum(a == b for a, b in zip(item, swapped, strict=True))


def test_decontaminate_finds_all_full_copies(spark, data, texts):
    items = {r["item_id"]: WORD.findall(r["text"].translate(LOWER)) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    found = {(r["doc_id"], r["item_id"]) for r in queries.op8_decontaminate(spark, data).collect()}
    for k, t in texts.items():
        words = " ".join(WORD.findall(t.translate(LOWER)))
        for i, w in items.items():
            if " " + " ".join(w) + " " in f" {words} ":
                assert (k, i) in found


def test_html(spark, data):
    import html as H

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    rows = {r["page_id"]: r for r in queries.op1_html_extract(spark, data).collect()}
    assert rows.keys() == pages.keys()
    for k, page in pages.items():
        article = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        blocks = (" ".join(H.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert rows[k]["text"] == "\n\n".join(b for b in blocks if b) and rows[k]["n_chars"] == len(rows[k]["text"])


def test_html_template(spark):
    """A notice without any mark is found by its place in the template; content that pages copy from each other is not."""
    rows = [(i, "http://h.example/a", f"<html><body><div><p>Join our list today</p></div><div><p>Story number {i} begins</p><p>and ends {i % 3}</p></div></body></html>") for i in range(20)]
    got = {r["key"]: r["text"] for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[4] == "Story number 4 begins\n\nand ends 1"
    joined = html_extract.BROADCAST_ROWS
    try:
        html_extract.BROADCAST_ROWS = -1
        again = {r["key"]: r["text"] for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    finally:
        html_extract.BROADCAST_ROWS = joined
    assert again == got


def test_furniture():
    page = """<html><head><title>T</title></head><body class="with-sidebar"><div id="header">Menu</div><div class="site-nav"><a>x</a></div>
    <div class="content"><p>One &amp; two<br>three</p><p class="notice">Notice!</p><p>Four&nbsp;five</p><form>f<input></form><div class="comments"><p>c</p></div>
    <script>var a='</p>';</script><ul><li>a<li>b</ul></div><aside>s</aside><footer>f</footer>"""
    assert html_extract.main_text(page) == "One & two three\n\nFour five\n\na\n\nb"
    assert html_extract.main_text("<main><h1>T</h1><aside>side</aside><p>A<p>B</main><div>after</div>") == "T\n\nA\n\nB"
