"""Manifests against trees built in plain Python, and hard rows."""

import hashlib
import zlib

import pytest

from loomgraph.llm import merkle_manifest as M

FIELDS = "doc_id source lang n_chars text".split()


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in FIELDS))


def walk(digests):
    """(root, for each digest its siblings as [(left, right)] by level)."""
    paths, at, nodes = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(nodes) > 1:
        for i, k in enumerate(at):
            first = k - k % 16
            paths[i].append(("".join(nodes[first:k]), "".join(nodes[k + 1 : first + 16])))
        at = [k // 16 for k in at]
        nodes = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], paths


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: walk([leaf(r) for r in sorted(by[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))]) for s in sources}
    root, tops = walk([trees[s][0] for s in sources])
    out = []
    for s, top in zip(sources, tops, strict=True):
        for r, path in zip(sorted(by[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))), trees[s][1], strict=True):
            now = dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"] is not None:
                now["text"] = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
            fold = leaf(now)
            for left, right in path + top:
                fold = h(left, fold, right)
            out.append((r["doc_id"], leaf(r), trees[s][0], root, h(*(x + y for x, y in path + top)), fold, fold == root))
    return sorted(out, key=repr)


def manifest(docs):
    got = M.manifest(docs, changed={"text": M.tampered_text()}).select("key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.mark.parametrize("sizes", [[1], [1, 1], [16], [17, 1, 16], [273, 2], [1] * 20 + [33]])
def test_shapes(spark, sizes):
    """Lone leaves, full and short runs, runs of one, more sources than a node has children."""
    rows = [(100 * s + i if s else 7 * i, f"s{s}" if s != 1 else None, "en" if i % 3 else None, i, f"Text {i} Ö" if i % 5 else None) for s, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    want = brute([r.asDict() for r in docs.collect()])
    assert manifest(docs) == want
    if sizes == [273, 2]:
        assert {True, False} == {r[-1] for r in want}


def test_hard_rows(hard_docs, no_docs):
    assert manifest(hard_docs) == brute([r.asDict() for r in hard_docs.collect()])
    assert manifest(no_docs) == []


def test_many_equal_rows(spark):
    rows = [(1, "a", "en", 1, "x")] * 300 + [(i, "a", "en", 1, "Y") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    got = manifest(docs)
    assert len(got) == 340 and len({r[3] for r in got}) == 1 and got == brute([r.asDict() for r in docs.collect()])


def test_no_python_workers(spark, data):
    """The plan has only Spark's own operators."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    plan = M.manifest(docs, changed={"text": M.tampered_text()})._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "BroadcastNestedLoop"))
