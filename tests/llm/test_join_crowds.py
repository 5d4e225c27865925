"""The shingle join where lists hold many groups: every link must be there, whichever order finds it."""

import random

import pytest

from loomgraph.llm import ngram_join

from .test_brute_force import components, shingles


def _check(spark, docs):
    sets = {k: shingles(t) for k, t in docs.items()}
    want = components(sets)
    got = {r["key"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.shingle_groups(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(8)).collect()}
    assert got == {k: (len(s), want[k]) for k, s in sets.items()}


@pytest.mark.parametrize("crowd", [2, 64, 10**9])
def test_passages_of_many_documents(spark, monkeypatch, crowd):
    """Documents of their own words around passages that others have too, near copies of some, and documents of passages only."""
    monkeypatch.setattr(ngram_join, "CROWD", crowd)
    rng = random.Random(crowd)
    passages = [[f"p{k}x{i}" for i in range(40)] for k in range(6)]
    docs = {}
    for k in range(120):
        own = [f"d{k}x{i}" for i in range(rng.randint(10, 60))]
        words = own[: len(own) // 2] + rng.choice(passages) + rng.choice(passages) + own[len(own) // 2 :]
        docs[k] = " ".join(words)
        if k % 3 == 0:
            for _ in range(rng.randint(1, 2)):
                words[rng.randrange(len(words))] = "edited"
            docs[1000 + k] = " ".join(words)
    for k in range(30):
        docs[2000 + k] = " ".join(w for p in rng.sample(passages, 4) for w in p)
    _check(spark, docs)


def test_whole_sf001(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    _check(spark, {r["doc_id"]: r["text"] or "" for r in rows})


def test_one_key_with_several_texts_in_a_crowd(spark, monkeypatch):
    """Rows of one key bring the same set more than once; the exact order must not count it twice."""
    monkeypatch.setattr(ngram_join, "CROWD", 2)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[2 * k : 2 * k + 40]) for k in range(8)]
    rows = [(k % 2, t) for k, t in enumerate(texts)] * 2
    got = ngram_join.shingle_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = components({i: shingles(t) for i, t in enumerate(texts)})
    assert len({want[i] for i in want}) == len({r["component_id"] for r in got})
    assert len(got) == len(rows)
