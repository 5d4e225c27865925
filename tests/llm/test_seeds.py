"""Decontamination against a plain search over all shifts, the join of seeds against the index, and repeated words."""

import time

import numpy as np
import pytest

from loomgraph.llm import decontaminate as D
from loomgraph.llm.shared import word_hashes

from .conftest import prose
from .test_brute_force import LOWER, WORD

PLACES = [[i for i, c in enumerate(m) if c == "1"] for m in D.MASKS]


def _words(text):
    return WORD.findall((text or "").translate(LOWER))


def _plain(doc, item):
    """The best stretch of an item in a text, where some seed of theirs is equal; by loops over all shifts."""
    best = None
    for shift in range(-len(item) + 1, len(doc)):
        first, last = max(0, -shift), min(len(item), len(doc) - shift)
        same = [item[i] == doc[i + shift] for i in range(first, last)]
        span = max(p[-1] for p in PLACES)
        seeds = [p for p in PLACES if p[-1] < len(item)] + ([list(range(len(item)))] if len(item) <= span else [])
        if not any(all(same[i + j] for j in p) for p in seeds for i in range(len(same) - p[-1])):
            continue
        top = (0, 0, 0)
        for a in range(len(same)):
            value = 0
            for b in range(a, len(same)):
                value += 1 if same[b] else -2
                # Of equal values the stretch that ends first, then the one that starts last.
                if (value, -b, a) > (top[0], -top[2], top[1]):
                    top = (value, a, b)
        value, a, b = top
        agree = sum(same[a : b + 1])
        if value > 0 and agree >= min(D.MIN_WORDS, len(item)) and agree >= D.MIN_SHARE * (b + 1 - a):
            hit = (agree, -(first + a + shift), first + a, b + 1 - a)
            best = max(best or hit, hit)
    return best and (-best[1], best[2], best[3], best[0])


@pytest.fixture(scope="module")
def cases():
    items = {1: prose(99, 30), 2: None, 3: "", 4: "three word item", 5: prose(97, 24), 6: "a a a a a a a a a a a a", 7: prose(99, 30)}
    cut = prose(99, 30).split()
    docs = {0: None, 1: prose(7, 25) + " " + prose(99, 30) + " " + prose(8, 25), 2: " ".join(f"q{i}" if i % 9 == 4 else w for i, w in enumerate(cut)), 3: prose(3, 90), 4: "x THREE word\titem y", 5: " ".join(cut[:8]), 6: "b " + "a " * 40}
    docs |= {7: " ".join(cut[:12] + ["new", "words", "here"] + cut[15:]), 8: " ".join(cut[10:] + cut[:10]), 9: prose(97, 24) + " " + prose(99, 30), 10: " ".join(f"q{i}" if i % 3 == 1 else w for i, w in enumerate(cut)), 11: "", 12: "item three word"}
    return docs, items


@pytest.mark.parametrize("limit", [D.INDEX_CHARS, 0])
def test_all_pairs(spark, monkeypatch, cases, limit):
    """Hits, near hits and misses, with repeated rows and a null key, by index and by join."""
    from loomgraph.llm.shared import ship

    ship(spark)
    monkeypatch.setattr(D, "INDEX_CHARS", limit)
    monkeypatch.setattr(D, "JOIN_BITS", 20)
    texts, items = cases
    rows = [(k or None, t) for k, t in texts.items()] + [(1, texts[1]), (None, texts[9])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = sorted((str(k), i, *hit) for k, t in rows for i, x in items.items() if _words(x) and (hit := _plain(_words(t), _words(x))))
    got = sorted((str(r["key"]), r["item"], r["doc_start"], r["item_start"], r["n_words"], r["n_same"]) for r in D.find_contaminated(docs, bench).collect())
    assert got == want and len({w[0] for w in want}) >= 6
    left = sorted((str(r["doc_id"]), r["text"] or "") for r in D.drop_contaminated(docs, bench).collect())
    assert left == sorted((str(k), t or "") for k, t in rows if not any(_words(x) and _plain(_words(t), _words(x)) for x in items.values()))


def test_best_overlap_is_the_best_stretch_of_any_shift():
    rng = np.random.default_rng(4)
    for _ in range(200):
        words, item = rng.integers(0, 3, rng.integers(1, 40)).astype(np.uint64), rng.integers(0, 3, rng.integers(1, 20)).astype(np.uint64)
        shifts = np.unique(rng.integers(-len(item) + 1, len(words), 6))
        best = None
        for shift in shifts.tolist():
            first, last = max(0, -shift), min(len(item), len(words) - shift)
            a, b, agree = D.best_stretch(item[first:last] == words[first + shift : last + shift])
            if agree >= min(D.MIN_WORDS, len(item)) and agree >= D.MIN_SHARE * (b - a):
                hit = (agree, -(first + a + shift), first + a, b - a)
                best = max(best or hit, hit)
        assert D.best_overlap(words, item, shifts) == (best and (best[0], -best[1], best[2], best[3]))


def test_repeated_words_take_no_long_time():
    seeds = D.build_seeds([1], ["same " * 200])
    words, _ = word_hashes([b"same " * 4000])
    began = time.time()
    assert D.find_items(words, seeds) == [(0, 0, 0, 200, 200)]
    assert time.time() - began < 3
