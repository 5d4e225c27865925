"""Angular filtering against all scores, its bounds, and hard rows."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import hard_negatives as H


def brute(rows, every=100):
    """(anchor, positive, rank, negative, positive score, negative score) by plain Python over (id, label, vector)."""
    steps = {i: (label, [math.floor(256 * x) for x in v]) for i, label, v in rows}
    out = []
    for a, (label, q) in steps.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(q, p, strict=False)) for i, (_, p) in steps.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if steps[i][0] == label][:5]:
            fits = [i for i in order if steps[i][0] != label and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(fits[:5])]
    return sorted(out)


def mined(spark, rows, every=100, **more):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = H.mine_hard_negatives(df.withColumns({c: F.lit("zz") for c in ("id", "steps", "norm", "home")}), anchor=F.col("id") % every == 0, **more)
    return sorted(tuple(r) for r in got.collect())


def clustered(n, seed=1, dim=8):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(6, dim))
    v = middles[rng.integers(0, 6, n)] + 0.4 * rng.normal(size=(n, dim))
    v = np.float32(v / np.linalg.norm(v, axis=1)[:, None])
    v[5], v[40:60] = v[4], v[30]  # ties and a crowd of equal vectors
    return [(i, int(rng.integers(0, 3)), v[i].tolist()) for i in range(n)]


@pytest.mark.parametrize("wave", [8192, 7])
def test_against_all_scores(spark, wave):
    rows = clustered(400)
    assert mined(spark, rows, every=10, wave_anchors=wave) == brute(rows, every=10)


def test_hard_rows(spark):
    fine = [(0, 1, [0.5, 0.5]), (1, 1, [0.5, 0.4]), (2, 2, [0.5, 0.4]), (3, 2, [0.5, 0.3]), (100, 3, [0.0, 0.0]), (101, 3, [0.0, 0.0]), (102, 1, [0.25]), (200, 4, []), (201, 4, [1e30, -1e30])]
    odd = [(None, 1, [0.5, 0.5]), (4, None, [0.5, 0.5]), (5, 2, None), (6, 2, [0.5, None]), (7, 2, [float("nan"), 0.5]), (8, 2, [float("inf"), 0.5]), fine[2]]
    got = mined(spark, fine + odd)
    limit = 1 << 17
    assert got == brute([(i, k, [max(-limit, min(limit, x)) for x in np.float32(v).astype(float).tolist()]) for i, k, v in fine])
    assert {r[3] for r in got if r[0] == 0} <= {2, 3, 100, 101, 200, 201} and any(r[:4] == (0, 1, 1, 2) for r in got)
    assert mined(spark, []) == []
    assert mined(spark, [(0, 1, [1.0]), (1, 2, [1.0])]) == []  # no positive


def test_scores_beyond_doubles(spark):
    """Products that doubles can't hold are summed as 64-bit integers."""
    rng = np.random.default_rng(5)
    v = np.float32(rng.integers(-130000, 130000, (60, 8)) + rng.integers(0, 256, (60, 8)) / 256)
    rows = [(i, i % 2, v[i].astype(float).tolist()) for i in range(60)]
    assert mined(spark, rows, every=10) == brute(rows, every=10)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 6))
def test_bounds_hold(seed, dim):
    """No score lies outside the bounds of its row or of its batch."""
    rng = np.random.default_rng(seed)
    q = np.floor(256 * rng.normal(size=(40, dim)) * rng.choice([0, 1, 3], (40, 1)))
    norm, d = np.linalg.norm(q, axis=1), rng.normal(size=(3, dim))
    angles = H._angles(q, norm, d / np.linalg.norm(d, axis=1)[:, None]).astype(np.float32).astype(float)
    scores = q @ q.T
    least, most = H.batch_bounds(angles, angles.min(axis=0), angles.max(axis=0))
    low, high = H.score_bounds(least, most, norm * norm.min(), norm * norm.max())
    assert (scores.min(axis=1) >= low).all() and (scores.max(axis=1) <= high).all()
    for i in range(40):
        low, high = H.score_bounds(*H.row_bounds(angles[i], angles), norm[i] * norm, norm[i] * norm)
        assert (scores[i] >= low).all() and (scores[i] <= high).all()


def test_only_overlapping_windows_are_scored(spark, monkeypatch):
    """On rows in clusters most are never scored."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    middles = np.linalg.qr(rng.normal(size=(8, 8)))[0]
    at = np.repeat(np.arange(8), 100)
    q = np.floor(256 * (middles[at] + 0.02 * rng.normal(size=(800, 8)))).astype(np.int64)
    norm = np.linalg.norm(q, axis=1)
    angles = H._angles(q.astype(float), norm, middles).astype(np.float32)
    table = pa.table({"id": np.arange(800), "label": at % 2, "steps": list(q.astype(np.int32)), "norm": norm, "angles": list(angles), "home": angles.argmin(axis=1).astype(np.int32)})
    anchors = H.Anchors(table.slice(0, 800).filter(pa.array(np.arange(800) % 40 == 0)), 8)
    scored = [0]
    plain = H.Batch.scores
    monkeypatch.setattr(H.Batch, "scores", lambda self, rows, *a: scored.__setitem__(0, scored[0] + len(rows)) or plain(self, rows, *a))
    found = list(H.search_positives(table.to_batches(max_chunksize=100), anchors, 8, 5))
    assert len(found) == 5 * len(anchors.ids) and scored[0] < 0.5 * 800 * len(anchors.ids)
