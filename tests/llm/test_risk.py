"""The risk, its gradient, the prior and the features against plain Python."""

import math

import numpy as np

from loomgraph.llm import quality as Q


def _plain_risk(w, p, u, prior):
    loss = lambda z: math.log1p(math.exp(-z))
    dot = lambda x: sum(a * b for a, b in zip(x, w, strict=True))
    mean = lambda v: sum(v) / len(v)
    return prior * mean([loss(dot(x)) for x in p]), mean([loss(-dot(x)) for x in u]) - prior * mean([loss(-dot(x)) for x in p])


def test_risk_and_gradient():
    rng = np.random.default_rng(5)
    for prior in (0.2, 0.9):
        p, u, w = rng.normal(1, 1, (13, 4)), rng.normal(0, 1, (17, 4)), rng.normal(0, 1, 4)
        pos, neg, g_pos, g_neg = Q.nn_pu_risk(w, p, u, prior)
        assert np.allclose((pos, neg), _plain_risk(w, p.tolist(), u.tolist(), prior))
        for j in range(4):
            step = np.zeros(4)
            step[j] = 1e-6
            up, down = _plain_risk(w + step, p.tolist(), u.tolist(), prior), _plain_risk(w - step, p.tolist(), u.tolist(), prior)
            assert np.allclose((g_pos[j], g_neg[j]), [(a - b) / 2e-6 for a, b in zip(up, down, strict=True)], atol=1e-5)


def test_prior_is_found():
    rng = np.random.default_rng(6)
    n = 3000
    for prior in (0.3, 0.7):
        draw = lambda k, good: np.where(good, rng.normal(3, 1, k), rng.normal(-3, 1, k))
        p, u = draw(n, np.ones(n, bool)), draw(n, rng.random(n) < prior)
        assert abs(Q.best_bin(p, u) - prior) < 0.06


def test_fit_minimises_the_risk():
    """The fitted weights have no more risk than others near them, but for what the penalty on weights costs, and far less than none."""
    rng = np.random.default_rng(7)
    make = lambda k, good: np.hstack((np.clip(rng.normal(np.where(good, 0.6, 0.3)[:, None], 0.1, (k, len(Q.FEATURES))), 0, 1), np.zeros((k, Q.WORDS)))).astype(np.float32)
    p, good = make(200, np.ones(200, bool)), rng.random(400) < 0.5
    u = make(400, good)
    model = Q.nn_pu_fit(p, u, 0.5)
    assert ((model.score(u) >= 0.5) == good).mean() > 0.95
    rows = lambda x: np.hstack((np.clip((Q.expand(x) - model.mean) / model.scale, -8, 8), np.ones((len(x), 1))))
    risk = lambda w: (lambda a: a[0] + max(0.0, a[1]))(Q.nn_pu_risk(w, rows(p), rows(u), 0.5))
    w = np.append(model.weights, model.bias)
    assert risk(w) < 0.05 * risk(np.zeros_like(w)) and risk(w) < 0.01 + min(risk(w + rng.normal(0, 0.3, len(w))) for _ in range(20))


def test_features_of_words():
    x = Q.features(["a b a", None, "", "a a a a"])
    assert x.shape == (4, len(Q.FEATURES) + Q.WORDS) and not x[1].any() and not x[2].any()
    assert sorted(np.round(x[0, len(Q.FEATURES) :][x[0, len(Q.FEATURES) :] > 0] ** 2, 4)) == [0.3333, 0.6667]
    assert np.allclose(x[3, len(Q.FEATURES) :].max(), 1)


def test_negative_labels_and_repeats_change_nothing(spark):
    from loomgraph.llm.shared import ship

    ship(spark)
    docs = spark.createDataFrame([(k, f"good text number {k} with words" if k % 2 else "!!! $$$ 123") for k in range(40)], "doc_id long, text string")
    good, bad = [(k, 1) for k in range(1, 30, 2)], [(k, 0) for k in range(0, 30, 2)]
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    a, b = Q.fit_quality(docs, labels(good)), Q.fit_quality(docs, labels(good + bad))
    assert a.prior == b.prior and (a.weights == b.weights).all()
    twice = Q.score_quality(docs.union(docs), a).groupBy("doc_id").agg({"score": "count"}).collect()
    assert all(r[1] == 2 for r in twice)
    scores = {r["doc_id"]: r["score"] for r in Q.score_quality(docs, a).collect()}
    assert scores[31] > scores[32]
