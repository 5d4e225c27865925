"""Quality classification from trusted positives and unlabelled text: non-negative unbiased risk over features of a text's form and its words, with an estimated class prior."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import chunks, lean, word_hashes

#: Positives and unlabelled texts that the fit may fetch: its bounds.
MAX_POSITIVE = 20_000
MAX_UNLABELLED = 20_000
STEPS = 400
PRIOR_STEPS = 150
RATE = 0.3
L2 = 1e-4
#: Buckets of hashed words.
WORDS = 256
#: Share of the positives that a threshold must keep to count in the estimate of the prior, and the chance that its bound fails.
LEAST_KEPT = 0.02
DELTA = 0.1
FEATURES = ("symbols", "upper", "digits", "space", "punctuation", "word_length", "distinct_words", "repeats", "repeats_2", "long_words", "log_words", "lines")

_KIND = np.zeros(256, dtype=np.uint8)
_KIND[list(b"#$%&*+/<=>@\\^_`{|}~!")] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[[32, 9, 13]] = 4
_KIND[list(b".,;:?'\"()-")] = 5
_KIND[10] = 6


def features(texts) -> np.ndarray:
    """A row for each text: FEATURES of its form, then the square roots of the shares of its words in each of WORDS hashed buckets; zeros for an empty or null text."""
    texts = list(texts)
    out = np.zeros((len(texts), len(FEATURES) + WORDS), np.float32)
    for first, parts in chunks(texts):
        words, begins = word_hashes(parts)
        for i, b in enumerate(parts):
            if not b:
                continue
            kinds = np.bincount(_KIND[np.frombuffer(b, np.uint8)], minlength=7)
            w = words[begins[i] : begins[i + 1]]
            n, k = len(b), max(1, len(w))
            body = n - kinds[4] - kinds[6]
            same = float(np.count_nonzero(w[1:] == w[:-1])) / k
            pairs = float(np.count_nonzero(w[2:] == w[:-2])) / k
            # Against what a text of this length has at most: distinct words thin out as texts grow.
            distinct = len(np.unique(w)) / k**0.85 if len(w) else 0.0
            out[first + i, : len(FEATURES)] = (kinds[1] / n, kinds[2] / n, kinds[3] / n, kinds[4] / n, kinds[5] / n, min(body / k, 30.0) / 10, distinct, same, pairs, max(0.0, body / k - 7.0) / 10, np.log1p(k) / 10, (kinds[6] + 1) / k)
            out[first + i, len(FEATURES) :] = np.sqrt(np.bincount((w >> np.uint64(40)).astype(np.int64) % WORDS, minlength=WORDS) / k)
    return out


def expand(x: np.ndarray) -> np.ndarray:
    """The features of form with their square roots and squares, and the words."""
    form = x[:, : len(FEATURES)]
    return np.hstack((form, np.sqrt(np.maximum(form, 0)), form * form, x[:, len(FEATURES) :]))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((expand(x) - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return _sigmoid(z.astype(np.float64))


def nn_pu_risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Under logistic loss: prior * R_p(+), R_u(-) - prior * R_p(-), and the gradients of both; the risk is the first plus the positive part of the second."""
    zp, zu = p @ w, u @ w
    sp, su = _sigmoid(zp), _sigmoid(zu)
    positive = prior * float(np.logaddexp(0, -zp).mean())
    negative = float(np.logaddexp(0, zu).mean()) - prior * float(np.logaddexp(0, zp).mean())
    g_positive = prior * (p.T @ (sp - 1)) / len(p)
    g_negative = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
    return positive, negative, g_positive, g_negative


def nn_pu_fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, rate: float = RATE) -> QualityModel:
    """Weights of least non-negative risk (nn_pu_risk), by Adam over all rows.

    Where the second part of the risk falls below 0, the step goes against its gradient, as the non-negative estimator asks.
    """
    both = expand(np.vstack((positive, unlabelled)))
    mean, scale = both.mean(0), both.std(0) + 1e-6
    del both
    p, u = (np.hstack((np.clip((expand(x) - mean) / scale, -8, 8), np.ones((len(x), 1), np.float32))).astype(np.float32) for x in (positive, unlabelled))
    w = np.zeros(p.shape[1], np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        _, negative, g_pos, g_neg = nn_pu_risk(w, p, u, prior)
        g = (g_pos + g_neg if negative >= 0 else -g_neg) + L2 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = (w - rate / (1 + t / 100) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) * 0.1).astype(np.float32)
    return QualityModel(w[:-1], float(w[-1]), mean, scale, prior)


def best_bin(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled rows, from the scores of both: the least ratio of what a threshold keeps of each, where its upper bound is least.

    The purest threshold keeps positives only, so there the ratio is the prior; elsewhere it is more.
    """
    t = np.unique(positive)
    kept_p = 1 - np.searchsorted(np.sort(positive), t) / len(positive)
    kept_u = 1 - np.searchsorted(np.sort(unlabelled), t) / len(unlabelled)
    slack = np.sqrt(np.log(4 / DELTA) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    at = int(np.argmin(np.where(kept_p >= LEAST_KEPT, (kept_u + slack) / kept_p, np.inf)))
    return float(kept_u[at] / kept_p[at])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The class prior of unlabelled rows: a classifier of half of the rows scores the other half for best_bin. 0.5 if there are fewer than two rows of a kind."""
    if min(len(positive), len(unlabelled)) < 2:
        return 0.5
    g = nn_pu_fit(positive[::2], unlabelled[::2], 0.5, PRIOR_STEPS)
    return min(0.98, max(0.02, best_bin(g.score(positive[1::2]), g.score(unlabelled[1::2]))))


def _texts(rows: DataFrame, total: int, most: int) -> np.ndarray:
    """Features of about `most` of `total` rows (key, text), by a hash of the key, computed where the texts are."""
    draw = F.shiftrightunsigned(F.xxhash64("key", F.lit("quality")), 11) / F.lit(float(2**53))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], names=["x"])

    got = rows.where(draw < F.lit(most / max(1, total))).select("text").mapInArrow(run, "x binary").collect()
    # Equal rows differ by nothing, so this order is the same whatever the tasks' order; a fixed shuffle parts what sorts together.
    x = np.frombuffer(b"".join(sorted(bytes(r["x"]) for r in got)), np.float32).reshape(len(got), len(FEATURES) + WORDS)
    return x[np.random.default_rng(0).permutation(len(x))]


def fit_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> QualityModel | None:
    """A model of docs' texts; labels has (key, label) with 1 for trusted positives.

    Positives and unlabelled texts (documents at large, whatever their labels) are bounded samples by a hash of the key; the
    class prior is estimated from them, negative labels are not used. None if there is no positive or no text.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    marked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(label).alias("label"))
    good = marked.where("label = 1").count()
    n = rows.count()
    if not good or not n:
        return None
    trusted = marked.where("label = 1").select("key").distinct()
    draw = F.shiftrightunsigned(F.xxhash64("key", F.lit("quality")), 11) / F.lit(float(2**53))
    # At most about max_positive keys, by the same draw as in _texts: small enough to broadcast.
    chosen = trusted.where(draw < F.lit(max_positive / good))
    positive = _texts(rows.join(F.broadcast(chosen), "key", "left_semi"), good, max_positive)
    unlabelled = _texts(rows, n, max_unlabelled)
    if not len(positive) or not len(unlabelled):
        return None
    return nn_pu_fit(positive, unlabelled, estimate_prior(positive, unlabelled))


def score_quality(docs: DataFrame, model: QualityModel | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep` and score, the model's probability that a text is of quality; from the whole text alone.

    Null and empty texts count as texts without words and get a score as such; very long texts are read to their end. Without
    a model every score is 0.5. Equal texts get equal scores. Columns not in `keep` are ignored. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("score", T.DoubleType())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column("__text").to_pylist())
            s = shared.value.score(x) if shared.value is not None else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(s, pa.float64())], names=[*keep, "score"])

    return rows.mapInArrow(run, schema)
