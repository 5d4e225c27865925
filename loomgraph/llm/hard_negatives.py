"""Hard negatives by angular triangle filtering.

Each row stores its angles to a few reference directions. For two vectors the difference and the sum of their angles to one
direction bound the angle between them, so all directions together give an interval of its cosine; multiplied by both norms
and widened for rounding it bounds the score. Rows whose interval meets an anchor's window of wanted scores are scored in
integers, no other. The rows lie in the order of their nearest direction and of the angle to it, so whole batches fall away
by the extremes of their angles.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import lean, ship, written

#: Components count in steps of 1/256.
SCALE = 256
#: A component's steps end at plus and minus this, so that scores of up to 8192 components fit in 64 bits.
LARGEST = 1 << 25
#: Reference directions, and the rows (those of the least hashes) that they are fitted to at most.
DIRECTIONS, SAMPLE_ROWS = 16, 4096
#: Anchors that a task handles at once: these are broadcast, larger sets go in several waves.
WAVE_ANCHORS = 8192
#: Radians by which a stored angle may be off: it is kept in 32 bits.
ANGLE_SLACK = 2e-6
#: Positives of an anchor, and negatives of each positive.
POSITIVES = NEGATIVES = 5
#: A negative's score is from 80 to 100 hundredths of its positive's.
LEAST_SHARE, MOST_SHARE = 80, 100
#: Products of norms under which sums of doubles are exact.
_EXACT = float(1 << 52)
_NONE = -(1 << 62)


def quantised(embeddings: DataFrame, key: str, vector: str, label: Column) -> DataFrame:
    """id, label and steps (floor of 256 x) of the rows that take part, one for each id."""
    x = F.col(vector)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    step = lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int")
    rows = embeddings.select(F.col(key).cast("long").alias("id"), label.alias("label"), F.when(fine, F.transform(x, step)).alias("steps"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND steps IS NOT NULL")
    return rows.groupBy("id").agg(F.min(F.struct("label", "steps")).alias("r")).select("id", "r.label", "r.steps")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The lists of a column as rows of dim 64-bit integers, short ones filled up with 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dim), np.int64)
    out[np.arange(dim) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _angles(q: np.ndarray, norm: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Of each row to each direction; a right angle for vectors of zeros, whose scores are 0 at any angle."""
    return np.arccos(np.clip((q @ directions.T) / np.maximum(norm, 1e-300)[:, None], -1, 1))


def fit_directions(rows: DataFrame, dim: int, count: int = DIRECTIONS, sample: int = SAMPLE_ROWS) -> np.ndarray:
    """Unit vectors in the middle of groups of similar rows: spherical k-means over at most `sample` rows, those whose ids have the least hashes.

    They only decide how much the filter saves, never what it finds.
    """
    taken = rows.select("id", "steps").orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    q = _matrix(taken["steps"], dim).astype(float)
    norm = np.linalg.norm(q, axis=1)
    unit = np.unique(q[norm > 0] / norm[norm > 0, None], axis=0)
    if not len(unit):
        return np.eye(max(dim, 1))[:1]
    # Each next start is the row that is farthest from the ones before.
    at = [0]
    nearest = unit @ unit[0]
    while len(at) < min(count, len(unit)):
        at.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, unit @ unit[at[-1]])
    directions = unit[at]
    for _ in range(8):
        home = np.argmax(unit @ directions.T, axis=1)
        for j in range(len(directions)):
            middle = unit[home == j].sum(axis=0)
            if np.linalg.norm(middle) > 1e-9:
                directions[j] = middle / np.linalg.norm(middle)
    return directions


def with_angles(rows: DataFrame, directions: np.ndarray, dim: int) -> DataFrame:
    """rows with their norm, their angles to all directions (32-bit floats) and the nearest direction with its angle."""
    held = rows.sparkSession.sparkContext.broadcast(directions)

    @lean
    def measure(batches):
        for b in batches:
            q = _matrix(b.column("steps"), dim)
            norm = np.linalg.norm(q.astype(float), axis=1)
            angles = _angles(q, norm, held.value).astype(np.float32)
            home = angles.argmin(axis=1) if len(q) else np.zeros(0, np.int64)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * angles.shape[1]), pa.array(angles.ravel()))
            columns = {"norm": norm, "angles": listed, "home": home.astype(np.int32), "near": angles[np.arange(len(q)), home]}
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(v) if isinstance(v, np.ndarray) else v for v in columns.values())], names=[*b.schema.names, *columns])

    kind = dict(rows.dtypes)["label"]
    return rows.select("id", "label", "steps").mapInArrow(measure, f"id long, label {kind}, steps array<int>, norm double, angles array<float>, home int, near float")


# ---------------------------------------------------------------- in a task


class Anchors:
    """Arrays of one wave: ids, labels, steps, norms, angles, and each one's windows (positive's id and score)."""

    def __init__(self, table: pa.Table, dim: int):
        self.ids, self.labels = table["id"].to_numpy(), np.array(table["label"].to_pylist(), dtype=object)
        self.q = _matrix(table["steps"], dim)
        self.norm = table["norm"].to_numpy()
        self.angles = np.array(table["angles"].to_pylist(), dtype=float).reshape(len(self.ids), -1)
        self.wanted = table["wanted"].to_pylist() if "wanted" in table.column_names else None


def batch_bounds(anchor_angles: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest angle that each anchor can have with any row whose angles lie from `low` to `high`."""
    least = np.maximum(anchor_angles - high, low - anchor_angles).max(axis=1) - ANGLE_SLACK
    most = np.where(anchor_angles + high <= math.pi, anchor_angles + high, np.where(anchor_angles + low >= math.pi, 2 * math.pi - anchor_angles - low, math.pi)).min(axis=1) + ANGLE_SLACK
    return np.clip(least, 0, math.pi), np.clip(most, 0, math.pi)


def row_bounds(anchor_angles: np.ndarray, angles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for one anchor and each row."""
    total = angles + anchor_angles
    least = np.abs(angles - anchor_angles).max(axis=1) - ANGLE_SLACK
    most = np.minimum(total, 2 * math.pi - total).min(axis=1) + ANGLE_SLACK
    return np.clip(least, 0, math.pi), np.clip(most, 0, math.pi)


def score_bounds(least: np.ndarray, most: np.ndarray, small, large) -> tuple[np.ndarray, np.ndarray]:
    """The lowest and highest score for angles from `least` to `most` and products of norms from `small` to `large`, widened beyond any rounding."""
    up, down = np.cos(least), np.cos(most)
    slack = 1 + 1e-9 * np.asarray(large)
    return down * np.where(down < 0, large, small) - slack, up * np.where(up > 0, large, small) + slack


class Batch:
    """Rows of one Arrow batch in the order of the angle to the direction that most of them are nearest to."""

    def __init__(self, b: pa.RecordBatch, dim: int):
        angles = b.column("angles")
        self.angles = angles.flatten().to_numpy().reshape(b.num_rows, -1).astype(float)
        self.home = int(np.bincount(b.column("home").to_numpy()).argmax())
        order = np.argsort(self.angles[:, self.home], kind="stable")
        self.angles = self.angles[order]
        self.ids, self.norm = b.column("id").to_numpy()[order], b.column("norm").to_numpy()[order]
        self.labels = np.array(b.column("label").to_pylist(), dtype=object)[order]
        self.q = _matrix(b.column("steps"), dim)[order]
        self.near, self.floats = self.angles[:, self.home], self.q.astype(float)

    def window(self, anchor_angle: float, norm: float, floor: float, top: float) -> slice:
        """The run of rows whose angle to the home direction leaves room for a score from floor to top."""
        small, large = norm * self.norm.min(), norm * self.norm.max()
        slack = 1 + 1e-9 * large
        first, last = 0, len(self.ids)
        if floor > slack and large > 0:  # the angle to the anchor is at most this
            reach = math.acos(min(1.0, max(-1.0, (floor - slack) / large))) + 2 * ANGLE_SLACK
            first = np.searchsorted(self.near, anchor_angle - reach, side="left")
            last = np.searchsorted(self.near, anchor_angle + reach, side="right")
        if 0 <= top < math.inf and small > 0 and (top + slack) / small < 1:  # and at least this: alpha + beta can't be less
            reach = math.acos((top + slack) / small) - 2 * ANGLE_SLACK
            first = max(first, np.searchsorted(self.near, reach - anchor_angle, side="left"))
        return slice(int(first), int(last))

    def scores(self, rows: np.ndarray, q: np.ndarray, norm: float) -> np.ndarray:
        if norm * self.norm[rows].max(initial=0) < _EXACT:
            return (self.floats[rows] @ q.astype(float)).astype(np.int64)
        return self.q[rows] @ q


def best(scores: np.ndarray, ids: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.lexsort((ids, -scores))[:count]
    return scores[at], ids[at]


def in_window(batch: Batch, anchors: Anchors, i: int, floor: float, top: float) -> np.ndarray:
    """Positions of the rows of a batch whose score bounds for anchor i meet the scores from floor to top."""
    run = batch.window(anchors.angles[i, batch.home], anchors.norm[i], floor, top)
    low, high = score_bounds(*row_bounds(anchors.angles[i], batch.angles[run]), *(2 * [anchors.norm[i] * batch.norm[run]]))
    return run.start + np.flatnonzero((high >= floor) & (low <= top))


def _batches(batches, dim: int, anchors: Anchors):
    """Each batch with the bounds of scores that its rows can have with each anchor."""
    for b in batches:
        if b.num_rows:
            rows = Batch(b, dim)
            least, most = batch_bounds(anchors.angles, rows.angles.min(axis=0), rows.angles.max(axis=0))
            yield rows, *score_bounds(least, most, anchors.norm * rows.norm.min(), anchors.norm * rows.norm.max())


def search_positives(batches, anchors: Anchors, dim: int, count: int):
    """(anchor's id, row's id, score) of the best `count` rows of equal label among all batches, for each anchor."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(anchors.ids)
    floor = np.full(len(anchors.ids), -math.inf)
    for rows, _, high in _batches(batches, dim, anchors):
        for i in np.flatnonzero(high >= floor):
            at = in_window(rows, anchors, i, floor[i], math.inf)
            at = at[(rows.labels[at] == anchors.labels[i]) & (rows.ids[at] != anchors.ids[i])]
            if len(at):
                s, ids = rows.scores(at, anchors.q[i], anchors.norm[i]), rows.ids[at]
                found[i] = best(np.concatenate((found[i][0], s)), np.concatenate((found[i][1], ids)), count)
                floor[i] = found[i][0][-1] if len(found[i][0]) == count else -math.inf
    for i, (s, ids) in enumerate(found):
        for x, y in zip(s.tolist(), ids.tolist(), strict=True):
            yield int(anchors.ids[i]), y, x


def search_negatives(batches, anchors: Anchors, dim: int, count: int, least: int, most: int):
    """(anchor's id, positive's id, its score, row's id, score) of the best `count` rows of another label in each positive's window."""
    slots = [[(w["id"], w["score"], -((-least * w["score"]) // 100), most * w["score"] // 100) for w in wanted] for wanted in anchors.wanted]
    found = [[(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in s] for s in slots]
    # What a row must still reach for some positive of the anchor, and the most that any window takes.
    floors = [[s[2] for s in of] for of in slots]
    lowest = np.array([min((f for f, s in zip(fs, of, strict=True) if s[2] <= s[3]), default=math.inf) for fs, of in zip(floors, slots, strict=True)], dtype=float)
    top = np.array([max((s[3] for s in of if s[2] <= s[3]), default=-math.inf) for of in slots], dtype=float)
    for rows, low, high in _batches(batches, dim, anchors):
        for i in np.flatnonzero((high >= lowest) & (low <= top)):
            at = in_window(rows, anchors, i, lowest[i], top[i])
            at = at[rows.labels[at] != anchors.labels[i]]
            if not len(at):
                continue
            s, ids = rows.scores(at, anchors.q[i], anchors.norm[i]), rows.ids[at]
            for k, (_, _, _, most_score) in enumerate(slots[i]):
                fits = (s >= floors[i][k]) & (s <= most_score)
                if fits.any():
                    got = found[i][k]
                    found[i][k] = best(np.concatenate((got[0], s[fits])), np.concatenate((got[1], ids[fits])), count)
                    if len(found[i][k][0]) == count:
                        floors[i][k] = int(found[i][k][0][-1])
            lowest[i] = min(f for f, w in zip(floors[i], slots[i], strict=True) if w[2] <= w[3])
    for i, of in enumerate(found):
        for (positive, score, _, _), (s, ids) in zip(slots[i], of, strict=True):
            for x, y in zip(s.tolist(), ids.tolist(), strict=True):
                yield int(anchors.ids[i]), positive, score, y, x


# ---------------------------------------------------------------- over all rows


def _rows(found, width: int, columns: list[str]):
    found = list(found)
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(width)], names=columns)


def _by_waves(index: DataFrame, anchors: DataFrame, dim: int, columns: list[str], search, what: str, wave_anchors: int) -> DataFrame:
    """What `search` finds in each task's batches for one wave of anchors after the other; at most about `wave_anchors` are broadcast at once."""
    spark = index.sparkSession
    schema = ", ".join(f"{c} long" for c in columns)
    waves = math.ceil(anchors.count() / wave_anchors)
    parts = [] if waves else [spark.createDataFrame([], schema)]
    for wave in range(waves):
        held = spark.sparkContext.broadcast(Anchors(anchors.where(F.pmod(F.xxhash64("id"), F.lit(waves)) == wave).toArrow(), dim))

        @lean
        def run(batches, held=held):
            yield _rows(search(batches, held.value), len(columns), columns)

        found = index.mapInArrow(run, schema)
        parts.append(written(found, f"{what}-{wave}") if waves > 1 else found)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def mine_hard_negatives(
    embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", label: Column | None = None, anchor: Column | None = None, positives: int = POSITIVES,
    negatives: int = NEGATIVES, least_share: int = LEAST_SHARE, most_share: int = MOST_SHARE, directions: int = DIRECTIONS, wave_anchors: int = WAVE_ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its best positives, the best rows of other labels with a score in the positive's window.

    `label` is a column of embeddings (by default "label"), `anchor` a condition on `id` (by default: divisible by 100).
    Rows with a null key, label or vector, or a component that is null or not finite, take no part; of several rows with one key the least by
    (label, steps) does. Components beyond 2^17 count as that. Vectors of unlike length are filled up with zeros; an empty or
    zero vector scores 0 with all. Ties go to the smaller id. Anchors without a positive, or positives without a negative, give no row; a
    positive of negative score has an empty window. Other columns are ignored, an empty table gives no rows.
    """
    ship(embeddings.sparkSession)
    rows = written(quantised(embeddings, key, vector, F.col("label") if label is None else label), "vectors")
    dim = rows.agg(F.max(F.size("steps"))).first()[0] or 1
    fitted = fit_directions(rows, dim, directions)
    index = written(with_angles(rows, fitted, dim).repartitionByRange("home", "near", "id").sortWithinPartitions("home", "near", "id"), "angles")
    anchors = index.where(F.col("id") % 100 == 0 if anchor is None else anchor).drop("home", "near")

    def first(found: DataFrame, by: list[str], item: str, score: str, count: int) -> DataFrame:
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), item)))
        return ranked.where(F.col("rank") <= count)

    near = _by_waves(index, anchors, dim, ["anchor_id", "positive_id", "positive_score"], lambda b, a: search_positives(b, a, dim, positives), "positives", wave_anchors)
    chosen = first(near, ["anchor_id"], "positive_id", "positive_score", positives)
    wanted = chosen.groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))).alias("wanted"))
    wanted = written(anchors.join(wanted, anchors["id"] == wanted["anchor_id"]).drop("anchor_id"), "wanted")
    columns = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
    far = _by_waves(index, wanted, dim, columns, lambda b, a: search_negatives(b, a, dim, negatives, least_share, most_share), "negatives", wave_anchors)
    out = first(far, ["anchor_id", "positive_id"], "negative_id", "negative_score", negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH rows AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM rows a JOIN rows b ON a.id <> b.id WHERE a.id % 100 = 0),
pos AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id)::INT AS rank,
       n.id AS negative_id, p.positive_score, n.score AS negative_score
FROM pos p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * positive_score <= 100 * n.score AND n.score <= positive_score
QUALIFY rank <= 5
"""
