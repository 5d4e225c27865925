"""I-Match fingerprints: the terms of a chosen band of inverse document frequency, hashed under several random lexicon subsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import chunks, lean, mix, run_hashes, word_hashes

#: Shares of all documents that a term of the lexicon is found in. A lexicon holds at most (distinct terms of a document
#: on average) / LEAST_SHARE terms, however many documents there are, so it is safe to broadcast.
LEAST_SHARE = 0.0005
MOST_SHARE = 0.2
#: Random subsets of the lexicon; a subset of level l holds each term with probability 2 ** -l.
SUBSETS = 48
LEVELS = 24
#: Levels in a fingerprint, from the one at which a subset holds about one of the text's terms. Texts whose numbers of terms differ up to
#: eight times still have a level in common.
KEPT = 4
#: Terms that a task counts before it passes them on, to bound its memory.
FLUSH = 2_000_000
#: Documents in a bucket of consecutive keys, and buckets at most.
BUCKET_ROWS = 5_000
MAX_BUCKETS = 20_000
_SEEDS = mix(np.arange(1, SUBSETS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = np.uint64(0x2545F4914F6CDD1D)


def term_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, n): the hash of each term and the number of documents with it, over all documents."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            terms, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n.astype(np.int64))], names=["term", "n"])

        for batch in batches:
            for _, parts in chunks(batch.column("text").to_pylist()):
                words, begins = word_hashes(parts)
                for a, b in zip(begins[:-1], begins[1:], strict=True):
                    held.append(np.unique(words[a:b]))
                    size += len(held[-1])
                if size > FLUSH:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def fit_lexicon(docs: DataFrame, text: str = "text", least: float = LEAST_SHARE, most: float = MOST_SHARE) -> np.ndarray:
    """Sorted hashes of the terms whose share of the documents lies in the band; at least two documents must have a term."""
    n = docs.count()
    band = term_counts(docs, text).where((F.col("n") >= max(2.0, least * n)) & (F.col("n") <= max(2.0, most * n)))
    got = band.select("term").toPandas()["term"].to_numpy(dtype=np.int64)
    return np.sort(got.view(np.uint64))


def _hashed(terms: np.ndarray) -> tuple[int, np.ndarray]:
    """The first level of sorted distinct terms, and for each subset of that level and of the next ones 16 bits of the hash of its terms in order; 0 for none."""
    level = min(LEVELS, max(0, round(float(np.log2(len(terms))) - 0.25)))
    mixed = mix(_SEEDS[:, None] ^ terms[None, :])
    out = np.zeros((KEPT, SUBSETS), np.uint16)
    # A subset lies within that of the level before.
    subset, at = np.nonzero(mixed >> np.uint64(64 - level) == 0) if level else tuple(x.ravel() for x in np.indices(mixed.shape))
    found = mixed[subset, at]
    for k in range(KEPT):
        if k:
            inside = found >> np.uint64(64 - level - k) == 0
            subset, found = subset[inside], found[inside]
        if not len(subset):
            break
        begin = np.flatnonzero(np.r_[True, subset[1:] != subset[:-1]])
        place = np.arange(len(subset)) - np.repeat(begin, np.diff(np.r_[begin, len(subset)]))
        # Each term's hash counts with its place, so the sum names the sorted list.
        total = np.add.reduceat(mix(found + (place.astype(np.uint64) + np.uint64(1)) * _STEP), begin)
        out[k, subset[begin]] = np.maximum(mix(total) >> np.uint64(48), 1)
    return level, out


def fingerprint_terms(words: np.ndarray, lexicon: np.ndarray) -> str:
    """The fingerprint of a text's words: of its terms in the lexicon alone, a level and 16 bits for each subset of that level and of the next three.

    A text with words but none in the lexicon has the letter e and a hash of its sorted distinct terms, which is like nothing but
    itself; a text without words has z.
    """
    terms = np.unique(words)
    if not len(terms):
        return "z"
    band = terms[:0]
    if len(lexicon):
        at = np.minimum(np.searchsorted(lexicon, terms), len(lexicon) - 1)
        band = terms[lexicon[at] == terms]
    if not len(band):
        return f"e{int(run_hashes(terms, np.array([0]), np.array([len(terms)]))[0]):016x}"
    level, short = _hashed(band)
    return f"{level:02d}" + short.astype(">u2").tobytes().hex()


def _part(f: str) -> tuple[int, np.ndarray]:
    return int(f[:2]), np.frombuffer(bytes.fromhex(f[2:]), dtype=">u2").reshape(KEPT, SUBSETS)


def likeness(a: str, b: str) -> float:
    """0 to 1: the share of subsets with equal hashes among those where either text has a term, over the levels that both have; 0 if they have none in common."""
    if a == b:
        return 1.0
    if a[0] in "ez" or b[0] in "ez":
        return 0.0
    (la, x), (lb, y) = _part(a), _part(b)
    same = either = 0
    for level in range(max(la, lb), min(la, lb) + KEPT):
        p, q = x[level - la], y[level - lb]
        there = (p > 0) | (q > 0)
        same, either = same + int(((p == q) & there).sum()), either + int(there.sum())
    return same / either if either else 0.0


def fingerprints(docs: DataFrame, lexicon: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) of every whole text; a null or empty text, or one of white space, has the fingerprint z."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [f for f in _fingerprints(batch.column("text").to_pylist(), shared.value)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.string())], names=["key", "fingerprint"])

    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, fingerprint string")


def _fingerprints(texts: list[str | None], lexicon: np.ndarray) -> Iterator[str]:
    for _, parts in chunks(texts):
        words, begins = word_hashes(parts)
        for a, b in zip(begins[:-1], begins[1:], strict=True):
            yield fingerprint_terms(words[a:b], lexicon)


def with_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (bucket, guest, key, zipped: the compressed text), in each partition sorted by bucket and descending key, such that the row after a document is the next document in descending key order (after the last the first).

    Keys are cut into buckets at approximate quantiles; each bucket's first document is a guest (guest = true) at the end of
    the bucket before. Null keys come last; equal keys are ordered by a hash of the text.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = rows.count()
    want = min(MAX_BUCKETS, -(-n // BUCKET_ROWS))
    bounds = np.zeros(0, np.int64)
    if want > 1:
        got = rows.agg(F.percentile_approx("key", [i / want for i in range(1, want)], 100_000)).first()[0]
        bounds = np.unique(np.array(got or [], dtype=np.int64))

    @F.pandas_udf("int")
    def bucket_of(k: pd.Series) -> pd.Series:
        # Bucket 0 has the largest keys, the last one the null keys too.
        place = np.searchsorted(bounds, k.fillna(0).to_numpy(dtype=np.int64), "left")
        return pd.Series(np.where(k.isna(), len(bounds), len(bounds) - place), dtype="int32")

    @F.pandas_udf("binary")
    def zip_up(t: pd.Series) -> pd.Series:
        coder = zstandard.ZstdCompressor(level=3)
        return t.map(lambda x: coder.compress(x.encode("utf-8", "surrogatepass")))

    # All texts are dealt out anew, so they travel compressed.
    ranked = rows.select("key", zip_up("text").alias("zipped"), F.xxhash64("text").alias("tie"), bucket_of("key").alias("bucket"))
    # A row for each bucket: at most MAX_BUCKETS, whatever the input.
    first = ranked.groupBy("bucket").agg(F.max(F.struct("key", "tie")).alias("top")).collect()
    order = sorted(r["bucket"] for r in first)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    heads = docs.sparkSession.createDataFrame([(r["bucket"], r["top"]["key"], r["top"]["tie"], before[r["bucket"]]) for r in first], "b int, k long, t long, before int")
    at_head = (F.col("bucket") == F.col("b")) & F.col("key").eqNullSafe(F.col("k")) & (F.col("tie") == F.col("t"))
    both = ranked.join(F.broadcast(heads), at_head, "left")
    homes = F.when(F.col("before").isNull(), F.array(F.struct(F.col("bucket"), F.lit(False).alias("guest")))).otherwise(F.array(F.struct(F.col("bucket"), F.lit(False).alias("guest")), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("guest"))))
    dealt = both.select("key", "zipped", "tie", F.explode(homes).alias("home")).select("home.bucket", "home.guest", "key", "zipped", "tie")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "guest", F.desc("key"), F.desc("tie"))


def compare_with_edits(docs: DataFrame, lexicon: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last third of the code points (rounded down) replaced by as many of the next document's first, or
    all of them. The order of documents and the cases of null keys, equal keys and one document are those of with_neighbours; null texts are
    empty. Repeated rows with one key and text follow each other. Very long texts are read whole, each by one task that holds it
    and its neighbour; an empty table gives no rows; other columns are ignored. Keys are cast to long, so keys that are no
    numbers raise an error or, without ANSI mode, become null keys.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    schema = "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        held, unzip = None, zstandard.ZstdDecompressor()  # held: the row that waits for the next one
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                piece = batch.slice(lo, 500)
                texts = [unzip.decompress(z).decode("utf-8", "surrogatepass") for z in piece.column("zipped").to_pylist()]
                prints = list(_fingerprints(texts, shared.value))
                pairs = []
                for row in zip(piece.column("bucket").to_pylist(), piece.column("guest").to_pylist(), piece.column("key").to_pylist(), texts, prints, strict=True):
                    if held is not None and held[0] == row[0] and not held[1]:
                        pairs.append((held, row))
                    held = row
                edited = []
                for (*_, t, _), (*_, after, _) in pairs:
                    k = len(t) // 3
                    edited.append(t[: len(t) - k] + after[:k])
                out = []
                for (own, nxt), e, f in zip(pairs, edited, _fingerprints(edited, shared.value), strict=True):
                    out.append((own[2], len(own[3]), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), own[4], f, likeness(own[4], f), likeness(own[4], nxt[4])))
                c = list(zip(*out, strict=True)) or [[]] * 7
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], names=["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return with_neighbours(docs, key, text).select("bucket", "guest", "key", "zipped").mapInArrow(run, schema)
