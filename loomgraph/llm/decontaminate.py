"""Benchmark decontamination with spaced seeds: hashes that ignore chosen word positions, and a check of the words around each hit."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import chunks, lean, mix, word_hashes, written

#: Positions of a window that count (1) and that may differ (0).
MASKS = ("1110101", "11001011", "101101001", "11111")
#: Words that agree in the best stretch, and their share of it, from which on a document counts as contaminated; an item
#: with fewer words must be there whole.
MIN_WORDS = 10
MIN_SHARE = 0.7
#: Code points of items that may be sent to all executors as an index; the seeds of a larger benchmark are joined.
INDEX_CHARS = 32_000_000
#: Bits of a seed hash that the index's filter knows, and those of the filter that goes before the join (2 ** 28 bits are 32 MB).
_BITS = 22
JOIN_BITS = 28
#: Hits, and compared words, that are held at a time.
HELD = 4_000_000


@dataclass
class Seeds:
    """Items as word hashes, and their seeds for each mask, sorted."""

    ids: list
    words: np.ndarray
    begins: np.ndarray
    masks: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    maybe: np.ndarray


def seed_hashes(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The hash of the words at `places` of every window; one entry for each window start."""
    n = len(words) - int(places[-1])
    if n <= 0:
        return np.zeros(0, np.uint64)
    s = np.full(n, len(places) * 1000 + int(places[-1]), dtype=np.uint64)
    for p in places:
        s = s * np.uint64(0x2545F4914F6CDD1D) + words[p : p + n]
    return mix(s)


def _places(lengths) -> list[tuple[np.ndarray, int | None]]:
    """The positions that each mask keeps, with None; and for items too short for a mask, all their positions, with their length."""
    places = [np.flatnonzero(np.array(list(m)) == "1") for m in MASKS]
    span = max(int(p[-1]) + 1 for p in places)
    return [(p, None) for p in places] + [(np.arange(n), n) for n in sorted({int(n) for n in lengths if 0 < n < span})]


def build_seeds(ids: list, texts: list[str | None]) -> Seeds:
    """Items without words are left out. An item too short for a mask gets a seed of all its words."""
    words, begins = word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in texts])
    masks, maybe = [], np.zeros(1 << _BITS, dtype=bool)
    for p, only in _places(np.diff(begins)):
        found, item, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(len(ids)):
            w = words[begins[i] : begins[i + 1]]
            if only is not None and len(w) != only:
                continue
            s = seed_hashes(w, p)
            found.append(s)
            item.append(np.full(len(s), i))
            at.append(np.arange(len(s)))
        s = np.concatenate(found)
        if len(s):
            o = np.argsort(s, kind="stable")
            masks.append((p, s[o], np.concatenate(item)[o], np.concatenate(at)[o]))
            maybe[s >> np.uint64(64 - _BITS)] = True
    return Seeds(list(ids), words, begins, masks, maybe)


def best_stretch(same: np.ndarray) -> tuple[int, int, int]:
    """(start, end, agreeing words) of the stretch of most agreeing words less twice the others, that is, of over two thirds agreeing."""
    total = np.concatenate(([0], np.cumsum(np.where(same, 1, -2))))
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.flatnonzero(total[: end + 1] == low[end])[-1])
    return start, end, int(same[start:end].sum())


def best_overlap(words: np.ndarray, item: np.ndarray, shifts: np.ndarray) -> tuple[int, int, int, int] | None:
    """(agreeing words, start in text, start in item, words) of the best stretch over all shifts of an item against a text, where one is long enough.

    Of stretches with as many agreeing words the one that starts first in the text, then last in the item, then the longest.
    """
    n, best = len(item), None
    step = max(1, HELD // max(1, n))
    for lo in range(0, len(shifts), step):
        part = shifts[lo : lo + step]
        at = part[:, None] + np.arange(n)
        inside = (at >= 0) & (at < len(words))
        same = (words[np.clip(at, 0, len(words) - 1)] == item) & inside
        # Outside the text nothing can belong to a stretch.
        total = np.zeros((len(part), n + 1), np.int64)
        np.cumsum(np.where(same, 1, np.where(inside, -2, -3 * n)), axis=1, out=total[:, 1:])
        low = np.minimum.accumulate(total, axis=1)
        end = np.argmax(total - low, axis=1)
        rows = np.arange(len(part))
        start = n - np.argmax((total == low[rows, end][:, None])[:, ::-1] & (np.arange(n, -1, -1) <= end[:, None]), axis=1)
        agreed = np.zeros((len(part), n + 1), np.int64)
        np.cumsum(same, axis=1, out=agreed[:, 1:])
        agree = agreed[rows, end] - agreed[rows, start]
        for r in np.flatnonzero((agree >= min(MIN_WORDS, n)) & (agree >= MIN_SHARE * (end - start))):
            hit = (int(agree[r]), -int(start[r] + part[r]), int(start[r]), int(end[r] - start[r]))
            best = max(best or hit, hit)
    return best and (best[0], -best[1], best[2], best[3])


def find_items(words: np.ndarray, seeds: Seeds) -> list[tuple[int, int, int, int, int]]:
    """(item index, start in text, start in item, words, agreeing words) of the best stretch of each item in a text's words, where it is long enough."""
    tried = np.zeros(0, np.int64)  # item and shift in one number
    for places, s, item, at in seeds.masks:
        own = seed_hashes(words, places)
        spots = np.flatnonzero(seeds.maybe[own >> np.uint64(64 - _BITS)])
        lo, hits = np.searchsorted(s, own[spots], "left"), np.searchsorted(s, own[spots], "right")
        hits -= lo
        spots, lo, hits = spots[hits > 0], lo[hits > 0], hits[hits > 0]
        # Texts and items of one repeated word hit each other everywhere, so hits are taken in portions.
        cuts = np.searchsorted(np.cumsum(hits), np.arange(HELD, hits.sum() + HELD, HELD), "left") + 1 if len(hits) else []
        a = 0
        for b in cuts:
            k = hits[a:b]
            j = np.arange(k.sum()) + np.repeat(lo[a:b] - np.concatenate(([0], np.cumsum(k)[:-1])), k) if len(k) else np.zeros(0, np.int64)
            tried = np.union1d(tried, (item[j] << 32) + (np.repeat(spots[a:b], k) - at[j] + (1 << 31)))
            a = b
    out = []
    for i in np.unique(tried >> 32):
        own = (tried[tried >> 32 == i] & 0xFFFFFFFF) - (1 << 31)
        best = best_overlap(words, seeds.words[seeds.begins[i] : seeds.begins[i + 1]], own)
        if best:
            agree, start, own_start, n = best
            out.append((int(i), start, own_start, n, agree))
    return out


def _size(benchmark: DataFrame, text: str) -> int:
    return benchmark.agg(F.coalesce(F.sum(F.length(text)), F.lit(0))).first()[0]


def _index(benchmark: DataFrame, item: str, text: str) -> Seeds:
    own = benchmark.where(F.col(text).isNotNull()).select(F.col(item).alias("id"), F.col(text).alias("text")).collect()
    own.sort(key=lambda r: (r["id"] is None, r["id"] if r["id"] is not None else 0, r["text"]))
    return build_seeds([r["id"] for r in own], [r["text"] for r in own])


def _scan(texts, seeds: Seeds) -> Iterator[tuple[int, list]]:
    for first, parts in chunks(texts):
        words, begins = word_hashes(parts)
        for i in range(len(parts)):
            if begins[i + 1] > begins[i]:
                hits = find_items(words[begins[i] : begins[i + 1]], seeds)
                if hits:
                    yield first + i, hits


def _named(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with 128 bits that name the text."""
    return df.withColumns({f"{name}a": F.xxhash64(text), f"{name}b": F.xxhash64(F.lit(name), text)})


def _joined(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(da, db, ia, ib, doc_start, item_start, n_words, n_same) for the named texts (text, da, db) and items (text, ia, ib) that overlap, by a join of seeds.

    Seeds of the texts that a filter of all items' seeds doesn't know are never shuffled.
    """
    lengths = [r[0] for r in items.select(F.size(F.array_remove(F.split(F.translate("text", "\t\n\x0b\x0c\r", "     "), " +"), "")).alias("n")).where(F.col("n") < 20).distinct().collect()]
    places = _places(lengths)

    def seeds_of(names: list[str], bitmap=None):
        @lean
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, parts in chunks(batch.column("text").to_pylist()):
                    words, begins = word_hashes(parts)
                    row, seed, pos = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                    for i in range(len(parts)):
                        w = words[begins[i] : begins[i + 1]]
                        for p, only in places:
                            if bitmap is None and only is not None and len(w) != only:
                                continue
                            s = seed_hashes(w, p)
                            at = np.arange(len(s))
                            if bitmap is not None:
                                h = (s >> np.uint64(64 - JOIN_BITS)).astype(np.int64)
                                at = np.flatnonzero(bitmap.value[h >> 6] >> (h & 63) & 1)
                            row.append(np.full(len(at), first + i))
                            seed.append(s[at])
                            pos.append(at)
                    at = pa.array(np.concatenate(row))
                    yield pa.RecordBatch.from_arrays([*(batch.column(n).take(at) for n in names), pa.array(np.concatenate(seed).view(np.int64)), pa.array(np.concatenate(pos).astype(np.int64))], names=[*names, "seed", "pos"])

        return run

    own = written(items.mapInArrow(seeds_of(["ia", "ib"]), "ia long, ib long, seed long, pos long"), "item-seeds")
    bit = F.shiftrightunsigned("seed", 64 - JOIN_BITS)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int"))
    word = own.groupBy(F.shiftrightunsigned(bit, 6).alias("at")).agg(F.bit_or(one).alias("bits")).toPandas()
    bitmap = np.zeros(1 << (JOIN_BITS - 6), np.int64)
    bitmap[word["at"].to_numpy(np.int64)] = word["bits"].to_numpy(np.int64)
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)
    theirs = texts.mapInArrow(seeds_of(["da", "db"], shared), "da long, db long, seed long, pos long")
    met = theirs.join(own.withColumnRenamed("pos", "own"), "seed").select("da", "db", "ia", "ib", (F.col("pos") - F.col("own")).alias("shift"))
    shifts = written(met.groupBy("da", "db", "ia", "ib").agg(F.collect_set("shift").alias("shifts")), "shifts")
    own_texts = texts.join(shifts.select("da", "db").distinct(), ["da", "db"], "left_semi").dropDuplicates(["da", "db"]).select("da", "db", F.col("text").alias("words"))
    item_texts = items.dropDuplicates(["ia", "ib"]).select("ia", "ib", F.col("text").alias("own"))
    both = shifts.join(own_texts, ["da", "db"]).join(item_texts, ["ia", "ib"]).select("da", "db", "ia", "ib", "shifts", "words", "own")

    @lean
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["da", "db", "ia", "ib"]
        for batch in batches:
            rows, got = [], []
            for i in range(batch.num_rows):
                words, begins = word_hashes([batch.column(c)[i].as_py().encode("utf-8", "surrogatepass") for c in ("words", "own")])
                best = best_overlap(words[: begins[1]], words[begins[1] :], np.sort(batch.column("shifts")[i].values.to_numpy(zero_copy_only=False)))
                if best:
                    rows.append(i)
                    got.append((best[1], best[2], best[3], best[0]))
            cols = list(zip(*got, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows, pa.int64())) for c in names), *(pa.array(c, pa.int64()) for c in cols)], names=[*names, "doc_start", "item_start", "n_words", "n_same"])

    return both.mapInArrow(verify, "da long, db long, ia long, ib long, doc_start long, item_start long, n_words long, n_same long")


def _overlaps(docs: DataFrame, benchmark: DataFrame, text: str, item_text: str) -> DataFrame:
    texts = _named(docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text")), "text", "d")
    return _joined(texts, _named(benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_text).alias("text")), "text", "i"))


def find_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row (key, item, doc_start, item_start, n_words, n_same) for each document and benchmark item that share a long enough stretch.

    Starts and lengths count words; the stretch is the item's best in that document, the earliest of equals. Null and empty
    texts and items share nothing; very long texts are read to their end. A document or item that is there twice is reported
    as often. An empty table or benchmark gives no rows. Other columns are ignored, whatever their names. A benchmark of up to
    INDEX_CHARS is sent to all executors as an index; of a larger one, seeds meet by a join, with equal results.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kinds = dict(rows.dtypes)["key"], dict(benchmark.dtypes)[item]
    if _size(benchmark, item_text) > INDEX_CHARS:
        found = written(_overlaps(docs, benchmark, text, item_text), "overlaps")
        named = _named(rows, "text", "d").select("key", "da", "db")
        items = _named(benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("text")), "text", "i").select("item", "ia", "ib")
        return named.join(found, ["da", "db"]).join(items, ["ia", "ib"]).select("key", "item", "doc_start", "item_start", "n_words", "n_same")
    schema = f"key {kinds[0]}, item {kinds[1]}, doc_start long, item_start long, n_words long, n_same long"
    shared = docs.sparkSession.sparkContext.broadcast(_index(benchmark, item, item_text))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared.value.ids
        kind = pa.array([x for x in ids if x is not None][:1] or [0]).type
        for batch in batches:
            got = [(i, ids[h[0]], *h[1:]) for i, hits in _scan(batch.column("text").to_pylist(), shared.value) for h in hits]
            cols = list(zip(*got, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(cols[0], pa.int64())), pa.array(cols[1], kind), *(pa.array(c, pa.int64()) for c in cols[2:])], names=["key", "item", "doc_start", "item_start", "n_words", "n_same"])

    return rows.mapInArrow(run, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows whose text shares a long enough stretch with a benchmark item; all columns stay as they are.

    Rows with null or empty texts stay, and repeated rows stay or go together; an empty benchmark drops nothing.
    """
    if _size(benchmark, item_text) > INDEX_CHARS:
        found = _overlaps(docs, benchmark, text, item_text).select("da", "db").distinct()
        return docs.join(found, (F.xxhash64(F.col(text)) == found["da"]) & (F.xxhash64(F.lit("d"), F.col(text)) == found["db"]), "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(_index(benchmark, item, item_text))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, dtype=bool)
            clean[[i for i, _ in _scan(batch.column(text).to_pylist(), shared.value)]] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
