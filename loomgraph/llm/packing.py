"""Packing of tokenised documents into fixed windows: repeat counts of length patterns by non-negative least squares, the rest greedily."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, lean, written

WINDOW = 2048
END = 1
#: Parts that a pattern has at most.
DEPTH = 4
#: Most frequent lengths that patterns of three and four parts are made of; pairs are made of all lengths.
COMMON = 48
STEPS = 400
#: Sub-buckets in which tails of one length are ranked, so that no task ranks all tails of a frequent length.
RANK_BUCKETS = 128
#: A text with a longer run of white space goes to the slower tokenizer, whose pattern has no backtracking.
LONG_SPACE = 2000


class Tokens:
    """Ids of a byte-level BPE: by tiktoken ranks, which give what the tokenizers file gives but faster, and by that file for texts that strain a backtracking pattern."""

    def __init__(self, json_path: str, ranks_path: str | None = None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(json_path)
        self.fast = None
        if ranks_path:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            special = {t.content: i for i, t in self.slow.get_added_tokens_decoder().items()}
            self.fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or " " * LONG_SPACE in text or "\n" * LONG_SPACE in text or len(text) > 200_000 and max(map(len, text.split(" "))) > 50_000:
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return self.fast.encode_to_numpy(text, allowed_special="all").astype(np.uint32)


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


_LOADED: dict = {}


def tokenise(docs: DataFrame, key: str = "doc_id", text: str = "text", paths: tuple[str, str | None] | None = None, window: int = WINDOW, end: int = END) -> DataFrame:
    """A row for each document: row (unique), part (its partition), key, n (ids with the end id), first_full (number of full windows of the partition before it), full (crc32 of each full window), tail_n, tail_crc and tail (the ids after the full windows, little-endian unsigned 32 bits)."""
    paths = paths or tokenizer_paths()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"row long, part long, key {dict(rows.dtypes)['key']}, n long, first_full long, full array<long>, tail_n int, tail_crc long, tail binary"

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if paths not in _LOADED:
            _LOADED[paths] = Tokens(*paths)
        coder, part, count, windows = _LOADED[paths], TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                piece, out = batch.slice(lo, 500), []
                for t in piece.column("text").to_pylist():
                    ids = np.append(coder.ids(t or ""), np.uint32(end)).astype("<u4")
                    k = len(ids) // window
                    tail = ids[k * window :].tobytes()
                    full = [zlib.crc32(ids[i * window : (i + 1) * window].tobytes()) for i in range(k)]
                    out.append(((part << 33) + count, part, len(ids), windows, full, len(tail) // 4, zlib.crc32(tail), tail))
                    count += 1
                    windows += k
                c = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int64(), None, pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.binary())
                c.insert(2, None)
                yield pa.RecordBatch.from_arrays([piece.column("key") if k is None else pa.array(x, k) for x, k in zip(c, kinds, strict=True)], names=["row", "part", "key", "n", "first_full", "full", "tail_n", "tail_crc", "tail"])

    return rows.mapInArrow(run, schema)


def patterns(histogram: dict[int, int], window: int = WINDOW, common: int = COMMON) -> list[tuple[int, ...]]:
    """Combinations of at most DEPTH lengths of the histogram that fill a window exactly, longest part first."""
    there = set(histogram)
    found = {(a, window - a) for a in there if 2 * a >= window and window - a in there}
    often = sorted(sorted(there, key=lambda a: (-histogram[a], a))[:common])
    for i, a in enumerate(often):
        for j in range(i, len(often)):
            rest = window - a - often[j]
            if rest in there:
                found.add(tuple(sorted((a, often[j], rest), reverse=True)))
            for c in often[j:] if DEPTH > 3 else ():
                if rest - c in there:
                    found.add(tuple(sorted((a, often[j], c, rest - c), reverse=True)))
    return sorted(found, reverse=True)


def repeat_counts(histogram: dict[int, int], found: list[tuple[int, ...]], window: int = WINDOW, steps: int = STEPS) -> np.ndarray:
    """Whole repeat counts of the patterns: least squares of what they use against the histogram, by accelerated projected gradient, rounded down and cut to what there is."""
    if not found:
        return np.zeros(0, np.int64)
    h = np.zeros(window)
    for a, n in histogram.items():
        h[a] = n
    lens = np.array([x for p in found for x in p])
    own = np.array([k for k, p in enumerate(found) for _ in p])
    scale = max(1.0, h.max())
    use = lambda x: np.bincount(lens, x[own], minlength=window)
    fit = lambda r: np.bincount(own, r[lens], minlength=len(found))
    v = np.ones(len(found))
    for _ in range(20):  # the largest eigenvalue gives the step
        v = fit(use(v))
        v /= np.linalg.norm(v) + 1e-12
    step = 1.0 / (np.linalg.norm(fit(use(v))) + 1e-9)
    x = y = np.zeros(len(found))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y + step * fit(h / scale - use(y)))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    left, counts = h.astype(np.int64), np.zeros(len(found), np.int64)
    for k in sorted(range(len(found)), key=lambda k: (-x[k], k)):
        need = np.bincount(found[k], minlength=window)
        n = min(int(x[k] * scale + 1e-6), int((left[need > 0] // need[need > 0]).min()))
        counts[k] = max(0, n)
        left -= counts[k] * need
    return counts


def _power_cuts(rest: int) -> list[int]:
    """Starts of the pieces of `rest` ids whose lengths are its powers of two, largest first."""
    out, at = [], 0
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            out.append(at)
            at += 1 << bit
    return out


def plan(histogram: dict[int, int], window: int = WINDOW) -> tuple[list[tuple], dict]:
    """Where tails go, by length and rank among the tails of that length.

    The list has (tail_n, from_rank, to_rank, first sequence, offset in the sequence) of pattern slots. Tails of higher ranks
    stand one after the other in a stream, longest first, cut at every window and, at its end, at powers of two; the dict
    has their slots (tail_n, from_rank, to_rank, place in the stream), the stream's length and its first sequence.
    """
    found = patterns(histogram, window)
    counts = repeat_counts(histogram, found, window)
    taken, slots, sequence = dict.fromkeys(histogram, 0), [], 0
    for p, n in zip(found, counts, strict=True):
        if n:
            offset = 0
            for a in p:
                slots.append((a, taken[a], taken[a] + int(n), sequence, offset))
                taken[a] += int(n)
                offset += a
            sequence += int(n)
    stream, at = [], 0
    for a in sorted(histogram, reverse=True):
        if histogram[a] > taken[a]:
            stream.append((a, taken[a], histogram[a], at))
            at += (histogram[a] - taken[a]) * a
    return slots, {"slots": stream, "length": at, "first": sequence}


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", paths: tuple[str, str | None] | None = None, window: int = WINDOW, end: int = END) -> DataFrame:
    """Pieces of all documents: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its text and then `end`; a null or empty text has `end` alone. It is cut into full windows,
    each a sequence of its own, and a tail below a window. Tails fill sequences by patterns; what the rounded counts leave
    is packed in a stream, where alone tails are cut. Only the stream's last part makes sequences below a window, of
    lengths that are powers of two. Offsets run gapless from 0. Repeated rows are packed each; an empty table gives no
    rows; other columns are ignored. Very long texts are encoded whole. ids_of gives the ids of the pieces.
    """
    table = written(tokenise(docs, key, text, paths, window, end), "tokens")
    spark = docs.sparkSession
    counts = {r["tail_n"]: r["k"] for r in table.where("tail_n > 0").groupBy("tail_n").agg(F.count(F.lit(1)).alias("k")).collect()}
    slots, stream = plan(counts, window)

    # Full windows: numbered through all partitions by the numbers of windows before.
    per_part = table.groupBy("part").agg(F.sum(F.size("full")).alias("k"))
    before = per_part.select("part", (F.coalesce(F.sum("k").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("before"))
    tail_sequences = stream["first"] + -(-stream["length"] // window) + window.bit_length()
    whole = table.select("part", "key", "n", "first_full", F.posexplode("full").alias("i", "crc")).join(before, "part")
    whole = whole.select("key", (F.col("i") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), (F.lit(tail_sequences) + F.col("before") + F.col("first_full") + F.col("i")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if not counts:
        return whole

    # The rank of a tail among those of its length: in a sub-bucket, plus what earlier sub-buckets hold.
    tails = table.where("tail_n > 0").select("row", "key", "n", "tail_n", "tail_crc", F.pmod(F.xxhash64("row"), F.lit(RANK_BUCKETS)).cast("int").alias("bucket"))
    sizes = tails.groupBy("tail_n", "bucket").agg(F.count(F.lit(1)).alias("k"))
    earlier = Window.partitionBy("tail_n").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("tail_n", "bucket", F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("before"))
    ranked = tails.withColumn("k", F.row_number().over(Window.partitionBy("tail_n", "bucket").orderBy("row")) - 1)
    ranked = ranked.join(offsets, ["tail_n", "bucket"]).withColumn("rank", F.col("before") + F.col("k"))
    # Slots are at most the patterns times their parts, whatever the input: safe to broadcast.
    table_slots = spark.createDataFrame(
        [(a, lo, hi, seq, off, False) for a, lo, hi, seq, off in slots] + [(a, lo, hi, at, 0, True) for a, lo, hi, at in stream["slots"]],
        "tail_n int, lo long, hi long, place long, at int, streamed boolean",
    )
    placed = ranked.join(F.broadcast(table_slots), "tail_n").where("rank >= lo AND rank < hi").withColumn("step", F.col("rank") - F.col("lo"))
    begin = ((F.col("n") - F.col("tail_n"))).cast("long")
    whole_tail = [F.col("tail_n").cast("long").alias("length"), F.col("tail_crc").alias("ids_crc32"), F.col("n").alias("doc_tokens")]
    by_pattern = placed.where("NOT streamed").select("key", begin.alias("start"), *whole_tail, (F.col("place") + F.col("step")).cast("long").alias("sequence_id"), F.col("at").cast("long").alias("offset"))

    # The stream: place of each tail, and the cuts inside it.
    rest = stream["length"] % window
    last = stream["length"] - rest
    ends = F.array(*[F.lit(last + c).cast("long") for c in _power_cuts(rest)]) if rest else F.array().cast("array<long>")
    lo, hi = F.col("place") + F.col("step") * F.col("tail_n"), F.col("place") + (F.col("step") + 1) * F.col("tail_n")
    flow = placed.where("streamed").select("row", "key", "n", "tail_n", "tail_crc", lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))
    next_window = ((F.floor(F.col("lo") / window) + 1) * window).cast("long")
    cuts = F.filter(F.array_union(F.array(next_window), ends), lambda c: (c > F.col("lo")) & (c < F.col("hi")) & ((c <= last) | F.exists(ends, lambda e: e == c)))
    points = F.array_sort(F.concat(F.array("lo", "hi"), cuts))
    pieces = flow.withColumn("points", points).select("*", F.posexplode(F.slice("points", 1, F.size("points") - 1)).alias("i", "from")).withColumn("to", F.element_at("points", F.col("i") + 2))
    in_last = F.col("from") >= last
    # Which of the last part's sequences a place lies in, and where that begins.
    own = F.array_max(F.filter(ends, lambda c: c <= F.col("from")))
    nth = F.size(F.filter(ends, lambda c: c <= F.col("from"))) - 1
    sequence = F.lit(stream["first"]) + F.when(in_last, F.lit(last // window) + nth).otherwise(F.floor(F.col("from") / window))
    offset = F.col("from") - F.when(in_last, own).otherwise(F.floor(F.col("from") / window) * window)
    pieces = pieces.select("row", "key", "n", "tail_n", "tail_crc", (F.col("from") - F.col("lo")).alias("inside"), (F.col("to") - F.col("from")).alias("length"), sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))
    uncut = pieces.where("length = tail_n").select("key", begin.alias("start"), *whole_tail, "sequence_id", "offset")
    cut = pieces.where("length < tail_n")
    # Each window boundary cuts one tail into two or more pieces, so the number of cut pieces is known beforehand.
    at_most = 2 * (stream["length"] // window + window.bit_length() + 1)
    cut = F.broadcast(cut) if at_most <= BROADCAST_ROWS else cut
    ids = F.substring("tail", (F.col("inside") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))
    sliced = table.where("tail_n > 0").select("row", "tail").join(cut, "row").select("key", (begin + F.col("inside")).alias("start"), F.col("length").cast("long").alias("length"), F.crc32(ids).alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id", "offset")
    return whole.unionByName(by_pattern).unionByName(uncut).unionByName(sliced)


def ids_of(docs: DataFrame, pieces: DataFrame, key: str = "doc_id", text: str = "text", paths: tuple[str, str | None] | None = None, end: int = END) -> DataFrame:
    """sequence_id, offset and ids (array of int) of pieces of `pack`, for writing out sequences. Keys must be unique."""
    paths = paths or tokenizer_paths()
    spans = pieces.groupBy("key").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("spans"))
    both = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(spans, "key")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if paths not in _LOADED:
            _LOADED[paths] = Tokens(*paths)
        for batch in batches:
            out = []
            for t, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                ids = np.append(_LOADED[paths].ids(t or ""), np.uint32(end))
                out += [(s["sequence_id"], s["offset"], ids[s["start"] : s["start"] + s["length"]].tolist()) for s in spans]
            c = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.list_(pa.int32()))], names=["sequence_id", "offset", "ids"])

    return both.select("text", "spans").mapInArrow(run, "sequence_id long, offset long, ids array<int>")
