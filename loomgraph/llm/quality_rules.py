"""Quality rules of single documents, and lines that too many documents of one host share.

Normalised lines are hashed, the distinct documents of each line and host counted, lines above the limits taken out, and
documents rejected that have little left. Words are runs without ASCII white space.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, chunks, lean, run_hashes, shingle_hashes, ship, word_hashes, written

#: A line goes if more documents of its host have it than both of these allow: a number and a share.
MOST_DOCUMENTS, MOST_SHARE = 10, 0.02
#: A document is depleted if less than this share of its words stays.
LEAST_KEPT = 0.5
#: Documents with fewer words fail, as do those with a greater share of repeated words (of three-word windows).
LEAST_WORDS, MOST_REPEATED, WINDOW = 50, 0.5, 3
#: Fixed by the rules: symbols of markup and of code.
SYMBOLS = b"#*$%&|<>"
#: A line that more of all (document, line) rows than one in this many have is frequent enough to be broadcast whatever the number of lines.
HOT_SHARE = 10_000

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_CONTINUES = np.zeros(256, bool)
_CONTINUES[0x80:0xC0] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: np.ndarray) -> int:
    """How many words lie in windows of three words that occur twice or more."""
    if len(words) < WINDOW:
        return 0
    _, back, times = np.unique(shingle_hashes(words, WINDOW), return_inverse=True, return_counts=True)
    again = times[back] > 1
    covered = np.zeros(len(words), bool)
    for k in range(WINDOW):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def later_equal(lines: list[bytes]) -> int:
    """Lines with a word that are equal to an earlier one."""
    worded = [x for x in lines if x.strip(b" \t\n\v\f\r")]
    return len(worded) - len(set(worded))


def measured(parts: list[bytes]):
    """For each text: the five counts, the hashes of its normalised lines (a line's words, A-Z lower-cased, in their order) and each line's words. Lines without words are left out."""
    exact, bounds = word_hashes(parts, lower=False)
    lowered, _ = word_hashes(parts)
    start = 0
    for i, part in enumerate(parts):
        data = np.frombuffer(part, np.uint8)
        words = exact[bounds[i] : bounds[i + 1]]
        space = _SPACE[data]
        counts = (len(words), int((~space & ~_CONTINUES[data]).sum()), int(_IS_SYMBOL[data].sum()), later_equal(part.split(b"\n")), repeated_words(words))
        # The line of each word: line breaks before it.
        begins = np.flatnonzero(~space & np.concatenate(([True], space[:-1]))) if len(data) else np.zeros(0, np.int64)
        line = np.searchsorted(np.flatnonzero(data == 0x0A), begins)
        first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(line) else np.zeros(0, np.int64)
        ends = np.concatenate((first[1:], [len(line)])).astype(np.int64)
        hashes = run_hashes(lowered[bounds[i] : bounds[i + 1]], first, ends)
        yield counts, hashes.view(np.int64), (ends - first).astype(np.int32)
        start += len(data)


def _ragged(arrays: list[np.ndarray], kind) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0), kind))


@lean
def _measure(batches):
    for b in batches:
        counts, lines, words = [], [], []
        for _, parts in chunks(b.column("text").to_pylist()):
            for c, h, n in measured(parts):
                counts.append(c)
                lines.append(h)
                words.append(n)
        columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(_COUNTS))]
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("host"), *columns, _ragged(lines, pa.int64()), _ragged(words, pa.int32())], names=["key", "host", *_COUNTS, "lines", "words"])


def frequent_lines(rows: DataFrame, most_documents: int, most_share: float) -> DataFrame:
    """host and line of the lines above the limits, with the documents that have them (of `rows`: id, host, lines).

    Each document's distinct lines are counted where they are first, so a line that all have is one row a task in the shuffle.
    """
    sizes = rows.groupBy("host").agg(F.count(F.lit(1)).alias("host_documents"))
    counted = rows.select("host", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("documents"))
    above = counted.where(F.col("documents") > most_documents)
    sizes = sizes.select(F.col("host").alias("__host"), "host_documents")
    both = above.join(sizes, F.col("host").eqNullSafe(F.col("__host")))
    return both.where(F.col("documents") > F.lit(most_share) * F.col("host_documents")).select("host", "line", "documents")


def _taken(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """Words of frequent lines by document id; lines: id, host, line, words.

    Lines that one row in HOT_SHARE has are few and broadcast; the others are too rare each to fill a task, so they may be joined by sort.
    """
    these = frequent.select(F.col("host").alias("__host"), F.col("line").alias("__line"), "documents")
    same = F.col("host").eqNullSafe(F.col("__host")) & (F.col("line") == F.col("__line"))
    if frequent.count() <= BROADCAST_ROWS:
        found = lines.join(F.broadcast(these), same, "left_semi")
    else:
        bound = lines.count() // HOT_SHARE
        hot, rest = these.where(F.col("documents") > bound), these.where(F.col("documents") <= bound)
        cool = lines.join(F.broadcast(hot), same, "left_anti").join(rest, same, "left_semi")
        found = lines.join(F.broadcast(hot), same, "left_semi").unionByName(cool)
    return found.groupBy("id").agg(F.sum("words").alias("taken"))


def judge_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", most_documents: int = MOST_DOCUMENTS, most_share: float = MOST_SHARE, least_kept: float = LEAST_KEPT
) -> DataFrame:
    """key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_line_words (words of lines above the limits), kept.

    A document fails with fewer than 50 words or more than half of its words in repeated three-word windows. Of the others
    those are kept that have at least `least_kept` of their words outside lines which more than `most_documents` documents and
    more than `most_share` of the documents of their host hold. A null text has no words and fails; null is a host like any other;
    repeated rows are documents each and so count towards their lines. Very long texts are read whole; words and lines are known by 64-bit hashes.
    Other columns are ignored; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    types = dict(docs.dtypes)
    schema = f"key {types[key]}, host {types[host]}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", lines array<long>, words array<int>"
    rows = docs.select(F.col(key).alias("key"), F.col(host).alias("host"), F.col(text).alias("text")).mapInArrow(_measure, schema)
    # Written once, so a row keeps its id.
    rows = written(rows.withColumn("id", F.monotonically_increasing_id()), "rules")
    frequent = written(frequent_lines(rows, most_documents, most_share), "frequent")
    lines = rows.select("id", "host", F.inline(F.arrays_zip(F.col("lines").alias("line"), F.col("words").alias("words"))).alias("line", "words"))
    both = rows.join(_taken(lines, frequent), "id", "left")
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") > F.lit(MOST_REPEATED) * F.col("n_words"))
    taken = F.coalesce("taken", F.lit(0)).cast("long")
    kept = ~F.col("base_failed") & (F.col("n_words") - F.col("n_line_words") >= F.lit(least_kept) * F.col("n_words"))
    return both.select("key", *_COUNTS, failed.alias("base_failed"), taken.alias("n_line_words")).withColumn("kept", kept)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
l AS (SELECT id, source, UNNEST(string_split(text, chr(10))) AS s FROM d),
lw AS (SELECT id, source, s, regexp_extract_all(s, '[^\x20\x09-\x0D]+') AS ws FROM l WHERE regexp_matches(s, '[^\x20\x09-\x0D]')),
dup AS (SELECT id, count(*) - count(DISTINCT s) AS n FROM lw GROUP BY id),
norm AS (SELECT id, source, translate(array_to_string(ws, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line, len(ws) AS n FROM lw),
hosts AS (SELECT source, count(*) AS n FROM d GROUP BY source),
freq AS (SELECT source, line FROM (SELECT source, line, count(DISTINCT id) AS n FROM norm GROUP BY source, line) f JOIN hosts h USING (source) WHERE f.n > 10 AND f.n > 0.02::DOUBLE * h.n),
taken AS (SELECT id, sum(norm.n) AS n FROM norm JOIN freq USING (source, line) GROUP BY id),
win AS (SELECT id, UNNEST(range(1, len(ws) - 1)) AS p, ws FROM w WHERE len(ws) >= 3),
keyed AS (SELECT id, p, array_to_string(ws[p : p + 2], ' ') AS k FROM win),
again AS (SELECT id, p FROM keyed QUALIFY count(*) OVER (PARTITION BY id, k) > 1),
rep AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, UNNEST([p, p + 1, p + 2]) AS p FROM again) GROUP BY id),
base AS (SELECT d.id, doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
                len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
                coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(taken.n, 0)::BIGINT AS n_line_words
         FROM d JOIN w USING (id) LEFT JOIN dup USING (id) LEFT JOIN rep USING (id) LEFT JOIN taken USING (id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_line_words,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * (n_words - n_line_words) >= n_words AS kept
FROM base
"""
