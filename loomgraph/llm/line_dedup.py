"""Removal of passages that repeat across a corpus, by overlapping windows of three lines, and on request by shorter ones of many words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, written

LINES = 3
#: Covered lines that may be broadcast in all.
BROADCAST_LINES = 2_000_000


def _windows(lines: Column, words: Column, over_words: int | None) -> Column:
    """Structs (pos, n_lines, a, b) of the windows of an array of lines: 128 hash bits of each run of three lines, or of all lines where there are fewer. Windows of white space only are left out.

    With `over_words`, also of each run of one or two lines that holds more words than that; `words` has those of each line.
    """
    n = F.size(lines)
    starts = F.when(n < LINES, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - LINES))

    def window(i: Column, length: int) -> Column:
        run = F.slice(lines, i + 1, length)
        seen = F.translate(F.concat_ws("", run), " \t\r", "") != ""
        return F.struct(i.alias("pos"), F.lit(length).alias("n_lines"), F.when(seen, F.xxhash64(run)).alias("a"), F.xxhash64(F.lit(7), run).alias("b"))

    def runs(at: Column, length: int) -> Column:
        return F.transform(at, lambda i: window(i, length))

    def long(length: int) -> Column:
        at = F.when(n > length, F.sequence(F.lit(0), n - length)).otherwise(F.array().cast("array<int>"))
        return F.filter(at, lambda i: sum((F.element_at(words, i + x) for x in range(2, length + 1)), F.element_at(words, i + 1)) > over_words)

    found = [runs(starts, LINES)]
    if over_words is not None:
        # A document of as few lines is a window already.
        found += [runs(long(length), length) for length in range(1, LINES)]
    return F.filter(F.concat(*found), lambda w: w["a"].isNotNull())


def covered_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", over_words: int | None = None) -> DataFrame:
    """For each document with later occurrences: key, text_hash, and the sorted positions of its lines that they cover.

    The first occurrence of a window is that of the least (key, text hash, position). Rows of one key and text are one
    document. Null texts have no windows; a null key sorts first.
    """
    # The lines are a column of their own, else each window's function would split the text anew.
    split = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("text_hash"), F.split(F.col(text), "\n", -1).alias("lines"))
    if over_words is not None:
        split = split.withColumn("words", F.transform("lines", lambda x: F.regexp_count(x, F.lit(r"\S+"))))
    found = split.select("key", "text_hash", F.inline(_windows(F.col("lines"), F.col("words") if over_words is not None else F.lit(None), over_words)))
    at = F.struct("key", "text_hash", "pos")
    first = found.groupBy("a", "b").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = found.join(first, ["a", "b"]).where(at > F.col("first"))
    runs = later.groupBy("key", "text_hash").agg(F.collect_set(F.struct("pos", "n_lines")).alias("starts"))
    cover = F.flatten(F.transform("starts", lambda w: F.sequence(w["pos"], w["pos"] + w["n_lines"] - 1)))
    return runs.select("key", "text_hash", F.array_sort(F.array_distinct(cover)).alias("covered"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", removed: str = "n_removed", over_words: int | None = None) -> DataFrame:
    """docs with `text` rid of the lines that later occurrences of repeated windows cover, and `removed`, how many went.

    Texts without such lines, null and empty ones included, stay as they are. A document all of whose lines go keeps its
    row with an empty text. Repeated rows of one key and text share a result. All other columns stay; a column of docs
    named as `removed` is replaced. Without `over_words`, a passage of one or two lines in a document of three or more is
    found only with its neighbouring lines; with it, also alone if it holds more words (runs without white space) than that.
    A very long text is one row of arrays of its lines and windows. An empty table gives no rows.
    """
    cover = written(covered_lines(docs, key, text, over_words).select(F.col("key").alias("__key"), F.col("text_hash").alias("__hash"), F.col("covered").alias("__covered")), "covered")
    n, lines = cover.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("__covered")), F.lit(0))).first()
    if n <= BROADCAST_ROWS and lines <= BROADCAST_LINES:
        cover = F.broadcast(cover)
    same = F.xxhash64(F.col(text)).eqNullSafe(F.col("__hash")) & F.col(key).eqNullSafe(F.col("__key"))
    changed = F.col("__covered").isNotNull()
    both = docs.join(cover, same, "left").withColumn("__lines", F.when(changed, F.split(F.col(text), "\n", -1)))
    lines = F.col("__lines")
    there = F.sequence(F.lit(0), F.size(lines) - 1)
    gone = F.array_intersect(there, F.col("__covered"))
    kept = F.array_except(there, F.col("__covered"))
    rest = F.array_join(F.transform(kept, lambda i: F.element_at(lines, i + 1)), "\n")
    out = [F.when(changed, rest).otherwise(F.col(text)).alias(c) if c == text else F.col(c) for c in docs.columns if c != removed]
    return both.select(*out, F.when(changed, F.size(gone)).otherwise(F.lit(0)).cast("long").alias(removed))


ORACLE = """
WITH base AS (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
starts AS (SELECT doc_id, a, UNNEST(CASE WHEN len(a) < 3 THEN [0] ELSE range(0, len(a) - 2) END) AS pos FROM base),
win AS (SELECT doc_id, pos, least(len(a), 3) AS n, array_to_string(a[pos + 1 : pos + 3], chr(10)) AS k FROM starts),
seen AS (SELECT * FROM win WHERE regexp_replace(k, '[ \\t\\r\\n]', '', 'g') <> ''),
first AS (SELECT k, min((doc_id, pos)) AS f, count(*) AS c FROM seen GROUP BY k HAVING count(*) > 1),
later AS (SELECT DISTINCT doc_id, UNNEST(range(pos, pos + n)) AS line FROM seen JOIN first USING (k) WHERE (doc_id, pos) > f),
lines AS (SELECT doc_id, UNNEST(a) AS s, UNNEST(range(0, len(a))) AS line FROM base),
rest AS (SELECT l.doc_id, coalesce(string_agg(l.s, chr(10) ORDER BY l.line) FILTER (WHERE r.line IS NULL), '') AS text,
                count(r.line) AS n_removed
         FROM lines l LEFT JOIN later r ON l.doc_id = r.doc_id AND l.line = r.line GROUP BY l.doc_id)
SELECT d.doc_id, rest.text, coalesce(n_removed, 0) AS n_removed, coalesce(length(rest.text), 0)::BIGINT AS n_chars
FROM documents d LEFT JOIN rest USING (doc_id)
"""
