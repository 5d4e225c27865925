"""What several operators of this subpackage need: shared tables, size checks and text arrays."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a small side may have to be broadcast; beyond it the caller joins with a shuffle.
BROADCAST_ROWS = 200_000


_SHIPPED: set[str] = set()


#: Rows of an Arrow batch: texts are long, so the default of 10,000 takes much memory in each worker.
BATCH_ROWS = "1000"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for an application, and keeps Arrow batches small unless the session sets their size."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if sc.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parent.parent
    out = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="spark-")), f"{top.name}.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local runs without it a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, what: str) -> DataFrame:
    """df written once as Parquet to the shared folder and read again: a cut of the lineage that outlives executors. Removed when the program ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows, else df; for tables of a few narrow columns that are already written."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def lean(run):
    """A function for mapInArrow that, when its task ends, gives freed memory back to the system: Python workers live on, and what they keep counts against their executor."""

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_fold(key: Column, folds: int) -> Column:
    """crc32 of a key as text, modulo folds."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(folds)


# ---------------------------------------------------------------- arrays of words

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}
#: Bytes of text that are handled as one array, to bound a worker's memory.
CHUNK_BYTES = 1_000_000


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(max(n, CHUNK_BYTES + 1), base, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def chunks(texts, limit: int = CHUNK_BYTES):
    """(first index, list of UTF-8 bytes) of consecutive texts; null is empty. A text above the limit is a chunk of its own."""
    part, size, first = [], 0, 0
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        if part and size + len(b) > limit:
            yield first, part
            part, size, first = [], 0, i
        part.append(b)
        size += len(b)
    if part:
        yield first, part


def word_hashes(parts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs without ASCII white space, A-Z lower-cased unless told not to) of several texts one after the other, and where each text's words begin (one more entry: the end)."""
    lens = np.array([len(b) for b in parts], dtype=np.int64)
    bounds = np.concatenate(([0], np.cumsum(lens)))
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(parts) + 1, np.int64)
    word = ~_SEP[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    before[bounds[:-1][lens > 0]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, word[1:]
    after[bounds[1:][lens > 0] - 1] = False
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    up, down = _powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(((_LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    h = mix(h ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return h, np.searchsorted(start, bounds)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words of one text (or of the whole text if it has fewer words); unsorted, with repeats."""
    k = len(words)
    if not k:
        return words
    w = min(width, k)
    s = np.full(k - w + 1, w, dtype=np.uint64)
    for j in range(w):
        s = s * np.uint64(0x2545F4914F6CDD1D) + words[j : k - w + 1 + j]
    return mix(s)


def run_hashes(words: np.ndarray, first: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the runs of word hashes from each `first` to before each `ends`; none is empty."""
    if not len(first):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix(((total[ends] - total[first]) * down[first]) ^ ((ends - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
