"""Exact Jaccard self-join of documents on word shingles, by vertical partitioning, and the groups that its links make.

The global order of shingles puts those seen nowhere often first, by hash, then frequent ones, by count. Two sets of Jaccard
similarity t share one of each one's first n - ceil(t * n) + 1 shingles, so these prefixes alone make candidates. The order is
cut into fragments; overlaps of a candidate pair are counted in each fragment and summed.

Groups of near copies would make pairs by the square of their size. So links are found in two rounds: each set against a
central set that it shares shingles with, then, exhaustively, sets that share a prefix shingle but not yet a group and whose
places of that shingle leave room for the overlap. Pairs inside a group found so far can't change the groups and are not made.

A passage that is spread thinly over the tasks looks rare to each of them, so its shingles stand in prefixes and their lists
grow with the corpus. The sets of lists that hold CROWD groups or more are therefore ordered again, by exact counts of all
their shingles, and make their pairs from the prefixes of that order; shorter lists make at most CROWD / 2 pairs of groups a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, chunks, lean, mix, shingle_hashes, word_hashes, written

WIDTH = 5
PERCENT = 75
#: Documents of one task's chunk that a shingle is in to be reported as frequent, and the frequent shingles that the order
#: knows at most, the most frequent first. They only shape the order, so no link depends on them.
LOCAL_FREQUENT = 2
FREQUENT = 500_000
CHUNK_SHINGLES = 2_000_000
#: Fragments of each half (rare, frequent) of the order.
FRAGMENTS = 4
#: Parts that a frequent shingle's rows are dealt to.
SALTS = 64
#: Groups in a list from which on its sets are ordered by exact counts.
CROWD = 64


def _sets(texts, width: int) -> Iterator[np.ndarray]:
    for _, parts in chunks(texts):
        words, begins = word_hashes(parts)
        for a, b in zip(begins[:-1], begins[1:], strict=True):
            yield np.unique(shingle_hashes(words[a:b], width))


def _name(s: np.ndarray) -> int:
    """64 bits that name a set, whatever the order of its members."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s).sum(dtype=np.uint64) ^ (mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) * np.uint64(3))]))[0].view(np.int64))


def _parity(s: np.ndarray) -> list[int]:
    """For each of some buckets whether it has an odd number of members: sets differ in as many members as these bits at least.

    There are twice as many buckets as members, up to the next power of two, so that long sets tell apart as well as short
    ones; half of the buckets are the other half's exclusive or away.
    """
    size = max(64, 1 << (2 * len(s) - 1).bit_length())
    odd = np.bincount((s >> np.uint64(20)).astype(np.int64) & (size - 1), minlength=size) & 1
    # Bucket order is kept, so the two halves of the result are the two halves of the buckets.
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def shingle_sets(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """Rows of documents (key, n, name, bits) and, with n null, of shingles that are frequent in a task's chunk (token, seen)."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, known, key_type = [], 0, set(), None

        def frequent() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= LOCAL_FREQUENT
            k = int(often.sum())
            return pa.RecordBatch.from_arrays([pa.nulls(k, key_type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.list_(pa.int64())), pa.array(token[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=names)

        names = ["key", "n", "name", "bits", "token", "seen"]
        for batch in batches:
            key_type = batch.column("key").type
            out = []
            for s in _sets(batch.column("text").to_pylist(), width):
                name = _name(s) if len(s) else None
                out.append((len(s), name, _parity(s) if len(s) else None))
                if len(s) and name not in known:
                    known.add(name)
                    held.append(s)
                    size += len(s)
                if size > CHUNK_SHINGLES:
                    yield frequent()
                    held, size, known = [], 0, set()
            c = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.list_(pa.int64())), pa.nulls(batch.num_rows, pa.int64()), pa.nulls(batch.num_rows, pa.int64())], names=names)
        if held:
            yield frequent()

    return rows.mapInArrow(run, f"key {kind.simpleString()}, n long, name long, bits array<long>, token long, seen long")


class _Order:
    """The global order: frequent shingles (sorted hashes) and how often they were seen."""

    def __init__(self, token: np.ndarray, seen: np.ndarray):
        o = np.argsort(token)
        self.token, self.seen = token[o], seen[o]

    def counts(self, s: np.ndarray) -> np.ndarray:
        if not len(self.token):
            return np.zeros(len(s), np.int64)
        at = np.minimum(np.searchsorted(self.token, s), len(self.token) - 1)
        return np.where(self.token[at] == s, self.seen[at], 0)


def _order(often: DataFrame) -> _Order:
    """The order of the most frequent of the shingles (token, seen), at most FREQUENT: those above a count that a histogram of the counts gives, so no sort of all meets in the driver."""
    often = written(often, "often")
    total, least = 0, None
    for r in often.groupBy("seen").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("seen")).collect():
        total += r["n"]
        if total > FREQUENT:
            break
        least = r["seen"]
    kept = often.where(F.col("seen") >= least) if least is not None else often.where("false")
    got = kept.toPandas()
    return _Order(got["token"].to_numpy(dtype=np.int64).view(np.uint64), got["seen"].to_numpy(dtype=np.int64))


def _prefixes(docs: DataFrame, order, text: str, width: int, percent: int) -> DataFrame:
    """(token, name, pos, often) of each distinct set's prefix; pos counts the set's members before the token."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = set()
        for batch in batches:
            tokens, names, places, often = [], [], [], []
            for s in _sets(batch.column("text").to_pylist(), width):
                n = len(s)
                if not n or (name := _name(s)) in known:
                    continue
                if len(known) < 200_000:
                    known.add(name)
                c = order.value.counts(s)
                first = np.lexsort((s, c))[: n - _least_overlap(n, percent) + 1]
                tokens.append(s[first])
                often.append(c[first] > 0)
                places.append(np.arange(len(first), dtype=np.int32))
                names.append(np.full(len(first), name, np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(names)), pa.array(np.concatenate(places)), pa.array(np.concatenate(often))], names=["token", "name", "pos", "often"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "token long, name long, pos int, often boolean")


def _drop_single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token and name: without repeats, those whose token is frequent or has more than one name; batch by batch."""
    carry, out_already = None, False  # the last row so far, and whether it was passed on
    for batch in batches:
        rows = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "name", "pos", "often"))
        t, n, pos, often = rows if carry is None else (np.concatenate(x) for x in zip(carry, rows, strict=True))
        if not len(t):
            continue
        fresh = np.ones(len(t), bool)
        fresh[1:] = (t[1:] != t[:-1]) | (n[1:] != n[:-1])
        t, n, pos, often = t[fresh], n[fresh], pos[fresh], often[fresh]
        shared = often.copy()
        shared[1:] |= t[1:] == t[:-1]
        shared[:-1] |= t[1:] == t[:-1]
        keep = shared.copy()
        if carry is not None:
            keep[0] &= not out_already
        out_already = bool(shared[-1]) if len(t) > 1 or carry is None else out_already
        carry = t[-1:], n[-1:], pos[-1:], often[-1:]
        yield pa.RecordBatch.from_arrays([pa.array(t[keep]), pa.array(n[keep]), pa.array(pos[keep])], names=["token", "name", "pos"])


def groups_of(links: DataFrame) -> DataFrame:
    """(node, root): the least node that links (a, b) reach from each node of them; by alternating large and small stars."""
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    seen = None
    while True:
        mark = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = written(small.distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _may_link(na: Column, nb: Column, a: Column, b: Column, percent: int) -> Column:
    """Whether sizes and parity bits leave room for enough overlap."""

    def like(x: Column, y: Column) -> Column:
        # Sets of these sizes have as many buckets or twice as many.
        half = (F.size(x) / 2).cast("int")
        folded = F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) > F.size(y), folded).otherwise(x)

    differ = F.aggregate(F.zip_with(like(a, b), like(b, a), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + F.coalesce(x, F.lit(0)))
    # overlap >= percent * union / 100 means that at most (100 - percent) / (100 + percent) of all members are in one set alone.
    return F.when(100 * F.least(na, nb) >= percent * F.greatest(na, nb), (100 + percent) * differ <= (100 - percent) * (na + nb)).otherwise(F.lit(False))


def _texts_of(names: DataFrame, docs: DataFrame, rows: DataFrame, key: str, text: str) -> DataFrame:
    """One column, text: the rows of docs that have a set of the given names, by the least key of each."""
    keys = written(rows.join(names, "name", "left_semi").groupBy("name").agg(F.min("key").alias("key")).select("key").distinct(), "keys")
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    few = keys.count() <= BROADCAST_ROWS
    return texts.join(F.broadcast(keys) if few else keys, texts["key"].eqNullSafe(keys["key"]), "left_semi").select("text")


def _crowded(texts: DataFrame, nodes: DataFrame, order, width: int, percent: int) -> DataFrame:
    """(token, name, n, pos) of the prefixes of these texts' sets in the order of exact counts among them.

    Shingles of one set only come first and need no row, as they have no list: they only move the places of the others.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, names, seen, size = [], [], [], 0
            for s in _sets(batch.column("text").to_pylist(), width):
                tokens.append(s.view(np.int64))
                names.append(np.full(len(s), _name(s) if len(s) else 0, np.int64))
                seen.append(order.value.counts(s))
                size += len(s)
                if size > CHUNK_SHINGLES // 8:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (tokens, names, seen)], names=["token", "name", "seen"])
                    tokens, names, seen, size = [], [], [], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (tokens, names, seen)], names=["token", "name", "seen"])

    spread = F.when(F.col("seen") > 0, F.pmod(F.xxhash64("name"), F.lit(SALTS))).otherwise(F.lit(0))
    dealt = texts.mapInArrow(run, "token long, name long, seen long").withColumn("part", spread)
    by_token = Window.partitionBy("token", "part")
    # Rows of one key with several texts may bring a set more than once.
    fresh = dealt.withColumn("before", F.lag("name").over(by_token.orderBy("name"))).where("before IS NULL OR before <> name")
    # Frequent shingles are dealt to parts and known by how often their chunks had them, all others by their exact count.
    counted = fresh.withColumn("k", F.when(F.col("seen") == 0, F.count(F.lit(1)).over(by_token)).otherwise(F.lit(0))).where("k <> 1").select("token", "name", "seen", "k")
    own = Window.partitionBy("name")
    placed = counted.join(nodes.select("name", "n"), "name").withColumn("pos", F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("seen", "k", "token")) - 1)
    return placed.where(100 * (F.col("n") - F.col("pos")) >= percent * F.col("n")).select("token", "name", "n", F.col("pos").cast("int").alias("pos"))


def _mixed(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of lists (token, name, n, pos) that hold several groups, with root, the number of groups, and main, the group with most members."""
    member = lists.join(groups.withColumnRenamed("node", "name"), "name", "left").select("token", "name", "n", "pos", F.coalesce("root", "name").alias("root"))
    sizes = member.groupBy("token", "root").agg(F.count(F.lit(1)).alias("k"))
    mixed = sizes.groupBy("token").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    return member.join(mixed, "token")


def _across(member: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different groups that meet in a list of _mixed at places that leave room for the overlap.

    The group with most members only meets the others. At the first member that two similar sets share, each has at least
    the needed overlap from there on.
    """
    minor = member.where("root <> main").select("token", F.col("name").alias("other"), F.col("n").alias("other_n"), F.col("pos").alias("other_pos"), F.col("root").alias("other_root"))
    overlap = F.ceil(percent * (F.col("n") + F.col("other_n")) / (100 + percent) - 1e-9)
    fits = (100 * F.least("n", "other_n") >= percent * F.greatest("n", "other_n")) & (F.col("n") - F.col("pos") >= overlap) & (F.col("other_n") - F.col("other_pos") >= overlap)
    across = member.join(minor, "token").where((F.col("root") != F.col("other_root")) & fits & ((F.col("root") == F.col("main")) | (F.col("name") < F.col("other"))))
    return across.select(F.least("name", "other").alias("a"), F.greatest("name", "other").alias("b"))


def _links(pairs: DataFrame, docs: DataFrame, rows: DataFrame, order, key: str, text: str, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b, na, nb) whose sets overlap enough: counted by fragment of the order, summed by pair."""
    nodes = pairs.select(F.col("a").alias("name")).unionByName(pairs.select(F.col("b").alias("name"))).distinct()
    wanted = _texts_of(nodes, docs, rows, key, text)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, frags, tokens = [], [], []
            for s in _sets(batch.column("text").to_pylist(), width):
                if not len(s):
                    continue
                name, half = _name(s), (order.value.counts(s) > 0).astype(np.int64)
                f = half * FRAGMENTS + (s >> np.uint64(62)).astype(np.int64) % FRAGMENTS
                for k in np.unique(f):
                    names.append(name)
                    frags.append(int(k))
                    tokens.append(s[f == k].view(np.int64))
                if len(names) > 4000:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(frags, pa.int32()), pa.array(tokens, pa.list_(pa.int64()))], names=["name", "fragment", "tokens"])
                    names, frags, tokens = [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(frags, pa.int32()), pa.array(tokens, pa.list_(pa.int64()))], names=["name", "fragment", "tokens"])

    # Rows of one key with several texts, or of no key, may bring a set more than once.
    parts = wanted.mapInArrow(run, "name long, fragment int, tokens array<long>").dropDuplicates(["name", "fragment"])
    left = parts.select(F.col("name").alias("a"), "fragment", F.col("tokens").alias("x"))
    right = parts.select(F.col("name").alias("b"), "fragment", F.col("tokens").alias("y"))
    each = pairs.select("a", "b", "na", "nb", F.explode(F.sequence(F.lit(0), F.lit(2 * FRAGMENTS - 1))).alias("fragment"))
    shared = each.join(left, ["a", "fragment"]).join(right, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("x", "y")).alias("k"))
    summed = shared.groupBy("a", "b", "na", "nb").agg(F.sum("k").alias("k"))
    return summed.where(100 * F.col("k") >= percent * (F.col("na") + F.col("nb") - F.col("k"))).select("a", "b")


def shingle_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id) for each row: the size of its set of word shingles, and the least key that links reach.

    Words are runs without ASCII white space, A-Z lower-cased; a text of fewer than `width` words has them all as one
    shingle; a null or empty text, or one of white space, has none, is linked with nothing and is its own component. Sets
    link when 100 * intersection >= percent * union. Equal sets are one node, so copies make no pairs. Rows with equal keys
    are rows of their own; null keys don't count as least unless all are null. An empty table gives no rows.
    Very long texts are read whole, a text at a time; other columns are ignored.

    Shingles and sets are known by 64-bit hashes: of 10 ** 9 distinct sets, two would be taken for one with a chance of 3 %.
    """
    spark = docs.sparkSession
    table = written(shingle_sets(docs, key, text, width), "sets")
    rows = table.where("n IS NOT NULL").select("key", "n", "name", "bits")
    order = spark.sparkContext.broadcast(_order(table.where("token IS NOT NULL").groupBy("token").agg(F.sum("seen").alias("seen"))))

    prefixes = _prefixes(docs, order, text, width, percent)
    # A frequent shingle has a list in any case, so its rows need not meet to be kept.
    spread = F.when(F.col("often"), F.pmod(F.xxhash64("name"), F.lit(SALTS))).otherwise(F.lit(0))
    lists = written(prefixes.repartition("token", spread).sortWithinPartitions("token", "name").mapInArrow(_drop_single, "token long, name long, pos int"), "lists")
    nodes = written(rows.where("name IS NOT NULL").join(lists.select("name").distinct(), "name", "left_semi").dropDuplicates(["name"]).select("name", "n", "bits"), "nodes")

    def sized(pairs: DataFrame) -> DataFrame:
        a = nodes.select(F.col("name").alias("a"), F.col("n").alias("na"), F.col("bits").alias("x"))
        b = nodes.select(F.col("name").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("y"))
        return pairs.join(a, "a").join(b, "b").where(_may_link(F.col("na"), F.col("nb"), F.col("x"), F.col("y"), percent)).select("a", "b", "na", "nb")

    # Round one: each set against the one of a list with fewest members before the shared one, which of near copies is the
    # one nearest to all; of several such sets the one that it shares most lists with.
    centre = lists.groupBy("token").agg(F.min(F.struct("pos", "name"))["name"].alias("b"))
    shared = lists.join(centre, "token").where("name <> b").groupBy(F.col("name").alias("a"), "b").agg(F.count(F.lit(1)).alias("k"))
    best = shared.groupBy("a").agg(F.max_by("b", F.struct("k", "b")).alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    first = written(_links(written(sized(best), "pairs"), docs, rows, order, key, text, width, percent), "links")
    groups = groups_of(first)

    # Round two: all pairs that share a list but no group.
    member = written(_mixed(lists.join(nodes.select("name", "n"), "name"), groups), "member")
    crowd = member.where(F.col("groups") >= CROWD).select("name").distinct()
    again = written(_crowded(_texts_of(crowd, docs, rows, key, text), nodes, order, width, percent), "again")
    pairs = _across(member.where(F.col("groups") < CROWD), percent).unionByName(_across(_mixed(again, groups), percent)).distinct()
    second = _links(written(sized(pairs), "pairs"), docs, rows, order, key, text, width, percent)
    groups = written(groups_of(first.unionByName(second)), "groups")

    named = rows.join(groups.withColumnRenamed("node", "name"), "name", "left").select("key", "n", F.coalesce("root", "name").alias("root"))
    lowest = named.where("root IS NOT NULL").groupBy("root").agg(F.min("key").alias("low"))
    out = named.join(lowest, "root", "left")
    return out.select("key", F.col("n").alias("n_shingles"), F.coalesce("low", "key").alias("component_id"))
