"""A Merkle manifest of a dataset: one tree for each group of rows, one tree over their roots, and proofs of single rows.

Every node is labelled by the half-open interval of the leaf ranks that it covers. The ancestors of a node are those whose
intervals contain its own; on each level they are found in the bucket that the level's width gives, from the root down. A
node's siblings are the intervals that are left of its parent's when its own is taken away. All of it is DataFrame work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import lower_ascii, written

#: Consecutive nodes that one parent covers.
FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """`-` for null, else the bytes of the value as text, a colon, the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def ranked(rows: DataFrame, group: str, order: list[str], what: str) -> DataFrame:
    """rows, written, with their rank (from 0) among those of their group by `order`, and the group's size n.

    Rows are cut into ranges over the whole table, so a large group is ranked by many tasks; of what precedes a range in its
    group only counts are gathered. Rows that are equal in group and order are told apart by where they were read.
    """
    told = rows.withColumn("__read", F.monotonically_increasing_id())
    cut = written(told.repartitionByRange(group, *order, "__read").withColumn("__part", F.spark_partition_id()), what)
    counts = cut.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("__count"))
    # One row for each group and range that meet.
    earlier = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(group).alias("__group"), F.col("__part").alias("__at"), F.coalesce(F.sum("__count").over(earlier), F.lit(0)).alias("__before"), F.sum("__count").over(Window.partitionBy(group)).alias("n"))
    within = Window.partitionBy("__part", group).orderBy(*order, "__read")
    there = cut.withColumn("__rank", F.row_number().over(within) - 1)
    both = there.join(counts, (F.col("__part") == F.col("__at")) & F.col(group).eqNullSafe(F.col("__group")))
    return both.select(*rows.columns, (F.col("__before") + F.col("__rank")).alias("rank"), "n")


def _parents(nodes: DataFrame, level: int) -> DataFrame:
    """The nodes of `level`, each over up to 16 of the level below, with those as `kids` in their order."""
    width = FANOUT**level
    kids = F.array_sort(F.collect_list("kid"))
    made = nodes.groupBy("group", "n", F.expr(f"lo div {width}").alias("bucket")).agg(kids.alias("kids"))
    joined = F.array_join(F.transform("kids", lambda k: k["digest"]), "")
    return made.select("group", "n", F.col("kids")[0]["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"), F.sha2(joined, 256).alias("digest"), "kids")


def _steps(kids: Column, lo: Column, hi: Column) -> Column:
    """(digests left of the interval, digests right of it): a parent's interval without the node's own."""

    def digests(kept):
        return F.array_join(F.transform(F.filter(kids, kept), lambda k: k["digest"]), "")

    return F.struct(digests(lambda k: k["hi"] <= lo).alias("left"), digests(lambda k: k["lo"] >= hi).alias("right"))


def tree(leaves: DataFrame, what: str, above: DataFrame | None = None):
    """(roots, prove): a tree with 16 children a node for each group of leaves (group, n, rank, digest and other columns, written).

    roots has group, n and digest. prove(above) gives each leaf its columns, and `path`: a (left, right) pair of its siblings' joined
    digests for each level upwards, followed by above's path of its group.
    """
    payload = [c for c in leaves.columns if c not in ("group", "n", "rank", "digest")]
    kid = F.struct(F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest", *payload)
    top = leaves.agg(F.max("n")).first()[0] or 0
    lone = leaves.where("n = 1").select("group", "n", "digest", *payload)
    levels, roots, below = [], [lone.select("group", "n", "digest")], leaves.where("n > 1").select("group", "n", F.col("rank").alias("lo"), kid.alias("kid"))
    while FANOUT ** len(levels) < top:
        level = len(levels) + 1
        made = written(_parents(below, level), f"{what}-level-{level}")
        levels.append(made)
        done = F.col("n") <= FANOUT**level
        roots.append(made.where(done).select("group", "n", "digest"))
        below = made.where(~done).select("group", "n", "lo", F.struct("lo", "hi", "digest").alias("kid"))
    found = roots[0]
    for r in roots[1:]:
        found = found.unionByName(r)

    def prove(above: DataFrame) -> DataFrame:
        """above: group and path, one row for each group."""
        ends = above.select(F.col("group").alias("__group"), F.col("path").alias("__path"), *(F.col(c) for c in above.columns if c not in ("group", "path")))
        carried = [c for c in ends.columns if not c.startswith("__")]
        same = F.col("group").eqNullSafe(F.col("__group"))
        parents = None
        for level in range(len(levels), 0, -1):
            nodes = levels[level - 1]
            at_top = nodes.where(F.col("n") <= FANOUT**level).join(ends, same).select("group", "lo", "hi", "n", "kids", F.col("__path").alias("path"), *carried)
            if parents is not None:
                # The parent's bucket on its own level is where this interval begins; it must contain the whole interval.
                bucket = F.expr(f"lo div {FANOUT ** (level + 1)}")
                over = parents.select(F.col("group").alias("__group"), F.expr(f"lo div {FANOUT ** (level + 1)}").alias("__bucket"), F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), F.col("kids").alias("__kids"), F.col("path").alias("__path"), *carried)
                inside = same & (bucket == F.col("__bucket")) & (F.col("lo") >= F.col("__lo")) & (F.col("hi") <= F.col("__hi"))
                step = F.array(_steps(F.col("__kids"), F.col("lo"), F.col("hi")))
                lower = nodes.where(F.col("n") > FANOUT**level).join(over, inside).select("group", "lo", "hi", "n", "kids", F.concat(step, F.col("__path")).alias("path"), *carried)
                at_top = at_top.unionByName(lower)
            parents = written(at_top, f"{what}-path-{level}") if level > 1 else at_top
        alone = lone.join(ends, same).select(*payload, "digest", F.col("__path").alias("path"), *carried)
        if parents is None:
            return alone
        each = parents.select("kids", "path", *carried, F.explode("kids").alias("k"))
        step = F.array(_steps(F.col("kids"), F.col("k.lo"), F.col("k.hi")))
        return each.select(*(f"k.{c}" for c in payload), "k.digest", F.concat(step, F.col("path")).alias("path"), *carried).unionByName(alone)

    return found, prove


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(path, leaf, lambda at, step: digest(step["left"], at, step["right"]))


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS, changed: dict[str, Column] | None = None) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256 of each row, and folded_root and verified: the root that the row's digest and its siblings lead to, and whether that is the root.

    The leaf is the digest of `fields`, each encoded with its length (null: `-`). Leaves stand in the order of the key in
    their group, groups in the order of their UTF-8 bytes, null first in both. With `changed` (new columns by field) the digest that is folded is that of
    the row as changed. Nulls, empty and very long texts are leaves as all others; of rows with one key and group the digests
    give the order, equal rows are leaves each. Other columns are ignored; an empty table gives no rows.
    """
    changed = {c: v for c, v in (changed or {}).items() if c in fields}
    differs = F.lit(False)
    for c, v in changed.items():
        differs = differs | ~v.eqNullSafe(F.col(c))
    now = F.when(differs, digest(*(encoded(changed.get(c, F.col(c))) for c in fields)))
    # A column of docs may be named like one of ours, so all are named at once.
    leaves = docs.select(F.col(group).alias("group"), F.col(key).alias("key"), digest(*(encoded(F.col(c)) for c in fields)).alias("digest"), now.alias("now"))
    # Written first: the ranges are found by a pass of their own, which would hash all texts again.
    leaves = written(leaves, "leaves")
    leaves = written(ranked(leaves, "group", ["key", "digest"], "ranges"), "ranked")
    subroots, prove = tree(leaves, "rows")
    subroots = written(subroots, "subroots")
    one = subroots.select(F.lit(0).alias("group"), F.col("group").alias("of"), "digest")
    tops = written(ranked(one, "group", ["of"], "tops"), "groups")
    root, prove_tops = tree(tops, "groups")
    above = root.select("group", F.array().cast("array<struct<left: string, right: string>>").alias("path"), F.col("digest").alias("root"))
    paths = prove_tops(above).select(F.col("of").alias("group"), "path", F.col("digest").alias("subroot"), "root")
    proofs = prove(written(paths, "tops-paths"))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    out = proofs.select("key", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.coalesce("now", "digest"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_text(key: str = "doc_id", text: str = "text", every: int = 5) -> Column:
    """text with A-Z lower-cased where `every` divides the crc32 of the key as text."""
    hit = F.crc32(F.col(key).cast("string").cast("binary")) % every == 0
    return F.when(hit, lower_ascii(F.col(text))).otherwise(F.col(text))


def _oracle_tree(rows: str, name: str, levels: int) -> str:
    """SQL of the nodes of a tree over the table `rows` (grp, rank, n, digest), level by level; a node that has no siblings left is the root."""
    out = [f"{name}0 AS (SELECT grp, rank AS idx, n, digest FROM {rows})"]
    for k in range(1, levels + 1):
        out.append(f"{name}{k} AS (SELECT grp, idx // 16 AS idx, (any_value(n) + 15) // 16 AS n, sha256(string_agg(digest, '' ORDER BY idx)) AS digest FROM {name}{k - 1} WHERE n > 1 GROUP BY grp, idx // 16)")
    tops = " UNION ALL ".join(f"SELECT grp, digest FROM {name}{k} WHERE n = 1" for k in range(levels + 1))
    return ",\n".join([*out, f"{name}_root AS ({tops})"])


def _oracle_walk(start: str, name: str, levels: int, keep: str) -> str:
    """SQL that adds each level's siblings to the proof of the rows of `start` (pid, grp, idx, proof, fold) and folds them."""
    out, at = [], start
    for k in range(levels):
        sides = f"""SELECT a.pid, string_agg(b.digest, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx) AS l, string_agg(b.digest, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx) AS r
          FROM {at} a JOIN {name}{k} b ON a.grp IS NOT DISTINCT FROM b.grp AND a.idx // 16 = b.idx // 16 AND b.n > 1 GROUP BY a.pid"""
        out.append(f"""{name}w{k + 1} AS (SELECT a.pid, a.grp, a.idx // 16 AS idx, {keep} proof || coalesce(s.l, '') || coalesce(s.r, '') AS proof,
          CASE WHEN s.pid IS NULL THEN fold ELSE sha256(coalesce(s.l, '') || fold || coalesce(s.r, '')) END AS fold FROM {at} a LEFT JOIN ({sides}) s ON a.pid = s.pid)""")
        at = f"{name}w{k + 1}"
    return ",\n".join(out)


def _oracle() -> str:
    field = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0} END"
    leaf = " || ".join(field.format(f) for f in FIELDS)
    changed = leaf.replace("text", "lowered")
    levels, tops = 5, 2
    return f"""
WITH RECURSIVE crc(i, c, k) AS (SELECT i::BIGINT, i::BIGINT, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM crc WHERE k < 8),
crcs AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
docs AS (SELECT *, row_number() OVER () AS pid, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
             lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 5 = 0 AS hit FROM documents, crcs),
low AS (SELECT *, CASE WHEN hit THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS lowered FROM docs),
leaves AS (SELECT pid, doc_id, source AS grp, sha256({leaf}) AS digest, sha256({changed}) AS now FROM low),
ranks AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, digest) - 1 AS rank, count(*) OVER (PARTITION BY grp) AS n FROM leaves),
{_oracle_tree("ranks", "a", levels)},
tops AS (SELECT 0 AS grp, grp AS of, digest, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS rank, count(*) OVER () AS n FROM a_root),
{_oracle_tree("tops", "b", tops)},
s0 AS (SELECT pid, grp, rank AS idx, '' AS proof, now AS fold FROM ranks),
{_oracle_walk("s0", "a", levels, "")},
s1 AS (SELECT w.pid, 0 AS grp, t.rank AS idx, t.digest AS sub, w.proof, w.fold FROM aw{levels} w JOIN tops t ON w.grp IS NOT DISTINCT FROM t.of),
{_oracle_walk("s1", "b", tops, "a.sub,")}
SELECT r.doc_id, r.digest AS leaf, w.sub AS subroot, b_root.digest AS root, sha256(w.proof) AS proof_sha256, w.fold AS folded_root, w.fold = b_root.digest AS verified
FROM ranks r JOIN bw{tops} w ON r.pid = w.pid CROSS JOIN b_root
"""


#: For up to 16^5 rows of a source and 256 sources.
ORACLE = _oracle()
