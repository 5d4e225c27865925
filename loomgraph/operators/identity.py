"""Entities that share any identity key are one: groups over a table of keys, by labels that move over keys and jump to their own labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: A key that more than one row in this many has is hot; there are fewer of them than this, so they may be broadcast.
HOT_SHARE = 1000


def hot_keys(rows: DataFrame, on: list[str]) -> DataFrame:
    """The keys that more than one row in HOT_SHARE has, written; fewer than HOT_SHARE whatever the rows."""
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    total = rows.count()
    return cut(counts.where((F.col("__n") * HOT_SHARE > total) & (F.col("__n") > 1)).select(*on))


def spread_join(big: DataFrame, small: DataFrame, on: list[str], hot: DataFrame | None = None) -> DataFrame:
    """big joined with small (one row a key), without sending the rows of a hot key to one task."""
    hot = F.broadcast(hot_keys(big, on) if hot is None else hot)
    often = big.join(hot, on, "left_semi").join(F.broadcast(small.join(hot, on, "left_semi")), on)
    return often.unionByName(big.join(hot, on, "left_anti").join(small, on))


def identity_groups(keys: DataFrame) -> DataFrame:
    """(entity, group) for keys (entity, kind, key): group is the least entity that chains of shared (kind, key) lead to.

    Each round gives every key the least label of its entities, every entity the least of its keys, and then the label's own label, so chains shrink by
    half or more. Rows without an entity are ignored; those without kind or key tell an entity that stands alone.
    """
    known = keys.where("entity IS NOT NULL")
    edges = cut(known.where("kind IS NOT NULL AND key IS NOT NULL").select("entity", F.xxhash64("kind", "key").alias("k1"), F.xxhash64("key", "kind").alias("k2")).distinct())
    labels = cut(known.select("entity").distinct().withColumn("label", F.col("entity")))
    often = hot_keys(edges, ["k1", "k2"])
    while True:
        marked = edges.join(labels, "entity")
        least = cut(marked.groupBy("k1", "k2").agg(F.min("label").alias("least")))
        offered = spread_join(edges, least, ["k1", "k2"], often).groupBy("entity").agg(F.min("least").alias("least"))
        moved = labels.join(offered, "entity", "left").select("entity", "label", F.least("label", F.coalesce("least", "label")).alias("next"))
        moved = cut(moved)
        # A label is an entity too, and may have moved itself.
        own = moved.select(F.col("entity").alias("next"), F.col("next").alias("far"))
        jumped = cut(spread_join(moved, own, ["next"]).select("entity", F.col("label").alias("was"), F.least("next", "far").alias("label")))
        labels = jumped.select("entity", "label")
        if jumped.where("was <> label").isEmpty():
            return labels.select("entity", F.col("label").alias("group"))


def key_clashes(keys: DataFrame, groups: DataFrame, exclusive: list[str]) -> DataFrame:
    """(group, kind, keys, least, most): groups with several keys of a kind that should tell them apart."""
    own = keys.where(F.col("kind").isin(exclusive)).join(groups, "entity").groupBy("group", "kind")
    return own.agg(F.count_distinct("key").alias("keys"), F.min("key").alias("least"), F.max("key").alias("most")).where("keys > 1")
