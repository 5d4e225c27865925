"""Deferred backfill: derived rows are made again only for the owners whose sources changed since the last run, and their ended items are reopened."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from ..sources.store import GenerationStore

#: Statuses of items that are over.
ENDED = ("succeeded", "dead_letter", "skipped")


def changed_owners(source: GenerationStore, log: GenerationStore) -> DataFrame:
    """(owner, gone): owners whose digest differs from the one that the last run read (log: owner, id, digest), and those that are no longer there."""
    now = source.manifest().select(source.owner, F.col("digest").cast("string").alias("now"))
    then = log.read().select(source.owner, F.col("digest").alias("then"))
    both = now.join(then, source.owner, "full")
    return both.where(~F.col("now").eqNullSafe(F.col("then"))).select(source.owner, F.col("now").isNull().alias("gone"))


def backfill(source: GenerationStore, result: GenerationStore, log: GenerationStore, derive: Callable[[DataFrame], DataFrame], generation: str) -> DataFrame:
    """Brings result to what `derive` makes of all of source, reading the rows of changed owners only; gives those owners (owner, gone).

    derive must make an owner's rows from that owner's rows alone. The log is written last, so a run that breaks off is done again.
    """
    changed = cut(changed_owners(source, log))
    result.write(derive(source.read(changed)), generation, scope=changed)
    seen = source.manifest().join(changed, source.owner, "left_semi").select(source.owner, F.lit("source").alias("id"), F.col("digest").cast("string").alias("digest"))
    log.write(seen, generation, scope=changed)
    return changed


def reopened(items: DataFrame, changed: DataFrame, owner: str) -> DataFrame:
    """items (owner, status, attempts, ...) with the ended ones of changed owners pending again and without attempts; items of owners that are gone stay ended."""
    back = changed.where("NOT gone").select(F.col(owner), F.lit(True).alias("__back"))
    both = items.join(back, owner, "left")
    again = F.coalesce("__back", F.lit(False)) & F.col("status").isin(*ENDED)
    out = {"status": F.when(again, F.lit("pending")).otherwise(F.col("status")), "attempts": F.when(again, F.lit(0)).otherwise(F.col("attempts"))}
    return both.select(*[out[c].alias(c) if c in out else F.col(c) for c in items.columns])
