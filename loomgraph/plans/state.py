"""Ordered folds of state, readiness splits, partitions of work."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..sources.tables import Tables
from .registry import Registry
from .status import ITEMS, items

R = Registry()


@R.add(f"WITH {ITEMS} SELECT user_id, (('0x' || substr(sha256('user:' || user_id), 1, 16))::UBIGINT % 8)::BIGINT AS part, count(*) AS n, max(event_id) AS latest FROM items WHERE status <> 'succeeded' GROUP BY 1, 2")
def partition_batch(t: Tables) -> DataFrame:
    """Open work by key, with the partition that the key's hash gives it and the latest of each."""
    open_items = items(t).where("status <> 'succeeded'")
    key = F.concat(F.lit("user:"), F.col("user_id").cast("string"))
    return open_items.groupBy("user_id", ids.hash_partition(key, 8).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("latest"))


@R.add(f"WITH {ITEMS}, ready AS (SELECT DISTINCT user_id, domain FROM items WHERE status = 'succeeded' AND value > 80) SELECT domain, count(*) FILTER (WHERE r.user_id IS NOT NULL) AS ready, count(*) FILTER (WHERE r.user_id IS NULL) AS blocked FROM items i LEFT JOIN ready r USING (user_id, domain) WHERE i.status = 'pending' GROUP BY 1")
def readiness_split(t: Tables) -> DataFrame:
    """Pending work by whether the phase that it waits for is published."""
    i = items(t)
    ready = i.where("status = 'succeeded' AND value > 80").select("user_id", "domain").distinct().withColumn("r", F.lit(True))
    both = i.where("status = 'pending'").join(ready, ["user_id", "domain"], "left")
    return both.groupBy("domain").agg(F.count("r").alias("ready"), F.count(F.when(F.col("r").isNull(), 1)).alias("blocked"))


@R.add(f"""WITH {ITEMS}, o AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY seen_at, event_id) AS before FROM items)
SELECT user_id, count(*) AS events, count(*) FILTER (WHERE status = 'claimed') AS attempts, count(*) FILTER (WHERE before = 'pending' AND status = 'claimed') AS claims, count(*) FILTER (WHERE before = 'dead_letter' AND status = 'pending') AS replays, arg_max(status, (seen_at, event_id)) AS final_status FROM o GROUP BY 1""")
def work_item_fold(t: Tables) -> DataFrame:
    """Each key's events in order, folded into attempts, claims, replays and the last state."""
    w = Window.partitionBy("user_id").orderBy("seen_at", "event_id")
    o = items(t).withColumn("before", F.lag("status").over(w))
    s, b = F.col("status"), F.col("before")
    n = lambda c: F.count(F.when(c, 1))
    return o.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), n(s == "claimed").alias("attempts"), n((b == "pending") & (s == "claimed")).alias("claims"), n((b == "dead_letter") & (s == "pending")).alias("replays"), F.max_by("status", F.struct("seen_at", "event_id")).alias("final_status"))


@R.add("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts)::DATE AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_days(t: Tables) -> DataFrame:
    """Events by day and type: the batch form of the tumbling window that streams use (an extension)."""
    return t.events.groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("w.start").cast("date").alias("day"), "n", "total")


@R.add("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 21600000000 THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS started, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(t: Tables) -> DataFrame:
    """Sessions of each user with gaps of six hours (an extension)."""
    w = t.events.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.unix_micros("w.start").alias("started"), "n")


QUERIES, SQL = R.queries, R.sql
