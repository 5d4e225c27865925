"""Pipeline status over work items: counts, backlog, blockages, health, freshness, claims, replays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.relational import count_if, pick
from ..sources.tables import Tables
from .registry import Registry

R = Registry()
AS_OF = "2024-01-31 00:00:00"
STATUS = {"signup": "pending", "click": "claimed", "view": "running", "purchase": "succeeded", "error": "dead_letter"}
_STATUS_SQL = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'claimed' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'succeeded' ELSE 'dead_letter' END"
ITEMS = f"items AS (SELECT event_id, user_id, epoch_us(ts) AS seen_at, value, {_STATUS_SQL} AS status, 'domain_' || user_id % 7 AS domain, 'key_' || user_id % 40 AS conflict_key FROM events)"


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def as_of_micros() -> Column:
    return F.unix_micros(F.lit(AS_OF).cast("timestamp"))


def items(t: Tables) -> DataFrame:
    """Events as work items: status by type, domain and conflict key by user."""
    status = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in STATUS.items() if k != "error"], F.lit("dead_letter"))
    return t.events.select("event_id", "user_id", micros("ts").alias("seen_at"), "value", status.alias("status"), F.concat(F.lit("domain_"), (F.col("user_id") % 7).cast("string")).alias("domain"), F.concat(F.lit("key_"), (F.col("user_id") % 40).cast("string")).alias("conflict_key"))


@R.add(f"WITH {ITEMS} SELECT status, count(*) AS n FROM items GROUP BY 1")
def status_counts(t: Tables) -> DataFrame:
    return items(t).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@R.add(f"WITH {ITEMS} SELECT domain, status, count(*) AS n FROM items GROUP BY 1, 2")
def stage_status_counts(t: Tables) -> DataFrame:
    return items(t).groupBy("domain", "status").agg(F.count(F.lit(1)).alias("n"))


@R.add(f"""WITH {ITEMS} SELECT domain, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status IN ('claimed', 'running')) AS in_flight, count(*) FILTER (WHERE status = 'dead_letter') AS dead,
round((epoch_us(TIMESTAMP '{AS_OF}') - min(seen_at) FILTER (WHERE status = 'pending')) / 1e6, 3) AS oldest_s FROM items GROUP BY 1 HAVING count(*) FILTER (WHERE status IN ('pending', 'claimed', 'running')) > 0""")
def domain_backlog(t: Tables) -> DataFrame:
    """Conditional counts of each domain with work left, and the age of its oldest pending item."""
    s = F.col("status")
    out = items(t).groupBy("domain").agg(count_if(s == "pending").alias("pending"), count_if(s.isin("claimed", "running")).alias("in_flight"), count_if(s == "dead_letter").alias("dead"), F.round((as_of_micros() - F.min(F.when(s == "pending", F.col("seen_at")))) / 1e6, 3).alias("oldest_s"))
    return out.where("pending + in_flight > 0")


@R.add(f"WITH {ITEMS} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'claimed') AS claimed, count(*) FILTER (WHERE status = 'claimed' AND seen_at < epoch_us(TIMESTAMP '{AS_OF}') - 86400000000) AS overdue, count(DISTINCT domain) AS domains FROM items")
def queue_snapshot(t: Tables) -> DataFrame:
    s = F.col("status")
    late = F.col("seen_at") < as_of_micros() - F.lit(86_400_000_000)
    return items(t).agg(F.count(F.lit(1)).alias("total"), count_if(s == "pending").alias("pending"), count_if(s == "claimed").alias("claimed"), count_if((s == "claimed") & late).alias("overdue"), F.count_distinct("domain").alias("domains"))


@R.add(f"""WITH {ITEMS} SELECT b.domain, b.conflict_key, count(DISTINCT b.event_id) AS blocked, count(DISTINCT f.event_id) AS blockers FROM items b JOIN items f ON b.conflict_key = f.conflict_key AND b.event_id <> f.event_id
WHERE b.status = 'pending' AND f.status = 'running' AND f.value > 40 GROUP BY 1, 2 ORDER BY blocked DESC, domain, conflict_key LIMIT 10""")
def conflict_blockages(t: Tables) -> DataFrame:
    """The ten conflict keys with most blocked items.

    Pending and running items are told apart by status, so each side is counted by key before the join: no pairs are made.
    """
    i = items(t)
    blocked = i.where("status = 'pending'").groupBy("domain", "conflict_key").agg(F.count_distinct("event_id").alias("blocked"))
    blockers = i.where("status = 'running' AND value > 40").groupBy("conflict_key").agg(F.count_distinct("event_id").alias("blockers"))
    return blocked.join(blockers, "conflict_key").select("domain", "conflict_key", "blocked", "blockers").orderBy(F.desc("blocked"), "domain", "conflict_key").limit(10)


@R.add(f"""WITH {ITEMS}, c AS (SELECT domain, count(*) FILTER (WHERE status = 'pending') AS p, count(*) FILTER (WHERE status IN ('claimed', 'running')) AS f, count(*) FILTER (WHERE status = 'dead_letter') AS d, count(*) FILTER (WHERE status = 'claimed' AND value > 95) AS overdue, count(*) AS n FROM items GROUP BY 1)
SELECT domain, CASE WHEN overdue * 100 > n * 3 OR (p > 0 AND f = 0) THEN 'stalled' WHEN d * 100 > n * 20 THEN 'degraded' WHEN p + f > 0 THEN 'progressing' ELSE 'healthy' END AS health FROM c""")
def pipeline_health(t: Tables) -> DataFrame:
    """Health of each domain by a ladder: stalled (over 3 % overdue, or nothing in flight), degraded (over 20 % dead), progressing, healthy."""
    s = F.col("status")
    c = items(t).groupBy("domain").agg(count_if(s == "pending").alias("p"), count_if(s.isin("claimed", "running")).alias("f"), count_if(s == "dead_letter").alias("d"), count_if((s == "claimed") & (F.col("value") > 95)).alias("overdue"), F.count(F.lit(1)).alias("n"))
    health = F.when((F.col("overdue") * 100 > F.col("n") * 3) | ((F.col("p") > 0) & (F.col("f") == 0)), "stalled").when(F.col("d") * 100 > F.col("n") * 20, "degraded").when(F.col("p") + F.col("f") > 0, "progressing").otherwise("healthy")
    return c.select("domain", health.alias("health"))


@R.add(f"WITH {ITEMS} SELECT event_id, domain, status FROM items WHERE status IN ('pending', 'dead_letter') AND domain = 'domain_3' AND value >= 10 ORDER BY seen_at DESC, event_id LIMIT 100")
def work_items_filter(t: Tables) -> DataFrame:
    """The hundred latest items under several filters, as the administration lists them."""
    i = items(t).where(F.col("status").isin("pending", "dead_letter") & (F.col("domain") == "domain_3") & (F.col("value") >= 10))
    return i.orderBy(F.desc("seen_at"), "event_id").limit(100).select("event_id", "domain", "status")


@R.add(f"WITH {ITEMS} SELECT event_id, CASE WHEN status = 'dead_letter' AND value < 50 THEN 'pending' WHEN status = 'claimed' AND seen_at < epoch_us(TIMESTAMP '{AS_OF}') - 864000000000 THEN 'retrying' ELSE status END AS new_status, (status = 'dead_letter' AND value < 50) AS replayed FROM items")
def replay_transition(t: Tables) -> DataFrame:
    """States after a replay of dead letters and the reaping of old claims: a function of the table, not an update."""
    dead = (F.col("status") == "dead_letter") & (F.col("value") < 50)
    old = (F.col("status") == "claimed") & (F.col("seen_at") < as_of_micros() - F.lit(864_000_000_000))
    return items(t).select("event_id", F.when(dead, "pending").when(old, "retrying").otherwise(F.col("status")).alias("new_status"), dead.alias("replayed"))


@R.add(f"""WITH {ITEMS}, eligible AS (SELECT * FROM items p WHERE status = 'pending' AND NOT EXISTS (SELECT 1 FROM items f WHERE f.status = 'running' AND f.conflict_key = p.conflict_key AND f.domain = p.domain AND f.value > 97))
SELECT event_id, domain, conflict_key FROM (SELECT *, row_number() OVER (PARTITION BY domain, conflict_key ORDER BY seen_at, event_id) AS k FROM eligible) WHERE k = 1""")
def claimable_items(t: Tables) -> DataFrame:
    """What would be claimed next: the oldest pending item of each conflict key that nothing in flight holds."""
    i = items(t)
    held = i.where("status = 'running' AND value > 97").select("domain", "conflict_key").distinct()
    free = i.where("status = 'pending'").join(held, ["domain", "conflict_key"], "left_anti")
    return pick(free, ["domain", "conflict_key"], ["seen_at", "event_id"]).select("event_id", "domain", "conflict_key")


@R.add(f"WITH {ITEMS} SELECT domain, count(*) AS due, min(event_id) AS first FROM items WHERE status = 'dead_letter' AND (value IS NULL OR seen_at + (value * 86400000000)::BIGINT <= epoch_us(TIMESTAMP '{AS_OF}')) GROUP BY 1")
def repair_due(t: Tables) -> DataFrame:
    """Failed items whose next attempt is due: blank or past."""
    due = F.col("value").isNull() | (F.col("seen_at") + F.round(F.col("value") * 86_400_000_000).cast("long") <= as_of_micros())
    return items(t).where((F.col("status") == "dead_letter") & due).groupBy("domain").agg(F.count(F.lit(1)).alias("due"), F.min("event_id").alias("first"))


@R.add("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS versions FROM events GROUP BY 1")
def upsert_latest(t: Tables) -> DataFrame:
    """The latest version of each key, as an upsert leaves it; an aggregate, so nothing is sorted."""
    return t.events.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count(F.lit(1)).alias("versions"))


@R.add("SELECT DISTINCT ON (user_id, event_type) user_id, event_type, event_id, value FROM events ORDER BY user_id, event_type, ts DESC, event_id DESC")
def distinct_on_latest(t: Tables) -> DataFrame:
    return pick(t.events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


_INTENTS = "SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events"


@R.add(f"SELECT event_id, user_id FROM ({_INTENTS}) WHERE k = 1")
def latest_intents(t: Tables) -> DataFrame:
    return pick(t.events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("event_id", "user_id")


@R.add(f"SELECT event_id, k - 1 AS newer FROM ({_INTENTS}) WHERE k > 1")
def superseded_intents(t: Tables) -> DataFrame:
    """Intents that a later one of their key replaced, and how many did."""
    w = Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return t.events.select("event_id", (F.row_number().over(w) - 1).cast("long").alias("newer")).where("newer > 0")


@R.add("""WITH act AS (SELECT user_id, max(event_id) AS active FROM events WHERE event_type = 'purchase' GROUP BY 1), newest AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS newest FROM events GROUP BY 1)
SELECT e.event_id, e.user_id, (e.event_id = coalesce(a.active, n.newest)) AS current FROM events e JOIN newest n USING (user_id) LEFT JOIN act a USING (user_id)""")
def facts_active_generation(t: Tables) -> DataFrame:
    """Facts by whether they are of their scope's active generation: the pointer, else the newest; both from one aggregation."""
    g = t.events.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("event_id"))).alias("active"), F.max_by("event_id", F.struct("ts", "event_id")).alias("newest"))
    return t.events.join(g, "user_id").select("event_id", "user_id", (F.col("event_id") == F.coalesce("active", "newest")).alias("current"))


@R.add("SELECT event_id, event_type, value FROM events WHERE event_type IN ('click', 'error') AND user_id IN (SELECT user_id FROM events WHERE event_type = 'signup')")
def facts_by_kind(t: Tables) -> DataFrame:
    """Facts of some kinds and scopes; the kinds reach the scan as pushed filters."""
    scopes = t.events.where("event_type = 'signup'").select("user_id").distinct()
    return t.events.where(F.col("event_type").isin("click", "error")).join(scopes, "user_id", "left_semi").select("event_id", "event_type", "value")


@R.add("""WITH act AS (SELECT user_id, max(event_id) AS active FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT event_id, CASE WHEN active IS NULL OR event_id = active THEN 'current' WHEN event_id < active THEN 'stale' ELSE 'unaccepted' END AS freshness FROM events LEFT JOIN act USING (user_id)""")
def freshness_filter(t: Tables) -> DataFrame:
    """Work split by its generation: current (also where none is known), stale, not yet accepted."""
    act = t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("event_id").alias("active"))
    state = F.when(F.col("active").isNull() | (F.col("event_id") == F.col("active")), "current").when(F.col("event_id") < F.col("active"), "stale").otherwise("unaccepted")
    return t.events.join(act, "user_id", "left").select("event_id", state.alias("freshness"))


@R.add("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def exists_semi(t: Tables) -> DataFrame:
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(urgent, "c_custkey", "left_semi").select("c_custkey", "c_name")


@R.add(f"""WITH {ITEMS}, c AS (SELECT domain, count(*) AS total, count(*) FILTER (WHERE status = 'succeeded') AS done, count(*) FILTER (WHERE status = 'dead_letter') AS failed, count(*) FILTER (WHERE status IN ('claimed', 'running')) AS active FROM items GROUP BY 1)
SELECT domain, total, done, CASE WHEN failed > 0.21 * total THEN 'failed' WHEN done = total THEN 'complete' WHEN active > 0 THEN 'collection_active' ELSE 'collection_pending' END AS progress FROM c""")
def run_progress(t: Tables) -> DataFrame:
    """Progress of each run by conditional counts and a ladder of states."""
    s = F.col("status")
    c = items(t).groupBy("domain").agg(F.count(F.lit(1)).alias("total"), count_if(s == "succeeded").alias("done"), count_if(s == "dead_letter").alias("failed"), count_if(s.isin("claimed", "running")).alias("active"))
    state = F.when(F.col("failed") > 0.21 * F.col("total"), "failed").when(F.col("done") == F.col("total"), "complete").when(F.col("active") > 0, "collection_active").otherwise("collection_pending")
    return c.select("domain", "total", "done", state.alias("progress"))


@R.add(f"WITH {ITEMS} SELECT i.domain, i.status, p.status AS phase, count(DISTINCT i.event_id) AS items FROM items i JOIN items p ON i.user_id = p.user_id AND i.domain = p.domain AND i.conflict_key = p.conflict_key AND p.value > 99 WHERE i.value > 50 GROUP BY 1, 2, 3")
def phase_publication_counts(t: Tables) -> DataFrame:
    """Items with a published phase, by several keys; phases are made distinct before the join, so items aren't multiplied."""
    i = items(t)
    phases = i.where("value > 99").select("user_id", "domain", "conflict_key", F.col("status").alias("phase")).distinct()
    return i.where("value > 50").join(phases, ["user_id", "domain", "conflict_key"]).groupBy("domain", "status", "phase").agg(F.count_distinct("event_id").alias("items"))


@R.add("SELECT domain, status, max(event_id) AS latest, arg_max(value, (seen_at, event_id)) AS last_value FROM (WITH " + ITEMS + " SELECT * FROM items WHERE status = 'dead_letter') GROUP BY 1, 2")
def latest_failure(t: Tables) -> DataFrame:
    return items(t).where("status = 'dead_letter'").groupBy("domain", "status").agg(F.max("event_id").alias("latest"), F.max_by("value", F.struct("seen_at", "event_id")).alias("last_value"))


QUERIES, SQL = R.queries, R.sql
