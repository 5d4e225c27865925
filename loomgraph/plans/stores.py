"""Keyed generations and incremental runs over them: the tables are written twice, the second time with rows changed, stale and retracted."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.incremental import backfill
from ..session import _remove, shared_dir
from ..sources.store import GenerationStore, write_graph
from ..sources.tables import Tables, node_id
from .registry import Registry

R = Registry()


def _store(t: Tables, schema: str, *keys: str) -> GenerationStore:
    path = f"{shared_dir(t.spark)}/loomgraph-store-{uuid.uuid4().hex}"
    atexit.register(_remove, t.spark, path)
    return GenerationStore(t.spark, path, schema, keys=keys or ("id",))


_ENTITIES = "repo_id string, id long, body string"


def _first(t: Tables) -> DataFrame:
    return t.customer.select(node_id("repo", "c_nationkey").alias("repo_id"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("body"))


def _second(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Rows of the nations whose key 3 doesn't divide: changed below a balance of 0, gone above 9000. In scope are all nations but those of region 4."""
    n = t.nation.where("n_regionkey <> 4")
    rows = t.customer.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).where("c_nationkey % 3 <> 0 AND c_acctbal <= 9000")
    body = F.when(F.col("c_acctbal") < 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    return rows.select(node_id("repo", "c_nationkey").alias("repo_id"), F.col("c_custkey").alias("id"), body.alias("body")), n.select(node_id("repo", "n_nationkey").alias("repo_id"))


_AFTER = """after AS (SELECT c_custkey AS id, c_nationkey AS nation, CASE WHEN n_regionkey <> 4 AND c_acctbal < 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS body
  FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 4 OR (n_nationkey % 3 <> 0 AND c_acctbal <= 9000))"""


@R.add(f"WITH {_AFTER} SELECT 'repo:' || nation AS repo_id, id, body FROM after")
def generation_upserts(t: Tables) -> DataFrame:
    """What readers see after two generations: changed rows, without stale ones and retracted repositories; others keep their first rows."""
    s = _store(t, _ENTITIES)
    s.write(_first(t), "1")
    rows, scope = _second(t)
    s.write(rows, "2", scope)
    return s.read()


@R.add(f"""WITH {_AFTER} SELECT 'repo:' || c_nationkey AS repo_id, 0::BIGINT AS inserted, count(*) FILTER (WHERE a.id IS NOT NULL AND a.body <> c_mktsegment) AS updated, count(*) FILTER (WHERE a.id IS NULL) AS deleted
FROM customer LEFT JOIN after a ON a.id = c_custkey GROUP BY c_nationkey HAVING count(*) FILTER (WHERE a.id IS NULL OR a.body <> c_mktsegment) > 0""")
def generation_changes(t: Tables) -> DataFrame:
    """How many rows of each repository the second generation inserts, updates and deletes."""
    s = _store(t, _ENTITIES)
    s.write(_first(t), "1")
    rows, scope = _second(t)
    return s.write(rows, "2", scope)


@R.add(f"""WITH {_AFTER}, full_run AS (SELECT 'repo:' || nation AS repo_id, upper(body) AS id, count(*) AS n FROM after GROUP BY ALL),
touched AS (SELECT DISTINCT c_nationkey AS nation FROM customer LEFT JOIN after a ON a.id = c_custkey WHERE a.id IS NULL OR a.body <> c_mktsegment)
SELECT repo_id, id, n, repo_id IN (SELECT 'repo:' || nation FROM touched) AS made_again FROM full_run""")
def incremental_backfill(t: Tables) -> DataFrame:
    """Counts derived twice, the second time for changed repositories only, as a full run would give them; and which were made again."""
    source, result, log = _store(t, _ENTITIES), _store(t, "repo_id string, id string, n long"), _store(t, "repo_id string, id string, digest string")

    def derive(rows: DataFrame) -> DataFrame:
        return rows.groupBy("repo_id", F.upper("body").alias("id")).agg(F.count(F.lit(1)).alias("n"))

    source.write(_first(t), "1")
    backfill(source, result, log, derive, "1")
    rows, scope = _second(t)
    source.write(rows, "2", scope)
    changed = backfill(source, result, log, derive, "2")
    return result.read().join(changed.select("repo_id", F.lit(True).alias("c")), "repo_id", "left").select("repo_id", "id", "n", F.coalesce("c", F.lit(False)).alias("made_again"))


@R.add("""WITH n AS (SELECT 'supp:' || s_suppkey AS id, s_nationkey AS nation FROM supplier WHERE s_acctbal > 0)
SELECT 'repo:' || nation AS repo_id, id AS src, dst FROM n JOIN (SELECT DISTINCT 'supp:' || l_suppkey AS src, 'supp:' || (l_suppkey + 1) AS dst FROM lineitem) e ON e.src = n.id WHERE dst IN (SELECT id FROM n)""")
def graph_sink(t: Tables) -> DataFrame:
    """Edges that were written after their nodes: only those both of whose ends are there."""
    nodes, edges = _store(t, "repo_id string, id string"), _store(t, "repo_id string, src string, dst string", "src", "dst")
    own = t.supplier.select(node_id("repo", "s_nationkey").alias("repo_id"), node_id("supp", "s_suppkey").alias("id"), "s_suppkey", "s_acctbal")
    links = t.lineitem.select("l_suppkey").distinct().join(own, F.col("l_suppkey") == F.col("s_suppkey")).select("repo_id", F.col("id").alias("src"), F.concat(F.lit("supp:"), F.col("s_suppkey") + 1).alias("dst"))
    write_graph(nodes, edges, own.where("s_acctbal > 0").select("repo_id", "id"), links, "1")
    return edges.read()


QUERIES, SQL = R.queries, R.sql
