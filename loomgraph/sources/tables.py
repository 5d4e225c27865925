"""The driver's tables read as a context graph: facts, nodes, typed edges. Each adapter has its SQL twin for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Tables:
    """Tables of one folder, read as they are asked for: tables.part, tables.lineitem, ..."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def node_id(kind: str, key) -> F.Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")


def calls(t: Tables) -> DataFrame:
    """CALLS: a part to the part on the next line of an order; distinct, without loops."""
    return call_lines(t).distinct()


def call_lines(t: Tables, *more: str) -> DataFrame:
    """Each line's call, repeats and all, for those who look at one end only; with other columns of the line if asked for."""
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    pairs = t.lineitem.select(node_id("part", "l_partkey").alias("src"), F.lead(node_id("part", "l_partkey")).over(w).alias("dst"), *more)
    return pairs.where("dst IS NOT NULL AND src <> dst")


def call_keys(t: Tables) -> DataFrame:
    """The same calls by the parts' keys as numbers, which traversals shuffle at a third of the size, with repeats.

    Lines of the same number and part give the same calls in any order, so no other column of LINE_ORDER is read.
    """
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    after = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").withColumn("dst", F.lead("l_partkey").over(w))
    return after.select(F.col("l_partkey").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("dst IS NOT NULL AND src <> dst")


def depends_on(t: Tables) -> DataFrame:
    """DEPENDS_ON: a nation to the foreign nations whose suppliers its customers' order lines come from, with their number."""
    lines = (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .where("c_nationkey <> s_nationkey")
    )
    return lines.groupBy(node_id("repo", "c_nationkey").alias("src"), node_id("repo", "s_nationkey").alias("dst")).agg(F.count(F.lit(1)).alias("n"))


def uses(t: Tables) -> DataFrame:
    """USES: a supplier to the parts it delivers."""
    return t.lineitem.select(node_id("supp", "l_suppkey").alias("src"), node_id("part", "l_partkey").alias("dst")).distinct()


def nodes(t: Tables) -> DataFrame:
    """(id, label, name, repo): tiers (regions), repositories (nations), workloads (suppliers) and functions (parts)."""
    none = F.lit(None).cast("string")
    return (
        t.region.select(node_id("tier", "r_regionkey").alias("id"), F.lit("Tier").alias("label"), F.col("r_name").alias("name"), none.alias("repo"))
        .unionByName(t.nation.select(node_id("repo", "n_nationkey").alias("id"), F.lit("Repository").alias("label"), F.col("n_name").alias("name"), node_id("repo", "n_nationkey").alias("repo")))
        .unionByName(t.supplier.select(node_id("supp", "s_suppkey").alias("id"), F.lit("Workload").alias("label"), F.col("s_name").alias("name"), node_id("repo", "s_nationkey").alias("repo")))
        .unionByName(t.part.select(node_id("part", "p_partkey").alias("id"), F.lit("Function").alias("label"), F.col("p_name").alias("name"), none.alias("repo")))
    )


def edges(t: Tables) -> DataFrame:
    """(src, dst, type) over all nodes: CONTAINS, DEFINES, DEPENDS_ON, USES and CALLS."""
    return (
        t.nation.select(node_id("tier", "n_regionkey").alias("src"), node_id("repo", "n_nationkey").alias("dst"), F.lit("CONTAINS").alias("type"))
        .unionByName(t.supplier.select(node_id("repo", "s_nationkey").alias("src"), node_id("supp", "s_suppkey").alias("dst"), F.lit("DEFINES").alias("type")))
        .unionByName(depends_on(t).select("src", "dst", F.lit("DEPENDS_ON").alias("type")))
        .unionByName(uses(t).select("src", "dst", F.lit("USES").alias("type")))
        .unionByName(calls(t).select("src", "dst", F.lit("CALLS").alias("type")))
    )


# SQL twins, as common table expressions.
_LEAD = "SELECT 'part:' || l_partkey AS src, 'part:' || lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS dst FROM lineitem"
CALLS = f"calls AS (SELECT DISTINCT src, dst FROM ({_LEAD}) WHERE dst IS NOT NULL AND src <> dst)"
DEPENDS_ON = """depends_on AS (
  SELECT 'repo:' || c_nationkey AS src, 'repo:' || s_nationkey AS dst, count(*) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY 1, 2)"""
USES = "uses AS (SELECT DISTINCT 'supp:' || l_suppkey AS src, 'part:' || l_partkey AS dst FROM lineitem)"
NODES = """nodes AS (
  SELECT 'tier:' || r_regionkey AS id, 'Tier' AS label, r_name AS name, NULL::VARCHAR AS repo FROM region
  UNION ALL SELECT 'repo:' || n_nationkey, 'Repository', n_name, 'repo:' || n_nationkey FROM nation
  UNION ALL SELECT 'supp:' || s_suppkey, 'Workload', s_name, 'repo:' || s_nationkey FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'Function', p_name, NULL FROM part)"""
EDGES = f"""{DEPENDS_ON},
{USES},
{CALLS},
edges AS (
  SELECT 'tier:' || n_regionkey AS src, 'repo:' || n_nationkey AS dst, 'CONTAINS' AS type FROM nation
  UNION ALL SELECT 'repo:' || s_nationkey, 'supp:' || s_suppkey, 'DEFINES' FROM supplier
  UNION ALL SELECT src, dst, 'DEPENDS_ON' FROM depends_on
  UNION ALL SELECT src, dst, 'USES' FROM uses
  UNION ALL SELECT src, dst, 'CALLS' FROM calls)"""

