"""Blast radius, change surface, dependency paths, deployment traces, environment comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.relational import sorted_set
from ..operators.traverse import bounded_bfs, shortest_paths, undirected
from ..session import cut
from ..sources import tables as S
from ..sources.tables import Tables, node_id
from .code import bfs_sql
from .registry import Registry

R = Registry()
_NATION_SEEDS = "SELECT 'repo:' || n_nationkey, 'repo:' || n_nationkey, 0 FROM nation"


def _nation_seeds(t: Tables) -> DataFrame:
    return t.nation.select(node_id("repo", "n_nationkey").alias("seed"), node_id("repo", "n_nationkey").alias("node"))


@R.add(bfs_sql(S.DEPENDS_ON, "(SELECT dst AS src, src AS dst FROM depends_on)", _NATION_SEEDS, 5) + " SELECT b.seed, b.node AS affected, b.depth AS hops, r_name AS tier FROM best b JOIN nation ON 'repo:' || n_nationkey = b.node LEFT JOIN region ON n_regionkey = r_regionkey WHERE b.depth > 0")
def blast_radius_repository(t: Tables) -> DataFrame:
    """Repositories that depend on each repository, up to five hops, with the least number of hops and their tier.

    The reference gives a row for each length of path and a row without repository where nothing depends; here a repository has one row.
    """
    back = S.depends_on(t).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    reach = bounded_bfs(_nation_seeds(t), back, 5).where("depth > 0")
    homes = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select(node_id("repo", "n_nationkey").alias("node"), F.col("r_name").alias("tier"))
    return reach.join(homes, "node").select("seed", F.col("node").alias("affected"), F.col("depth").alias("hops"), "tier")


_MODULE_CTES = S.DEPENDS_ON + """,
homes AS (SELECT p_brand AS module, 'repo:' || s_nationkey AS repo, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
module_seeds AS (SELECT module, arg_max(repo, (n, repo)) AS repo FROM homes GROUP BY 1)"""


@R.add(bfs_sql(_MODULE_CTES, "(SELECT dst AS src, src AS dst FROM depends_on)", "SELECT module, repo, 0 FROM module_seeds", 5) + " SELECT seed AS module, node AS repo, depth AS hops FROM best")
def blast_radius_module(t: Tables) -> DataFrame:
    """From each module (brand) to the repository that holds most of it (0 hops) and what depends on that."""
    homes = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("p_brand").alias("seed"), node_id("repo", "s_nationkey").alias("repo")).agg(F.count(F.lit(1)).alias("n"))
    seeds = homes.groupBy("seed").agg(F.max_by("repo", F.struct("n", "repo")).alias("node"))
    back = S.depends_on(t).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return bounded_bfs(seeds, back, 5).select(F.col("seed").alias("module"), F.col("node").alias("repo"), F.col("depth").alias("hops"))


@R.add("""SELECT p_type AS definition, n_name AS repo, r_name AS tier, count(DISTINCT l_orderkey) AS claims FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3""")
def blast_radius_claims(t: Tables) -> DataFrame:
    """Claims that a definition satisfies, by repository; the tier is that of the repository (the reference joins it to nothing)."""
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    placed = lines.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return placed.groupBy(F.col("p_type").alias("definition"), F.col("n_name").alias("repo"), F.col("r_name").alias("tier")).agg(F.count_distinct("l_orderkey").alias("claims"))


@R.add("""SELECT 'repo:' || s_nationkey AS repo, 0 AS hops FROM supplier UNION SELECT 'repo:' || c_nationkey, 1 FROM customer WHERE c_acctbal < 0
UNION SELECT 'repo:' || s_nationkey, 1 FROM supplier WHERE s_acctbal < 0 UNION SELECT 'repo:' || c_nationkey, 1 FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'""")
def blast_radius_table(t: Tables) -> DataFrame:
    """Repositories around a table by kind of use: distinct rows of several branches, each with its hops."""
    own = t.supplier.select(node_id("repo", "s_nationkey").alias("repo"), F.lit(0).alias("hops"))
    migrates = t.customer.where("c_acctbal < 0").select(node_id("repo", "c_nationkey").alias("repo"), F.lit(1).alias("hops"))
    maps = t.supplier.where("s_acctbal < 0").select(node_id("repo", "s_nationkey").alias("repo"), F.lit(1).alias("hops"))
    asks = t.orders.where("o_orderpriority = '1-URGENT'").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(node_id("repo", "c_nationkey").alias("repo"), F.lit(1).alias("hops"))
    return own.unionByName(migrates).unionByName(maps).unionByName(asks).distinct()


_TIER_SEEDS = "SELECT 'tier:' || r_regionkey, 'tier:' || r_regionkey, 0 FROM region"
_SURFACE = S.EDGES + ", surface AS (SELECT src, dst FROM edges WHERE type IN ('CONTAINS', 'DEFINES', 'DEPENDS_ON'))"


@R.add(bfs_sql(_SURFACE, "surface", _TIER_SEEDS, 8) + f", {S.NODES} SELECT b.seed, n.id, n.name, n.label, b.depth FROM best b JOIN nodes n ON n.id = b.node WHERE n.label IN ('Repository', 'Workload') AND b.depth > 0")
def change_surface(t: Tables) -> DataFrame:
    """Repositories and workloads that a change of each tier reaches over edges of several types, with the least depth."""
    e = S.edges(t).where(F.col("type").isin("CONTAINS", "DEFINES", "DEPENDS_ON"))
    seeds = t.region.select(node_id("tier", "r_regionkey").alias("seed"), node_id("tier", "r_regionkey").alias("node"))
    reach = bounded_bfs(seeds, e, 8).where("depth > 0")
    targets = S.nodes(t).where(F.col("label").isin("Repository", "Workload"))
    return reach.join(targets, reach["node"] == targets["id"]).select("seed", "id", "name", "label", "depth")


@R.add(bfs_sql(S.EDGES + ", back AS (SELECT dst AS src, src AS dst FROM edges WHERE type IN ('USES', 'DEFINES'))", "back", "SELECT 'part:' || p_partkey, 'part:' || p_partkey, 0 FROM part", 2) + " SELECT seed, count(*) FILTER (WHERE depth = 2) AS repositories, min(node) FILTER (WHERE depth = 2) AS first_repository FROM best GROUP BY seed")
def resource_to_code(t: Tables) -> DataFrame:
    """From every resource back over its workloads to repositories: how many, and the first."""
    homes = t.supplier.select(node_id("supp", "s_suppkey").alias("src"), node_id("repo", "s_nationkey").alias("repo"))
    reached = S.uses(t).join(homes, "src").select(F.col("dst").alias("seed"), "repo").distinct()
    counted = reached.groupBy("seed").agg(F.count(F.lit(1)).alias("repositories"), F.min("repo").alias("first_repository"))
    return t.part.select(node_id("part", "p_partkey").alias("seed")).join(counted, "seed", "left").select("seed", F.coalesce("repositories", F.lit(0)).cast("long").alias("repositories"), "first_repository")


@R.add("""SELECT 'part:' || l_partkey AS resource, 'repo:' || s_nationkey AS repo, 'supp:' || min(l_suppkey) AS workload, count(DISTINCT l_suppkey) AS workloads FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_partkey, s_nationkey""")
def resource_chain_hops(t: Tables) -> DataFrame:
    """Each chain from a resource over a workload that uses it to a repository that defines that one: its hops, and how many such chains there are."""
    used = t.lineitem.select("l_partkey", "l_suppkey").distinct().join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    chains = used.groupBy("l_partkey", "s_nationkey").agg(F.min("l_suppkey").alias("first"), F.count(F.lit(1)).alias("workloads"))
    return chains.select(node_id("part", "l_partkey").alias("resource"), node_id("repo", "s_nationkey").alias("repo"), node_id("supp", "first").alias("workload"), "workloads")


@R.add(bfs_sql(S.DEPENDS_ON + ", both_ways AS (SELECT src, dst FROM depends_on UNION SELECT dst, src FROM depends_on)", "both_ways", _NATION_SEEDS, 8) + " SELECT a.n_name AS source, b.n_name AS target, coalesce(best.depth, -1) AS depth FROM nation a CROSS JOIN nation b LEFT JOIN best ON best.seed = 'repo:' || a.n_nationkey AND best.node = 'repo:' || b.n_nationkey WHERE a.n_nationkey < b.n_nationkey")
def dependency_path(t: Tables) -> DataFrame:
    """Shortest undirected dependency path between any two repositories, -1 where there is none.

    The pairs come from a join of the nation table with itself: 25 rows at every scale.
    """
    paths = shortest_paths(_nation_seeds(t), undirected(S.depends_on(t).select("src", "dst")).select("src", "dst"), 8).select("seed", "node", "depth")
    a = t.nation.select(node_id("repo", "n_nationkey").alias("seed"), F.col("n_name").alias("source"), F.col("n_nationkey").alias("ka"))
    b = t.nation.select(node_id("repo", "n_nationkey").alias("node"), F.col("n_name").alias("target"), F.col("n_nationkey").alias("kb"))
    return a.join(F.broadcast(b), F.col("ka") < F.col("kb")).join(paths, ["seed", "node"], "left").select("source", "target", F.coalesce("depth", F.lit(-1)).alias("depth"))


@R.add("""WITH links AS (SELECT l_suppkey, l_returnflag AS env, min(1 - l_discount) AS conf, count(DISTINCT l_partkey) AS resources FROM lineitem GROUP BY 1, 2)
SELECT s_suppkey, s_name AS workload, n_name AS repo, env, round(conf, 6) AS confidence, resources FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN links ON l_suppkey = s_suppkey""")
def deployment_trace(t: Tables) -> DataFrame:
    """Workload, its repository, and its instances by environment with their confidence and resources."""
    links = t.lineitem.groupBy("l_suppkey", F.col("l_returnflag").alias("env")).agg(F.round(F.min(1 - F.col("l_discount")), 6).alias("confidence"), F.count_distinct("l_partkey").alias("resources"))
    homes = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return homes.join(links, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_suppkey", F.col("s_name").alias("workload"), F.col("n_name").alias("repo"), "env", "confidence", "resources")


@R.add("""SELECT s_suppkey, round(coalesce(min(CASE WHEN l_discount > 0 THEN l_discount END), CASE WHEN count(l_orderkey) > 0 THEN 0.9 END, CASE WHEN s_acctbal > 0 THEN 0.75 END, 0.45), 6) AS confidence
FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_acctbal""")
def confidence_ladder(t: Tables) -> DataFrame:
    """Least positive confidence of the instances; else 0.9 with instances, 0.75 with sources, 0.45 with configuration only."""
    by = t.lineitem.groupBy("l_suppkey").agg(F.min(F.when(F.col("l_discount") > 0, F.col("l_discount"))).alias("least"), F.count(F.lit(1)).alias("n"))
    both = t.supplier.join(by, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    value = F.coalesce("least", F.when(F.coalesce("n", F.lit(0)) > 0, F.lit(0.9)), F.when(F.col("s_acctbal") > 0, F.lit(0.75)), F.lit(0.45))
    return both.select("s_suppkey", F.round(value, 6).alias("confidence"))


_ENVS = """l AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_linestatus = 'O'), r AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_linestatus = 'F')"""


@R.add(f"WITH {_ENVS} SELECT coalesce(l.l_suppkey, r.l_suppkey) AS workload, coalesce(l.l_partkey, r.l_partkey) AS resource, CASE WHEN l.l_partkey IS NULL THEN 'added' ELSE 'removed' END AS change FROM l FULL JOIN r ON l.l_suppkey = r.l_suppkey AND l.l_partkey = r.l_partkey WHERE l.l_partkey IS NULL OR r.l_partkey IS NULL")
def env_diff(t: Tables) -> DataFrame:
    """Resources of each workload that only one of two environments has, from one aggregation over both."""
    sides = t.lineitem.where(F.col("l_linestatus").isin("O", "F")).groupBy("l_suppkey", "l_partkey").agg(F.max(F.col("l_linestatus") == "O").alias("left"), F.max(F.col("l_linestatus") == "F").alias("right"))
    return sides.where("NOT (left AND right)").select(F.col("l_suppkey").alias("workload"), F.col("l_partkey").alias("resource"), F.when(F.col("left"), "removed").otherwise("added").alias("change"))


@R.add(f"WITH {_ENVS}, b AS (SELECT coalesce(l.l_suppkey, r.l_suppkey) AS workload, (l.l_partkey IS NOT NULL) AS a, (r.l_partkey IS NOT NULL) AS b FROM l FULL JOIN r ON l.l_suppkey = r.l_suppkey AND l.l_partkey = r.l_partkey) SELECT workload, CASE WHEN NOT bool_or(a) OR NOT bool_or(b) THEN 0.35 WHEN bool_and(a AND b) THEN 1.0 ELSE round(sum((a AND b)::INT)::DOUBLE / count(*), 6) END::DOUBLE AS confidence FROM b GROUP BY 1")
def env_diff_confidence(t: Tables) -> DataFrame:
    """How far a comparison of environments can be trusted: 0.35 if one is only inferred, 1 if both are alike, else the share they have in common."""
    sides = t.lineitem.where(F.col("l_linestatus").isin("O", "F")).groupBy("l_suppkey", "l_partkey").agg(F.max(F.col("l_linestatus") == "O").alias("a"), F.max(F.col("l_linestatus") == "F").alias("b"))
    shared = F.sum((F.col("a") & F.col("b")).cast("int"))
    value = F.when(~F.max("a") | ~F.max("b"), F.lit(0.35)).when(F.min(F.col("a") & F.col("b")), F.lit(1.0)).otherwise(F.round(shared / F.count(F.lit(1)), 6))
    return sides.groupBy(F.col("l_suppkey").alias("workload")).agg(value.alias("confidence"))


@R.add("""SELECT 'supp:' || l_suppkey AS workload, n_name AS repo, r_name AS tier, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS environments, count(DISTINCT l_orderkey) AS files
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3""")
def workload_context(t: Tables) -> DataFrame:
    """Workload, repository, tier, environments and files; lines are aggregated before the dimension joins."""
    used = t.lineitem.groupBy("l_suppkey").agg(sorted_set("l_returnflag").alias("environments"), F.count_distinct("l_orderkey").alias("files"))
    homes = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return used.join(homes, F.col("l_suppkey") == F.col("s_suppkey")).select(node_id("supp", "l_suppkey").alias("workload"), F.col("n_name").alias("repo"), F.col("r_name").alias("tier"), "environments", "files")


@R.add()
def dependency_path_hops(t: Tables) -> DataFrame:
    """The hops of the shortest dependency path between any two repositories: from, to, direction, and the share of the dependant's order lines that the dependency stands on.

    Of equal paths the least by ids. A hop that holds both ways counts as outgoing.
    """
    d = S.depends_on(t)
    share = d.join(d.groupBy("src").agg(F.sum("n").alias("total")), "src").select("src", "dst", (F.col("n") / F.col("total")).alias("confidence"))
    paths = shortest_paths(_nation_seeds(t), undirected(d.select("src", "dst")).select("src", "dst"), 8).where("depth > 0")
    hop = F.explode(F.transform(F.sequence(F.lit(1), F.col("depth")), lambda i: F.struct(i.alias("hop"), F.element_at("path", i).alias("a"), F.element_at("path", i + 1).alias("b"))))
    each = paths.select(F.col("seed").alias("source"), F.col("node").alias("target"), hop.alias("h")).select("source", "target", "h.hop", "h.a", "h.b")
    out = share.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("confidence").alias("there"))
    back = share.select(F.col("src").alias("b"), F.col("dst").alias("a"), F.col("confidence").alias("back"))
    both = each.join(out, ["a", "b"], "left").join(back, ["a", "b"], "left")
    return both.select("source", "target", "hop", F.col("a").alias("from"), F.col("b").alias("to"), F.when(F.col("there").isNotNull(), "outgoing").otherwise("incoming").alias("direction"), F.round(F.coalesce("there", "back"), 9).alias("confidence"))


# Dependencies that large returned lines without discount confirm: few enough that some repositories don't reach others. Their confidence is what is left of the tax.
_STRONG = """strong AS (SELECT 'repo:' || c_nationkey AS src, 'repo:' || s_nationkey AS dst, avg(1 - l_tax) AS confidence
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey AND l_quantity = 50 AND l_discount = 0 AND l_returnflag = 'R' GROUP BY 1, 2)"""


def _strong(t: Tables) -> DataFrame:
    lines = t.lineitem.where("l_quantity = 50 AND l_discount = 0 AND l_returnflag = 'R'").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return lines.where("c_nationkey <> s_nationkey").groupBy(node_id("repo", "c_nationkey").alias("src"), node_id("repo", "s_nationkey").alias("dst")).agg(F.avg(1 - F.col("l_tax")).alias("confidence"))


@R.add(f"""WITH RECURSIVE {_STRONG},
r(seed, node, depth, path) AS (SELECT 'repo:' || n_nationkey, 'repo:' || n_nationkey, 0, ['repo:' || n_nationkey] FROM nation
  UNION ALL SELECT r.seed, e.dst, r.depth + 1, list_append(r.path, e.dst) FROM r JOIN strong e ON e.src = r.node WHERE r.depth < 5 AND NOT list_contains(r.path, e.dst)),
best AS (SELECT seed, node, arg_min(path, (depth, path)) AS path, min(depth) AS depth FROM r WHERE depth > 0 GROUP BY seed, node),
hops AS (SELECT seed, node, depth, array_to_string(path, '>') AS chain, unnest(path[1:-2]) AS src, unnest(path[2:]) AS dst FROM best),
graded AS (SELECT seed, node, depth, chain, round(avg(confidence), 6) AS confidence, round(min(confidence), 6) AS weakest FROM hops JOIN strong USING (src, dst) GROUP BY ALL)
SELECT a.n_name AS source, b.n_name AS target, g.seed IS NOT NULL AS reachable, g.depth::INT AS hops, g.chain, g.confidence, g.weakest
FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey LEFT JOIN graded g ON g.seed = 'repo:' || a.n_nationkey AND g.node = 'repo:' || b.n_nationkey""")
def dependency_path_explained(t: Tables) -> DataFrame:
    """Each pair of repositories: the shortest chain of confirmed dependencies, the average and least confidence of its hops, or that there is none."""
    strong = cut(_strong(t))
    paths = shortest_paths(_nation_seeds(t), strong.select("src", "dst"), 5).where("depth > 0")
    hops = paths.select("seed", "node", "depth", F.array_join("path", ">").alias("chain"), F.explode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("src"), F.slice("path", 2, F.size("path") - 1).alias("dst"))).alias("h"))
    graded = hops.select("seed", "node", "depth", "chain", "h.src", "h.dst").join(strong, ["src", "dst"]).groupBy("seed", "node", "depth", "chain").agg(F.round(F.avg("confidence"), 6).alias("confidence"), F.round(F.min("confidence"), 6).alias("weakest"))
    # Every pair of nations is asked for, 600 at any scale: each nation against an array of all.
    names = t.nation.select(node_id("repo", "n_nationkey").alias("id"), "n_name")
    everyone = F.collect_list(F.struct("id", "n_name")).over(Window.partitionBy(F.lit(0)))
    pairs = names.withColumn("others", everyone).select(F.col("id").alias("a"), F.col("n_name").alias("source"), F.explode("others").alias("o")).where("a <> o.id")
    both = pairs.join(graded, (F.col("a") == F.col("seed")) & (F.col("o.id") == F.col("node")), "left")
    return both.select("source", F.col("o.n_name").alias("target"), F.col("seed").isNotNull().alias("reachable"), F.col("depth").alias("hops"), "chain", "confidence", "weakest")


QUERIES, SQL = R.queries, R.sql
