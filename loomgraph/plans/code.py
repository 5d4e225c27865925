"""Symbol search, callers and callees, call chains, dead code, complexity, entity resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.relational import page, pick, sorted_set
from ..operators.traverse import bounded_bfs, reversed_edges, shortest_paths_to
from ..sources import tables as S
from ..sources.tables import Tables, node_id
from .registry import Registry

R = Registry()


def _seeds(t: Tables) -> DataFrame:
    """The search set: every hundredth id of the part table, by keys."""
    key = F.col("p_partkey").cast("long")
    return t.part.where("p_partkey % 100 = 0").select(key.alias("seed"), key.alias("node"))


def _newest(t: Tables) -> DataFrame:
    """The newest function's key; no row without parts."""
    return t.part.agg(F.max("p_partkey").cast("long").alias("target")).where("target IS NOT NULL")


def _named(found: DataFrame, **columns: str) -> DataFrame:
    """Pairs of a seed and a node that isn't itself, with the ids of the graph."""
    return found.where("depth > 0").select(*[(F.col(c) if c == "depth" else node_id("part", c)).alias(n) for n, c in columns.items()])


def bfs_sql(ctes: str, table: str, seeds: str, depth: int) -> str:
    """CTEs that end in best(seed, node, depth)."""
    return f"""WITH RECURSIVE {ctes},
r(seed, node, depth) AS ({seeds} UNION SELECT r.seed, e.dst, r.depth + 1 FROM r JOIN {table} e ON e.src = r.node WHERE r.depth < {depth}),
best AS (SELECT seed, node, min(depth)::INTEGER AS depth FROM r GROUP BY seed, node)"""


SEED_SQL = "SELECT 'part:' || p_partkey, 'part:' || p_partkey, 0 FROM part WHERE p_partkey % 100 = 0"


@R.add("SELECT p_partkey, p_name, p_brand FROM part WHERE p_name = (SELECT min(p_name) FROM part)")
def code_search_exact(t: Tables) -> DataFrame:
    """Symbols by exact name; the name looked for is the first in the catalogue."""
    first = t.part.agg(F.min("p_name").alias("p_name"))
    return t.part.join(F.broadcast(first), "p_name").select("p_partkey", "p_name", "p_brand")


@R.add("""SELECT p_partkey, p_name, count(DISTINCT l_orderkey) AS files FROM part JOIN lineitem ON l_partkey = p_partkey
WHERE contains(p_name, 'ring') AND contains(p_type, 'ECON') GROUP BY ALL ORDER BY p_name, p_partkey LIMIT 50""")
def code_search_fuzzy(t: Tables) -> DataFrame:
    """Symbols by case-sensitive substring, with the number of files they are in: the first fifty by name."""
    hits = t.part.where(F.contains("p_name", F.lit("ring")) & F.contains("p_type", F.lit("ECON")))
    files = t.lineitem.join(hits, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_partkey", "p_name").agg(F.count_distinct("l_orderkey").alias("files"))
    return files.orderBy("p_name", "p_partkey").limit(50)


@R.add("""SELECT p_partkey, min_by(source, rank) AS source, min(p_name) AS p_name FROM (
  SELECT p_partkey, p_name, 'name' AS source, 0 AS rank FROM part WHERE p_name ILIKE '%BLUE%' OR p_name ILIKE '%bolt%'
  UNION ALL SELECT p_partkey, p_name, 'type', 1 FROM part WHERE p_type ILIKE '%promo%') GROUP BY p_partkey""")
def search_fallback_union(t: Tables) -> DataFrame:
    """Matches by name and by source, each entity once, the name match first."""
    by_name = t.part.where(F.col("p_name").ilike("%BLUE%") | F.col("p_name").ilike("%bolt%")).select("p_partkey", "p_name", F.lit("name").alias("source"), F.lit(0).alias("rank"))
    by_type = t.part.where(F.col("p_type").ilike("%promo%")).select("p_partkey", "p_name", F.lit("type").alias("source"), F.lit(1).alias("rank"))
    return pick(by_name.unionByName(by_type), ["p_partkey"], ["rank"]).select("p_partkey", "source", "p_name")


@R.add(f"WITH {S.CALLS} SELECT dst AS callee, count(*) AS callers, min(src) AS first_caller FROM calls GROUP BY dst")
def direct_callers(t: Tables) -> DataFrame:
    return S.calls(t).groupBy(F.col("dst").alias("callee")).agg(F.count(F.lit(1)).alias("callers"), F.min("src").alias("first_caller"))


@R.add(f"WITH {S.CALLS} SELECT src AS caller, count(*) AS callees, min(dst) AS first_callee FROM calls GROUP BY src")
def direct_callees(t: Tables) -> DataFrame:
    return S.calls(t).groupBy(F.col("src").alias("caller")).agg(F.count(F.lit(1)).alias("callees"), F.min("dst").alias("first_callee"))


@R.add(f"WITH {S.EDGES} SELECT src AS node, dst AS other, type, 'outgoing' AS direction FROM edges UNION ALL SELECT dst, src, type, 'incoming' FROM edges")
def edges_in_out(t: Tables) -> DataFrame:
    """Edges of every node in both directions."""
    e = S.edges(t)
    out = e.select(F.col("src").alias("node"), F.col("dst").alias("other"), "type", F.lit("outgoing").alias("direction"))
    return out.unionByName(e.select(F.col("dst").alias("node"), F.col("src").alias("other"), "type", F.lit("incoming").alias("direction")))


@R.add(bfs_sql(S.CALLS, "(SELECT dst AS src, src AS dst FROM calls)", SEED_SQL, 5) + " SELECT seed, node, depth FROM best WHERE depth > 0")
def transitive_callers(t: Tables) -> DataFrame:
    """Who reaches the seeds by calls, with the least depth, up to five."""
    return _named(bounded_bfs(_seeds(t), reversed_edges(S.call_keys(t)), 5), seed="seed", node="node", depth="depth")


@R.add(bfs_sql(S.CALLS, "calls", SEED_SQL, 5) + " SELECT seed, node, depth FROM best WHERE depth > 0")
def transitive_callees(t: Tables) -> DataFrame:
    """What the seeds reach over all calls, with the least depth, up to five."""
    return _named(bounded_bfs(_seeds(t), S.call_keys(t), 5), seed="seed", node="node", depth="depth")


@R.add(bfs_sql(S.CALLS, "calls", SEED_SQL, 5) + " SELECT seed, node AS target, depth AS hops FROM best WHERE node = (SELECT 'part:' || max(p_partkey) FROM part) AND depth > 0")
def call_chain_shortest(t: Tables) -> DataFrame:
    """Length of the shortest call chain from each seed to the newest function, by one search backwards from that. `call_chain_nodes` gives the chains."""
    back = bounded_bfs(_newest(t).select(F.col("target").alias("seed"), F.col("target").alias("node")), reversed_edges(S.call_keys(t)), 5, ends=_seeds(t).select("node"))
    return _named(back, seed="node", target="seed", hops="depth")


@R.add()
def call_chain_nodes(t: Tables) -> DataFrame:
    """The shortest call chain from each of the search set to the newest function, node by node; of equal chains the least by ids."""
    newest = _newest(t).select(node_id("part", "target").alias("target"))
    seeds = _seeds(t).select(node_id("part", "node").alias("node")).distinct()
    paths = shortest_paths_to(newest, S.calls(t), 5).where("depth > 0").join(seeds, "node", "left_semi")
    return paths.select(F.col("node").alias("seed"), "target", F.col("depth").alias("hops"), F.array_join("path", ">").alias("chain"))


@R.add(bfs_sql(S.CALLS, "calls", SEED_SQL, 10) + " SELECT a.seed, a.node AS reached, a.depth FROM best a WHERE a.depth > 0 AND a.node IN (SELECT dst FROM calls GROUP BY dst HAVING count(*) >= 3)")
def reachable_pairs(t: Tables) -> DataFrame:
    """Pairs of a start and a candidate end (a function that three or more call) that a chain joins."""
    return _named(bounded_bfs(_seeds(t), S.call_keys(t), 10, least_in=3), seed="seed", reached="node", depth="depth")


@R.add(f"WITH {S.CALLS} SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM calls WHERE dst = 'part:' || p_partkey)")
def dead_nodes_anti(t: Tables) -> DataFrame:
    """Functions that nothing calls."""
    called = S.call_lines(t).select(F.col("dst").alias("id")).distinct()
    return t.part.withColumn("id", node_id("part", "p_partkey")).join(called, "id", "left_anti").select("p_partkey", "p_name")


_POLICY_SQL = "CASE WHEN p_size >= 45 THEN 'entrypoint' WHEN p_name LIKE '%test%' OR p_name LIKE 'Test%' THEN 'test' WHEN p_type LIKE 'PROMO%' THEN 'generated' WHEN substr(p_brand, 1, 7) = 'Brand#5' THEN 'public_api' END"


# Calls that an indexer confirmed: those of lines of many pieces. Over all calls no part of the tables is dead; over these many are.
_CONFIRMED = f"confirmed AS (SELECT DISTINCT dst FROM (SELECT l_quantity, {S._LEAD.removeprefix('SELECT ').replace(' FROM lineitem', '')} FROM lineitem) WHERE dst IS NOT NULL AND src <> dst AND l_quantity >= 49)"
_FINDINGS = f"""WITH {_CONFIRMED}, findings AS (SELECT p_partkey, p_name, p_size, {_POLICY_SQL} AS excluded_by FROM part WHERE 'part:' || p_partkey NOT IN (SELECT dst FROM confirmed))"""


def _findings(t: Tables) -> DataFrame:
    """Functions without a confirmed call, and the policy that excludes them from what is reported, null where none does."""
    called = S.call_lines(t, "l_quantity").where("l_quantity >= 49").select(F.col("dst").alias("id")).distinct()
    excluded = F.when(F.col("p_size") >= 45, "entrypoint").when(F.contains("p_name", F.lit("test")) | F.startswith("p_name", F.lit("Test")), "test").when(F.startswith("p_type", F.lit("PROMO")), "generated").when(F.startswith("p_brand", F.lit("Brand#5")), "public_api")
    uncalled = t.part.withColumn("id", node_id("part", "p_partkey")).join(called, "id", "left_anti")
    return uncalled.select("p_partkey", "p_name", "p_size", excluded.alias("excluded_by"))


@R.add(f"{_FINDINGS} SELECT p_partkey, p_name, coalesce(excluded_by, 'dead') AS verdict FROM findings")
def dead_code_findings(t: Tables) -> DataFrame:
    """Every function without a confirmed call: dead, or what keeps it out of the report."""
    return _findings(t).select("p_partkey", "p_name", F.coalesce("excluded_by", F.lit("dead")).alias("verdict"))


@R.add(f"""{_FINDINGS}, kept AS (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS place FROM findings WHERE excluded_by IS NULL)
SELECT p_partkey, p_name, total, CASE WHEN total > 150 THEN 150 END AS next_offset, total > 150 AS truncated FROM kept WHERE place >= 50 AND place < 150""")
def dead_code_page(t: Tables) -> DataFrame:
    """The second page of dead functions by name (offset 50, limit 100), with the total and where the next one begins."""
    kept = _findings(t).where("excluded_by IS NULL")
    total = kept.agg(F.count(F.lit(1)).alias("total"), F.lit("page").alias("of"))
    page = kept.orderBy("p_name", "p_partkey").offset(50).limit(100).withColumn("of", F.lit("page"))
    more = F.col("total") > 150
    return page.join(F.broadcast(total), "of").select("p_partkey", "p_name", "total", F.when(more, F.lit(150)).alias("next_offset"), more.alias("truncated"))


@R.add(f"{_FINDINGS} SELECT coalesce(excluded_by, 'dead') AS verdict, count(*) AS n, min(p_name) AS first_name, sum(p_size)::BIGINT AS lines FROM findings GROUP BY 1")
def dead_code_policies(t: Tables) -> DataFrame:
    """Functions without a confirmed call, by what excludes them."""
    return _findings(t).groupBy(F.coalesce("excluded_by", F.lit("dead")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"), F.min("p_name").alias("first_name"), F.sum("p_size").alias("lines"))


@R.add(f"WITH {S.CALLS} SELECT coalesce({_POLICY_SQL}, 'dead') AS verdict, count(*) AS n FROM part WHERE NOT EXISTS (SELECT 1 FROM calls WHERE dst = 'part:' || p_partkey) GROUP BY 1")
def dead_policy(t: Tables) -> DataFrame:
    """Uncalled functions by what excludes them: entry points, tests, generated code, public interface; else dead."""
    called = S.call_lines(t).select(F.col("dst").alias("id")).distinct()
    uncalled = t.part.withColumn("id", node_id("part", "p_partkey")).join(called, "id", "left_anti")
    reason = (
        F.when(F.col("p_size") >= 45, "entrypoint")
        .when(F.contains("p_name", F.lit("test")) | F.startswith("p_name", F.lit("Test")), "test")
        .when(F.startswith("p_type", F.lit("PROMO")), "generated")
        .when(F.substring("p_brand", 1, 7) == "Brand#5", "public_api")
        .otherwise("dead")
    )
    return uncalled.groupBy(reason.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@R.add(f"WITH {S.NODES}, {S.EDGES} SELECT n.id, n.label FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = n.id) AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.dst = n.id)")
def orphan_nodes(t: Tables) -> DataFrame:
    """Nodes without any edge."""
    e = S.edges(t)
    touched = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    return S.nodes(t).join(touched, "id", "left_anti").select("id", "label")


@R.add(f"""WITH {S.CALLS}, o AS (SELECT src AS id, count(*) AS n_out FROM calls GROUP BY 1), i AS (SELECT dst AS id, count(*) AS n_in FROM calls GROUP BY 1)
SELECT coalesce(o.id, i.id) AS id, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) + coalesce(n_in, 0) AS degree FROM o FULL JOIN i ON o.id = i.id""")
def degree_complexity(t: Tables) -> DataFrame:
    """Distinct callees and callers of each function, in one aggregation over both ends of each call."""
    ends = S.calls(t).select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return ends.groupBy("x.id").agg(F.sum("x.o").alias("n_out"), F.sum("x.i").alias("n_in")).withColumn("degree", F.col("n_out") + F.col("n_in"))


@R.add(f"WITH {S.CALLS} SELECT src AS id, count(*) AS complexity FROM calls GROUP BY src ORDER BY complexity DESC, id LIMIT 25")
def top_complex(t: Tables) -> DataFrame:
    return S.calls(t).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("complexity")).orderBy(F.desc("complexity"), "id").limit(25)


@R.add(f"""WITH {S.NODES}, scored AS (
  SELECT name, id, label, (CASE label WHEN 'Repository' THEN 1000 WHEN 'Workload' THEN 950 WHEN 'Tier' THEN 700 ELSE 500 END) + 50 + (CASE WHEN repo IS NULL THEN 0 ELSE 20 END) AS score FROM nodes)
SELECT name, id, label, score FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, id) AS k FROM scored) WHERE k = 1""")
def resolve_ranked(t: Tables) -> DataFrame:
    """For each name the entity of the highest rank: label rank, and bonuses for an id and a repository."""
    # Ranks by label.
    rank = F.when(F.col("label") == "Repository", 1000).when(F.col("label") == "Workload", 950).when(F.col("label") == "Tier", 700).otherwise(500)
    scored = S.nodes(t).withColumn("score", rank + 50 + F.when(F.col("repo").isNull(), 0).otherwise(20))
    return pick(scored, ["name"], [F.desc("score"), "id"]).select("name", "id", "label", "score")


@R.add("SELECT p_name, count(*) AS candidates, count(*) = 1 AS unambiguous, min(p_partkey) AS first_id FROM part WHERE p_name NOT LIKE '%test%' GROUP BY p_name")
def exact_candidates(t: Tables) -> DataFrame:
    """Exact-name candidates outside tests; a name is resolved only if one is left."""
    return t.part.where(~F.contains("p_name", F.lit("test"))).groupBy("p_name").agg(F.count(F.lit(1)).alias("candidates"), (F.count(F.lit(1)) == 1).alias("unambiguous"), F.min("p_partkey").alias("first_id"))


@R.add(f"""WITH {S.NODES}, {S.EDGES} SELECT n.id, n.name, n.label, coalesce(string_agg(DISTINCT e.type || '>' || split_part(e.dst, ':', 1), ',' ORDER BY e.type || '>' || split_part(e.dst, ':', 1)), '') AS relations
FROM nodes n LEFT JOIN edges e ON e.src = n.id WHERE n.label <> 'Function' GROUP BY ALL""")
def entity_context(t: Tables) -> DataFrame:
    """Each entity with its distinct kinds of outgoing relations."""
    e = S.edges(t).select("src", F.concat("type", F.lit(">"), F.substring_index("dst", ":", 1)).alias("relation"))
    n = S.nodes(t).where("label <> 'Function'")
    return n.join(e, n["id"] == e["src"], "left").groupBy("id", "name", "label").agg(sorted_set("relation").alias("relations"))


@R.add(f"WITH {S.CALLS}, dead AS (SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM calls WHERE dst = 'part:' || p_partkey)) SELECT p_partkey, p_name, (SELECT count(*) FROM dead) AS total, (SELECT count(*) FROM dead) > 125 AS truncated FROM dead ORDER BY p_name, p_partkey LIMIT 100 OFFSET 25")
def dead_artifacts_paged(t: Tables) -> DataFrame:
    """One page of dead functions, with the total and whether more follow."""
    return page(dead_nodes_anti(t), ["p_name", "p_partkey"], 25, 100).select("p_partkey", "p_name", "total", "truncated")


@R.add("""SELECT p_partkey, p_name, coalesce(nullif(p_type, ''), p_brand) AS resource_type FROM part
WHERE (contains(p_name, 'ring') OR contains(p_type, 'ECON') OR contains(p_brand, '#4')) AND p_size >= 10""")
def infra_search(t: Tables) -> DataFrame:
    """Resources by substring of any of several properties."""
    anywhere = F.contains("p_name", F.lit("ring")) | F.contains("p_type", F.lit("ECON")) | F.contains("p_brand", F.lit("#4"))
    return t.part.where(anywhere & (F.col("p_size") >= 10)).select("p_partkey", "p_name", F.coalesce(F.nullif("p_type", F.lit("")), "p_brand").alias("resource_type"))


@R.add(f"WITH {S.NODES}, {S.EDGES} SELECT e.src, e.dst, e.type FROM edges e WHERE e.src IN (SELECT id FROM nodes) AND e.dst IN (SELECT id FROM nodes)")
def edges_endpoint_exists(t: Tables) -> DataFrame:
    """Edges both of whose ends are nodes."""
    ids = S.nodes(t).select("id")
    e = S.edges(t)
    return e.join(ids, e["src"] == ids["id"], "left_semi").join(ids, e["dst"] == ids["id"], "left_semi").distinct()


@R.add("""SELECT p_brand, p_type, p_size, count(*) AS n, min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2, 3 HAVING count(*) = 1""")
def unique_name_resolution(t: Tables) -> DataFrame:
    """(brand, type, size) names that resolve to exactly one part."""
    return t.part.groupBy("p_brand", "p_type", "p_size").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("p_partkey")).where("n = 1")


_SPANS = "spans AS (SELECT conv_id, turn AS start_turn, turn + 1 + length(text) % 5 AS end_turn FROM conversations)"


@R.add(f"""WITH {_SPANS} SELECT conv_id, turn, start_turn, end_turn FROM (
  SELECT c.conv_id, c.turn, s.start_turn, s.end_turn, row_number() OVER (PARTITION BY c.conv_id, c.turn ORDER BY s.end_turn - s.start_turn, s.start_turn, s.end_turn) AS k
  FROM (SELECT DISTINCT conv_id, turn FROM conversations) c JOIN spans s ON c.conv_id = s.conv_id AND c.turn BETWEEN s.start_turn AND s.end_turn) WHERE k = 1""")
def interval_narrowest(t: Tables) -> DataFrame:
    """The narrowest span of the same file that a line lies in; the earliest of equals."""
    spans = t.conversations.select("conv_id", F.col("turn").alias("start_turn"), (F.col("turn") + 1 + F.length("text") % 5).alias("end_turn"))
    lines = t.conversations.select("conv_id", "turn").distinct()
    # Spans hold a few lines, so each goes to the lines it covers; no line meets the spans it lies outside of.
    both = lines.join(spans.withColumn("turn", F.explode(F.sequence("start_turn", "end_turn"))), ["conv_id", "turn"])
    return pick(both, ["conv_id", "turn"], [F.col("end_turn") - F.col("start_turn"), "start_turn", "end_turn"]).select("conv_id", "turn", "start_turn", "end_turn")


@R.add("SELECT a.l_orderkey, a.l_linenumber, min(a.l_partkey) AS caller, min(b.l_partkey) AS callee FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 GROUP BY 1, 2")
def exact_position_join(t: Tables) -> DataFrame:
    """Definitions joined by exact file and line: of each position with that of the next line."""
    a = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("x"))
    b = t.lineitem.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("y"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).groupBy("l_orderkey", "l_linenumber").agg(F.min("x").alias("caller"), F.min("y").alias("callee"))


@R.add("""WITH u3 AS (SELECT p_brand, p_type, p_size, min(p_partkey) AS k FROM part GROUP BY 1, 2, 3 HAVING count(*) = 1),
u2 AS (SELECT p_brand, p_type, min(p_partkey) AS k FROM part GROUP BY 1, 2 HAVING count(*) = 1), u1 AS (SELECT p_type, min(p_partkey) AS k FROM part GROUP BY 1 HAVING count(*) = 1)
SELECT p.p_partkey, coalesce(u3.k, u2.k, u1.k) AS resolved, CASE WHEN u3.k IS NOT NULL THEN 'exact' WHEN u2.k IS NOT NULL THEN 'repo' WHEN u1.k IS NOT NULL THEN 'broad' ELSE 'none' END AS tier
FROM part p LEFT JOIN u3 ON p.p_brand = u3.p_brand AND p.p_type = u3.p_type AND p.p_size = u3.p_size LEFT JOIN u2 ON p.p_brand = u2.p_brand AND p.p_type = u2.p_type LEFT JOIN u1 ON p.p_type = u1.p_type""")
def cascade_resolution(t: Tables) -> DataFrame:
    """Names resolved by the first tier at which they are unique: one aggregation for each tier, joined left."""

    def tier(keys: list[str], name: str) -> DataFrame:
        return t.part.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias(name)).where("n = 1").drop("n")

    p = t.part.select("p_partkey", "p_brand", "p_type", "p_size")
    for keys, name in ((["p_brand", "p_type", "p_size"], "k3"), (["p_brand", "p_type"], "k2"), (["p_type"], "k1")):
        p = p.join(tier(keys, name), keys, "left")
    tiers = F.when(F.col("k3").isNotNull(), "exact").when(F.col("k2").isNotNull(), "repo").when(F.col("k1").isNotNull(), "broad").otherwise("none")
    return p.select("p_partkey", F.coalesce("k3", "k2", "k1").alias("resolved"), tiers.alias("tier"))


@R.add("""WITH tables AS (SELECT p_type AS name, max(p_partkey) AS k FROM part GROUP BY 1), mentions AS (SELECT p_partkey, UNNEST(string_split(p_type, ' ')) AS word FROM part),
words AS (SELECT word, max(p_partkey) AS target FROM mentions GROUP BY 1) SELECT m.p_partkey AS src, w.target AS dst, count(*) AS mentions FROM mentions m JOIN words w ON m.word = w.word WHERE m.p_partkey <> w.target GROUP BY 1, 2""")
def sql_edges(t: Tables) -> DataFrame:
    """References to tables by name: of several entities with a name the last one has it, across repositories."""
    mentions = t.part.select("p_partkey", F.explode(F.split("p_type", " ")).alias("word"))
    last = mentions.groupBy("word").agg(F.max("p_partkey").alias("target"))
    return mentions.join(last, "word").where("p_partkey <> target").groupBy(F.col("p_partkey").alias("src"), F.col("target").alias("dst")).agg(F.count(F.lit(1)).alias("mentions"))


@R.add("""WITH bases AS (SELECT p_brand, p_type, min(p_partkey) AS base FROM part GROUP BY 1, 2) SELECT p.p_partkey AS child, b.base AS parent FROM part p JOIN bases b ON p.p_brand = b.p_brand AND p.p_type = b.p_type WHERE p.p_partkey <> b.base""")
def inheritance_edges(t: Tables) -> DataFrame:
    """INHERITS: to the first entity of the same repository and base name."""
    w = Window.partitionBy("p_brand", "p_type")
    return t.part.select(F.col("p_partkey").alias("child"), F.min("p_partkey").over(w).alias("parent")).where("child <> parent")


@R.add("SELECT s_suppkey AS service, c_custkey AS deployment FROM supplier JOIN customer ON s_nationkey = c_nationkey AND split_part(s_name, '#', 2) = split_part(c_name, '#', 2)")
def k8s_selects(t: Tables) -> DataFrame:
    """SELECTS: services (suppliers) to deployments (customers) of the same namespace and name."""
    services = t.supplier.select(F.col("s_suppkey").alias("service"), F.col("s_nationkey").alias("namespace"), F.split_part("s_name", F.lit("#"), F.lit(2)).alias("app"))
    deployments = t.customer.select(F.col("c_custkey").alias("deployment"), F.col("c_nationkey").alias("namespace"), F.split_part("c_name", F.lit("#"), F.lit(2)).alias("app"))
    return services.join(deployments, ["namespace", "app"]).select("service", "deployment")


QUERIES, SQL = R.queries, R.sql
