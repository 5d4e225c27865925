"""Repository catalogue, context, statistics, coverage, relationships, overviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import count_if, sorted_set
from ..sources import tables as S
from ..sources.tables import Tables, node_id
from .registry import Registry

R = Registry()


@R.add("SELECT n_nationkey, n_name, r_name AS tier FROM nation JOIN region ON n_regionkey = r_regionkey")
def catalog_list(t: Tables) -> DataFrame:
    return t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", F.col("r_name").alias("tier"))


@R.add("SELECT DISTINCT n_nationkey, n_name FROM nation WHERE n_name ILIKE '%on_1%' ORDER BY n_name LIMIT 100")
def bundle_search(t: Tables) -> DataFrame:
    return t.nation.where(F.col("n_name").ilike("%on_1%")).select("n_nationkey", "n_name").distinct().orderBy("n_name").limit(100)


@R.add("""SELECT n_nationkey, count(*) AS matches, min(s_suppkey) AS scope FROM nation JOIN supplier ON s_nationkey = n_nationkey
WHERE 'repo:' || n_nationkey IN ('repo:1', 'repo:7') OR n_name IN ('CHINA', 'NATION_3') OR s_name = 'Supplier#000000001' GROUP BY 1""")
def selector_resolution(t: Tables) -> DataFrame:
    """Repositories that a selector fits by any of id, name or scope, with the number of matches that tells ambiguity."""
    both = t.nation.join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey"))
    fits = node_id("repo", "n_nationkey").isin("repo:1", "repo:7") | F.col("n_name").isin("CHINA", "NATION_3") | (F.col("s_name") == "Supplier#000000001")
    return both.where(fits).groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("matches"), F.min("s_suppkey").alias("scope"))


@R.add("SELECT source AS repo, lang, count(*) AS files FROM documents GROUP BY 1, 2")
def language_repo_counts(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.col("source").alias("repo"), "lang").agg(F.count(F.lit(1)).alias("files"))


@R.add("SELECT lang, count(*) AS files, sum(n_chars)::BIGINT AS chars, count(DISTINCT source) AS repos FROM documents GROUP BY 1")
def language_distribution(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("chars"), F.count_distinct("source").alias("repos"))


@R.add("SELECT split_part(url, '/', 3) AS dir, split_part(url, '/', 4) AS lang, count(*) AS files FROM pages GROUP BY 1, 2")
def language_dir_counts(t: Tables) -> DataFrame:
    """Files by directory (host) and language (first segment)."""
    return t.pages.groupBy(F.split_part("url", F.lit("/"), F.lit(3)).alias("dir"), F.split_part("url", F.lit("/"), F.lit(4)).alias("lang")).agg(F.count(F.lit(1)).alias("files"))


@R.add("SELECT doc_id, source AS repo, CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french' WHEN 'es' THEN 'spanish' ELSE 'other' END AS language FROM documents WHERE text LIKE '%token%'")
def language_entities(t: Tables) -> DataFrame:
    """Entities that hold a word, with their language's full name."""
    name = F.when(F.col("lang") == "en", "english").when(F.col("lang") == "de", "german").when(F.col("lang") == "fr", "french").when(F.col("lang") == "es", "spanish").otherwise("other")
    return t.documents.where(F.contains("text", F.lit("token"))).select("doc_id", F.col("source").alias("repo"), name.alias("language"))


@R.add("SELECT page_id, CASE WHEN ends_with(p, '.html') THEN 'html' WHEN ends_with(p, '/') THEN 'directory' WHEN contains(url, '?') THEN 'query' ELSE 'plain' END AS language FROM (SELECT page_id, url, split_part(split_part(url, '#', 1), '?', 1) AS p FROM pages)")
def language_detect(t: Tables) -> DataFrame:
    """Kind of a file by the end of its path: the first suffix that fits."""
    p = F.split_part(F.split_part("url", F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))
    kind = F.when(F.endswith(p, F.lit(".html")), "html").when(F.endswith(p, F.lit("/")), "directory").when(F.contains("url", F.lit("?")), "query").otherwise("plain")
    return t.pages.select("page_id", kind.alias("language"))


@R.add("""SELECT s_nationkey, count(DISTINCT l_orderkey) AS files, count(DISTINCT l_partkey) AS entities, count(DISTINCT p_type) AS entity_types, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def repo_stats(t: Tables) -> DataFrame:
    """Exact counts of files, entities and entity types of each repository.

    Pairs are made distinct before parts are joined, so no line is expanded for each of the counts.
    """
    known = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi")
    lines = known.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    files = lines.select("s_nationkey", "l_orderkey").distinct().groupBy("s_nationkey").agg(F.count("l_orderkey").alias("files"))
    pairs = lines.select("s_nationkey", "l_partkey").distinct()
    entities = pairs.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("s_nationkey", "p_type").agg(F.count_distinct("l_partkey").alias("n"))
    kinds = entities.groupBy("s_nationkey").agg(F.sum("n").alias("entities"), F.count("p_type").alias("entity_types"), sorted_set("p_type").alias("types"))
    return files.join(kinds, F.equal_null(files["s_nationkey"], kinds["s_nationkey"])).select(files["s_nationkey"], "files", "entities", "entity_types", "types")


@R.add(f"WITH {S.NODES} SELECT count(*) FILTER (WHERE label = 'Repository') AS repositories, count(*) FILTER (WHERE label = 'Workload') AS workloads, count(*) FILTER (WHERE label = 'Tier') AS tiers, count(*) FILTER (WHERE label = 'Function') AS functions FROM nodes")
def ecosystem_overview(t: Tables) -> DataFrame:
    """Counts by label in one pass."""
    label = F.col("label")
    return S.nodes(t).agg(*[count_if(label == x).alias(n) for x, n in (("Repository", "repositories"), ("Workload", "workloads"), ("Tier", "tiers"), ("Function", "functions"))])


@R.add("""WITH g AS (SELECT s_nationkey AS k, count(DISTINCT l_partkey) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1),
c AS (SELECT c_nationkey AS k, count(DISTINCT l_partkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT coalesce(g.k, c.k) AS repo, coalesce(g.n, 0) AS graph, coalesce(c.n, 0) AS content, greatest(coalesce(g.n, 0) - coalesce(c.n, 0), 0) AS content_gap, greatest(coalesce(c.n, 0) - coalesce(g.n, 0), 0) AS graph_gap,
CASE WHEN c.n IS NULL THEN 'graph_only' WHEN g.n IS NULL THEN 'content_only' WHEN g.n = c.n THEN 'complete' WHEN g.n < c.n THEN 'graph_partial' ELSE 'content_partial' END AS state FROM g FULL JOIN c ON g.k = c.k""")
def coverage_gaps(t: Tables) -> DataFrame:
    """Entities of each repository in the graph against those in content: gaps both ways and a state."""
    g = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").alias("repo")).agg(F.count_distinct("l_partkey").alias("g"))
    c = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("repo")).agg(F.count_distinct("l_partkey").alias("c"))
    zero = F.lit(0).cast("long")
    state = F.when(F.col("c").isNull(), "graph_only").when(F.col("g").isNull(), "content_only").when(F.col("g") == F.col("c"), "complete").when(F.col("g") < F.col("c"), "graph_partial").otherwise("content_partial")
    both = g.join(c, "repo", "full_outer").withColumn("state", state).withColumn("graph", F.coalesce("g", zero)).withColumn("content", F.coalesce("c", zero))
    return both.select("repo", "graph", "content", F.greatest(F.col("graph") - F.col("content"), zero).alias("content_gap"), F.greatest(F.col("content") - F.col("graph"), zero).alias("graph_gap"), "state")


@R.add(f"WITH {S.DEPENDS_ON} SELECT src AS repo, count(DISTINCT dst) AS dependencies, string_agg(DISTINCT dst, ',' ORDER BY dst) AS names FROM depends_on GROUP BY 1")
def repo_dependencies(t: Tables) -> DataFrame:
    return _depends_on(t).groupBy(F.col("src").alias("repo")).agg(F.count_distinct("dst").alias("dependencies"), sorted_set("dst").alias("names"))


@R.add(f"WITH {S.DEPENDS_ON} SELECT dst AS repo, count(*) AS consumers, sum(n)::BIGINT AS mentions FROM depends_on GROUP BY 1")
def repo_consumers(t: Tables) -> DataFrame:
    return S.depends_on(t).groupBy(F.col("dst").alias("repo")).agg(F.count(F.lit(1)).alias("consumers"), F.sum("n").alias("mentions"))


def _depends_on(t: Tables) -> DataFrame:
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return lines.where("c_nationkey <> s_nationkey").groupBy(node_id("repo", "c_nationkey").alias("src"), node_id("repo", "s_nationkey").alias("dst")).agg(F.count(F.lit(1)).alias("n"))


@R.add(f"WITH {S.DEPENDS_ON} SELECT src, dst, n AS evidence FROM depends_on")
def dependency_edges(t: Tables) -> DataFrame:
    """DEPENDS_ON rows between repositories, first-wins deduplicated, with the lines that speak for them."""
    return _depends_on(t).withColumnRenamed("n", "evidence")


@R.add("""WITH one AS (SELECT s_nationkey AS k, min(s_suppkey) AS w FROM supplier GROUP BY 1 HAVING count(*) = (SELECT min(n) FROM (SELECT count(*) AS n FROM supplier GROUP BY s_nationkey)))
SELECT DISTINCT a.w AS source, b.w AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN one a ON a.k = c_nationkey JOIN one b ON b.k = s_nationkey WHERE a.w <> b.w""")
def unique_endpoint_edges(t: Tables) -> DataFrame:
    """Workload dependencies, only where both repositories have as few workloads as any: one each in the reference's data."""
    per = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("s_suppkey").alias("w"))
    one = F.broadcast(per.join(F.broadcast(per.agg(F.min("n").alias("n"))), "n").select("k", "w"))
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = lines.select("c_nationkey", "s_nationkey").distinct()
    a, b = one.withColumnsRenamed({"k": "ka", "w": "source"}), one.withColumnsRenamed({"k": "kb", "w": "target"})
    return pairs.join(a, F.col("c_nationkey") == F.col("ka")).join(b, F.col("s_nationkey") == F.col("kb")).where("source <> target").select("source", "target").distinct()


@R.add(f"WITH {S.DEPENDS_ON}, names AS (SELECT 'repo:' || n_nationkey AS id, n_name FROM nation) SELECT d.src AS repo, 'outgoing' AS direction, d.dst AS other, n.n_name AS other_name FROM depends_on d LEFT JOIN names n ON n.id = d.dst UNION ALL SELECT d.dst, 'incoming', d.src, n.n_name FROM depends_on d LEFT JOIN names n ON n.id = d.src")
def relationships_in_out(t: Tables) -> DataFrame:
    """Relationships of each repository in both directions, with the other's name looked up once."""
    d = S.depends_on(t)
    both = d.select(F.col("src").alias("repo"), F.lit("outgoing").alias("direction"), F.col("dst").alias("other")).unionByName(d.select(F.col("dst").alias("repo"), F.lit("incoming").alias("direction"), F.col("src").alias("other")))
    names = t.nation.select(node_id("repo", "n_nationkey").alias("other"), F.col("n_name").alias("other_name"))
    return both.join(F.broadcast(names), "other", "left").select("repo", "direction", "other", "other_name")


@R.add(f"WITH {S.DEPENDS_ON} SELECT 'resolved_' || substr(sha1(concat_ws(chr(10), src, dst)), 1, 16) AS resolved_id, s.n_name AS source_name, t.n_name AS target_name, n AS evidence_count FROM depends_on JOIN nation s ON 'repo:' || s.n_nationkey = src JOIN nation t ON 'repo:' || t.n_nationkey = dst")
def evidence_drilldown(t: Tables) -> DataFrame:
    """Resolved relationships with digest ids and the names of both ends."""
    names = t.nation.select(node_id("repo", "n_nationkey").alias("id"), "n_name")
    d = S.depends_on(t).join(F.broadcast(names.withColumnsRenamed({"id": "src", "n_name": "source_name"})), "src").join(F.broadcast(names.withColumnsRenamed({"id": "dst", "n_name": "target_name"})), "dst")
    return d.select(F.concat(F.lit("resolved_"), F.substring(F.sha1(F.concat_ws("\n", "src", "dst").cast("binary")), 1, 16)).alias("resolved_id"), "source_name", "target_name", F.col("n").alias("evidence_count"))


@R.add("SELECT n_name, format('{} defines {} workloads for {} consumers', n_name, count(DISTINCT s_suppkey), (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey)) AS story FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name, n_nationkey")
def story_summary(t: Tables) -> DataFrame:
    """A sentence on each repository from its counts."""
    s = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("w"))
    c = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("u"))
    n = t.nation.withColumn("k", F.col("n_nationkey")).join(s, "k", "left").join(c, "k", "left")
    zero = F.lit(0).cast("long")
    return n.select("n_name", F.format_string("%s defines %d workloads for %d consumers", "n_name", F.coalesce("w", zero), F.coalesce("u", zero)).alias("story"))


@R.add("""SELECT CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'terraform' WHEN p_type IN ('PROMO') THEN 'helm' WHEN p_type IN ('SMALL', 'MEDIUM') THEN 'kubernetes' ELSE 'other' END AS family, p_type AS entity_type, count(*) AS n FROM part GROUP BY 1, 2""")
def family_overview(t: Tables) -> DataFrame:
    """Counts by infrastructure family and entity type."""
    family = F.when(F.col("p_type").isin("ECONOMY", "STANDARD"), "terraform").when(F.col("p_type").isin("PROMO"), "helm").when(F.col("p_type").isin("SMALL", "MEDIUM"), "kubernetes").otherwise("other")
    return t.part.groupBy(family.alias("family"), F.col("p_type").alias("entity_type")).agg(F.count(F.lit(1)).alias("n"))


@R.add(f"WITH {S.EDGES} SELECT dst, count(*) AS n_edges, count(DISTINCT src) AS sources, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM edges WHERE type IN ('DEPENDS_ON', 'USES', 'DEFINES') GROUP BY dst")
def provisioning_candidates(t: Tables) -> DataFrame:
    """Incoming edges of a few types by target, with their sorted distinct types."""
    e = S.edges(t).where(F.col("type").isin("DEPENDS_ON", "USES", "DEFINES"))
    return e.groupBy("dst").agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("src").alias("sources"), sorted_set("type").alias("types"))


@R.add("""WITH refs AS (SELECT c_nationkey AS repo, 'name' AS kind, c_mktsegment AS v FROM customer UNION ALL SELECT s_nationkey, 'host', left(s_name, 10) FROM supplier
UNION ALL SELECT c_nationkey, 'provision', o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT repo, (100 * max((kind = 'provision')::INT) + 15 * max((kind = 'host')::INT) + 5 * max((kind = 'name')::INT) + 3 * count(DISTINCT v) + 10 * count(DISTINCT kind))::BIGINT AS score FROM refs GROUP BY 1""")
def consumer_scores(t: Tables) -> DataFrame:
    """Consumers by three kinds of evidence, merged by repository and scored by fixed weights."""
    names = t.customer.select(F.col("c_nationkey").alias("repo"), F.lit("name").alias("kind"), F.col("c_mktsegment").alias("v"))
    hosts = t.supplier.select(F.col("s_nationkey").alias("repo"), F.lit("host").alias("kind"), F.substring("s_name", 1, 10).alias("v"))
    prov = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("repo"), F.lit("provision").alias("kind"), F.col("o_orderpriority").alias("v"))
    refs = names.unionByName(hosts).unionByName(prov)
    has = lambda k: F.max((F.col("kind") == k).cast("int"))
    # Weights of the kinds of evidence.
    score = 100 * has("provision") + 15 * has("host") + 5 * has("name") + 3 * F.count_distinct("v") + 10 * F.count_distinct("kind")
    return refs.groupBy("repo").agg(score.cast("long").alias("score"))


QUERIES, SQL = R.queries, R.sql
