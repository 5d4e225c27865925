"""Read-only questions, fair schedules, trigram search, shared configuration, overviews and summaries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.relational import count_if, sorted_set
from ..sources import tables as S
from ..sources.tables import Tables, node_id
from .registry import Registry

R = Registry()
#: Of an ad-hoc question: its length, the rows it may return, and words that change data or settings.
MAX_LENGTH, MAX_ROWS = 4096, 1000
_CHANGES = re.compile(r"(?i)\b(?:insert|update|delete|merge|create|drop|alter|truncate|set|reset|cache|refresh|load|call|use|grant|revoke)\b")


def read_only(spark: SparkSession, sql: str, tables: dict[str, DataFrame], rows: int = MAX_ROWS) -> DataFrame:
    """The answer of spark.sql to one SELECT over the given tables, at most `rows` rows of it."""
    bare = re.sub(r"'(?:[^']|'')*'", "''", sql)
    if len(sql) > MAX_LENGTH or ";" in bare.rstrip().rstrip(";") or not re.match(r"(?is)\s*(?:select|with)\b", bare) or _CHANGES.search(bare):
        raise ValueError("only one SELECT of at most 4096 characters is answered")
    return spark.sql(sql, **tables).limit(rows)


@R.add("SELECT p_brand, count(*) AS n, avg(p_size)::DOUBLE AS size FROM part GROUP BY 1 ORDER BY 1 LIMIT 1000")
def adhoc_readonly(t: Tables) -> DataFrame:
    return read_only(t.spark, "SELECT p_brand, count(*) AS n, avg(p_size) AS size FROM {part} GROUP BY p_brand ORDER BY p_brand", {"part": t.part})


_SHARE = {"error": 5, "purchase": 3, "click": 2}


@R.add("""WITH r AS (SELECT event_id, event_type AS family, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k, CASE event_type WHEN 'error' THEN 5 WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 ELSE 1 END AS w FROM events)
SELECT event_id, family, ((k - 1) // w + 1)::BIGINT AS round, round(k::DOUBLE / w, 6) AS finish FROM r""")
def fair_schedule(t: Tables) -> DataFrame:
    """Weighted fair order of families: in each round a family has as many turns as its weight; inside, oldest first.

    Turns are given by rank and weight, so no generator runs over all items one by one.
    """
    weight = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in _SHARE.items()], F.lit(1))
    k = F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id"))
    r = t.events.select("event_id", F.col("event_type").alias("family"), k.alias("k"), weight.alias("w"))
    return r.select("event_id", "family", (F.floor((F.col("k") - 1) / F.col("w")) + 1).cast("long").alias("round"), F.round(F.col("k") / F.col("w"), 6).alias("finish"))


def trigrams(c: str):
    """Distinct lower-case trigrams of a column."""
    low = F.lower(c)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda i: F.substr(low, i, F.lit(3))))


@R.add("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%widg%'")
def trigram_search(t: Tables) -> DataFrame:
    """Substring search over an inverted table of trigrams: entities with all trigrams of the words looked for, then verified.

    Names repeat, so the inverted table is one of distinct names.
    """
    looked_for = "widg"
    grams = {looked_for[i : i + 3] for i in range(len(looked_for) - 2)}
    names = t.part.select("p_name").distinct()
    index = names.select("p_name", F.explode(trigrams("p_name")).alias("g")).where(F.col("g").isin(*grams))
    hits = index.groupBy("p_name").agg(F.count_distinct("g").alias("n")).where(F.col("n") == len(grams)).where(F.col("p_name").ilike(f"%{looked_for}%")).select("p_name")
    return t.part.join(hits, "p_name", "left_semi").select("p_partkey", "p_name")


@R.add("SELECT p_name AS path, count(DISTINCT p_brand) AS repos, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS shared_by FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def shared_config_paths(t: Tables) -> DataFrame:
    """Configuration paths that several repositories have."""
    return t.part.groupBy(F.col("p_name").alias("path")).agg(F.count_distinct("p_brand").alias("repos"), sorted_set("p_brand").alias("shared_by")).where("repos > 1")


@R.add("SELECT split_part(url, '/', 3) AS service, count(*) AS endpoints, count(DISTINCT split_part(url, '/', 4)) AS methods, count(*) FILTER (WHERE url LIKE '%?%') AS with_query, count(*) FILTER (WHERE url LIKE 'https:%') AS secure FROM pages GROUP BY 1")
def api_surface(t: Tables) -> DataFrame:
    """Endpoints of each service and how they are reached."""
    url = F.col("url")
    return t.pages.groupBy(F.split_part("url", F.lit("/"), F.lit(3)).alias("service")).agg(F.count(F.lit(1)).alias("endpoints"), F.count_distinct(F.split_part("url", F.lit("/"), F.lit(4))).alias("methods"), count_if(F.contains(url, F.lit("?"))).alias("with_query"), count_if(F.startswith(url, F.lit("https:"))).alias("secure"))


@R.add("SELECT lang, source, count(*) AS files, count(*) FILTER (WHERE contains(text, chr(10))) AS multi_line, count(*) FILTER (WHERE regexp_matches(text, '[0-9]')) AS with_digits FROM documents GROUP BY 1, 2")
def semantic_overview(t: Tables) -> DataFrame:
    """Semantic traits of entities by language and repository."""
    return t.documents.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("files"), count_if(F.contains("text", F.lit("\n"))).alias("multi_line"), count_if(F.rlike("text", F.lit("[0-9]"))).alias("with_digits"))


@R.add(f"WITH {S.DEPENDS_ON} SELECT d.src AS repo, d.dst AS source, s.s_suppkey AS workload FROM depends_on d JOIN supplier s ON 'repo:' || s.s_nationkey = d.dst")
def deployment_sources(t: Tables) -> DataFrame:
    """Workloads of the repositories that a repository is deployed from."""
    d = S.depends_on(t).select(F.col("src").alias("repo"), F.col("dst").alias("source"))
    w = t.supplier.select(node_id("repo", "s_nationkey").alias("source"), F.col("s_suppkey").alias("workload"))
    return d.join(w, "source").select("repo", "source", "workload")


@R.add("""WITH kinds AS (SELECT l_suppkey AS workload, l_shipdate::DATE AS day, l_returnflag AS kind FROM lineitem) SELECT workload, kind, count(*) AS artifacts, min(day) AS first, max(day) AS last FROM kinds GROUP BY 1, 2""")
def delivery_paths(t: Tables) -> DataFrame:
    """Delivery artifacts of each workload by kind, with the first and the last day."""
    return t.lineitem.groupBy(F.col("l_suppkey").alias("workload"), F.col("l_returnflag").alias("kind")).agg(F.count(F.lit(1)).alias("artifacts"), F.min(F.col("l_shipdate").cast("date")).alias("first"), F.max(F.col("l_shipdate").cast("date")).alias("last"))


@R.add(f"""WITH {S.EDGES}, shown AS (SELECT DISTINCT src FROM edges WHERE type = 'DEPENDS_ON')
SELECT type, count(*) AS n, count(DISTINCT src) AS sources, count(*) FILTER (WHERE src IN (SELECT src FROM shown)) AS already_shown FROM edges GROUP BY 1""")
def relationship_overview(t: Tables) -> DataFrame:
    """Edges by type, and how many of them start where a group already shown does."""
    e = S.edges(t)
    shown = e.where("type = 'DEPENDS_ON'").select("src").distinct().withColumn("shown", F.lit(True))
    return e.join(shown, "src", "left").groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src").alias("sources"), F.count("shown").alias("already_shown"))


@R.add("""SELECT id, max_by(v, pri) AS value, count(*) AS sources FROM (SELECT c_nationkey AS id, c_mktsegment AS v, 2000000000 - c_custkey AS pri FROM customer UNION ALL SELECT s_nationkey, s_name, -s_suppkey FROM supplier) GROUP BY 1""")
def metadata_enrichment(t: Tables) -> DataFrame:
    """A property of each node from several sources: what is there already wins, then the first of the next source."""
    a = t.customer.select(F.col("c_nationkey").alias("id"), F.col("c_mktsegment").alias("v"), (F.lit(2_000_000_000) - F.col("c_custkey")).alias("pri"))
    b = t.supplier.select(F.col("s_nationkey").alias("id"), F.col("s_name").alias("v"), (-F.col("s_suppkey")).alias("pri"))
    return a.unionByName(b).groupBy("id").agg(F.max_by("v", "pri").alias("value"), F.count(F.lit(1)).alias("sources"))


@R.add("SELECT doc_id, CASE WHEN regexp_matches(text, '(^|[^a-z])the ') THEN 'inferred' WHEN contains(text, 'der ') THEN 'mentioned' ELSE 'none' END AS provenance FROM documents")
def env_provenance(t: Tables) -> DataFrame:
    """Where an inferred environment comes from: evidence texts that name it."""
    kind = F.when(F.rlike("text", F.lit("(^|[^a-z])the ")), "inferred").when(F.contains("text", F.lit("der ")), "mentioned").otherwise("none")
    return t.documents.select("doc_id", kind.alias("provenance"))


@R.add("""WITH cur AS (SELECT DISTINCT ON (user_id) user_id, event_id FROM events ORDER BY user_id, ts DESC, event_id DESC), old AS (SELECT DISTINCT user_id, event_type FROM events)
SELECT o.user_id, o.event_type AS retracted FROM old o WHERE NOT EXISTS (SELECT 1 FROM cur c JOIN events e ON e.event_id = c.event_id WHERE c.user_id = o.user_id AND e.event_type = o.event_type)""")
def retract_edges(t: Tables) -> DataFrame:
    """Edges of earlier generations that the current one no longer has."""
    cur = t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))
    return t.events.select("user_id", "event_type").distinct().join(cur, ["user_id", "event_type"], "left_anti").withColumnRenamed("event_type", "retracted")


QUERIES, SQL = R.queries, R.sql
