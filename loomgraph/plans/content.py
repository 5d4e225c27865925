"""Content search, references, and functions over text, urls and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, text as X
from ..operators.relational import count_if, pick
from ..sources.tables import Tables
from .registry import Registry

R = Registry()


@R.add("SELECT doc_id, source FROM documents WHERE text ILIKE '%TOKEN%' ORDER BY doc_id LIMIT 50")
def content_ilike(t: Tables) -> DataFrame:
    """The first fifty files that hold a string, whatever its case."""
    return t.documents.where(F.col("text").ilike("%TOKEN%")).select("doc_id", "source").orderBy("doc_id").limit(50)


@R.add("SELECT doc_id, source FROM documents WHERE contains(text, 'The ')")
def content_like_case(t: Tables) -> DataFrame:
    return t.documents.where(F.contains("text", F.lit("The "))).select("doc_id", "source")


@R.add("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RING%' AND p_size > 10")
def entities_by_name(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_name").ilike("%RING%") & (F.col("p_size") > 10)).select("p_partkey", "p_name")


@R.add("SELECT doc_id, i AS line, a[i] AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS a, UNNEST(range(2, 5)) AS i FROM documents) WHERE i <= len(a)")
def file_lines(t: Tables) -> DataFrame:
    """Lines 2 to 4 of each file."""
    return t.documents.select("doc_id", F.posexplode(F.slice(F.split("text", "\n", -1), 2, 3)).alias("i", "content")).select("doc_id", (F.col("i") + 2).cast("long").alias("line"), "content")


@R.add("SELECT page_id, count(*) AS refs, count(DISTINCT v) AS distinct_refs, min(v) AS first FROM (SELECT page_id, UNNEST(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS v FROM pages) GROUP BY 1")
def reference_lookup(t: Tables) -> DataFrame:
    """The inverted index of references, summed up by page."""
    refs = t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]+)"'), F.lit(1))).alias("v"))
    return refs.groupBy("page_id").agg(F.count(F.lit(1)).alias("refs"), F.count_distinct("v").alias("distinct_refs"), F.min("v").alias("first"))


@R.add("SELECT host, count(*) AS pages, count(DISTINCT path) AS paths FROM (SELECT lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages) GROUP BY 1 HAVING host <> ''")
def hostnames(t: Tables) -> DataFrame:
    parts = t.pages.select(X.hostname("url").alias("host"), X.url_path("url").alias("path"))
    return parts.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count_distinct("path").alias("paths")).where("host <> ''")


@R.add("SELECT token, count(*) AS n FROM (SELECT UNNEST(list_distinct(regexp_extract_all(url, '[a-z0-9]+(?:-[a-z0-9]+)+', 0))) AS token FROM pages) WHERE length(token) BETWEEN 5 AND 100 GROUP BY 1")
def service_tokens(t: Tables) -> DataFrame:
    """Kebab-case names, and in how many pages they are mentioned."""
    tokens = t.pages.select(F.explode(F.array_distinct(F.regexp_extract_all("url", F.lit("[a-z0-9]+(?:-[a-z0-9]+)+"), F.lit(0)))).alias("token"))
    return tokens.where(F.length("token").between(5, 100)).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@R.add("SELECT route, count(DISTINCT page_id) AS pages FROM (SELECT page_id, UNNEST(regexp_extract_all(html, '\"(/[A-Za-z0-9_/.-]+)\"', 1)) AS route FROM pages) GROUP BY 1")
def docs_routes(t: Tables) -> DataFrame:
    """Quoted absolute paths, and how many pages hold them."""
    routes = t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('"(/[A-Za-z0-9_/.-]+)"'), F.lit(1))).alias("route"))
    return routes.groupBy("route").agg(F.count_distinct("page_id").alias("pages"))


@R.add("SELECT page_id, 'https://' || lower(regexp_replace(regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '^https?://(www\\.|m\\.)?', ''), '(\\.html|/)$', '')) AS normal FROM pages")
def url_normalize(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.normal_url("url").alias("normal"))


@R.add("SELECT event_id, cast(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_explode(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@R.add("SELECT k, count(DISTINCT user_id) AS entities FROM (SELECT user_id, UNNEST(json_keys(props)) AS k FROM events) GROUP BY 1")
def jsonb_array_distinct(t: Tables) -> DataFrame:
    """Keys of nested objects exploded and counted distinctly."""
    keys = t.events.select("user_id", F.explode(F.coalesce(F.json_object_keys("props"), F.array().cast("array<string>"))).alias("k"))
    return keys.groupBy("k").agg(F.count_distinct("user_id").alias("entities"))


@R.add("SELECT a.page_id, a.host, a.ancestor, a.depth::INT AS depth FROM (SELECT DISTINCT page_id, host, depth, array_to_string(s[1:depth], '/') AS ancestor FROM (SELECT page_id, host, s, UNNEST(range(1, len(s) + 1)) AS depth FROM (SELECT page_id, split_part(url, '/', 3) AS host, list_filter(string_split(split_part(split_part(url, '#', 1), '?', 1), '/')[4:], lambda x: x <> '') AS s FROM pages))) a")
def directory_chain(t: Tables) -> DataFrame:
    """All ancestor directories of every file."""
    p = t.pages.select("page_id", F.split_part("url", F.lit("/"), F.lit(3)).alias("host"), F.expr("filter(slice(split(split_part(split_part(url, '#', 1), '?', 1), '/'), 4, 1000000), x -> x <> '')").alias("s"))
    each = p.where(F.size("s") > 0).select("page_id", "host", "s", F.explode(F.sequence(F.lit(1), F.size("s"))).alias("depth"))
    return each.select("page_id", "host", F.array_join(F.slice("s", F.lit(1), F.col("depth")), "/").alias("ancestor"), "depth").distinct()


@R.add("SELECT page_id, coalesce(nullif(regexp_extract(url, '/(en|de|fr|es)/', 1), ''), nullif(regexp_extract(url, '[?&]ref=([a-z]+)', 1), ''), 'none') AS env FROM pages")
def env_from_path(t: Tables) -> DataFrame:
    """The environment named by the first pattern that fits a path."""
    return t.pages.select("page_id", X.first_match("url", ["/(en|de|fr|es)/", "[?&]ref=([a-z]+)"], "none").alias("env"))


@R.add("""SELECT doc_id, coalesce(string_agg(DISTINCT env, ',' ORDER BY env), '') AS envs FROM (SELECT doc_id, '_' || regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g') || '_' AS n FROM documents) d
LEFT JOIN (VALUES ('prod', 'prod'), ('production', 'prod'), ('stage', 'stage'), ('staging', 'stage'), ('dev', 'dev'), ('test', 'test'), ('the', 'default'), ('der', 'default')) a(alias, env) ON contains(n, '_' || alias || '_') GROUP BY 1""")
def env_aliases(t: Tables) -> DataFrame:
    """Canonical environments whose aliases a text mentions as whole words."""
    return t.documents.select("doc_id", X.env_names("text", {**X.ENV_ALIASES, "the": "default", "der": "default"}).alias("envs"))


@R.add("""SELECT 'resolved_' || substr(sha1(concat_ws(chr(10), c_name, coalesce(nullif(c_mktsegment, ''), '<none>'))), 1, 16) AS relation_id, sha256(c_name || '|' || c_custkey) AS entity_id, 'repository:r_' || substr(sha1('https://host/' || lower(c_name)), 1, 8) AS repo_id FROM customer""")
def digest_ids(t: Tables) -> DataFrame:
    return t.customer.select(
        ids.short_id("resolved_", ["c_name", "c_mktsegment"], 16).alias("relation_id"),
        F.sha2(F.concat_ws("|", "c_name", F.col("c_custkey").cast("string")), 256).alias("entity_id"),
        F.concat(F.lit("repository:r_"), F.substring(F.sha1(F.concat(F.lit("https://host/"), F.lower("c_name")).cast("binary")), 1, 8)).alias("repo_id"),
    )


@R.add("SELECT (('0x' || substr(sha256(c_name), 1, 16))::UBIGINT % 8)::BIGINT AS part, count(*) AS n FROM customer GROUP BY 1")
def hash_partition(t: Tables) -> DataFrame:
    return t.customer.groupBy(ids.hash_partition("c_name", 8).alias("part")).agg(F.count(F.lit(1)).alias("n"))


@R.add("""WITH d AS (SELECT source AS repo, doc_id || ':' || sha256(coalesce(text, '')) AS one FROM documents), b AS (SELECT repo, substr(sha256(one), 1, 4) AS bucket, sha256(string_agg(one, chr(10) ORDER BY one)) AS digest, count(*) AS n FROM d GROUP BY 1, 2)
SELECT repo, sha256(string_agg(digest, chr(10) ORDER BY bucket)) AS snapshot, sum(n)::BIGINT AS files FROM b GROUP BY 1""")
def snapshot_hash(t: Tables) -> DataFrame:
    """A digest of each repository's files, equal as long as none changed.

    Files are digested in 65,536 buckets by hash, then the buckets' digests in order, so no task gathers a repository.
    """
    one = F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2(F.coalesce("text", F.lit("")), 256))
    each = t.documents.select(F.col("source").alias("repo"), one.alias("one")).withColumn("bucket", F.substring(F.sha2("one", 256), 1, 4))
    digests = each.groupBy("repo", "bucket").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("one")), "\n"), 256).alias("digest"), F.count(F.lit(1)).alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("bucket", "digest"))), lambda x: x["digest"])
    return digests.groupBy("repo").agg(F.sha2(F.array_join(ordered, "\n"), 256).alias("snapshot"), F.sum("n").alias("files"))


@R.add("""SELECT CASE WHEN url LIKE '%utm_source%' THEN 'tracking' WHEN url LIKE '%spam%' OR url LIKE '%cheap%' THEN 'ignored_host' WHEN html IS NULL OR html = '' THEN 'empty' WHEN length(html) > 5000 THEN 'large' ELSE 'kept' END AS reason, count(*) AS files FROM pages GROUP BY 1""")
def scan_prune_stats(t: Tables) -> DataFrame:
    """Files by what prunes them from a scan."""
    reason = F.when(F.contains("url", F.lit("utm_source")), "tracking").when(F.contains("url", F.lit("spam")) | F.contains("url", F.lit("cheap")), "ignored_host").when(F.col("html").isNull() | (F.col("html") == ""), "empty").when(F.length("html") > 5000, "large").otherwise("kept")
    return t.pages.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("files"))


@R.add("""SELECT artifact_type, count(*) AS n FROM (SELECT CASE WHEN contains(text, '{{') THEN 'template' WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '###') THEN 'markup' WHEN regexp_matches(text, '[0-9]{6}') THEN 'numeric' ELSE 'prose' END AS artifact_type FROM documents) GROUP BY 1""")
def artifact_type(t: Tables) -> DataFrame:
    kind = F.when(F.contains("text", F.lit("{{")), "template").when(F.contains("text", F.lit(" | ")), "table").when(F.contains("text", F.lit("###")), "markup").when(F.rlike("text", F.lit("[0-9]{6}")), "numeric").otherwise("prose")
    return t.documents.groupBy(kind.alias("artifact_type")).agg(F.count(F.lit(1)).alias("n"))


_WORDS = "('the'), ('der'), ('que'), ('les')"


@R.add(f"SELECT doc_id, min(a.alias) AS alias, count(*) AS hits FROM documents JOIN (SELECT DISTINCT split_part(p_name, ' ', 1) AS alias FROM part UNION SELECT * FROM (VALUES {_WORDS}) v(alias)) a ON contains(lower(text), a.alias) GROUP BY 1")
def alias_substring_join(t: Tables) -> DataFrame:
    """Texts that mention a catalogue alias anywhere, whatever its case.

    The aliases are the distinct first words of part names, a vocabulary that doesn't grow with the table; they become one
    pattern list per text rather than a join of every text with every alias.
    """
    words = t.part.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("alias")).distinct()
    more = t.spark.createDataFrame([("the",), ("der",), ("que",), ("les",)], "alias string")
    aliases = words.unionByName(more).distinct().agg(F.array_sort(F.collect_set("alias")).alias("aliases")).scalar()
    low = t.documents.select("doc_id", F.lower("text").alias("low"))
    hit = low.withColumn("aliases", aliases).select("doc_id", F.filter("aliases", lambda a: F.contains(F.col("low"), a)).alias("h"))
    return hit.where(F.size("h") > 0).select("doc_id", F.array_min("h").alias("alias"), F.size("h").cast("long").alias("hits"))


@R.add("""SELECT doc_id, count(*) FILTER (WHERE w = 'the') AS n_the, count(*) FILTER (WHERE w = 'of') AS n_of FROM (SELECT doc_id, UNNEST(regexp_extract_all(lower(text), '(?:^|[^a-z])(the|of)[ .]', 1)) AS w FROM documents) GROUP BY 1""")
def sql_mentions(t: Tables) -> DataFrame:
    """Keyword mentions by kind in each text."""
    words = t.documents.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("(?:^|[^a-z])(the|of)[ .]"), F.lit(1))).alias("w"))
    return words.groupBy("doc_id").agg(count_if(F.col("w") == "the").alias("n_the"), count_if(F.col("w") == "of").alias("n_of"))


@R.add("""WITH h AS (SELECT lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1), k AS (SELECT *, regexp_extract(host, '([a-z]+)\\.example', 1) AS stem FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY n DESC, host) AS k FROM k) SELECT stem, host, n FROM r WHERE k <= 4""")
def hostname_affinity(t: Tables) -> DataFrame:
    """The four best hostnames of each service stem."""
    h = t.pages.groupBy(X.hostname("url").alias("host")).agg(F.count(F.lit(1)).alias("n")).withColumn("stem", F.regexp_extract("host", r"([a-z]+)\.example", 1))
    w = Window.partitionBy("stem").orderBy(F.desc("n"), "host")
    return h.withColumn("k", F.row_number().over(w)).where("k <= 4").select("stem", "host", "n")


@R.add("SELECT split_part(url, '/', 4) AS dir, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, dir LIMIT 10")
def top_k_dirs(t: Tables) -> DataFrame:
    return t.pages.groupBy(F.split_part("url", F.lit("/"), F.lit(4)).alias("dir")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dir").limit(10)


@R.add("SELECT host AS endpoint, count(*) AS n, string_agg(DISTINCT seg, ',' ORDER BY seg) AS segments FROM (SELECT split_part(url, '/', 3) AS host, split_part(url, '/', 4) AS seg FROM pages) GROUP BY 1")
def endpoint_merge(t: Tables) -> DataFrame:
    """Endpoints merged by id: list fields united, sorted and distinct."""
    p = t.pages.select(F.split_part("url", F.lit("/"), F.lit(3)).alias("endpoint"), F.array(F.split_part("url", F.lit("/"), F.lit(4))).alias("s"))
    return p.groupBy("endpoint").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("s")))), ",").alias("segments"))


@R.add("SELECT kind, p_brand, count(*) AS n FROM (SELECT p_brand, CASE WHEN p_name LIKE '%bolt%' THEN 'cronjob' WHEN p_name LIKE '%gear%' THEN 'worker' WHEN p_name LIKE '%ring%' THEN 'consumer' WHEN p_name LIKE '%widget%' THEN 'batch' ELSE 'service' END AS kind FROM part) GROUP BY 1, 2")
def workload_kind(t: Tables) -> DataFrame:
    """Kind of a workload by the first word that its name holds."""
    kind = X.first_word("p_name", [("bolt", "cronjob"), ("gear", "worker"), ("ring", "consumer"), ("widget", "batch")], "service")
    return t.part.groupBy(kind.alias("kind"), "p_brand").agg(F.count(F.lit(1)).alias("n"))


@R.add("""SELECT p_partkey, 'platform:' || lower(p_type) || ':' || lower(replace(p_brand, '#', '')) || ':' || replace(p_name, ' ', '-') || ':' || (CASE WHEN p_size > 40 THEN 'prod' ELSE 'none' END) || ':none' AS platform_id FROM part""")
def platform_ids(t: Tables) -> DataFrame:
    env = F.when(F.col("p_size") > 40, "prod")
    return t.part.select("p_partkey", ids.platform_id(F.lower("p_type"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.replace("p_name", F.lit(" "), F.lit("-")), env, F.lit(None).cast("string")).alias("platform_id"))


@R.add("SELECT family, count(*) AS n, min(p_partkey) AS first FROM (SELECT p_partkey, CASE WHEN p_name LIKE '%bolt%' THEN 'ecs' WHEN p_name LIKE '%gear%' THEN 'eks' WHEN p_type = 'PROMO' THEN 'lambda' WHEN p_brand LIKE 'Brand#1%' THEN 'gke' ELSE 'none' END AS family FROM part) GROUP BY 1")
def family_inference(t: Tables) -> DataFrame:
    """Runtime family by the first pattern of the table that fits."""
    family = F.when(F.contains("p_name", F.lit("bolt")), "ecs").when(F.contains("p_name", F.lit("gear")), "eks").when(F.col("p_type") == "PROMO", "lambda").when(F.startswith("p_brand", F.lit("Brand#1")), "gke").otherwise("none")
    return t.part.groupBy(family.alias("family")).agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first"))


@R.add("SELECT p_name, p_brand FROM (SELECT p_name, p_brand, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part) WHERE k = 1")
def module_dedupe(t: Tables) -> DataFrame:
    """Modules are one by name across repositories: the first wins."""
    return pick(t.part, ["p_name"], ["p_partkey"]).select("p_name", "p_brand")


QUERIES, SQL = R.queries, R.sql
