"""Infrastructure artifacts judged one by one, and cloud assets that share identity keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.reachability import reachability
from ..operators.identity import identity_groups, key_clashes
from ..sources.files import language_of
from ..sources.tables import Tables
from .registry import Registry

R = Registry()


def _artifact_files(t: Tables) -> DataFrame:
    """An artifact for each part, of a family by its key, and a file that refers to one for each line of a single piece: outright, by a variable, or by a name's beginning."""
    def family(c: str, *of: str):
        k = F.col(c) % 3
        return F.when(k == 0, F.lit(of[0])).when(k == 1, F.lit(of[1])).otherwise(F.lit(of[2]))

    name = lambda c: F.concat(F.lit("m"), F.col(c).cast("string"))
    own = t.part.select(F.concat(F.lit("repo:"), F.col("p_size")).alias("repo_id"), F.concat(family("p_partkey", "modules/", "charts/", "base/"), name("p_partkey"), family("p_partkey", "/main.tf", "/Chart.yaml", "/kustomization.yaml")).alias("path"), F.lit("x: 1").alias("content"))
    flag, part = F.col("l_returnflag"), name("l_partkey")
    target = F.when(flag == "R", part).when(flag == "A", F.lit("${var.which}")).otherwise(F.concat(part, F.lit("${var.which}")))
    said = F.concat(family("l_partkey", 'source = "../lib/modules/', "path: charts/", "path: ../base/"), target, family("l_partkey", '"', "", ""), F.when(flag == "A", F.concat(F.lit("\nwhich = "), part)).otherwise(F.lit("")), F.lit("\n"))
    users = t.lineitem.where("l_quantity = 1").select(F.concat(F.lit("user:"), F.col("l_suppkey")).alias("repo_id"), F.concat_ws("/", F.lit("use"), "l_orderkey", "l_linenumber", "l_partkey", F.lit("f.txt")).alias("path"), said.alias("content"))
    return own.unionByName(users).withColumn("language", language_of("path"))


_REACHED = """refs AS (SELECT DISTINCT l_partkey % 3 AS family, l_returnflag AS form, 'm' || l_partkey AS name FROM lineitem WHERE l_quantity = 1),
judged AS (SELECT p_partkey, p_size, CASE p_partkey % 3 WHEN 0 THEN 'terraform' WHEN 1 THEN 'helm' ELSE 'kustomize' END AS family, 'm' || p_partkey AS name,
  CASE WHEN EXISTS (SELECT 1 FROM refs r WHERE r.family = p_partkey % 3 AND r.form = 'R' AND r.name = 'm' || p_partkey) THEN 'used'
       WHEN EXISTS (SELECT 1 FROM refs r WHERE r.family = p_partkey % 3 AND r.form = 'A' AND r.name = 'm' || p_partkey) THEN 'ambiguous'
       WHEN EXISTS (SELECT 1 FROM refs r WHERE r.family = p_partkey % 3 AND r.form = 'N' AND starts_with('m' || p_partkey, r.name)) THEN 'ambiguous' ELSE 'unused' END AS reachability FROM part)"""


@R.add(f"WITH {_REACHED} SELECT family, 'repo:' || p_size AS repo_id, name, reachability, CASE reachability WHEN 'used' THEN 0.99 WHEN 'ambiguous' THEN 0.4 ELSE 0.75 END::DOUBLE AS confidence FROM judged")
def artifact_reachability(t: Tables) -> DataFrame:
    """Each module, chart and folder: used, ambiguous by an interpolated reference, or unused."""
    return reachability(_artifact_files(t)).select("family", "repo_id", "name", "reachability", "confidence")


@R.add(f"""WITH {_REACHED} SELECT family, 'repo:' || p_size AS repo_id, count(*) FILTER (WHERE reachability = 'unused') AS unused, count(*) FILTER (WHERE reachability = 'ambiguous') AS ambiguous, count(*) AS artifacts
FROM judged GROUP BY ALL HAVING count(*) FILTER (WHERE reachability <> 'used') > 0""")
def artifact_cleanup(t: Tables) -> DataFrame:
    """Repositories with artifacts to clean up, by family: the unused ones and those that a person must look at."""
    r = reachability(_artifact_files(t)).groupBy("family", "repo_id").agg(F.count(F.when(F.col("reachability") == "unused", 1)).alias("unused"), F.count(F.when(F.col("reachability") == "ambiguous", 1)).alias("ambiguous"), F.count(F.lit(1)).alias("artifacts"))
    return r.where("unused + ambiguous > 0")


# A customer is an asset seen by several collectors: a name that neighbours share, an arn of the next ones where its balance is positive, a tag in one nation and segment.
_KEYS = """keys AS (SELECT c_custkey AS e, 'name' AS kind, (c_custkey // 3)::VARCHAR AS k FROM customer
  UNION ALL SELECT c_custkey, 'arn', ((c_custkey + 1) // 4)::VARCHAR FROM customer WHERE c_acctbal > 3000
  UNION ALL SELECT c_custkey, 'tag', c_nationkey || c_mktsegment FROM customer WHERE c_nationkey = 7 AND c_mktsegment = 'BUILDING')"""
_GROUPS = f"""{_KEYS}, reach(e, kind, k) AS (SELECT e, kind, k FROM keys UNION SELECT r.e, b.kind, b.k FROM reach r JOIN keys a ON a.kind = r.kind AND a.k = r.k JOIN keys b ON b.e = a.e),
grouped AS (SELECT r.e AS entity, min(k.e) AS grp FROM reach r JOIN keys k ON k.kind = r.kind AND k.k = r.k GROUP BY r.e)"""


def _identity_keys(t: Tables) -> DataFrame:
    c = t.customer
    key = F.col("c_custkey")
    return (
        c.select(key.alias("entity"), F.lit("name").alias("kind"), F.floor(key / 3).cast("string").alias("key"))
        .unionByName(c.where("c_acctbal > 3000").select(key.alias("entity"), F.lit("arn").alias("kind"), F.floor((key + 1) / 4).cast("string").alias("key")))
        .unionByName(c.where("c_nationkey = 7 AND c_mktsegment = 'BUILDING'").select(key.alias("entity"), F.lit("tag").alias("kind"), F.concat("c_nationkey", "c_mktsegment").alias("key")))
    )


@R.add(f"WITH RECURSIVE {_GROUPS} SELECT entity, grp AS identity FROM grouped")
def asset_identity(t: Tables) -> DataFrame:
    """Assets that chains of shared names, arns and tags make one, by the least of them."""
    return identity_groups(_identity_keys(t)).withColumnRenamed("group", "identity")


@R.add(f"""WITH RECURSIVE {_GROUPS} SELECT grp AS identity, kind, count(DISTINCT k) AS keys, min(k) AS least, max(k) AS most FROM grouped JOIN keys ON e = entity WHERE kind = 'arn' GROUP BY grp, kind HAVING count(DISTINCT k) > 1""")
def asset_key_clashes(t: Tables) -> DataFrame:
    """Identities with more than one arn."""
    keys = _identity_keys(t)
    return key_clashes(keys, identity_groups(keys), ["arn"]).withColumnRenamed("group", "identity")


QUERIES, SQL = R.queries, R.sql
