"""API documents with references: JSON documents as variants are opened level by level into pointers, and chains of $ref followed by joins until nothing is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread
from . import yaml_paths

#: Levels of a document that are opened, and references that a chain may have; deeper objects are given as too_deep, longer chains as too_long.
DEPTH, HOPS = 24, 16


def _escaped(key: Column) -> Column:
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def json_nodes(files: DataFrame) -> DataFrame:
    """(repo_id, path, pointer, parent, key, kind, value) of every value in JSON files: kind object, array, scalar or too_deep; value is a scalar's text. Files that don't parse give no rows."""
    texts = spread(files.where(F.endswith("path", F.lit(".json"))).select("repo_id", "path", "content"), "repo_id", "path")
    docs = texts.select("repo_id", "path", F.try_parse_json("content").alias("v")).where("v IS NOT NULL")
    spark = files.sparkSession

    def kinds(level: DataFrame, deep: bool) -> DataFrame:
        shape = F.schema_of_variant("v")
        kind = F.when(F.startswith(shape, F.lit("OBJECT")), "object").when(F.startswith(shape, F.lit("ARRAY")), "array").otherwise("scalar")
        kind = F.when(F.lit(deep) & kind.isin("object", "array"), "too_deep").otherwise(kind)
        return level.select("repo_id", "path", "pointer", "parent", "key", kind.alias("kind"), F.when(kind == "scalar", F.try_variant_get("v", "$", "string")).alias("value"), "v")

    none = F.lit(None).cast("string")
    level = cut(kinds(docs.select("repo_id", "path", F.lit("").alias("pointer"), none.alias("parent"), none.alias("key"), "v"), False))
    out = level.drop("v")
    for depth in range(1, DEPTH + 1):
        open_ = level.where("kind IN ('object', 'array')").select("repo_id", "path", F.col("pointer").alias("parent"), "v")
        if open_.isEmpty():
            break
        inner = open_.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("repo_id", "path", "parent", F.coalesce("key", F.col("pos").cast("string")).alias("key"), F.col("value").alias("v"))
        level = cut(kinds(inner.withColumn("pointer", F.concat("parent", F.lit("/"), _escaped(F.col("key")))), depth == DEPTH))
        out = out.unionByName(level.drop("v"))
    return out


def yaml_nodes(files: DataFrame) -> DataFrame:
    """The same of YAML files, by their key paths; an item of a list has its line for a key."""
    found = yaml_paths.paths(files.where(F.rlike("path", F.lit(r"\.ya?ml$"))).where("content IS NOT NULL")).where("document = 0 AND size(keys) > 0")
    # The k-th [] of the keys is the k-th of the items.
    keys = F.transform("keys", lambda k, i: F.when(k == "[]", F.coalesce(F.get(F.col("items"), F.size(F.filter(F.slice("keys", F.lit(1), i + 1), lambda x: x == "[]")) - 1).cast("string"), F.lit(""))).otherwise(_escaped(k)))
    at = found.select("repo_id", "path", keys.alias("keys"), "value", "kind")
    pointer = lambda c: F.when(F.size(c) > 0, F.concat(F.lit("/"), F.array_join(c, "/"))).otherwise(F.lit(""))
    inner = F.slice("keys", F.lit(1), F.size("keys") - 1)
    kind = F.when(F.col("kind").isin("map", "anchor"), "object").when(F.col("kind") == "too_deep", "too_deep").otherwise("scalar")
    return at.select("repo_id", "path", pointer(F.col("keys")).alias("pointer"), pointer(inner).alias("parent"), F.element_at("keys", -1).alias("key"), kind.alias("kind"), "value").distinct()


def _clean(path: Column) -> Column:
    """A relative path without . and .. parts."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    up = lambda a, p: F.when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/")


def references(nodes: DataFrame) -> DataFrame:
    """(repo_id, path, holder, target_path, target): each $ref, the object that it stands for, and what it points to; of other files relative to its own."""
    said = nodes.where("key = '$ref' AND kind = 'scalar' AND value IS NOT NULL")
    file = F.substring_index("value", "#", 1)
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    target = F.when(F.contains("value", F.lit("#")), F.regexp_replace(F.substring_index("value", "#", -1), "/+$", "")).otherwise(F.lit(""))
    return said.select("repo_id", "path", F.col("parent").alias("holder"), F.when(file == "", F.col("path")).otherwise(_clean(F.concat(F.coalesce(folder, F.lit("")), file))).alias("target_path"), target.alias("target"))


def resolve(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo_id, path, holder, status, target_path, target, hops) of references (see `references`): resolved with the object at the end of the chain, missing with what
    isn't there, cycle with where it closes, or too_long. A round follows one more reference of each chain that isn't over."""
    step = cut(refs.select("repo_id", F.col("path").alias("from_path"), F.col("holder").alias("from"), F.col("target_path").alias("to_path"), F.col("target").alias("to")).distinct())
    there = cut(nodes.where("key IS NULL OR key <> '$ref'").select("repo_id", F.col("path").alias("at_path"), F.col("pointer").alias("at"), F.lit(True).alias("there")).distinct())
    seen = F.array(F.struct(F.col("path").alias("p"), F.col("holder").alias("a")))
    open_ = cut(refs.distinct().select("repo_id", "path", "holder", F.col("target_path").alias("at_path"), F.col("target").alias("at"), F.lit(1).alias("hops"), seen.alias("seen")))
    done = None
    for _ in range(HOPS):
        here = F.struct(F.col("at_path").alias("p"), F.col("at").alias("a"))
        both = open_.join(step.withColumnRenamed("repo_id", "s_repo"), (F.col("repo_id") == F.col("s_repo")) & (F.col("at_path") == F.col("from_path")) & (F.col("at") == F.col("from")), "left")
        both = both.join(there, ["repo_id", "at_path", "at"], "left")
        status = F.when(F.array_contains(F.col("seen"), here), "cycle").when(F.col("to").isNotNull(), "open").when(F.col("there"), "resolved").otherwise("missing")
        moved = cut(both.withColumn("status", status))
        over = moved.where("status <> 'open'").select("repo_id", "path", "holder", "status", F.col("at_path").alias("target_path"), F.col("at").alias("target"), "hops")
        done = over if done is None else done.unionByName(over)
        more = moved.where("status = 'open'")
        open_ = cut(more.select("repo_id", "path", "holder", F.col("to_path").alias("at_path"), F.col("to").alias("at"), (F.col("hops") + 1).alias("hops"), F.concat("seen", F.array(here)).alias("seen")))
        if open_.isEmpty():
            return done
    return done.unionByName(open_.select("repo_id", "path", "holder", F.lit("too_long").alias("status"), F.col("at_path").alias("target_path"), F.col("at").alias("target"), "hops"))


def operation_schemas(resolved: DataFrame) -> DataFrame:
    """(repo_id, path, route, method, place, status, target_path, target, hops) of the references that stand right in an operation; place is where: parameters, requestBody or responses."""
    part = lambda i: F.get(F.split("holder", "/"), F.lit(i))
    own = resolved.where(F.rlike("holder", F.lit(r"^/paths/[^/]+/(?:get|put|post|delete|patch|head|options|trace)/(?:parameters|requestBody|responses)(?:/|$)")))
    route = F.replace(F.replace(part(2), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
    return own.select("repo_id", "path", route.alias("route"), part(3).alias("method"), part(4).alias("place"), "status", "target_path", "target", "hops")
