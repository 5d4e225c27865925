"""What delivery documents say: applications and sets of applications, the configuration that sets discover in other repositories, and what that configuration deploys where.

A set names paths, with wildcards, of configuration files in another repository. Its templates are filled from each file that a path fits,
so the files are joined by repository and the literal folders of the path, then by the pattern; only files that a path fits are opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import yaml_paths
from .api_refs import json_nodes
from .extract import repository_of

# Keys of a configuration that name what it deploys, and names that are too common to tell a repository.
IDENTITY = ("addon", "app", "application", "name", "service", "service.name", "serviceName", "helm.releaseName", "releaseName", "metadata.name")
BROAD = ("api", "app", "application", "backend", "frontend", "platform", "service", "server", "worker")
# Evidence, relationship, confidence.
DISCOVERED, DEPLOYED, RUNS, APPLIED = (("argocd_applicationset_discovery", "DISCOVERS_CONFIG_IN", 0.99), ("argocd_applicationset_deploy_source", "DEPLOYS_FROM", 0.99), ("argocd_destination_platform", "RUNS_ON", 0.97), ("argocd_application_source", "DEPLOYS_FROM", 0.95))

_DOC = ("repo_id", "path", "document")
_SLOT = r"\{\{\s*\.([A-Za-z0-9_.]+)\s*\}\}"


def _templated(c: Column) -> Column:
    return F.contains(c, F.lit("{{")) | F.contains(c, F.lit("}}"))


def _token(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"\s", "-")


def _glob(pattern: Column) -> Column:
    """The regular expression of a path with * and ? (within a part) and ** (any number of parts)."""
    plain = F.regexp_replace(pattern, r"([.+^$(){}|\[\]\\])", r"\\$1")
    parts = F.replace(F.replace(plain, F.lit("**/"), F.lit("\x01")), F.lit("**"), F.lit("\x02"))
    parts = F.replace(F.replace(parts, F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]"))
    return F.concat(F.lit("^"), F.replace(F.replace(parts, F.lit("\x01"), F.lit("(?:.*/)?")), F.lit("\x02"), F.lit(".*")), F.lit("$"))


def documents(files: DataFrame) -> DataFrame:
    """Key paths (see yaml_paths.paths) with dotted keys and is_set, of the YAML files that hold applications or sets of them."""
    own = files.where(F.rlike("path", F.lit(r"\.ya?ml$")) & F.contains("content", F.lit("repoURL")))
    # Written once: a document's rows are read for its kind and again for what it says.
    found = cut(yaml_paths.paths(own.select("repo_id", "path", "content")).where("value IS NOT NULL").withColumn("dotted", F.array_join("keys", ".")))
    kinds = found.groupBy(*_DOC).agg(F.max(F.when(F.col("dotted") == "kind", F.lower("value")) == "applicationset").alias("is_set"))
    return found.join(kinds, list(_DOC)).withColumn("is_set", F.coalesce("is_set", F.lit(False)))


def discoveries(found: DataFrame) -> DataFrame:
    """(repo_id, path, document, url, pattern): the files that sets look for, in generators of git, also inside matrix and merge; urls with slots are left out."""
    git = r"^spec\.generators\.\[\](?:\.(?:matrix|merge)\.generators\.\[\])*\.git\."
    sets = found.where("is_set")
    # A generator is known by the items of lists around it; a file's own item comes after.
    urls = sets.where(F.rlike("dotted", F.lit(git + "repoURL$")) & ~_templated(F.col("value"))).select(*_DOC, F.col("items").alias("generator"), F.col("value").alias("url"))
    patterns = sets.where(F.rlike("dotted", F.lit(git + r"files\.\[\]\.path$")) & F.rlike("value", F.lit(r"(?i)\.(?:ya?ml|json)$")))
    patterns = patterns.select(*_DOC, F.slice("items", F.lit(1), F.size(F.filter("keys", lambda k: k == "[]")) - 1).alias("generator"), F.regexp_replace(F.trim("value"), "^/", "").alias("pattern"))
    return urls.join(patterns, [*_DOC, "generator"]).select(*_DOC, "url", "pattern").distinct()


def destinations(found: DataFrame) -> DataFrame:
    """(repo_id, path, document, platform): where the applications of a document run, by the cluster's name or else its server's host; none with slots."""
    at = F.regexp_extract("dotted", r"^(spec(?:\.template\.spec)?)\.destination\.(?:name|server)$", 1)
    own = found.where((at != "") & (F.col("is_set") == (at == "spec.template.spec")))
    said = lambda k: F.max(F.when(F.endswith("dotted", F.lit(f".{k}")), F.col("value")))
    each = own.groupBy(*_DOC).agg(said("name").alias("name"), said("server").alias("server"))
    open_ = _templated(F.coalesce("name", F.lit(""))) | _templated(F.coalesce("server", F.lit("")))
    cluster, host = _token(F.col("name")), _token(F.regexp_extract("server", r"^(?:[A-Za-z][\w+.-]*://)?(?:[^@/]*@)?([^/?#]*)", 1))
    platform = F.when(cluster != "", F.concat(F.lit("platform:kubernetes:none:cluster/"), cluster, F.lit(":none:none"))).when(host != "", F.concat(F.lit("platform:kubernetes:none:server/"), host, F.lit(":none:none")))
    return each.where(~open_).select(*_DOC, platform.alias("platform")).where("platform IS NOT NULL")


def fitting(files: DataFrame, found: DataFrame) -> DataFrame:
    """found (with config_repo and pattern), a row for each file of that repository that the pattern fits: with config_path."""
    head = F.regexp_extract("pattern", r"^((?:[^*?/]+/)*)", 1)
    want = found.withColumns({"head": head, "fits": _glob(F.col("pattern"))})
    names = files.where(F.rlike("path", F.lit(r"(?i)\.(?:ya?ml|json)$"))).select(F.col("repo_id").alias("config_repo"), F.col("path").alias("config_path"))
    names = names.join(found.select("config_repo").distinct(), "config_repo", "left_semi")
    parts = F.split("config_path", "/")
    heads = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.when(i > 0, "/").otherwise("")))
    each = names.select("*", F.explode(heads).alias("head"))
    return want.join(each, ["config_repo", "head"]).where(F.rlike("config_path", F.col("fits"))).drop("head", "fits")


def parameters(files: DataFrame) -> DataFrame:
    """(repo_id, path, params): dotted keys and values of each configuration file's first document, but of lists, and path.path, path.basename and path.basenameNormalized."""
    yaml = yaml_paths.paths(files.where(F.rlike("path", F.lit(r"(?i)\.ya?ml$"))).select("repo_id", "path", "content")).where("document = 0 AND value IS NOT NULL")
    flat = yaml.where(~F.array_contains("keys", "[]") & (F.size("keys") > 0)).select("repo_id", "path", F.array_join("keys", ".").alias("key"), "value")
    # In pointers an item of a list is a number.
    json = json_nodes(files).where("kind = 'scalar' AND value IS NOT NULL").where(~F.rlike("pointer", F.lit(r"/\d+(?:/|$)")))
    flat = flat.unionByName(json.select("repo_id", "path", F.replace(F.substring("pointer", 2, 1 << 30), F.lit("/"), F.lit(".")).alias("key"), "value"))
    base = F.when(F.contains("path", F.lit("/")), F.regexp_extract("path", r"([^/]*)/[^/]*$", 1)).otherwise(F.regexp_replace("path", r"\.[^.]*$", ""))
    own = F.map_from_arrays(F.array(F.lit("path.path"), F.lit("path.basename"), F.lit("path.basenameNormalized")), F.array(F.col("path"), base, _token(base)))
    flat = flat.unionByName(files.select("repo_id", "path", F.explode(own).alias("key", "value")))
    each = flat.where(F.trim("value") != "").groupBy("repo_id", "path", "key").agg(F.max(F.trim("value")).alias("value"))
    return each.groupBy("repo_id", "path").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("params"))


def filled(template: Column, params: Column) -> Column:
    """A template with its slots filled; null if one has no value."""
    even = F.regexp_replace(template, _SLOT, r"{{.$1}}")
    slots = F.array_distinct(F.regexp_extract_all(even, F.lit(_SLOT), F.lit(1)))
    out = F.aggregate(slots, even, lambda a, k: F.replace(a, F.concat(F.lit("{{."), k, F.lit("}}")), F.coalesce(F.try_element_at(params, k), F.lit("{{"))))
    return F.when(~_templated(out) & (F.trim(out) != ""), F.trim(out))


def delivery_evidence(files: DataFrame, repos: DataFrame) -> DataFrame:
    """(evidence, relationship, confidence, source, target, path): what applications and sets of applications tell of repositories and platforms.

    files: repo_id, path, content; repos: repo_id, name. A url or name means the repositories with its last part for a name, A-Z alike. Sets: the
    set's repository discovers configuration in another; each repository that a source of the template or the configuration names, but these two, is
    deployed from the configuration and runs on the destination. Applications: their repository is deployed from each source, which runs on the destination.
    Rows are distinct; null contents, broken files and unknown repositories give none.
    """
    names = repos.select("repo_id", F.lower("name").alias("name")).where("name <> ''").distinct()

    def known(rows: DataFrame, c: str, out: str) -> DataFrame:
        """rows with the repositories that c names, in column out."""
        return rows.withColumn("name", F.lower(repository_of(F.col(c)))).join(names.withColumnRenamed("repo_id", out), "name").drop("name")

    def evidence(rows: DataFrame, kind: tuple, source: str, target: str) -> DataFrame:
        return rows.select(F.lit(kind[0]).alias("evidence"), F.lit(kind[1]).alias("relationship"), F.lit(kind[2]).alias("confidence"), F.col(source).alias("source"), F.col(target).alias("target"), "path")

    # Tables that several steps read are written once; it also keeps the plans of opened files out of what follows.
    found = documents(files)
    runs = destinations(found)
    looked = cut(known(discoveries(found), "url", "config_repo").where("config_repo <> repo_id"))
    source = r"spec\.(?:source|sources\.\[\])\.repoURL$"
    sources = found.where("is_set").where(F.rlike("dotted", F.lit(r"^spec\.template\." + source))).select(*_DOC, F.col("value").alias("url"))
    literal = looked.join(sources.where(~_templated(F.col("url"))).withColumnRenamed("url", "said"), list(_DOC))
    hits = cut(fitting(files, looked))
    opened = parameters(cut(files.join(hits.select(F.col("config_repo").alias("repo_id"), F.col("config_path").alias("path")).distinct(), ["repo_id", "path"], "left_semi")))
    hits = cut(hits.join(opened.select(F.col("repo_id").alias("config_repo"), F.col("path").alias("config_path"), "params"), ["config_repo", "config_path"]))
    rendered = hits.join(sources.where(_templated(F.col("url"))).withColumnRenamed("url", "template"), list(_DOC)).withColumn("said", filled(F.col("template"), F.col("params")))
    named = F.filter(F.transform(F.array(*[F.lit(k) for k in IDENTITY]), lambda k: F.try_element_at("params", k)), lambda v: v.isNotNull() & (F.length(v) >= 4) & ~F.lower(v).isin(*BROAD))
    identity = hits.withColumn("said", F.explode(named))
    columns = [*_DOC, "config_repo", "said"]
    said = literal.select(*columns).unionByName(rendered.where("said IS NOT NULL").select(*columns)).unionByName(identity.select(*columns)).distinct()
    deployed = cut(known(said, "said", "deployed").where("deployed <> config_repo AND deployed <> repo_id"))
    single = known(found.where("NOT is_set").where(F.rlike("dotted", F.lit("^" + source))).select(*_DOC, F.col("value").alias("url")), "url", "deployed").where("deployed <> repo_id")
    placed = deployed.select(*_DOC, "deployed").unionByName(single.select(*_DOC, "deployed")).join(runs, list(_DOC))
    rows = evidence(looked, DISCOVERED, "repo_id", "config_repo").unionByName(evidence(deployed, DEPLOYED, "deployed", "config_repo"))
    return rows.unionByName(evidence(single, APPLIED, "repo_id", "deployed")).unionByName(evidence(placed, RUNS, "deployed", "platform")).distinct()
