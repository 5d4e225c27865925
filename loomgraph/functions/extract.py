"""Rows out of file contents, by tables of patterns that Spark applies line by line: symbols, calls, SQL objects, infrastructure blocks, references, lineage.

Input is a table with repo_id, path, language and content. The patterns cover the common forms of each language, not its
grammar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (languages, kind, pattern with the name as group 1).
SYMBOLS: Sequence[tuple[tuple[str, ...], str, str]] = (
    (("python",), "Function", r"^\s*(?:async\s+)?def\s+(\w+)\s*\("),
    (("python",), "Class", r"^\s*class\s+(\w+)"),
    (("python",), "Import", r"^\s*(?:from|import)\s+([\w.]+)"),
    (("go",), "Function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*[\[(]"),
    (("go",), "Struct", r"^type\s+(\w+)\s+struct\b"),
    (("go",), "Interface", r"^type\s+(\w+)\s+interface\b"),
    (("javascript", "typescript"), "Function", r"\bfunction\s*\*?\s+(\w+)\s*\("),
    (("javascript", "typescript"), "Function", r"\b(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>"),
    (("javascript", "typescript", "java", "kotlin", "csharp", "php", "scala", "swift", "dart", "cpp"), "Class", r"\bclass\s+(\w+)"),
    (("javascript", "typescript"), "Import", r"\bfrom\s+['\"]([^'\"]+)['\"]"),
    (("typescript", "java", "kotlin", "csharp", "php"), "Interface", r"\binterface\s+(\w+)"),
    (("java", "csharp"), "Function", r"^\s*(?:public|private|protected|static|final|override|async|\s)+[\w<>\[\],.]+\s+(\w+)\s*\([^;]*\{\s*$"),
    (("kotlin",), "Function", r"\bfun\s+(?:<[^>]+>\s*)?(?:\w+\.)?(\w+)\s*\("),
    (("rust",), "Function", r"\bfn\s+(\w+)"),
    (("rust",), "Struct", r"\bstruct\s+(\w+)"),
    (("rust",), "Trait", r"\btrait\s+(\w+)"),
    (("ruby",), "Function", r"^\s*def\s+(?:self\.)?([\w?!]+)"),
    (("ruby",), "Class", r"^\s*class\s+(\w+)"),
    (("php",), "Function", r"\bfunction\s+(\w+)\s*\("),
    (("swift",), "Function", r"\bfunc\s+(\w+)"),
    (("scala", "groovy"), "Function", r"\bdef\s+(\w+)"),
    (("elixir",), "Function", r"^\s*defp?\s+(\w+[?!]?)"),
    (("elixir",), "Module", r"^\s*defmodule\s+([\w.]+)"),
    (("perl",), "Function", r"^\s*sub\s+(\w+)"),
    (("haskell",), "Function", r"^(\w+)\s*::"),
    (("c", "cpp"), "Function", r"^[\w*\s]+?\b(\w+)\s*\([^;]*\)\s*\{"),
    (("terraform", "terragrunt"), "TerraformResource", r'^\s*resource\s+"[^"]+"\s+"([^"]+)"'),
    (("terraform", "terragrunt"), "TerraformModule", r'^\s*module\s+"([^"]+)"'),
    (("terraform", "terragrunt"), "TerraformVariable", r'^\s*variable\s+"([^"]+)"'),
    (("terraform", "terragrunt"), "TerraformOutput", r'^\s*output\s+"([^"]+)"'),
    (("terraform", "terragrunt"), "TerraformDataSource", r'^\s*data\s+"[^"]+"\s+"([^"]+)"'),
    (("dockerfile",), "DockerStage", r"(?i)^\s*FROM\s+\S+\s+AS\s+(\S+)"),
    (("dockerfile",), "DockerImage", r"(?i)^\s*FROM\s+(\S+)"),
    (("sql",), "SqlTable", r"(?i)\bCREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w.\"]+)"),
    (("sql",), "SqlView", r"(?i)\bCREATE\s+(?:OR\s+REPLACE\s+)?(?:MATERIALIZED\s+)?VIEW\s+([\w.\"]+)"),
    (("sql",), "SqlFunction", r"(?i)\bCREATE\s+(?:OR\s+REPLACE\s+)?FUNCTION\s+([\w.\"]+)"),
    (("sql",), "SqlTrigger", r"(?i)\bCREATE\s+TRIGGER\s+([\w.\"]+)"),
    (("sql",), "SqlIndex", r"(?i)\bCREATE\s+(?:UNIQUE\s+)?INDEX\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w.\"]+)"),
    (("compose",), "ComposeService", r"^  ([\w.-]+):\s*$"),
)

# How a SQL text mentions a table.
MENTIONS = (
    ("select", r"(?i)\b(?:FROM|JOIN)\s+([\w.\"]+)"),
    ("insert", r"(?i)\bINSERT\s+INTO\s+([\w.\"]+)"),
    ("update", r"(?i)\bUPDATE\s+([\w.\"]+)\s+SET\b"),
    ("delete", r"(?i)\bDELETE\s+FROM\s+([\w.\"]+)"),
    ("reference", r"(?i)\bREFERENCES\s+([\w.\"]+)"),
    ("alter", r"(?i)\bALTER\s+TABLE\s+([\w.\"]+)"),
    ("trigger", r"(?i)\bON\s+([\w.\"]+)\s+(?:FOR\s+EACH|EXECUTE)"),
)


def lines(files: DataFrame) -> DataFrame:
    """(repo_id, path, language, line, text); lines count from 1."""
    numbered = files.where(F.col("content").isNotNull()).select("repo_id", "path", "language", F.posexplode(F.split("content", "\r?\n")).alias("i", "text"))
    return numbered.select("repo_id", "path", "language", (F.col("i") + 1).alias("line"), "text")


def _match(kind: str, pattern: str, languages: tuple[str, ...] | None) -> Column:
    found = F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda n: F.struct(F.lit(kind).alias("kind"), F.regexp_replace(n, '"', "").alias("name")))
    if languages is None:
        return found
    return F.when(F.col("language").isin(*languages), found).otherwise(F.array().cast("array<struct<kind:string,name:string>>"))


def symbols(files: DataFrame) -> DataFrame:
    """(repo_id, path, language, kind, name, line) of every definition, import and block that a pattern finds."""
    found = F.concat(*[_match(kind, pattern, languages) for languages, kind, pattern in SYMBOLS])
    return lines(files).select("repo_id", "path", "language", "line", F.inline(found)).select("repo_id", "path", "language", "kind", "name", "line")


def spans(found: DataFrame) -> DataFrame:
    """Definitions with end_line: the line before the next definition of the file, null for its last."""
    from pyspark.sql import Window

    w = Window.partitionBy("repo_id", "path").orderBy("line", "name")
    return found.where(F.col("kind").isin("Function", "Class", "Struct", "Interface", "Trait")).withColumn("end_line", F.lead("line").over(w) - 1)


def calls(files: DataFrame) -> DataFrame:
    """(repo_id, path, line, callee): names that are called, other than on the line that defines them."""
    names = lines(files).where(F.col("language").isin(*{x for s in SYMBOLS for x in s[0]} - {"sql", "terraform", "terragrunt", "dockerfile", "compose"}))
    each = names.select("repo_id", "path", "line", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([A-Za-z_]\w*)\s*\("), F.lit(1)))).alias("callee"))
    defined = F.rlike("text", F.concat(F.lit(r"\b(?:def|func|function|fn|fun|sub|class)\s+(?:\([^)]*\)\s*)?"), F.col("callee"), F.lit(r"\b")))
    keywords = ("if", "for", "while", "switch", "catch", "return", "func", "function", "sizeof", "elif", "match", "and", "or", "not", "in")
    return each.where(~defined & ~F.col("callee").isin(*keywords)).select("repo_id", "path", "line", "callee")


def table_mentions(files: DataFrame) -> DataFrame:
    """(repo_id, path, line, kind, name): tables that SQL files and SQL inside other files mention, by how."""
    found = F.concat(*[_match(kind, pattern, None) for kind, pattern in MENTIONS])
    return lines(files).select("repo_id", "path", "line", F.inline(found))


def documents(files: DataFrame) -> DataFrame:
    """(repo_id, path, document, api_version, kind, name, namespace) of each document of YAML files with a kind."""
    each = files.where(F.col("language").isin("yaml", "helm", "kustomize")).select("repo_id", "path", F.posexplode(F.split("content", r"(?m)^---\s*$")).alias("document", "text"))

    def field(pattern: str) -> Column:
        return F.nullif(F.trim(F.regexp_replace(F.regexp_extract("text", pattern, 1), "[\"']", "")), F.lit(""))

    rows = each.select("repo_id", "path", "document", field(r"(?m)^apiVersion:\s*(\S+)").alias("api_version"), field(r"(?m)^kind:\s*(\S+)").alias("kind"), field(r"(?ms)^metadata:.*?^\s+name:\s*(\S+)").alias("name"), field(r"(?ms)^metadata:.*?^\s+namespace:\s*(\S+)").alias("namespace"))
    return rows.where("kind IS NOT NULL")


# Fixed values: (kind, relationship, confidence, pattern with the target as group 1).
REFERENCES = (
    ("terraform_module_source", "USES_MODULE", 0.98, r'^\s*source\s*=\s*"([^"]+)"'),
    ("dockerfile_base", "DEPENDS_ON", 0.88, r"(?i)^\s*FROM\s+(\S+)"),
    ("github_actions_uses", "DEPENDS_ON", 0.88, r"^\s*-?\s*uses:\s*([\w./@-]+)"),
    ("compose_image", "DEPLOYS_FROM", 0.88, r"^\s+image:\s*(\S+)"),
    ("argocd_repo", "DEPLOYS_FROM", 0.95, r"^\s*repoURL:\s*(\S+)"),
    ("kustomize_resource", "DEPLOYS_FROM", 0.9, r"^\s*-\s+((?:\.\./|https?://)\S+)"),
    ("helm_dependency", "DEPLOYS_FROM", 0.9, r"^\s*repository:\s*(\S+)"),
)


def references(files: DataFrame) -> DataFrame:
    """(repo_id, path, line, evidence, relationship, confidence, target): what files say they depend on or are deployed from."""
    kind = "array<struct<evidence:string,relationship:string,confidence:double,target:string>>"

    def match(evidence: str, relationship: str, confidence: float, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda t: F.struct(F.lit(evidence).alias("evidence"), F.lit(relationship).alias("relationship"), F.lit(confidence).alias("confidence"), F.regexp_replace(t, "[\"']", "").alias("target")))

    return lines(files).select("repo_id", "path", "line", F.inline(F.concat(*[match(*r) for r in REFERENCES]).cast(kind)))


def repository_of(target: Column) -> Column:
    """The repository's name in a reference: the last part of a git source, image, action, chart or path, without scheme, query, version and .git."""
    bare = F.regexp_replace(target, r"^(?:git::)?(?:[a-z+]+://)?|[?].*$", "")
    last = F.element_at(F.split(F.regexp_replace(bare, r"//.*$|/+$", ""), "/"), -1)
    return F.regexp_replace(last, r"(?:[.]git)?(?:[@:][^/]*)?$", "")


def deployable_units(files: DataFrame) -> DataFrame:
    """(repo_id, path, unit) of Dockerfiles: the name of the folder they are in, of one at the top the repository's, of Dockerfile.NAME that name."""
    own = files.where(F.col("language") == "dockerfile")
    parts = F.split("path", "/")
    suffix = F.nullif(F.regexp_extract(F.element_at(parts, -1), r"^Dockerfile[.](.+)$", 1), F.lit(""))
    folder = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.regexp_replace("repo_id", "^.*[:/]", ""))
    return own.select("repo_id", "path", F.coalesce(suffix, folder).alias("unit"))


def metaclasses(files: DataFrame) -> DataFrame:
    """(repo_id, path, line, class, metaclass) of Python classes that name a metaclass."""
    found = lines(files).where("language = 'python'").withColumns({"class": F.regexp_extract("text", r"^\s*class\s+(\w+)\s*\(", 1), "metaclass": F.regexp_extract("text", r"\bmetaclass\s*=\s*([\w.]+)", 1)})
    return found.where("class <> '' AND metaclass <> ''").select("repo_id", "path", "line", "class", "metaclass")


def decorators(files: DataFrame) -> DataFrame:
    """(repo_id, path, line, decorator) of decorators and annotations, without arguments, in lower case."""
    found = lines(files).withColumn("decorator", F.lower(F.regexp_extract("text", r"^\s*@([\w.]+)", 1)))
    return found.where("decorator <> ''").select("repo_id", "path", "line", "decorator")


# Fixed value: the fields of a dbt manifest that are read.
MANIFEST = "nodes map<string, struct<name: string, resource_type: string, relation_name: string, depends_on: struct<nodes: array<string>>, columns: map<string, struct<name: string>>, compiled_code: string>>"


def manifest_models(files: DataFrame) -> DataFrame:
    """(repo_id, path, model, name, relation, upstream, columns, compiled) of the models of dbt manifests."""
    parsed = files.where(F.endswith("path", F.lit("manifest.json"))).select("repo_id", "path", F.from_json("content", MANIFEST).alias("m"))
    each = parsed.where("m.nodes IS NOT NULL").select("repo_id", "path", F.explode("m.nodes").alias("model", "n"))
    return each.select("repo_id", "path", "model", "n.name", F.col("n.relation_name").alias("relation"), F.coalesce("n.depends_on.nodes", F.array().cast("array<string>")).alias("upstream"), F.array_sort(F.map_keys("n.columns")).alias("columns"), F.col("n.compiled_code").alias("compiled"))


_METHODS = ("get", "put", "post", "delete", "patch", "head", "options", "trace")


def api_endpoints(files: DataFrame) -> DataFrame:
    """(repo_id, path, route, method, operation_id) of the operations of OpenAPI documents in JSON."""
    parsed = files.where(F.endswith("path", F.lit(".json"))).select("repo_id", "path", F.from_json("content", "paths map<string, map<string, string>>").alias("api"))
    routes = parsed.where("api.paths IS NOT NULL").select("repo_id", "path", F.explode("api.paths").alias("route", "methods"))
    each = routes.where("methods IS NOT NULL").select("repo_id", "path", "route", F.explode("methods").alias("method", "operation")).where(F.col("method").isin(*_METHODS))
    return each.select("repo_id", "path", "route", "method", F.get_json_object("operation", "$.operationId").alias("operation_id"))


# Fixed values: (list in a replay file, id of its items, field with the assets, relationship).
REPLAYS = (
    ("dashboards", "dashboard_id", "consumes_assets", "POWERS"),
    ("checks", "check_id", "targets_assets", "ASSERTS_QUALITY_ON"),
    ("owners", "owner_id", "owns_assets", "OWNS"),
    ("contracts", "contract_id", "targets_assets", "DECLARES_CONTRACT_FOR"),
    ("query_history", "query_id", "touched_assets", "RUNS_QUERY_AGAINST"),
    ("models", "model_id", "upstream_assets", "ASSET_DERIVES_FROM"),
)


def asset_relationships(files: DataFrame) -> DataFrame:
    """(repo_id, path, src, type, dst) of the assets that dashboards, checks, owners, contracts, queries and models name in replay files."""
    schema = ", ".join(f"{name} array<struct<{key}: string, {assets}: array<string>>>" for name, key, assets, _ in REPLAYS)
    parsed = files.where(F.endswith("path", F.lit(".json"))).select("repo_id", "path", F.from_json("content", schema).alias("r")).where("r IS NOT NULL")
    kind = "array<struct<src:string,type:string,dst:string>>"

    def rows(name: str, key: str, assets: str, relation: str) -> Column:
        def of(item: Column) -> Column:
            return F.transform(F.coalesce(item[assets], F.array().cast("array<string>")), lambda a: F.struct(item[key].alias("src"), F.lit(relation).alias("type"), a.alias("dst")))

        return F.coalesce(F.flatten(F.transform(F.col(f"r.{name}"), of)), F.array().cast(kind))

    return parsed.select("repo_id", "path", F.inline(F.concat(*[rows(*x) for x in REPLAYS])))
