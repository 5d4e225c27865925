"""What definitions and build files mean: surface kinds of Python code, roots of Go code, PHP trait adaptations, Jenkins controllers, identity keys of provider schemas.

As in `extract`, these are patterns over lines, not parsers; a file's lines are the largest group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread
from .extract import lines


def _part(pattern: str, group: int = 1, column: str = "text") -> Column:
    """A group of the first match, null where nothing matches."""
    return F.nullif(F.regexp_extract(column, pattern, group), F.lit(""))


def trait_adaptations(files: DataFrame) -> DataFrame:
    """(repo_id, path, line, type, trait, method, target) of PHP trait adaptations, names without their namespaces.

    OVERRIDES: `A::m insteadof B, C`, a row for each distinct trait that gives way. ALIASES: `A::m as protected n`, with
    the new name as target; an `as` that changes visibility only has no new name and gives that word, as it is the last.
    """
    php = lines(files).where("language = 'php'")
    head = r"^\s*([\w\\]+)\s*::\s*(\w+)\s+"
    override, alias = _part(rf"(?i){head}insteadof\s+([^;]+)", 3), _part(rf"(?i){head}as\s+([^;]+)", 3)
    bare = lambda c: F.regexp_replace(F.trim(c), r"^.*\\", "")
    targets = F.when(override.isNotNull(), F.array_distinct(F.transform(F.split(override, ","), bare))).when(alias.isNotNull(), F.array(F.element_at(F.split(F.trim(alias), r"\s+"), -1)))
    found = php.where(targets.isNotNull()).select("repo_id", "path", "line", F.when(override.isNotNull(), "OVERRIDES").otherwise("ALIASES").alias("type"), bare(_part(head)).alias("trait"), _part(head, 2).alias("method"), F.explode(targets).alias("target"))
    return found.where("target <> ''")


def python_profiles(files: DataFrame) -> DataFrame:
    """(repo_id, path, line, kind, name, decorated, is_async, generator, lambda, metaclass, documented, annotated, surface_kind) of Python definitions.

    A definition is decorated if the lines just above it are decorators, a generator if a line before the next definition
    yields, documented if the line below opens a docstring. surface_kind is the first of the signals in a fixed order.
    """
    text = F.col("text")
    by_file = Window.partitionBy("repo_id", "path").orderBy("line")
    definition = r"^\s*(?:async\s+)?(?:def|class)\s+(\w+)|^\s*(\w+)\s*=\s*lambda\b"
    own = lines(files).where("language = 'python'").select(
        "repo_id", "path", "line", "text", F.lag("text").over(by_file).alias("above"), F.lead("text").over(by_file).alias("below"), F.sum(F.rlike(text, F.lit(definition)).cast("int")).over(by_file).alias("n")
    )
    yields = F.max(F.rlike(text, F.lit(r"^\s+(?:\w+\s*=\s*)?yield\b"))).over(Window.partitionBy("repo_id", "path", "n"))
    defs = own.withColumn("generator", yields).where(F.rlike(text, F.lit(definition)))
    flag = lambda pattern, column="text": F.coalesce(F.rlike(column, F.lit(pattern)), F.lit(False))
    rows = defs.select(
        "repo_id", "path", "line", F.when(flag(r"^\s*class\b"), "Class").otherwise("Function").alias("kind"), F.coalesce(_part(definition), _part(definition, 2)).alias("name"), flag(r"^\s*@[\w.]+", "above").alias("decorated"),
        flag(r"^\s*async\s").alias("is_async"), "generator", flag(r"=\s*lambda\b").alias("lambda"), flag(r"\bmetaclass\s*=").alias("metaclass"), flag("^\\s*[rbu]?(?:\"\"\"|''')", "below").alias("documented"),
        F.when(flag(r"\)\s*->"), "return").when(flag(r"\(.*\w\s*:\s*\w.*\)"), "parameter").alias("annotated"),
    )
    return rows.withColumn("surface_kind", surface_kind())


def surface_kind() -> Column:
    """The kind of surface by the first signal that holds. Names and order of the kinds."""
    is_class, decorated, generator, asynchronous = F.col("kind") == "Class", F.col("decorated"), F.col("generator") & (F.col("kind") != "Class"), F.col("is_async")
    return (
        F.when(decorated & is_class, "decorated_class").when(decorated & asynchronous, "decorated_async_function").when(decorated, "decorated_function")
        .when(asynchronous & generator, "async_generator_function").when(generator, "generator_function").when(asynchronous, "async_function").when(F.col("lambda"), "lambda_function")
        .when(is_class & F.col("metaclass"), "metaclass_class").when(F.col("annotated") == "parameter", "parameter_type_annotation").when(F.col("annotated") == "return", "return_type_annotation")
        .when(F.col("documented") & is_class, "documented_class").when(F.col("documented"), "documented_function").otherwise("plain")
    )


# Why a Go function counts as a root though nothing calls it, with the pattern that names it.
GO_ROOTS = (
    ("go.entrypoint", r"^func\s+(main|init)\s*\(\s*\)"),
    ("go.net_http_handler_registration", r"\bHandle(?:Func)?\(\s*\"[^\"]*\"\s*,\s*(?:http\.HandlerFunc\()?(\w+)"),
    ("go.net_http_handler_signature", r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*\(\s*\w+\s+http\.ResponseWriter\s*,\s*\w+\s+\*http\.Request\s*\)"),
    ("go.cobra_run_registration", r"\b(?:Pre|Post)?RunE?\s*:\s*(\w+)\s*[,}]"),
    ("go.cobra_run_signature", r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*\(\s*\w+\s+\*cobra\.Command\s*,\s*\w+\s+\[\]string\s*\)"),
    ("go.controller_runtime_reconcile_signature", r"^func\s+\([^)]*\)\s*(Reconcile)\s*\(\s*\w+\s+context\.Context\s*,\s*\w+\s+(?:ctrl|reconcile)\.Request\s*\)"),
)


def go_roots(files: DataFrame) -> DataFrame:
    """(repo_id, path, name, root), distinct: Go functions that a framework or the runtime calls, and why."""

    def named(root: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda n: F.struct(n.alias("name"), F.lit(root).alias("root")))

    found = F.concat(*[named(*r) for r in GO_ROOTS])
    # Dealt by file, equal rows meet without a further shuffle, and a task holds a share of the files whatever their bytes.
    return lines(spread(files.where("language = 'go'"), "repo_id", "path")).select("repo_id", "path", F.inline(found)).where("name <> 'func'").distinct()


def controllers(files: DataFrame) -> DataFrame:
    """(repo_id, path, controller_kind, libraries, pipelines, commands, playbooks, use_configd, pre_deploy) of Jenkins pipelines in Groovy.

    Lists hold distinct values in their order in the file; libraries are without their versions. A file in which none of
    these is found is no controller, unless it is a Jenkinsfile.
    """
    every = lambda pattern: F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)))
    text = files.where("language = 'groovy' AND content IS NOT NULL")
    rows = text.select(
        "repo_id", "path", F.lit("jenkins_pipeline").alias("controller_kind"),
        F.array_distinct(F.transform(every(r"(?i)(?:@Library\(|\blibrary\s*\(?\s*(?:identifier\s*:\s*)?)['\"]([^'\"]+)['\"]"), lambda x: F.substring_index(x, "@", 1))).alias("libraries"),
        every(r"\b(pipeline\w*)\s*\(").alias("pipelines"), every(r"\bsh\s+['\"]([^'\"]+)['\"]").alias("commands"),
        F.coalesce(F.nullif(F.regexp_extract("content", r"use_configd\s*:\s*(true|false)", 1), F.lit("")).cast("boolean"), F.lit(None).cast("boolean")).alias("use_configd"), F.rlike("content", F.lit(r"\bpre_deploy\s*:")).alias("pre_deploy"),
    )
    playbooks = F.filter(F.transform("commands", lambda c: F.regexp_extract(c, r"\bansible-playbook\s+(\S+)", 1)), lambda p: p != "")
    named = F.rlike("path", F.lit(r"(?:^|/)Jenkinsfile"))
    return rows.withColumn("playbooks", F.array_distinct(playbooks)).where(named | (F.size("libraries") + F.size("pipelines") + F.size("commands") > 0))


# Attributes that name a resource, the first that is there wins.
IDENTITY_KEYS = (
    "name", "function_name", "bucket", "family", "queue_name", "topic_name", "cluster_identifier", "cluster_id", "cluster_name", "replication_group_id", "domain_name",
    "broker_name", "table_name", "repository_name", "project_name", "pipeline_name", "app_name", "service_name", "rule_name", "db_name", "creation_token", "instance_id",
)


def identity_keys(schemas: DataFrame) -> DataFrame:
    """(resource_type, identity_keys) from provider schemas (content: {"resource type": {"attribute": "type"}} in JSON).

    The first string attribute of IDENTITY_KEYS, else all string attributes that end in _name or _identifier, in order.
    """
    each = schemas.select(F.explode(F.from_json("content", "map<string, map<string, string>>")).alias("resource_type", "attributes"))
    strings = F.array_sort(F.map_keys(F.map_filter("attributes", lambda _, kind: kind == "string")))
    first = F.try_element_at(F.filter(F.array(*map(F.lit, IDENTITY_KEYS)), lambda k: F.array_contains("strings", k)), F.lit(1))
    named = each.where("attributes IS NOT NULL").select("resource_type", strings.alias("strings"))
    return named.select("resource_type", F.when(first.isNotNull(), F.array(first)).otherwise(F.filter("strings", lambda k: F.rlike(k, F.lit("_(?:name|identifier)$")))).alias("identity_keys"))


def decorated_definitions(files: DataFrame) -> DataFrame:
    """(repo_id, path, line, name, decorators) of Python definitions with decorators, in lower case, without arguments, in their order.

    All decorators since the last statement count, however many lines they take: blank lines, comments and lines inside
    brackets, told by a running sum, are no statements.
    """
    order = Window.partitionBy("repo_id", "path").orderBy("line")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    text = lines(files).where("language = 'python'").withColumn("code", F.regexp_replace("text", r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|#.*$""", ""))
    net = F.length(F.regexp_replace("code", r"[^(\[{]", "")) - F.length(F.regexp_replace("code", r"[^)\]}]", ""))
    own = text.withColumn("open", F.coalesce(F.sum(net).over(before), F.lit(0)) > 0).withColumn("decorator", F.when(~F.col("open"), F.lower(_part(r"^\s*@([\w.]+)"))))
    statement = (F.trim("code") != "") & ~F.col("open") & F.col("decorator").isNull()
    grouped = own.withColumn("n", F.coalesce(F.sum(statement.cast("int")).over(before), F.lit(0)))
    above = F.collect_list("decorator").over(Window.partitionBy("repo_id", "path", "n").orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    name = _part(r"^\s*(?:async\s+)?(?:def|class)\s+(\w+)")
    found = grouped.withColumns({"decorators": above, "name": name}).where(statement & F.col("name").isNotNull() & (F.size("decorators") > 0))
    return found.select("repo_id", "path", "line", "name", "decorators")


def resolved_metaclasses(classes: DataFrame, found: DataFrame) -> DataFrame:
    """found (repo_id, path, line, class, metaclass) with metaclass_path and metaclass_line: the class of that name in the same file, else the only one of the repository, else null.

    classes: repo_id, path, name, line. Of several in one file the last counts; what is before a dot is not looked at.
    """
    here = classes.groupBy("repo_id", "path", "name").agg(F.max("line").alias("line"))
    only = here.groupBy("repo_id", "name").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("far_path"), F.min("line").alias("far_line")).where("n = 1").drop("n")
    near = here.select("repo_id", "path", "name", F.col("line").alias("near_line"))
    both = found.withColumn("name", F.element_at(F.split("metaclass", r"\."), -1)).join(near, ["repo_id", "path", "name"], "left").join(only, ["repo_id", "name"], "left")
    own = F.col("near_line").isNotNull()
    return both.select("repo_id", "path", "line", "class", "metaclass", F.when(own, F.col("path")).otherwise(F.col("far_path")).alias("metaclass_path"), F.coalesce("near_line", "far_line").alias("metaclass_line"))
