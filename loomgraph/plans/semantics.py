"""Semantics of code and build files that Spark writes from the tables, explained candidates, activated generations; as in `extraction`, the SQL knows the answers from the columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import extract, semantics
from ..sources.tables import Tables, node_id
from .extraction import _files, _infrastructure
from .reducers import CANDIDATES, _judged
from .registry import Registry

R = Registry()


def _text(*parts) -> F.Column:
    """A text of pieces and columns: strings that are no column's name go in as they are."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@R.add("""SELECT 'repo:' || p_size AS repo_id, type, trait || p_partkey AS trait, method, replace(target, '$', p_partkey::VARCHAR) AS target FROM part,
(VALUES ('OVERRIDES', 'A', 'run', 'B$'), ('OVERRIDES', 'A', 'run', 'C'), ('ALIASES', 'B', 'run', 'runB'), ('ALIASES', 'B', 'stop', 'halt')) x(type, trait, method, target)""")
def trait_adaptations(t: Tables) -> DataFrame:
    """Traits that give way and methods with new names, of PHP classes."""
    k = F.col("p_partkey")
    content = _text("<?php\nclass C", k, " {\n  use A", k, ", B", k, " {\n    \\App\\A", k, "::run insteadof \\App\\B", k, ", C;\n    B", k, "::run as protected runB;\n    B", k, "::stop AS halt;\n  }\n}\n")
    return semantics.trait_adaptations(_files(t.part, node_id("repo", "p_size"), _text("src/C", k, ".php"), content)).select("repo_id", "type", "trait", "method", "target")


#: Shapes of Python definitions by p_size: text, kind of surface.
_SHAPES = (
    ("@app.get('/x')\nasync def {}():\n    pass\n", "decorated_async_function"),
    ("@dataclass\nclass {}:\n    pass\n", "decorated_class"),
    ("async def {}():\n    yield 1\n", "async_generator_function"),
    ("def {}():\n    x = yield 1\n", "generator_function"),
    ("{} = lambda x: x\n", "lambda_function"),
    ("class {}(metaclass=Meta):\n    pass\n", "metaclass_class"),
    ("def {}(x: int):\n    return x\n", "parameter_type_annotation"),
    ("def {}() -> int:\n    return 1\n", "return_type_annotation"),
    ('class {}:\n    """What it is."""\n', "documented_class"),
    ("def {}():\n    return 1\n", "plain"),
)
_KINDS = f"CASE p_size % {len(_SHAPES)} " + " ".join(f"WHEN {i} THEN '{kind}'" for i, (_, kind) in enumerate(_SHAPES)) + " END"


@R.add(f"""SELECT 'repo:' || p_size AS repo_id, 'f' || p_partkey AS name, {_KINDS} AS surface_kind FROM part
UNION ALL SELECT 'repo:' || p_size, 'last' || p_partkey, 'documented_function' FROM part""")
def python_surface_kinds(t: Tables) -> DataFrame:
    """The surface kind of each Python definition, by its first signal."""
    name = _text("f", F.col("p_partkey"))
    shapes = [F.when(F.col("p_size") % len(_SHAPES) == i, F.replace(F.lit(text), F.lit("{}"), name)) for i, (text, _) in enumerate(_SHAPES)]
    content = F.concat(F.coalesce(*shapes), _text("\ndef last", F.col("p_partkey"), "():\n    '''What it does.'''\n"))
    return semantics.python_profiles(_files(t.part, node_id("repo", "p_size"), F.concat(name, F.lit(".py")), content)).select("repo_id", "name", "surface_kind")


@R.add(f"""WITH d AS (SELECT p_size AS repo, {_KINDS} AS kind FROM part UNION ALL SELECT p_size, 'documented_function' FROM part)
SELECT 'repo:' || repo AS repo_id, count(*) AS definitions, count(DISTINCT kind) AS kinds, count(*) FILTER (WHERE kind LIKE '%async%') AS asynchronous, count(*) FILTER (WHERE kind LIKE 'decorated%') AS decorated FROM d GROUP BY 1""")
def python_profile_summary(t: Tables) -> DataFrame:
    """How the definitions of each repository are made."""
    kind = F.col("surface_kind")
    share = lambda p: F.count(F.when(kind.like(p), 1))
    return python_surface_kinds(t).groupBy("repo_id").agg(F.count(F.lit(1)).alias("definitions"), F.count_distinct(kind).alias("kinds"), share("%async%").alias("asynchronous"), share("decorated%").alias("decorated"))


@R.add("""SELECT 'repo:' || p_size AS repo_id, replace(name, '$', p_partkey::VARCHAR) AS name, root FROM part,
(VALUES ('main', 'go.entrypoint'), ('serve$', 'go.net_http_handler_registration'), ('serve$', 'go.net_http_handler_signature'), ('run$', 'go.cobra_run_registration'), ('Reconcile', 'go.controller_runtime_reconcile_signature')) x(name, root)""")
def go_roots(t: Tables) -> DataFrame:
    """Go functions that count as used though nothing in their files calls them."""
    k = F.col("p_partkey")
    content = _text(
        "package main\n\nfunc main() {\n\thttp.HandleFunc(\"/x\", serve", k, ")\n}\n\nfunc serve", k, "(w http.ResponseWriter, r *http.Request) {\n}\n\nvar c = &cobra.Command{\n\tRunE: run", k,
        ",\n}\n\nfunc (r *R) Reconcile(ctx context.Context, req ctrl.Request) (ctrl.Result, error) {\n}\n\nfunc idle", k, "() {\n}\n",
    )
    return semantics.go_roots(_files(t.part, node_id("repo", "p_size"), _text("cmd/m", k, ".go"), content)).select("repo_id", "name", "root")


@R.add("""SELECT 'repo:' || p_size AS repo_id, 'jenkins_pipeline' AS controller_kind, 'lib' || p_size AS libraries, CASE WHEN p_partkey % 3 = 0 THEN 'pipelineDeploy' ELSE '' END AS pipelines, 'deploy' || p_partkey || '.yml' AS playbooks,
CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS use_configd, p_partkey % 2 = 0 AS pre_deploy FROM part""")
def controller_artifacts(t: Tables) -> DataFrame:
    """Jenkins pipelines: shared libraries, pipeline calls, playbooks that they run, switches."""
    k, n = F.col("p_partkey"), F.col("p_size")
    calls = F.when(k % 3 == 0, F.lit("pipelineDeploy(use_configd: true)\n")).when(k % 3 == 1, F.lit("step(use_configd: false)\n")).otherwise(F.lit(""))
    content = F.concat(_text("@Library('lib", n, "@v1') _\nlibrary identifier: 'lib", n, "'\n"), calls, F.when(k % 2 == 0, F.lit("pre_deploy: x\n")).otherwise(F.lit("")), _text("sh 'ansible-playbook deploy", k, ".yml -i hosts'\nsh 'make'\n"))
    found = semantics.controllers(_files(t.part, node_id("repo", "p_size"), _text("ci", k, "/Jenkinsfile"), content))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return found.select("repo_id", "controller_kind", joined("libraries"), joined("pipelines"), joined("playbooks"), "use_configd", "pre_deploy")


@R.add("""SELECT 'kind_' || p_partkey AS resource_type, CASE p_size % 3 WHEN 0 THEN 'name' WHEN 1 THEN 'bucket' ELSE 'a_identifier,z_name' END AS identity_keys FROM part""")
def schema_identity_keys(t: Tables) -> DataFrame:
    """The attributes that name a resource, by provider schemas."""
    kind = F.col("p_size") % 3
    attributes = F.when(kind == 0, '"bucket": "string", "name": "string"').when(kind == 1, '"name": "bool", "bucket": "string"').otherwise('"z_name": "string", "count": "number", "a_identifier": "string", "b_name": "bool"')
    schemas = t.part.select(F.concat(_text('{"kind_', F.col("p_partkey"), '": {'), attributes, F.lit("}}")).alias("content"))
    return semantics.identity_keys(schemas).select("resource_type", F.array_join("identity_keys", ",").alias("identity_keys"))


_BLOCKS = """SELECT s_suppkey, 'TerraformModule' AS type, 'm' || s_suppkey AS name FROM supplier WHERE s_suppkey % 7 = 0 UNION ALL SELECT s_suppkey, 'TerraformResource', 'b' || s_suppkey FROM supplier WHERE s_suppkey % 7 = 0"""


@R.add(f"""SELECT 'repo:s' || s_suppkey AS repo_id, type, name, 'content' AS origin FROM ({_BLOCKS})
UNION ALL SELECT 'repo:s' || s_suppkey, 'K8sResource', s_name, 'graph' FROM supplier WHERE s_suppkey % 7 <> 0""")
def infrastructure_rows(t: Tables) -> DataFrame:
    """Infrastructure of each repository: what its contents hold, without repeats, or where they hold none what the graph knows."""
    key = ["repo_id", "type", "name"]
    content = extract.symbols(_infrastructure(t)).where(F.col("kind").isin("TerraformResource", "TerraformModule", "TerraformDataSource")).select("repo_id", F.col("kind").alias("type"), "name").distinct()
    graph = t.supplier.select(F.concat(F.lit("repo:s"), "s_suppkey").alias("repo_id"), F.lit("K8sResource").alias("type"), F.col("s_name").alias("name")).distinct()
    rest = graph.join(content.select("repo_id").distinct(), "repo_id", "left_anti")
    return content.select(*key, F.lit("content").alias("origin")).unionByName(rest.select(*key, F.lit("graph").alias("origin")))


_SHOWN = "CAST(CAST({} AS DECIMAL(8, 6)) AS DECIMAL(8, 2))"


@R.add(f"""WITH {CANDIDATES} SELECT id, 0 AS part, 'candidate=' || id || ' key=' || correlation_key || ' state=' || CASE WHEN reason IS NULL THEN 'admitted' ELSE 'rejected' END || ' confidence=' || {_SHOWN.format("confidence")} AS line FROM judged
UNION ALL SELECT id, 1, 'match_count rule=returned count=' || atoms FROM judged
UNION ALL SELECT id, 2, 'rejection_reason=' || reason FROM judged WHERE reason IS NOT NULL
UNION ALL SELECT l_orderkey, 3, 'evidence id=' || l_linenumber || ' type=' || l_returnflag || ' key=' || l_partkey || ' value=' || l_suppkey || ' confidence=' || {_SHOWN.format("round(1 - l_discount, 6)")} FROM lineitem WHERE l_orderkey IN (SELECT id FROM judged)""")
def explain_candidates(t: Tables) -> DataFrame:
    """The lines that explain each candidate (head, match counts, reasons, evidence), as rows in the order of part and line, so that no list grows."""
    judged = _judged(t)
    head = F.concat(F.lit("candidate="), "id", F.lit(" key="), "correlation_key", F.lit(" state="), F.when(F.col("reason").isNull(), "admitted").otherwise("rejected"), F.lit(" confidence="), F.expr(_SHOWN.format("confidence")))
    said = F.array(*[F.struct(F.lit(n).alias("part"), line.alias("line")) for n, line in enumerate((head, F.concat(F.lit("match_count rule=returned count="), "atoms"), F.concat(F.lit("rejection_reason="), "reason")))])
    about = judged.select("id", F.inline(said)).where("line IS NOT NULL")
    text = F.concat(F.lit("evidence id="), "l_linenumber", F.lit(" type="), "l_returnflag", F.lit(" key="), "l_partkey", F.lit(" value="), "l_suppkey", F.lit(" confidence="), F.expr(_SHOWN.format("round(1 - l_discount, 6)")))
    atoms = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").select(F.col("l_orderkey").alias("id"), F.lit(3).alias("part"), text.alias("line"))
    return about.unionByName(atoms)


@R.add("""WITH active AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS id FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT e.user_id AS scope, e.event_id AS generation, CASE WHEN e.event_type <> 'purchase' THEN 'pending' WHEN e.event_id = a.id THEN 'active' ELSE 'superseded' END AS status FROM events e LEFT JOIN active a USING (user_id)""")
def generation_activation(t: Tables) -> DataFrame:
    """Relationship generations of each scope (events of a user): the last one activated (a purchase) is active, those before it are superseded, the others pending."""
    done = F.col("event_type") == "purchase"
    active = t.events.where(done).groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("id"))
    status = F.when(~done, "pending").when(F.col("event_id") == F.col("id"), "active").otherwise("superseded")
    return t.events.join(active, "user_id", "left").select(F.col("user_id").alias("scope"), F.col("event_id").alias("generation"), status.alias("status"))


QUERIES, SQL = R.queries, R.sql
