"""Extractors over file contents that Spark writes from the tables: each query reads back what the rows say, so its SQL knows the answer from the columns alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract, lineage, semantics
from ..sources.files import language_of
from ..sources.tables import Tables, node_id
from .registry import Registry

R = Registry()


def _files(rows: DataFrame, repo: Column, path: Column, content: Column) -> DataFrame:
    """A table of files (repo_id, path, content, language)."""
    return rows.select(repo.alias("repo_id"), path.alias("path"), content.alias("content")).withColumn("language", language_of("path"))


def _code(t: Tables) -> DataFrame:
    """A source file for each part, in one of five languages by its size: a class or struct, a function of its own that calls the next one's."""
    own, other = F.concat(F.lit("run"), F.col("p_partkey")), F.concat(F.lit("run"), F.col("p_partkey") + 1)
    kind = F.col("p_size") % 5
    shapes = [
        ("py", F.concat(F.lit("import os\n\nclass C"), "p_partkey", F.lit("(Base):\n    def "), own, F.lit("(self):\n        return "), other, F.lit("(1)\n"))),
        ("go", F.concat(F.lit("package main\n\ntype C"), "p_partkey", F.lit(" struct {\n}\n\nfunc "), own, F.lit("() {\n\t"), other, F.lit("()\n}\n"))),
        ("ts", F.concat(F.lit("import x from 'lib'\nexport class C"), "p_partkey", F.lit(" {}\nfunction "), own, F.lit("() {\n  "), other, F.lit("(2)\n}\n"))),
        ("rs", F.concat(F.lit("pub struct C"), "p_partkey", F.lit(";\nfn "), own, F.lit("() {\n    "), other, F.lit("();\n}\n"))),
        ("rb", F.concat(F.lit("class C"), "p_partkey", F.lit("\n  def "), own, F.lit("\n    "), other, F.lit("(3)\n  end\nend\n"))),
    ]
    end, content = (F.coalesce(*[F.when(kind == k, F.lit(x[0]) if i == 0 else x[1]) for k, x in enumerate(shapes)]) for i in (0, 1))
    return _files(t.part, F.concat(F.lit("repo:"), F.col("p_size") % 25), F.concat(F.lit("src/f"), "p_partkey", F.lit("."), end), content)


_LANGUAGES = "CASE p_size % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'go' WHEN 2 THEN 'typescript' WHEN 3 THEN 'rust' ELSE 'ruby' END"
_TYPE = "CASE WHEN p_size % 5 IN (1, 3) THEN 'Struct' ELSE 'Class' END"


@R.add(f"""SELECT {_LANGUAGES} AS language, {_TYPE} AS kind, 'C' || p_partkey AS name, CASE p_size % 5 WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS line FROM part
UNION ALL SELECT {_LANGUAGES}, 'Function', 'run' || p_partkey, CASE p_size % 5 WHEN 0 THEN 4 WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 2 END FROM part
UNION ALL SELECT {_LANGUAGES}, 'Import', CASE p_size % 5 WHEN 0 THEN 'os' ELSE 'lib' END, 1 FROM part WHERE p_size % 5 IN (0, 2)""")
def extract_symbols(t: Tables) -> DataFrame:
    """Definitions and imports of source files in five languages."""
    return extract.symbols(_code(t)).select("language", "kind", "name", "line")


@R.add("""SELECT 'src/f' || p_partkey || '.' || CASE p_size % 5 WHEN 0 THEN 'py' WHEN 1 THEN 'go' WHEN 2 THEN 'ts' WHEN 3 THEN 'rs' ELSE 'rb' END AS path, CASE p_size % 5 WHEN 0 THEN 5 WHEN 1 THEN 7 WHEN 2 THEN 4 ELSE 3 END AS line, 'run' || (p_partkey + 1) AS callee FROM part
UNION ALL SELECT 'src/f' || p_partkey || '.py', 3, 'C' || p_partkey FROM part WHERE false""")
def extract_calls(t: Tables) -> DataFrame:
    """Calls in source files, without the lines that define what they name."""
    return extract.calls(_code(t)).select("path", "line", "callee")


@R.add("""SELECT a.p_partkey AS caller, b.p_partkey AS callee FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def extract_call_edges(t: Tables) -> DataFrame:
    """CALLS from the file that calls a name to the one that defines it, by the unique definition of the name."""
    files = _code(t)
    defined = extract.symbols(files).where("kind = 'Function'").groupBy("name").agg(F.min("path").alias("home"), F.count(F.lit(1)).alias("n")).where("n = 1")
    key = lambda c: F.regexp_extract(c, r"f([0-9]+)[.]", 1).cast("long")
    return extract.calls(files).join(defined, F.col("callee") == F.col("name")).select(key(F.col("path")).alias("caller"), key(F.col("home")).alias("callee"))


@R.add(f"""SELECT 'src/f' || p_partkey AS file, 'C' || p_partkey AS name, CASE p_size % 5 WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS line, CASE p_size % 5 WHEN 0 THEN 3 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 1 END AS end_line FROM part
UNION ALL SELECT 'src/f' || p_partkey, 'run' || p_partkey, CASE p_size % 5 WHEN 0 THEN 4 WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 2 END, NULL FROM part""")
def extract_spans(t: Tables) -> DataFrame:
    """Line spans of definitions."""
    return extract.spans(extract.symbols(_code(t))).select(F.substring_index("path", ".", 1).alias("file"), "name", "line", "end_line")


def _sql_files(t: Tables) -> DataFrame:
    """A migration for each supplier: its table with a foreign key, a view over it, an index and a row."""
    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    content = F.concat(
        F.lit("CREATE TABLE IF NOT EXISTS t"), k, F.lit(" (id int, n int REFERENCES nation"), n, F.lit("(id));\nCREATE OR REPLACE VIEW v"), k, F.lit(" AS SELECT * FROM t"), k, F.lit(" x JOIN nation"), n,
        F.lit(" y ON x.n = y.id;\nCREATE UNIQUE INDEX i"), k, F.lit(" ON t"), k, F.lit(" (id);\nINSERT INTO t"), k, F.lit(" VALUES (1, 2);\nUPDATE t"), k, F.lit(" SET n = 3;\n"),
    )
    return _files(t.supplier, node_id("repo", "s_nationkey"), F.concat(F.lit("db/m"), k, F.lit(".sql")), content)


@R.add("SELECT 'repo:' || s_nationkey AS repo_id, kind, name || s_suppkey AS name, line FROM supplier, (VALUES ('SqlTable', 't', 1), ('SqlView', 'v', 2), ('SqlIndex', 'i', 3)) x(kind, name, line)")
def extract_sql_objects(t: Tables) -> DataFrame:
    """Tables, views and indexes that migrations create."""
    return extract.symbols(_sql_files(t)).select("repo_id", "kind", "name", "line")


@R.add("""SELECT kind, target AS name, count(*) AS n FROM (
  SELECT 'reference' AS kind, 'nation' || s_nationkey AS target FROM supplier UNION ALL SELECT 'select', 't' || s_suppkey FROM supplier UNION ALL SELECT 'select', 'nation' || s_nationkey FROM supplier
  UNION ALL SELECT 'insert', 't' || s_suppkey FROM supplier UNION ALL SELECT 'update', 't' || s_suppkey FROM supplier) GROUP BY 1, 2""")
def extract_table_mentions(t: Tables) -> DataFrame:
    """How often migrations mention each table, by how."""
    return extract.table_mentions(_sql_files(t)).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))


def _manifests(t: Tables) -> DataFrame:
    """A file of two Kubernetes documents for each customer."""
    k = F.col("c_custkey").cast("string")
    content = F.concat(
        F.lit("apiVersion: v1\nkind: Service\nmetadata:\n  name: app"), k, F.lit("\n  namespace: ns"), F.col("c_nationkey").cast("string"),
        F.lit("\n---\napiVersion: apps/v1\nkind: Deployment\nmetadata:\n  name: 'app"), k, F.lit("'\n  namespace: ns"), F.col("c_nationkey").cast("string"), F.lit("\nspec:\n  image: registry/app"), k, F.lit(":1\n"),
    )
    return _files(t.customer, node_id("repo", "c_nationkey"), F.concat(F.lit("k8s/"), k, F.lit(".yaml")), content)


@R.add("SELECT 'repo:' || c_nationkey AS repo_id, api_version, kind, 'app' || c_custkey AS name, 'ns' || c_nationkey AS namespace FROM customer, (VALUES ('v1', 'Service'), ('apps/v1', 'Deployment')) x(api_version, kind)")
def extract_yaml_documents(t: Tables) -> DataFrame:
    """Kubernetes documents of YAML files, by kind, name and namespace."""
    return extract.documents(_manifests(t)).select("repo_id", "api_version", "kind", "name", "namespace")


@R.add("SELECT 'ns' || c_nationkey AS namespace, 'app' || c_custkey AS service, 'app' || c_custkey AS deployment, count(*) AS n FROM customer GROUP BY ALL")
def extract_selects(t: Tables) -> DataFrame:
    """SELECTS from the extracted services to the deployments of the same namespace and name."""
    docs = extract.documents(_manifests(t))
    deployments = docs.where("kind = 'Deployment'").select("namespace", "name", F.col("name").alias("deployment"))
    services = docs.where("kind = 'Service'").select("namespace", "name", F.col("name").alias("service"))
    return services.join(deployments, ["namespace", "name"]).groupBy("namespace", "service", "deployment").agg(F.count(F.lit(1)).alias("n"))


def _infrastructure(t: Tables) -> DataFrame:
    """Terraform, Dockerfile, workflow, compose, Argo, Kustomize and Helm files, one for each supplier by its key."""
    k, other = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    shapes = [
        ("main.tf", F.concat(F.lit('module "m'), k, F.lit('" {\n  source = "git::https://host/org/n'), other, F.lit('.git"\n}\nresource "aws_s3_bucket" "b'), k, F.lit('" {}\nvariable "v" {}\n'))),
        ("Dockerfile", F.concat(F.lit("FROM host/n"), other, F.lit(":1 AS build\nFROM scratch\n"))),
        (".github/workflows/ci.yml", F.concat(F.lit("jobs:\n  b:\n    steps:\n      - uses: org/n"), other, F.lit("@v1\n"))),
        ("docker-compose.yml", F.concat(F.lit("services:\n  s"), k, F.lit(":\n    image: host/n"), other, F.lit(":2\n"))),
        ("argo/app.yaml", F.concat(F.lit("kind: Application\nspec:\n  source:\n    repoURL: https://host/org/n"), other, F.lit(".git\n"))),
        ("k/kustomization.yaml", F.concat(F.lit("resources:\n  - ../../n"), other, F.lit("\n"))),
        ("Chart.yaml", F.concat(F.lit("dependencies:\n  - name: x\n    repository: https://host/n"), other, F.lit("\n"))),
    ]
    kind = F.col("s_suppkey") % len(shapes)
    path, content = (F.coalesce(*[F.when(kind == n, F.concat(F.lit("s"), k, F.lit("/"), F.lit(x[0])) if i == 0 else x[1]) for n, x in enumerate(shapes)]) for i in (0, 1))
    return _files(t.supplier, F.concat(F.lit("repo:s"), k), path, content)


_TARGET = "CASE s_suppkey % 7 WHEN 0 THEN 'git::https://host/org/n' || s_nationkey || '.git' WHEN 1 THEN 'host/n' || s_nationkey || ':1' WHEN 2 THEN 'org/n' || s_nationkey || '@v1' WHEN 3 THEN 'host/n' || s_nationkey || ':2' WHEN 4 THEN 'https://host/org/n' || s_nationkey || '.git' WHEN 5 THEN '../../n' || s_nationkey ELSE 'https://host/n' || s_nationkey END"
_KINDS = "(VALUES (0, 'terraform_module_source', 'USES_MODULE', 0.98), (1, 'dockerfile_base', 'DEPENDS_ON', 0.88), (2, 'github_actions_uses', 'DEPENDS_ON', 0.88), (3, 'compose_image', 'DEPLOYS_FROM', 0.88), (4, 'argocd_repo', 'DEPLOYS_FROM', 0.95), (5, 'kustomize_resource', 'DEPLOYS_FROM', 0.9), (6, 'helm_dependency', 'DEPLOYS_FROM', 0.9)) x(k, evidence, relationship, confidence)"
_EVIDENCE = f"""SELECT 'repo:s' || s_suppkey AS repo_id, evidence, relationship, confidence::DOUBLE AS confidence, {_TARGET} AS target, 'n' || s_nationkey AS name FROM supplier JOIN {_KINDS} ON k = s_suppkey % 7
UNION ALL SELECT 'repo:s' || s_suppkey, 'dockerfile_base', 'DEPENDS_ON', 0.88, 'scratch', 'scratch' FROM supplier WHERE s_suppkey % 7 = 1"""


@R.add(f"SELECT repo_id, evidence, relationship, confidence, target FROM ({_EVIDENCE})")
def extract_references(t: Tables) -> DataFrame:
    """What infrastructure files of seven families say they depend on or are deployed from."""
    return extract.references(_infrastructure(t)).select("repo_id", "evidence", "relationship", "confidence", "target")


@R.add("""SELECT 'repo:s' || s_suppkey AS repo_id, kind, name FROM (
  SELECT s_suppkey, 'TerraformModule' AS kind, 'm' || s_suppkey AS name FROM supplier WHERE s_suppkey % 7 = 0 UNION ALL SELECT s_suppkey, 'TerraformResource', 'b' || s_suppkey FROM supplier WHERE s_suppkey % 7 = 0
  UNION ALL SELECT s_suppkey, 'TerraformVariable', 'v' FROM supplier WHERE s_suppkey % 7 = 0 UNION ALL SELECT s_suppkey, 'DockerStage', 'build' FROM supplier WHERE s_suppkey % 7 = 1
  UNION ALL SELECT s_suppkey, 'DockerImage', 'host/n' || s_nationkey || ':1' FROM supplier WHERE s_suppkey % 7 = 1 UNION ALL SELECT s_suppkey, 'DockerImage', 'scratch' FROM supplier WHERE s_suppkey % 7 = 1
  UNION ALL SELECT s_suppkey, 'ComposeService', 's' || s_suppkey FROM supplier WHERE s_suppkey % 7 = 3)""")
def extract_infra_blocks(t: Tables) -> DataFrame:
    """Terraform blocks, Docker stages and images, and compose services."""
    return extract.symbols(_infrastructure(t)).select("repo_id", "kind", "name")


@R.add(f"SELECT evidence, target, name AS repository, target <> name AS had_more FROM ({_EVIDENCE})")
def normalise_references(t: Tables) -> DataFrame:
    """The repository that each kind of reference names: of git sources, images, actions, charts and relative paths."""
    found = extract.references(_infrastructure(t))
    return found.select("evidence", "target", extract.repository_of(F.col("target")).alias("repository")).withColumn("had_more", F.col("target") != F.col("repository"))


@R.add(f"""WITH e AS ({_EVIDENCE}), repos AS (SELECT 'n' || n_nationkey AS name, 'repo:' || n_nationkey AS id FROM nation)
SELECT relationship, id AS target_repo, count(*) AS evidence_count, max(confidence) AS confidence, count(DISTINCT repo_id) AS sources FROM e JOIN repos USING (name) WHERE confidence >= 0.85 GROUP BY 1, 2""")
def cross_repo_resolution(t: Tables) -> DataFrame:
    """Cross-repository edges from evidence: references resolved to the catalogue by the repository they name, admitted by confidence, gathered by type and target."""
    catalogue = t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("name"), node_id("repo", "n_nationkey").alias("target_repo"))
    found = extract.references(_infrastructure(t)).where("confidence >= 0.85").withColumn("name", extract.repository_of(F.col("target")))
    return found.join(F.broadcast(catalogue), "name").groupBy("relationship", "target_repo").agg(F.count(F.lit(1)).alias("evidence_count"), F.max("confidence").alias("confidence"), F.count_distinct("repo_id").alias("sources"))


@R.add("""SELECT 'repo:s' || s_suppkey AS repo_id, 's' || s_suppkey || '/Dockerfile' AS path, 's' || s_suppkey AS unit FROM supplier WHERE s_suppkey % 7 = 1""")
def deployable_units(t: Tables) -> DataFrame:
    """The deployable unit of each Dockerfile: its folder's name, or the repository's for one at the top."""
    return extract.deployable_units(_infrastructure(t))


@R.add("""SELECT '/c' || c_custkey AS route, method, method || 'C' || c_custkey AS operation_id FROM customer, (VALUES ('get'), ('post')) m(method)""")
def extract_api_endpoints(t: Tables) -> DataFrame:
    """Operations of OpenAPI documents."""
    k = F.col("c_custkey").cast("string")
    content = F.concat(F.lit('{"openapi": "3.0.0", "paths": {"/c'), k, F.lit('": {"get": {"operationId": "getC'), k, F.lit('"}, "post": {"operationId": "postC'), k, F.lit('"}, "parameters": []}}}'))
    files = _files(t.customer, node_id("repo", "c_nationkey"), F.concat(F.lit("api/"), k, F.lit(".json")), content)
    return extract.api_endpoints(files).select("route", "method", "operation_id")


def _dbt(t: Tables) -> DataFrame:
    """A dbt manifest with one model for each customer."""
    k = F.col("c_custkey").cast("string")
    content = F.concat(
        F.lit('{"nodes": {"model.p.m'), k, F.lit('": {"name": "m'), k, F.lit('", "resource_type": "model", "relation_name": "db.m'), k, F.lit('", "depends_on": {"nodes": ["source.n'), F.col("c_nationkey").cast("string"),
        F.lit('"]}, "columns": {"id": {"name": "id"}, "n": {"name": "n"}}, "compiled_code": "select c.id as id, count(o.id) as n, * from c'), k, F.lit(' c join orders as o on c.id = o.id"}}}'),
    )
    return _files(t.customer, node_id("repo", "c_nationkey"), F.concat(F.lit("dbt/"), k, F.lit("/manifest.json")), content)


@R.add("SELECT 'm' || c_custkey AS name, 'db.m' || c_custkey AS relation, 'source.n' || c_nationkey AS upstream, 'id,n' AS columns FROM customer")
def extract_dbt_models(t: Tables) -> DataFrame:
    """Models of dbt manifests, what they stand on, and their columns."""
    return extract.manifest_models(_dbt(t)).select("name", "relation", F.explode("upstream").alias("upstream"), F.array_join("columns", ",").alias("columns"))


@R.add("""SELECT 'model.p.m' || c_custkey AS model, output, replace(source, '$', 'c' || c_custkey) AS source, kind FROM customer, (VALUES ('id', '$.id', 'direct'), ('n', 'orders.id', 'aggregate'), ('*', '*', 'unresolved')) x(output, source, kind)""")
def extract_column_lineage(t: Tables) -> DataFrame:
    """Column lineage of compiled models: direct, aggregated and unresolved columns, with aliases resolved to tables."""
    known, gaps = lineage.column_lineage(extract.manifest_models(_dbt(t)))
    named = known.select("model", "output", F.explode("sources").alias("source"), "kind")
    return named.unionByName(gaps.select("model", F.col("reference").alias("output"), F.col("reference").alias("source"), F.lit("unresolved").alias("kind")))


@R.add("SELECT count(*) AS models, sum(3)::BIGINT AS columns, sum(2)::BIGINT AS resolved, sum(1)::BIGINT AS unresolved, round(2 / 3, 6) AS share FROM customer")
def dbt_coverage(t: Tables) -> DataFrame:
    """How much of the models' columns has known lineage."""
    known, gaps = lineage.column_lineage(extract.manifest_models(_dbt(t)))
    each = known.select("model", F.lit(0).alias("bad")).unionByName(gaps.select("model", F.lit(1).alias("bad")))
    total = each.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad")).agg(F.count(F.lit(1)).alias("models"), F.sum("n").alias("columns"), F.sum("bad").alias("unresolved"))
    return total.select("models", "columns", (F.col("columns") - F.col("unresolved")).alias("resolved"), "unresolved", F.round((F.col("columns") - F.col("unresolved")) / F.col("columns"), 6).alias("share"))


@R.add("""SELECT 'd' || s_suppkey AS src, 'POWERS' AS type, 'a' || s_nationkey AS dst FROM supplier UNION ALL SELECT 'o' || s_suppkey, 'OWNS', 'a' || s_nationkey FROM supplier UNION ALL SELECT 'o' || s_suppkey, 'OWNS', 'b' FROM supplier""")
def extract_asset_relations(t: Tables) -> DataFrame:
    """Assets that dashboards show and owners own, of replay files."""
    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    content = F.concat(F.lit('{"dashboards": [{"dashboard_id": "d'), k, F.lit('", "consumes_assets": ["a'), n, F.lit('"]}], "owners": [{"owner_id": "o'), k, F.lit('", "owns_assets": ["a'), n, F.lit('", "b"]}]}'))
    files = _files(t.supplier, node_id("repo", "s_nationkey"), F.concat(F.lit("replay/"), k, F.lit(".json")), content)
    return extract.asset_relationships(files).select("src", "type", "dst")


def _python(t: Tables) -> DataFrame:
    """A Python file for each supplier: a class with a metaclass, and a function, decorated as a route in every third."""
    k = F.col("s_suppkey").cast("string")
    decorator = F.when(F.col("s_suppkey") % 3 == 0, F.lit("@App.Route('/x')\n")).otherwise(F.lit(""))
    content = F.concat(F.lit("class M"), k, F.lit("(Base, metaclass=Meta"), F.col("s_nationkey").cast("string"), F.lit("):\n    pass\n\n"), decorator, F.lit("def f"), k, F.lit("():\n    pass\n"))
    return _files(t.supplier, node_id("repo", "s_nationkey"), F.concat(F.lit("m"), k, F.lit(".py")), content)


@R.add("SELECT 'repo:' || s_nationkey AS repo_id, 'M' || s_suppkey AS class, 'Meta' || s_nationkey AS metaclass FROM supplier")
def metaclass_edges(t: Tables) -> DataFrame:
    """USES_METACLASS of Python classes."""
    return extract.metaclasses(_python(t)).select("repo_id", "class", "metaclass")


@R.add("SELECT 'repo:' || s_nationkey AS repo_id, 'f' || s_suppkey AS name FROM supplier WHERE s_suppkey % 3 <> 0")
def dead_without_decorators(t: Tables) -> DataFrame:
    """Uncalled Python functions other than those with a decorator of a framework, whatever its case and arguments."""
    files = _python(t)
    called = extract.calls(files).select(F.col("callee").alias("name")).distinct()
    functions = extract.symbols(files).where("kind = 'Function'")
    kept = extract.decorators(files).where(F.col("decorator").isin("app.route", "app.get", "pytest.fixture", "click.command", "celery.task")).select("repo_id", "path", "line")
    bare = functions.join(kept.withColumn("line", F.col("line") + 1), ["repo_id", "path", "line"], "left_anti")
    return bare.join(called, "name", "left_anti").select("repo_id", "name")


def _roots(t: Tables) -> DataFrame:
    """A Python file for each supplier: functions under one to four lines of decorators, with arguments over lines, comments between, and decoys; a class with a metaclass that is in the file, in another or nowhere."""
    k = F.col("s_suppkey").cast("string")
    shapes = (
        "@app.route(\n    '/x',\n    methods=['GET'],\n)\n# why\n@Login.Required\n\nasync def f$(): pass\ndef plain$(): pass\n", "x = '@app.route'\n@click.command\n@click.option('--a', help='(')\nclass f$: pass\n",
        "@other\nx = 1\ndef f$():\n    # @app.get\n    pass\n", "class A:\n    @property\n    @cache(size=(1, 2))\n    def f$(self): pass\n    def plain$(self): pass\n",
    )
    kind = F.col("s_suppkey") % 4
    functions = F.coalesce(*[F.when(kind == i, F.lit(x)) for i, x in enumerate(shapes)])
    meta = F.when(kind == 0, F.concat(F.lit("class Own"), k, F.lit("(type): pass\nclass M$(B, metaclass=Own"), k, F.lit("): pass\n"))).when(kind == 1, F.concat(F.lit("class M$(metaclass = base.Own"), F.col("s_suppkey") - 1, F.lit("): pass\n"))).otherwise(F.lit("class M$(metaclass=abc.Lost): pass\n"))
    content = F.replace(F.concat(meta, functions), F.lit("$"), k)
    return _files(t.supplier, F.lit("repo:roots"), F.concat(F.lit("m"), k, F.lit(".py")), content)


@R.add("""SELECT 'm' || s_suppkey || '.py' AS path, 'f' || s_suppkey AS name, line + CASE s_suppkey % 4 WHEN 0 THEN 1 ELSE 0 END AS line, decorators
FROM supplier JOIN (VALUES (0, 9, 'app.route,login.required'), (1, 5, 'click.command,click.option'), (3, 5, 'property,cache')) d(kind, line, decorators) ON kind = s_suppkey % 4""")
def decorator_blocks(t: Tables) -> DataFrame:
    """Decorated definitions with all their decorators, wherever above they begin."""
    return semantics.decorated_definitions(_roots(t)).select("path", "name", "line", F.array_join("decorators", ",").alias("decorators"))


@R.add("""WITH there AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 4 = 0)
SELECT 'M' || s_suppkey AS class, CASE s_suppkey % 4 WHEN 0 THEN 'm' || s_suppkey || '.py' WHEN 1 THEN (SELECT 'm' || k || '.py' FROM there WHERE k = s_suppkey - 1) END AS metaclass_path FROM supplier""")
def metaclass_targets(t: Tables) -> DataFrame:
    """The class that each metaclass is: of the same file, or the only one of that name in the repository."""
    files = _roots(t)
    classes = extract.symbols(files).where("kind = 'Class'").select("repo_id", "path", "name", "line")
    return semantics.resolved_metaclasses(classes, extract.metaclasses(files)).select("class", "metaclass_path")


QUERIES, SQL = R.queries, R.sql
