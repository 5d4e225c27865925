"""Extractors on small files."""

import pytest

from loomgraph.functions import extract
from loomgraph.functions.lineage import column_lineage
from loomgraph.functions.reachability import reachability
from loomgraph.sources import files as S

FILES = {
    "app/main.py": "import os\nfrom a.b import c\n\nclass App(Base):\n    def run(self):\n        helper(os.getcwd())\n\ndef helper(x):\n    return x\n",
    "cmd/main.go": "package main\n\ntype Server struct {\n}\n\nfunc main() {\n\tserve()\n}\n\nfunc (s *Server) serve() {}\n",
    "web/a.ts": "import x from 'lib/x'\nexport const go = (a) => a\nfunction other() { go(1) }\n",
    "db/schema.sql": "CREATE TABLE users (id int, org int REFERENCES orgs(id));\nCREATE VIEW v AS SELECT * FROM users JOIN orgs ON true;\nCREATE INDEX ix ON users (id);\n",
    "infra/main.tf": 'module "net" {\n  source = "../modules/net"\n}\nresource "aws_s3_bucket" "logs" {}\n',
    "infra/modules/net/main.tf": 'variable "cidr" {}\n',
    "infra/modules/old/main.tf": 'output "x" {}\n',
    "Dockerfile": "FROM golang:1.22 AS build\nFROM scratch\n",
    "k8s/a.yaml": "apiVersion: v1\nkind: Service\nmetadata:\n  name: web\n  namespace: prod\n---\napiVersion: apps/v1\nkind: Deployment\nmetadata:\n  name: 'web'\n",
    ".github/workflows/ci.yml": "jobs:\n  b:\n    steps:\n      - uses: actions/checkout@v4\n",
    "node_modules/x.js": "function skipped() {}\n",
    "api/openapi.json": '{"openapi": "3.0.0", "paths": {"/users": {"get": {"operationId": "list"}, "parameters": []}, "/users/{id}": {"delete": {}}}}',
    "data/replay.json": '{"dashboards": [{"dashboard_id": "d1", "consumes_assets": ["a", "b"]}], "owners": [{"owner_id": "o", "owns_assets": ["a"]}, {"owner_id": "p"}]}',
    "dbt/manifest.json": '{"nodes": {"model.p.m": {"name": "m", "resource_type": "model", "relation_name": "db.m", "depends_on": {"nodes": ["source.u"]}, "columns": {"b": {"name": "b"}, "a": {"name": "a"}}, "compiled_code": "select u.id as user_id, count(o.id) as n, cast(u.age as int) as age, coalesce(u.x, o.y) as z, u.a + o.b as t, name from users u join orders as o on true"}}}',
}


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for path, text in FILES.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return S.scan(spark, str(root), "repo:1").cache()


def test_scan(tree):
    rows = {r["path"]: r for r in tree.collect()}
    assert set(rows) >= set(FILES) and rows[".github/workflows/ci.yml"]["skip"] is None
    assert rows["node_modules/x.js"]["skip"] == "folder" and rows["app/main.py"]["skip"] is None
    assert (rows["Dockerfile"]["language"], rows["cmd/main.go"]["language"], rows["web/a.ts"]["language"]) == ("dockerfile", "go", "typescript")
    ids = {r["fact_id"] for r in S.facts(tree).collect()}
    assert len(ids) == sum(r["skip"] is None for r in rows.values()) and ids == {r["fact_id"] for r in S.facts(tree).collect()}


def test_symbols(tree):
    found = {(r["path"], r["kind"], r["name"], r["line"]) for r in extract.symbols(tree.where("skip IS NULL")).collect()}
    assert found >= {
        ("app/main.py", "Class", "App", 4), ("app/main.py", "Function", "run", 5), ("app/main.py", "Function", "helper", 8), ("app/main.py", "Import", "a.b", 2), ("cmd/main.go", "Struct", "Server", 3),
        ("cmd/main.go", "Function", "main", 6), ("cmd/main.go", "Function", "serve", 10), ("web/a.ts", "Function", "go", 2), ("web/a.ts", "Function", "other", 3), ("web/a.ts", "Import", "lib/x", 1),
        ("db/schema.sql", "SqlTable", "users", 1), ("db/schema.sql", "SqlView", "v", 2), ("db/schema.sql", "SqlIndex", "ix", 3), ("infra/main.tf", "TerraformModule", "net", 1), ("infra/main.tf", "TerraformResource", "logs", 4), ("Dockerfile", "DockerStage", "build", 1),
    }
    spans = {r["name"]: (r["line"], r["end_line"]) for r in extract.spans(extract.symbols(tree.where("path = 'app/main.py'"))).collect()}
    assert spans == {"App": (4, 4), "run": (5, 7), "helper": (8, None)}


def test_calls_and_mentions(tree):
    assert {(r["path"], r["callee"]) for r in extract.calls(tree.where("skip IS NULL")).collect()} >= {("app/main.py", "helper"), ("cmd/main.go", "serve"), ("web/a.ts", "go")}
    assert not {r["callee"] for r in extract.calls(tree.where("path = 'cmd/main.go'")).collect()} & {"main", "func"}
    assert {(r["kind"], r["name"]) for r in extract.table_mentions(tree.where("language = 'sql'")).collect()} == {("reference", "orgs"), ("select", "users"), ("select", "orgs")}


def test_documents_and_references(tree):
    assert {(r["document"], r["kind"], r["name"], r["namespace"]) for r in extract.documents(tree).collect()} == {(0, "Service", "web", "prod"), (1, "Deployment", "web", None)}
    found = {(r["evidence"], r["target"]) for r in extract.references(tree).collect()}
    assert found >= {("terraform_module_source", "../modules/net"), ("dockerfile_base", "golang:1.22")}


def test_reachability(tree):
    assert {(r["family"], r["name"]): r["reachability"] for r in reachability(tree).collect()} == {("terraform", "net"): "used", ("terraform", "old"): "unused"}


def test_lineage(tree):
    models = extract.manifest_models(tree)
    m = models.first()
    assert (m["name"], m["upstream"], m["columns"]) == ("m", ["source.u"], ["a", "b"])
    known, gaps = column_lineage(models)
    rows = {(r["output"], x, r["kind"]) for r in known.collect() for x in r["sources"]}
    assert rows == {
        ("user_id", "users.id", "direct"), ("n", "orders.id", "aggregate"), ("age", "users.age", "cast"), ("z", "users.x", "function"), ("z", "orders.y", "function"),
        ("t", "users.a", "arithmetic"), ("t", "orders.b", "arithmetic"),
    }
    # Without a catalogue a column that names no table isn't resolved.
    assert [(r["reference"], r["reason"]) for r in gaps.collect()] == [("name", "unqualified_column_reference_not_resolved")]


def test_json_documents(tree):
    assert {(r["route"], r["method"], r["operation_id"]) for r in extract.api_endpoints(tree).collect()} == {("/users", "get", "list"), ("/users/{id}", "delete", None)}
    assert {(r["src"], r["type"], r["dst"]) for r in extract.asset_relationships(tree).collect()} == {("d1", "POWERS", "a"), ("d1", "POWERS", "b"), ("o", "OWNS", "a")}


def test_workflows_are_read(tree):
    assert {(r["evidence"], r["target"]) for r in extract.references(tree.where("path LIKE '.github/%'")).collect()} == {("github_actions_uses", "actions/checkout@v4")}


def test_repository_of(spark):
    want = {"git::https://host/org/n1.git": "n1", "git::https://host/org/n1.git?ref=v2": "n1", "host:5000/team/img:1.2": "img", "org/act@v1": "act", "../../n3": "n3", "https://h/charts/": "charts", "https://host/org/mod.git//sub?ref=x": "mod", "scratch": "scratch", "img@sha256:abc": "img"}
    df = spark.createDataFrame([(k,) for k in want], "t string")
    from pyspark.sql import functions as F

    assert {r[0]: r[1] for r in df.select("t", extract.repository_of(F.col("t"))).collect()} == want


def test_units_and_decorators(spark):
    rows = [("repo:a", "svc/api/Dockerfile", "FROM x", "dockerfile"), ("host/a", "Dockerfile", "FROM x", "dockerfile"), ("r", "Dockerfile.web", "FROM x", "dockerfile"), ("r", "a.py", "@Pytest.Fixture(scope='x')\ndef f():\n  pass\nclass C(A, metaclass = m.Meta):\n  pass", "python"), ("r", "b.py", None, "python")]
    files = spark.createDataFrame(rows, "repo_id string, path string, content string, language string")
    assert {r["unit"] for r in extract.deployable_units(files).collect()} == {"api", "a", "web"}
    assert [tuple(r) for r in extract.decorators(files).collect()] == [("r", "a.py", 1, "pytest.fixture")]
    assert [tuple(r)[2:] for r in extract.metaclasses(files).collect()] == [(4, "C", "m.Meta")]
