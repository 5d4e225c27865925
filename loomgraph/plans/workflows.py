"""Workflow and Kubernetes files whose layout differs from key to key (indentation, flows, blocks, comments, quotes), read by their key paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import yaml_paths
from ..sources.tables import Tables, node_id
from .registry import Registry

R = Registry()

#: Layouts of one workflow with a build job and, in most, a second one; $ is the supplier's key, # its nation, ~ its list of systems.
LAYOUTS = (
    "name: ci\non: [push, workflow_dispatch]\njobs:\n  build:\n    strategy:\n      matrix:\n        os: [~]\n        go: ['1', \"2\"]\n    steps:\n      - uses: org/n#@v1\n      - run: make t$\n",
    "# on: push\n'on':\n    push:\n        branches:\n        - main # jobs\n    workflow_call:\n        inputs:\n            target$:\n                type: string\njobs:\n    build:\n        steps:\n        -   name: x\n            run: |\n                # jobs:\n                #   fake:\n                make t$\n        -   uses: 'org/n#@v1'\n    ship:\n        needs: build\n        environment: e#\n",
    "on: push\njobs:\n  ship:\n    needs: [build, lint$]\n    uses: org/n#/.github/workflows/w.yml@v1\n  build:\n    timeout-minutes: 5\n    strategy: &s\n      matrix:\n        include: [a]\n        os:\n          - ~\n    steps:\n      - {uses: org/n#@v2, name: y}\n      -\n        run: make t$\n...\n",
    "on:\n  schedule:\n    - cron: '0 0 * * *'\njobs:\n  build: {runs-on: x, if: always$}\n",
)

_PATH = "'.github/workflows/w' || s_suppkey || '.yml'"
# Known answers: layout, kind, job, value.
_ANSWERS = """(VALUES (0, 'trigger', NULL, 'push'), (0, 'trigger', NULL, 'workflow_dispatch'), (0, 'matrix', 'build', 'os'), (0, 'matrix', 'build', 'go'), (0, 'action', 'build', 'org/n#'), (0, 'run', 'build', 'make t$'),
  (1, 'trigger', NULL, 'push'), (1, 'trigger', NULL, 'workflow_call'), (1, 'input', NULL, 'target$'), (1, 'action', 'build', 'org/n#'), (1, 'needs', 'ship', 'build'), (1, 'environment', 'ship', 'e#'),
  (2, 'trigger', NULL, 'push'), (2, 'needs', 'ship', 'build'), (2, 'needs', 'ship', 'lint$'), (2, 'reusable_workflow', 'ship', 'org/n#'), (2, 'timeout', 'build', '5'), (2, 'matrix', 'build', 'os'), (2, 'action', 'build', 'org/n#'), (2, 'run', 'build', 'make t$'),
  (3, 'trigger', NULL, 'schedule'), (3, 'condition', 'build', 'always$')) a(layout, kind, job, value)"""
_FOUND = f"""SELECT 'repo:' || s_nationkey AS repo_id, {_PATH} AS path, kind, job, replace(replace(value, '$', s_suppkey::VARCHAR), '#', s_nationkey::VARCHAR) AS value FROM supplier JOIN {_ANSWERS} ON layout = s_suppkey % 4
UNION ALL SELECT 'repo:' || s_nationkey, {_PATH}, 'run', 'build', '# jobs:' || chr(10) || '#   fake:' || chr(10) || 'make t' || s_suppkey FROM supplier WHERE s_suppkey % 4 = 1"""


def _workflows(t: Tables) -> DataFrame:
    """A workflow for each supplier."""
    key, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    layout = F.col("s_suppkey") % len(LAYOUTS)
    text = F.coalesce(*[F.when(layout == i, F.lit(x)) for i, x in enumerate(LAYOUTS)])
    systems = F.transform(F.sequence(F.lit(0), F.col("s_nationkey") % 4), lambda i: F.concat(F.lit("s"), i.cast("string")))
    between = F.when(layout == 2, F.lit("\n          - ")).otherwise(F.lit(", "))
    joined = F.aggregate(F.slice(systems, F.lit(2), F.greatest(F.size(systems), F.lit(1))), F.get(systems, F.lit(0)), lambda a, x: F.concat(a, between, x))
    filled = F.replace(F.replace(F.replace(text, F.lit("$"), key), F.lit("#"), nation), F.lit("~"), joined)
    # In the layouts # begins comments too, where a number must not stand.
    filled = F.when(layout == 1, F.replace(F.replace(F.replace(F.replace(filled, F.concat(nation, F.lit(" on: push")), F.lit("# on: push")), F.concat(F.lit("main "), nation), F.lit("main #")), F.concat(nation, F.lit(" jobs:")), F.lit("# jobs:")), F.concat(nation, F.lit("   fake")), F.lit("#   fake"))).otherwise(filled)
    return t.supplier.select(node_id("repo", "s_nationkey").alias("repo_id"), F.concat(F.lit(".github/workflows/w"), key, F.lit(".yml")).alias("path"), filled.alias("content"))


@R.add(_FOUND)
def workflow_artifacts(t: Tables) -> DataFrame:
    """Triggers, inputs, needs, conditions, environments, actions, reusable workflows, commands, timeouts and matrix keys of workflows."""
    return yaml_paths.workflow_artifacts(yaml_paths.paths(_workflows(t)))


@R.add(f"""SELECT 'repo:' || s_nationkey AS repo_id, {_PATH} AS path, 'build' AS job, (CASE s_suppkey % 4 WHEN 0 THEN 2 ELSE 1 END * (s_nationkey % 4 + 1))::BIGINT AS combinations FROM supplier WHERE s_suppkey % 4 IN (0, 2)""")
def workflow_matrix(t: Tables) -> DataFrame:
    """How many combinations the matrix of each job has."""
    return yaml_paths.matrix_sizes(yaml_paths.paths(_workflows(t))).select("repo_id", "path", "job", "combinations")


@R.add(f"""WITH f AS ({_FOUND}) SELECT repo_id, count(DISTINCT path) FILTER (WHERE kind = 'trigger') AS workflows, count(DISTINCT value) FILTER (WHERE kind IN ('action', 'reusable_workflow')) AS repositories,
  count(*) FILTER (WHERE kind = 'run') AS commands, count(*) FILTER (WHERE kind = 'needs') AS needs, count(DISTINCT path) FILTER (WHERE kind IN ('environment', 'reusable_workflow')) AS deploying FROM f GROUP BY repo_id""")
def workflow_overview(t: Tables) -> DataFrame:
    """Each repository's workflows, the repositories that they use, their commands and which of them deploy."""
    f = yaml_paths.workflow_artifacts(yaml_paths.paths(_workflows(t)))
    is_ = lambda *k: F.col("kind").isin(*k)
    return f.groupBy("repo_id").agg(
        F.count_distinct(F.when(is_("trigger"), F.col("path"))).alias("workflows"), F.count_distinct(F.when(is_("action", "reusable_workflow"), F.col("value"))).alias("repositories"),
        F.count(F.when(is_("run"), 1)).alias("commands"), F.count(F.when(is_("needs"), 1)).alias("needs"), F.count_distinct(F.when(is_("environment", "reusable_workflow"), F.col("path"))).alias("deploying"),
    )


#: Layouts of one deployment with its service; images stand in containers, init containers and a template's flow.
MANIFESTS = (
    "apiVersion: v1\nkind: Service\nmetadata: {name: app$, namespace: n#}\nspec:\n  selector:\n    app: app$\n---\napiVersion: apps/v1\nkind: Deployment\nmetadata:\n  name: app$\n  namespace: n#\nspec:\n  template:\n    spec:\n      containers:\n      - name: main\n        image: reg/app$:1\n      - name: side\n        image: reg/side#:2\n",
    "kind: Deployment\nmetadata:\n    labels:\n        name: no\n    name: \"app$\"\n    namespace: n#\nspec:\n    template:\n        spec:\n            initContainers:\n                - image: reg/init:1 # image: reg/no:1\n                  name: i\n            containers: [{name: m, image: reg/app$}]\n",
    "kind: ConfigMap\nmetadata:\n  name: app$\n  namespace: n#\ndata:\n  file.yaml: |\n    kind: Deployment\n    spec:\n      image: reg/no:1\n",
)


def _manifests(t: Tables) -> DataFrame:
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    layout = F.col("c_custkey") % len(MANIFESTS)
    text = F.coalesce(*[F.when(layout == i, F.lit(x)) for i, x in enumerate(MANIFESTS)])
    filled = F.replace(F.replace(F.replace(F.replace(text, F.lit(" # image"), F.lit(" @ image")), F.lit("$"), key), F.lit("#"), nation), F.lit(" @ image"), F.lit(" # image"))
    return t.customer.select(node_id("repo", "c_nationkey").alias("repo_id"), F.concat(F.lit("k8s/"), key, F.lit(".yaml")).alias("path"), filled.alias("content"))


@R.add("""SELECT 'n' || c_nationkey AS namespace, 'app' || c_custkey AS name, image FROM customer, LATERAL (SELECT unnest(CASE c_custkey % 3 WHEN 0 THEN ['reg/app' || c_custkey || ':1', 'reg/side' || c_nationkey || ':2'] WHEN 1 THEN ['reg/init:1', 'reg/app' || c_custkey || ':latest'] ELSE [] END) AS image)""")
def kubernetes_images(t: Tables) -> DataFrame:
    """USES_IMAGE: each workload's images, in any container, however the file is laid out; an image without a tag is the latest."""
    found = yaml_paths.paths(_manifests(t))
    document = ["repo_id", "path", "document"]
    dotted = F.array_join(F.filter("keys", lambda k: k != "[]"), ".")
    heads = found.groupBy(*document).agg(
        F.max(F.when(dotted == "kind", F.col("value"))).alias("kind"), F.max(F.when(dotted == "metadata.name", F.col("value"))).alias("name"), F.max(F.when(dotted == "metadata.namespace", F.col("value"))).alias("namespace"),
        F.collect_list(F.when(F.rlike(dotted, F.lit(r"^spec\.template\.spec\.(?:initContainers|containers)\.image$")), F.col("value"))).alias("images"),
    )
    each = heads.where(F.col("kind").isin("Deployment", "StatefulSet", "DaemonSet")).select("namespace", "name", F.explode("images").alias("image"))
    return each.withColumn("image", F.when(F.rlike("image", F.lit(r"[:@][^/]*$")), F.col("image")).otherwise(F.concat("image", F.lit(":latest"))))


QUERIES, SQL = R.queries, R.sql
