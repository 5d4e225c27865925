"""Sets of applications by nation that discover the configuration of their customers' services, in shapes by key: who deploys what from where, and where it runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import delivery
from ..sources.tables import Tables
from .registry import Registry

R = Registry()

#: Layouts of a control repository's file; # is the nation.
CONTROLS = (
    "apiVersion: argoproj.io/v1alpha1\nkind: ApplicationSet\nspec:\n  generators:\n  - git:\n      repoURL: https://host/org/cfg#.git\n      files:\n      - path: apps/*/prod/*.yaml\n      - path: apps/{{x}}/readme.md\n  template:\n    spec:\n      source:\n        repoURL: 'https://host/org/{{ .service.repo }}.git'\n      destination:\n        name: Main Cluster #\n",
    "kind: ApplicationSet\nspec:\n  generators:\n    - matrix:\n        generators:\n          - list: {elements: [a]}\n          - git:\n              files: [{path: apps/**/values.yaml}]\n              repoURL: git@host:org/CFG#.git\n    - git:\n        repoURL: '{{url}}'\n        files:\n          - path: apps/**/config.json\n  template:\n    spec:\n      sources:\n        - repoURL: https://host/org/{{.service.repo}}\n        - repoURL: https://host/org/{{.none}}\n      destination: {server: 'https://K8s#.example:6443/x', name: ''}\n",
    "kind: ApplicationSet\nspec:\n  generators:\n  - git: {repoURL: https://host/org/cfg#, files: [{path: /apps/**/*.json}]}\n  template:\n    spec:\n      source: {repoURL: 'ssh://host/{{.service.repo}}.git'}\n      destination:\n        name: '{{.cluster}}'\n        server: https://no\n",
    "kind: Application\nspec:\n  sources:\n  - repoURL: https://host/org/cfg#.git\n  - repoURL: https://host/org/unknown\n  destination:\n    name: edge\n---\nkind: ConfigMap\ndata:\n  a: |\n    kind: ApplicationSet\n    spec:\n      source:\n        repoURL: https://host/org/ctl1\n",
)
#: Shapes of a customer's configuration; $ is the customer.
CONFIGS = (
    ("apps/c$/prod/values.yaml", "service:\n  repo: svc$ # svc0\nname: api\n"),
    ("apps/c$/prod/config.json", '{\n  "service": {"repo": "svc$"},\n  "name": "also$",\n  "list": [{"app": "svc0"}]\n}\n'),
    ("apps/c$/dev/values.yaml", "service:\n  - repo: svc$\nreleaseName: also$\n"),
)

# Known answers: layout of the set, shape of the configuration, what it names.
_DEPLOYED = """SELECT 'repo:' || prefix || c_custkey AS deployed, c_nationkey AS n FROM customer JOIN (VALUES (0, 0, 'svc'), (1, 0, 'svc'), (1, 2, 'also'), (2, 1, 'svc'), (2, 1, 'also')) a(layout, shape, prefix) ON layout = c_nationkey % 4 AND shape = c_custkey % 3"""
_PLATFORM = "CASE n % 4 WHEN 0 THEN 'platform:kubernetes:none:cluster/main-cluster-' || n || ':none:none' WHEN 1 THEN 'platform:kubernetes:none:server/k8s' || n || '.example:6443:none:none' ELSE 'platform:kubernetes:none:cluster/edge:none:none' END"
_FOUND = f"""SELECT *, 'delivery/n' || n || '.yaml' AS path FROM (
SELECT 'argocd_applicationset_discovery' AS evidence, 'DISCOVERS_CONFIG_IN' AS relationship, 0.99::DOUBLE AS confidence, 'repo:ctl' || n_nationkey AS source, 'repo:cfg' || n_nationkey AS target, n_nationkey AS n FROM nation WHERE n_nationkey % 4 < 3
UNION ALL SELECT 'argocd_applicationset_deploy_source', 'DEPLOYS_FROM', 0.99, deployed, 'repo:cfg' || n, n FROM ({_DEPLOYED})
UNION ALL SELECT 'argocd_application_source', 'DEPLOYS_FROM', 0.95, 'repo:ctl' || n_nationkey, 'repo:cfg' || n_nationkey, n_nationkey FROM nation WHERE n_nationkey % 4 = 3
UNION ALL SELECT 'argocd_destination_platform', 'RUNS_ON', 0.97, deployed, {_PLATFORM}, n FROM (SELECT * FROM ({_DEPLOYED}) UNION ALL SELECT 'repo:cfg' || n_nationkey, n_nationkey FROM nation WHERE n_nationkey % 4 = 3) WHERE n % 4 <> 2)"""


def _inputs(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Files and repositories: a control and a configuration repository for each nation, two services for each customer."""
    n, c = F.col("n_nationkey"), F.col("c_custkey")
    text = F.coalesce(*[F.when(n % len(CONTROLS) == i, F.lit(x)) for i, x in enumerate(CONTROLS)])
    controls = t.nation.select(F.concat(F.lit("repo:ctl"), n).alias("repo_id"), F.concat(F.lit("delivery/n"), n, F.lit(".yaml")).alias("path"), F.replace(text, F.lit("#"), n.cast("string")).alias("content"))
    chosen = lambda i: F.replace(F.coalesce(*[F.when(c % len(CONFIGS) == k, F.lit(x[i])) for k, x in enumerate(CONFIGS)]), F.lit("$"), c.cast("string"))
    configs = t.customer.select(F.concat(F.lit("repo:cfg"), "c_nationkey").alias("repo_id"), chosen(0).alias("path"), chosen(1).alias("content"))
    named = lambda df, key, *kinds: [df.select(F.concat(F.lit(f"repo:{k}"), key).alias("repo_id"), F.concat(F.lit(k), key).alias("name")) for k in kinds]
    return controls.unionByName(configs), reduce(DataFrame.unionByName, named(t.nation, "n_nationkey", "ctl", "cfg") + named(t.customer, "c_custkey", "svc", "also"))


@R.add(f"SELECT evidence, relationship, confidence, source, target, path FROM ({_FOUND})")
def delivery_evidence(t: Tables) -> DataFrame:
    """Configuration that sets of applications discover, what it deploys, and where that runs."""
    return delivery.delivery_evidence(*_inputs(t))


@R.add(f"""SELECT target AS platform, count(DISTINCT source) AS repositories, count(DISTINCT path) AS documents FROM ({_FOUND}) WHERE relationship = 'RUNS_ON' GROUP BY target""")
def delivery_platforms(t: Tables) -> DataFrame:
    """How many repositories run on each platform, by how many documents."""
    found = delivery.delivery_evidence(*_inputs(t)).where("relationship = 'RUNS_ON'")
    return found.groupBy(F.col("target").alias("platform")).agg(F.count_distinct("source").alias("repositories"), F.count_distinct("path").alias("documents"))


QUERIES, SQL = R.queries, R.sql
