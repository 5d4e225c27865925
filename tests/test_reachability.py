"""Artifacts used, ambiguous and unused, by family; interpolated references by words and by literal parts."""

from loomgraph.functions.reachability import reachability

FILES = [
    ("stack", "main.tf", 'module "a" {\n  source = "../tf/modules/checkout?ref=1"\n}\nmodule "b" {\n  source = "../tf/modules/${var.name}"\n}\nvariable "name" { default = "dynamic" }'),
    ("stack", "more.tf", 'module "c" { source = "git::https://h/tf.git//modules/pre-${var.x}-db" }\nmodule "d" { source = "./modules/${a}-mid-${b}" }'),
    *[("tf", f"modules/{n}/main.tf", "x") for n in ("checkout", "orphan", "dynamic", "pre-one-db", "pre-one", "x-mid-y", "xmidy")],
    ("ctl", "argo/a.yaml", "path: charts/web"), ("ctl", "argo/b.yaml", 'path: "charts/{{service}}"\n- service: worker'), *[("charts", f"charts/{n}/Chart.yaml", f"name: {n}") for n in ("web", "worker", "old")],
    ("ops", "ci.yml", "run: ansible-playbook ../ops/playbooks/site.yml"), ("ops", "Jenkinsfile", "sh 'ansible-playbook playbooks/dyn.yml'"), ("ops", "playbooks/site.yml", "roles:\n  - deploy"), ("ops", "playbooks/dyn.yml", 'roles:\n  - "{{ r }}"\nvars:\n  r: picked'),
    ("ops", "playbooks/lost.yml", "roles:\n  - unrun"), *[("ops", f"roles/{n}/tasks/main.yml", "- debug: x") for n in ("deploy", "picked", "unrun")],
    ("kc", "app.yaml", "path: overlays/prod"), ("kc", "dyn.yaml", 'path: "base/{{s}}"\n- s: later'), ("kz", "overlays/prod/kustomization.yaml", "resources:\n  - ../../base/api"), *[("kz", f"base/{n}/kustomization.yaml", "resources:\n  - d.yaml") for n in ("api", "later", "none")],
    ("cc", "deploy.yaml", "- run: docker compose -f ../compose.yaml up -d api worker\n- run: docker compose up -d ${S}\nenv:\n  S: side"), ("app", "compose.yaml", "services:\n  api:\n    image: x\n  worker:\n    image: x\n  side:\n    image: x\n  cache:\n    image: x\nvolumes:\n  data:\n"),
    ("n", "x.tf", None),
]


def test_families(spark):
    files = spark.createDataFrame([(*f, "x") for f in FILES], "repo_id string, path string, content string, language string")
    got = {}
    for r in reachability(files).collect():
        got.setdefault((r["family"], r["reachability"]), set()).add(r["name"])
    assert got == {
        ("terraform", "used"): {"checkout"}, ("terraform", "ambiguous"): {"dynamic", "pre-one-db", "x-mid-y"}, ("terraform", "unused"): {"orphan", "pre-one", "xmidy"},
        ("helm", "used"): {"web"}, ("helm", "ambiguous"): {"worker"}, ("helm", "unused"): {"old"}, ("ansible", "used"): {"deploy"}, ("ansible", "ambiguous"): {"picked"}, ("ansible", "unused"): {"unrun"},
        ("kustomize", "used"): {"prod", "api"}, ("kustomize", "ambiguous"): {"later"}, ("kustomize", "unused"): {"none"}, ("compose", "used"): {"api", "worker"}, ("compose", "ambiguous"): {"side"}, ("compose", "unused"): {"cache"},
    }
