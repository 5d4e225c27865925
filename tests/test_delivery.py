"""Sets of applications on small files: paths with wildcards, slots, sets that name themselves, broken and empty files."""

from pyspark.sql import functions as F

from loomgraph.functions import delivery


def test_paths_with_wildcards(spark):
    found = spark.createDataFrame([("cfg", p) for p in ("a/*/v.yaml", "a/**/v.yaml", "**/v.yaml", "a.b/?.json", "v.yaml", "a/x/y/v.yaml", "no/*.yaml")], "config_repo string, pattern string")
    files = spark.createDataFrame([(r, p, "") for r in ("cfg", "other") for p in ("a/v.yaml", "a/x/v.yaml", "a/x/y/v.yaml", "v.yaml", "a.b/c.json", "aXb/c.json", "a/x/v.txt")], "repo_id string, path string, content string")
    got = {}
    for r in delivery.fitting(files, found).collect():
        got.setdefault(r["pattern"], set()).add(r["config_path"])
    assert got == {
        "a/*/v.yaml": {"a/x/v.yaml"}, "a/**/v.yaml": {"a/v.yaml", "a/x/v.yaml", "a/x/y/v.yaml"}, "**/v.yaml": {"v.yaml", "a/v.yaml", "a/x/v.yaml", "a/x/y/v.yaml"},
        "a.b/?.json": {"a.b/c.json"}, "v.yaml": {"v.yaml"}, "a/x/y/v.yaml": {"a/x/y/v.yaml"},
    }


def test_filled(spark):
    rows = spark.createDataFrame([(1, "x{{.a}}-{{ .a.b }}", {"a": "1", "a.b": "2"}), (2, "{{.a}}{{.c}}", {"a": "1"}), (3, "{{a}}", {"a": "1"}), (4, "{{.a}}", {"a": "{{.b}}", "b": "2"}), (5, "plain", {}), (6, None, {}), (7, " ", {})], "k int, t string, p map<string,string>")
    assert {r[0]: r[1] for r in rows.select("k", delivery.filled(F.col("t"), F.col("p"))).collect()} == {1: "x1-2", 2: None, 3: None, 4: None, 5: "plain", 6: None, 7: None}


SET = "kind: ApplicationSet\nspec:\n  generators:\n  - git:\n      repoURL: h/cfg\n      files:\n      - path: '*.yaml'\n  - git:\n      repoURL: h/ctl\n      files:\n      - path: '*.yaml'\n  - git:\n      repoURL: h/{{x}}\n      files:\n      - path: '*.yaml'\n  template:\n    spec:\n      sources:\n      - repoURL: h/Lit.git\n      - repoURL: h/{{ .path.basename }}\n      - repoURL: h/cfg\n      - repoURL: h/{{.gone}}\n"


def test_evidence(spark):
    repos = spark.createDataFrame([(n, n) for n in ("ctl", "cfg", "lit", "svc1", "file1", "worker", "abc")] + [("twin", "SVC1"), ("null", None)], "repo_id string, name string")
    rows = [
        ("ctl", "set.yaml", SET + "      destination:\n        server: https://u@h.x/a?b\n"), ("ctl", "null.yaml", None), ("ctl", "empty.yaml", ""), ("ctl", "broken.yaml", "}{ repoURL: [\n - :"),
        ("cfg", "file1.yaml", "app: svc1\nservice: worker\nname: abc\n"), ("cfg", "null.yaml", None), ("cfg", "deep/x.yaml", "app: svc1\n"), ("cfg", "broken.yaml", "}{"),
        ("own", "app.yaml", "kind: Application\nspec:\n  source: {repoURL: h/lit}\n---\nkind: Other\nspec:\n  destination: {name: no}\n"),
    ]
    files = spark.createDataFrame([(*r, 1, "x") for r in rows], "repo_id string, path string, content string, name int, url string")
    got = sorted((r["relationship"], r["source"], r["target"], r["path"]) for r in delivery.delivery_evidence(files, repos).collect())
    where = "platform:kubernetes:none:server/h.x:none:none"
    deployed = ["file1", "lit", "svc1", "twin"]
    assert got == sorted([("DISCOVERS_CONFIG_IN", "ctl", "cfg", "set.yaml"), ("DEPLOYS_FROM", "own", "lit", "app.yaml")] + [("DEPLOYS_FROM", d, "cfg", "set.yaml") for d in deployed] + [("RUNS_ON", d, where, "set.yaml") for d in deployed])
