"""Key paths of YAML texts, and workflow artifacts, against known answers."""

from loomgraph.functions import yaml_paths as Y

TEXT = """# head
a: 1  # one
"b c": 'x # y'
list:
- p: 1
  q:
    - deep
    - {r: 2, "s": t}
-   p: 3
flow: [u, "v", 3]
nested: [{n: m, i: [7, {z: 8}]}, k]
block: |
  # not a comment
  jobs:
    - no: node

  end
other: >-
    folded
ref: &x
  m: 1
use: *x
open: [1,
  2]
url: http://h/p#f
---
kind: Second
"""


def test_paths(spark):
    files = spark.createDataFrame([("r", "a.yaml", TEXT), ("r", "n.yaml", None), ("r", "e.yaml", "")], "repo_id string, path string, content string")
    got = {(r["document"], ".".join(r["keys"]), r["value"], r["kind"]) for r in Y.paths(files).collect() if r["keys"]}
    want = {
        (0, "a", "1", "scalar"), (0, "b c", "x # y", "scalar"), (0, "list", None, "map"), (0, "list.[]", None, "map"), (0, "list.[].p", "1", "scalar"), (0, "list.[].q", None, "map"), (0, "list.[].q.[]", None, "map"),
        (0, "list.[].q.[]", "deep", "scalar"), (0, "list.[].q.[].r", "2", "scalar"), (0, "list.[].q.[].s", "t", "scalar"), (0, "list.[].p", "3", "scalar"), (0, "flow.[]", "u", "scalar"), (0, "flow.[]", "v", "scalar"), (0, "flow.[]", "3", "scalar"), (0, "nested.[].n", "m", "scalar"), (0, "nested.[].i.[]", "7", "scalar"), (0, "nested.[].i.[]", "{z: 8}", "too_deep"), (0, "nested.[]", "k", "scalar"),
        (0, "block", "# not a comment\njobs:\n  - no: node\nend", "block"), (0, "other", "folded", "block"), (0, "ref", "", "anchor"), (0, "ref.m", "1", "scalar"), (0, "use", "*x", "alias"), (0, "open", "[1,", "open"), (0, "open", "2]", "scalar"), (0, "url", "http://h/p#f", "scalar"),
        (1, "kind", "Second", "scalar"),
    }
    assert got == want


def test_items_tell_list_entries_apart(spark):
    files = spark.createDataFrame([("r", "a.yaml", "l:\n  - a: 1\n    b: 2\n  - a: 3\n")], "repo_id string, path string, content string")
    assert {(r["keys"][-1], r["value"], tuple(r["items"])) for r in Y.paths(files).collect() if r["value"]} == {("a", "1", (2,)), ("b", "2", (2,)), ("a", "3", (4,))}


def test_depth(spark):
    text = "\n".join(" " * i + f"k{i}:" for i in range(Y.COLUMNS + 3))
    rows = Y.paths(spark.createDataFrame([("r", "a.yaml", text)], "repo_id string, path string, content string")).collect()
    assert [len(r["keys"]) for r in sorted(rows, key=lambda r: r["line"])][: Y.COLUMNS] == list(range(1, Y.COLUMNS + 1))
    assert sum(r["kind"] == "too_deep" for r in rows) == 3


WORKFLOW = """name: ci
on:
  push:
    branches: [main]
  workflow_dispatch:
    inputs:
      env: {type: string}
permissions: {contents: read}
concurrency:
  group: g-1
jobs:
  build:
    timeout-minutes: 5
    strategy:
      matrix:
        os: [a, b]
        v:
          - 1
          - 2
          - 3
        include: [z]
    steps:
    - uses: actions/checkout@v4
      with:
        repository: org/other
    - run: |
        make
        jobs: none
      if: github.ref == 'main'
  ship:
    needs: [build, test]
    environment: prod
    uses: org/flows/.github/workflows/x.yml@v1
  local:
    needs: build
    uses: ./.github/workflows/y.yml
"""


def test_workflows(spark):
    files = spark.createDataFrame([("r", ".github/workflows/ci.yml", WORKFLOW), ("r", "x.yml", WORKFLOW)], "repo_id string, path string, content string")
    found = Y.paths(files)
    got = {(r["kind"], r["job"], r["value"]) for r in Y.workflow_artifacts(found).collect()}
    assert got == {
        ("trigger", None, "push"), ("trigger", None, "workflow_dispatch"), ("input", None, "env"), ("permission", None, "contents:read"), ("concurrency", None, "g-1"), ("timeout", "build", "5"),
        ("matrix", "build", "os"), ("matrix", "build", "v"), ("action", "build", "actions/checkout"), ("checkout", "build", "org/other"), ("run", "build", "make\njobs: none"), ("condition", "build", "github.ref == 'main'"),
        ("needs", "ship", "build"), ("needs", "ship", "test"), ("environment", "ship", "prod"), ("reusable_workflow", "ship", "org/flows"), ("needs", "local", "build"), ("local_workflow", "local", "./.github/workflows/y.yml"),
    }
    assert [(r["job"], r["combinations"]) for r in Y.matrix_sizes(found).where("path LIKE '.github%'").collect()] == [("build", 6)]
