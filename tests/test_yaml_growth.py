"""Long YAML files, and what their reading asks of Spark."""

from loomgraph.functions import yaml_paths as Y


def test_files_are_read_where_they_lie(spark):
    files = spark.createDataFrame([("r", "a.yaml", "a: {b: [1, 2]}\nc: |\n  d\n")], "repo_id string, path string, content string")
    plan = Y.paths(files)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in ("Window", "Join", "Union", "Aggregate") if x in plan]


def test_files_longer_than_a_block_of_the_pass(spark):
    n = 2 * Y._BLOCK + 10
    text = "top:\n" + "".join(f"  k{i}:\n    - v: {i}\n" for i in range(n)) + "text: |\n" + "".join(f"  l{i}\n" for i in range(n)) + "---\nend: 1\n"
    got = {(r["document"], ".".join(r["keys"]), r["value"], tuple(r["items"])) for r in Y.paths(spark.createDataFrame([("r", "a.yaml", text)], "repo_id string, path string, content string")).collect() if r["value"]}
    assert got == {(0, f"top.k{i}.[].v", str(i), (3 + 2 * i,)) for i in range(n)} | {(0, "text", "\n".join(f"l{i}" for i in range(n)), ()), (1, "end", "1", ())}
