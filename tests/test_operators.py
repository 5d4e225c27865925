"""Operators on literal rows and against plain Python."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.functions import ids
from loomgraph.functions import text as X
from loomgraph.operators import relational, traverse
from loomgraph.streaming import jobs


def bfs(seeds, edges, depth):
    out = {}
    for s in seeds:
        level, seen = {s}, {s: 0}
        for d in range(1, depth + 1):
            level = {b for a, b in edges if a in level} - seen.keys()
            seen |= dict.fromkeys(level, d)
        out |= {(s, n): d for n, d in seen.items()}
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bfs(spark, seed):
    rng = random.Random(seed)
    names = "abcdefghijkl"
    edges = list({(rng.choice(names), rng.choice(names)) for _ in range(18)})
    e = spark.createDataFrame(edges, "src string, dst string")
    s = spark.createDataFrame([("a", "a"), ("b", "b")], "seed string, node string")
    want = bfs("ab", edges, 4)
    assert {(r["seed"], r["node"]): r["depth"] for r in traverse.bounded_bfs(s, e, 4).collect()} == want
    paths = traverse.shortest_paths(s, e, 4).collect()
    assert {(r["seed"], r["node"]): r["depth"] for r in paths} == want
    for r in paths:
        assert r["path"][0] == r["seed"] and r["path"][-1] == r["node"] and len(r["path"]) == r["depth"] + 1
        assert all((a, b) in edges for a, b in zip(r["path"], r["path"][1:]))


def test_undirected(spark):
    e = spark.createDataFrame([("a", "b")], "src string, dst string")
    assert {tuple(r) for r in traverse.undirected(e).collect()} == {("a", "b", True), ("b", "a", False)}


def test_pick_and_unique(spark):
    df = spark.createDataFrame([(1, 5, "x"), (1, 6, "y"), (2, 1, "z"), (2, 1, "z")], "k int, v int, n string")
    assert {(r["k"], r["n"]) for r in relational.pick(df, ["k"], [F.desc("v")]).collect()} == {(1, "y"), (2, "z")}
    assert [tuple(r) for r in relational.unique_only(df, ["k"], "n").collect()] == [(2, "z")]


def test_difference_and_page(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "k int") for xs in ([1, 2, 3], [2, 3, 4]))
    assert {tuple(r) for r in relational.difference(a, b, ["k"]).collect()} == {(1, "removed"), (4, "added")}
    rows = relational.page(a, ["k"], 1, 1).collect()
    assert [(r["k"], r["total"], r["truncated"]) for r in rows] == [(2, 3, True)]
    assert not relational.page(a, ["k"], 2, 5).collect()[0]["truncated"]


def test_ids(spark):
    df = spark.createDataFrame([("k", "", "e", None)], "name string, blank string, env string, region string")
    r = df.select(
        ids.short_id("r_", ["name", "blank"], 16).alias("a"),
        ids.hash_partition("name", 8).alias("b"),
        ids.platform_id(F.lit("kind"), F.lit(""), F.col("name"), F.col("env"), F.col("region")).alias("c"),
        ids.platform_id(F.lit("kind"), F.lit("p"), F.col("blank"), F.col("env"), F.col("region")).alias("d"),
    ).first()
    import hashlib

    assert r["a"] == "r_" + hashlib.sha1(b"k\n<none>").hexdigest()[:16]
    assert r["b"] == int(hashlib.sha256(b"k").hexdigest()[:16], 16) % 8
    assert r["c"] == "platform:kind:none:k:e:none" and r["d"] is None


def test_text(spark):
    df = spark.createDataFrame([("https://WWW.a.example/x.html?q#f", "Deploy to PROD, not staging.", "big-worker-ring")], "url string, t string, n string")
    df = df.withColumn("url", F.lower("url"))
    r = df.select(X.hostname("url"), X.url_path("url"), X.normal_url("url"), X.env_names("t", X.ENV_ALIASES), X.first_word("n", [("ring", "a"), ("worker", "b")], "c"), X.first_match("url", ["/(y)", r"[.]([a-z]+)[?]"], "none")).first()
    assert list(r) == ["www.a.example", "/x.html", "https://a.example/x", "prod,stage", "a", "html"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["pending", "claimed", "running", "succeeded", "retrying", "dead_letter"]), max_size=12))
def test_state_machine(moves):
    import pandas as pd

    frame = pd.DataFrame({"status": moves, "ts": range(len(moves)), "event_id": range(len(moves))})
    whole = jobs.advance(("pending", 0, 0), frame)
    part = ("pending", 0, 0)
    for i in range(len(moves)):
        part = jobs.advance(part, frame.iloc[i : i + 1])
    assert part == whole and whole[1] <= moves.count("claimed")


def test_streams(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    folder = str(tmp_path / "in")
    events.repartition(3).write.parquet(folder)
    stream = jobs.event_stream(spark, folder)
    got = []
    q = jobs.collect_generations(stream, lambda df, k: got.append((k, df.count())), str(tmp_path / "c1"))
    q.awaitTermination(120)
    assert sum(n for _, n in got) == events.count() and len({k for k, _ in got}) == 3

    q = jobs.windowed_counts(stream, lateness="365 days").writeStream.format("memory").queryName("win").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = spark.sql("SELECT start, event_type, max(n) AS n FROM win GROUP BY 1, 2")
    assert last.agg(F.sum("n")).first()[0] == events.count()

    status = stream.select("user_id", "ts", "event_id", F.when(F.col("event_type") == "click", "claimed").when(F.col("event_type") == "view", "running").when(F.col("event_type") == "error", "dead_letter").when(F.col("event_type") == "signup", "pending").otherwise("succeeded").alias("status"))
    q = jobs.work_item_states(status).writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("states").select("user_id").distinct().count() == events.select("user_id").distinct().count()


def test_plans(spark, data):
    """Anti joins and aggregates as planned: no Cartesian product, filters and columns pushed to the scan."""
    from loomgraph import catalog

    q = catalog.queries()
    text = q["facts_by_kind"](spark, data)._jdf.queryExecution().toString()
    assert "PushedFilters" in text and "CartesianProduct" not in text and "LeftSemi" in text
    assert "LeftAnti" in q["dead_nodes_anti"](spark, data)._jdf.queryExecution().toString()
    scan = q["direct_callers"](spark, data)._jdf.queryExecution().toString()
    assert "l_tax" not in scan.split("== Physical Plan ==")[1]
