"""Generations that are swapped last, writes that change nothing, stale rows, graphs, and incremental runs against full ones."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import incremental
from loomgraph.sources.store import GenerationStore, write_graph

SCHEMA = "repo_id string, id long, body string"


def rows(spark, *r):
    return spark.createDataFrame(list(r), SCHEMA)


def seen(store):
    return sorted(tuple(r) for r in store.read().collect())


def changes(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_generations(spark, tmp_path):
    s = GenerationStore(spark, f"file://{tmp_path}/s", SCHEMA)
    assert seen(s) == [] and s.versions() == []
    one = [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")]
    assert changes(s.write(rows(spark, *one), "g1")) == {"a": (2, 0, 0), "b": (1, 0, 0)}
    assert changes(s.write(rows(spark, *reversed(one)), "g2")) == {} and s.versions() == [1]
    # One row updated, one stale, one new; b is not written and stays.
    assert changes(s.write(rows(spark, ("a", 1, "X"), ("a", 3, "n")), "g3")) == {"a": (1, 1, 1)}
    assert seen(s) == [("a", 1, "X"), ("a", 3, "n"), ("b", 1, "z")]
    # An owner in scope without rows is retracted.
    assert changes(s.write(rows(spark, ("c", 1, None)), "g4", scope=rows(spark, ("b", 0, ""), ("c", 0, "")))) == {"b": (0, 0, 1), "c": (1, 0, 0)}
    assert seen(s) == [("a", 1, "X"), ("a", 3, "n"), ("c", 1, None)]
    with pytest.raises(ValueError):
        s.write(rows(spark, ("a", 9, "q")), "g3")
    assert s.vacuum() == ["g1"] and seen(s) == [("a", 1, "X"), ("a", 3, "n"), ("c", 1, None)] and len(s.versions()) == 1


def test_broken_write_leaves_the_old_rows(spark, tmp_path, monkeypatch):
    s = GenerationStore(spark, f"file://{tmp_path}/s", SCHEMA)
    s.write(rows(spark, ("a", 1, "x")), "g1")
    bad = rows(spark, ("a", 1, "y"), ("b", 2, "z")).withColumn("body", F.when(F.col("id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("body")))
    with pytest.raises(Exception, match="lost"):
        s.write(bad, "g2")
    with monkeypatch.context() as m:
        m.setattr(GenerationStore, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            s.write(rows(spark, ("a", 1, "y")), "g2")
    assert seen(s) == [("a", 1, "x")]
    assert changes(s.write(rows(spark, ("a", 1, "y")), "g2")) == {"a": (0, 1, 0)} and seen(s) == [("a", 1, "y")]


def test_graph(spark, tmp_path):
    nodes = GenerationStore(spark, f"file://{tmp_path}/n", "repo_id string, id string")
    edges = GenerationStore(spark, f"file://{tmp_path}/e", "repo_id string, src string, dst string", keys=("src", "dst"))
    n = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "repo_id string, id string")
    e = spark.createDataFrame([("a", "x", "y"), ("a", "x", "lost"), ("b", "z", "x")], "repo_id string, src string, dst string")
    write_graph(nodes, edges, n, e, "g1")
    assert seen(edges) == [("a", "x", "y"), ("b", "z", "x")]


def test_incremental_runs(spark, tmp_path):
    source, result = GenerationStore(spark, f"file://{tmp_path}/s", SCHEMA), GenerationStore(spark, f"file://{tmp_path}/r", "repo_id string, id string, n long")
    log = GenerationStore(spark, f"file://{tmp_path}/l", "repo_id string, id string, digest string")
    read = []

    def derive(df):
        read.append(df.count())
        return df.groupBy("repo_id", F.upper("body").alias("id")).agg(F.count(F.lit(1)).alias("n")).where("id IS NOT NULL")

    source.write(rows(spark, *[(f"r{i}", k, "ab"[k % 2]) for i in range(20) for k in range(10)]), "s1")
    assert incremental.backfill(source, result, log, derive, "b1").count() == 20 and read == [200]
    assert incremental.backfill(source, result, log, derive, "b2").count() == 0 and read == [200, 0]
    source.write(rows(spark, ("r3", 0, "c"), ("new", 0, "a")), "s2", scope=rows(spark, ("r4", 0, "")))
    changed = incremental.backfill(source, result, log, derive, "b3")
    assert {tuple(r) for r in changed.collect()} == {("r3", False), ("new", False), ("r4", True)} and read == [200, 0, 2]
    assert seen(result) == sorted(tuple(r) for r in derive(source.read()).collect())
    items = spark.createDataFrame([("r3", "succeeded", 2), ("r3", "running", 1), ("r4", "succeeded", 1), ("r5", "dead_letter", 3), ("new", "dead_letter", 3)], "repo_id string, status string, attempts int")
    assert sorted(tuple(r) for r in incremental.reopened(items, changed, "repo_id").collect()) == [("new", "pending", 0), ("r3", "pending", 0), ("r3", "running", 1), ("r4", "succeeded", 1), ("r5", "dead_letter", 3)]
