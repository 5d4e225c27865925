"""Steps whose rows must not grow faster than their input, by the rows that they write."""

import pytest

from loomgraph import catalog
from loomgraph.functions import reachability
from loomgraph.operators import traverse
from loomgraph.sources import tables
from loomgraph.sources.tables import Tables


@pytest.fixture()
def written(monkeypatch):
    """Numbers of rows of the tables that traverse writes."""
    counts = []
    real = traverse.cut

    def counted(df):
        out = real(df)
        counts.append(out.count())
        return out

    monkeypatch.setattr(traverse, "cut", counted)
    return counts


def test_seeds_that_are_near_share_rows(spark, written):
    # Four rings of 64 functions apart from each other, all of them seeds: 64 seeds of a ring share a number, so a node has one row for each level.
    rings = [(1000 * r + i, 1000 * r + (i + 1) % 64) for r in range(1, 5) for i in range(64)]
    edges = spark.createDataFrame(rings, "src long, dst long").repartition(8)
    seeds = spark.createDataFrame([(a, a) for a, _ in rings], "seed long, node long").repartition(8)
    found = {tuple(r) for r in traverse.bounded_bfs(seeds, edges, 3).collect()}
    assert found == {(1000 * r + i, 1000 * r + (i + d) % 64, d) for r in range(1, 5) for i in range(64) for d in range(4)}
    assert max(written) == len(rings)


def test_ends_limit_what_is_given_not_what_is_searched(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    seeds, ends = spark.createDataFrame([(1, 1)], "seed long, node long"), spark.createDataFrame([(3,)], "node long")
    assert [tuple(r) for r in traverse.bounded_bfs(seeds, edges, 5, ends=ends).collect()] == [(1, 3, 2)]


def test_chains_to_one_function_are_searched_from_it(spark, written):
    # A hundred starts, each of which reaches a hundred others; the target is reached over b before c.
    starts = [(f"s{i:02}", f"o{j:02}") for i in range(100) for j in range(100)] + [(f"s{i:02}", x) for i in range(100) for x in ("c", "b")] + [("b", "t"), ("c", "t")]
    edges = spark.createDataFrame(starts, "src string, dst string")
    found = {r["node"]: (r["depth"], r["path"]) for r in traverse.shortest_paths_to(spark.createDataFrame([("t",)], "target string"), edges, 5).collect()}
    assert found == {"t": (0, ["t"]), "b": (1, ["b", "t"]), "c": (1, ["c", "t"])} | {f"s{i:02}": (2, [f"s{i:02}", "b", "t"]) for i in range(100)}
    assert max(written[1:]) == 100


def test_names_meet_only_references_whose_literal_they_hold(spark):
    # A thousand names and as many references share their first letters; each reference fits one name.
    own = spark.createDataFrame([("helm", f"mod{i}") for i in range(1000, 2000)], "family string, name string")
    said = spark.createDataFrame([("helm", t) for i in range(1000, 2000) for t in (f"mod{i}${{v}}", f"${{v}}od{i}", f"${{v}}d{i}${{w}}")] + [("helm", "${v}"), ("helm", "modx${v}"), ("terraform", "mod1${v}")], "family string, target string")
    got = reachability.candidates(own, said).where("name RLIKE pattern")
    assert got.count() == reachability.candidates(own, said).count() == 3000
    assert {(r["name"], r["n"]) for r in got.groupBy("name").agg({"*": "count"}).toDF("name", "n").collect()} == {(f"mod{i}", 3) for i in range(1000, 2000)}


@pytest.fixture()
def shuffled(spark):
    """Rows that the session has shuffled since; all joins shuffle, as those of large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    sc = spark.sparkContext

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    yield lambda: total() - before
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["reachable_pairs", "transitive_callees", "transitive_callers"])
def test_calls_are_dealt_once_for_all_levels(spark, data, shuffled, name):
    lines = spark.read.parquet(f"{data}/lineitem.parquet").count()
    assert catalog.queries()[name](spark, data).count() > 0
    assert lines < shuffled() < 3 * lines


def test_what_a_range_sends_to_a_node_is_put_together(spark, shuffled):
    # Layers of a hundred functions, each of which calls all of the next layer.
    edges = spark.createDataFrame([(100 * k + i, 100 * k + 100 + j) for k in range(3) for i in range(100) for j in range(100)], "src long, dst long")
    seeds = spark.createDataFrame([(i, i) for i in range(64)], "seed long, node long")
    found = {tuple(r) for r in traverse.bounded_bfs(seeds, edges, 3).collect()}
    assert found == {(s, s, 0) for s in range(64)} | {(s, 100 * d + j, d) for s in range(64) for d in (1, 2, 3) for j in range(100)}
    assert 30_000 < shuffled() < 40_000


def test_ends_are_counted_by_distinct_callers(spark):
    edges = spark.createDataFrame([(1, 9)] * 3 + [(1, 2), (1, 3), (2, 8), (3, 8), (1, 8), (None, 9), (None, 7), (4, 9)], "src long, dst long")
    seeds = spark.createDataFrame([(1, 1)], "seed long, node long")
    assert [tuple(r) for r in traverse.bounded_bfs(seeds, edges, 5, least_in=3).collect()] == [(1, 8, 1)]


def test_lines_of_the_same_number_and_part_need_no_other_order(spark, tmp_path):
    # Three suppliers' lines of part 1 and two of part 2 share a number, with prices that would order them otherwise.
    lines = [(1, 1, p, s, 1.0, float(-s * p), "2020-01-01") for s in (1, 2, 3) for p in (2, 1) if s < 3 or p == 1] + [(1, 2, 3, 1, 1.0, 1.0, "2020-01-01"), (1, None, 4, 1, 1.0, 1.0, "2020-01-01"), (2, 1, 5, 1, 1.0, 1.0, "2020-01-01"), (2, 2, 1, 1, 1.0, 1.0, "2020-01-01")]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate string").write.parquet(f"{tmp_path}/lineitem.parquet")
    t = Tables(spark, str(tmp_path))
    found = {(f"part:{a}", f"part:{b}") for a, b in map(tuple, tables.call_keys(t).collect())}
    assert found == {tuple(r) for r in tables.calls(t).collect()} == {("part:4", "part:1"), ("part:1", "part:2"), ("part:2", "part:3"), ("part:5", "part:1")}
    assert "l_extendedprice" not in tables.call_keys(t)._jdf.queryExecution().executedPlan().toString()
