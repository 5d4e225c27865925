"""Queries over all calls and dependencies, and from the search set, against plain Python, on graphs where a top-k of partners changes the result."""

import pytest

from loomgraph import catalog
from loomgraph.plans import code
from loomgraph.sources.tables import Tables

#: Orders as the parts on their lines: 1 calls 2 most, and 3; 3 calls 4, and 5 first; only 4 calls 200, and 5 more often.
ORDERS = [[1, 2], [1, 2], [1, 3], [3, 4], [3, 5], [3, 5], [4, 5], [4, 5], [4, 200], [6, 6], [200, 100], [100, 3], [2, 5], [5, 7], [7, 8]]
PARTS = [1, 2, 3, 4, 5, 6, 7, 8, 100, 200]
CALLS = {(a, b) for o in ORDERS for a, b in zip(o, o[1:], strict=False) if a != b}


def reach(starts, pairs, depth):
    """{(start, node): least depth}, by steps from each start."""
    out = {}
    for s in starts:
        level, seen = {s}, {s}
        for d in range(1, depth + 1):
            level = {b for a, b in pairs if a in level} - seen
            seen |= level
            out |= {(s, x): d for x in level}
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("whole"))
    lines = [(o, i, p, 1, 1.0, 1.0, "2020-01-01") for o, parts in enumerate(ORDERS) for i, p in enumerate(parts)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate string").write.parquet(f"{at}/lineitem.parquet")
    spark.createDataFrame([(p, f"n{p}", "PROMO" if p == 6 else "SMALL", "Brand#1", 1) for p in PARTS], "p_partkey long, p_name string, p_type string, p_brand string, p_size int").write.parquet(f"{at}/part.parquet")
    return at


def rows(spark, folder, name):
    return {tuple(r) for r in catalog.queries()[name](spark, folder).collect()}


def test_dead_code_over_all_calls(spark, folder):
    dead = {p for p in PARTS if p not in {b for _, b in CALLS}}
    assert dead == {1, 6}
    assert {r[0] for r in rows(spark, folder, "dead_nodes_anti")} == dead
    assert rows(spark, folder, "dead_policy") == {("dead", 1), ("generated", 1)}
    paged = code.page(code.dead_nodes_anti(Tables(spark, folder)), ["p_name"], 1, 5).collect()
    assert [(r["p_partkey"], r["total"], r["truncated"]) for r in paged] == [(6, 2, False)]
    assert code.dead_artifacts_paged(Tables(spark, folder)).collect() == []


def test_chains_over_second_callees(spark, folder):
    back = reach([100, 200], {(b, a) for a, b in CALLS}, 5)
    assert back[100, 1] == 4
    assert rows(spark, folder, "transitive_callers") == {(f"part:{s}", f"part:{x}", d) for (s, x), d in back.items()}
    ends = {b for _, b in CALLS if sum(y == b for _, y in CALLS) >= 3}
    assert ends == {5}
    there = {(f"part:{s}", f"part:{x}", d) for (s, x), d in reach([100, 200], CALLS, 10).items() if x in ends}
    assert rows(spark, folder, "reachable_pairs") == there


def test_callees_of_the_search_set_to_depth_five(spark, folder):
    out = reach([100, 200], CALLS, 5)
    assert out[200, 8] == 5
    assert rows(spark, folder, "transitive_callees") == {(f"part:{s}", f"part:{x}", d) for (s, x), d in out.items()}
    assert rows(spark, folder, "call_chain_shortest") == {("part:100", "part:200", out[100, 200])}


def test_chain_nodes(spark, folder):
    found = rows(spark, folder, "call_chain_nodes")
    assert {r[:3] for r in found} == rows(spark, folder, "call_chain_shortest")
    for seed, target, hops, chain in found:
        nodes = [int(x.removeprefix("part:")) for x in chain.split(">")]
        assert len(nodes) == hops + 1 and (f"part:{nodes[0]}", f"part:{nodes[-1]}") == (seed, target) and all(p in CALLS for p in zip(nodes, nodes[1:], strict=False))


#: Lines that a nation orders of each other nation: 0 takes from 1, 2 and 3, and from 3 the least.
TAKES = {(0, 1): 3, (0, 2): 2, (0, 3): 1, (1, 4): 1, (3, 4): 2}


def test_blast_radius_over_all_dependencies(spark, tmp_path):
    pairs = [p for p, n in TAKES.items() for _ in range(n)]
    spark.createDataFrame([(i, s) for i, (_, s) in enumerate(pairs)], "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, c) for i, (c, _) in enumerate(pairs)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    for name in ("customer", "supplier"):
        spark.createDataFrame([(k, k) for k in range(5)], f"{name[0]}_{name[:4]}key long, {name[0]}_nationkey long").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([(k, f"N{k}", 0) for k in range(5)], "n_nationkey long, n_name string, n_regionkey long").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(0, "R")], "r_regionkey long, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    want = reach(range(5), {(b, a) for a, b in TAKES}, 5)
    assert want[3, 0] == 1
    assert rows(spark, str(tmp_path), "blast_radius_repository") == {(f"repo:{s}", f"repo:{x}", d, "R") for (s, x), d in want.items()}
    assert rows(spark, str(tmp_path), "repo_consumers") == {(f"repo:{b}", sum(y == b for _, y in TAKES), sum(n for (_, y), n in TAKES.items() if y == b)) for _, b in TAKES}


def test_dependency_hops(spark, tmp_path):
    pairs = [p for p, n in TAKES.items() for _ in range(n)]
    spark.createDataFrame([(i, s) for i, (_, s) in enumerate(pairs)], "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, c) for i, (c, _) in enumerate(pairs)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    for name in ("customer", "supplier"):
        spark.createDataFrame([(k, k) for k in range(6)], f"{name[0]}_{name[:4]}key long, {name[0]}_nationkey long").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([(k, f"N{k}", 0) for k in range(6)], "n_nationkey long, n_name string, n_regionkey long").write.parquet(f"{tmp_path}/nation.parquet")
    both = set(TAKES) | {(b, a) for a, b in TAKES}
    least = {}
    for s in range(6):
        level = [(s,)]
        for _ in range(8):
            level = sorted(p + (b,) for p in level for a, b in both if a == p[-1] and b != s and (s, b) not in least)
            for p in level:
                least.setdefault((s, p[-1]), p)
    total = {a: sum(n for (x, _), n in TAKES.items() if x == a) for a, _ in TAKES}
    want = set()
    for (s, x), p in least.items():
        for i, (a, b) in enumerate(zip(p, p[1:], strict=False)):
            out = (a, b) in TAKES
            share = TAKES[a, b] / total[a] if out else TAKES[b, a] / total[b]
            want.add((f"repo:{s}", f"repo:{x}", i + 1, f"repo:{a}", f"repo:{b}", "outgoing" if out else "incoming", round(share, 9)))
    assert rows(spark, str(tmp_path), "dependency_path_hops") == want
