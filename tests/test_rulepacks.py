"""Rule packs: division by required atoms, ties, bounds, and packs that are only rows."""

from loomgraph.operators import rulepacks as P

ATOM = "candidate long, atom string, source_system string, evidence_type string, scope_id string, key string, value string"
CAND = "candidate long, pack string, correlation_key string, confidence double"


def states(df):
    return {r["candidate"]: (r["state"], r["reasons"]) for r in df.collect()}


def test_admission(spark):
    packs = P.first_party(spark)
    atoms = spark.createDataFrame([(1, "a", "s", "dockerfile", "x", "image", "i"), (2, "a", "s", "dockerfile", "x", "other", "image"), (2, "b", "s", "helm", "x", "image", "i"), (3, "a", "s", "dockerfile", "x", "image", "i"), (4, "a", "s", "dockerfile", "x", "image", "i"), (5, "a", None, "dockerfile", None, "image", None)], ATOM)
    cands = spark.createDataFrame([(1, "dockerfile", "k", 0.9), (2, "dockerfile", "k", 0.89), (3, "dockerfile", "k", 0.95), (4, "dockerfile", "k", 0.95), (5, "dockerfile", "z", None), (6, "nobody", "k", 1.0), (7, "helm", "k", 1.0)], CAND)
    assert states(P.evaluate(cands, atoms, packs)) == {
        1: ("rejected", ["lost_tie_break"]), 2: ("rejected", ["low_confidence", "structural_mismatch"]), 3: ("admitted", []), 4: ("rejected", ["lost_tie_break"]),
        5: ("rejected", ["low_confidence"]), 6: ("rejected", ["unknown_pack"]), 7: ("rejected", ["structural_mismatch"]),
    }
    assert len(P.FIRST_PARTY) == 11 and min(c for _, c, *_ in P.FIRST_PARTY) >= 0.75


def test_a_pack_of_rows(spark):
    """Two requirements, one of two atoms, one without selectors; a bound and no bound on matches."""
    packs = P.RulePacks(
        spark.createDataFrame([("p", 0.5)], "pack string, min_confidence double"), spark.createDataFrame([("p", "two", 2), ("p", "three", 3), ("p", "none", 0)], "pack string, requirement string, min_count int"),
        spark.createDataFrame([("p", "two", "key", "k"), ("p", "two", "scope_id", "s")], "pack string, requirement string, field string, value string"), spark.createDataFrame([("p", "z", "match", 1, 2), ("p", "a", "match", 1, 0), ("p", "x", "admit", 0, 9)], "pack string, rule string, kind string, priority int, max_matches int"),
    )
    atoms = spark.createDataFrame([(1, "a", None, None, "s", "k", None), (1, "b", None, None, "s", "k", None), (1, "c", None, None, "t", "k", None), (2, "a", None, None, "s", "k", None), (2, "a", None, None, "s", "k", None), (2, "c", None, None, "t", "k", None), (3, "a", None, None, "s", "k", None), (3, "b", None, None, "s", "k", None)], ATOM)
    cands = spark.createDataFrame([(1, "p", "x", 0.5), (2, "p", "y", 0.5), (3, "p", "z", 0.4)], CAND)
    assert states(P.evaluate(cands, atoms, packs)) == {1: ("admitted", []), 2: ("rejected", ["structural_mismatch"]), 3: ("rejected", ["low_confidence", "structural_mismatch"])}
    assert sorted((r["candidate"], r["place"], r["rule"], r["matches"]) for r in P.match_counts(cands, atoms, packs).collect()) == [(1, 1, "a", 3), (1, 2, "z", 2), (2, 1, "a", 3), (2, 2, "z", 2), (3, 1, "a", 2), (3, 2, "z", 2)]


def test_nothing(spark):
    assert P.evaluate(spark.createDataFrame([], CAND), spark.createDataFrame([], ATOM), P.first_party(spark)).collect() == []
