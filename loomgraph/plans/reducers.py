"""Evidence, relationship resolution, correlation, workload projection, reachability, truth levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import rulepacks
from ..operators.relational import count_if, pick, sorted_set
from ..sources.tables import Tables, node_id
from .registry import Registry

R = Registry()
#: A relationship needs this confidence, an assertion has this one.
RESOLVED, ASSERTED = 0.75, 1.0


def evidence(t: Tables) -> DataFrame:
    """Order lines as evidence of a relationship from the customer's to the supplier's repository."""
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return lines.select(node_id("repo", "c_nationkey").alias("src"), node_id("repo", "s_nationkey").alias("dst"), F.col("l_returnflag").alias("kind"), (1 - F.col("l_discount")).alias("confidence"), F.col("l_shipdate").alias("seen_at"), "l_orderkey", "l_linenumber", "l_partkey")


EVIDENCE = """evidence AS (SELECT 'repo:' || c_nationkey AS src, 'repo:' || s_nationkey AS dst, l_returnflag AS kind, 1 - l_discount AS confidence, l_shipdate AS seen_at, l_orderkey, l_linenumber, l_partkey
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""


@R.add(f"WITH {EVIDENCE} SELECT DISTINCT src, dst, kind, round(confidence, 6) AS confidence, l_partkey FROM evidence")
def evidence_dedupe(t: Tables) -> DataFrame:
    """Evidence without exact repeats."""
    return evidence(t).select("src", "dst", "kind", F.round("confidence", 6).alias("confidence"), "l_partkey").distinct()


@R.add(f"WITH {EVIDENCE} SELECT src, dst, round(max(confidence), 6) AS confidence, count(*) AS evidence_count, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM evidence GROUP BY 1, 2")
def evidence_candidates(t: Tables) -> DataFrame:
    """Evidence gathered by pair: highest confidence, count, sorted distinct kinds."""
    return evidence(t).groupBy("src", "dst").agg(F.round(F.max("confidence"), 6).alias("confidence"), F.count(F.lit(1)).alias("evidence_count"), sorted_set("kind").alias("kinds"))


_PREVIEW = f"""WITH {EVIDENCE}, r AS (SELECT src, dst, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY src, dst ORDER BY l_orderkey, l_linenumber, l_partkey, kind, confidence, seen_at) AS k FROM evidence)
SELECT src, dst, l_orderkey, l_linenumber, l_partkey FROM r WHERE k <= 5"""


@R.add(_PREVIEW)
def evidence_preview(t: Tables) -> DataFrame:
    """The first five pieces of evidence of each pair; the bound is applied before and after the shuffle, so no list grows."""
    w = Window.partitionBy("src", "dst").orderBy("l_orderkey", "l_linenumber", "l_partkey", "kind", "confidence", "seen_at")
    return evidence(t).withColumn("k", F.row_number().over(w)).where("k <= 5").select("src", "dst", "l_orderkey", "l_linenumber", "l_partkey")


_ASSERT = f"""assertions AS (SELECT src, dst, arg_max(CASE WHEN kind = 'R' THEN 'reject' WHEN kind = 'A' THEN 'assert' ELSE 'none' END, (seen_at, l_orderkey, l_linenumber, l_partkey, kind, confidence)) AS decision FROM evidence GROUP BY 1, 2)"""


def _assertions(t: Tables) -> DataFrame:
    decision = F.when(F.col("kind") == "R", "reject").when(F.col("kind") == "A", "assert").otherwise("none")
    return evidence(t).groupBy("src", "dst").agg(F.max_by(decision, F.struct("seen_at", "l_orderkey", "l_linenumber", "l_partkey", "kind", "confidence")).alias("decision"))


@R.add(f"WITH {EVIDENCE}, {_ASSERT} SELECT * FROM assertions")
def assertion_latest(t: Tables) -> DataFrame:
    """The last decision on each pair, by time and then by id (the reference goes by the order of its input)."""
    return _assertions(t)


@R.add(f"""WITH {EVIDENCE}, {_ASSERT}, c AS (SELECT src, dst, avg(confidence) AS confidence, count(*) AS n FROM evidence GROUP BY 1, 2)
SELECT src, dst, round(CASE WHEN decision = 'assert' THEN 1.0 ELSE confidence END, 4) AS confidence, n AS evidence_count, CASE WHEN decision = 'assert' THEN 'assertion' ELSE 'inferred' END AS resolution_source
FROM c JOIN assertions USING (src, dst) WHERE decision <> 'reject' AND (decision = 'assert' OR round(confidence, 4) >= 0.75)""")
def resolve_relationships(t: Tables) -> DataFrame:
    """Candidates of enough confidence, less the rejected pairs, with assertions above all; from one aggregation of the evidence."""
    decision = F.when(F.col("kind") == "R", "reject").when(F.col("kind") == "A", "assert").otherwise("none")
    order = F.struct("seen_at", "l_orderkey", "l_linenumber", "l_partkey", "kind", "confidence")
    c = evidence(t).groupBy("src", "dst").agg(F.avg("confidence").alias("c"), F.count(F.lit(1)).alias("evidence_count"), F.max_by(decision, order).alias("decision"))
    kept = c.where((F.col("decision") != "reject") & ((F.col("decision") == "assert") | (F.round("c", 4) >= RESOLVED)))
    asserted = F.col("decision") == "assert"
    return kept.select("src", "dst", F.round(F.when(asserted, F.lit(ASSERTED)).otherwise(F.col("c")), 4).alias("confidence"), "evidence_count", F.when(asserted, "assertion").otherwise("inferred").alias("resolution_source"))


_PACKS = {"1-URGENT": 0.9, "2-HIGH": 0.86, "3-MEDIUM": 0.82, "4-NOT SPECIFIED": 0.79, "5-LOW": 0.76}
_PACK_SQL = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _PACKS.items()) + " END"
CANDIDATES = f"""cand AS (SELECT o_orderkey AS id, o_custkey AS correlation_key, {_PACK_SQL}::DOUBLE AS threshold, round(max(1 - l_discount), 6) AS confidence, count(*) FILTER (WHERE l_returnflag = 'R') AS atoms
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
judged AS (SELECT *, CASE WHEN confidence < threshold THEN 'low_confidence' WHEN atoms < 1 THEN 'structural_mismatch' END AS reason FROM cand)"""


def _judged(t: Tables) -> DataFrame:
    """Orders as correlation candidates of rule packs (by priority): admitted if confident enough and with a required atom."""
    threshold = F.coalesce(*[F.when(F.col("o_orderpriority") == k, F.lit(v)) for k, v in _PACKS.items()])
    lines = t.lineitem.groupBy("l_orderkey").agg(F.round(F.max(1 - F.col("l_discount")), 6).alias("confidence"), count_if(F.col("l_returnflag") == "R").alias("atoms"))
    cand = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("correlation_key"), threshold.alias("threshold"), "confidence", "atoms")
    return cand.withColumn("reason", F.when(F.col("confidence") < F.col("threshold"), "low_confidence").when(F.col("atoms") < 1, "structural_mismatch"))


@R.add(f"WITH {CANDIDATES} SELECT id, correlation_key, confidence, reason IS NULL AS admitted, reason FROM judged")
def correlation_admission(t: Tables) -> DataFrame:
    return _judged(t).select("id", "correlation_key", "confidence", F.col("reason").isNull().alias("admitted"), "reason")


_WINNERS = f"{CANDIDATES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY correlation_key ORDER BY reason IS NOT NULL, confidence DESC, id) AS k FROM judged), final AS (SELECT id, correlation_key, coalesce(reason, CASE WHEN k > 1 THEN 'lost_tie_break' END) AS reason FROM ranked)"


def _final(t: Tables) -> DataFrame:
    w = Window.partitionBy("correlation_key").orderBy(F.col("reason").isNotNull(), F.desc("confidence"), "id")
    ranked = _judged(t).withColumn("k", F.row_number().over(w))
    return ranked.select("id", "correlation_key", F.coalesce("reason", F.when(F.col("k") > 1, "lost_tie_break")).alias("reason"))


@R.add(f"WITH {_WINNERS} SELECT id, correlation_key FROM final WHERE reason IS NULL")
def correlation_winners(t: Tables) -> DataFrame:
    """The admitted candidate of each key: by confidence, then by id."""
    return _final(t).where("reason IS NULL").select("id", "correlation_key")


@R.add(f"WITH {_WINNERS} SELECT count(*) AS evaluated, count(*) FILTER (WHERE reason IS NULL) AS admitted, count(*) FILTER (WHERE reason IS NOT NULL) AS rejected, count(*) FILTER (WHERE reason = 'low_confidence') AS low_confidence, count(*) FILTER (WHERE reason = 'lost_tie_break') AS conflicts FROM final")
def correlation_summary(t: Tables) -> DataFrame:
    r = F.col("reason")
    return _final(t).agg(F.count(F.lit(1)).alias("evaluated"), count_if(r.isNull()).alias("admitted"), count_if(r.isNotNull()).alias("rejected"), count_if(r == "low_confidence").alias("low_confidence"), count_if(r == "lost_tie_break").alias("conflicts"))


# Rule packs as data: an order is a candidate of the pack that its key gives, its lines are atoms of that pack's family or the next.
_FAMILY = f"(VALUES {', '.join(f"({i}, '{p[0]}', {p[1]}, '{p[3]}', '{p[4]}', {p[5]})" for i, p in enumerate(rulepacks.FIRST_PARTY))}) f(i, pack, least, evidence_type, key, most)"
_PACK_ATOMS = f"""families AS (SELECT * FROM {_FAMILY}),
atoms AS (SELECT l_orderkey AS candidate, evidence_type, CASE WHEN l_returnflag = 'R' THEN 'other' ELSE key END AS key, l_discount FROM lineitem JOIN families ON i = (l_orderkey + CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) % 11),
cands AS (SELECT o_orderkey AS candidate, pack, o_custkey AS correlation_key, least, evidence_type, key, most, (SELECT round(max(1 - 2 * l_discount), 6) FROM lineitem WHERE l_orderkey = o_orderkey) AS confidence FROM orders JOIN families ON i = o_orderkey % 11),
met AS (SELECT c.*, (SELECT count(*) FROM atoms a WHERE a.candidate = c.candidate AND a.evidence_type = c.evidence_type AND a.key = c.key) AS fitting, (SELECT count(*) FROM atoms a WHERE a.candidate = c.candidate) AS n FROM cands c),
graded AS (SELECT *, confidence IS NULL OR confidence < least AS low, fitting < 1 AS lacking FROM met),
placed AS (SELECT *, NOT low AND NOT lacking AS fine, row_number() OVER (PARTITION BY pack, correlation_key, NOT low AND NOT lacking ORDER BY confidence DESC, candidate) AS k FROM graded)"""


def _pack_inputs(t: Tables) -> tuple[DataFrame, DataFrame]:
    families = t.spark.createDataFrame([(i, p[0], p[3], p[4]) for i, p in enumerate(rulepacks.FIRST_PARTY)], "i long, pack string, evidence_type string, own_key string")
    lines = t.lineitem.join(F.broadcast(families), F.pmod(F.col("l_orderkey") + F.when(F.col("l_quantity") > 25, 1).otherwise(0), F.lit(len(rulepacks.FIRST_PARTY))) == F.col("i"))
    none = F.lit(None).cast("string")
    # Two lines of an order may share their number, so an atom's name is all that tells it.
    atom = F.concat_ws("/", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate", "l_returnflag")
    atoms = lines.select(F.col("l_orderkey").alias("candidate"), atom.alias("atom"), none.alias("source_system"), "evidence_type", none.alias("scope_id"), F.when(F.col("l_returnflag") == "R", "other").otherwise(F.col("own_key")).alias("key"), none.alias("value"))
    confidence = t.lineitem.groupBy(F.col("l_orderkey").alias("candidate")).agg(F.round(F.max(1 - 2 * F.col("l_discount")), 6).alias("confidence"))
    cands = t.orders.join(F.broadcast(families), F.pmod("o_orderkey", F.lit(len(rulepacks.FIRST_PARTY))) == F.col("i")).select(F.col("o_orderkey").alias("candidate"), "pack", F.col("o_custkey").alias("correlation_key"))
    return cands.join(confidence, "candidate", "left"), atoms


@R.add(f"""WITH {_PACK_ATOMS} SELECT candidate, pack, CASE WHEN fine AND k = 1 THEN 'admitted' ELSE 'rejected' END AS state,
concat_ws(',', CASE WHEN low THEN 'low_confidence' END, CASE WHEN lacking THEN 'structural_mismatch' END, CASE WHEN fine AND k > 1 THEN 'lost_tie_break' END) AS reasons FROM placed""")
def rule_pack_admission(t: Tables) -> DataFrame:
    """Candidates judged by eleven packs: confidence, required atoms, and the winner of each pack and key."""
    cands, atoms = _pack_inputs(t)
    return rulepacks.evaluate(cands, atoms, rulepacks.first_party(t.spark)).select("candidate", "pack", "state", F.array_join("reasons", ",").alias("reasons"))


@R.add(f"WITH {_PACK_ATOMS} SELECT candidate, pack, least(n, most)::BIGINT AS matches FROM met")
def rule_pack_matches(t: Tables) -> DataFrame:
    """How many atoms each pack's match rule takes of a candidate, bounded by the rule."""
    cands, atoms = _pack_inputs(t)
    return rulepacks.match_counts(cands, atoms, rulepacks.first_party(t.spark)).select("candidate", "pack", "matches")


@R.add(f"""WITH {_PACK_ATOMS} SELECT pack, count(*) AS evaluated, count(*) FILTER (WHERE fine AND k = 1) AS admitted, count(*) FILTER (WHERE low) AS low_confidence,
count(*) FILTER (WHERE lacking) AS structural_mismatch, count(*) FILTER (WHERE fine AND k > 1) AS lost_tie_break FROM placed GROUP BY pack""")
def rule_pack_summary(t: Tables) -> DataFrame:
    """Each pack's candidates by outcome and reason."""
    cands, atoms = _pack_inputs(t)
    e = rulepacks.evaluate(cands, atoms, rulepacks.first_party(t.spark))
    having = lambda r: count_if(F.array_contains("reasons", r)).alias(r)
    return e.groupBy("pack").agg(F.count(F.lit(1)).alias("evaluated"), count_if(F.col("state") == "admitted").alias("admitted"), having("low_confidence"), having("structural_mismatch"), having("lost_tie_break"))


# Confidence by kind of signal.
_WEIGHT_SQL = "CASE p_type WHEN 'STANDARD' THEN 0.98 WHEN 'ECONOMY' THEN 0.95 WHEN 'PROMO' THEN 0.92 WHEN 'SMALL' THEN 0.88 WHEN 'MEDIUM' THEN 0.78 ELSE 0.45 END"
_WEIGHTS = {"STANDARD": 0.98, "ECONOMY": 0.95, "PROMO": 0.92, "SMALL": 0.88, "MEDIUM": 0.78}


def _weight():
    return F.coalesce(*[F.when(F.col("p_type") == k, F.lit(v)) for k, v in _WEIGHTS.items()], F.lit(0.45))


@R.add(f"""SELECT l_suppkey AS repo, max({_WEIGHT_SQL})::DOUBLE AS confidence, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS signals, count(DISTINCT p_brand) AS namespaces,
CASE WHEN count(*) FILTER (WHERE p_type = 'PROMO') * 40 > count(*) * 7 THEN 'job' WHEN count(*) FILTER (WHERE p_type = 'STANDARD') * 100 > count(*) * 17 THEN 'service' ELSE 'utility' END AS classification FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def workload_candidates(t: Tables) -> DataFrame:
    """Signals of each repository: highest weight, kinds, namespaces and a class by the share of its kinds."""
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    kind = F.when(count_if(F.col("p_type") == "PROMO") * 40 > F.count(F.lit(1)) * 7, "job").when(count_if(F.col("p_type") == "STANDARD") * 100 > F.count(F.lit(1)) * 17, "service").otherwise("utility")
    return lines.groupBy(F.col("l_suppkey").alias("repo")).agg(F.max(_weight()).alias("confidence"), sorted_set("p_type").alias("signals"), F.count_distinct("p_brand").alias("namespaces"), kind.alias("classification"))


@R.add(f"""WITH w AS (SELECT l_suppkey, max({_WEIGHT_SQL}) AS c FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), e AS (SELECT DISTINCT l_suppkey, l_returnflag AS env FROM lineitem)
SELECT 'workload:' || s_name AS workload_id, 'workload-instance:' || s_name || ':' || env AS instance_id FROM supplier JOIN w ON s_suppkey = w.l_suppkey AND c >= 0.82 JOIN e ON s_suppkey = e.l_suppkey""")
def workload_projection(t: Tables) -> DataFrame:
    """Instances of every workload of enough confidence, one for each environment."""
    w = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.max(_weight()).alias("c"), F.collect_set("l_returnflag").alias("envs")).where("c >= 0.82")
    named = t.supplier.join(w, "s_suppkey").select("s_name", F.explode("envs").alias("env"))
    return named.select(F.concat(F.lit("workload:"), "s_name").alias("workload_id"), F.concat(F.lit("workload-instance:"), "s_name", F.lit(":"), "env").alias("instance_id"))


@R.add("""WITH used AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_discount < 0.002), maybe AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_discount < 0.02)
SELECT p_partkey, CASE WHEN u.l_partkey IS NOT NULL THEN 'used' WHEN m.l_partkey IS NOT NULL THEN 'ambiguous' ELSE 'unused' END AS reachability, CASE WHEN u.l_partkey IS NOT NULL THEN 0.99 WHEN m.l_partkey IS NOT NULL THEN 0.4 ELSE 0.75 END::DOUBLE AS confidence
FROM part LEFT JOIN used u ON u.l_partkey = p_partkey LEFT JOIN maybe m ON m.l_partkey = p_partkey""")
def reachability_classify(t: Tables) -> DataFrame:
    """Artifacts by their references: used beats ambiguous, else unused; both kinds from one aggregation."""
    refs = t.lineitem.groupBy("l_partkey").agg(F.max(F.col("l_discount") < 0.002).alias("used"), F.max(F.col("l_discount") < 0.02).alias("maybe"))
    p = t.part.join(refs, F.col("p_partkey") == F.col("l_partkey"), "left")
    level = F.when(F.col("used"), 0).when(F.col("maybe"), 1).otherwise(2)
    return p.select("p_partkey", F.when(level == 0, "used").when(level == 1, "ambiguous").otherwise("unused").alias("reachability"), F.when(level == 0, F.lit(0.99)).when(level == 1, F.lit(0.4)).otherwise(F.lit(0.75)).alias("confidence"))


_PATTERNS = [("digits", "([0-9]{8,})", 0.95), ("ip", "([0-9]+[.][0-9]+[.][0-9]+[.][0-9]+)", 0.9), ("secret", 'token = "([0-9a-f]+)"', 0.99)]
_DISCOVERY = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, {c}::DOUBLE AS confidence, UNNEST(regexp_extract_all(text, '{p}', 1)) AS matched FROM documents" for k, p, c in _PATTERNS)


@R.add(f"SELECT doc_id, kind, max(confidence) AS confidence, count(DISTINCT matched) AS matches, min(matched) AS first FROM ({_DISCOVERY}) GROUP BY 1, 2")
def evidence_discovery(t: Tables) -> DataFrame:
    """Evidence in texts by a table of patterns, each with a fixed confidence; one scan tries all of them."""

    def matches(kind: str, pattern: str, confidence: float):
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda m: F.struct(F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"), m.alias("matched")))

    found = F.concat(*[matches(*x) for x in _PATTERNS])
    each = t.documents.where(F.col("text").isNotNull()).select("doc_id", F.inline(found))
    return each.groupBy("doc_id", "kind").agg(F.max("confidence").alias("confidence"), F.count_distinct("matched").alias("matches"), F.min("matched").alias("first"))


@R.add("""SELECT p_partkey, CASE least(CASE WHEN p_size > 30 THEN 3 WHEN p_size > 15 THEN 2 ELSE 1 END, CASE WHEN p_type IN ('PROMO', 'LARGE') THEN 1 WHEN p_type = 'SMALL' THEN 2 ELSE 3 END) WHEN 3 THEN 'exact' WHEN 2 THEN 'derived' ELSE 'fallback' END AS truth_level FROM part""")
def truth_levels(t: Tables) -> DataFrame:
    """The lesser of what a basis gives and what a capability allows."""
    basis = F.when(F.col("p_size") > 30, 3).when(F.col("p_size") > 15, 2).otherwise(1)
    allowed = F.when(F.col("p_type").isin("PROMO", "LARGE"), 1).when(F.col("p_type") == "SMALL", 2).otherwise(3)
    level = F.least(basis, allowed)
    return t.part.select("p_partkey", F.when(level == 3, "exact").when(level == 2, "derived").otherwise("fallback").alias("truth_level"))


@R.add("""SELECT p_brand, p_type, count(*) AS facts, sum(CASE WHEN p_size > 40 THEN 0.9 WHEN p_size > 20 THEN 0.75 ELSE 0.6 END)::DOUBLE / count(*) AS confidence FROM part GROUP BY 1, 2""")
def projection_decisions(t: Tables) -> DataFrame:
    """Decisions of projection stages with fixed confidences, averaged."""
    c = F.when(F.col("p_size") > 40, F.lit(0.9)).when(F.col("p_size") > 20, F.lit(0.75)).otherwise(F.lit(0.6))
    return t.part.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("facts"), F.avg(c).alias("confidence"))


@R.add("SELECT n_regionkey, s_suppkey, s_name FROM (SELECT n_regionkey, s_suppkey, s_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY s_acctbal DESC, s_suppkey) AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey) WHERE k = 1")
def artifact_lineage(t: Tables) -> DataFrame:
    """The best match of each group by rank."""
    both = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return pick(both, ["n_regionkey"], [F.desc("s_acctbal"), "s_suppkey"]).select("n_regionkey", "s_suppkey", "s_name")


QUERIES, SQL = R.queries, R.sql
