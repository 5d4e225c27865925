"""Correlation rule packs as tables: what a candidate must have is a division of its atoms by the required ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ATOM_FIELDS = ("source_system", "evidence_type", "scope_id", "key", "value")

# Pack, least confidence, required evidence (requirement, evidence type, key), most matches of its match rule.
FIRST_PARTY = (
    ("dockerfile", 0.90, "runtime-image", "dockerfile", "image", 4),
    ("docker_compose", 0.80, "compose-service", "docker_compose", "service", 6),
    ("github_actions", 0.82, "workflow-repository", "github_actions", "repository", 6),
    ("jenkins", 0.84, "pipeline-repository", "jenkins", "repository", 6),
    ("helm", 0.86, "release-mapping", "helm", "release", 8),
    ("argocd", 0.90, "application-mapping", "argocd", "application", 8),
    ("kustomize", 0.83, "resource-mapping", "kustomize", "resource", 8),
    ("terraform_config", 0.91, "module-mapping", "terraform_config", "module", 8),
    ("terragrunt", 0.76, "config-path", "terragrunt", "config_path", 8),
    ("ansible", 0.76, "role-reference", "ansible", "role", 8),
    ("cloudformation", 0.79, "stack-template", "cloudformation", "stack", 8),
)


@dataclass
class RulePacks:
    """packs (pack, min_confidence), requirements (pack, requirement, min_count), selectors (pack, requirement, field, value: all must fit one atom)
    and rules (pack, rule, kind, priority, max_matches: 0 for no bound). A pack is added by adding rows."""

    packs: DataFrame
    requirements: DataFrame
    selectors: DataFrame
    rules: DataFrame


def first_party(spark: SparkSession) -> RulePacks:
    return RulePacks(
        spark.createDataFrame([(p, c) for p, c, *_ in FIRST_PARTY], "pack string, min_confidence double"),
        spark.createDataFrame([(p, r, 1) for p, _, r, *_ in FIRST_PARTY], "pack string, requirement string, min_count int"),
        spark.createDataFrame([row for p, _, r, kind, key, _ in FIRST_PARTY for row in ((p, r, "evidence_type", kind), (p, r, "key", key))], "pack string, requirement string, field string, value string"),
        spark.createDataFrame([(p, f"match-{r}", "match", 20, m) for p, _, r, _, _, m in FIRST_PARTY], "pack string, rule string, kind string, priority int, max_matches int"),
    )


def _satisfied(candidates: DataFrame, atoms: DataFrame, packs: RulePacks) -> DataFrame:
    """(candidate, pack, requirement) that have enough atoms which fit all selectors of the requirement.

    An atom's fields are rows; those that selectors name are counted for each requirement, and an atom fits if as many fit as there are
    selectors. An atom without any such field is gone after the join; requirements without a selector count all atoms. Tables of packs
    are broadcast: they have a few rows for each pack, and all candidates would meet in a task for each pack.
    """
    own = candidates.select("candidate", "pack")
    needed = packs.selectors.groupBy("pack", "requirement").agg(F.count(F.lit(1)).alias("needed"))
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ATOM_FIELDS]))
    said = atoms.select("candidate", "atom", fields.alias("f")).select("candidate", "atom", "f.field", "f.value").join(own, "candidate")
    fits = said.join(F.broadcast(packs.selectors), ["pack", "field", "value"]).groupBy("candidate", "pack", "requirement", "atom").agg(F.count(F.lit(1)).alias("fitting"))
    full = fits.join(F.broadcast(needed), ["pack", "requirement"]).where("fitting = needed").select("candidate", "pack", "requirement", "atom")
    loose = packs.requirements.join(packs.selectors, ["pack", "requirement"], "left_anti")
    any_ = atoms.select("candidate", "atom").join(own, "candidate").join(F.broadcast(loose.select("pack", "requirement")), "pack").select("candidate", "pack", "requirement", "atom")
    counted = full.unionByName(any_).groupBy("candidate", "pack", "requirement").agg(F.count_distinct("atom").alias("found"))
    return counted.join(F.broadcast(packs.requirements), ["pack", "requirement"]).where("found >= min_count").select("candidate", "pack", "requirement")


def evaluate(candidates: DataFrame, atoms: DataFrame, packs: RulePacks) -> DataFrame:
    """(candidate, pack, correlation_key, confidence, state, reasons) of candidates (candidate, pack, correlation_key, confidence) with atoms (candidate, atom and the five fields).

    A candidate is admitted if it is confident enough for its pack and meets all of the pack's requirements, and if no other admitted one of its
    pack and key has more confidence, or as much and a smaller id. reasons are, in this order, low_confidence,
    structural_mismatch and lost_tie_break; a candidate whose pack isn't known has unknown_pack.
    """
    needed = packs.requirements.where("min_count > 0").groupBy("pack").agg(F.count(F.lit(1)).alias("requirements"))
    met = _satisfied(candidates, atoms, packs).join(F.broadcast(packs.requirements.where("min_count > 0")), ["pack", "requirement"], "left_semi").groupBy("candidate", "pack").agg(F.count(F.lit(1)).alias("met"))
    both = candidates.join(F.broadcast(packs.packs), "pack", "left").join(F.broadcast(needed), "pack", "left").join(met, ["candidate", "pack"], "left")
    low = F.when(F.col("confidence").isNull() | (F.col("confidence") < F.col("min_confidence")), "low_confidence")
    lacking = F.when(F.coalesce("met", F.lit(0)) < F.coalesce("requirements", F.lit(0)), "structural_mismatch")
    unknown = F.when(F.col("min_confidence").isNull(), "unknown_pack")
    judged = both.withColumn("reasons", F.filter(F.array(unknown, low, lacking), F.isnotnull))
    best = Window.partitionBy("pack", "correlation_key", F.size("reasons") == 0).orderBy(F.desc("confidence"), "candidate")
    lost = (F.size("reasons") == 0) & (F.row_number().over(best) > 1)
    final = judged.withColumn("lost", lost).withColumn("reasons", F.when(F.col("lost"), F.array(F.lit("lost_tie_break"))).otherwise(F.col("reasons")))
    return final.select("candidate", "pack", "correlation_key", "confidence", F.when(F.size("reasons") == 0, "admitted").otherwise("rejected").alias("state"), "reasons")


def match_counts(candidates: DataFrame, atoms: DataFrame, packs: RulePacks) -> DataFrame:
    """(candidate, pack, rule, matches) of match rules, in the order of priority and name: the candidate's atoms, bounded by the rule."""
    n = atoms.groupBy("candidate").agg(F.count(F.lit(1)).alias("n"))
    each = candidates.select("candidate", "pack").join(F.broadcast(packs.rules.where("kind = 'match'")), "pack").join(n, "candidate", "left")
    found = F.coalesce("n", F.lit(0))
    order = F.row_number().over(Window.partitionBy("candidate", "pack").orderBy("priority", "rule"))
    return each.select("candidate", "pack", "rule", order.alias("place"), F.when(F.col("max_matches") > 0, F.least(found, F.col("max_matches"))).otherwise(found).cast("long").alias("matches"))
