"""Which infrastructure artifacts are used: Terraform modules, Helm charts, Ansible roles, Kustomize folders and Compose services, each judged by itself.

References that say their target outright are joined by name. Of interpolated ones the literal parts are kept: they are
joined by what they begin or end with, else by the longest, then held against the whole pattern; and any word of their file may be what is filled in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .extract import lines

_HOLE = r"\$\{[^}]*\}|\{\{[^}]*\}\}|\$[A-Z_]+"
_TARGET = rf"(?:{_HOLE}|[^\s\"'`,;{{}}$])+"
# Confidence by reachability.
CONFIDENCE = {"used": 0.99, "ambiguous": 0.40, "unused": 0.75}
# Family, where its artifacts lie (name as group 1).
PLACES = (
    ("terraform", r"(?:^|/)modules/([^/]+)/[^/]+\.tf$"),
    ("helm", r"(?:^|/)charts/([^/]+)/Chart\.ya?ml$"),
    ("ansible", r"(?:^|/)roles/([^/]+)/tasks/[^/]+$"),
    ("kustomize", r"(?:^|/)([^/]+)/kustomization\.ya?ml$"),
)
_COMPOSE = r"(?:^|/)(?:docker-)?compose[^/]*\.ya?ml$"


def artifacts(files: DataFrame) -> DataFrame:
    """(family, repo_id, artifact, name): each module, chart, role, folder and service once."""
    found = None
    for family, place in PLACES:
        folder = F.regexp_extract("path", r"^(.*?)/(?:tasks/)?[^/]+$", 1)
        rows = files.where(F.rlike("path", F.lit(place))).select(F.lit(family).alias("family"), "repo_id", folder.alias("artifact"), F.regexp_extract("path", place, 1).alias("name"))
        found = rows if found is None else found.unionByName(rows)
    text = lines(files.where(F.rlike("path", F.lit(_COMPOSE))))
    section = F.last(F.nullif(F.regexp_extract("text", r"^(\w[\w-]*):", 1), F.lit("")), ignorenulls=True).over(Window.partitionBy("repo_id", "path").orderBy("line"))
    services = text.withColumn("section", section).withColumn("name", F.regexp_extract("text", r"^  ([\w.-]+):\s*(?:#.*)?$", 1)).where("section = 'services' AND name <> ''")
    return found.unionByName(services.select(F.lit("compose").alias("family"), "repo_id", F.concat(F.lit("services/"), "name").alias("artifact"), "name")).distinct()


def references(files: DataFrame) -> DataFrame:
    """(family, repo_id, path, target): what files say they use, the part of a path that names an artifact; it may hold ${...} or {{...}}."""
    def all_(pattern: str) -> Column:
        return F.regexp_extract_all("content", F.lit(pattern), F.lit(1))

    def rows(family: str, where: Column, targets: Column) -> DataFrame:
        return files.where(where).select(F.lit(family).alias("family"), "repo_id", "path", F.explode(F.array_distinct(targets)).alias("target"))

    any_ = F.col("content").isNotNull()
    segment = rf"((?:{_HOLE}|[^\s\"'/{{}}$?])+)"
    own = F.rlike("path", F.lit(r"(?:^|/)kustomization\.ya?ml$"))
    found = rows("terraform", any_, F.flatten(F.transform(all_(r"""\bsource\s*=\s*["']([^"']+)["']"""), lambda s: F.regexp_extract_all(s, F.lit(rf"(?:^|/)modules/{segment}"), F.lit(1)))))
    found = found.unionByName(rows("helm", any_, all_(rf"charts/{segment}")))
    # A folder is meant by a path: or, in a file of its kind, by an item.
    folder = rf"(?:^|/)(?:bases?|overlays)/{segment}/?$"
    said = F.concat(all_(rf"(?m)^\s*path:\s*[\"']?({_TARGET})"), F.when(own, all_(rf"(?m)^\s*-\s+[\"']?({_TARGET})")).otherwise(F.array().cast("array<string>")))
    found = found.unionByName(rows("kustomize", any_, F.filter(F.transform(said, lambda s: F.regexp_extract(s, folder, 1)), lambda s: s != "")))
    # Services that are brought up, flags left out.
    ups = F.flatten(F.transform(all_(r"docker[ -]compose\b[^\n]*?\bup\b([^\n]*)"), lambda s: F.regexp_extract_all(s, F.lit(rf"(?<=\s)(?!-)((?:{_HOLE}|[\w.-])+)"), F.lit(1))))
    found = found.unionByName(rows("compose", any_, ups))
    # Roles count in playbooks that something runs.
    playbook = lambda c: F.regexp_replace(c, r"^.*?(?=playbooks/)|[\"']", "")
    run = files.where(any_).select(F.explode(all_(r"ansible-playbook\s+([^\s'\"]+)")).alias("p")).select(playbook(F.col("p")).alias("playbook")).distinct()
    reached = files.where(any_).withColumn("playbook", playbook(F.col("path"))).join(run, "playbook", "left_semi")
    roles = reached.select(F.lit("ansible").alias("family"), "repo_id", "path", F.explode(F.array_distinct(F.concat(all_(rf"(?m)^\s*-\s+(?:role:\s*)?[\"']?((?:{_HOLE}|[\w.-])+)[\"']?\s*$")))).alias("target"))
    return found.unionByName(roles)


def _pattern(target: Column) -> Column:
    parts = F.transform(F.split(target, _HOLE, -1), lambda p: F.when(p == "", "").otherwise(F.concat(F.lit("\\Q"), p, F.lit("\\E"))))
    return F.concat(F.lit("^"), F.array_join(parts, "[^/]*"), F.lit("$"))


def candidates(own: DataFrame, loose: DataFrame) -> DataFrame:
    """(family, name, pattern): names with the patterns of interpolated references (family, target) of their family whose literal they hold whole, where it must stand.

    The literal is what a reference begins with, else what it ends with, else its longest part. Names are cut to the lengths that the
    literals of a kind have, so both sides are equal in whole and names with the same first letters don't all meet.
    """
    parts = F.split("target", _HOLE, -1)
    longest = F.get(F.array_sort(F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p")))), F.lit(0))["p"]
    first, last = F.nullif(F.get(parts, F.lit(0)), F.lit("")), F.nullif(F.element_at(parts, -1), F.lit(""))
    at = F.when(first.isNotNull(), "start").when(last.isNotNull(), "end").otherwise("inside")
    keyed = loose.select("family", _pattern(F.col("target")).alias("pattern"), at.alias("at"), F.coalesce(first, last, longest).alias("literal")).where("literal IS NOT NULL").distinct()
    lengths = keyed.select("family", "at", F.length("literal").alias("n")).distinct()
    names = own.select("family", "name").distinct().join(F.broadcast(lengths), "family").where(F.length("name") >= F.col("n"))
    ends = F.length("name") - F.col("n") + 1
    piece = lambda i: F.substring(F.col("name"), i, F.col("n"))
    pieces = F.when(F.col("at") == "start", F.array(piece(F.lit(1)))).when(F.col("at") == "end", F.array(piece(ends))).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), ends), piece)))
    return names.select("family", "name", "at", F.explode(pieces).alias("literal")).join(keyed, ["family", "at", "literal"]).select("family", "name", "pattern")


def reachability(files: DataFrame) -> DataFrame:
    """(family, repo_id, artifact, name, reachability, confidence) of each artifact in files (repo_id, path, language, content).

    used (0.99) if a reference of its family names it; else ambiguous (0.4) if an interpolated one of its family fits its name by a literal part, or stands in a file
    that holds its name as a word; else unused (0.75). Names count in all repositories.
    """
    own, said = artifacts(files), references(files)
    hole = F.rlike("target", F.lit(_HOLE))
    used = said.where(~hole).select("family", F.col("target").alias("name")).distinct()
    loose = said.where(hole)
    # By words of the file.
    at = loose.select("family", "repo_id", "path").distinct()
    words = F.array_distinct(F.regexp_extract_all("content", F.lit(r"([A-Za-z0-9_.-]+)"), F.lit(1)))
    named = files.join(at, ["repo_id", "path"]).select("family", F.explode(words).alias("name")).distinct()
    # By literal parts.
    fits = candidates(own, loose).where(F.rlike("name", F.col("pattern"))).select("family", "name")
    maybe = named.unionByName(fits).distinct()
    both = own.join(used.withColumn("u", F.lit(True)), ["family", "name"], "left").join(maybe.withColumn("m", F.lit(True)), ["family", "name"], "left")
    level = F.when(F.col("u"), "used").when(F.col("m"), "ambiguous").otherwise("unused")
    confidence = F.coalesce(*[F.when(F.col("reachability") == k, F.lit(v)) for k, v in CONFIDENCE.items()])
    return both.select("family", "repo_id", "artifact", "name", level.alias("reachability")).withColumn("confidence", confidence)
