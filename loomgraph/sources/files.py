"""File trees as content tables, with what is pruned and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders and endings that a scan leaves out.
IGNORED_FOLDERS = (".git", "node_modules", "vendor", "dist", "build", "target", "__pycache__", ".venv", ".terraform")
#: Hidden folders and files of a repository's root that are read all the same.
HIDDEN_KEPT = (".github", ".circleci", ".gitlab-ci.yml")
IGNORED_ENDINGS = (".png", ".jpg", ".gif", ".zip", ".gz", ".jar", ".class", ".pyc", ".so", ".exe", ".pdf", ".woff", ".lock")

# Language by file name and by ending; names come before endings, longer endings before shorter.
BY_NAME = {"Dockerfile": "dockerfile", "Jenkinsfile": "groovy", "docker-compose.yml": "compose", "docker-compose.yaml": "compose", "Chart.yaml": "helm", "kustomization.yaml": "kustomize"}
BY_ENDING = {
    ".tfvars.json": "terraform", ".tf": "terraform", ".hcl": "terragrunt", ".py": "python", ".ipynb": "python", ".go": "go", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".java": "java", ".kt": "kotlin", ".rb": "ruby", ".rs": "rust", ".php": "php", ".cs": "csharp", ".cpp": "cpp", ".c": "c", ".swift": "swift", ".scala": "scala", ".dart": "dart", ".ex": "elixir", ".pl": "perl",
    ".hs": "haskell", ".groovy": "groovy", ".sql": "sql", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".dockerfile": "dockerfile",
}


def language_of(path: str) -> Column:
    """Language of a file by its name, else by its ending; null if neither is known."""
    name = F.element_at(F.split(path, "/"), -1)
    found = [F.when(name == k, v) for k, v in BY_NAME.items()]
    found.append(F.when(F.startswith(name, F.lit("Dockerfile.")), "dockerfile"))
    found += [F.when(F.endswith(name, F.lit(k)), v) for k, v in sorted(BY_ENDING.items(), key=lambda x: -len(x[0]))]
    return F.coalesce(*found)


def skip_reason(path: str, globs: tuple[str, ...] = ()) -> Column:
    """Why a path is left out of a scan (folder, ending, hidden, glob); null if it stays."""
    parts = F.split(path, "/")
    by_glob = F.lit(False)
    for g in globs:
        by_glob = by_glob | F.rlike(path, F.lit(g))
    return (
        F.when(F.arrays_overlap(parts, F.array(*map(F.lit, IGNORED_FOLDERS))), "folder")
        .when(F.exists(F.array(*map(F.lit, IGNORED_ENDINGS)), lambda e: F.endswith(F.col(path), e)), "ending")
        .when(~F.element_at(parts, 1).isin(*HIDDEN_KEPT) & F.exists(parts, lambda p: F.startswith(p, F.lit(".")) & (F.length(p) > 1)), "hidden")
        .when(by_glob, "glob")
    )


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def scan(spark: SparkSession, root: str, repo_id: str) -> DataFrame:
    """(repo_id, path, content, language, skip) of all files under root, read by Spark as whole texts; path is relative.

    Spark leaves out hidden folders itself, so those of HIDDEN_KEPT are named beside the root.
    """
    top = root.rstrip("/")
    paths = [root, *(f"{top}/{h}" for h in HIDDEN_KEPT if _there(spark, f"{top}/{h}"))]
    files = spark.read.option("recursiveFileLookup", True).text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("full"), F.col("value").alias("content"))
    relative = F.regexp_replace(F.col("full"), "^.*?" + root.rstrip("/").replace(".", "[.]") + "/", "")
    named = files.select(F.lit(repo_id).alias("repo_id"), relative.alias("path"), "content")
    return named.select("*", language_of("path").alias("language"), skip_reason("path").alias("skip"))


def facts(files: DataFrame) -> DataFrame:
    """Facts of kept files: deterministic id, kind, key and digest; unchanged files keep their ids."""
    kept = files.where("skip IS NULL")
    key = F.concat_ws("\n", "repo_id", "path")
    return kept.select(F.sha2(F.concat_ws("\n", F.lit("file"), key, F.sha2("content", 256)), 256).alias("fact_id"), F.lit("file").alias("fact_kind"), "repo_id", F.col("path").alias("stable_fact_key"), F.sha2("content", 256).alias("digest"), F.size(F.split("content", "\n")).alias("line_count"), "language")
