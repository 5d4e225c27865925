"""Allow and block lists of URLs: a trie over reversed host labels and path segments, longest match first."""

from __future__ import annotations

from bisect import insort
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lower_ascii

#: (verdict, host, path) of the production lists.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: The verdict where no rule fits.
DEFAULT = "allow"
#: Rules that a trie in each Python worker may hold; longer lists are joined.
TRIE_RULES = 200_000
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def build_trie(rules: Sequence[tuple[str, str, str]]) -> dict:
    """Nodes {"next": {label or segment: node}}: a host node has {"path": node}, a path node {"ends": {last part: (rule, verdict)}, "lengths": of those parts, rising}.

    A rule's last path part need not be a whole segment: it is kept as a prefix of the url's. Of equal rules, block wins.
    """
    root: dict = {"next": {}, "path": None}
    for verdict, host, path in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node["next"].setdefault(label, {"next": {}, "path": None})
        node["path"] = node["path"] or {"next": {}, "ends": {}, "lengths": []}
        at, (*segments, last) = node["path"], path.split("/")
        for s in segments:
            at = at["next"].setdefault(s, {"next": {}, "ends": {}, "lengths": []})
        if last not in at["ends"] and len(last) not in at["lengths"]:
            insort(at["lengths"], len(last))
        if at["ends"].get(last, ("", "allow"))[1] == "allow":
            at["ends"][last] = (host + path, verdict)
    return root


def _in_path(node: dict, path: str) -> tuple[str, str] | None:
    best = None
    for s in path.split("/"):
        # Only the beginnings that some rule is as long as, so a long segment costs no more than a short one.
        for k in reversed(node["lengths"]):
            if k <= len(s) and s[:k] in node["ends"]:
                best = node["ends"][s[:k]]
                break
        node = node["next"].get(s)
        if node is None:
            break
    return best


def look_up(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """The (rule, verdict) of the longest host, and for it the longest path, that fits."""
    node, best = trie, None
    for label in reversed(host.split(".")):
        node = node["next"].get(label)
        if node is None:
            break
        if node["path"] is not None:
            best = _in_path(node["path"], path) or best
    return best


def _by_trie(parts: DataFrame, rules) -> DataFrame:
    trie = parts.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judge(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        got = [look_up(trie.value, h, p) or (None, None) for h, p in zip(host, path, strict=True)]
        return pd.DataFrame(got, columns=["rule", "verdict"])

    return parts.withColumn("__hit", judge("host", "path")).select("*", "__hit.rule", "__hit.verdict").drop("__hit")


def _by_join(parts: DataFrame, rules) -> DataFrame:
    """The same for lists of any length: each distinct host's suffixes are joined with the rules, the best kept by url."""
    lists = parts.sparkSession.createDataFrame([(h, p, v, h + p) for v, h, p in rules], "r_host string, r_path string, verdict string, rule string")
    labels = F.split("host", r"\.")
    keyed = parts.select("host", "path").distinct().select("*", labels.alias("l"))
    keyed = keyed.select("host", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size("l")), lambda i: F.array_join(F.slice("l", i, F.size("l")), "."))).alias("r_host"))
    fits = keyed.join(lists, "r_host").where(F.startswith("path", "r_path"))
    rank = F.struct(F.length("r_host"), F.length("r_path"), (F.col("verdict") == "block"))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("__hit"))
    return parts.join(best, ["host", "path"], "left").select(*parts.columns, "__hit.rule", "__hit.verdict")


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, default: str = DEFAULT, trie_rules: int = TRIE_RULES) -> DataFrame:
    """Key, host, path, rule and verdict of each url; rule is null and the verdict `default` where none fits.

    A null url, or one without "://", has an empty host and path, which no rule with a host fits. Repeated rows are judged
    alike, an empty table gives no rows, other columns are ignored; very long urls are read whole, in time that grows with
    their length.
    """
    parts = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    judged = (_by_trie if len(rules) <= trie_rules else _by_join)(parts, list(rules))
    return judged.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


ORACLE = """
WITH parts AS (
  SELECT page_id,
         translate(CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1) ELSE '' END,
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
rules AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) t(verdict, rhost, rpath)),
hits AS (SELECT page_id, rhost || rpath AS rule, verdict,
                row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) DESC, length(rpath) DESC) AS k
         FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT p.page_id, coalesce(p.host, '') AS host, coalesce(p.path, '') AS path, h.rule, coalesce(h.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN hits h ON p.page_id = h.page_id AND h.k = 1
"""
