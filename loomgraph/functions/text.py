"""Patterns over names, paths, urls and texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Environment names and their aliases.
ENV_ALIASES = {"prod": "prod", "production": "prod", "stage": "stage", "staging": "stage", "dev": "dev", "test": "test"}


def hostname(url: str) -> Column:
    return F.lower(F.regexp_extract(url, r"^https?://([^/?#]+)", 1))


def url_path(url: str) -> Column:
    return F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)


def normal_url(url: str) -> Column:
    """https, no www or m label, no query, fragment, .html or closing slash, lower case."""
    bare = F.split_part(F.split_part(url, F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    name = F.regexp_replace(bare, r"^https?://(www\.|m\.)?", "")
    return F.concat(F.lit("https://"), F.lower(F.regexp_replace(name, r"(\.html|/)$", "")))


def first_match(c: str, patterns: list[str], default: str) -> Column:
    """Group 1 of the first pattern that fits."""
    found = [F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in patterns]
    return F.coalesce(*found, F.lit(default))


def env_names(c: str, aliases: dict[str, str]) -> Column:
    """Sorted canonical names of the aliases that stand in a text as whole words, as one string."""
    plain = F.concat(F.lit("_"), F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))
    hits = F.array(*[F.when(F.contains(plain, F.lit(f"_{a}_")), F.lit(name)) for a, name in aliases.items()])
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(hits))), ",")


def first_word(c: str, table: list[tuple[str, str]], default: str) -> Column:
    """The value of the first word of the table that a name holds."""
    return reduce(lambda rest, kv: F.when(F.contains(c, F.lit(kv[0])), kv[1]).otherwise(rest), reversed(table), F.lit(default))
