"""Deterministic ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_id(prefix: str, parts: Sequence[str | Column], digits: int) -> Column:
    """prefix and the first hex digits of the SHA-1 over the lines of the parts; blank parts are <none>."""
    filled = [F.coalesce(F.nullif(F.trim(p if isinstance(p, Column) else F.col(p)), F.lit("")), F.lit("<none>")) for p in parts]
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("\n", *filled).cast("binary")), 1, digits))


def hash_partition(key: str | Column, n: int) -> Column:
    """The first eight bytes of the SHA-256 of a key as a big-endian number, modulo n."""
    digits = F.substring(F.sha2(F.col(key) if isinstance(key, str) else key, 256), 1, 16)
    return (F.conv(digits, 16, 10).cast("decimal(20,0)") % n).cast("long")


def platform_id(kind: Column, provider: Column, name: Column, env: Column, region: Column) -> Column:
    """platform:kind:provider:name:env:region, blanks as none; null without a name where env or region is blank."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    parts = [F.coalesce(blank(c), F.lit("none")) for c in (kind, provider, name, env, region)]
    nameless = blank(name).isNull() & (blank(env).isNull() | blank(region).isNull())
    return F.when(~nameless, F.concat_ws(":", F.lit("platform"), *parts))
