"""Deterministic per-key numbers from md5, so results never depend on
partitioning, retries or ``rand()`` seeds. DuckDB computes the same values
with ``md5`` and a hex cast."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_u32(*parts: Column) -> Column:
    """First 32 bits of md5(parts joined by ':') as a non-negative long."""
    key = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def md5_bucket(n: int, *parts: Column) -> Column:
    """Bucket in [0, n) from md5 of the key."""
    return F.pmod(md5_u32(*parts), F.lit(n))


def md5_unit(*parts: Column) -> Column:
    """Uniform draw in [0, 1) from md5 of the key."""
    return md5_u32(*parts) / F.lit(float(2 ** 32))


def py_md5_u32(*parts) -> int:
    """Python twin of :func:`md5_u32` for use inside pandas tasks (the first
    four digest bytes, big-endian, are the first eight hex digits)."""
    key = ":".join(map(str, parts))
    return int.from_bytes(hashlib.md5(key.encode("utf-8")).digest()[:4], "big")


def py_md5_unit(*parts) -> float:
    return py_md5_u32(*parts) / float(2 ** 32)
