"""Deterministic per-key hashing for samples, splits and folds.

``DataFrame.sample``/``randomSplit`` depend on partition layout, so the same
seed can select different rows after a repartition.  A hash of the key does
not: a row is in or out regardless of where it lives, and DuckDB computes the
same value (``('0x' || substr(md5(key || ':' || salt), 1, 8))::bigint``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296


def hash_bucket(key, salt: str | int) -> Column:
    """First 32 bits of md5(key ':' salt) as a bigint in [0, 2^32)."""
    k = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(k.cast("string"), F.lit(f":{salt}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def unit_hash(key, salt: str | int) -> Column:
    """``hash_bucket`` scaled to [0, 1)."""
    return hash_bucket(key, salt) / F.lit(float(TWO_32))


def sql_hash_bucket(key_sql: str, salt: str | int) -> str:
    """DuckDB text of :func:`hash_bucket` for oracle queries."""
    return f"('0x' || substr(md5(CAST({key_sql} AS VARCHAR) || ':{salt}'), 1, 8))::BIGINT"
