"""Registry of queries: name -> (callable(spark, sf_dir) -> DataFrame, DuckDB SQL or None).

Each query reads the given tables (or fixtures Spark derives from them) in
full.  Float outputs are rounded to 6 decimals on both sides so the oracle
hash does not depend on the last bits of a library ``ln``/``sqrt``.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def load_all() -> dict:
    # importing the modules fills the registry
    from shoppulse.plans import q_text, q_features, q_scoring, q_models  # noqa: F401
    return REGISTRY
