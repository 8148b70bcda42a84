"""The README's operator inventory names functions and queries that exist."""

import importlib
import os
import re

import __spark_entry__ as E

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
MODULES = {m: f"shoppulse.operators.{m}" for m in
           ("text", "schema", "sampling", "features", "correlation", "scoring", "metrics", "rules", "models",
            "topics", "layout")}
MODULES.update({"sources": "shoppulse.sources", "functions": "shoppulse.functions"})


def _inventory():
    s = open(os.path.join(ROOT, "README.md"), encoding="utf-8").read()
    return s[s.index("## Operator inventory"):s.index("## Design for scale")]


def test_inventory_functions_exist():
    missing = []
    for mod, fn in re.findall(r"`(\w+)\.(\w+)`", _inventory()):
        if mod in MODULES and not hasattr(importlib.import_module(MODULES[mod]), fn):
            missing.append(f"{mod}.{fn}")
    assert not missing


def test_inventory_queries_registered():
    queries = E.queries()
    named = set()
    for row in _inventory().splitlines():
        if row.startswith("| ") and row.count("|") >= 4:
            named |= set(re.findall(r"`([a-z0-9_]+)`", row.split("|")[3]))
    assert named and named <= set(queries)


def test_every_sql_query_is_registered():
    assert set(E.oracle_sql()) <= set(E.queries())
