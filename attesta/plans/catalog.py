"""All registered queries: name -> (Spark query, DuckDB oracle or None)."""

from __future__ import annotations

import importlib
import pkgutil

import attesta.plans as plans


def all_queries():
    found = {}
    for info in sorted(pkgutil.iter_modules(plans.__path__), key=lambda m: m.name):
        if info.name.startswith("queries_"):
            module = importlib.import_module(f"attesta.plans.{info.name}")
            for name, pair in module.QUERIES.items():
                if name in found:
                    raise ValueError(f"query {name} is registered twice")
                found[name] = pair
    return found
