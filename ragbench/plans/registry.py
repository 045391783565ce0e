"""All registered queries and their DuckDB SQL, by family."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("retrieval", "ranking", "analysis", "annotation", "pipelines", "lifecycle", "rules")


def queries() -> dict:
    return {name: fn for family in FAMILIES for name, fn in import_module(f"ragbench.plans.{family}").QUERIES.items()}


def sql() -> dict:
    return {name: text for family in FAMILIES for name, text in import_module(f"ragbench.plans.{family}").SQL.items()}
