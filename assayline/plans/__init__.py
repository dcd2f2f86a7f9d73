"""Named queries over the standard tables."""

from __future__ import annotations

from importlib import import_module

MODULES = ("check_plans", "report_plans", "import_plans", "registry_plans", "stored_plans", "change_plans")


def _load() -> None:
    for name in MODULES:
        import_module(f"assayline.plans.{name}")


def all_queries() -> dict:
    from assayline.plans.registry import QUERIES

    _load()
    return dict(QUERIES)


def all_sql() -> dict:
    from assayline.plans.registry import SQL

    _load()
    return dict(SQL)
