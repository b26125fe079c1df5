"""All queries of the engine by name, with their SQL."""

from __future__ import annotations

import importlib

from pulsequilt.plans import registry

for _name in ("rhythm", "intervals", "fusion", "quality", "waves", "records", "documents", "leads", "policies", "signals", "engine", "rescues", "consensus", "taxis", "merging", "streams"):
    importlib.import_module(f"pulsequilt.plans.{_name}")


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
