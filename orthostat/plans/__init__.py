"""Named queries: each module has QUERIES (name to callable) and SQL (name to DuckDB text)."""

from __future__ import annotations

import importlib
from types import ModuleType

_NAMES = ["proximity", "scalar", "validators", "joins", "reports", "graph", "features", "assertions", "replies"]


def modules() -> list[ModuleType]:
    return [importlib.import_module(f"{__name__}.{name}") for name in _NAMES]
