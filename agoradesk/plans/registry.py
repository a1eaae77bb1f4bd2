"""Every registered query: name → (DataFrame builder, equivalent SQL or None)."""

from __future__ import annotations

import importlib

MODULES = ("relational", "event_state", "chronicle", "corpus", "search", "questioning", "entitlements", "auditing", "governing", "nesting", "onboard")

QUERIES: dict = {}
for _name in MODULES:
    try:
        _module = importlib.import_module(f"agoradesk.plans.{_name}")
    except ModuleNotFoundError as error:
        if error.name != f"agoradesk.plans.{_name}":
            raise
        continue
    QUERIES.update(_module.QUERIES)
