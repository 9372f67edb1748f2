"""Every query of the library by name, with its SQL where SQL can express it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

MODULES: list[str] = ["plans.q_text", "plans.q_relational", "plans.q_ranking", "plans.q_evaluation", "plans.q_udf", "plans.q_claims", "plans.q_selection", "plans.q_answers"]


def _gather(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        own = getattr(importlib.import_module(f"lodestone.{name}"), what)
        if twice := found.keys() & own.keys():
            raise ValueError(f"registered twice: {sorted(twice)}")
        found |= own
    return found


def queries() -> dict[str, Callable]:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLE")
