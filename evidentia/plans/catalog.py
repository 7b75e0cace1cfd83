"""All named queries and their SQL counterparts."""

from __future__ import annotations

from importlib import import_module

#: Modules of this package that define QUERIES (name -> function) and ORACLE (name -> SQL).
FAMILIES = ("units", "ranking", "evaluation", "judging", "checks", "bundles", "workflow")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for family in FAMILIES:
        out |= getattr(import_module(f"evidentia.plans.{family}"), attribute)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLE")
