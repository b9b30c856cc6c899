"""Registered queries. Importing a module of this package registers its queries."""

from __future__ import annotations

import importlib
import pkgutil

from lakewright.plans.registry import PLANS, Plan


def load_plans() -> dict[str, Plan]:
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return PLANS
