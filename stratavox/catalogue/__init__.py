"""Registered queries, one per operator of the inventory."""

from __future__ import annotations

import importlib
from types import SimpleNamespace

from stratavox.catalogue.registry import ORACLES, QUERIES

MODULES = ("intensity", "geometry", "sources", "metrics", "codes", "stencils", "degradation", "recipes", "stateful", "journeys")


def load() -> SimpleNamespace:
    for module in MODULES:
        importlib.import_module(f"stratavox.catalogue.{module}")
    return SimpleNamespace(queries=QUERIES, oracles=ORACLES)
