"""Queries of the subpackage and, where SQL can express them, the SQL each must equal."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODULES = (
    "katz",
    "repeats",
    "unit_dedup",
    "main_text",
    "toxicity",
    "ngram_join",
    "decontaminate",
    "packing",
    "language",
    "content_sort",
    "whitening",
    "collocation",
    "quality",
)


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with its SQL twin if there is one."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def load() -> tuple[dict, dict]:
    for module in MODULES:
        importlib.import_module(f"stratavox.llm.{module}")
    return QUERIES, ORACLES
