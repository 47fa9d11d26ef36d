"""All registered queries and their SQL checks, by key."""

from __future__ import annotations

from functools import wraps
from importlib import import_module

from tillgrain.session import shared_tables

MODULES = ("dashboard", "menu", "ingest", "impute", "forecast", "views", "evaluate", "sinks")


def _gather(package: str, attribute: str) -> dict:
    out: dict = {}
    for module in MODULES:
        try:
            part = getattr(import_module(f"tillgrain.{package}.{module}"), attribute)
        except ModuleNotFoundError as missing:
            if missing.name != f"tillgrain.{package}.{module}":
                raise
            continue
        out.update(part)
    return out


def _call(query):
    @wraps(query)
    def run(spark, sf_dir):
        with shared_tables():
            return query(spark, sf_dir)
    return run


def all_queries() -> dict:
    return {name: _call(query) for name, query in _gather("plans", "QUERIES").items()}


def all_oracles() -> dict[str, str]:
    return _gather("oracle", "ORACLES")
