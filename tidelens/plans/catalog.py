"""Collects the queries of all families."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    covers: str


_ALL: dict[str, Query] = {}


def add(name: str, covers: str, run, oracle: str | None = None) -> None:
    if name in _ALL:
        raise ValueError(f"query {name} registered twice")
    _ALL[name] = Query(name, run, oracle, covers)


def query(name: str, covers: str, oracle: str | None = None):
    def wrap(fn):
        add(name, covers, fn, oracle)
        return fn

    return wrap


def catalogue() -> dict[str, Query]:
    import importlib

    for family in ("indicators", "features", "data", "market", "vaults", "portfolio", "evaluation", "social",
                   "signals", "prepare", "streams"):
        importlib.import_module(f"{__package__}.{family}")
    return dict(_ALL)
