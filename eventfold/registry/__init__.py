"""Named runs of every operator over the given tables, with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]

RUNS: dict[str, Run] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Add a run under ``name``; ``sql`` is the statement its rows must equal."""

    def add(fn: Run) -> Run:
        if name in RUNS:
            raise ValueError(f"{name} is registered twice")
        RUNS[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def load_all() -> None:
    """Import every module that registers runs."""
    from eventfold.registry import (  # noqa: F401
        changelogs,
        commands,
        decoding,
        failing,
        folding,
        observing,
        serving,
        sourcing,
        streams,
    )
