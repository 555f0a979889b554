"""Sinks that pass their table on, and functions as tasks."""

from __future__ import annotations

import logging
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG = logging.getLogger("weftline")


def logged(table: Any, level: str = "info", rows: int = 20) -> Any:
    """Log a value at a level and pass it on unchanged: of a table its first rows, or with level dir its plan too."""
    at = {"debug": logging.DEBUG, "info": logging.INFO, "log": logging.INFO, "dir": logging.INFO, "warn": logging.WARNING, "error": logging.ERROR}[level]
    if LOG.isEnabledFor(at):
        if isinstance(table, DataFrame):
            LOG.log(at, "%s", table._show_string(rows, True))
            if level == "dir":
                LOG.log(at, "%s", table._jdf.queryExecution().toString())
        else:
            LOG.log(at, "%r" if level == "dir" else "%s", table)
    return table


def applied(fn: Callable[[Any], Any] | None, value: Any = None) -> Any:
    """A function as a task: on a table it is a transformation of it."""
    if fn is None:
        raise ValueError("No runner provided")
    if not callable(fn):
        raise ValueError("the runner is not a function")
    return value.transform(fn) if isinstance(value, DataFrame) else fn(value)


class OutputSink:
    """Base of sinks: writes a table somewhere, and passes it on with its provenance as columns' metadata."""

    def __init__(self, write: Callable[[DataFrame], None]):
        self.write = write

    def __call__(self, table: DataFrame, provenance: dict[str, Any] | None = None) -> DataFrame:
        noted = table.select(*[F.col(f"`{c}`").alias(c, metadata={"provenance": provenance or {}}) for c in table.columns])
        self.write(noted)
        return noted
