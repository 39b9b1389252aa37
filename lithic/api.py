"""Functions over a source tree, for programs."""

from __future__ import annotations

from os import PathLike
from typing import Any

from pyspark.sql import SparkSession

from .operators import facts
from .operators.clones import sorted_groups
from .plans.engine import Engine
from .sources.config import Config, load_config
from .sources.reports import Results

Root = PathLike | str | None
Settings = Config | None


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.appName("lithic").getOrCreate()


def _engine(root: Root, config: Settings) -> Engine:
    return Engine.of_tree(session(), config or load_config(root))


def detect_dead_code(root: Root = None, config: Settings = None) -> Results:
    """The full analysis."""
    return _engine(root, config).results()


def detect_circular_dependencies(root: Root = None, config: Settings = None) -> list[dict[str, Any]]:
    rows = _engine(root, config).cycles.collect()
    return [{"modules": r["modules"], "edges": [list(e) for e in r["edges"]]} for r in rows]


def compute_complexity(root: Root = None, config: Settings = None, at_least: int | None = None) -> list[dict[str, Any]]:
    """Functions by file; with ``at_least`` those of that cyclomatic complexity or more."""
    rows = facts.functions(_engine(root, config).modules)
    if at_least is not None:
        rows = rows.where(rows.cyclomatic >= at_least)
    names = ("name", "kind", "line", "end_line", "cyclomatic", "cognitive", "parameters", "lines_of_code")
    found = rows.orderBy("path", "function_id").select(rows.path.alias("file"), *names)
    return [r.asDict() for r in found.collect()]


def compute_health(root: Root = None, config: Settings = None) -> dict[str, Any]:
    return _engine(root, config).health_row()


def find_duplicates(root: Root = None, config: Settings = None, mode: str | None = None) -> list[dict[str, Any]]:
    config = config or load_config(root)
    if mode:
        config.duplicates.mode = mode
    return [r.asDict(recursive=True) for r in sorted_groups(_engine(root, config).clones).collect()]
