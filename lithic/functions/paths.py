"""Path predicates as Column expressions."""

from __future__ import annotations

import fnmatch as _fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression for ``rlike``; ``*`` crosses ``/``."""
    return "^" + _fnmatch.translate(pattern).replace("\\Z", "\\z")


def matches_glob(path: Column, pattern: str) -> Column:
    return path.rlike(glob_regex(pattern))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_hidden(path: Column) -> Column:
    """Does any component start with a dot?"""
    return F.exists(F.split(path, "/"), lambda part: part.startswith("."))


def is_ignored(path: Column, patterns: list[str]) -> Column:
    """Does a pattern match the whole path or the bare file name?"""
    out = F.lit(False)
    for p in patterns:
        out = out | matches_glob(path, p) | matches_glob(file_name(path), p)
    return out


def in_zone(path: Column, pattern: str) -> Column:
    """Zone patterns: the glob, the glob without a leading ``**/``, or the first
    component (stars removed) as any directory or file of the path."""
    out = matches_glob(path, pattern)
    if pattern.startswith("**/"):
        out = out | matches_glob(path, pattern[3:])
    head, _, _ = pattern.replace("**/", "").partition("/")
    if head := head.replace("*", ""):
        out = out | F.array_contains(F.split(path, "/"), head)
    return out


def normalised_dependency(name: Column) -> Column:
    return F.translate(F.lower(name), "-.", "__")


def requirement_name(requirement: Column) -> Column:
    """Name in a requirement: up to the first of ``> < = [ ;``, normalised."""
    return normalised_dependency(F.trim(F.regexp_extract(requirement, r"^[^><=\[;]*", 0)))
