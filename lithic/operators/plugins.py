"""Framework plugins: which exports, imports and files a framework uses by itself."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _any(tests: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


@dataclass(frozen=True)
class Plugin:
    """Predicates over (name, decorators, path) columns; empty sets say never."""

    packages: tuple[str, ...]
    decorators: frozenset[str] = frozenset()
    names: frozenset[str] = frozenset()
    import_names: frozenset[str] = frozenset()
    import_files: str = ""
    entry_suffixes: tuple[str, ...] = ()
    entry_parts: tuple[str, ...] = ()
    entries_are_used: bool = False
    suppressed_in: str = ""
    suppressed: frozenset[str] = field(default_factory=frozenset)

    def is_entry_file(self, path: Column) -> Column:
        ends = [path.endswith(s) for s in self.entry_suffixes]
        return _any([*ends, *[path.contains(p) for p in self.entry_parts]])

    def is_used_export(self, name: Column, decorators: Column, path: Column) -> Column:
        out = F.arrays_overlap(decorators, F.array(*[F.lit(d) for d in sorted(self.decorators)])) | name.isin(*self.names)
        return F.coalesce(out | self.is_entry_file(path) if self.entries_are_used else out, F.lit(False))

    def is_used_import(self, module: Column, name: Column, path: Column) -> Column:
        return name.isin(*self.import_names) & path.endswith(self.import_files)

    def suppressed_rules(self, path: Column) -> Column:
        rules = F.array(*[F.lit(r) for r in sorted(self.suppressed)]).cast("array<string>")
        return F.when(path.contains(self.suppressed_in) if self.suppressed_in else F.lit(False), rules).otherwise(F.array().cast("array<string>"))


def _set(words: str) -> frozenset[str]:
    return frozenset(words.split())


_DJANGO_FILES = "admin.py apps.py asgi.py management/commands/ migrations/ signals.py templatetags/ urls.py wsgi.py".split()
PLUGINS = {
    "celery": Plugin(
        ("celery",), _set("on_after_configure on_after_finalize periodic_task shared_task task"), _set("app celery_app"), entry_suffixes=("celery.py", "tasks.py")
    ),
    "django": Plugin(
        ("django",), _set("action admin_register api_view login_required permission_required receiver register"), _set("app_name default_app_config urlpatterns"),
        _set("Manager Model QuerySet"), "models.py", tuple(_DJANGO_FILES), tuple(f"/{f}" for f in _DJANGO_FILES), True,
        "migrations/", _set("high-complexity unused-classes unused-functions unused-imports"),
    ),
    "fastapi": Plugin(
        ("fastapi",), _set("delete exception_handler get head middleware on_event options patch post put trace websocket"), _set("app router"),
        _set("Body Cookie Depends File Form Header Path Query"), entry_suffixes=("app.py", "main.py"),
    ),
    "flask": Plugin(
        ("flask",), _set("after_app_request after_request before_app_request before_request cli command errorhandler route teardown_request"), _set("app create_app"),
        entry_suffixes=("app.py", "wsgi.py"),
    ),
    "pytest": Plugin(
        ("pytest",), _set("fixture hookimpl hookspec mark parametrize"), entry_parts=("conftest.py",), entries_are_used=True,
        suppressed_in="conftest.py", suppressed=_set("unused-functions unused-imports"),
    ),
}


class Registry:
    """The active plugins; predicates hold if any plugin's does, rules add up."""

    def __init__(self, plugins: dict[str, Plugin]):
        self.plugins = plugins

    def is_entry_file(self, path: Column) -> Column:
        return _any(p.is_entry_file(path) for p in self.plugins.values())

    def is_used_export(self, name: Column, decorators: Column, path: Column) -> Column:
        return _any(p.is_used_export(name, decorators, path) for p in self.plugins.values())

    def is_used_import(self, module: Column, name: Column, path: Column) -> Column:
        return _any(p.is_used_import(module, name, path) for p in self.plugins.values())

    def suppressed_rules(self, path: Column) -> Column:
        empty = F.array().cast("array<string>")
        return reduce(F.array_union, (p.suppressed_rules(path) for p in self.plugins.values()), empty)


def plain_requirement(requirement: str) -> str:
    """Name of a requirement for activation: dots stay, unlike where rules compare names."""
    for mark in ("[", ";", "=", "<", ">"):
        requirement = requirement.partition(mark)[0]
    return requirement.strip().lower().replace("-", "_")


def load_plugins(requirements: list[tuple[str, bool]] | None) -> Registry:
    """The plugins one of whose packages is declared, in whatever group."""
    names = {plain_requirement(r) for r, _ in requirements or []}
    return Registry({k: p for k, p in PLUGINS.items() if names & set(p.packages)})
