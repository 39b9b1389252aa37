"""Settings: defaults, ``.lithicrc.toml`` or ``[tool.lithic]``, then overrides."""

from __future__ import annotations

import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from os import PathLike
from pathlib import Path
from typing import Any

RC, TABLE = ".lithicrc.toml", "lithic"
#: Findings of a rule that isn't listed are off.
SEVERITIES = {
    **dict.fromkeys(["boundary-violation", "circular-dependencies", "hardcoded-secret"], "error"),
    **dict.fromkeys([f"unused-{what}" for what in ("classes", "dependencies", "files", "functions", "imports")], "error"),
    **dict.fromkeys(["duplicate-code", "high-complexity", "stale-suppression", "unlisted-dependencies"], "warn"),
    **dict.fromkeys(["unused-all-entries", "unused-variables"], "warn"),
    "taint-sink": "off",
}


@dataclass
class Rules:
    overrides: dict[str, str] = field(default_factory=dict)

    def severity_for(self, rule: str) -> str:
        return self.overrides.get(rule, SEVERITIES.get(rule, "off"))


@dataclass
class Duplicates:
    mode: str = "mild"
    min_tokens: int = 50
    min_lines: int = 5
    min_occurrences: int = 2


@dataclass
class Health:
    max_cyclomatic: int = 20
    max_cognitive: int = 15


@dataclass
class Zone:
    name: str
    patterns: list[str]


@dataclass
class ZoneRule:
    source: str
    allow: list[str] = field(default_factory=list)


@dataclass
class Boundaries:
    preset: str | None = None
    zones: list[Zone] = field(default_factory=list)
    rules: list[ZoneRule] = field(default_factory=list)


def ignore_defaults() -> list[str]:
    inside = ".git .venv __pycache__ build dist node_modules venv *.egg-info".split()
    return [f"**/{name}/**" for name in inside]


@dataclass
class Config:
    root: Path = field(default_factory=Path.cwd)
    entry: list[str] = field(default_factory=list)
    rules: Rules = field(default_factory=Rules)
    duplicates: Duplicates = field(default_factory=Duplicates)
    health: Health = field(default_factory=Health)
    boundaries: Boundaries = field(default_factory=Boundaries)
    ignore_patterns: list[str] = field(default_factory=ignore_defaults)
    ignore_dependencies: list[str] = field(default_factory=list)
    src_paths: list[str] = field(default_factory=lambda: "src .".split())
    test_patterns: list[str] = field(default_factory=lambda: "tests/** test/** **/test_*.py **/*_test.py".split())
    baseline: str | None = None
    ci: bool = False
    changed_since: str | None = None
    fail_on_issues: bool = False
    output_file: str | None = None
    format: str = "human"


def find_project_root(start: Path) -> Path:
    """Nearest folder at or above ``start`` with a settings file; else ``start``."""
    start = start.resolve()
    for folder in [start, *start.parents]:
        if (folder / RC).exists() or (folder / "pyproject.toml").exists():
            return folder
    return start


def read_toml(path: Path) -> dict[str, Any]:
    with path.open("rb") as f:
        return tomllib.load(f)


def _section(cls: type, raw: Any) -> Any:
    if not isinstance(raw, dict):
        return raw
    known = {f.name for f in fields(cls)}
    return cls(**{k: v for k, v in raw.items() if k in known})


def _build(raw: dict[str, Any]) -> Config:
    raw = dict(raw)
    rules = raw.pop("rules", None)
    if isinstance(rules, dict):
        inner = rules.get("overrides") if isinstance(rules.get("overrides"), dict) else rules
        raw["rules"] = Rules({k: v for k, v in inner.items() if isinstance(v, str)})
    for name, cls in (("duplicates", Duplicates), ("health", Health)):
        if name in raw:
            raw[name] = _section(cls, raw[name])
    if isinstance(zones := raw.get("boundaries"), dict):
        raw["boundaries"] = Boundaries(
            preset=zones.get("preset"),
            zones=[Zone(z["name"], list(z.get("patterns", []))) for z in zones.get("zones", [])],
            rules=[ZoneRule(r["from"], list(r.get("allow", []))) for r in zones.get("rules", [])],
        )
    config = _section(Config, raw)
    config.root = Path(config.root)
    return config


def load_config(root: PathLike | str | None = None, config_path: PathLike | str | None = None, overrides: Mapping | None = None) -> Config:
    """An explicit file, else the rc file, else pyproject's table; overrides replace
    whole top-level keys."""
    folder = Path(root).resolve() if root else find_project_root(Path.cwd())
    raw: Mapping = {}
    if config_path is not None:
        whole = read_toml(Path(config_path))
        raw = whole.get("tool", {}).get(TABLE, whole)
    elif (folder / RC).exists():
        raw = read_toml(folder / RC)
    elif (folder / "pyproject.toml").exists():
        raw = read_toml(folder / "pyproject.toml").get("tool", {}).get(TABLE, {})
    return _build({**raw, "root": folder, **(overrides or {})})


def declared_requirements(root: Path) -> list[tuple[str, bool]] | None:
    """(requirement, optional) of ``[project]``; None without a readable pyproject."""
    try:
        project = read_toml(Path(root) / "pyproject.toml").get("project", {})
    except (OSError, tomllib.TOMLDecodeError, UnicodeDecodeError):
        return None
    main = [(d, False) for d in project.get("dependencies", [])]
    groups = project.get("optional-dependencies", {})
    return main + [(need, True) for name in groups for need in groups[name]]
