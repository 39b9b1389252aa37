"""Fix planning over DataFrames; applying a plan is an action of its own."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FROM = re.compile(r"^(?P<head>\s*from\s+\S+\s+import)\s+(?P<names>\S.*?)\s*$")
_PLAIN = re.compile(r"^(?P<head>\s*import)\s+(?P<names>\S.*?)\s*$")
EDITS = "file string, line int, target string, new_text string, applied boolean"


@dataclass
class FixResult:
    removed_imports: list[str] = field(default_factory=list)
    deleted_files: list[str] = field(default_factory=list)
    removed_deps: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)

    @property
    def total(self):
        """Things that were or would be removed."""
        return sum(map(len, (self.deleted_files, self.removed_deps, self.removed_imports)))


@lru_cache(1 << 12)
def without_name(line: str, name: str) -> str | None:
    """An import line without ``name``; '' if nothing is left, None if it can't be taken out.

    Lines that go on after a bracket or a backslash, and comments, are left alone.
    """
    body = line.rstrip("\r\n")
    found = _FROM.match(body) or _PLAIN.match(body)
    if not found or "#" in body or body.endswith("\\"):
        return None
    names = found["names"]
    if names.startswith("("):
        if not names.endswith(")"):
            return None
        names = names[1:-1]
    parts = [p.strip() for p in names.split(",") if p.strip()]
    plain = found.re is _PLAIN

    def bound(part: str) -> str:
        original, _, other = part.partition(" as ")
        return (other.strip() or original.split(".")[0]) if plain else original.strip()

    kept = [p for p in parts if bound(p) != name]
    if len(kept) == len(parts):
        return None
    return f"{found['head']} {', '.join(kept)}{line[len(body):]}" if kept else ""


def import_edits(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows of ``EDITS``: each line that loses imports, as it is after all of them.

    ``lines`` has path, line and text. Only edits that change the line are applied.
    """
    asked = findings.where("rule = 'unused-imports' and fix.kind = 'remove_import'").groupBy("file", "line")
    asked = asked.agg(F.sort_array(F.collect_set("fix.target")).alias("targets"))
    rows = asked.join(lines.select(F.col("path").alias("file"), "line", "text"), ["file", "line"])

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("line", pa.int32()), ("target", pa.string()), ("new_text", pa.string()), ("applied", pa.bool_())])
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                text, done = row["text"], []
                for target in row["targets"]:
                    changed = without_name(text, target)
                    done.append(changed is not None)
                    text = text if changed is None else changed
                out += [{"file": row["file"], "line": row["line"], "target": t, "new_text": text, "applied": d} for t, d in zip(row["targets"], done, strict=True)]
            yield pa.RecordBatch.from_pylist(out, schema)

    return rows.select("file", "line", "text", "targets").mapInArrow(edit, EDITS)


def fix_plan(findings: DataFrame) -> DataFrame:
    """(kind, file, line, target) of what can be fixed without a person."""
    return findings.where("fix is not null and fix.auto_fixable").select("fix.kind", "file", "line", "fix.target")


def requirement_of(line: str) -> str | None:
    """Normalised name in a line of a dependency list; '' and None for none."""
    found = re.match(r"""^\s*["']\s*([A-Za-z0-9._-]+)""", line)
    return re.sub("[-.]", "_", found[1].lower()) if found else None


def without_requirements(text: str, names: set[str]) -> tuple[str, list[str]]:
    """A pyproject text without these main dependencies, and those that were in it.

    Only lists with one requirement a line are edited.
    """
    kept, removed, inside = [], [], False
    for line in text.splitlines(keepends=True):
        bare = line.strip()
        if not inside and re.match(r"dependencies\s*=", bare):
            inside = not bare.endswith("]")
        elif inside and bare.startswith("]"):
            inside = False
        elif inside and (name := requirement_of(bare)) in names:
            removed.append(name)
            continue
        kept.append(line)
    return "".join(kept), removed


def apply_fixes(findings: DataFrame, lines: DataFrame, root: Path | str, dry_run: bool = True) -> FixResult:
    """Carry out the plan below ``root``; a dry run only lists it.

    Files are edited where they are, so this runs on the driver's machine.
    """
    root, result = Path(root), FixResult()
    edits: dict[str, dict[int, str]] = {}
    for row in import_edits(findings, lines).where("applied").orderBy("file", "line", "target").collect():
        result.removed_imports.append(f"{row['file']}: {row['target']}")
        edits.setdefault(row["file"], {})[row["line"]] = row["new_text"]
    for file, own in edits.items():
        path = root / file
        if dry_run or not path.exists():
            continue
        old = path.read_text(encoding="utf-8").splitlines(keepends=True)
        new = []
        for number, line in enumerate(old, 1):
            if number not in own:
                new.append(line)
            elif own[number]:
                new.append(own[number] + line[len(line.rstrip("\r\n")) :])
        path.write_text("".join(new), encoding="utf-8")
    plan = fix_plan(findings).where("kind in ('delete_file', 'remove_dependency')").orderBy("kind", "target").collect()
    for row in plan:
        path = root / row["target"]
        if row["kind"] == "delete_file" and path.exists():
            result.deleted_files.append(row["target"])
            if not dry_run:
                path.unlink()
    names = {r["target"] for r in plan if r["kind"] == "remove_dependency"}
    project = root / "pyproject.toml"
    if names and project.exists():
        text, result.removed_deps = without_requirements(project.read_text(encoding="utf-8"), names)
        if result.removed_deps and not dry_run:
            project.write_text(text, encoding="utf-8")
    return result
