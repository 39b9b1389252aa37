"""Report formats.

What a report says of each finding is computed in Spark and can be written from
there; the formats that are one document are put together on the driver from
``Results``, which holds the sorted rows.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from typing import Any, TextIO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import __version__
from ..operators.findings import rule_index

TOOL = "lithic"
#: Rules by category; all others are about clarity.
_BY_CATEGORY = {
    "Bug Risk": ["unlisted-dependencies"],
    "Complexity": ["circular-dependencies", "high-complexity"],
    "Duplication": ["duplicate-code"],
    "Security": ["hardcoded-secret", "taint-sink"],
    "Style": ["boundary-violation"],
}
CATEGORIES = {rule: category for category, rules in _BY_CATEGORY.items() for rule in rules}
SUMMARIES = {
    "boundary-violation": "An import crosses architecture zones",
    "circular-dependencies": "Modules import each other in a circle",
    "duplicate-code": "A block of code is repeated",
    "hardcoded-secret": "A credential is written in the code",
    "high-complexity": "A function is above a complexity limit",
    "stale-suppression": "A suppression comment suppresses nothing",
    "taint-sink": "A dangerous function gets a computed argument",
    "unlisted-dependencies": "A package is imported but not declared",
    "unused-all-entries": "A name in __all__ doesn't exist",
    "unused-classes": "No one imports the class",
    "unused-dependencies": "A declared package is never imported",
    "unused-files": "No module leads to the file",
    "unused-functions": "No one imports the function",
    "unused-imports": "The module doesn't use the imported name",
    "unused-variables": "No one imports the variable",
}
LEVELS = {"error": "error", "warn": "warning", "off": "note"}
CLIMATE = {"error": "critical", "warn": "minor", "off": "info"}


@dataclass
class Results:
    """Rows of one analysis, sorted as reports show them."""

    findings: list[dict] = field(default_factory=list)
    cycles: list[dict] = field(default_factory=list)
    duplicates: list[dict] = field(default_factory=list)
    health: dict | None = None
    errors: int = 0
    warnings: int = 0
    total_issues: int = 0
    total_files_scanned: int = 0

    def compute_totals(self):
        """Count what there is; severities are those of findings alone."""
        severities = [f["severity"] for f in self.findings]
        self.errors, self.warnings = severities.count("error"), severities.count("warn")
        self.total_issues = sum(map(len, (self.cycles, self.duplicates, self.findings)))


# ------------------------------------------------------------- rows as columns
def fingerprint() -> Column:
    return F.md5(F.concat_ws(":", "rule", "file", F.col("line").cast("string"), "message"))


def _mapped(values: dict[str, str], key: Column, default: str) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def climate_rows(findings: DataFrame) -> DataFrame:
    """(check_name, description, severity, fingerprint, path, begin, category) of each finding."""
    return findings.select(
        F.col("rule").alias("check_name"), F.col("message").alias("description"), _mapped(CLIMATE, F.col("severity"), "info").alias("severity"), fingerprint().alias("fingerprint"),
        F.col("file").alias("path"), F.greatest("line", F.lit(1)).alias("begin"), _mapped(CATEGORIES, F.col("rule"), "Clarity").alias("category"),
    )


def annotation_rows(findings: DataFrame) -> DataFrame:
    """(value): a workflow command for each finding."""
    command = F.when(F.col("severity") == "error", "error").otherwise("warning")
    return findings.select(F.format_string("::%s file=%s,line=%d::%s: %s", command, "file", F.greatest("line", F.lit(1)), "rule", "message").alias("value"))


def compact_rows(findings: DataFrame) -> DataFrame:
    """(value): one line for each finding."""
    icon = F.when(F.col("severity") == "error", "x").otherwise("!")
    return findings.select(F.format_string("%s:%d: %s %s: %s", "file", "line", icon, "rule", "message").alias("value"))


def sarif_rows(findings: DataFrame) -> DataFrame:
    """(rule_id, rule_index, level, text, uri, start_line, summary) of each finding's result."""
    rows = findings.join(rule_index(findings), "rule")
    return rows.select(
        F.col("rule").alias("rule_id"), "rule_index", _mapped(LEVELS, F.col("severity"), "note").alias("level"), F.col("message").alias("text"), F.col("file").alias("uri"),
        F.greatest(F.coalesce("line", F.lit(0)), F.lit(1)).alias("start_line"), _mapped(SUMMARIES, F.col("rule"), "").alias("summary"),
    )


def markdown_rows(findings: DataFrame) -> DataFrame:
    """(value): one row of the table of findings each."""
    cells = [F.upper("severity"), F.format_string("`%s`", "rule"), F.format_string("`%s`", "file"), F.col("line").cast("string"), F.col("message")]
    return findings.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def write_rows(findings: DataFrame, fmt: str, path: str) -> None:
    """Write findings at scale: json, codeclimate, sarif, github, markdown or compact, one row a line."""
    if fmt == "json":
        findings.write.json(path)
    elif fmt == "codeclimate":
        climate_rows(findings).write.json(path)
    elif fmt == "sarif":
        sarif_rows(findings).write.json(path)
    elif fmt in (lines := {"github": annotation_rows, "compact": compact_rows, "markdown": markdown_rows}):
        lines[fmt](findings).write.text(path)
    else:
        raise ValueError(f"Unknown format: {fmt}")


# ------------------------------------------------------------------- documents
def _line(f: dict) -> int:
    return max(f["line"] or 0, 1)


def _circle(cycle: dict, close: bool = True) -> str:
    mods = cycle["modules"]
    return " -> ".join([*mods, mods[0]] if close else mods)


def _places(group: dict, end: bool = False, quote: str = "") -> str:
    return ", ".join(f"{quote}{f['file']}:{f['start_line']}" + (f"-{f['end_line']}" if end else "") + quote for f in group["fragments"])


def _plural(n: int, word: str) -> str:
    return f"{n} {word}" + "s" * (n != 1)


def to_json(r: Results) -> str:
    return json.dumps(asdict(r), indent=2)


def to_sarif(r: Results) -> str:
    order: dict[str, dict] = {}

    def result(rule: str, level: str, text: str, uri: str, line: int, advice: str | None = None) -> dict:
        order.setdefault(rule, {"id": rule, "shortDescription": {"text": SUMMARIES.get(rule, rule)}, "defaultConfiguration": {"level": level}})
        place = {"artifactLocation": {"uri": uri}, "region": {"startLine": line}}
        out = {"ruleId": rule, "ruleIndex": list(order).index(rule), "level": level, "message": {"text": text}, "locations": [{"physicalLocation": place}]}
        return out | ({"fixes": [{"description": {"text": advice}}]} if advice else {})

    rows = [result(f["rule"], LEVELS[f["severity"]], f["message"], f["file"], _line(f), f.get("suggestion")) for f in r.findings]
    rows += [result("circular-dependencies", "error", f"Circular import: {_circle(c)}", c["modules"][0], 1) for c in r.cycles]
    driver = {"name": TOOL, "version": __version__, "rules": list(order.values())}
    schema = "https://json.schemastore.org/sarif-2.1.0.json"
    run = {"results": rows, "tool": {"driver": driver}}
    return json.dumps({"$schema": schema, "runs": [run], "version": "2.1.0"}, indent=2)


def to_codeclimate(r: Results) -> str:
    def issue(rule: str, text: str, severity: str, key: str, path: str, line: int) -> dict:
        mark = hashlib.md5(key.encode(), usedforsecurity=False).hexdigest()
        place = {"path": path, "lines": {"begin": line}}
        return {"type": "issue", "check_name": rule, "description": text, "severity": severity, "fingerprint": mark, "location": place, "categories": [CATEGORIES.get(rule, "Clarity")]}

    rows = [issue(f["rule"], f["message"], CLIMATE[f["severity"]], f"{f['rule']}:{f['file']}:{f['line']}:{f['message']}", f["file"], _line(f)) for f in r.findings]
    rows += [issue("circular-dependencies", f"Circular import: {_circle(c)}", "critical", f"circular:{_circle(c)}", c["modules"][0], 1) for c in r.cycles]
    return json.dumps(rows, indent=2)


def to_github(r: Results) -> str:
    rows = [f"::{'error' if f['severity'] == 'error' else 'warning'} file={f['file']},line={_line(f)}::{f['rule']}: {f['message']}" for f in r.findings]
    rows += [f"::error file={c['modules'][0]},line=1::circular-dependencies: {_circle(c)}" for c in r.cycles]
    for g in r.duplicates:
        first = g["fragments"][0]
        rows.append(f"::warning file={first['file']},line={first['start_line']}::duplicate-code: {g['token_count']} tokens duplicated at {_places(g)}")
    return "".join(f"{row}\n" for row in rows)


def to_markdown(r: Results) -> str:
    out = ["# Analysis report", ""]
    if r.health:
        h = r.health
        out += [f"**Health:** {h['score']}/100 ({h['grade']})", f"**Files:** {h['total_files']} | **Functions:** {h['total_functions']} | **Lines:** {h['total_lines']}", ""]
    if not (r.findings or r.cycles or r.duplicates):
        return "\n".join([*out, "No issues found.", "", f"Scanned {r.total_files_scanned} files.", ""])
    if r.findings:
        head = ["Severity", "Rule", "File", "Line", "Message"]
        rows = [[f["severity"].upper(), f"`{f['rule']}`", f"`{f['file']}`", str(f["line"]), f["message"]] for f in r.findings]
        out += ["## Findings", "", *("| " + " | ".join(x) + " |" for x in [head, ["---"] * len(head), *rows]), ""]
    if r.cycles:
        out += ["## Circular Dependencies", "", *(f"- {_circle(c)}" for c in r.cycles), ""]
    if r.duplicates:
        said = "{}. **{} tokens, {} lines** ({} occurrences): {}"
        out += ["## Duplicate Code", "", *(said.format(k, g["token_count"], g["line_count"], len(g["fragments"]), _places(g, True, "`")) for k, g in enumerate(r.duplicates, 1)), ""]
    counts = [f"{n} {word}(s)" for n, word in ((r.errors, "error"), (r.warnings, "warning")) if n]
    return "\n".join([*out, "---", f"{' and '.join(counts) or '0 issues'} in {r.total_files_scanned} files.", ""])


def to_compact(r: Results) -> str:
    rows = [f"{f['file']}:{f['line']}: {'x' if f['severity'] == 'error' else '!'} {f['rule']}: {f['message']}" for f in r.findings]
    return "".join(f"{row}\n" for row in [*rows, *(f"circular-dependencies: {_circle(c, False)}" for c in r.cycles)])


def _health_line(h: dict) -> str:
    return f"  Health: {h['score']}/100 ({h['grade']})  Complexity hotspots: {len(h.get('hotspots', []))}  Maintainability: {h['maintainability_avg']} avg"


def to_human(r: Results) -> str:
    if not r.findings and not r.cycles:
        return "\n".join(["", "No issues found.", f"  Scanned {r.total_files_scanned} files", *([_health_line(r.health)] if r.health else []), ""])
    files: dict[str, list[dict]] = {}
    for f in r.findings:
        files.setdefault(f["file"], []).append(f)
    out = [""]
    for path in sorted(files):
        out += [path, *(f"  {'x' if f['severity'] == 'error' else '!'} {f['rule']} {f['message']} {path}" + (f":{f['line']}" if f["line"] else "") for f in files[path]), ""]
    if r.cycles:
        out += ["Circular imports:", *(f"  <> {_circle(c)}" for c in r.cycles), ""]
    if r.duplicates:
        out += [f"Duplicate code: {len(r.duplicates)} group(s)", *(f"  D {g['token_count']} tokens, {g['line_count']} lines — {_places(g)}" for g in r.duplicates[:5])]
        out += [f"  ... and {len(r.duplicates) - 5} more"] * (len(r.duplicates) > 5) + [""]
    if r.health:
        out.append(_health_line(r.health))
    counts = [_plural(n, word) for n, word in ((r.errors, "error"), (r.warnings, "warning")) if n]
    return "\n".join([*out, f"  {' and '.join(counts) or '0 issues'} in {r.total_files_scanned} files", ""])


FORMATS = {"human": to_human, "json": to_json, "sarif": to_sarif, "codeclimate": to_codeclimate, "github": to_github, "markdown": to_markdown, "compact": to_compact}


def format_results(r: Results, fmt: str = "human", file: TextIO | None = None) -> str:
    if fmt not in FORMATS:
        raise ValueError(f"Unknown format: {fmt}. Known: {', '.join(sorted(FORMATS))}")
    text = FORMATS[fmt](r)
    if file:
        file.write(text)
    return text


def format_health(project: dict, files: list[dict], fmt: str = "human", score_only: bool = False) -> str:
    if fmt == "json":
        return json.dumps({"project": project, "files": files}, indent=2)
    hot = project.get("hotspots", [])
    out = ["", f"  Health: {project['score']}/100 ({project['grade']})", f"  Complexity hotspots: {len(hot)}", f"  Maintainability: {project['maintainability_avg']} avg"]
    out += [f"  Files: {project['total_files']}  Functions: {project['total_functions']}  Lines: {project['total_lines']}", ""]
    if score_only:
        return "\n".join(out)
    for h in hot:
        out += [f"  ! {h['path']}  cc_max={h['cyclomatic_max']}  cog_max={h['cognitive_max']}  MI={h['maintainability_index']}", *(f"    -> {n}" for n in h["hotspot_functions"])]
    table = [["File", "LOC", "CC avg", "CC max", "Cog avg", "MI"]]
    for h in sorted(files, key=lambda h: (h["maintainability_index"], h["path"])):
        table.append([h["path"], str(h["lines_of_code"]), f"{h['cyclomatic_avg']:.1f}", str(h["cyclomatic_max"]), f"{h['cognitive_avg']:.1f}", f"{h['maintainability_index']:.1f}"])
    width = [max(len(r[k]) for r in table) for k in range(6)]
    return "\n".join([*out, *("  ".join([r[0].ljust(width[0]), *(c.rjust(w) for c, w in zip(r[1:], width[1:], strict=True))]) for r in table), ""])


def format_dupes(groups: list[dict], fmt: str = "human") -> str:
    if fmt == "json":
        return json.dumps(groups, indent=2)
    if not groups:
        return "\nNo duplicate code found.\n"
    out = ["", f"Found {len(groups)} duplicate group(s):", ""]
    for k, g in enumerate(groups, 1):
        out.append(f"  Group {k} — {g['token_count']} tokens, {g['line_count']} lines, {len(g['fragments'])} occurrences")
        out += [*(f"    {f['file']}:{f['start_line']}-{f['end_line']} ({f['lines_of_code']} lines)" for f in g["fragments"]), ""]
    return "\n".join(out)


# -------------------------------------------------------------------- baseline
def save_baseline(keys: list[str], path: str) -> int:
    """Write the distinct keys, sorted; returns how many."""
    own = sorted(set(keys))
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"version": 1, "findings": own}, f, indent=2)
    return len(own)


def load_baseline(path: str) -> set[str]:
    """The keys; none for a missing or broken file."""
    try:
        with open(path, encoding="utf-8") as f:
            data: Any = json.load(f)
    except (OSError, ValueError):
        return set()
    return set(data.get("findings") or ()) if isinstance(data, dict) else set()
