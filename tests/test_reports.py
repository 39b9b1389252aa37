"""Reports, baselines, fixes, API, commands and requests."""

import io
import json

import pytest
from lithic import api, cli, rpc
from lithic.operators import fixes
from lithic.sources import reports as R

FINDINGS = [
    {"rule": "unused-imports", "severity": "error", "message": "'os' is unused", "file": "app.py", "line": 1, "col": 0, "suggestion": "drop it"},
    {"rule": "high-complexity", "severity": "warn", "message": "'f' is complex", "file": "core.py", "line": 10, "col": 0, "suggestion": None},
]


@pytest.fixture
def results():
    health = {"score": 75, "grade": "B", "total_files": 5, "total_functions": 9, "total_lines": 100, "maintainability_avg": 75.2, "hotspots": []}
    group = {"token_count": 60, "line_count": 7, "fragments": [{"file": "a.py", "start_line": 1, "end_line": 7, "lines_of_code": 7}, {"file": "b.py", "start_line": 3, "end_line": 9, "lines_of_code": 7}]}
    r = R.Results(findings=FINDINGS, cycles=[{"modules": ["a.py", "b.py"], "edges": []}], duplicates=[group], health=health, total_files_scanned=5)
    r.compute_totals()
    return r


def test_totals(results):
    assert (results.total_issues, results.errors, results.warnings) == (4, 1, 1)


def test_sarif(results):
    run = json.loads(R.format_results(results, "sarif"))["runs"][0]
    assert [x["ruleId"] for x in run["results"]] == ["unused-imports", "high-complexity", "circular-dependencies"]
    assert [x["level"] for x in run["results"]] == ["error", "warning", "error"] and [x["ruleIndex"] for x in run["results"]] == [0, 1, 2]
    assert run["results"][0]["fixes"] and "fixes" not in run["results"][1] and len(run["tool"]["driver"]["rules"]) == 3


def test_codeclimate(results):
    rows = json.loads(R.format_results(results, "codeclimate"))
    assert [r["categories"][0] for r in rows] == ["Clarity", "Complexity", "Complexity"] and [r["severity"] for r in rows] == ["critical", "minor", "critical"]
    assert len({r["fingerprint"] for r in rows}) == 3


def test_annotations_and_rows(spark, results):
    text = R.format_results(results, "github").splitlines()
    assert text[0] == "::error file=app.py,line=1::unused-imports: 'os' is unused" and text[1].startswith("::warning file=core.py,line=10")
    assert text[2].startswith("::error") and text[3].startswith("::warning file=a.py,line=1::duplicate-code: 60 tokens")
    rows = spark.createDataFrame([(f["rule"], f["severity"], f["message"], f["file"], f["line"]) for f in FINDINGS], "rule string, severity string, message string, file string, line int")
    assert [r.value for r in R.annotation_rows(rows).collect()] == text[:2]
    assert [r.value for r in R.compact_rows(rows).collect()] == R.format_results(results, "compact").splitlines()[:2]
    climate = {c["fingerprint"] for c in json.loads(R.format_results(results, "codeclimate"))}
    assert {r.fingerprint for r in R.climate_rows(rows).collect()} < climate


def test_write_rows(spark, results, tmp_path):
    rows = spark.createDataFrame([("unused-imports", "error", "m", "a.py", 1)], "rule string, severity string, message string, file string, line int")
    for fmt in ("json", "codeclimate", "github", "compact"):
        R.write_rows(rows, fmt, str(tmp_path / fmt))
        assert spark.read.text(str(tmp_path / fmt)).count() == 1
    with pytest.raises(ValueError, match="Unknown format"):
        R.write_rows(rows, "nope", str(tmp_path / "x"))


def test_texts(results):
    md = R.format_results(results, "markdown")
    assert "75/100 (B)" in md and "| ERROR | `unused-imports` | `app.py` | 1 |" in md and "a.py -> b.py -> a.py" in md and "1 error(s) and 1 warning(s) in 5 files." in md
    human = R.format_results(results, "human")
    assert "1 error and 1 warning in 5 files" in human and "<> a.py -> b.py -> a.py" in human
    assert "No issues found" in R.format_results(R.Results(), "human") and "No issues found" in R.format_results(R.Results(), "markdown")
    assert json.loads(R.format_results(results, "json"))["errors"] == 1
    with pytest.raises(ValueError, match="Unknown format"):
        R.format_results(results, "xml")
    assert "Group 1" in R.format_dupes(results.duplicates) and "No duplicate" in R.format_dupes([])


def test_baseline_file(tmp_path):
    path = str(tmp_path / "b.json")
    assert R.save_baseline(["b", "a", "b"], path) == 2 and R.load_baseline(path) == {"a", "b"}
    assert R.load_baseline(str(tmp_path / "none.json")) == set()
    (tmp_path / "bad.json").write_text("{")
    assert R.load_baseline(str(tmp_path / "bad.json")) == set()


@pytest.mark.parametrize(
    ("line", "name", "want"),
    [
        ("from a import b, c\n", "b", "from a import c\n"), ("from a import b\n", "b", ""), ("    from a import b as x, c\n", "b", "    from a import c\n"), ("import os\n", "os", ""),
        ("import a, b\n", "a", "import b\n"), ("import a.b, c\n", "a", "import c\n"), ("import a as b\n", "b", ""), ("from a import (b, c)\n", "c", "from a import b\n"), ("from a import (\n", "b", None),
        ("from a import bc\n", "b", None), ("x = 1\n", "x", None),
    ],
)
def test_line_edits(line, name, want):
    assert fixes.without_name(line, name) == want


PROJECT = '[project]\nname = "x"\ndependencies = [\n  "left-over>=1",\n  "plain",\n  "requests",\n]\n'


def test_fixes(project, tmp_path):
    e = project({"main.py": "import lib, os\nfrom json import dumps, loads\nprint(lib, loads)\nimport requests\nrequests.x\n", "lib.py": "x = 1\n", "a.py": "import b\nb.x\n", "b.py": "import a\na.x\n", "pyproject.toml": PROJECT})
    found = e.findings
    dry = fixes.apply_fixes(found, e.lines, tmp_path)
    assert dry.removed_imports == ["main.py: os", "main.py: dumps"] and dry.deleted_files == ["a.py", "b.py"] and sorted(dry.removed_deps) == ["left_over", "plain"]
    assert (tmp_path / "a.py").exists() and "import lib, os" in (tmp_path / "main.py").read_text() and dry.total == 6
    fixes.apply_fixes(found, e.lines, tmp_path, dry_run=False)
    assert (tmp_path / "main.py").read_text() == "import lib\nfrom json import loads\nprint(lib, loads)\nimport requests\nrequests.x\n"
    assert not (tmp_path / "a.py").exists() and (tmp_path / "pyproject.toml").read_text() == '[project]\nname = "x"\ndependencies = [\n  "requests",\n]\n'


def test_api_commands_and_requests(spark, project, tmp_path, capsys):
    project({"m.py": "import os\nimport n\ndef f(a):\n    if a:\n        return 1\n", "n.py": "import m\n"})
    out = api.detect_dead_code(tmp_path)
    assert out.errors >= 1 and out.total_files_scanned == 2 and out.health["grade"] == "A"
    assert api.detect_circular_dependencies(tmp_path)[0]["modules"] == ["m.py", "n.py"]
    assert api.compute_complexity(tmp_path)[0]["cyclomatic"] == 2 and api.compute_complexity(tmp_path, at_least=3) == []
    assert api.find_duplicates(tmp_path, mode="weak") == []
    assert cli.main(["check", str(tmp_path), "--format", "json", "--ci"]) == 1
    assert json.loads(capsys.readouterr().out)["errors"] == out.errors
    base = str(tmp_path / "base.json")
    assert cli.main(["audit", str(tmp_path), "--save-baseline", base, "-f", "json"]) == 0
    capsys.readouterr()
    assert cli.main(["audit", str(tmp_path), "--baseline", base, "-f", "json", "--ci"]) == 0
    assert json.loads(capsys.readouterr().out)["findings"] == []
    for argv in (["health", str(tmp_path)], ["dupes", str(tmp_path)], ["security", str(tmp_path)], ["fix", str(tmp_path)], ["health", str(tmp_path), "--score"]):
        assert cli.main(argv) == 0
    assert "Health:" in capsys.readouterr().out

    server = rpc.Server()
    ask = lambda method, **p: server.handle(dict(id=7, jsonrpc="2.0", params=p, method=method))
    assert len(ask("tools/list")["result"]["tools"]) == 6 and ask("initialize")["result"]["serverInfo"]["name"] == "lithic"
    assert ask("nope")["error"]["code"] == -32601 and ask("shutdown")["result"] is None
    tool = lambda name, **a: ask("tools/call", name=name, arguments=a)["result"]
    text = lambda r: json.loads(r["content"][0]["text"])
    assert text(tool("explain", rule="unused-imports"))["rule"] == "unused-imports" and "error" in text(tool("explain", rule="x"))
    assert text(tool("cycles", root=str(tmp_path)))[0]["modules"] == ["m.py", "n.py"] and tool("other")["isError"]
    assert text(tool("complexity", root=str(tmp_path), threshold=2))[0]["name"] == "f" and text(tool("health", root=str(tmp_path)))["grade"] == "A"
    assert text(tool("analyze", root=str(tmp_path)))["errors"] == out.errors
    sink = io.StringIO()
    server.run(["", "not json\n", '{"method": "tools/list", "id": 1}\n'], sink)
    assert len(sink.getvalue().splitlines()) == 2


def test_empty_project(project, tmp_path):
    e = project({})
    assert e.results().total_files_scanned == 0
