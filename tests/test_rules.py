"""Rules from source text to finding."""

from lithic.operators import findings as O
from lithic.operators import rules
from lithic.sources.config import Boundaries, Zone, ZoneRule


def said(df):
    return sorted((r.file, r.line, r.message) for r in df.collect())


def test_unused_imports(project):
    e = project({
        "m.py": "import email.utils\nimport os.path as p\nimport sys\nfrom __future__ import annotations\nfrom a import b as c, d\nfrom x import *\nfrom k import kept  # noqa: F401\n__all__ = ['d']\nprint(sys.argv)\n",
        "pkg/__init__.py": "from z import w\n",
        "test_m.py": "import json\n",
    })
    assert said(rules.unused_imports(e.modules, "error")) == [
        ("m.py", 1, "'email' (import email.utils) is unused"), ("m.py", 2, "'p' (import os.path) is unused"), ("m.py", 5, "'b' imported from 'a' is unused"),
        ("test_m.py", 1, "'json' (import json) is unused"),
    ]


def test_unused_exports(project):
    mod = (
        "import logging\nlogger = logging.getLogger()\nspare = 1\nclass Used: pass\nclass Idle: pass\n@app.command()\ndef cmd(): logger.info('x')\n"
        "def by_attribute(): pass\ndef orphan_thing(): pass\ndef used_thing(): pass\ndef _private(): pass\n"
    )
    e = project({"mod.py": mod, "entry.py": "from mod import used_thing, Used\nimport mod\nmod.by_attribute()\n", "alone.py": "def nobody(): pass\n", "listed.py": "__all__ = ['a']\ndef a(): pass\ndef b(): pass\n", "user.py": "import listed\n"})
    severities = {"unused-functions": "error", "unused-classes": "error", "unused-variables": "warn"}
    rows = rules.unused_exports(e.modules, e.edges, e.symbols, severities).collect()
    assert {(r.file, r.rule, r.fix.target, r.severity) for r in rows} == {
        ("mod.py", "unused-functions", "orphan_thing", "error"), ("mod.py", "unused-classes", "Idle", "error"), ("mod.py", "unused-variables", "spare", "warn"),
        ("listed.py", "unused-functions", "a", "error"),
    }
    assert not any(r.fix.auto_fixable for r in rows)
    off = rules.unused_exports(e.modules, e.edges, e.symbols, severities | {"unused-functions": "off"})
    assert {r.rule for r in off.collect()} == {"unused-classes", "unused-variables"}


PYPROJECT = '[project]\nname = "x"\ndependencies = [\n  "PyJWT>=2",\n  "left-over",\n  "requests[socks]>=2; python_version>\'3\'",\n]\n[project.optional-dependencies]\ndev = ["pytest"]\n'


def test_dependencies(project):
    e = project({"m.py": "import jwt, requests, numpy, os, _private, pytest\n", "pyproject.toml": PYPROJECT})
    found = e.all_findings()
    assert said(found.where("rule = 'unused-dependencies'")) == [("pyproject.toml", 1, "Dependency 'left_over' is declared but never imported")]
    assert said(found.where("rule = 'unlisted-dependencies'")) == [("pyproject.toml", 1, "'numpy' is imported but not declared in pyproject.toml")]


def test_no_pyproject_no_dependency_findings(project):
    e = project({"m.py": "import numpy\n"})
    assert e.all_findings().where("rule like '%dependencies' and rule <> 'circular-dependencies'").count() == 0


def test_unused_files_and_cycles(project):
    e = project({"main.py": "import lib\n", "lib.py": "x = 1\n", "a.py": "import b\n", "b.py": "import a\n"})
    found = e.all_findings()
    assert [m[0] for m in said(found.where("rule = 'unused-files'"))] == ["a.py", "b.py"]
    assert said(found.where("rule = 'circular-dependencies'")) == [("a.py", 1, "Circular import: a.py → b.py → a.py")]


def test_boundaries(spark):
    edges = spark.createDataFrame([("app/models/m.py", "app/views/v.py"), ("app/views/v.py", "app/services/s.py"), ("app/views/a.py", "app/views/b.py"), ("x.py", "app/db/y.py")], "src string, dst string")
    layered = Boundaries(preset="layered")
    rows = rules.boundary_violations(edges, layered, "error").collect()
    assert [(r.file, r.metadata["source_zone"], r.metadata["target_zone"]) for r in rows] == [("app/models/m.py", "data", "presentation")]
    assert rows[0].suggestion.endswith("nothing")
    own = Boundaries("layered", [Zone("a", ["app/models/*"]), Zone("b", ["**/views/**"])], [ZoneRule("b", ["a"]), ZoneRule("b", [])])
    assert {z.name for z in rules.effective_boundaries(own).zones} == {"a", "b"}
    assert rules.boundary_violations(edges, Boundaries(), "error").count() == 0


def test_all_entries(project):
    e = project({"m.py": "__all__ = ['a', 'gone']\ndef a(): pass\n"})
    assert [r.message for r in rules.undefined_all_entries(e.modules, "warn").collect()] == ["'gone' is in __all__ but not defined in the module"]


def test_baseline_totals_and_order(spark, project):
    e = project({"m.py": "import a, b\n", "n.py": "import c\n"})
    found = rules.unused_imports(e.modules, "error")
    keys = O.baseline_keys(found.where("file = 'm.py'"))
    assert keys.count() == 2 and [r.file for r in O.new_findings(found, keys).collect()] == ["n.py"]
    assert [r.message[1] for r in O.sorted_findings(found).collect()] == ["a", "b", "c"]
    none = spark.range(0)
    assert O.totals(found, spark.range(2), none).first().asDict() == {"total_issues": 5, "errors": 3, "warnings": 0}
    assert O.rule_index(found).first().asDict() == {"rule": "unused-imports", "rule_index": 0}


def test_plugin_suppression(project):
    text = '[project]\ndependencies = ["Django>=4"]\n'
    e = project({"app/migrations/0001.py": "import os\n", "app/x.py": "import os\n", "pyproject.toml": text}, {"ignore_patterns": []})
    assert list(e.plugins.plugins) == ["django"]
    assert [r.file for r in e.findings.where("rule = 'unused-imports'").collect()] == ["app/x.py"]
