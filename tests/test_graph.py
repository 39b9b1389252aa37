"""Resolution, reachability and components."""

import random

import pytest
from lithic.operators import graph

A = "def used(): pass\ndef idle(): pass\n"


def pairs(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    from lithic.plans.engine import Engine
    from lithic.sources.config import load_config

    root = tmp_path_factory.mktemp("tree")
    files = {
        "main.py": "import lib\nfrom pkg import sub, helper\nimport os, requests\nimport pkg.deep.mod\nimport pkg.deep.gone\n",
        "lib.py": A,
        "pkg/__init__.py": "from . import rel\n",
        "pkg/sub.py": "from .rel import used\nfrom ..lib import idle\n",
        "pkg/rel.py": "from . import sub\n" + A,
        "pkg/deep/__init__.py": "",
        "pkg/deep/mod.py": "from ...lib import *\n",
        "src/inner/__init__.py": "",
        "src/inner/a.py": "from inner import b\nimport inner.b\n",
        "src/inner/b.py": "import inner.a as other\n",
        "island_a.py": "import island_b\n",
        "island_b.py": "import island_a\n",
        "test_it.py": "import tested\n",
        "tested.py": "import tested\n",
        "broken.py": "def (:",
        ".hidden/x.py": "import lib",
        "a/build/x.py": "import lib",
    }
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return Engine.of_tree(spark, load_config(root))


def test_discovery_leaves_out_hidden_ignored_and_broken(tree):
    paths = {r.path for r in tree.modules.collect()}
    assert "main.py" in paths and not {".hidden/x.py", "a/build/x.py", "broken.py"} & paths


def test_edges(tree):
    assert pairs(tree.edges) == {
        ("main.py", "lib.py"), ("main.py", "pkg/__init__.py"), ("main.py", "pkg/sub.py"), ("main.py", "pkg/deep/mod.py"), ("main.py", "pkg/deep/__init__.py"),
        ("pkg/__init__.py", "pkg/__init__.py"), ("pkg/__init__.py", "pkg/rel.py"), ("pkg/sub.py", "pkg/rel.py"), ("pkg/sub.py", "lib.py"),
        ("pkg/rel.py", "pkg/__init__.py"), ("pkg/rel.py", "pkg/sub.py"), ("pkg/deep/mod.py", "lib.py"),
        ("src/inner/a.py", "src/inner/__init__.py"), ("src/inner/a.py", "src/inner/b.py"), ("src/inner/b.py", "src/inner/a.py"),
        ("island_a.py", "island_b.py"), ("island_b.py", "island_a.py"), ("test_it.py", "tested.py"), ("tested.py", "tested.py"),
    }
    assert {r.path for r in tree.importers_of("lib.py").collect()} == {"main.py", "pkg/sub.py", "pkg/deep/mod.py"}
    assert {r.path for r in tree.imports_of("pkg/sub.py").collect()} == {"pkg/rel.py", "lib.py"}
    assert {r.name for r in tree.symbols_imported("main.py", "pkg/__init__.py").collect()} == {"sub", "helper"}
    assert {r.name for r in tree.symbols_imported("main.py", "pkg/deep/__init__.py").collect()} == {"gone"}


def test_externals(tree):
    assert {r.top_level for r in tree.all_external_imports().collect()} == {"os", "requests"}


def test_reachability(tree):
    assert {r.path for r in tree.unreachable.collect()} == {"island_a.py", "island_b.py", "src/inner/a.py", "src/inner/b.py"}
    entries = {r.path for r in tree.entry_points.collect()}
    assert "main.py" in entries and "lib.py" not in entries and "test_it.py" not in entries
    assert "tested.py" in {r.path for r in tree.reachable.collect()}


def test_cycles(tree):
    got = [r.modules for r in tree.cycles.collect()]
    assert ["island_a.py", "island_b.py"] in got and ["src/inner/a.py", "src/inner/b.py"] in got
    assert ["pkg/__init__.py", "pkg/rel.py", "pkg/sub.py"] in got and len(got) == 3
    by = {tuple(r.modules): {tuple(e) for e in r.edges} for r in tree.cycles.collect()}
    assert by[("island_a.py", "island_b.py")] == {("island_a.py", "island_b.py"), ("island_b.py", "island_a.py")}


def components(edges, nodes):
    reach = {n: {n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            new = reach[b] - reach[a]
            if new:
                reach[a] |= new
                changed = True
    return {frozenset(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    edges = sorted({(rng.randrange(24), rng.randrange(24)) for _ in range(34)})
    want = {c for c in components(edges, range(24)) if len(c) > 1}
    rows = graph.strong_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    got: dict = {}
    for r in rows:
        got.setdefault(r.component, set()).add(r.node)
    assert {frozenset(v) for v in got.values()} == want and all(k == min(v) for k, v in got.items())


def test_no_edges(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert graph.strong_components(none).count() == 0 and graph.weak_components(none).count() == 0
