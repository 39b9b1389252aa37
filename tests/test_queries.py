"""The entry points, with and without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from lithic.plans import queries as Q

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", ["secret_lines", "repeated_lines", "high_complexity", "unused_deps", "parsed_unused_imports", "resolved_symbols", "code_climate", "sarif_rule_index"])
def test_query_equals_its_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, DATA)
    want = duck.sql(Q.SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    order = [want.columns.index(c) for c in cols]
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(r[k] for k in order) for r in want.fetchall())


def test_every_sql_has_a_query():
    assert set(Q.SQL) <= set(Q.QUERIES)


def test_imports_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py",):
        (tmp_path / name).write_text((ROOT / name).read_text())
    (tmp_path / "lithic").mkdir()
    for p in (ROOT / "lithic").rglob("*.py"):
        to = tmp_path / p.relative_to(ROOT)
        if "llm" not in to.relative_to(tmp_path).parts:
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(p.read_text())
    code = "import __spark_entry__ as e; assert set(e.queries()) >= set(e.oracle_sql()) and not [q for q in e.queries() if q.startswith('op')]; import lithic.api, lithic.cli"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
