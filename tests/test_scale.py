"""Steps whose work must not grow faster than their input, or be done twice."""

import ast

import pytest
from lithic.functions import python_source as P

WANTED = {"path", "functions", "line_count"}
BODY = "(a, b):\n    if a and b:\n        for x in b:\n            return [y for y in x if y]\n"
SOURCES = {
    "plain": "import os\n" + "".join(f"def f_{k}{BODY}" for k in range(50)),
    "starts with def": "def a(): pass\ndef b(): pass",
    "nested, async and class between": "class A:\n    def m(self):\n        def inner(): pass\ndef f():\n    def g():\n        if 1: pass\nasync def h(): pass\nclass B:\n    @property\n    def p(self): pass\ndef g(x, /, y, *, z): return x if y else z\n",
    "def inside a string": 'def a():\n    """\ndef b(): pass\n"""\ndef c(): pass\n',
    "def inside a bracketed string": 'x = ["""\ndef b(\n""", 1]\ndef c(): pass\n',
    "decorated": "@x\ndef a(): pass\ny = 1\n@z\ndef b(): pass\n",
    "continued": "x = 1 + \\\n\ndef a(): pass\n",
    "other line ends": "x = 1\r\ndef a():\r\n    pass\r\ndef b():\n    pass\n",
    "keyword": "def a(): pass\ndef class(): pass\n",
    "blank and comment": "\n\n# c\n\ndef a(): pass\n\n\n# d\n\ndef b():\n    pass\n\n\n",
    "type parameters, odd names": "def a[T](x: T): pass\ndef é(): pass\ndef a  (x): pass\n",
    "broken": "def a(): pass\ndef b(:\n",
    "empty": "",
}


@pytest.mark.parametrize("name", SOURCES)
def test_functions_by_blocks_are_those_of_the_whole(name):
    text = SOURCES[name]
    memo = P.Memo()
    for _ in range(2):
        assert P.source_facts(text, WANTED, memo) == P.source_facts(text, WANTED)


def test_a_body_is_parsed_once(monkeypatch):
    texts, parse = [], ast.parse
    monkeypatch.setattr(ast, "parse", lambda source, *a, **k: texts.append(source) or parse(source, *a, **k))
    memo = P.Memo()
    rows = P.source_facts(SOURCES["plain"], WANTED, memo)["functions"]
    P.source_facts(SOURCES["plain"].replace("f_", "g_"), WANTED, memo)
    assert [r["name"] for r in rows] == [f"f_{k}" for k in range(50)] and [r["line"] for r in rows] == [2 + 4 * k for k in range(50)]
    assert sum(map(len, texts)) < 300


def test_memo_is_bounded():
    memo = P.Memo(100)
    for k in range(1000):
        memo.keep(f"{k:010d}", k)
    assert len(memo) <= 10 and memo["0000000999"] == 999


def test_equal_texts_are_parsed_once(spark, tmp_path):
    """Each parse costs a quarter of a second here, so a parse for each file would take minutes."""
    import time

    from lithic.operators import facts

    text = "".join(f"x{k} = {k}\n" for k in range(20_000))
    rows = spark.range(1000).selectExpr("concat('m/f', id, '.py') AS path", f"encode(if(id % 100 = 7, 'def (', '{text}'), 'UTF-8') AS content").repartition(4)
    began = time.time()
    out = facts.modules(rows, ["path", "package", "line_count", "is_test"])
    got = {tuple(r) for r in out.select("path", "package", "line_count", "is_test").collect()}
    assert got == {(f"m/f{k}.py", f"m.f{k}", 20_000, False) for k in range(1000) if k % 100 != 7}
    assert time.time() - began < 60


def moved(spark, run):
    """What ``run`` returns, and the bytes that it shuffles."""

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    before = total()
    return run(), total() - before


def test_windows_are_shuffled_in_few_bytes(spark):
    import random

    from lithic.operators import clones

    rng = random.Random(1)
    rows = spark.createDataFrame([(k, [f"w{rng.randrange(10**6)}" for _ in range(200)]) for k in range(2000)], "path long, values array<string>").repartition(2)
    rows = rows.union(rows.where("path < 10").selectExpr("path + 5000", "values"))
    rows.write.mode("overwrite").parquet(place := f"{spark.conf.get('spark.checkpoint.dir')}/scale-windows")
    rows = spark.read.parquet(place)
    for f in (clones.window_counts, clones.repeated_windows):
        found, size = moved(spark, lambda f=f: f(rows, 8).count())
        assert found == 10 * 193 and size < 25 * 2010 * 193


ODD_WORDS = [(1, "a b a b a b a b a b".split()), (2, "a b a b c d e f".split()), (2, "x a b a b".split()), (3, []), (4, None), (5, ["a"]), (None, "q r s t".split()), (6, "q r s t".split()), (7, ["é", "", " ", "é"] * 3)]


@pytest.mark.parametrize("buckets", [1 << 21, 1])
def test_windows_against_brute_force(spark, monkeypatch, buckets):
    from lithic.operators import clones

    monkeypatch.setattr(clones, "BUCKET_BYTES", buckets)
    rows = spark.createDataFrame(ODD_WORDS, "path long, values array<string>").repartition(3)
    wins = {}
    for path, words in ODD_WORDS:
        for k in range(len(words or []) - 3):
            wins.setdefault(tuple(words[k : k + 4]), []).append((path is None, path or 0, k))
    counts, places = set(), set()
    for found in wins.values():
        found.sort()
        if len(found) > 1:
            counts.add((None if found[0][0] else found[0][1], found[0][2], len(found), len({p for none, p, _ in found if not none})))
        kept = []
        for none, p, k in found:
            if not kept or kept[-1][:2] != (none, p) or k - kept[-1][2] >= 4:
                kept.append((none, p, k))
        if len(kept) > 1:
            places.add(tuple((None if none else p, k) for none, p, k in kept))
    assert {tuple(r) for r in clones.window_counts(rows, 4).collect()} == counts
    assert {tuple((p.path, p.pos) for p in r.positions) for r in clones.repeated_windows(rows, 4).collect()} == places


def test_claiming_is_linear_in_the_places():
    """A block that 60,000 files share; each against all others would take hours."""
    import time

    import pyarrow as pa
    from lithic.operators import clones

    n = 60_000
    places = [[{"path": f"f{k:06d}", "pos": shift, "start": 2 + shift, "end": 8} for k in range(n)] for shift in range(3)]
    began = time.time()
    out = clones._claimer(2, 2)(pa.table({"length": pa.array([40, 39, 38], pa.int32()), "places": places})).to_pylist()
    assert len(out) == 1 and out[0]["token_count"] == 40 and out[0]["line_count"] == 7 and len(out[0]["fragments"]) == n
    assert out[0]["fragments"][5] == {"file": "f000005", "start_line": 2, "end_line": 8, "lines_of_code": 7}
    assert time.time() - began < 30


def test_lines_of_a_corpus_in_one_piece_are_spread(spark):
    from lithic.operators import facts

    rows = spark.createDataFrame([(f"m/f{k}.py", b"import os\nx = 1\n") for k in range(64)], "path string, content binary")
    rows.coalesce(1).write.mode("overwrite").parquet(place := f"{spark.conf.get('spark.checkpoint.dir')}/scale-lines")
    lines = facts.source_lines(spark.read.parquet(place))
    assert lines.rdd.getNumPartitions() > 1 and lines.count() == 192
