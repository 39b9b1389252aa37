"""Facts of one source text."""

import textwrap

from hypothesis import given
from hypothesis import strategies as st
from lithic.functions.python_source import module_facts, noqa_lines, source_tokens


def facts(source, path="pkg/mod.py"):
    return module_facts(path, textwrap.dedent(source))


def test_imports_and_what_they_bind():
    f = facts("""
        import a.b.c
        import numpy as np
        from ..up import x as y, z
        from . import sib
        def late():
            import json
        """)
    got = [(i["module"], i["bound_names"], i["level"], i["is_relative"]) for i in f["imports"]]
    assert got == [("a.b.c", ["a"], 0, False), ("numpy", ["np"], 0, False), ("up", ["y", "z"], 2, True), ("", ["sib"], 1, True), ("json", ["json"], 0, False)]


def test_blocks_around_imports():
    f = facts("""
        from typing import TYPE_CHECKING
        import typing
        if TYPE_CHECKING:
            import a
        elif x:
            import b
        if typing.TYPE_CHECKING:
            import c
        if y:
            import d
        try:
            import e
        except ImportError:
            e = None
        """)
    by = {i["module"]: i for i in f["imports"]}
    assert [by[m]["is_type_checking"] for m in "abcde"] == [True, True, True, False, False]
    assert by["b"]["is_conditional"] and by["d"]["is_conditional"] and by["e"]["is_try_except"]


def test_exports():
    f = facts("""
        LIMIT = 3
        logger = 1
        _hidden = 2
        typed: int = 4
        a, b = 1, 2
        @app.command("x")
        @register
        def run(): pass
        class Foo: pass
        def _private(): pass
        __version__ = "1"
        if x:
            def inside(): pass
        """)
    got = {e["name"]: e for e in f["exports"]}
    assert {n: e["kind"] for n, e in got.items()} == {
        "LIMIT": "constant", "logger": "variable", "typed": "variable", "run": "function", "Foo": "class", "_private": "function",
    }
    assert got["run"]["decorators"] == ["command", "register"] and got["_private"]["is_private"]


def test_all_list_null_and_empty():
    assert facts("x = 1")["all_list"] is None
    assert facts("__all__ = []")["all_list"] == []
    assert facts("__all__ = ('a', 'b', 1)")["all_list"] == ["a", "b"]


def test_complexity_numbers():
    f = facts("""
        def simple():
            return "no branch"
        def complex_fn(items, left):
            if items:
                for item in items:
                    if item.ready:
                        go(item)
                    elif item.late:
                        pass
                while left:
                    left -= 1
            return left
        def logic(a, b, c, *args, d=1, **kw):
            assert a and b and c
            return [i for i in a if i] if b else None
        async def waits(q):
            async with q:
                async for x in q:
                    match x:
                        case 1: pass
                        case 2: pass
                        case _: pass
            try:
                pass
            except ValueError:
                pass
        """)
    got = {x["name"]: x for x in f["functions"]}
    assert got["simple"]["cyclomatic"] == 1 and got["simple"]["cognitive"] == 0
    assert got["complex_fn"]["cyclomatic"] == 6
    assert got["complex_fn"]["cognitive"] == 1 + 2 + 3 + 4 + 2
    assert got["logic"]["cyclomatic"] == 1 + 1 + 2 + 1 + 2 and got["logic"]["cognitive"] == 2
    assert got["logic"]["parameters"] == 4
    assert got["waits"]["cyclomatic"] == 1 + 1 + 2 + 1 and got["waits"]["cognitive"] == 1 + 2 + 1
    assert got["simple"]["lines_of_code"] == 2


def test_function_kinds():
    f = facts("""
        class A:
            def m(self): pass
            @classmethod
            def c(cls): pass
            @staticmethod
            def s(): pass
            @property
            def p(self): pass
        def f():
            def nested(): pass
        """)
    assert {x["name"]: x["kind"] for x in f["functions"]} == {"m": "method", "c": "classmethod", "s": "staticmethod", "p": "property", "f": "function", "nested": "function"}


def test_file_flags_and_counts():
    f = facts("x = 1\fy = 2\n", "a/__init__.py") or module_facts("a/__init__.py", "x = 1\n\n")
    assert f["is_init"] and f["package"] == "a"
    assert module_facts("a/test_x.py", "")["is_test"] and module_facts("a/x_test.py", "")["is_test"]
    assert not module_facts("tests/x.py", "")["is_test"]
    assert module_facts("conftest.py", "")["is_conftest"] and module_facts("m/__main__.py", "")["is_main"]
    assert module_facts("x.py", "def broken(:") is None
    assert module_facts("x.py", "a = 1\n")["content_hash"] == "e1e7b4c8b6b8f0d3" or len(module_facts("x.py", "a = 1\n")["content_hash"]) == 16


def test_noqa():
    text = "a  # noqa\nb  # NOQA: E501\nc  # noqa: E501, F401\nd  # noqa: F401  (why)\ne  # noqa: F401 see docs\nf\n"
    assert noqa_lines(text) == [1, 3, 4]


def test_calls():
    f = facts("""
        eval(x)
        eval("1")
        os.path.join(a)
        get()(x)
        make().run(f"{x}")
        cur.execute("select %s" % x)
        cur.execute(q.format(x))
        cur.execute("a" + x)
        """)
    got = {(c["name"], c["line"]): (c["has_dynamic_arg"], c["has_format_arg"]) for c in f["calls"]}
    assert got[("eval", 2)] == (True, False) and got[("eval", 3)] == (False, False)
    assert got[("run", 6)] == (True, True)
    assert got[("cur.execute", 7)] == (True, True) and got[("cur.execute", 8)] == (True, True) and got[("cur.execute", 9)] == (True, False)


def test_tokens():
    kinds, texts, lines = source_tokens("x = 1 + 2  # c\n")
    assert texts == ["x", "=", "1", "+", "2"] and kinds == ["NAME", "OP", "NUMBER", "OP", "NUMBER"] and lines == [1] * 5
    assert source_tokens("if x:\n        a\n    b\n")[1][:3] == ["if", "x", ":"]


@given(st.text(max_size=200))
def test_any_text_is_handled(text):
    module_facts("x.py", text)
    source_tokens(text)
    noqa_lines(text)
