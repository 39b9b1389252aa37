"""Facts of one Python source text; runs inside the Arrow workers of the parse pass."""

from __future__ import annotations

import ast
import hashlib
import io
import keyword
import re
import tokenize
from collections.abc import Collection
from pathlib import PurePosixPath

_NOQA = re.compile(r"#\s*noqa(?P<codes>:\s*[a-z0-9, ]+)?", re.IGNORECASE)
_LOOPS = tuple(getattr(ast, n) for n in "AsyncFor For If While".split())
_DECISIONS = {*_LOOPS, ast.Assert, ast.ExceptHandler, ast.IfExp}
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
_METHODS = {"classmethod", "staticmethod", "property"}
_SILENT = {getattr(tokenize, n) for n in "COMMENT DEDENT ENCODING ENDMARKER INDENT NEWLINE NL".split()}
#: Names that the clone search treats as keywords, the soft ones among them.
KEYWORDS = frozenset(keyword.kwlist) | {"match", "case", "type"}


def noqa_lines(source: str) -> list[int]:
    """Lines whose noqa comment names no codes, or F401 among others."""
    out = []
    for number, line in enumerate(source.splitlines(), 1):
        found = _NOQA.search(line)
        if not found:
            continue
        codes = found["codes"]
        if codes is None or any(c.strip().upper() == "F401" for c in codes[1:].split(",")):
            out.append(number)
    return out


def leaf_name(node: ast.expr) -> str | None:
    """Last part of a decorator's name, calls looked through."""
    if isinstance(node, ast.Call):
        return leaf_name(node.func)
    if isinstance(node, ast.Attribute):
        return node.attr
    return node.id if isinstance(node, ast.Name) else None


def _decorators(node: ast.AST) -> list[str]:
    return [n for n in map(leaf_name, node.decorator_list) if n]


def dotted_name(call: ast.Call) -> str | None:
    """``a.b.c`` of a call; what hangs on no name keeps its attributes alone."""
    parts, node = [], call.func
    while isinstance(node, ast.Attribute):
        parts.insert(0, node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        parts.insert(0, node.id)
    return ".".join(parts) or None


#: Fields that hold no node that any fact depends on.
_PLAIN = {"ctx", "op", "ops", "type_comment", "type_ignores"}
_FIELDS: dict[type, tuple[str, ...]] = {}
_NESTING = {*_LOOPS, ast.ExceptHandler, ast.Match}


class _Walk:
    """What one breadth-first walk over a tree finds.

    ``functions`` are [node, whether its parent is a class, cyclomatic, cognitive, level]. A
    decision counts for every function around it: cyclomatic is 1 and one more for each,
    cognitive 1 + nesting below the function for those that break the flow.
    """

    def __init__(self, tree: ast.Module):
        self.functions: list[list] = []
        self.calls: list[ast.Call] = []
        self.names: set[str] = set()
        self.attributes: set[str] = set()
        # node, nesting, functions around it with the nesting of their own content, in a class
        level: list[tuple] = [(tree, 0, (), False)]
        down = 0
        while level:
            below: list[tuple] = []
            for node, depth, around, in_class in level:
                kind = type(node)
                flow = extra = nests = 0
                if kind is ast.Name:
                    if type(node.ctx) is ast.Load:
                        self.names.add(node.id)
                    continue
                if kind is ast.Constant:
                    continue
                if kind is ast.Attribute:
                    if type(node.ctx) is ast.Load:
                        self.attributes.add(node.attr)
                elif kind is ast.Call:
                    self.calls.append(node)
                elif kind is ast.FunctionDef or kind is ast.AsyncFunctionDef:
                    found = [node, in_class, 1, 0, down]
                    self.functions.append(found)
                    nests = 1
                elif kind is ast.BoolOp:
                    flow = extra = len(node.values) - 1
                elif kind is ast.comprehension:
                    flow = 1 + len(node.ifs)
                elif kind in _DECISIONS:
                    flow = 1
                    nests = kind in _NESTING
                elif kind is ast.Match:
                    flow, nests = len(node.cases) - 1, 1
                if around and (flow or kind in _NESTING):
                    for owner, base in around:
                        owner[2] += flow
                        owner[3] += extra + (1 + depth - base if kind in _NESTING else 0)
                inner = depth + nests
                if kind is ast.FunctionDef or kind is ast.AsyncFunctionDef:
                    around = (*around, (found, inner))
                fields = _FIELDS.get(kind)
                if fields is None:
                    fields = _FIELDS[kind] = tuple(f for f in kind._fields if f not in _PLAIN)
                owned = kind is ast.ClassDef
                for name in fields:
                    value = getattr(node, name, None)
                    if value.__class__ is list:
                        for child in value:
                            if isinstance(child, ast.AST):
                                below.append((child, inner, around, owned and name == "body"))
                    elif isinstance(value, ast.AST):
                        below.append((value, inner, around, False))
            level = below
            down += 1


def cyclomatic(root: ast.AST) -> int:
    """1 and one more for each decision below the function ``root``, nested functions included."""
    return _Walk(ast.Module([root], [])).functions[0][2]


def cognitive(root: ast.AST) -> int:
    """Sum of 1 + nesting over the flow-breaking nodes below the function ``root``."""
    return _Walk(ast.Module([root], [])).functions[0][3]


_BLOCKS = ("body", "handlers", "orelse", "finalbody", "cases")


def _imports(blocks: list, flags: dict[str, bool], out: list[dict]) -> list[dict]:
    """Imports in the order of the text, with the kinds of blocks that they are in.

    Only statements can hold imports, so expressions aren't looked into.
    """

    def add(node: ast.stmt, **fields: object) -> None:
        out.append(fields | flags | {"line": node.lineno, "col": node.col_offset})

    for node in blocks:
        inner = flags
        if isinstance(node, ast.Import):
            for a in node.names:
                top = a.name.partition(".")[0]
                add(node, module=a.name, names=[], bound_names=[a.asname or top], alias=a.asname, is_from_import=False, is_relative=False, level=0)
        elif isinstance(node, ast.ImportFrom):
            pairs = [(a.name, a.asname or a.name) for a in node.names]
            names, bound = [p[0] for p in pairs], [p[1] for p in pairs]
            add(node, module=node.module or "", names=names, bound_names=bound, alias=None, is_from_import=True, is_relative=bool(node.level), level=node.level or 0)
        elif isinstance(node, ast.If):
            test = node.test
            name = test.id if isinstance(test, ast.Name) else test.attr if isinstance(test, ast.Attribute) else ""
            inner = flags | {"is_type_checking" if name == "TYPE_CHECKING" else "is_conditional": True}
        elif isinstance(node, ast.Try):
            inner = flags | {"is_try_except": True}
        for block in _BLOCKS:
            if isinstance(below := getattr(node, block, None), list):
                _imports(below, inner, out)
    return out


def _names(targets: list[ast.expr]) -> list[str]:
    return [t.id for t in targets if isinstance(t, ast.Name)]


def _all_list(statements: list[ast.stmt]) -> list[str] | None:
    for node in statements:
        if isinstance(node, ast.Assign) and "__all__" in _names(node.targets) and isinstance(node.value, ast.List | ast.Tuple):
            return [e.value for e in node.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)]
    return None


def _exports(tree: ast.Module) -> list[dict]:
    out = []

    def add(name: str, kind: str, node: ast.stmt, decorators: list[str]) -> None:
        dunder = name.startswith("__")
        out.append({
            "name": name, "kind": kind, "line": node.lineno, "col": node.col_offset, "decorators": decorators,
            "is_dunder": dunder and name.endswith("__"), "is_private": name.startswith("_") and not dunder,
        })

    for node in tree.body:
        if isinstance(node, _DEFS):
            add(node.name, "function", node, _decorators(node))
        elif isinstance(node, ast.ClassDef):
            add(node.name, "class", node, _decorators(node))
        elif isinstance(node, ast.Assign | ast.AnnAssign):
            plain = isinstance(node, ast.Assign)
            for name in _names(node.targets if plain else [node.target]):
                if name[0] != "_":
                    add(name, "constant" if plain and name.isupper() else "variable", node, [])
    return out


def _functions(walk: _Walk) -> list[dict]:
    out = []
    for node, in_class, cyclo, cogni, _ in walk.functions:
        kind = "function"
        if in_class:
            kind = "method"
            for d in node.decorator_list:
                if isinstance(d, ast.Name) and d.id in _METHODS:
                    kind = d.id
        end = node.end_lineno or node.lineno
        args = node.args
        out.append({
            "name": node.name, "kind": kind, "line": node.lineno, "end_line": end, "cyclomatic": cyclo, "cognitive": cogni,
            "parameters": len(args.args) + len(args.posonlyargs) + len(args.kwonlyargs), "lines_of_code": end - node.lineno + 1,
        })
    return out


def _formats(arg: ast.expr) -> bool:
    if isinstance(arg, ast.Call):
        return (dotted_name(arg) or "").endswith(".format")
    return isinstance(arg, ast.JoinedStr) or isinstance(getattr(arg, "op", None), ast.Mod)


def _calls(walk: _Walk) -> list[dict]:
    out = []
    for node in walk.calls:
        if name := dotted_name(node):
            dynamic = any(not isinstance(a, ast.Constant) for a in node.args)
            out.append({"name": name, "line": node.lineno, "col": node.col_offset, "has_dynamic_arg": dynamic, "has_format_arg": any(map(_formats, node.args))})
    return out


def _global_names(tree: ast.Module) -> list[str]:
    """Public names that the module's own statements assign, as often as they do."""
    plain = [n for x in tree.body if isinstance(x, ast.Assign | ast.AnnAssign) for n in _names(x.targets if isinstance(x, ast.Assign) else [x.target])]
    return [n for n in plain if n[0] != "_"]


class Memo(dict):
    """What was made of source texts, by text; emptied beyond so many characters."""

    def __init__(self, most: int = 1 << 22):
        super().__init__()
        self.most, self.held = most, 0

    def keep(self, text: str | bytes, made: object) -> None:
        if self.held + len(text) > self.most:
            self.clear()
            self.held = 0
        self[text] = made
        self.held += len(text)


_DEF_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(?=\()")
#: Texts with these are parsed in one piece: other line ends, decorated definitions, a switch of the grammar.
_WHOLE = ("\r", "\f", "\0", "\n@", "barry_as_FLUFL")


def _block(source: str) -> list[tuple[int, dict]]:
    walk = _Walk(ast.parse(source))
    return list(zip([f[4] for f in walk.functions], _functions(walk), strict=True))


def block_functions(source: str, memo: Memo) -> list[dict] | None:
    """``_functions`` of a source, block by block; None where the blocks don't parse on their own.

    A block starts at each ``def`` without indent. Statements that parse on their own
    mean the same one after another, and but for its name nothing of a function depends
    on how it is called; so a body that was seen before isn't parsed again.
    """
    if source[:1] == "@" or any(x in source for x in _WHOLE):
        return None
    head, *parts = ("\n" + source).split("\ndef ")
    out, nested = [], False
    try:
        if head:
            out = _block(head[1:] + "\n")
            nested = any(level > 1 for level, _ in out)
        line = head.count("\n")
        for part in parts:
            if not (found := _DEF_NAME.match(part)) or keyword.iskeyword(name := found[0]) or name == "__debug__":
                return None
            body = part[len(name) :]
            if (made := memo.get(body)) is None:
                made = body.count("\n") + 1, _block(f"def f{body}\n")
                memo.keep(body, made)
            lines, rows = made
            for k, (level, row) in enumerate(rows):
                row = row | {"line": row["line"] + line, "end_line": row["end_line"] + line}
                if not k:
                    row["name"] = name
                nested |= level > 1
                out.append((level, row))
            line += lines
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    if nested:  # the walk goes level by level
        out.sort(key=lambda x: x[0])
    return [row for _, row in out]


#: Facts that ask for a walk over the whole tree.
_WALKED = {"functions", "calls", "referenced_names", "accessed_attributes"}
#: Facts of the path alone.
_OF_PATH = {
    "path": lambda path, name: path,
    "package": lambda path, name: re.sub(r"\.[^./]*$", "", path).replace("/", ".").removesuffix(".__init__"),
    "is_init": lambda path, name: name == "__init__.py",
    "is_main": lambda path, name: name == "__main__.py",
    "is_test": lambda path, name: name.startswith("test_") or name.endswith("_test.py"),
    "is_conftest": lambda path, name: name == "conftest.py",
}


def path_facts(path: str, wanted: Collection[str] | None = None) -> dict:
    """The fields of MODULES that follow from the path."""
    name = path.rpartition("/")[2]
    if name in ("", "."):
        name = PurePosixPath(path).name
    return {k: f(path, name) for k, f in _OF_PATH.items() if wanted is None or k in wanted}


def source_facts(source: str, wanted: Collection[str] | None = None, memo: Memo | None = None) -> dict | None:
    """The fields of MODULES that follow from the text; None where it doesn't parse."""
    if memo is not None and wanted is not None and set(wanted) - _OF_PATH.keys() <= {"functions", "line_count"}:
        found = block_functions(source, memo)
        if found is not None:
            facts = {"functions": lambda: found, "line_count": lambda: len(source.splitlines())}
            return {k: f() for k, f in facts.items() if k in wanted}
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    walk = _Walk(tree) if wanted is None or _WALKED & set(wanted) else None
    facts = {
        "imports": lambda: _imports(tree.body, dict.fromkeys(["is_type_checking", "is_conditional", "is_try_except"], False), []),
        "exports": lambda: _exports(tree),
        "functions": lambda: _functions(walk),
        "calls": lambda: _calls(walk),
        "all_list": lambda: _all_list(tree.body),
        "referenced_names": lambda: sorted(walk.names),
        "accessed_attributes": lambda: sorted(walk.attributes),
        "noqa_lines": lambda: noqa_lines(source),
        "line_count": lambda: len(source.splitlines()),
        "content_hash": lambda: hashlib.sha256(source.encode("utf-8", "replace")).hexdigest()[:16],
        "classes": lambda: [x.name for x in tree.body if isinstance(x, ast.ClassDef)],
        "global_variables": lambda: _global_names(tree),
        "docstring": lambda: ast.get_docstring(tree),
    }
    return {k: f() for k, f in facts.items() if wanted is None or k in wanted}


def module_facts(path: str, source: str, wanted: Collection[str] | None = None) -> dict | None:
    """The row of MODULES for one file, or its ``wanted`` fields; None where it doesn't parse."""
    found = source_facts(source, wanted)
    return None if found is None else path_facts(path, wanted) | found


def source_tokens(source: str) -> tuple[list[str], list[str], list[int]]:
    """Kinds, texts and lines of the tokens up to the first one that can't be read."""
    kinds, texts, lines = [], [], []
    try:
        for token in tokenize.generate_tokens(io.StringIO(source).readline):
            if token.type in _SILENT:
                continue
            kinds.append(tokenize.tok_name[token.type])
            texts.append(token.string)
            lines.append(token.start[0])
    except (tokenize.TokenError, SyntaxError, ValueError):
        pass
    return kinds, texts, lines
