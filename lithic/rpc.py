"""JSON-RPC over standard input and output: one request a line, six tools."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterable
from dataclasses import asdict
from typing import Any, TextIO

from . import __version__, api
from .sources.reports import format_results

ENVELOPE = {"jsonrpc": "2.0"}
PROTOCOL = "2024-11-05"
EXPLANATIONS = {
    "boundary-violation": "Architecture zones and what each may import; an import of another zone is reported.",
    "circular-dependencies": "Groups of modules that import each other, found as strongly connected components.",
    "duplicate-code": "Repeated runs of tokens; the mode says how much of names, literals and operators has to agree.",
    "hardcoded-secret": "Keys, tokens, passwords and private keys written in source lines.",
    "high-complexity": "Functions above 20 in cyclomatic or 15 in cognitive complexity, unless configured otherwise.",
    "taint-sink": "Calls of eval, exec, shells and the like with computed arguments, and SQL put together by formatting.",
    "unlisted-dependencies": "Packages that are imported but neither declared in pyproject.toml nor part of Python.",
    "unused-classes": "Top-level classes that no other module imports and their own doesn't use.",
    "unused-dependencies": "Packages that pyproject.toml declares and no module imports.",
    "unused-files": "Files that neither an entry point nor a test leads to.",
    "unused-functions": "Top-level functions that no other module imports and their own doesn't use.",
    "unused-imports": "Imported names that a module doesn't use; type-checking blocks and packages' re-exports are left out.",
    "unused-variables": "Top-level variables that no other module imports and their own doesn't use.",
}


def _schema(required: list[str] = (), **fields: dict) -> dict:
    out = {"type": "object", "properties": {k: {"type": "string"} | v for k, v in fields.items()}}
    return out | ({"required": list(required)} if required else {})


_ROOT = {"description": "Folder of the project"}
_MODES = {"enum": sorted(["mild", "semantic", "strict", "weak"]), "default": "mild"}
_FORMATS = {"enum": ["codeclimate", "json", "markdown", "sarif"], "default": "json"}
TOOLS: dict[str, tuple[str, dict]] = {
    "analyze": ("Analyse a project in full", _schema(root=_ROOT, format=_FORMATS)),
    "complexity": ("Complexity of every function", _schema(root=_ROOT, threshold={"type": "integer", "default": 1})),
    "cycles": ("Circular imports", _schema(root=_ROOT)),
    "duplicates": ("Repeated code", _schema(root=_ROOT, mode=_MODES)),
    "explain": ("What a rule looks for", _schema(["rule"], rule={"description": "Name of the rule"})),
    "health": ("Score and grade of a project", _schema(root=_ROOT)),
}


def _explain(rule: str) -> dict:
    return {"rule": rule} | ({"explanation": EXPLANATIONS[rule]} if rule in EXPLANATIONS else {"error": f"Unknown rule: {rule}"})


def _analyze(root: str | None, fmt: str) -> Any:
    results = api.detect_dead_code(root)
    return asdict(results) if fmt == "json" else format_results(results, fmt)


_RUN: dict[str, Callable[[dict], Any]] = {
    "analyze": lambda a: _analyze(a.get("root"), a.get("format", "json")),
    "complexity": lambda a: api.compute_complexity(a.get("root"), at_least=a.get("threshold", 1)),
    "cycles": lambda a: api.detect_circular_dependencies(a.get("root")),
    "duplicates": lambda a: api.find_duplicates(a.get("root"), mode=a.get("mode", "mild")),
    "explain": lambda a: _explain(a.get("rule", "")),
    "health": lambda a: api.compute_health(a.get("root")),
}


def call_tool(name: str, arguments: dict) -> Any:
    if name not in _RUN:
        raise ValueError(f"Unknown tool: {name}")
    return _RUN[name](arguments)


def _parsed(line: str) -> Any:
    try:
        return json.loads(line)
    except ValueError:
        return None


class Server:
    """Answers requests; there is no state between them."""

    def hello(self) -> dict:
        return dict(protocolVersion=PROTOCOL, capabilities={"tools": {}}, serverInfo={"name": "lithic", "version": __version__})

    def _call(self, params: dict) -> dict:
        try:
            text, failed = json.dumps(call_tool(params.get("name", ""), params.get("arguments", {})), indent=2), {}
        except Exception as e:  # whatever a tool runs into is the caller's answer
            text, failed = f"Error: {e}", {"isError": True}
        return dict(content=[dict(type="text", text=text)]) | failed

    def handle(self, request: dict) -> dict:
        methods: dict[str, Callable[[], Any]] = {
            "initialize": self.hello,
            "shutdown": lambda: None,
            "tools/call": lambda: self._call(request.get("params", {})),
            "tools/list": lambda: {"tools": [{"name": n, "description": d, "inputSchema": s} for n, (d, s) in TOOLS.items()]},
        }
        head = ENVELOPE | {"id": request.get("id")}
        method = request.get("method", "")
        if method not in methods:
            return head | {"error": {"code": -32601, "message": f"Method not found: {method}"}}
        return head | {"result": methods[method]()}

    def run(self, lines: Iterable[str] | None = None, out: TextIO | None = None) -> None:
        """Serve ``lines``; blank and malformed ones are passed over."""
        out = out or sys.stdout
        print(json.dumps(ENVELOPE | {"id": 0, "result": self.hello()}), file=out, flush=True)
        for line in sys.stdin if lines is None else lines:
            if isinstance(request := _parsed(line), dict):
                print(json.dumps(self.handle(request)), file=out, flush=True)
