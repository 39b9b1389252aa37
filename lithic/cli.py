"""Commands: check, health, dupes, fix, audit, security, serve."""

from __future__ import annotations

import argparse
import subprocess
import sys
from pathlib import Path

from . import __version__, api
from .operators import findings as F
from .operators.fixes import apply_fixes
from .plans.engine import Engine, changed_files
from .rpc import Server
from .sources.config import Config, load_config
from .sources.reports import FORMATS, Results, format_dupes, format_health, format_results, load_baseline, save_baseline


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lithic", description="Code and corpus analytics on Spark")
    top.add_argument("--version", action="version", version=f"lithic {__version__}")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, report: bool = True) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=text)
        p.add_argument("root", nargs="?", default=None)
        p.add_argument("--config")
        if report:
            p.add_argument("--format", "-f", default="human", choices=sorted(FORMATS))
            p.add_argument("--output", "-o")
            p.add_argument("--ci", action="store_true", help="exit with 1 if there are errors")
        return p

    command("check", "run every rule").add_argument("--preset", help="architecture preset")
    health = command("health", "score the project")
    health.add_argument("--score", action="store_true", help="the score alone")
    dupes = command("dupes", "find repeated code")
    dupes.add_argument("--mode", default="mild", choices=["mild", "semantic", "strict", "weak"])
    dupes.add_argument("--min-tokens", type=int, default=50)
    dupes.add_argument("--min-lines", type=int, default=5)
    fix = command("fix", "remove what is unused", report=False)
    fix.add_argument("--apply", action="store_true", help="change the files; else only list the changes")
    audit = command("audit", "report what is new")
    audit.add_argument("--changed-since", metavar="REF", help="only files changed since a git revision")
    audit.add_argument("--baseline", help="leave out the findings in this file")
    audit.add_argument("--save-baseline", help="store the findings in this file")
    security = command("security", "secrets and dangerous calls")
    security.add_argument("--no-taint", action="store_true")
    sub.add_parser("serve", help="answer JSON-RPC requests on standard input")
    return top


def _emit(text: str, output: str | None) -> None:
    if output:
        Path(output).write_text(text, encoding="utf-8")
    else:
        sys.stdout.write(text if text.endswith("\n") else text + "\n")


def _report(results: Results, args: argparse.Namespace) -> int:
    _emit(format_results(results, args.format), args.output)
    return int(args.ci and results.errors > 0)


def _changed(root: Path, ref: str) -> list[str]:
    got = subprocess.run(["git", "-C", str(root), "diff", "--name-only", "--relative", ref, "--", "*.py"], capture_output=True, text=True, check=True)
    return got.stdout.split("\n")


def _audit(engine: Engine, args: argparse.Namespace) -> int:
    found = engine.findings
    if args.save_baseline:
        save_baseline([r["key"] for r in F.baseline_keys(found).collect()], args.save_baseline)
    if args.changed_since:
        found = changed_files(found, [f for f in _changed(engine.config.root, args.changed_since) if f])
    if args.baseline and (keys := load_baseline(args.baseline)):
        found = F.new_findings(found, engine.spark.createDataFrame([(k,) for k in sorted(keys)], "key string"))
    engine.findings = found
    return _report(engine.results(), args)


def run(args: argparse.Namespace) -> int:
    if args.command == "serve":
        Server().run()
        return 0
    overrides: dict = {}
    if args.command == "dupes":
        overrides["duplicates"] = {"mode": args.mode, "min_tokens": args.min_tokens, "min_lines": args.min_lines}
    if args.command == "check" and args.preset:
        overrides["boundaries"] = {"preset": args.preset}
    config: Config = load_config(args.root, args.config, overrides)
    if args.command == "security" and not args.no_taint and config.rules.severity_for("taint-sink") == "off":
        config.rules.overrides["taint-sink"] = "warn"
    engine = Engine.of_tree(api.session(), config)
    if args.command == "check":
        return _report(engine.results(), args)
    if args.command == "audit":
        return _audit(engine, args)
    if args.command == "security":
        rows = [r.asDict(recursive=True) for r in F.sorted_findings(engine.security_findings()).collect()]
        results = Results(findings=rows, total_files_scanned=engine.modules.count())
        results.compute_totals()
        return _report(results, args)
    if args.command == "health":
        files = [] if args.score else [r.asDict() for r in engine.file_health.orderBy("path").collect()]
        _emit(format_health(engine.health_row(), files, args.format, args.score), args.output)
        return 0
    if args.command == "dupes":
        _emit(format_dupes([r.asDict(recursive=True) for r in api.sorted_groups(engine.clones).collect()], args.format), args.output)
        return 0
    done = apply_fixes(engine.findings, engine.lines, config.root, dry_run=not args.apply)
    word = "Removed" if args.apply else "Would remove"
    shown = [*(f"  import {x}" for x in done.removed_imports[:10]), *(["  ..."] if len(done.removed_imports) > 10 else [])]
    shown += [*(f"  file {x}" for x in done.deleted_files), *(f"  dependency {x}" for x in done.removed_deps)]
    _emit("\n".join([f"{word} {done.total} thing(s)", *shown]), None)
    return 0


def main(argv: list[str] | None = None) -> int:
    return run(_parser().parse_args(argv))


if __name__ == "__main__":
    sys.exit(main())
