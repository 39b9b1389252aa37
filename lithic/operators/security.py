"""Hard-coded secrets and calls of dangerous functions.

The secret patterns are this library's own. All of it is column expressions over
lines and calls, so the scan needs neither Python nor a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .findings import finding

#: (what it is, pattern); the first that matches names the finding.
SECRETS = [
    ("AWS access key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("GitHub token", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{50,})"),
    ("Private key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("JSON Web Token", r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    ("Slack token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    ("API key", r"""(?i)\bapi[_-]?key\b["']?\s*[:=]\s*["'][A-Za-z0-9_-]{16,}["']"""),
    ("Generic secret", r"""(?i)\b[a-z_]*(?:password|passwd|pwd|secret|token)[a-z_]*["']?\s*[:=]\s*["'][^"'\s]{8,}["']"""),
]
COMMENT = r"^\s*#"
SAFE = r"os\.environ|os\.getenv|\bgetenv\(|\bconfig(?:\.|\[|\.get\()|\bsettings\.|(?i:changeme|placeholder|your[_-]|<[a-z_ -]+>|\$\{|\{\{|x{6,})"

SINKS = sorted("__import__ compile eval exec marshal.loads os.popen os.system pickle.loads shelve.open subprocess.Popen subprocess.call subprocess.run yaml.load yaml.unsafe_load".split())
SQL_SINKS = ["execute", "executemany", "extra", "raw"]


def secret_kind(text: Column) -> Column:
    """What a line gives away; NULL for nothing."""
    return reduce(lambda out, p: F.when(text.rlike(p[1]), F.lit(p[0])).otherwise(out), reversed(SECRETS), F.lit(None).cast("string"))


def secret_lines(lines: DataFrame) -> DataFrame:
    """``lines`` (text and others) with ``kind``, those that hold a secret."""
    rows = lines.where(~F.col("text").rlike(COMMENT) & ~F.col("text").rlike(SAFE))
    return rows.withColumn("kind", secret_kind(F.col("text"))).where("kind is not null")


def hardcoded_secrets(lines: DataFrame, mods: DataFrame, severity: str) -> DataFrame:
    """Findings of the lines (path, line, text) of modules that aren't tests."""
    rows = secret_lines(lines).join(mods.where("not is_test and not is_conftest").select("path"), "path", "left_semi")
    return finding(
        rows, "hardcoded-secret", severity, F.format_string("Possible %s in source code", F.col("kind")), F.col("path"), F.col("line"),
        suggestion=F.lit("Read it from the environment or a secret store"), metadata=F.create_map(F.lit("kind"), F.col("kind")),
    )


def taint_sinks(calls: DataFrame, severity: str) -> DataFrame:
    """Dangerous calls with an argument that isn't a literal, and formatted SQL."""
    leaf = F.element_at(F.split("name", r"\."), -1)
    rows = calls.where("not is_test and not is_conftest")
    danger = F.when(F.col("name").isin(*SINKS) & F.col("has_dynamic_arg"), F.lit("dangerous_call"))
    sql = F.when(leaf.isin(*SQL_SINKS) & F.col("has_format_arg"), F.lit("sql_injection"))
    rows = rows.withColumn("kind", F.explode(F.array_compact(F.array(danger, sql))))
    name, dangerous = F.col("name"), F.col("kind") == "dangerous_call"
    message = F.when(dangerous, F.format_string("Dangerous function '%s' called with dynamic argument", name))
    advice = F.when(dangerous, F.format_string("Avoid passing user-controlled data to '%s'", name)).otherwise("Use parameterized queries instead of string formatting")
    return finding(
        rows, "taint-sink", severity, message.otherwise(F.format_string("Potential SQL injection via '%s' with string formatting", name)), F.col("path"), F.col("line"),
        col=F.col("col"), suggestion=advice, metadata=F.create_map(F.lit("sink"), name, F.lit("kind"), F.col("kind")), seq=F.col("call_id"),
    )
