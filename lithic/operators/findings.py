"""Findings as rows: building, suppressing, comparing with a baseline, counting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..schemas import FIELDS, FINDINGS
from ..storage import materialise


def fix_action(kind: str, target: Column, auto: bool = True) -> Column:
    return F.struct(F.lit(kind).alias("kind"), target.alias("target"), F.lit(auto).alias("auto_fixable"))


def finding(rows: DataFrame, rule: Column | str, severity: Column | str, message: Column, file: Column | str, line: Column | int = 1, **more: Column | None) -> DataFrame:
    """Rows of ``FINDINGS``; fields that aren't given are NULL, col and seq 0."""
    given = {
        "rule": F.lit(rule) if isinstance(rule, str) else rule,
        "severity": F.lit(severity) if isinstance(severity, str) else severity,
        "message": message,
        "file": F.lit(file) if isinstance(file, str) else file,
        "line": F.lit(line) if isinstance(line, int) else line,
        "col": F.lit(0),
        "seq": F.lit(0),
    } | {k: v for k, v in more.items() if v is not None}
    kinds = dict(x.strip().split(" ", 1) for x in _top_level(FINDINGS))
    return rows.select(*[given.get(f, F.lit(None)).cast(kinds[f]).alias(f) for f in FIELDS])


def _top_level(ddl: str) -> list[str]:
    out, depth, start = [], 0, 0
    for k, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[start:k])
            start = k + 1
    return [*out, ddl[start:]]


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def suppress(findings: DataFrame, rules_of: Column) -> DataFrame:
    """Findings whose rule isn't among ``rules_of`` (an array over the column file)."""
    return findings.where(~F.array_contains(rules_of, F.col("rule")))


def finding_key() -> Column:
    return F.concat_ws(":", "rule", "file", F.col("line").cast("string"), "message")


def baseline_keys(findings: DataFrame) -> DataFrame:
    """(key) of the findings, each once."""
    return findings.select(finding_key().alias("key")).distinct()


def new_findings(findings: DataFrame, keys: DataFrame) -> DataFrame:
    """Findings whose key isn't among ``keys``."""
    return findings.withColumn("key", finding_key()).join(keys.select("key"), "key", "left_anti").drop("key")


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """All findings of two results."""
    return a.unionByName(b)


def sorted_findings(findings: DataFrame) -> DataFrame:
    """By file, line and rule; ties by their place in the rule's own order."""
    return findings.orderBy("file", "line", "rule", "seq", "message")


def numbered_findings(findings: DataFrame) -> DataFrame:
    """Sorted findings with ``place``, their number in the report from 1.

    Ranges of the order are written; a range's rows are numbered within it, after the
    rows of all ranges before it. No task holds more than a range.
    """
    order = ["file", "line", "rule", "seq", "message"]
    ranged = materialise(findings.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("__range").agg(F.count("*").alias("n"))
    before = counts.select("__range", F.coalesce(F.sum("n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = ranged.withColumn("nth", F.row_number().over(W.partitionBy("__range").orderBy(*order)))
    return inside.join(before, "__range").withColumn("place", F.col("nth") + F.col("before")).drop("__range", "nth", "before")


def totals(findings: DataFrame, cycles: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: total_issues, errors, warnings. Cycles and clone groups count beside
    the findings that they also give, so they count twice."""
    counts = findings.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warn").alias("warnings"),
    )
    extra = cycles.agg(F.count("*").alias("c")).crossJoin(groups.agg(F.count("*").alias("g")))
    return counts.crossJoin(extra).select((F.col("n") + F.col("c") + F.col("g")).alias("total_issues"), "errors", "warnings")


def by_file(findings: DataFrame) -> DataFrame:
    """(file, findings, errors, warnings), for reports grouped by file."""
    return findings.groupBy("file").agg(
        F.count("*").alias("findings"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warn").alias("warnings")
    )


def rule_index(findings: DataFrame) -> DataFrame:
    """(rule, rule_index): rules numbered by their first finding in report order."""
    order = W.orderBy("file", "line", "rule", "seq", "message")
    # a rule's first finding decides; one row a rule is left before anything is sorted
    firsts = findings.groupBy("rule").agg(F.min(F.struct("file", "line", "rule", "seq", "message")).alias("first"))
    return firsts.select("rule", "first.file", "first.line", "first.seq", "first.message").select("rule", (F.row_number().over(order) - 1).alias("rule_index"))
