"""Complexity and maintainability of files and of the project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOTSPOTS = 10


def rounded(x: Column, digits: int) -> Column:
    """To so many digits, halves to even, as Python rounds but for the last bit."""
    return F.rint(x * 10**digits) / 10**digits


def maintainability(cyclomatic: Column, lines: Column) -> Column:
    """0 to 100; the logarithm of the lines stands in for the volume too."""
    log = F.log(F.greatest(lines, F.lit(1)).cast("double"))
    return F.greatest(F.lit(0.0), (F.lit(171.0) - log * 21.4 - cyclomatic * 0.23) * 100 / 171)


def grade(score: Column) -> Column:
    out = F.lit("F")
    for least, letter in ((20, "D"), (40, "C"), (60, "B"), (80, "A")):
        out = F.when(score >= least, letter).otherwise(out)
    return out


def production(rows: DataFrame) -> DataFrame:
    return rows.where("not is_test and not is_conftest")


def file_metrics(files: DataFrame, functions: DataFrame, max_cyclomatic: int = 20, max_cognitive: int = 15) -> DataFrame:
    """Unrounded metrics of each of ``files`` (path, line_count); functions by path.

    Files without a function have an index of 100 and zeros.
    """
    hot = (F.col("cyclomatic") > max_cyclomatic) | (F.col("cognitive") > max_cognitive)
    each = functions.groupBy("path").agg(
        F.avg("cyclomatic").alias("cyclomatic_avg"), F.max("cyclomatic").alias("cyclomatic_max"), F.avg("cognitive").alias("cognitive_avg"), F.max("cognitive").alias("cognitive_max"),
        F.count("*").alias("n_functions"),
        F.sort_array(F.collect_list(F.when(hot, F.struct("function_id", "name")))).alias("hot"),
    )
    rows = files.select("path", "line_count").join(each, "path", "left")
    loc = F.when(F.col("line_count") == 0, 1).otherwise(F.col("line_count"))
    index = F.when(F.col("n_functions").isNull(), 100.0).otherwise(maintainability(F.col("cyclomatic_avg"), loc))
    zero = F.lit(0)
    return rows.select(
        "path", F.coalesce("cyclomatic_avg", F.lit(0.0)).alias("cyclomatic_avg"), F.coalesce("cyclomatic_max", zero).alias("cyclomatic_max"),
        F.coalesce("cognitive_avg", F.lit(0.0)).alias("cognitive_avg"), F.coalesce("cognitive_max", zero).alias("cognitive_max"),
        index.alias("maintainability_index"), loc.alias("lines_of_code"), F.coalesce("n_functions", zero.cast("long")).alias("n_functions"), "line_count",
        F.coalesce(F.col("hot.name"), F.array().cast("array<string>")).alias("hotspot_functions"),
    )


def file_health(files: DataFrame, functions: DataFrame, max_cyclomatic: int = 20, max_cognitive: int = 15) -> DataFrame:
    """``file_metrics``, rounded: means to two digits, the index to one."""
    rows = file_metrics(files, functions, max_cyclomatic, max_cognitive)
    two = {c: rounded(F.col(c), 2) for c in ("cyclomatic_avg", "cognitive_avg")}
    return rows.withColumns(two | {"maintainability_index": rounded(F.col("maintainability_index"), 1)})


def hotspots(health: DataFrame) -> DataFrame:
    """The ten files with the highest cyclomatic complexity of those that have a hot function."""
    return health.where(F.size("hotspot_functions") > 0).orderBy(F.desc("cyclomatic_max"), "path").limit(HOTSPOTS)


def project_health(health: DataFrame) -> DataFrame:
    """One row: score, grade, totals and means over files; no files score 100."""
    some = lambda c: F.coalesce(F.avg(F.when(F.col(c) > 0, F.col(c))), F.lit(0.0))
    total = health.agg(
        F.avg("maintainability_index").alias("mi"), some("cyclomatic_avg").alias("cc"), some("cognitive_avg").alias("cog"), F.count("*").alias("total_files"),
        F.coalesce(F.sum("n_functions"), F.lit(0)).alias("total_functions"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("total_lines"),
    )
    # least and greatest pass over NULLs, so a project without files is told apart first
    score = F.when(F.col("mi").isNull(), 100.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("mi")))).cast("int")
    return total.select(
        score.alias("score"), grade(score).alias("grade"), "total_files", "total_functions", "total_lines", rounded(F.col("cc"), 2).alias("cyclomatic_avg"),
        rounded(F.col("cog"), 2).alias("cognitive_avg"), rounded(F.coalesce("mi", F.lit(0.0)), 1).alias("maintainability_avg"),
    )


def slowest_first(health: DataFrame) -> DataFrame:
    """Files by maintainability, the worst first."""
    return health.orderBy("maintainability_index", "path")
