"""Imports to modules: candidates in order of precedence, then one equi-join.

An import's candidates are paths; they are exploded with their rank, joined to the
module paths, and the first that exists is taken. Nothing is looked up one by one,
so the plan is a shuffle by path however many modules there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _joined(*parts: Column) -> Column:
    """Path of the parts that aren't empty."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "/")


def _slashed(module: Column) -> Column:
    return F.replace(module, F.lit("."), F.lit("/"))


def base_folder() -> Column:
    """Folder that a relative import starts from, clamped at the root; '' is the root."""
    parts = F.split("path", "/")
    up = F.greatest(F.size(parts) - F.greatest("level", F.lit(1)), F.lit(0))
    return F.array_join(F.slice(parts, F.lit(1), up), "/")


def absolute_candidates() -> Column:
    """For the module and then each shorter dotted prefix: module, package, and both below src."""
    parts = F.split("module", r"\.")
    lengths = F.when(F.col("module") == "", F.array().cast("array<int>")).otherwise(F.sequence(F.size(parts), F.lit(1), F.lit(-1)))

    def forms(n: Column) -> Column:
        stem = F.array_join(F.slice(parts, F.lit(1), n), "/")
        tails = [F.lit(".py"), F.lit("/__init__.py")]
        return F.array(*[F.concat(F.lit(head), stem, tail) for head in ("", "src/") for tail in tails])

    return F.flatten(F.transform(lengths, forms))


def relative_candidates() -> Column:
    """With a module its file and package; without, the folder's package and then each name's."""
    folder = base_folder()
    stem = _joined(folder, _slashed(F.col("module")))
    named = F.flatten(F.transform("names", lambda n: F.array(F.concat(_joined(folder, n), F.lit(".py")), _joined(folder, n, F.lit("__init__.py")))))
    bare = F.concat(F.array(_joined(folder, F.lit("__init__.py"))), named)
    return F.when(F.col("module") != "", F.array(F.concat(stem, F.lit(".py")), F.concat(stem, F.lit("/__init__.py")))).otherwise(bare)


def _first_match(rows: DataFrame, keys: list[str], paths: DataFrame) -> DataFrame:
    """(keys, dst): of each row's ``candidates`` the first that is a path."""
    each = rows.select(*keys, F.posexplode("candidates").alias("rank", "dst"))
    return each.join(paths.select(F.col("path").alias("dst")), "dst").groupBy(*keys).agg(F.min_by("dst", "rank").alias("dst"))


def resolved_imports(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, import_id, dst) of the imports of a module in the corpus."""
    found = F.when(F.col("is_relative"), relative_candidates()).otherwise(absolute_candidates())
    return _first_match(imports.withColumn("candidates", found), ["path", "import_id"], paths)


def resolved_submodules(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, import_id, name, dst) of the names of from-imports that are modules themselves."""
    rows = imports.where("is_from_import and (is_relative or module <> '')")
    rows = rows.select("path", "import_id", "is_relative", "level", "module", F.explode(F.array_distinct("names")).alias("name")).where("name not in ('', '*')")
    package = _slashed(F.col("module"))
    heads = F.when(F.col("is_relative"), F.array(_joined(base_folder(), package))).otherwise(F.array(package, F.concat(F.lit("src/"), package)))
    name = F.col("name")
    found = F.flatten(F.transform(heads, lambda h: F.array(F.concat(_joined(h, name), F.lit(".py")), _joined(h, name, F.lit("__init__.py")))))
    return _first_match(rows.withColumn("candidates", found), ["path", "import_id", "name"], paths)


def symbol_edges(imports: DataFrame, resolved: DataFrame, submodules: DataFrame) -> DataFrame:
    """(src, dst, name): the names that src takes from dst; a NULL name for none."""
    last = F.element_at(F.split("module", r"\."), -1)
    names = F.when(F.size("names") > 0, F.col("names")).when(F.col("module") != "", F.array(last))
    direct = imports.join(resolved, ["path", "import_id"]).select(F.col("path").alias("src"), "dst", F.explode_outer(names).alias("name"))
    nested = submodules.select(F.col("path").alias("src"), "dst", "name")
    return direct.union(nested).distinct()


def edges(symbols: DataFrame) -> DataFrame:
    """(src, dst), each once."""
    return symbols.select("src", "dst").distinct()


def external_imports(imports: DataFrame, resolved: DataFrame) -> DataFrame:
    """(path, top_level) of the absolute imports of no module in the corpus."""
    outside = imports.where("not is_relative and module <> ''").join(resolved, ["path", "import_id"], "left_anti")
    return outside.select("path", F.element_at(F.split("module", r"\."), 1).alias("top_level")).distinct()
