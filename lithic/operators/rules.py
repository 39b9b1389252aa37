"""The rules over modules, imports and dependencies; each returns findings."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import in_zone, normalised_dependency, requirement_name
from ..sources.config import Boundaries, Zone, ZoneRule
from .findings import finding, fix_action
from .graph import unreachable_files

#: Decorators, by their last name, that register what they decorate.
ENTRY_DECORATORS = sorted(
    "abstractmethod app callback command delete deleter exception_handler fixture get getter group head hookimpl middleware on_event options "
    "overload override patch periodic_task post put register route router setter shared_task task websocket".split()
)
#: Names under which distributions are imported, where the two differ.
ALIASES = dict(
    pair.split("=")
    for pair in (
        "attr=attrs bs4=beautifulsoup4 cv2=opencv_python dateutil=python_dateutil dotenv=python_dotenv gi=pygobject google=google_cloud "
        "jwt=pyjwt lxml=lxml magic=python_magic pil=pillow serial=pyserial sklearn=scikit_learn usb=pyusb yaml=pyyaml"
    ).split()
)
_STRINGS = "array<string>"


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(_STRINGS)


def unused_files(mods: DataFrame, edges: DataFrame, severity: str, strict: bool = False) -> DataFrame:
    rows = mods.where("not is_test and not is_conftest and line_count <> 0").join(unreachable_files(mods, edges, strict), "path", "left_semi")
    path = F.col("path")
    return finding(
        rows, "unused-files", severity, F.lit("File is not imported by any other module"), path,
        suggestion=F.lit("Delete this file if it is no longer needed"), fix=fix_action("delete_file", path),
    )


def unused_imports(mods: DataFrame, severity: str) -> DataFrame:
    """Names bound by an import that neither the module's code nor its ``__all__`` uses."""
    known = F.coalesce("all_list", _strings([]))
    rows = mods.where("not is_init").select("path", "referenced_names", known.alias("exported"), "noqa_lines", F.posexplode("imports").alias("at", "i"))
    rows = rows.where("not i.is_type_checking and i.module <> '__future__' and not array_contains(noqa_lines, i.line)")
    # from-imports pair the names with what they bind; plain ones have what they bind alone
    pairs = F.when(F.col("i.is_from_import"), F.arrays_zip(F.col("i.names").alias("name"), F.col("i.bound_names").alias("bound")))
    pairs = pairs.otherwise(F.transform("i.bound_names", lambda b: F.struct(b.alias("name"), b.alias("bound"))))
    rows = rows.select("*", F.posexplode(pairs).alias("nth", "p")).where("p.name is not null and p.bound is not null")
    used = F.array_contains("referenced_names", F.col("p.bound")) | F.array_contains("exported", F.col("p.bound"))
    source = F.col("i.is_from_import") & ((F.col("p.name") == "*") | F.array_contains("exported", F.col("p.name")))
    rows = rows.where(~used & ~source)
    name, module = F.col("p.name"), F.col("i.module")
    message = F.when(F.col("i.is_from_import"), F.format_string("'%s' imported from '%s' is unused", name, module))
    message = message.otherwise(F.format_string("'%s' (import %s) is unused", name, module))
    return finding(
        rows, "unused-imports", severity, message, F.col("path"), F.col("i.line"),
        col=F.col("i.col"), fix=fix_action("remove_import", name), seq=F.col("at") * 100000 + F.col("nth"),
    )


def unused_exports(mods: DataFrame, edges: DataFrame, symbols: DataFrame, severities: dict[str, str]) -> DataFrame:
    """Public names of imported modules that no one imports, reads or registers.

    ``severities``: of unused-functions, unused-classes and unused-variables.
    """
    rows = mods.where("not is_init and not is_test and not is_conftest and not is_main")
    rows = rows.select("path", "all_list", "referenced_names", F.posexplode("exports").alias("at", "e"))
    rows = rows.where("not e.is_dunder and not e.is_private and (all_list is null or array_contains(all_list, e.name))")
    rows = rows.where(~F.array_contains("referenced_names", F.col("e.name")) & ~F.arrays_overlap("e.decorators", _strings(ENTRY_DECORATORS)))
    kind = F.col("e.kind")
    rule = F.when(kind == "function", "unused-functions").when(kind == "class", "unused-classes").otherwise("unused-variables")
    level = F.lit(None).cast("string")
    for name, severity in severities.items():
        level = F.when(rule == name, F.lit(severity)).otherwise(level)
    rows = rows.select("path", "at", F.col("e.name").alias("name"), F.col("e.line").alias("line"), F.col("e.col").alias("col"), rule.alias("rule"), level.alias("severity"))
    rows = rows.where("severity <> 'off'")
    rows = rows.join(edges.select(F.col("dst").alias("path")).distinct(), "path", "left_semi")
    rows = rows.join(symbols.select(F.col("dst").alias("path"), "name").where("name is not null").distinct(), ["path", "name"], "left_anti")
    # names that an importer reads as attributes; only those of the names in question
    importers = edges.select("src", F.col("dst").alias("path"))
    reads = mods.select(F.col("path").alias("src"), F.explode("accessed_attributes").alias("name"))
    reads = reads.join(rows.select("name").distinct(), "name", "left_semi")
    rows = rows.join(importers.join(reads, "src").select("path", "name").distinct(), ["path", "name"], "left_anti")
    name = F.col("name")
    return finding(
        rows, F.col("rule"), F.col("severity"), F.format_string("'%s' is defined but never used or imported", name), F.col("path"), F.col("line"),
        col=F.col("col"), suggestion=F.format_string("Remove '%s' if it is no longer used", name), fix=fix_action("remove_export", name, False), seq=F.col("at"),
    )


def undefined_all_entries(mods: DataFrame, severity: str) -> DataFrame:
    """Names in ``__all__`` that the module neither defines nor imports."""
    rows = mods.where("all_list is not null").select("path", F.posexplode("all_list").alias("at", "name"), "exports", "imports")
    known = F.array_union(F.col("exports.name"), F.flatten("imports.bound_names"))
    rows = rows.where(~F.array_contains(known, F.col("name")) & ~F.exists("imports", lambda i: F.array_contains(i["names"], "*")))
    return finding(rows, "unused-all-entries", severity, F.format_string("'%s' is in __all__ but not defined in the module", F.col("name")), F.col("path"), seq=F.col("at"))


def declared(spark: SparkSession, requirements: list[tuple[str, bool]]) -> DataFrame:
    """(seq, requirement, optional) of a project file."""
    rows = [(k, r, o) for k, (r, o) in enumerate(requirements)]
    return spark.createDataFrame(rows, "seq int, requirement string, optional boolean")


def _alias_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ALIASES.items()), "imported string, distribution string")


def unused_dependencies(externals: DataFrame, requirements: DataFrame, severity: str, ignored: list[str] = ()) -> DataFrame:
    """Main dependencies that are imported under neither their name nor an alias."""
    used = externals.select(normalised_dependency(F.col("top_level")).alias("dep")).distinct()
    alias = F.broadcast(_alias_rows(externals.sparkSession))  # fifteen rows
    used = used.union(used.join(alias, used.dep == alias.imported).select(F.col("distribution").alias("dep"))).distinct()
    rows = requirements.where("not optional").select("seq", requirement_name(F.col("requirement")).alias("dep")).where("dep <> ''")
    rows = rows.where(~F.col("dep").isin(*ignored)) if ignored else rows
    rows = rows.join(used, "dep", "left_anti")
    dep = F.col("dep")
    return finding(
        rows, "unused-dependencies", severity, F.format_string("Dependency '%s' is declared but never imported", dep), "pyproject.toml",
        suggestion=F.format_string("Remove '%s' from [project.dependencies] if no longer needed", dep), fix=fix_action("remove_dependency", dep), seq=F.col("seq"),
    )


def unlisted_dependencies(externals: DataFrame, requirements: DataFrame, severity: str) -> DataFrame:
    """Imports from outside that aren't declared, in the standard library or private."""
    names = requirements.select(requirement_name(F.col("requirement")).alias("dep")).where("dep <> ''").distinct()
    alias = F.broadcast(_alias_rows(externals.sparkSession))
    listed = names.union(names.join(alias, names.dep == alias.distribution).select(F.col("imported").alias("dep"))).distinct()
    rows = externals.select("top_level").distinct().where(~F.col("top_level").isin(*sorted(sys.stdlib_module_names)) & ~F.col("top_level").startswith("_"))
    rows = rows.join(listed, normalised_dependency(F.col("top_level")) == F.col("dep"), "left_anti")
    name = F.col("top_level")
    return finding(
        rows, "unlisted-dependencies", severity, F.format_string("'%s' is imported but not declared in pyproject.toml", name), "pyproject.toml",
        suggestion=F.format_string("Add '%s' to [project.dependencies]", name),
    )


def circular_imports(cycles: DataFrame, severity: str) -> DataFrame:
    mods = F.col("modules")
    chain = F.array_join(F.concat(mods, F.slice(mods, 1, 1)), " → ")
    return finding(
        cycles, "circular-dependencies", severity, F.concat(F.lit("Circular import: "), chain), mods[0],
        suggestion=F.lit("Break the cycle by extracting shared types or using lazy imports"),
        metadata=F.create_map(F.lit("modules"), F.to_json(mods), F.lit("edges"), F.to_json("edges")),
    )


def high_complexity(functions: DataFrame, severity: str, max_cyclomatic: int = 20, max_cognitive: int = 15) -> DataFrame:
    """Functions above a threshold, one finding for each of the two."""
    rows = functions.where("not is_test and not is_conftest")
    kinds = f"stack(2, 'cyclomatic', cyclomatic, {int(max_cyclomatic)}, 'Break this function into smaller pieces', 'cognitive', cognitive, {int(max_cognitive)}, 'Reduce nesting and simplify control flow')"
    rows = rows.select("path", "function_id", "name", "line", "end_line", F.expr(kinds).alias("kind", "value", "most", "advice")).where("value > most")
    message = F.format_string("'%s' has %s complexity %d (max %d)", "name", "kind", "value", "most")
    return finding(
        rows, "high-complexity", severity, message, F.col("path"), F.col("line"), end_line=F.col("end_line"), suggestion=F.col("advice"),
        metadata=F.create_map(F.lit("kind"), F.col("kind"), F.lit("value"), F.col("value").cast("string"), F.lit("threshold"), F.col("most").cast("string")),
        seq=F.col("function_id") * 2 + (F.col("kind") == "cognitive").cast("int"),
    )


# ------------------------------------------------------------------- boundaries
def _preset(name: str, zones: dict[str, str], allowed: dict[str, str]) -> Boundaries:
    return Boundaries(name, [Zone(z, [f"**/{d}/**" for d in dirs.split()]) for z, dirs in zones.items()], [ZoneRule(z, to.split()) for z, to in allowed.items()])


PRESETS = {
    p.preset: p
    for p in (
        _preset("layered", {"presentation": "views routes api", "business": "services domain core", "data": "models repositories db"}, {"presentation": "business", "business": "data", "data": ""}),
        _preset("hexagonal", {"adapters": "adapters infra", "ports": "ports interfaces", "domain": "domain core models"}, {"adapters": "ports domain", "ports": "domain", "domain": ""}),
        _preset("feature-sliced", {"app": "app", "features": "features", "shared": "shared common lib"}, {"app": "features shared", "features": "shared", "shared": ""}),
    )
}


def effective_boundaries(given: Boundaries) -> Boundaries:
    """The preset that is named, if there is one and no zones are given."""
    return PRESETS.get(given.preset or "", given) if not given.zones else given


def zone_of(path: Column, zones: list[Zone]) -> Column:
    """First zone with a pattern that matches; NULL for none."""
    out = F.lit(None).cast("string")
    for zone in reversed(zones):
        match = F.lit(False)
        for pattern in zone.patterns:
            match = match | in_zone(path, pattern)
        out = F.when(match, F.lit(zone.name)).otherwise(out)
    return out


def zone_violations(pairs: DataFrame, rules: list[ZoneRule], severity: str) -> DataFrame:
    """Findings of the edges (src, dst, source_zone, target_zone) that no rule allows.

    A zone without a rule may import anything; the last of several rules counts.
    """
    allow = F.lit(None).cast(_STRINGS)
    for rule in rules:
        allow = F.when(F.col("source_zone") == rule.source, _strings(sorted(set(rule.allow)))).otherwise(allow)
    rows = pairs.withColumn("allowed", allow).where("source_zone <> target_zone and allowed is not null and not array_contains(allowed, target_zone)")
    message = F.format_string("'%s' (%s) imports '%s' (%s) — not allowed by boundary rules", "src", "source_zone", "dst", "target_zone")
    may = F.when(F.size("allowed") > 0, F.array_join("allowed", ", ")).otherwise("nothing")
    return finding(
        rows, "boundary-violation", severity, message, F.col("src"), suggestion=F.format_string("Zone '%s' may only import from: %s", F.col("source_zone"), may),
        metadata=F.create_map(F.lit("source_zone"), F.col("source_zone"), F.lit("target_zone"), F.col("target_zone"), F.lit("allowed"), F.to_json("allowed")),
    )


def boundary_violations(edges: DataFrame, boundaries: Boundaries, severity: str) -> DataFrame:
    """Imports across zones; zones are an expression over the path, so nothing is joined."""
    rules = effective_boundaries(boundaries)
    pairs = edges.select("src", "dst", zone_of(F.col("src"), rules.zones).alias("source_zone"), zone_of(F.col("dst"), rules.zones).alias("target_zone"))
    return zone_violations(pairs, rules.rules if rules.zones else [], severity)
