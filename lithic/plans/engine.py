"""The analysis as one plan over a corpus.

An ``Engine`` holds the fact tables of a corpus and lazy frames for every result.
The sources are parsed once; the module rows are written to the shared folder, from
which all rules read the columns that they need.
"""

from __future__ import annotations

from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clones, facts, findings, graph, health, plugins, resolve, rules, security
from ..sources.config import Config, declared_requirements
from ..sources.files import read_tree
from ..sources.reports import Results
from ..storage import materialise


class Engine:
    """Results of one corpus (path, content, size) under one configuration."""

    def __init__(self, corpus: DataFrame, config: Config, requirements: list[tuple[str, bool]] | None = None):
        self.corpus, self.config, self.requirements = corpus, config, requirements
        self.spark: SparkSession = corpus.sparkSession

    @classmethod
    def of_tree(cls, spark: SparkSession, config: Config) -> Engine:
        return cls(read_tree(spark, config.root, config.ignore_patterns), config, declared_requirements(config.root))

    def _severity(self, rule: str) -> str:
        return self.config.rules.severity_for(rule)

    # ------------------------------------------------------------------- facts
    @cached_property
    def modules(self) -> DataFrame:
        return materialise(facts.modules(self.corpus), "modules")

    @cached_property
    def imports(self) -> DataFrame:
        return facts.imports(self.modules)

    @cached_property
    def functions(self) -> DataFrame:
        return facts.functions(self.modules)

    @cached_property
    def lines(self) -> DataFrame:
        return facts.source_lines(self.corpus)

    @cached_property
    def tokens(self) -> DataFrame:
        return facts.normalised_values(facts.tokens(self.corpus), self.config.duplicates.mode).select("path", "values", "lines")

    # ------------------------------------------------------------------- graph
    @cached_property
    def resolved(self) -> DataFrame:
        return resolve.resolved_imports(self.imports, self.modules.select("path"))

    @cached_property
    def symbols(self) -> DataFrame:
        nested = resolve.resolved_submodules(self.imports, self.modules.select("path"))
        return materialise(resolve.symbol_edges(self.imports, self.resolved, nested), "symbols")

    @cached_property
    def edges(self) -> DataFrame:
        return resolve.edges(self.symbols)

    @cached_property
    def externals(self) -> DataFrame:
        return resolve.external_imports(self.imports, self.resolved)

    def importers_of(self, path: str) -> DataFrame:
        return self.edges.where(F.col("dst") == path).select(F.col("src").alias("path"))

    def imports_of(self, path: str) -> DataFrame:
        return self.edges.where(F.col("src") == path).select(F.col("dst").alias("path"))

    def symbols_imported(self, src: str, dst: str) -> DataFrame:
        return self.symbols.where((F.col("src") == src) & (F.col("dst") == dst) & F.col("name").isNotNull()).select("name")

    def all_external_imports(self) -> DataFrame:
        return self.externals.select("top_level").distinct()

    @cached_property
    def entry_points(self) -> DataFrame:
        return graph.entry_points(self.modules, self.edges)

    @cached_property
    def reachable(self) -> DataFrame:
        tests = self.modules.where("is_test or is_conftest").select("path")
        return graph.reachable(self.edges, self.entry_points.union(tests))

    def is_reachable(self, path: str) -> bool:
        return not self.reachable.where(F.col("path") == path).isEmpty()

    def is_entry_point(self, path: str) -> bool:
        return not self.entry_points.where(F.col("path") == path).isEmpty()

    @cached_property
    def unreachable(self) -> DataFrame:
        return graph.unreachable_files(self.modules, self.edges).orderBy("path")

    @cached_property
    def cycles(self) -> DataFrame:
        found = materialise(graph.cycles(self.edges), "cycles")
        return found.select("modules", "edges").orderBy(F.size("modules"), "modules")

    # ----------------------------------------------------------------- results
    @cached_property
    def clones(self) -> DataFrame:
        d = self.config.duplicates
        return materialise(clones.clone_groups(self.tokens, d.min_tokens, d.min_lines, d.min_occurrences), "groups")

    @cached_property
    def file_health(self) -> DataFrame:
        h = self.config.health
        return health.file_health(health.production(self.modules), self.functions, h.max_cyclomatic, h.max_cognitive)

    @cached_property
    def project_health(self) -> DataFrame:
        return health.project_health(self.file_health)

    @cached_property
    def hotspots(self) -> DataFrame:
        return health.hotspots(self.file_health)

    @cached_property
    def plugins(self) -> plugins.Registry:
        return plugins.load_plugins(self.requirements)

    def security_findings(self) -> DataFrame:
        parts = [self._none()]
        if (s := self._severity("hardcoded-secret")) != "off":
            parts.append(security.hardcoded_secrets(self.lines, self.modules, s))
        if (s := self._severity("taint-sink")) != "off":
            parts.append(security.taint_sinks(facts.calls(self.modules), s))
        return findings.union_all(parts)

    def _none(self) -> DataFrame:
        from ..schemas import FINDINGS

        return self.spark.createDataFrame([], FINDINGS)

    def all_findings(self) -> DataFrame:
        """Every rule that isn't off, in one union; a rule that is off isn't planned."""
        c, on = self.config, lambda rule: self._severity(rule) != "off"
        s = self._severity
        parts = [self.security_findings()]
        if on("unused-files"):
            parts.append(rules.unused_files(self.modules, self.edges, s("unused-files")))
        if on("unused-imports"):
            parts.append(rules.unused_imports(self.modules, s("unused-imports")))
        exports = {r: s(r) for r in ("unused-functions", "unused-classes", "unused-variables")}
        if any(v != "off" for v in exports.values()):
            parts.append(rules.unused_exports(self.modules, self.edges, self.symbols, exports))
        if on("unused-all-entries"):
            parts.append(rules.undefined_all_entries(self.modules, s("unused-all-entries")))
        if self.requirements is not None:
            asked = rules.declared(self.spark, self.requirements)
            if on("unused-dependencies"):
                parts.append(rules.unused_dependencies(self.externals, asked, s("unused-dependencies"), c.ignore_dependencies))
            if on("unlisted-dependencies"):
                parts.append(rules.unlisted_dependencies(self.externals, asked, s("unlisted-dependencies")))
        if on("circular-dependencies"):
            parts.append(rules.circular_imports(self.cycles, s("circular-dependencies")))
        if on("high-complexity"):
            parts.append(rules.high_complexity(self.functions, s("high-complexity"), c.health.max_cyclomatic, c.health.max_cognitive))
        if on("boundary-violation") and rules.effective_boundaries(c.boundaries).zones:
            parts.append(rules.boundary_violations(self.edges, c.boundaries, s("boundary-violation")))
        if on("duplicate-code"):
            parts.append(clones.clone_findings(self.clones, s("duplicate-code")))
        return findings.union_all(parts)

    @cached_property
    def findings(self) -> DataFrame:
        """All findings but those that an active plugin suppresses."""
        return findings.suppress(self.all_findings(), self.plugins.suppressed_rules(F.col("file")))

    def frames(self) -> dict[str, DataFrame]:
        """Every result as a lazy frame."""
        return {
            "findings": findings.sorted_findings(self.findings), "cycles": self.cycles, "duplicates": clones.sorted_groups(self.clones),
            "file_health": self.file_health, "health": self.project_health, "totals": findings.totals(self.findings, self.cycles, self.clones),
        }

    # ------------------------------------------------------------- driver side
    def health_row(self) -> dict:
        row = self.project_health.first().asDict()
        return row | {"hotspots": [r.asDict() for r in self.hotspots.collect()]}

    def results(self, with_health: bool = True) -> Results:
        """The report's rows on the driver, sorted."""
        found = materialise(self.findings, "findings")
        out = Results(
            findings=[r.asDict(recursive=True) for r in findings.sorted_findings(found).collect()],
            cycles=[r.asDict(recursive=True) for r in self.cycles.collect()],
            duplicates=[r.asDict(recursive=True) for r in clones.sorted_groups(self.clones).collect()],
            health=self.health_row() if with_health else None,
            total_files_scanned=self.modules.count(),
        )
        out.compute_totals()
        return out


def analyze(spark: SparkSession, config: Config) -> Results:
    """Everything about one source tree."""
    return Engine.of_tree(spark, config).results()


def changed_files(found: DataFrame, files: list[str] | DataFrame) -> DataFrame:
    """Findings in the given files alone."""
    if isinstance(files, DataFrame):
        return found.join(files.select(F.col("path").alias("file")).distinct(), "file", "left_semi")
    return found.where(F.col("file").isin(*files)) if files else found.limit(0)


def project_root(root: Path | str | None) -> Path:
    return Path(root).resolve() if root else Path.cwd()
