"""Registered queries: every operator over whole tables, with the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.python_source import KEYWORDS
from ..operators import clones, facts, findings, fixes, graph, health, plugins, resolve, rules, security
from ..sources import reports
from ..sources.config import Boundaries, Zone, ZoneRule
from ..storage import materialise
from . import bindings as B

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
WINDOW = 8


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ------------------------------------------------------------- lines and tokens
_KINDS = " ".join(f"WHEN regexp_matches(text, {_sql_text(p)}) THEN {_sql_text(kind)}" for kind, p in security.SECRETS)
_LINES = r"lines AS (SELECT doc_id, unnest(parts) AS text, unnest(range(1, len(parts) + 1))::INT AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))"


@query(f"WITH {_LINES} SELECT * FROM (SELECT doc_id, line, CASE {_KINDS} END AS kind FROM lines WHERE NOT regexp_matches(text, {_sql_text(security.COMMENT)}) AND NOT regexp_matches(text, {_sql_text(security.SAFE)})) WHERE kind IS NOT NULL")
def secret_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.secret_lines(B.document_lines(spark, sf_dir)).select("doc_id", "line", "kind")


_WORDS = r"words AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda w: w <> '') AS w FROM documents)"


def _windows_sql(word: str) -> str:
    return f"""
WITH {_WORDS},
v AS (SELECT doc_id, list_transform(w, lambda x: {word}) AS w FROM words),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS k FROM v WHERE len(w) >= {WINDOW}),
h AS (SELECT doc_id, k - 1 AS pos, array_to_string(w[k:k + {WINDOW - 1}], ' ') AS win FROM p)"""


_WINDOW_COUNTS = "SELECT min(doc_id) AS path, arg_min(pos, (doc_id, pos))::INT AS pos, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM h GROUP BY win HAVING count(*) > 1"


@query(_windows_sql("x") + _WINDOW_COUNTS)
def clone_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clones.window_counts(B.document_words(spark, sf_dir), WINDOW)


@query(_windows_sql("CASE WHEN regexp_full_match(x, '[0-9]+') THEN '$NUM' WHEN regexp_full_match(x, '[A-Za-z_]+') AND NOT list_contains(['" + "', '".join(sorted(KEYWORDS)) + "'], x) THEN '$ID' ELSE x END") + _WINDOW_COUNTS)
def clone_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows under the mild mode: words as names, digits as numbers."""
    kind = lambda w: F.when(w.rlike("^[0-9]+$"), "NUMBER").when(w.rlike("^[A-Za-z_]+$"), "NAME").otherwise("OP")
    rows = B.document_words(spark, sf_dir).select("path", F.col("values").alias("texts"), F.transform("values", kind).alias("kinds"))
    return clones.window_counts(facts.normalised_values(rows, "mild").select("path", "values"), WINDOW)


@query(_windows_sql("x") + f""", l AS (SELECT win, doc_id, list([pos] ORDER BY pos) AS spots FROM h GROUP BY win, doc_id),
kept AS (SELECT win, doc_id, list_reduce(spots, lambda acc, x: CASE WHEN x[1] - acc[len(acc)] >= {WINDOW} THEN list_concat(acc, x) ELSE acc END) AS spots FROM l)
SELECT min(doc_id) AS path, arg_min(spots[1], doc_id)::INT AS pos, sum(len(spots))::BIGINT AS occurrences FROM kept GROUP BY win HAVING sum(len(spots)) > 1""")
def repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that occur twice at least without overlap."""
    found = clones.repeated_windows(B.document_words(spark, sf_dir), WINDOW)
    return found.select(F.col("positions")[0]["path"].alias("path"), F.col("positions")[0]["pos"].alias("pos"), F.size("positions").cast("long").alias("occurrences"))


@query(f"WITH {_LINES} SELECT md5(text) AS line_hash, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM lines WHERE text <> '' GROUP BY 1 HAVING count(*) > 1")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.document_lines(spark, sf_dir).where("text <> ''").groupBy(F.md5("text").alias("line_hash"), "doc_id").agg(F.count("*").alias("n"))
    return rows.groupBy("line_hash").agg(F.sum("n").alias("occurrences"), F.count("*").alias("documents")).where("occurrences > 1")


@query("SELECT md5(text) AS text_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = B.table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("text_hash"))
    return docs.groupBy("text_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


# ------------------------------------------------------------------------ graph
@query(f"WITH {B.ORDER_EDGES} SELECT src, dst FROM edges")
def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.order_edges(spark, sf_dir)


@query(f"WITH {B.NATION_EDGES} SELECT dst AS path, count(*) AS importers FROM edges GROUP BY dst")
def importers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.nation_edges(spark, sf_dir).groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("importers"))


_ENTRIES = "entries AS (SELECT src AS path FROM chain WHERE o_orderstatus = 'P' OR src NOT IN (SELECT dst FROM edges))"


@query(f"WITH {B.ORDER_EDGES}, {_ENTRIES} SELECT path FROM entries")
def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.entry_points(B.order_modules(spark, sf_dir), B.order_edges(spark, sf_dir))


_REACH = f"WITH RECURSIVE {B.ORDER_EDGES}, {_ENTRIES}, reach AS (SELECT path FROM entries UNION SELECT dst FROM reach JOIN edges ON src = path)"


@query(f"{_REACH} SELECT path FROM reach")
def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = materialise(B.order_edges(spark, sf_dir), "edges")
    return graph.reachable(edges, graph.entry_points(B.order_modules(spark, sf_dir), edges))


@query(f"WITH RECURSIVE {B.ORDER_EDGES}, reach AS (SELECT src AS path FROM chain WHERE o_orderstatus = 'P' UNION SELECT dst FROM reach JOIN edges ON src = path) SELECT src AS path FROM chain WHERE src NOT IN (SELECT path FROM reach)")
def unreachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict mode: what the pending orders, the only main modules, don't lead to."""
    return graph.unreachable_files(B.order_modules(spark, sf_dir), materialise(B.order_edges(spark, sf_dir), "edges"), strict=True)


@query(f"{_REACH} SELECT src::VARCHAR AS file, 'unused-files' AS rule FROM chain WHERE src NOT IN (SELECT path FROM reach)")
def unused_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda df, *cs: df.withColumns({c: F.col(c).cast("string") for c in cs})
    edges = materialise(text(B.order_edges(spark, sf_dir), "src", "dst"), "edges")
    return rules.unused_files(text(B.order_modules(spark, sf_dir), "path"), edges, "error").select("file", "rule")


_RINGS = f"""WITH {B.ORDER_EDGES}, rings AS (
  SELECT src AS node, first AS component FROM chain WHERE first IN (SELECT first FROM chain WHERE later IS NULL AND o_orderstatus = 'F' AND src <> first))"""


@query(f"{_RINGS} SELECT node, component FROM rings")
def cycle_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.strong_components(B.order_edges(spark, sf_dir))


@query(f"{_RINGS} SELECT 'Circular import: ' || array_to_string(list(node ORDER BY node::VARCHAR), ' → ') || ' → ' || min(node::VARCHAR) AS message, min(node::VARCHAR) AS file FROM rings GROUP BY component")
def circular_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = B.order_edges(spark, sf_dir).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    return rules.circular_imports(graph.cycles(materialise(edges, "edges")), "error").select("message", "file")


_ALLOWED = {0: [1, 2], 1: [0], 2: [0, 1, 3], 3: []}
_MAY = " ".join(f"WHEN {k} THEN {[str(x) for x in v] or '[]::VARCHAR[]'}" for k, v in _ALLOWED.items())


@query(f"""WITH {B.NATION_EDGES},
z AS (SELECT e.src, e.dst, a.n_regionkey AS source_zone, b.n_regionkey AS target_zone, CASE a.n_regionkey {_MAY} END AS allowed
      FROM edges e JOIN nation a ON e.src = a.n_nationkey JOIN nation b ON e.dst = b.n_nationkey)
SELECT src::VARCHAR AS file, '''' || src || ''' (' || source_zone || ') imports ''' || dst || ''' (' || target_zone || ') — not allowed by boundary rules' AS message,
       'Zone ''' || source_zone || ''' may only import from: ' || CASE WHEN len(allowed) > 0 THEN array_to_string(allowed, ', ') ELSE 'nothing' END AS suggestion
FROM z WHERE source_zone <> target_zone AND allowed IS NOT NULL AND NOT list_contains(allowed, target_zone::VARCHAR)""")
def boundary_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones are regions; region 4 has no rule."""
    nation = B.table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").cast("string").alias("zone"))
    pairs = B.nation_edges(spark, sf_dir)
    pairs = pairs.join(nation.select(F.col("n_nationkey").alias("src"), F.col("zone").alias("source_zone")), "src")
    pairs = pairs.join(nation.select(F.col("n_nationkey").alias("dst"), F.col("zone").alias("target_zone")), "dst")
    pairs = pairs.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "source_zone", "target_zone")
    given = [ZoneRule(str(k), [str(x) for x in v]) for k, v in _ALLOWED.items()]
    return rules.zone_violations(pairs, given, "error").select("file", "message", "suggestion")


# ------------------------------------------------------------------- complexity
@query(f"""WITH {B.ITEM_FUNCTIONS}, u AS (
  SELECT path, name, line, end_line, 'cyclomatic' AS kind, cyclomatic AS value, 20 AS most FROM fn WHERE NOT is_test
  UNION ALL SELECT path, name, line, end_line, 'cognitive', cognitive, 15 FROM fn WHERE NOT is_test)
SELECT path::VARCHAR AS file, line::INT AS line, end_line::INT AS end_line, '''' || name || ''' has ' || kind || ' complexity ' || value || ' (max ' || most || ')' AS message
FROM u WHERE value > most""")
def high_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.item_functions(spark, sf_dir).withColumn("path", F.col("path").cast("string"))
    return rules.high_complexity(rows, "warn").select("file", "line", "end_line", "message")


@query(f"WITH {B.ITEM_FUNCTIONS} SELECT path, name, cyclomatic FROM fn WHERE cyclomatic >= 24")
def complexity_at_least(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tool's threshold includes its value."""
    return B.item_functions(spark, sf_dir).where(F.col("cyclomatic") >= 24).select("path", "name", "cyclomatic")


_HEALTH = f"""WITH {B.ITEM_FUNCTIONS},
files AS (SELECT s_suppkey AS path, ((s_suppkey % 7) * 100)::INT AS line_count FROM supplier WHERE s_suppkey % 10 <> 0),
g AS (SELECT path, avg(cyclomatic) AS ca, max(cyclomatic) AS cm, avg(cognitive) AS ga, max(cognitive) AS gm, count(*) AS n, count_if(cyclomatic > 20 OR cognitive > 15) AS hot FROM fn GROUP BY path),
m AS (
  SELECT path, line_count, CASE WHEN line_count = 0 THEN 1 ELSE line_count END AS lines_of_code, coalesce(ca, 0) AS cyclomatic_avg, coalesce(cm, 0) AS cyclomatic_max,
         coalesce(ga, 0) AS cognitive_avg, coalesce(gm, 0) AS cognitive_max, coalesce(n, 0) AS n_functions, coalesce(hot, 0) AS hot
  FROM files LEFT JOIN g USING (path)),
h AS (SELECT *, CASE WHEN n_functions = 0 THEN 100.0::DOUBLE ELSE greatest(0, (171 - ln(lines_of_code::DOUBLE) * 21.4 - cyclomatic_avg * 0.23) * 100 / 171) END AS mi FROM m)"""


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.file_metrics(health.production(B.item_files(spark, sf_dir)), B.item_functions(spark, sf_dir))


@query(f"{_HEALTH} SELECT path, lines_of_code, cyclomatic_max, cognitive_max, n_functions, floor(cyclomatic_avg * 1000)::BIGINT AS cyclomatic_mil, floor(mi * 1000 + 0.0001)::BIGINT AS mi_mil, hot AS hot_functions FROM h")
def file_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _metrics(spark, sf_dir)
    return rows.select(
        "path", "lines_of_code", "cyclomatic_max", "cognitive_max", "n_functions", F.floor(F.col("cyclomatic_avg") * 1000).alias("cyclomatic_mil"),
        F.floor(F.col("maintainability_index") * 1000 + 0.0001).alias("mi_mil"), F.size("hotspot_functions").cast("long").alias("hot_functions"),
    )


@query(f"{_HEALTH} SELECT trunc(avg(mi))::INT AS score, CASE WHEN trunc(avg(mi)) >= 80 THEN 'A' WHEN trunc(avg(mi)) >= 60 THEN 'B' WHEN trunc(avg(mi)) >= 40 THEN 'C' WHEN trunc(avg(mi)) >= 20 THEN 'D' ELSE 'F' END AS grade, count(*) AS total_files, sum(n_functions)::BIGINT AS total_functions, sum(line_count)::BIGINT AS total_lines FROM h")
def project_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.project_health(_metrics(spark, sf_dir)).select("score", "grade", "total_files", "total_functions", "total_lines")


@query(f"{_HEALTH} SELECT path, cyclomatic_max FROM h WHERE hot > 0 ORDER BY cyclomatic_max DESC, path LIMIT {health.HOTSPOTS}")
def hotspots_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.hotspots(_metrics(spark, sf_dir)).select("path", "cyclomatic_max")


# ------------------------------------------------------------------ dependencies
def _imported_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that were returned to a supplier are imported."""
    items = B.table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_returnflag") == "R").alias("back"))
    used = items.groupBy("l_partkey").agg(F.count_if("back").alias("n")).where("n > 6")
    return used.select(F.concat(F.lit("Part-"), F.col("l_partkey").cast("string")).alias("top_level"))


def _declared_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of an odd number are declared, those of more than 30 as optional."""
    parts = B.table(spark, sf_dir, "part").where("p_size % 2 = 1")
    need = F.concat(F.lit("part."), F.col("p_partkey").cast("string"), F.lit("[extra]>=1.0; python_version > '3'"))
    return parts.select(F.col("p_partkey").cast("int").alias("seq"), need.alias("requirement"), (F.col("p_size") > 30).alias("optional"))


_USED = "used AS (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count_if(l_returnflag = 'R') > 6)"


@query(f"""WITH {_USED} SELECT 'Dependency ''part_' || p_partkey || ''' is declared but never imported' AS message, 'part_' || p_partkey AS target FROM part
WHERE p_size % 2 = 1 AND p_size <= 30 AND p_partkey NOT IN (SELECT l_partkey FROM used)""")
def unused_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.unused_dependencies(_imported_parts(spark, sf_dir), _declared_parts(spark, sf_dir), "error")
    return found.select("message", F.col("fix.target").alias("target"))


@query(f"""WITH {_USED} SELECT '''Part-' || l_partkey || ''' is imported but not declared in pyproject.toml' AS message FROM used
WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size % 2 = 1)""")
def unlisted_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.unlisted_dependencies(_imported_parts(spark, sf_dir), _declared_parts(spark, sf_dir), "warn").select("message")


@query("""SELECT 'unlisted-dependencies' AS rule, '''Nation_' || n || ''' is imported but not declared in pyproject.toml' AS message FROM (SELECT DISTINCT s_nationkey AS n FROM supplier) WHERE n NOT IN (0, 1)
UNION ALL SELECT 'unused-dependencies', 'Dependency ''left_pad'' is declared but never imported'""")
def parsed_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both rules over parsed imports: aliases, the standard library and private names aren't reported."""
    mods = materialise(facts.modules(B.import_sources(spark, sf_dir), ["path", "imports"]), "imports")
    imports = facts.imports(mods)
    outside = resolve.external_imports(imports, resolve.resolved_imports(imports, mods.select("path")))
    needs = rules.declared(spark, [("PyYAML>=5", False), ("opencv-python[all]", False), ("nation.0", False), ("left-pad; python_version < '4'", False), ("Nation_1", True), ("unused-group", True)])
    found = rules.unlisted_dependencies(outside, needs, "warn").unionByName(rules.unused_dependencies(outside, needs, "error"))
    return found.select("rule", "message")


# --------------------------------------------------------------------- findings
_F = f"WITH {B.EVENT_FINDINGS}"
_SUPPRESSED = "(file LIKE 'migrations/%' AND rule IN ('unused-imports', 'unused-functions', 'unused-classes', 'high-complexity'))"


@query(f"{_F} SELECT rule, file, line, seq FROM f WHERE NOT {_SUPPRESSED}")
def suppressed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = plugins.load_plugins([("Django>=4", False), ("pytest", True)])
    return findings.suppress(B.event_findings(spark, sf_dir), active.suppressed_rules(F.col("file"))).select("rule", "file", "line", "seq")


_KEY = "rule || ':' || file || ':' || line || ':' || message"


@query(f"{_F} SELECT DISTINCT {_KEY} AS key FROM f")
def baseline_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.baseline_keys(B.event_findings(spark, sf_dir))


@query(f"{_F}, old AS (SELECT DISTINCT {_KEY} AS key FROM f WHERE seq % 2 = 0) SELECT rule, file, line, seq FROM f WHERE {_KEY} NOT IN (SELECT key FROM old)")
def baseline_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.event_findings(spark, sf_dir)
    return findings.new_findings(found, findings.baseline_keys(found.where("seq % 2 = 0"))).select("rule", "file", "line", "seq")


@query(f"{_F} SELECT count(*) + (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) AS total_issues, count_if(severity = 'error')::BIGINT AS errors, count_if(severity = 'warn')::BIGINT AS warnings FROM f")
def severity_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.totals(B.event_findings(spark, sf_dir), B.table(spark, sf_dir, "region"), B.table(spark, sf_dir, "nation"))


@query(f"{_F} SELECT rule, file, line, seq FROM f UNION ALL SELECT rule, file, line, seq FROM f WHERE severity = 'error'")
def merged_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.event_findings(spark, sf_dir)
    return findings.merged(found, found.where("severity = 'error'")).select("rule", "file", "line", "seq")


@query(f"{_F} SELECT rule, file, line, seq, row_number() OVER (ORDER BY file, line, rule, seq, message) AS place FROM f")
def sorted_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report order; the place is the row's number in it."""
    return findings.numbered_findings(B.event_findings(spark, sf_dir)).select("rule", "file", "line", "seq", "place")


@query(f"{_F} SELECT file, count(*) AS findings, count_if(severity = 'error')::BIGINT AS errors, count_if(severity = 'warn')::BIGINT AS warnings FROM f GROUP BY file")
def findings_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.by_file(B.event_findings(spark, sf_dir))


_CATEGORY = "CASE rule " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in reports.CATEGORIES.items()) + " ELSE 'Clarity' END"


@query(f"{_F} SELECT rule AS check_name, message AS description, CASE severity WHEN 'error' THEN 'critical' ELSE 'minor' END AS severity, md5({_KEY}) AS fingerprint, file AS path, greatest(line, 1) AS begin, {_CATEGORY} AS category FROM f")
def code_climate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.climate_rows(B.event_findings(spark, sf_dir))


@query(f"{_F} SELECT '::' || CASE severity WHEN 'error' THEN 'error' ELSE 'warning' END || ' file=' || file || ',line=' || greatest(line, 1) || '::' || rule || ': ' || message AS value FROM f")
def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.annotation_rows(B.event_findings(spark, sf_dir))


@query(f"{_F} SELECT file || ':' || line || ': ' || CASE severity WHEN 'error' THEN 'x' ELSE '!' END || ' ' || rule || ': ' || message AS value FROM f")
def compact_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.compact_rows(B.event_findings(spark, sf_dir))


@query(f"{_F} SELECT '| ' || upper(severity) || ' | `' || rule || '` | `' || file || '` | ' || line || ' | ' || message || ' |' AS value FROM f")
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.markdown_rows(B.event_findings(spark, sf_dir))


_SUMMARY = "CASE rule " + " ".join(f"WHEN '{k}' THEN {_sql_text(v)}" for k, v in reports.SUMMARIES.items()) + " ELSE '' END"


@query(f"""{_F}, o AS (SELECT rule, row_number() OVER (ORDER BY file, line, rule, seq, message) AS k FROM f), x AS (SELECT rule, (row_number() OVER (ORDER BY min(k)) - 1)::INT AS rule_index FROM o GROUP BY rule)
SELECT rule AS rule_id, rule_index, CASE severity WHEN 'error' THEN 'error' ELSE 'warning' END AS level, message AS text, file AS uri, greatest(line, 1) AS start_line, {_SUMMARY} AS summary FROM f JOIN x USING (rule)""")
def sarif_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sarif_rows(B.event_findings(spark, sf_dir))


@query(f"{_F}, o AS (SELECT rule, row_number() OVER (ORDER BY file, line, rule, seq, message) AS k FROM f) SELECT rule, (row_number() OVER (ORDER BY min(k)) - 1)::INT AS rule_index FROM o GROUP BY rule")
def sarif_rule_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.rule_index(B.event_findings(spark, sf_dir))


@query(r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)
SELECT page_id, href, EXISTS (SELECT 1 FROM pages p WHERE p.url = href) AS inside FROM l""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links as imports: inside if a page has the address, else external."""
    pages = B.table(spark, sf_dir, "pages")
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    known = pages.select(F.col("url").alias("href")).distinct().withColumn("known", F.lit(True))
    return links.join(known, "href", "left").select("page_id", "href", F.coalesce("known", F.lit(False)).alias("inside"))


# --------------------------------------------------------------- parsed sources
_ITEMS = """i AS (
  SELECT l_suppkey, l_orderkey, l_linenumber, l_returnflag,
         sum(l_linenumber + 2) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_returnflag <> 'R' ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - (l_linenumber + 2) + 1 AS line,
         l_linenumber + CASE WHEN l_returnflag = 'R' THEN l_linenumber ELSE 0 END AS extra,
         l_linenumber * (l_linenumber + 1) // 2 + CASE WHEN l_returnflag = 'R' THEN l_linenumber ELSE 0 END AS cognitive
  FROM lineitem)"""


@query(f"""WITH {_ITEMS} SELECT 'suppliers/s' || l_suppkey || '.py' AS path, 'f_' || l_orderkey || '_' || l_linenumber AS name, line::INT AS line, (line + l_linenumber + 1)::INT AS end_line,
       (1 + extra)::INT AS cyclomatic, cognitive::INT AS cognitive, 2 AS parameters, (l_linenumber + 2)::INT AS lines_of_code FROM i""")
def parsed_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complexity of all functions of sources written from the line items."""
    rows = facts.functions(facts.modules(B.supplier_sources(spark, sf_dir), facts.FUNCTION_FACTS))
    return rows.select("path", "name", "line", "end_line", "cyclomatic", "cognitive", "parameters", "lines_of_code")


@query(f"""WITH {_ITEMS} SELECT 'suppliers/s' || l_suppkey || '.py' AS file, line::INT AS line,
       '''f_' || l_orderkey || '_' || l_linenumber || ''' has cognitive complexity ' || cognitive || ' (max 15)' AS message FROM i WHERE cognitive > 15""")
def parsed_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High complexity from source text to finding."""
    rows = facts.functions(facts.modules(B.supplier_sources(spark, sf_dir), facts.FUNCTION_FACTS))
    return rules.high_complexity(rows, "warn").select("file", "line", "message")


_URGENT = "SELECT o_orderkey, o_orderstatus, substr(o_orderpriority, 1, 1)::INT AS u FROM orders"


@query(f"""WITH o AS ({_URGENT})
SELECT 'orders/o' || o_orderkey || '.py' AS file, 1 AS line, '''os'' (import os) is unused' AS message FROM o WHERE u > 3
UNION ALL SELECT 'orders/o' || o_orderkey || '.py', 2, '''dumps'' imported from ''json'' is unused' FROM o
UNION ALL SELECT 'orders/o' || o_orderkey || '.py', 2, '''loads'' imported from ''json'' is unused' FROM o WHERE u < 4""")
def parsed_unused_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    mods = facts.modules(B.order_sources(spark, sf_dir), ["path", "imports", "all_list", "referenced_names", "noqa_lines", "is_init"])
    return rules.unused_imports(mods, "error").select("file", "line", "message")


@query(f"""WITH o AS ({_URGENT}) SELECT 'orders/o' || o_orderkey || '.py' AS file, (6 + (u <> 3)::INT)::INT AS line,
       CASE o_orderstatus WHEN 'F' THEN 'Dangerous function ''eval'' called with dynamic argument' ELSE 'Potential SQL injection via ''cur.execute'' with string formatting' END AS message
FROM o WHERE o_orderstatus <> 'O'""")
def parsed_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    mods = facts.modules(B.order_sources(spark, sf_dir), facts.CALL_FACTS)
    return security.taint_sinks(facts.calls(mods), "warn").select("file", "line", "message")


@query("SELECT 'orders/o' || o_orderkey || '.py' AS path, 'orders.o' || o_orderkey AS package, (6 + (substr(o_orderpriority, 1, 1) <> '3')::INT)::INT AS line_count, false AS is_test FROM orders")
def parsed_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.modules(B.order_sources(spark, sf_dir)).select("path", "package", "line_count", "is_test")


_PKG = """s AS (
  SELECT 'pkg/suppliers/s' || s_suppkey || '.py' AS src, 'pkg/r' || n_regionkey || '/n' || n_nationkey || '.py' AS dst, s_suppkey % 4 AS kind, n_nationkey AS n
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def _package(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    mods = materialise(facts.modules(B.package_sources(spark, sf_dir)), "package")
    imports = facts.imports(mods)
    direct = resolve.resolved_imports(imports, mods.select("path"))
    symbols = resolve.symbol_edges(imports, direct, resolve.resolved_submodules(imports, mods.select("path")))
    return mods, imports, direct, symbols


@query(f"WITH {_PKG} SELECT src, dst, CASE kind WHEN 2 THEN 'used_' || n ELSE 'n' || n END AS name FROM s WHERE kind < 3")
def resolved_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports resolved to modules: by name, by dots and relatively."""
    return _package(spark, sf_dir)[3]


@query(f"WITH {_PKG} SELECT src AS path, 'numpy' AS top_level FROM s WHERE kind = 3 UNION ALL SELECT src, 'pkg' FROM s WHERE kind = 0")
def external_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute imports of no module; a package without ``__init__`` is one beside its submodule."""
    _, imports, direct, _ = _package(spark, sf_dir)
    return resolve.external_imports(imports, direct)


@query(f"""WITH {_PKG}, t AS (SELECT dst, n, bool_or(kind = 2) AS named FROM s WHERE kind < 3 GROUP BY dst, n)
SELECT dst AS file, 'unused-functions' AS rule, '''idle_' || n || ''' is defined but never used or imported' AS message FROM t
UNION ALL SELECT dst, 'unused-functions', '''used_' || n || ''' is defined but never used or imported' FROM t WHERE NOT named""")
def unused_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    mods, _, _, symbols = _package(spark, sf_dir)
    severities = {"unused-functions": "error", "unused-classes": "error", "unused-variables": "warn"}
    return rules.unused_exports(mods, resolve.edges(symbols), symbols, severities).select("file", "rule", "message")


@query(f"WITH {_PKG} SELECT src AS file, 'supply' AS source_zone, 'asia' AS target_zone FROM s WHERE kind < 3 AND dst LIKE 'pkg/r2/%'")
def zone_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones by path patterns: suppliers may import every region but the third."""
    zones = [Zone("supply", ["suppliers/*"]), Zone("asia", ["**/r2/**"])]
    given = Boundaries(None, zones, [ZoneRule("supply", [])])
    found = rules.boundary_violations(resolve.edges(_package(spark, sf_dir)[3]), given, "error")
    return found.select("file", F.col("metadata")["source_zone"].alias("source_zone"), F.col("metadata")["target_zone"].alias("target_zone"))


_PARTS = """p AS (SELECT 'parts/p' || p_partkey || '.py' AS path, p_partkey::VARCHAR AS k, p_size <= 25 AS listed FROM part)"""


@query(f"""WITH {_PARTS}, e AS (
  SELECT path, unnest([
    {{'marks': 0, 'name': '__all__', 'kind': 'skip', 'line': 2}}, {{'marks': 0, 'name': 'MAKE', 'kind': 'constant', 'line': 3}}, {{'marks': 0, 'name': 'brand', 'kind': 'variable', 'line': 4}},
    {{'marks': 2, 'name': 'view_' || k, 'kind': 'function', 'line': 9}}, {{'marks': 0, 'name': 'Part' || k, 'kind': 'class', 'line': 11}},
    {{'marks': 0, 'name': '__getattr__', 'kind': 'function', 'line': 14}}, {{'marks': 0, 'name': '_quiet', 'kind': 'function', 'line': 16}}], recursive := true)
  FROM p)
SELECT path, name, kind, line::INT AS line, CASE marks WHEN 2 THEN 'route,cached' ELSE '' END AS decorators, name = '__getattr__' AS is_dunder, name = '_quiet' AS is_private FROM e WHERE kind <> 'skip'""")
def parsed_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions, classes, constants and variables with their decorators."""
    rows = facts.exports(facts.modules(B.part_sources(spark, sf_dir), ["path", "exports"]))
    return rows.select("path", "name", "kind", "line", F.array_join("decorators", ",").alias("decorators"), "is_dunder", "is_private")


@query(f"""WITH {_PARTS} SELECT path, 'Part' || k AS classes, 'MAKE,brand' AS global_variables, 'Part ' || k || '.' AS docstring,
       CASE WHEN listed THEN 'Part' || k || ',lost_' || k || ',json' END AS all_list, 'kind,route' AS accessed, true AS hashed FROM p""")
def parsed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes, global names, the docstring, ``__all__`` and attributes that are read."""
    rows = facts.modules(B.part_sources(spark, sf_dir), ["path", "classes", "global_variables", "docstring", "all_list", "accessed_attributes", "content_hash"])
    text = lambda c: F.array_join(c, ",").alias(c)
    return rows.select("path", text("classes"), text("global_variables"), "docstring", text("all_list"), F.array_join("accessed_attributes", ",").alias("accessed"), F.col("content_hash").rlike("^[0-9a-f]{16}$").alias("hashed"))


@query(f"""WITH {_PARTS} SELECT path AS file, '''lost_' || k || ''' is in __all__ but not defined in the module' AS message FROM p WHERE listed""")
def undefined_all_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    mods = facts.modules(B.part_sources(spark, sf_dir), ["path", "all_list", "exports", "imports"])
    return rules.undefined_all_entries(mods, "warn").select("file", "message")


_STATEMENTS = """t AS (
  SELECT 'parts/t' || p_partkey || '.py' AS path, [
    ['strict', 'total = ' || p_size || ' + "' || p_brand || '" if total > 1 : match_ = total'],
    ['mild', '$ID = $NUM + $STR if $ID > $NUM : $ID = $ID'], ['semantic', '$ID = $NUM + $STR if $ID > $NUM : $ID = $ID'],
    ['weak', '$ID $OP $NUM $OP $STR if $ID $OP $NUM $OP $ID $OP $ID']] AS modes FROM part)"""


@query(f"WITH {_STATEMENTS}, m AS (SELECT path, unnest(modes) AS m FROM t) SELECT path, m[1] AS mode, m[2] AS tokens, '1,1,1,1,1,3,3,3,3,3,4,4,4' AS lines FROM m")
def token_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of sources under each clone mode; comments, line ends and indents are skipped."""
    rows = materialise(facts.tokens(B.statement_sources(spark, sf_dir)), "tokens")
    modes = [facts.normalised_values(rows, mode).withColumn("mode", F.lit(mode)) for mode in ("strict", "mild", "semantic", "weak")]
    return findings.union_all(modes).select("path", "mode", F.array_join("values", " ").alias("tokens"), F.array_join("lines", ",").alias("lines"))


_BLOCKS = """g AS (
  SELECT p_brand, count(*) AS n, array_to_string(list('parts/b' || p_partkey || '.py:2-6' ORDER BY 'parts/b' || p_partkey || '.py'), ', ') AS fragments, min('parts/b' || p_partkey || '.py') AS file
  FROM part GROUP BY p_brand HAVING count(*) > 1)"""


@query(f"WITH {_BLOCKS} SELECT 40 AS token_count, 5 AS line_count, n AS occurrences, fragments FROM g")
def clone_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of code that sources share, from their text."""
    rows = facts.normalised_values(facts.tokens(B.block_sources(spark, sf_dir)), "strict")
    found = clones.clone_groups(rows.select("path", "values", "lines"), 30, 4)
    place = F.transform("fragments", lambda f: F.concat(f["file"], F.lit(":"), f["start_line"].cast("string"), F.lit("-"), f["end_line"].cast("string")))
    return found.select("token_count", "line_count", F.size("fragments").cast("long").alias("occurrences"), F.array_join(place, ", ").alias("fragments"))


@query(f"WITH {_BLOCKS} SELECT file, 2 AS line, 6 AS end_line, 'Duplicate code block (40 tokens, 5 lines) appears ' || n || ' times' AS message FROM g")
def clone_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts.normalised_values(facts.tokens(B.block_sources(spark, sf_dir)), "strict")
    return clones.clone_findings(clones.clone_groups(rows.select("path", "values", "lines"), 30, 4), "warn").select("file", "line", "end_line", "message")


# ------------------------------------------------------------------------ fixes
_EDITS = f"""WITH o AS ({_URGENT})
SELECT 'orders/o' || o_orderkey || '.py' AS file, 1 AS line, 'os' AS target, '' AS new_text, true AS applied FROM o WHERE u > 3
UNION ALL SELECT 'orders/o' || o_orderkey || '.py', 2, 'dumps', CASE WHEN u < 4 THEN '' ELSE 'from json import loads' END, true FROM o
UNION ALL SELECT 'orders/o' || o_orderkey || '.py', 2, 'loads', '', true FROM o WHERE u < 4"""


def _unused_in_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    corpus = B.order_sources(spark, sf_dir)
    mods = facts.modules(corpus, ["path", "imports", "all_list", "referenced_names", "noqa_lines", "is_init"])
    return materialise(rules.unused_imports(mods, "error"), "unused"), facts.source_lines(corpus)


@query(_EDITS)
def fix_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import lines without the names that nothing uses."""
    return fixes.import_edits(*_unused_in_orders(spark, sf_dir))


@query(f"SELECT 'remove_import' AS kind, file, line, target FROM ({_EDITS})")
def fix_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixes.fix_plan(_unused_in_orders(spark, sf_dir)[0])


# ---------------------------------------------------------------------- plugins
def _in(column: str, values: set[str] | frozenset[str]) -> str:
    return f"{column} IN ({', '.join(map(_sql_text, sorted(values))) or 'NULL'})"


def _plugin_sql(name: str, p: plugins.Plugin) -> str:
    entry = " OR ".join([*(f"path LIKE '%{x}'" for x in p.entry_suffixes), *(f"contains(path, '{x}')" for x in p.entry_parts)])
    used = f"({_in('decorator', p.decorators)} OR {_in('name', p.names)}" + (f" OR {entry})" if p.entries_are_used else ")")
    imported = f"({_in('name', p.import_names)} AND path LIKE '%{p.import_files}')"
    quiet = f"CASE WHEN contains(path, '{p.suppressed_in}') THEN {len(p.suppressed)} ELSE 0 END" if p.suppressed_in else "0"
    return f"SELECT '{name}' AS plugin, id, coalesce({used}, false) AS used_export, coalesce({imported}, false) AS used_import, ({entry}) AS entry_file, ({quiet})::INT AS suppressed FROM c"


def _picked(values: list[str], key: str) -> str:
    return f"([{', '.join(map(_sql_text, values))}])[({key}) % {len(values)} + 1]"


_CASES = f"c AS (SELECT p_partkey AS id, {_picked(B.PLUGIN_NAMES, 'p_partkey')} AS name, {_picked(B.PLUGIN_DECORATORS, 'p_size')} AS decorator, {_picked(B.PLUGIN_PATHS, 'p_partkey // 11')} AS path FROM part)"


@query(f"WITH {_CASES} " + " UNION ALL ".join(_plugin_sql(k, p) for k, p in plugins.PLUGINS.items()))
def plugin_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each framework says of the same exports, imports and files."""
    rows = B.plugin_cases(spark, sf_dir)
    name, decorators, path = F.col("name"), F.col("decorators"), F.col("path")
    parts = []
    for k, p in plugins.PLUGINS.items():
        asked = [p.is_used_export(name, decorators, path).alias("used_export"), p.is_used_import(F.lit(""), name, path).alias("used_import")]
        parts.append(rows.select(F.lit(k).alias("plugin"), "id", *asked, p.is_entry_file(path).alias("entry_file"), F.size(p.suppressed_rules(path)).alias("suppressed")))
    return findings.union_all(parts)
