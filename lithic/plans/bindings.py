"""Facts out of the driver's tables, so that every operator runs on whole tables.

Two kinds: tables read as facts directly, and Python sources written from rows,
which then go through the real parse pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import findings as O
from ..sources.files import from_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line, text): lines of the documents, from 1."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "text")).select("doc_id", (F.col("at") + 1).alias("line"), "text")


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, values): words of each document; they stand for tokens."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("path"), F.filter(F.split("text", "[ \t\r\n]+"), lambda w: w != "").alias("values"))


# ------------------------------------------------------------ nations as modules
def nation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, n): line items by the supplier's and the customer's nation."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("dst"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("src"))
    rows = items.join(suppliers, items.l_suppkey == suppliers.s_suppkey).join(orders, items.l_orderkey == orders.o_orderkey)
    return rows.join(customers, rows.o_custkey == customers.c_custkey).groupBy("src", "dst").agg(F.count("*").alias("n"))


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): each supplier nation and the customer nations with line items of it."""
    return nation_lines(spark, sf_dir).select("src", "dst")


NATION_EDGES = """
edges AS (
  SELECT DISTINCT s_nationkey AS src, c_nationkey AS dst
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)
"""


# ------------------------------------------------------------- orders as modules
def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): each order leads to its customer's next one of the same priority; a last one
    with the status F leads back to the first."""
    own = W.partitionBy("o_custkey", "o_orderpriority")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(own.orderBy("o_orderkey")).alias("later"), F.min("o_orderkey").over(own).alias("first"), "o_orderstatus"
    )
    dst = F.coalesce("later", F.when(F.col("o_orderstatus") == "F", F.col("first")))
    return rows.select("src", dst.alias("dst")).where("dst is not null")


ORDER_EDGES = """
chain AS (
  SELECT o_orderkey AS src, o_orderstatus, lead(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS later, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS first
  FROM orders),
edges AS (
  SELECT src, CASE WHEN later IS NOT NULL THEN later WHEN o_orderstatus = 'F' THEN first END AS dst FROM chain
  WHERE later IS NOT NULL OR o_orderstatus = 'F')
"""


def order_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Module flags of the orders: pending ones are main modules, none is a test."""
    no = F.lit(False)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("path"), (F.col("o_orderstatus") == "P").alias("is_main"), no.alias("is_test"), no.alias("is_conftest"), no.alias("is_init"), F.lit(1).alias("line_count")
    )


# ---------------------------------------------------------- items as functions
def item_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as functions of their supplier's file."""
    items = table(spark, sf_dir, "lineitem")
    return items.select(
        F.col("l_suppkey").alias("path"), F.concat_ws("_", F.lit("f"), "l_orderkey", "l_linenumber").alias("name"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("function_id"),
        (F.col("l_linenumber") * 10).alias("line"), (F.col("l_linenumber") * 10 + 5).alias("end_line"), (F.col("l_linenumber") * 4).cast("int").alias("cyclomatic"),
        (F.col("l_quantity") / 3).cast("int").alias("cognitive"), (F.pmod("l_suppkey", F.lit(10)) == 0).alias("is_test"), F.lit(False).alias("is_conftest"),
    )


ITEM_FUNCTIONS = """
fn AS (
  SELECT l_suppkey AS path, 'f_' || l_orderkey || '_' || l_linenumber AS name, l_linenumber * 10 AS line, l_linenumber * 10 + 5 AS end_line,
         (l_linenumber * 4)::INT AS cyclomatic, trunc(l_quantity / 3)::INT AS cognitive, l_suppkey % 10 = 0 AS is_test
  FROM lineitem)
"""


def item_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as files; the line count follows from the key."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("path"), (F.pmod("s_suppkey", F.lit(7)) * 100).cast("int").alias("line_count"), (F.pmod("s_suppkey", F.lit(10)) == 0).alias("is_test"), F.lit(False).alias("is_conftest")
    )


# ------------------------------------------------------------ events as findings
def event_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as findings: the type is the rule, the user the file, migrations every tenth user."""
    events = table(spark, sf_dir, "events")
    rule = F.when(F.col("event_type") == "click", "unused-imports").when(F.col("event_type") == "view", "high-complexity").otherwise(F.concat(F.lit("rule-"), "event_type"))
    folder = F.when(F.pmod("user_id", F.lit(10)) == 0, "migrations/").otherwise("src/")
    file = F.concat(folder, F.lit("u"), F.col("user_id").cast("string"), F.lit(".py"))
    severity = F.when(F.pmod("event_id", F.lit(3)) == 0, "error").otherwise("warn")
    line = F.pmod("event_id", F.lit(50)).cast("int")
    return O.finding(events, rule, severity, F.concat(F.lit("event "), "event_type"), file, line, seq=F.col("event_id"))


EVENT_FINDINGS = """
f AS (
  SELECT CASE event_type WHEN 'click' THEN 'unused-imports' WHEN 'view' THEN 'high-complexity' ELSE 'rule-' || event_type END AS rule,
         CASE WHEN event_id % 3 = 0 THEN 'error' ELSE 'warn' END AS severity, 'event ' || event_type AS message,
         CASE WHEN user_id % 10 = 0 THEN 'migrations/' ELSE 'src/' END || 'u' || user_id || '.py' AS file, (event_id % 50)::INT AS line, event_id AS seq
  FROM events)
"""


# --------------------------------------------------------------- written sources
def supplier_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One module a supplier: a function a line item, with as many ifs, one in the other,
    as its line number says, and an ``and`` where the item was returned."""
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag")
    name = F.concat_ws("_", F.lit("f"), "l_orderkey", "l_linenumber")
    test = F.when(F.col("l_returnflag") == "R", "a and b").otherwise("a")
    ifs = F.transform(F.sequence(F.lit(1), "l_linenumber"), lambda k: F.concat(F.repeat(F.lit("    "), k), F.lit("if "), test, F.lit(":\n")))
    text = F.concat(F.lit("def "), name, F.lit("(a, b):\n"), F.array_join(ifs, ""), F.repeat(F.lit("    "), F.col("l_linenumber") + 1), F.lit("return b\n"))
    files = items.select("l_suppkey", "l_orderkey", "l_linenumber", text.alias("text")).groupBy("l_suppkey")
    files = files.agg(F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber", "text"))).alias("parts"))
    return from_table(files, F.concat(F.lit("suppliers/s"), "l_suppkey", F.lit(".py")), F.array_join("parts.text", ""))


def order_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One module an order: a call that depends on its status, imports that its priority uses or not."""
    orders = table(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    call = F.when(status == "F", "eval(x)\n").when(status == "O", "eval('1 + 1')\n").otherwise("cur.execute(f'select {x}')\n")
    urgent = F.substring("o_orderpriority", 1, 1).cast("int")
    uses = F.concat(F.when(urgent <= 2, "os.getcwd()\n").otherwise(""), F.when(urgent >= 4, "loads('1')\n").otherwise(""))
    comment = F.when(urgent == 3, "  # noqa: F401\n").otherwise("\n")
    text = F.concat(F.lit("import os"), comment, F.lit("from json import dumps, loads\n"), F.lit("from typing import TYPE_CHECKING\nif TYPE_CHECKING:\n    import re\n"), uses, call)
    return from_table(orders, F.concat(F.lit("orders/o"), "o_orderkey", F.lit(".py")), text)


def package_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package: a module a nation below its region, and one a supplier that imports its
    nation by name, by dots or relatively, and the package ``numpy``."""
    nation = table(spark, sf_dir, "nation")
    where = F.concat(F.lit("pkg/r"), "n_regionkey", F.lit("/n"), "n_nationkey", F.lit(".py"))
    body = F.concat(F.lit("NATION = 1\ndef used_"), "n_nationkey", F.lit("():\n    return NATION\ndef idle_"), "n_nationkey", F.lit("():\n    return 2\n"))
    mods = nation.select(where.alias("path"), body.alias("source"))
    suppliers = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    kind = F.pmod("s_suppkey", F.lit(4))
    n, r = F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    line = (
        F.when(kind == 0, F.concat(F.lit("from pkg.r"), r, F.lit(" import n"), n))
        .when(kind == 1, F.concat(F.lit("import pkg.r"), r, F.lit(".n"), n))
        .when(kind == 2, F.concat(F.lit("from ..r"), r, F.lit(".n"), n, F.lit(" import used_"), n))
        .otherwise(F.concat(F.lit("import numpy.linalg\nfrom .. import missing_"), n))
    )
    users = suppliers.select(F.concat(F.lit("pkg/suppliers/s"), "s_suppkey", F.lit(".py")).alias("path"), F.concat(line, F.lit("\n")).alias("source"))
    return from_table(mods.union(users), F.col("path"), F.col("source"))


def part_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One module a part with exports of all kinds; small parts list them in ``__all__``,
    with a name that isn't there."""
    p = F.col("p_partkey").cast("string")
    listed = F.when(F.col("p_size") <= 25, F.concat(F.lit("__all__ = ['Part"), p, F.lit("', 'lost_"), p, F.lit("', 'json']\n"))).otherwise("\n")
    body = F.concat(
        F.lit("MAKE = 1\nbrand: str = 'b'\n_hidden = 2\nimport json\n@app.route('/x')\n@cached\ndef view_"), p, F.lit("():\n    return MAKE\nclass Part"), p,
        F.lit("(Base):\n    def get(self):\n        return self.kind\ndef __getattr__(name):\n    pass\nasync def _quiet():\n    pass\n"),
    )
    text = F.concat(F.lit('"""Part '), p, F.lit('."""\n'), listed, body)
    return from_table(table(spark, sf_dir, "part"), F.concat(F.lit("parts/p"), p, F.lit(".py")), text)


def statement_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One module a part: an assignment with its size and brand, a comment, a condition."""
    text = F.concat(F.lit("total = "), F.col("p_size").cast("string"), F.lit(' + "'), "p_brand", F.lit('"  # a note\n\nif total > 1:\n    match_ = total\n'))
    return from_table(table(spark, sf_dir, "part"), F.concat(F.lit("parts/t"), F.col("p_partkey").cast("string"), F.lit(".py")), text)


def block_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One module a part: a line of its own, a block that all parts of its brand have, a line of its own."""
    p, b = F.col("p_partkey").cast("string"), F.regexp_replace("p_brand", "[^0-9]", "")
    lines = [F.concat(F.lit(f"step_{k}_"), b, F.lit(f" = call_{k}_"), b, F.lit(f"(a_{k}_"), b, F.lit(f", {k})\n")) for k in range(1, 6)]
    text = F.concat(F.lit("before_"), p, F.lit(" = own_"), p, F.lit("\n"), *lines, F.lit("after_"), p, F.lit(" = own_"), p, F.lit("\n"))
    return from_table(table(spark, sf_dir, "part"), F.concat(F.lit("parts/b"), p, F.lit(".py")), text)


def import_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One module a supplier that imports packages: under another name, of the standard library,
    private ones, and one for each nation."""
    s, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    text = F.concat(F.lit("import yaml.loader\nimport os.path, _thread_tools\nfrom cv2 import imread\nimport Nation_"), n, F.lit("\n"))
    return from_table(table(spark, sf_dir, "supplier"), F.concat(F.lit("imports/s"), s, F.lit(".py")), text)


def plugin_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, decorators, module, path): parts as exports and imports in files that frameworks know."""
    pick = lambda values, key: F.element_at(F.array(*[F.lit(v) for v in values]), F.pmod(key, F.lit(len(values))).cast("int") + 1)
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("id"), pick(PLUGIN_NAMES, key).alias("name"), F.array(F.lit("cached"), pick(PLUGIN_DECORATORS, F.col("p_size"))).alias("decorators"), pick(PLUGIN_PATHS, F.floor(key / 11)).alias("path")
    )


PLUGIN_NAMES = ["app", "urlpatterns", "helper", "Model", "Depends", "create_app"]
PLUGIN_DECORATORS = ["task", "receiver", "fixture", "get", "errorhandler", "nothing", "parametrize"]
PLUGIN_PATHS = ["src/models.py", "src/migrations/0001.py", "tests/conftest.py", "src/tasks.py", "src/main.py", "src/wsgi.py", "src/util.py"]
