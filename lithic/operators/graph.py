"""The import graph: entry points, reachability, strongly connected components.

Loops run over DataFrames of nodes or edges; each round is written to the shared
folder, so plans stay short and no node set is ever on the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise


def entry_points(mods: DataFrame, edges: DataFrame) -> DataFrame:
    """(path): the root package, every main module, and what nobody imports (tests apart)."""
    imported = edges.select(F.col("dst").alias("path")).distinct().withColumn("imported", F.lit(True))
    rows = mods.select("path", "is_main", "is_test", "is_conftest").join(imported, "path", "left")
    alone = F.col("imported").isNull() & ~F.col("is_test") & ~F.col("is_conftest")
    return rows.where((F.col("path").cast("string") == "__init__.py") | F.col("is_main") | alone).select("path")


#: Levels that a round of reachability takes before it is written.
HOPS = 4


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(path): ``starts`` and all that they lead to.

    A round takes ``HOPS`` levels of the graph and carries on with the nodes that no
    round has seen before.
    """
    links = materialise(edges.select("src", "dst").distinct(), "links")
    seen = front = materialise(starts.select("path").distinct(), "seen")
    while not front.isEmpty():
        levels = [front]
        for _ in range(HOPS):
            last = levels[-1]
            levels.append(last.join(links, last.path == links.src).select(F.col("dst").alias("path")).distinct())
        found = reduce(DataFrame.union, levels[1:]).distinct()
        front = materialise(found.join(seen, "path", "left_anti"), "front")
        seen = materialise(seen.union(front), "seen")
    return seen


def unreachable_files(mods: DataFrame, edges: DataFrame, strict: bool = False) -> DataFrame:
    """(path): neither reached from an entry point or a test, nor one, nor a package or conftest.

    A module that nobody imports is an entry point, so only cycles, self-imports and
    what hangs on them can be unreachable. ``strict`` takes main modules and the root
    package for entry points alone.
    """
    starts = mods.where("is_main or cast(path as string) = '__init__.py'").select("path") if strict else entry_points(mods, edges)
    tests = mods.where("is_test or is_conftest").select("path")
    found = reachable(edges, starts.union(tests))
    rest = mods.where("not is_conftest and not is_init").select("path")
    return rest.join(found, "path", "left_anti")


def _trim(links: DataFrame) -> DataFrame:
    """Links between nodes that have links both in and out, again and again."""
    count = links.count()
    while count:
        kept = links.join(links.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        kept = kept.join(kept.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        kept = materialise(kept, "trim")
        left = kept.count()
        if left == count:
            break
        links, count = kept, left
    return links


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the strongly connected components of two nodes or more.

    Forward-backward colouring: after nodes on no cycle are trimmed, every node takes
    the least node that leads to it as its colour; those of a colour that lead back to
    its root are a component. What is left goes into the next round. ``component`` is
    the least node.
    """
    links = _trim(materialise(edges.where("src <> dst").select("src", "dst").distinct(), "scc"))
    done = None
    while not links.isEmpty():
        nodes = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct()
        colours = materialise(nodes.select("node", F.col("node").alias("colour")), "colour")
        while True:  # the colour spreads along the links
            sent = links.join(colours, links.src == colours.node).groupBy("dst").agg(F.min("colour").alias("new"))
            spread = colours.join(sent, colours.node == sent.dst, "left").select("node", F.least("colour", "new").alias("colour"), (F.col("new") < F.col("colour")).alias("moved"))
            spread = materialise(spread, "colour")
            colours = spread.select("node", "colour")
            if spread.where("moved").isEmpty():
                break
        inside = links.join(colours.select(F.col("node").alias("src"), F.col("colour").alias("a")), "src")
        inside = inside.join(colours.select(F.col("node").alias("dst"), F.col("colour").alias("b")), "dst").where("a = b")
        roots = colours.where("node = colour").select(F.col("node").alias("path"))
        members = reachable(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), roots)
        found = materialise(colours.join(members, colours.node == members.path).select("node", F.col("colour").alias("component")), "found")
        done = found if done is None else done.union(found)
        gone = found.select("node")
        rest = links.join(gone, links.src == gone.node, "left_anti")
        rest = rest.join(gone, rest.dst == gone.node, "left_anti")
        links = _trim(materialise(rest, "scc"))
    if done is None:
        return edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).limit(0)
    big = done.groupBy("component").count().where("count > 1").select("component")
    return done.join(big, "component", "left_semi").select("node", "component")


def cycles(edges: DataFrame) -> DataFrame:
    """(component, modules, edges): nodes of each component and the links inside, sorted."""
    parts = materialise(strong_components(edges), "parts")
    mods = parts.groupBy("component").agg(F.sort_array(F.collect_list("node")).alias("modules"))
    a = parts.select(F.col("node").alias("src"), F.col("component").alias("component"))
    b = parts.select(F.col("node").alias("dst"), F.col("component").alias("other"))
    inner = edges.where("src <> dst").join(a, "src").join(b, "dst").where("component = other")
    links = inner.groupBy("component").agg(F.sort_array(F.collect_set(F.struct("src", "dst"))).alias("edges"))
    return mods.join(links, "component").select("component", "modules", "edges")


def weak_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the undirected graph of ``edges`` (src, dst): the least node
    of each component, by rounds that hook every node to the least one near it."""
    links = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()
    links, before = materialise(links, "weak"), None
    while not links.isEmpty():
        both = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.least("b", "m").alias("a"), F.greatest("b", "m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.explode(F.array("a", "b")).alias("b"), F.col("m").alias("a")).where("a <> b").select("a", "b").distinct()
        links = materialise(small, "weak")
        now = tuple(links.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())
        if now == before:
            break
        before = now
    roots = links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return links.select(F.col("b").alias("node"), F.col("a").alias("component")).union(roots)
