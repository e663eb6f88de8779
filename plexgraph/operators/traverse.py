"""Breadth-first expansion and what is told from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexgraph.functions.scalar import risk
from plexgraph.graph import PropertyGraph
from plexgraph.schema import flag
from plexgraph.shared import stored

MAX_DEPTH = 15


def _steps(g: PropertyGraph, types: tuple, direction: str) -> DataFrame:
    e = g.of_type(*types)
    out = e.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    back = e.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"))
    return {"outbound": out, "inbound": back}.get(direction, out.unionByName(back))


def bfs(g: PropertyGraph, seeds: DataFrame, types: tuple = ("CALLS",), direction: str = "outbound", max_depth: int = 3) -> DataFrame:
    """(id, hop): nodes reached from any seed (``id``) at their least hop; seeds are left out.

    One join a hop: the frontier meets the edges, those seen are taken off, and
    the new level is written to the shared folder, so that plans stay short, a
    level survives lost executors, and its size is known: a small frontier is
    broadcast and the edges are only scanned, a large one is shuffled. It ends
    when a level is empty.
    """
    steps = _steps(g, types, direction)
    start = seeds.select("id").distinct()
    here, seen = start, start.withColumn("hop", F.lit(0))
    for hop in range(1, min(max_depth, MAX_DEPTH) + 1):
        reached = here.join(steps, here["id"] == steps["a"]).select(F.col("b").alias("id")).distinct()
        here = stored(reached.join(seen.select("id"), "id", "left_anti"))
        if here.isEmpty():
            break
        seen = seen.unionByName(here.withColumn("hop", F.lit(hop)))
    return seen.filter("hop > 0")


def visited_edges(g: PropertyGraph, seeds: DataFrame, visited: DataFrame, types: tuple = ("CALLS",)) -> DataFrame:
    """Edges with both ends among the seeds and the visited."""
    ids = seeds.select("id").unionByName(visited.select("id")).distinct()
    e = g.of_type(*types)
    return e.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def first_hops(hops: DataFrame) -> DataFrame:
    return hops.groupBy("id").agg(F.min("hop").alias("hop"))


def bounded(visited: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The first ``most`` by (hop, id), and whether that cuts any off."""
    cut = visited.orderBy("hop", "id").limit(most + 1)
    return visited.orderBy("hop", "id").limit(most), cut.count() > most


def trace(g: PropertyGraph, seeds: DataFrame, direction: str = "outbound", depth: int = 3, types: tuple = ("CALLS",), include_tests: bool = True) -> DataFrame:
    """(id, qualified_name, hop, risk)."""
    from plexgraph.functions.scalar import is_test_file_path

    n = g.nodes.select("id", "qualified_name", "file_path")
    n = n if include_tests else n.filter(~is_test_file_path(F.col("file_path")))
    return bfs(g, seeds, types, direction, depth).join(n, "id").select("id", "qualified_name", "hop", risk(F.col("hop")).alias("risk"))


def impact_summary(visited: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts by risk, the total, and whether an edge crosses services."""
    r = risk(F.col("hop"))
    counts = visited.agg(*[F.count_if(r == k).alias(k.lower()) for k in ("CRITICAL", "HIGH", "MEDIUM", "LOW")], F.count(F.lit(1)).alias("total"))
    cross = edges.agg(F.coalesce(F.bool_or(F.col("type").isin("HTTP_CALLS", "ASYNC_CALLS")), F.lit(False)).alias("has_cross_service"))
    return counts.withColumn("has_cross_service", cross.scalar())


def detect_changes(g: PropertyGraph, hunks: DataFrame, depth: int = 3) -> DataFrame:
    """Modules affected by changed lines: (module, risk, impacted) over everything that calls, at any hop, what the hunks touch."""
    from plexgraph.functions.scalar import qn_package
    from plexgraph.operators.lookup import in_hunks

    seeds = stored(in_hunks(g.nodes, hunks).select("id"))
    hit = bfs(g, seeds, ("CALLS",), "inbound", depth).join(g.nodes.select("id", "qualified_name"), "id")
    return hit.groupBy(qn_package(F.col("qualified_name")).alias("module"), risk(F.col("hop")).alias("risk")).agg(F.count(F.lit(1)).alias("impacted"))


def dead_code(g: PropertyGraph) -> DataFrame:
    """(id, status) of callables: structural, test, entry, exported, dead, single or normal, the first that holds."""
    from plexgraph.functions.scalar import is_test_file_path

    callers = g.of_type("CALLS", "USAGE", "CALL_REFERENCE").groupBy(F.col("target_id").alias("id")).agg(F.countDistinct("source_id").alias("n"))
    n = g.nodes.join(callers, "id", "left")
    count = F.coalesce("n", F.lit(0))
    status = (
        F.when(~F.col("label").isin("Function", "Method"), "structural")
        .when(is_test_file_path(F.col("file_path")), "test")
        .when(flag("is_entry_point"), "entry")
        .when(flag("is_exported"), "exported")
        .when(count == 0, "dead")
        .when(count == 1, "single")
        .otherwise("normal")
    )
    return n.select("id", status.alias("status"))


def call_depth(g: PropertyGraph, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(id, depth): hops from a Route, File, Module or Package, or else from the nodes nobody calls; 0 where unreached."""
    roots = g.nodes.filter(F.col("label").isin("Route", "File", "Module", "Package")).select("id")
    if roots.isEmpty():
        roots = g.nodes.select("id").join(g.of_type("CALLS").select(F.col("target_id").alias("id")), "id", "left_anti")
    found = bfs(g, roots, ("CALLS",), "outbound", max_depth)
    return g.nodes.select("id").join(found, "id", "left").select("id", F.coalesce("hop", F.lit(0)).alias("depth"))


def connected(pairs: DataFrame) -> DataFrame:
    """(id, root): the smallest id that each end of the pairs (a, b) is connected to, at any distance.

    Every node follows the least root around it, and roots follow theirs; a round is
    written to the shared folder, and it ends when no pair joins two roots.
    """
    both = stored(pairs.filter("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.*").distinct())
    cur = stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("root")))
    while True:
        of = lambda c, r: cur.select(F.col("id").alias(c), F.col("root").alias(r))
        open_ = stored(both.join(of("a", "ra"), "a").join(of("b", "rb"), "b").filter("rb < ra").groupBy(F.col("ra").alias("root")).agg(F.min("rb").alias("to")))
        if open_.isEmpty():
            return cur
        # a root that hangs on another hands all its own to it; chains of roots halve in each step
        hung = cur.join(open_, "root", "left").select("id", F.coalesce("to", "root").alias("root"))
        top = hung.select(F.col("id").alias("root"), F.col("root").alias("top"))
        cur = stored(hung.join(top, "root").select("id", F.col("top").alias("root")))
