"""Point and batch lookups over nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexgraph.graph import PropertyGraph
from plexgraph.schema import CALLABLE_LABELS, prop

#: Types of edges that call.
CALL_TYPES = ["CALLS", "HTTP_CALLS", "ASYNC_CALLS"]


def by_qn_suffix(nodes: DataFrame, suffix: str) -> DataFrame:
    """Nodes named so, or ending so at a dot."""
    return nodes.filter((F.col("qualified_name") == suffix) | F.endswith("qualified_name", F.lit(f".{suffix}")))


def in_lines(nodes: DataFrame, path: str, first: int, last: int) -> DataFrame:
    """Definitions of a file that overlap a range of lines."""
    return nodes.filter((F.col("file_path") == path) & (F.col("start_line") <= last) & (F.col("end_line") >= first) & ~F.col("label").isin("Module", "Package", "File", "Folder"))


def in_hunks(nodes: DataFrame, hunks: DataFrame) -> DataFrame:
    """Definitions that overlap any of the hunks (path, start_line, end_line): an equi-join on the file with a range condition."""
    h = hunks.select(F.col("path"), F.col("start_line").alias("_a"), F.col("end_line").alias("_b"))
    hit = nodes.join(h, (F.col("file_path") == F.col("path")) & (F.col("start_line") <= F.col("_b")) & (F.col("end_line") >= F.col("_a")), "left_semi")
    return hit.filter(~F.col("label").isin("Module", "Package", "File", "Folder"))


def qn_to_id(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """names (qualified_name) with their id, NULL where there is none."""
    return names.join(nodes.select("qualified_name", "id"), "qualified_name", "left")


def degrees(g: PropertyGraph, types: list[str] | None = None) -> DataFrame:
    """(id, in_degree, out_degree) of every node, over edges of the given types. Counted on each end before any join."""
    e = g.of_type(*types) if types else g.edges
    ends = e.select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    d = ends.groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    return g.nodes.select("id").join(d, "id", "left").select("id", F.coalesce("i", F.lit(0)).alias("in_degree"), F.coalesce("o", F.lit(0)).alias("out_degree"))


def neighbour_names(g: PropertyGraph, limit: int = 10) -> DataFrame:
    """(id, callers, callees): sorted distinct names over calls of any kind, the first ``limit`` of each."""
    names = g.nodes.select(F.col("id").alias("other"), "name")
    e = g.of_type(*CALL_TYPES)

    def first(own: str, other: str, name: str) -> DataFrame:
        met = e.select(F.col(own).alias("id"), F.col(other).alias("other")).join(names, "other").filter("name IS NOT NULL").select("id", "name").distinct()
        few = met.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("name"))).filter(F.col("k") <= limit)  # each task keeps no more than these
        return few.groupBy("id").agg(F.array_sort(F.collect_list("name")).alias(name))

    return first("target_id", "source_id", "callers").join(first("source_id", "target_id", "callees"), "id", "full")


def dependent_files(g: PropertyGraph, files: list[str]) -> DataFrame:
    """Files with an edge into one of the given files, these left out."""
    n = g.nodes.select("id", "file_path")
    targets = n.filter(F.col("file_path").isin(files)).select(F.col("id").alias("target_id"))
    sources = g.edges.join(targets, "target_id", "left_semi").select(F.col("source_id").alias("id")).distinct()
    return n.join(sources, "id", "left_semi").select("file_path").distinct().filter(~F.col("file_path").isin(files))


def callable_edges(g: PropertyGraph, max_edges: int) -> DataFrame:
    """CALLS among callables, the first ``max_edges`` by id, with ``truncated`` telling whether there are more."""
    ids = g.nodes.filter(F.col("label").isin(CALLABLE_LABELS)).select("id")
    e = g.of_type("CALLS").join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    some = e.select("id", "source_id", "target_id").orderBy("id").limit(max_edges + 1)
    more = some.agg((F.count(F.lit(1)) > max_edges).alias("truncated"))
    return some.orderBy("id").limit(max_edges).withColumn("truncated", more.scalar())


def under(path: Column, scope: str) -> Column:
    """Is the path the scope or below it, by whole segments?"""
    bare = scope.rstrip("/")
    return F.lit(True) if not bare else (path == bare) | F.startswith(path, F.lit(f"{bare}/"))


def counts(g: PropertyGraph, scope: str = "") -> DataFrame:
    """(kind, value, n): nodes by label and edges by type whose source lies in the scope."""
    n = g.nodes.filter(under(F.col("file_path"), scope))
    e = g.edges.join(n.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return n.groupBy(F.lit("node").alias("kind"), F.col("label").alias("value")).agg(F.count(F.lit(1)).alias("n")).unionByName(e.groupBy(F.lit("edge").alias("kind"), F.col("type").alias("value")).agg(F.count(F.lit(1)).alias("n")))


def edges_by_url(edges: DataFrame, keyword: str) -> DataFrame:
    return edges.filter(F.contains(prop("url_path"), F.lit(keyword)))


def coverage_of(coverage: DataFrame, scope: str) -> DataFrame:
    """Coverage rows below a scope, and of directories that hold it."""
    bare = scope.rstrip("/")
    return coverage.filter(under(F.col("rel_path"), bare) | F.startswith(F.lit(bare), F.concat(F.col("rel_path"), F.lit("/"))))
