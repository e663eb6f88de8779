"""Roll-ups of a graph: each aspect is a plan of its own, built only when asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexgraph.functions.scalar import is_test_file_path, qn_package
from plexgraph.graph import PropertyGraph
from plexgraph.operators.lookup import under
from plexgraph.schema import flag, keys, prop

#: File endings and languages.
LANGUAGES = {"py": "Python", "go": "Go", "js": "JavaScript", "ts": "TypeScript", "tsx": "TSX", "java": "Java", "kt": "Kotlin", "c": "C", "h": "C", "cpp": "C++", "hpp": "C++", "cs": "C#", "rs": "Rust", "rb": "Ruby", "php": "PHP", "scala": "Scala", "swift": "Swift", "lua": "Lua", "sql": "SQL", "sh": "Shell"}


def _package(prefix: str = "") -> F.Column:
    return qn_package(F.col(f"{prefix}qualified_name"))


def _package_calls(g: PropertyGraph, types: tuple = ("CALLS",)) -> DataFrame:
    """(from_pkg, to_pkg, type) of each edge: two joins on ids, of narrow columns."""
    p = g.nodes.select("id", _package().alias("pkg"))
    e = g.of_type(*types).select("source_id", "target_id", "type")
    e = e.join(p.select(F.col("id").alias("source_id"), F.col("pkg").alias("from_pkg")), "source_id")
    return e.join(p.select(F.col("id").alias("target_id"), F.col("pkg").alias("to_pkg")), "target_id")


def languages(g: PropertyGraph) -> DataFrame:
    to = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    files = g.nodes.select("file_path").distinct()
    return files.groupBy(F.coalesce(to[F.regexp_extract("file_path", r"\.([^./]+)$", 1)], F.lit("Other")).alias("language")).agg(F.count(F.lit(1)).alias("files"))


def packages(g: PropertyGraph) -> DataFrame:
    n = g.nodes.groupBy(_package().alias("name")).agg(F.count(F.lit(1)).alias("node_count"))
    cross = _package_calls(g).filter("from_pkg <> to_pkg")
    out = cross.groupBy(F.col("from_pkg").alias("name")).agg(F.count(F.lit(1)).alias("fan_out"))
    into = cross.groupBy(F.col("to_pkg").alias("name")).agg(F.count(F.lit(1)).alias("fan_in"))
    return n.join(into, "name", "left").join(out, "name", "left").select("name", "node_count", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def entry_points(g: PropertyGraph) -> DataFrame:
    return g.nodes.filter(flag("is_entry_point") & ~is_test_file_path(F.col("file_path"))).select("name", "qualified_name", "file_path")


def routes(g: PropertyGraph) -> DataFrame:
    return g.nodes.select(prop("route_method").alias("method"), prop("route_path").alias("path"), F.col("qualified_name").alias("handler")).filter("path IS NOT NULL")


def hotspots(g: PropertyGraph, k: int = 20) -> DataFrame:
    into = g.of_type("CALLS").groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"))
    return g.nodes.filter(~is_test_file_path(F.col("file_path"))).join(into, "id").select("name", "qualified_name", "fan_in").orderBy(F.desc("fan_in"), "qualified_name").limit(k)


def boundaries(g: PropertyGraph) -> DataFrame:
    return _package_calls(g).filter("from_pkg <> to_pkg").groupBy("from_pkg", "to_pkg").agg(F.count(F.lit(1)).alias("call_count"))


def services(g: PropertyGraph) -> DataFrame:
    return _package_calls(g, ("HTTP_CALLS", "ASYNC_CALLS")).groupBy("from_pkg", "to_pkg", "type").agg(F.count(F.lit(1)).alias("n"))


def layers(g: PropertyGraph) -> DataFrame:
    """A package with routes is api; one that only others call is core; one that nobody calls is entry; the others are internal."""
    p = packages(g)
    routed = g.nodes.filter(prop("route_path").isNotNull()).select(_package().alias("name")).distinct().withColumn("routed", F.lit(True))
    layer = F.when(F.col("routed"), "api").when((F.col("fan_in") > 0) & (F.col("fan_out") == 0), "core").when(F.col("fan_in") == 0, "entry").otherwise("internal")
    return p.join(routed, "name", "left").select("name", layer.alias("layer"))


def file_tree(g: PropertyGraph) -> DataFrame:
    """(path, kind, children) of every file and directory."""
    files = g.nodes.select("file_path").distinct()
    parts = F.split("file_path", "/")
    paths = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("path"), F.array_join(F.slice(parts, 1, k - 1), "/").alias("parent"), (k == F.size(parts)).alias("leaf")))).alias("p")).select("p.*").distinct()
    n = paths.groupBy(F.col("parent").alias("path")).agg(F.count(F.lit(1)).alias("children"))
    return paths.select("path", F.when(F.col("leaf"), "file").otherwise("dir").alias("kind")).join(n, "path", "left").select("path", "kind", F.coalesce("children", F.lit(0)).alias("children"))


def schema_counts(g: PropertyGraph) -> DataFrame:
    return g.nodes.groupBy(F.lit("label").alias("kind"), F.col("label").alias("value")).agg(F.count(F.lit(1)).alias("n")).unionByName(g.edges.groupBy(F.lit("type").alias("kind"), F.col("type").alias("value")).agg(F.count(F.lit(1)).alias("n")))


def schema_keys(g: PropertyGraph) -> DataFrame:
    """(label, key): which properties nodes of a label have."""
    return g.nodes.select("label", F.explode(keys()).alias("key")).distinct()


def schema_patterns(g: PropertyGraph) -> DataFrame:
    """(a, type, b, n): (A)-[T]->(B) by labels."""
    l = g.nodes.select("id", "label")  # noqa: E741
    e = g.edges.select("source_id", "target_id", "type").join(l.select(F.col("id").alias("source_id"), F.col("label").alias("a")), "source_id")
    return e.join(l.select(F.col("id").alias("target_id"), F.col("label").alias("b")), "target_id").groupBy("a", "type", "b").agg(F.count(F.lit(1)).alias("n"))


def health(g: PropertyGraph) -> DataFrame:
    n = g.nodes.groupBy("project").agg(F.count(F.lit(1)).alias("nodes"))
    e = g.edges.groupBy("project").agg(F.count(F.lit(1)).alias("edges"))
    return n.join(e, "project", "left").select("project", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"))


def documents(files: DataFrame) -> DataFrame:
    """Paths (``path``) that look like architecture documents."""
    return files.filter(F.lower("path").rlike(r"(^|/)architecture[^/]*\.md$|(^|/)(adr|adrs|decisions)/[^/]*\.md$|(^|/)design[^/]*\.md$"))


ASPECTS = {"languages": languages, "packages": packages, "entry_points": entry_points, "routes": routes, "hotspots": hotspots, "boundaries": boundaries, "services": services, "layers": layers, "file_tree": file_tree}


def architecture(g: PropertyGraph, aspects: list[str], path: str = "") -> dict[str, DataFrame]:
    """The aspects asked for, below a path; "overview" is all but file_tree, "all" is all."""
    if path.strip("/"):
        g = PropertyGraph(g.nodes.filter(under(F.col("file_path"), path)), g.edges).without_orphans()
    names = [a for x in aspects for a in (ASPECTS if x == "all" else [k for k in ASPECTS if k != "file_tree"] if x == "overview" else [x])]
    return {a: ASPECTS[a](g) for a in dict.fromkeys(names)}


def cluster_summary(g: PropertyGraph, membership: DataFrame) -> DataFrame:
    """membership (id, community) -> members, cohesion (share of the community's CALLS that stay inside)."""
    m = membership.select("id", "community")
    e = g.of_type("CALLS").select("source_id", "target_id").join(m.select(F.col("id").alias("source_id"), F.col("community").alias("a")), "source_id").join(m.select(F.col("id").alias("target_id"), F.col("community").alias("b")), "target_id")
    ends = e.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("community"), (F.col("a") == F.col("b")).cast("int").alias("inside"))
    c = ends.groupBy("community").agg(F.avg("inside").alias("cohesion"))
    w = Window.partitionBy("community").orderBy("id")
    top = m.withColumn("k", F.row_number().over(w)).filter("k <= 5").groupBy("community").agg(F.array_sort(F.collect_list("id")).alias("top_nodes"))
    return m.groupBy("community").agg(F.count(F.lit(1)).alias("members")).filter("members >= 2").join(c, "community", "left").join(top, "community").withColumn("cohesion", F.coalesce("cohesion", F.lit(0.0)))
