"""Changes between manifests, early cut-off, upserts, and streams of spans and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexgraph.graph import PropertyGraph


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(project, rel_path, state): added, changed (time or size differ), deleted or same, by a full join of the manifests."""
    key = ["project", "rel_path"]
    a = old.select(*key, F.col("mtime_ns").alias("m0"), F.col("size").alias("s0"), F.lit(1).alias("o"))
    b = new.select(*key, F.col("mtime_ns").alias("m1"), F.col("size").alias("s1"), F.lit(1).alias("n"))
    state = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "deleted").when((F.col("m0") != F.col("m1")) | (F.col("s0") != F.col("s1")), "changed").otherwise("same")
    return a.join(b, key, "full").select(*key, state.alias("state"))


def affected_files(g: PropertyGraph, old_surface: DataFrame, new_surface: DataFrame) -> DataFrame:
    """Files to resolve anew: those whose own surface (rel_path, surface_sha) changed and those that depend on them."""
    changed = old_surface.select("rel_path", F.col("surface_sha").alias("a")).join(new_surface.select("rel_path", F.col("surface_sha").alias("b")), "rel_path", "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select(F.col("rel_path").alias("file_path"))
    n = g.nodes.select("id", "file_path")
    target = n.join(changed, "file_path", "left_semi").select(F.col("id").alias("target_id"))
    source = g.edges.join(target, "target_id", "left_semi").select(F.col("source_id").alias("id")).distinct()
    return n.join(source, "id", "left_semi").select("file_path").union(changed).distinct()


def patch(g: PropertyGraph, fresh: PropertyGraph, files: DataFrame) -> PropertyGraph:
    """The graph with everything of some files (file_path) replaced; edges into them from elsewhere follow by qualified name."""
    gone = g.nodes.join(files, "file_path", "left_semi")
    ids = gone.select("id", "qualified_name")
    into = g.edges.join(ids.select(F.col("id").alias("target_id"), F.col("qualified_name").alias("_q")), "target_id").join(ids.select(F.col("id").alias("source_id")), "source_id", "left_anti")
    moved = into.join(fresh.nodes.select(F.col("qualified_name").alias("_q"), F.col("id").alias("_new")), "_q").withColumn("target_id", F.col("_new"))
    kept = g.without_nodes(gone)
    return PropertyGraph(kept.nodes.unionByName(fresh.nodes), kept.edges.unionByName(fresh.edges).unionByName(moved.select(*g.edges.columns)))


def publish(g: PropertyGraph, root: str, generation: int) -> str:
    """Writes a generation to a folder of its own and then the pointer to it; readers see the old one or the new one."""
    path = f"{root}/generation={generation}"
    g.write(path)
    spark = g.nodes.sparkSession
    spark.createDataFrame([(generation, path)], "generation long, path string").coalesce(1).write.mode("append").parquet(f"{root}/_current")
    return path


def current(spark: SparkSession, root: str) -> PropertyGraph:
    row = spark.read.parquet(f"{root}/_current").orderBy(F.desc("generation")).first()
    return PropertyGraph.read(spark, row.path)


def verify_dump(committed: int, persisted: int) -> str:
    """degraded if more than 50 nodes were committed and under half of them are there."""
    return "degraded" if committed > 50 and persisted / committed < 0.5 else "ok"


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) of a stream or table of events (ts, event_type, value) in tumbling windows."""
    w = events.withWatermark("ts", late) if events.isStreaming else events
    g = w.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n): sessions of a user that end after a gap."""
    w = events.withWatermark("ts", late) if events.isStreaming else events
    g = w.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what there is now, exactly once, into Parquet."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def upsert_stream(stream: DataFrame, apply, checkpoint: str) -> None:
    """Hands each micro-batch to apply(batch, number), at least once."""
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def poll_seconds(files: int) -> int:
    """5 s and one more for each 500 files, 60 at most."""
    return min(60, 5 + files // 500)
