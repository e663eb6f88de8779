"""The property graph: nodes and edges with JSON properties."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plexgraph.schema import EDGE_COLUMNS, NODE_COLUMNS, prop


@dataclass
class PropertyGraph:
    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> PropertyGraph:
        return cls(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))

    def write(self, path: str, codec: str = "zstd") -> None:
        """Partitioned by project; nodes sorted by label and edges by type within files, for row-group skipping."""
        for name, df, by in (("nodes", self.nodes, "label"), ("edges", self.edges, "type")):
            df.repartition("project", by).sortWithinPartitions("project", by).write.mode("overwrite").option("compression", codec).partitionBy("project").parquet(f"{path}/{name}")

    def of_project(self, project: str | None) -> PropertyGraph:
        if project is None:
            return self
        return PropertyGraph(self.nodes.filter(F.col("project") == project), self.edges.filter(F.col("project") == project))

    def of_type(self, *types: str) -> DataFrame:
        return self.edges.filter(F.col("type").isin(*types)) if types else self.edges

    def deduplicated(self) -> PropertyGraph:
        return PropertyGraph(dedup_nodes(self.nodes), dedup_edges(self.edges))

    def without_orphans(self) -> PropertyGraph:
        """Edges whose ends both exist."""
        ids = self.nodes.select("id")
        e = self.edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
        return PropertyGraph(self.nodes, e.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(*self.edges.columns))

    def without_nodes(self, gone: DataFrame) -> PropertyGraph:
        """Deletion of nodes (ids in ``id``) with their edges."""
        ids = gone.select("id").distinct()
        e = self.edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
        return PropertyGraph(self.nodes.join(ids, "id", "left_anti"), e.select(*self.edges.columns))

    def merged(self, other: PropertyGraph) -> PropertyGraph:
        """Union by qualified name: ids of ``other`` follow the node that survives."""
        nodes = dedup_nodes(self.nodes.unionByName(other.nodes))
        keep = nodes.select("project", "qualified_name", F.col("id").alias("new"))
        e = None
        for g in (self, other):  # each side by its own ids: one number may stand for a node of either
            to = g.nodes.select("id", "project", "qualified_name").join(keep, ["project", "qualified_name"]).select("id", "new").distinct()
            own = g.edges
            for end in ("source_id", "target_id"):
                own = own.join(to.withColumnRenamed("id", end), end).drop(end).withColumnRenamed("new", end)
            own = own.select(*EDGE_COLUMNS)
            e = own if e is None else e.unionByName(own)
        return PropertyGraph(nodes, dedup_edges(e))


def dedup_nodes(nodes: DataFrame) -> DataFrame:
    """One node for each (project, qualified name): a Module gives way to a Project or Folder, then the smallest file path, the last start line, the greatest name and label."""
    rank = F.when(F.col("label").isin("Project", "Folder"), 0).when(F.col("label") == "Module", 2).otherwise(1)
    w = Window.partitionBy("project", "qualified_name").orderBy(rank, F.asc("file_path"), F.desc("start_line"), F.desc("name"), F.desc("label"), F.asc("id"))
    return nodes.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(*NODE_COLUMNS)


def dedup_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (source, target, type), and local name for IMPORTS: the greatest confidence, then the greatest properties."""
    local = F.when(F.col("type") == "IMPORTS", F.coalesce(prop("local_name"), F.lit(""))).otherwise("")
    confidence = F.expr("try_cast(get_json_object(properties, '$.confidence') as double)")
    w = Window.partitionBy("project", "source_id", "target_id", "type", local).orderBy(F.desc_nulls_last(confidence), F.desc("properties"), F.asc("id"))
    return edges.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(*EDGE_COLUMNS)
