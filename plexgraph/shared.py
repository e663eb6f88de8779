"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The shuffle files of a step go when it is written, not when the driver next collects its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``. Where that is unset, it is a temporary folder on one machine; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="plexgraph-")
        spark.conf.set("spark.checkpoint.dir", root)
    return os.path.join(root, f"plexgraph-{uuid.uuid4().hex}")


def stored(df: DataFrame) -> DataFrame:
    """Writes ``df`` below ``spark.checkpoint.dir`` and reads it back: iterations keep short plans and survive lost executors."""
    path, conf = shared_dir(df.sparkSession), df.sparkSession.conf
    old = conf.get(_CLEAN, None)
    conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(_CLEAN) if old is None else conf.set(_CLEAN, old)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deals out a table that its files split into fewer parts than there are cores: one large row group is one task. Larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
