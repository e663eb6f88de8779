"""Git logs and diffs as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def parse_log(lines: DataFrame) -> DataFrame:
    """(commit_id, ts, file) from lines (part, n, value) of ``git log --name-only --format=COMMIT:%H:%ct``; n numbers the lines of a part."""
    head = F.startswith("value", F.lit("COMMIT:"))
    w = Window.partitionBy("part").orderBy("n")
    at = lines.withColumn("head", F.last(F.when(head, F.col("value")), ignorenulls=True).over(w))
    rows = at.filter(~head & (F.trim("value") != "") & F.col("head").isNotNull())
    return rows.select(F.split_part("head", F.lit(":"), F.lit(2)).alias("commit_id"), F.split_part("head", F.lit(":"), F.lit(3)).cast("long").alias("ts"), F.col("value").alias("file"))


def parse_name_status(lines: DataFrame) -> DataFrame:
    """(status, path, old_path) from lines (value): status letter, tab, path, and for renames a second path."""
    p = F.split("value", "\t")
    status = F.left(F.get(p, F.lit(0)), F.lit(1))
    new = F.when(status.isin("R", "C"), F.get(p, F.lit(2))).otherwise(F.get(p, F.lit(1)))
    return lines.filter(F.size(p) >= 2).select(status.alias("status"), new.alias("path"), F.when(status.isin("R", "C"), F.get(p, F.lit(1))).alias("old_path"))


def parse_hunks(lines: DataFrame) -> DataFrame:
    """(path, start_line, end_line) of the new sides in unified diffs; lines (part, n, value) in order. A pure deletion marks its line."""
    w = Window.partitionBy("part").orderBy("n")
    path = F.last(F.when(F.startswith("value", F.lit("+++ ")), F.regexp_replace(F.substring("value", 5, 4096), "^b/", "")), ignorenulls=True).over(w)
    h = lines.withColumn("path", path).filter(F.startswith("value", F.lit("@@")))
    start = F.regexp_extract("value", r"\+(\d+)", 1).cast("int")
    size = F.coalesce(F.regexp_extract("value", r"\+\d+,(\d+)", 1).try_cast("int"), F.lit(1))
    return h.filter("path <> '/dev/null'").select("path", F.greatest(start, F.lit(1)).alias("start_line"), (F.greatest(start, F.lit(1)) + F.greatest(size, F.lit(1)) - 1).alias("end_line"))
