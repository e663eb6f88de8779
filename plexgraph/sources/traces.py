"""Spans of requests: attributes, durations and percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexgraph.functions.scalar import duration_ns, url_path

#: An exported batch as JSON: one resource with its spans.
OTLP = "resource struct<attributes: array<struct<key: string, value: struct<stringValue: string>>>>, spans array<struct<kind: int, startTimeUnixNano: string, endTimeUnixNano: string, attributes: array<struct<key: string, value: struct<stringValue: string>>>>>"


def parse_otlp(lines: DataFrame) -> DataFrame:
    """(service, kind, attributes, start_time, end_time) from JSON batches in ``value``; what is no JSON gives nothing."""
    b = lines.select(F.from_json("value", OTLP).alias("b")).filter("b.spans IS NOT NULL")
    named = lambda a: F.map_from_entries(F.transform(F.coalesce(a, F.array()), lambda x: F.struct(x["key"], x["value"]["stringValue"])))
    r = b.select(named(F.col("b.resource.attributes"))["service.name"].alias("service"), F.explode("b.spans").alias("s"))
    return r.select(F.coalesce("service", F.lit("")).alias("service"), "s.kind", named(F.col("s.attributes")).alias("attributes"), F.col("s.startTimeUnixNano").alias("start_time"), F.col("s.endTimeUnixNano").alias("end_time"))


def http_spans(spans: DataFrame) -> DataFrame:
    """(method, path, status, duration_ns) of spans (attributes, start_time, end_time) that are HTTP requests."""
    a = F.col("attributes")
    pick = lambda *names: F.coalesce(*[a[n] for n in names])
    method = pick("http.request.method", "http.method")
    route = F.coalesce(pick("http.route", "url.path", "http.target"), url_path(pick("url.full", "http.url")))
    kept = spans.filter(method.isNotNull() & route.isNotNull())
    return kept.select(method.alias("method"), F.split_part(route, F.lit("?"), F.lit(1)).alias("path"), pick("http.response.status_code", "http.status_code").alias("status"), duration_ns(F.col("start_time"), F.col("end_time")).alias("duration_ns"))


def latency(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, total, p99): the percentile is exact, from counts of distinct values so that a hot key holds no list of its rows."""
    from pyspark.sql import Window

    c = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy(key)
    up = c.withColumns({"n": F.sum("k").over(w), "total": F.sum(F.col(value) * F.col("k")).over(w), "seen": F.sum("k").over(w.orderBy(value))})
    place = F.least(F.floor(F.col("n") * 0.99), F.col("n") - 1)
    return up.filter(F.col("seen") > place).groupBy(key, "n", "total").agg(F.min(value).alias("p99")).select(key, "n", F.round("total", 6).alias("total"), "p99")


__all__ = ["http_spans", "latency", "parse_otlp"]
