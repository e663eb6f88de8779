"""Graphs projected from the star-schema tables, in Spark and as SQL common-table expressions.

Expressions are written once, in SQL that Spark and DuckDB both read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plexgraph.graph import PropertyGraph
from plexgraph.schema import EDGE_COLUMNS, NODE_COLUMNS

#: Of the code graph: a definition for each part.
CODE_NODE = {
    "id": "p_partkey",
    "project": "CASE WHEN p_partkey % 4 = 0 THEN 'beta' ELSE 'alpha' END",
    "label": "CASE WHEN p_size % 10 < 6 THEN 'Function' WHEN p_size % 10 < 8 THEN 'Method' WHEN p_size % 10 = 8 THEN 'Class' ELSE 'Interface' END",
    "name": "CASE WHEN p_partkey % 11 = 0 THEN 'test_' WHEN p_partkey % 5 = 0 THEN 'handle' ELSE '' END || replace(p_name, ' ', '_') || CAST(p_partkey AS STRING)",
    "qualified_name": "CASE WHEN p_partkey % 4 = 0 THEN 'beta' ELSE 'alpha' END || CASE WHEN p_partkey % 11 = 0 THEN '.tests.' ELSE '.src.' END || lower(p_type) || '.' || lower(replace(p_brand, '#', '')) || '.' || CASE WHEN p_partkey % 11 = 0 THEN 'test_' WHEN p_partkey % 5 = 0 THEN 'handle' ELSE '' END || replace(p_name, ' ', '_') || CAST(p_partkey AS STRING)",
    "file_path": "CASE WHEN p_partkey % 11 = 0 THEN 'tests/' ELSE 'src/' END || lower(p_type) || '/' || CASE WHEN p_partkey % 11 = 0 THEN 'test_' ELSE '' END || lower(replace(p_brand, '#', '')) || CASE WHEN p_partkey % 3 = 0 THEN '.py' WHEN p_partkey % 3 = 1 THEN '.go' ELSE '.js' END",
    "start_line": "CAST((p_partkey * 7) % 500 + 1 AS INT)",
    "end_line": "CAST((p_partkey * 7) % 500 + 1 + p_size AS INT)",
    "properties": "'{\"complexity\":' || CAST(p_size AS STRING) || ',\"loop_depth\":' || CAST(p_partkey % 4 AS STRING) || CASE WHEN p_partkey % 13 = 0 THEN ',\"is_entry_point\":true' ELSE '' END || CASE WHEN p_partkey % 17 = 0 THEN ',\"route_path\":\"/api/' || lower(p_type) || '/:id\",\"route_method\":\"GET\"' ELSE '' END || ',\"brand\":\"' || p_brand || '\",\"decorators\":[\"@cache_' || lower(p_type) || '\",\"@app.route_' || replace(p_name, ' ', '_') || '\"]}'",
}
#: The type of an edge between definitions that follow one another in an order, by the line's quantity.
CODE_TYPE = "CASE WHEN l_quantity < 6 THEN 'CALLS' WHEN l_quantity < 7 THEN 'HTTP_CALLS' WHEN l_quantity < 8 THEN 'ASYNC_CALLS' WHEN l_quantity < 9 THEN 'USAGE' WHEN l_quantity < 10 THEN 'INHERITS' ELSE 'IMPORTS' END"
_PAIRS_WHERE = "target_id IS NOT NULL AND source_id <> target_id AND l_quantity < 11"
CODE_EDGE_ID = "source_id * 10000000 + target_id + CAST(length(type) AS BIGINT) * 1000000000000000"
CODE_EDGE_PROPERTIES = "'{\"confidence\":0.' || CAST((source_id + target_id) % 9 + 1 AS STRING) || ',\"line\":' || CAST(line AS STRING) || ',\"url_path\":\"/api/' || CAST(target_id % 50 AS STRING) || '/\"}'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _columns(spec: dict) -> list[str]:
    return [f"{v} AS {k}" for k, v in spec.items()]


def code_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*_columns(CODE_NODE))


def code_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_linenumber", F.col("l_partkey").alias("source_id"), F.lead("l_partkey").over(w).alias("target_id"))
    pairs = lines.filter(_PAIRS_WHERE).selectExpr("source_id", "target_id", f"{CODE_TYPE} AS type", "CAST(l_linenumber AS BIGINT) AS line")
    kept = pairs.groupBy("source_id", "target_id", "type").agg(F.min("line").alias("line"))
    return kept.selectExpr(f"{CODE_EDGE_ID} AS id", "'alpha' AS project", "source_id", "target_id", "type", f"{CODE_EDGE_PROPERTIES} AS properties")


def code_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    return PropertyGraph(code_nodes(spark, sf_dir), code_edges(spark, sf_dir))


CODE_SQL = f"""nodes AS (SELECT {", ".join(_columns(CODE_NODE))} FROM part),
edges AS (SELECT {CODE_EDGE_ID} AS id, 'alpha' AS project, source_id, target_id, type, {CODE_EDGE_PROPERTIES} AS properties
  FROM (SELECT source_id, target_id, type, min(line) AS line FROM (SELECT source_id, target_id, {CODE_TYPE} AS type, CAST(l_linenumber AS BIGINT) AS line
    FROM (SELECT l_quantity, l_linenumber, l_partkey AS source_id, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS target_id FROM lineitem)
    WHERE {_PAIRS_WHERE}) GROUP BY ALL))"""

#: Of the trade graph: label, id, name, qualified name, properties, source table.
_TRADE = [
    ("Region", "1000000000000 + r_regionkey", "r_name", "'trade.' || r_name", "'{}'", "region"),
    ("Nation", "2000000000000 + n_nationkey", "n_name", "'trade.' || r_name || '.' || n_name", "'{}'", "nation_of"),
    ("Customer", "3000000000000 + c_custkey", "c_name", "'trade.' || r_name || '.' || n_name || '.' || c_name", "'{\"segment\":\"' || c_mktsegment || '\",\"balance\":' || CAST(CAST(c_acctbal AS INT) AS STRING) || '}'", "customer_of"),
    ("Supplier", "4000000000000 + s_suppkey", "s_name", "'trade.' || r_name || '.' || n_name || '.' || s_name", "'{\"balance\":' || CAST(CAST(s_acctbal AS INT) AS STRING) || '}'", "supplier_of"),
    ("Part", "5000000000000 + p_partkey", "p_name", "'trade.parts.' || CAST(p_partkey AS STRING)", "'{\"brand\":\"' || p_brand || '\",\"type\":\"' || p_type || '\",\"size\":' || CAST(p_size AS STRING) || '}'", "part"),
    ("Order", "6000000000000 + o_orderkey", "'order ' || CAST(o_orderkey AS STRING)", "'trade.orders.' || CAST(o_orderkey AS STRING)", "'{\"status\":\"' || o_orderstatus || '\",\"priority\":\"' || o_orderpriority || '\"}'", "orders"),
]
_TRADE_EDGES = [
    ("IN_REGION", "2000000000000 + n_nationkey", "1000000000000 + n_regionkey", "nation", "TRUE"),
    ("IN_NATION", "3000000000000 + c_custkey", "2000000000000 + c_nationkey", "customer", "TRUE"),
    ("IN_NATION", "4000000000000 + s_suppkey", "2000000000000 + s_nationkey", "supplier", "TRUE"),
    ("PLACED", "3000000000000 + o_custkey", "6000000000000 + o_orderkey", "orders", "TRUE"),
    ("CONTAINS", "6000000000000 + l_orderkey", "5000000000000 + l_partkey", "lineitem", "TRUE"),
    ("SUPPLIED_BY", "5000000000000 + l_partkey", "4000000000000 + l_suppkey", "lineitem", "TRUE"),
]


def trade_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    t = lambda n: table(spark, sf_dir, n)
    places = t("nation").join(F.broadcast(t("region")), F.expr("n_regionkey = r_regionkey"))  # 25 rows
    source = {
        "nation_of": places,
        "customer_of": t("customer").join(places, F.expr("c_nationkey = n_nationkey")),
        "supplier_of": t("supplier").join(places, F.expr("s_nationkey = n_nationkey")),
    }
    nodes = None
    for label, key, name, qn, props, src in _TRADE:
        df = source.get(src, None) if src in source else t(src)
        df = df.selectExpr(f"CAST({key} AS BIGINT) AS id", "'trade' AS project", f"'{label}' AS label", f"{name} AS name", f"{qn} AS qualified_name", f"'{src.split('_')[0]}.tbl' AS file_path", "0 AS start_line", "0 AS end_line", f"{props} AS properties")
        nodes = df if nodes is None else nodes.unionByName(df)
    edges = None
    for type_, a, b, src, _ in _TRADE_EDGES:
        df = t(src).selectExpr(f"CAST({a} AS BIGINT) AS source_id", f"CAST({b} AS BIGINT) AS target_id", f"'{type_}' AS type")
        df = df.distinct() if src == "lineitem" else df
        edges = df if edges is None else edges.unionByName(df)
    edges = edges.select((F.xxhash64("source_id", "target_id", "type")).alias("id"), F.lit("trade").alias("project"), "source_id", "target_id", "type", F.lit("{}").alias("properties"))
    return PropertyGraph(nodes.select(*NODE_COLUMNS), edges.select(*EDGE_COLUMNS))


TRADE_SQL = (
    "nation_of AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey), customer_of AS (SELECT * FROM customer JOIN nation_of ON c_nationkey = n_nationkey), supplier_of AS (SELECT * FROM supplier JOIN nation_of ON s_nationkey = n_nationkey),\nnodes AS ("
    + " UNION ALL ".join(f"SELECT CAST({key} AS BIGINT) AS id, 'trade' AS project, '{label}' AS label, {name} AS name, {qn} AS qualified_name, '{src.split('_')[0]}.tbl' AS file_path, 0 AS start_line, 0 AS end_line, {props} AS properties FROM {src}" for label, key, name, qn, props, src in _TRADE)
    + "),\nedges AS ("
    + " UNION ALL ".join(f"SELECT {'DISTINCT' if src == 'lineitem' else ''} CAST({a} AS BIGINT) AS source_id, CAST({b} AS BIGINT) AS target_id, '{type_}' AS type FROM {src}" for type_, a, b, src, _ in _TRADE_EDGES)
    + ")"
)
