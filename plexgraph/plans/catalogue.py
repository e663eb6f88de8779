"""All registered queries of the graph engine and their SQL twins."""

from plexgraph.plans import basic_queries, cypher_queries, derived_queries, more_queries  # noqa: F401  (they register themselves)
from plexgraph.plans.cypher import execute
from plexgraph.plans.projection import trade_graph
from plexgraph.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "flagship"]


def flagship(spark, sf_dir):
    return execute(trade_graph(spark, sf_dir), cypher_queries.FLAGSHIP).df
