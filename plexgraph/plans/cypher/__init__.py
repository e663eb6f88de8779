"""A read-only openCypher subset compiled to DataFrame plans."""

from plexgraph.plans.cypher.parser import CypherError, UnsupportedCypher, parse
from plexgraph.plans.cypher.planner import CypherResult, execute, run_with_deadline, truncated

__all__ = ["CypherError", "CypherResult", "UnsupportedCypher", "execute", "parse", "run_with_deadline", "truncated"]
