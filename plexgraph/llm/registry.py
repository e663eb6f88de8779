"""Queries of the training-data operators."""

from plexgraph.llm import decontaminate, ivfpq, langid, mixture, separators, simhash, suffixarray, suffixtree, tokenfile, toxicity

QUERIES = {}
ORACLE = {}
for _m in (toxicity, separators, ivfpq, langid, tokenfile, decontaminate, suffixarray, simhash, suffixtree, mixture):
    QUERIES |= _m.QUERIES
    ORACLE |= _m.ORACLE
