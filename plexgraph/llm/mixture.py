"""Op 10 [native]. Mixing sources to target weights by iterative proportional fitting.

Documents are summed to cells of (source, lang, topic) with their tokens; raking
multiplies the weights of the cells so that in turn the weighted tokens of each
source, each language and each topic reach their target shares. A document is
then drawn with the probability ``rate`` x weight of its cell, where ``rate`` is
lowered to 1 / largest weight if it must be, so that no probability is cut off
and the drawn tokens meet the raked marginals in expectation. The draw compares
the probability with a hash of the doc_id: it is repeatable. All of it are
DataFrame operations; what is iterated over is the table of cells.

A document's topic is a rule on its text (``TOPIC``) unless the caller gives
another column. Targets default to each value's share of the tokens raised to
``TEMPER`` (below 1: small sources and languages gain), and topics to their share
as it is.

Nulls: a null source or lang is a value of its own, shown as null; a null text
has no tokens and topic 'none'; a null doc_id is drawn like the text ''. Rows
with equal doc_id in one cell share their fate. Cells without tokens keep weight
1. Empty tables give no rows. Other columns pass through ``mix`` untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexgraph.llm.common import quoted, stored

SWEEPS = 6
RATE = 1.0
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 1.0}
SALT = "mix-1:"

#: Patterns of the topics, tried in this order.
TOPICS = {"legal": "(?i)licen[sc]e|copyright", "contact": "@"}
LISTS_PER_CHAR = 1 / 60
_NULL = "\u0001"


def n_tokens(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def topic(text: F.Column) -> F.Column:
    rule = F.when(text.isNull() | (text == ""), "none")
    for name, pattern in TOPICS.items():
        rule = rule.when(text.rlike(pattern), name)
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n")))
    return rule.when(lines > F.length(text) * LISTS_PER_CHAR, "lists").otherwise("prose")


def default_targets(cells: DataFrame, temper: dict = TEMPER) -> dict[str, DataFrame]:
    """For each margin: (value, share)."""
    out = {}
    for c, power in temper.items():
        part = cells.groupBy(F.col(c).alias("value")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("p"))
        out[c] = part.select("value", (F.col("p") / part.agg(F.sum("p")).scalar()).alias("share"))
    return out


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS) -> DataFrame:
    """cells (margins..., tokens) with a weight; written to the shared folder after each step."""
    total = cells.agg(F.sum("tokens").cast("double")).first()[0] or 0.0
    cur = cells.withColumn("weight", F.lit(1.0))
    goals = {c: stored(t) for c, t in targets.items()}
    for _ in range(sweeps):
        for c, goal in goals.items():
            have = cur.groupBy(F.col(c).alias("value")).agg(F.sum(F.col("tokens") * F.col("weight")).alias("have"))
            factor = have.join(goal, "value", "left").select(F.col("value").alias(c), F.when(F.col("have") > 0, F.coalesce("share", F.lit(0.0)) * total / F.col("have")).otherwise(1.0).alias("factor"))
            cur = stored(cur.join(factor, c).withColumn("weight", F.col("weight") * F.col("factor")).select(*cells.columns, "weight"))
    return cur


def _drawn(docs: DataFrame, targets: dict[str, DataFrame] | None = None, topic_col: str | None = None, sweeps: int = SWEEPS, rate: float = RATE) -> DataFrame:
    """(own, _topic, _tokens, _weight, _probability, _selected); own holds all columns of docs."""
    text, name = F.col("text").cast("string"), lambda c: F.coalesce(F.col(c).cast("string"), F.lit(_NULL))
    told = docs.select(
        F.struct(F.col("*")).alias("own"), (name(topic_col) if topic_col else topic(text)).alias("_topic"), n_tokens(text).alias("_tokens"), name("source").alias("_source"), name("lang").alias("_lang"),
    )
    cells = stored(told.groupBy(F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic")).agg(F.sum("_tokens").alias("tokens")))
    raked = rake(cells, targets or default_targets(cells), sweeps)
    most = raked.filter("tokens > 0").agg(F.max("weight")).first()[0] or 1.0
    p = F.least(F.lit(1.0), F.col("weight") * min(rate, 1.0 / most))
    share = raked.select(F.col("source").alias("_source"), F.col("lang").alias("_lang"), F.col("topic").alias("_topic"), F.col("weight").alias("_weight"), p.alias("_probability"))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(SALT), F.coalesce(F.col("own.doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    return told.join(share, ["_source", "_lang", "_topic"]).withColumn("_selected", draw < F.col("_probability")).drop("_source", "_lang")


_ADDED = ("_topic", "_tokens", "_weight", "_probability", "_selected")


def probabilities(docs: DataFrame, **how) -> DataFrame:
    """docs with _topic, _tokens, _weight, _probability and _selected, which replace columns of those names."""
    return _drawn(docs, **how).select(*[F.col(f"own.{quoted(c)}") for c in docs.columns if c.lower() not in _ADDED], *_ADDED)


def mix(docs: DataFrame, **how) -> DataFrame:
    """The drawn documents, with their own columns as they are."""
    return _drawn(docs, **how).filter("_selected").select("own.*")


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    out = probabilities(docs)
    return out.select("doc_id", "source", "lang", F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), F.round("_weight", 6).alias("weight"), F.round("_probability", 6).alias("probability"), F.col("_selected").alias("selected"))


QUERIES = {"op10_mixture": op10_mixture}


def _oracle() -> str:
    rules = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in TOPICS.items())
    parts = [
        f"""d AS (SELECT doc_id, source, lang, coalesce(source, '\u0001') AS s, coalesce(lang, '\u0001') AS l,
  CASE WHEN text IS NULL OR text = '' THEN 'none' {rules}
       WHEN length(text) - length(replace(text, chr(10), '')) > length(text) * {LISTS_PER_CHAR!r} THEN 'lists' ELSE 'prose' END AS t,
  CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0) AS BIGINT) AS n FROM documents)""",
        "c0 AS MATERIALIZED (SELECT s, l, t, CAST(sum(n) AS DOUBLE) AS n, CAST(1 AS DOUBLE) AS w FROM d GROUP BY ALL)",
        "total AS MATERIALIZED (SELECT sum(n) AS total FROM c0)",
    ]
    for c, m in (("source", "s"), ("lang", "l"), ("topic", "t")):
        parts.append(f"g_{m} AS MATERIALIZED (SELECT {m}, p / sum(p) OVER () AS share FROM (SELECT {m}, pow(sum(n), {TEMPER[c]}) AS p FROM c0 GROUP BY {m}))")
    k = 0
    for _ in range(SWEEPS):
        for m in "slt":
            parts.append(f"c{k + 1} AS MATERIALIZED (SELECT s, l, t, n, w * CASE WHEN have > 0 THEN share * (SELECT total FROM total) / have ELSE 1 END AS w FROM (SELECT *, sum(n * w) OVER (PARTITION BY {m}) AS have FROM c{k}) JOIN g_{m} USING ({m}))")
            k += 1
    return f"""WITH {", ".join(parts)}, r AS (SELECT least({RATE}, 1 / max(w)) AS rate FROM c{k} WHERE n > 0)
SELECT doc_id, source, lang, d.t AS topic, d.n AS n_tokens, round(w, 6) AS weight, round(least(1.0, w * rate), 6) AS probability,
  CAST(('0x' || substr(md5('{SALT}' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0 < least(1.0, w * rate) AS selected
FROM d JOIN c{k} c ON d.s = c.s AND d.l = c.l AND d.t = c.t, r"""


ORACLE = {"op10_mixture": _oracle()}
