"""Search: structural, BM25, vectors and lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexgraph.functions.scalar import camel_split, glob_to_like, with_case
from plexgraph.graph import PropertyGraph
from plexgraph.operators.lookup import degrees
from plexgraph.schema import flag

K1, B = 1.2, 0.75


def search_graph(g: PropertyGraph, label: str | None = None, name: str | None = None, qn: str | None = None, file: str | None = None, relationship: list[str] | None = None, direction: str = "any", min_degree: int = -1, max_degree: int = -1, exclude_entry_points: bool = False, exclude_labels: tuple = (), case_sensitive: bool = False, sort: str = "name", limit: int = 10, offset: int = 0, degree_types: tuple = ("CALLS", "INHERITS")) -> DataFrame:
    """Matching nodes with in_degree, out_degree and the total before paging; a total order by the sort key and id."""
    n = g.nodes
    if label:
        n = n.filter(F.col("label") == label)
    for column, pattern in (("name", name), ("qualified_name", qn)):
        if pattern:
            n = n.filter(F.col(column).rlike(with_case(pattern, case_sensitive)))
    if file:
        path, text = (F.col("file_path"), file) if case_sensitive else (F.lower("file_path"), file.lower())
        n = n.filter(path.like(glob_to_like(text)) if any(c in file for c in "*?") else F.contains(path, F.lit(text)))
    if exclude_labels:
        n = n.filter(~F.col("label").isin(*exclude_labels))
    if exclude_entry_points:
        n = n.filter(~flag("is_entry_point"))
    if relationship:
        e = g.of_type(*relationship)
        ends = {"out": [e.select(F.col("source_id").alias("id"))], "in": [e.select(F.col("target_id").alias("id"))]}
        ends["any"] = ends["out"] + ends["in"]
        for k, part in enumerate(ends[direction]):
            ids = part if k == 0 else ids.unionByName(part)  # noqa: F821
        n = n.join(ids.distinct(), "id", "left_semi")
    n = n.join(degrees(g, list(degree_types)), "id")
    degree = F.col("in_degree") + F.col("out_degree")
    if min_degree >= 0:
        n = n.filter(degree >= min_degree)
    if max_degree >= 0:
        n = n.filter(degree <= max_degree)
    total = n.agg(F.count(F.lit(1)).alias("total"))
    order = {"name": [F.asc("name")], "degree": [degree.desc(), F.asc("name")], "relevance": [degree.desc(), F.length("name"), F.asc("name")]}[sort]
    page = n.select("id", "label", "name", "qualified_name", "file_path", "in_degree", "out_degree").orderBy(*order, "id").offset(offset).limit(limit)
    return page.withColumn("total", total.scalar())


def terms(c: Column) -> Column:
    """Lower-cased runs of letters and digits, camel case split."""
    return F.filter(F.split(F.lower(camel_split(c)), "[^a-z0-9]+"), lambda t: t != "")


def inverted_index(docs: DataFrame) -> DataFrame:
    """docs (id, text) -> (term, id, tf, dl): one row for each term of a document."""
    t = docs.select("id", terms(F.col("text")).alias("terms"))
    return t.select("id", F.size("terms").alias("dl"), F.explode("terms").alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def bm25(docs: DataFrame, query: str, k: int = 10) -> DataFrame:
    """(id, score): the k best documents (id, text) for a query's terms.

    Only rows of the query's terms leave the scan of a document; the length of a document is counted beside them.
    """
    import re

    asked = sorted({t for t in re.split("[^a-z0-9]+", re.sub("([a-z])([A-Z])", r"\1 \2", query).lower()) if t})
    t = docs.select("id", terms(F.col("text")).alias("terms"))
    n, avgdl = t.agg(F.count(F.lit(1))).scalar(), t.agg(F.avg(F.size("terms"))).scalar()
    tf = t.select("id", F.size("terms").alias("dl"), F.explode(F.array(*[F.struct(F.lit(q).alias("term"), (F.size("terms") - F.size(F.array_remove("terms", q))).alias("tf")) for q in asked])).alias("h")).select("id", "dl", "h.*").filter("tf > 0")
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row for each term of the query
    rows = tf.join(F.broadcast(df), "term").withColumns({"n": n, "avgdl": avgdl})
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return rows.groupBy("id").agg(F.sum(part).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def vector_topk(vectors: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """(id, score): the k vectors (id, v) most alike by cosine."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("id", cosine(F.col("v"), q).alias("score")).filter("score IS NOT NULL").orderBy(F.desc("score"), "id").limit(k)


def search_lines(files: DataFrame, pattern: str, regex: bool = True, context: int = 1) -> DataFrame:
    """(id, line, text, before, after) of the matching lines of files (id, text). Context comes from the file's own array of lines, without a shuffle."""
    lines = files.select("id", F.split("text", "\n").alias("all"))
    rows = lines.select("id", "all", F.posexplode("all").alias("p", "text"))
    hit = rows.filter(F.col("text").rlike(pattern) if regex else F.contains("text", F.lit(pattern)))
    before = F.slice("all", F.greatest(F.lit(1), F.col("p") + 1 - context), F.least(F.lit(context), F.col("p")))
    return hit.select("id", (F.col("p") + 1).alias("line"), "text", F.array_join(before, "\n").alias("before"), F.array_join(F.slice("all", F.col("p") + 2, F.lit(context)), "\n").alias("after"))


def enclosing(nodes: DataFrame, hits: DataFrame) -> DataFrame:
    """hits (path, line) with the id of the narrowest definition around them, NULL outside all."""
    n = nodes.select(F.col("id").alias("node"), F.col("file_path").alias("path"), "start_line", "end_line")
    met = hits.join(n, (hits["path"] == n["path"]) & F.col("line").between(F.col("start_line"), F.col("end_line")), "left").drop(n["path"])
    w = Window.partitionBy("path", "line").orderBy(F.asc_nulls_last(F.col("end_line") - F.col("start_line")), "node")
    return met.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("path", "line", "node")


def snippet(files: DataFrame, nodes: DataFrame, qn: str) -> DataFrame:
    """Source lines of a definition, by its qualified name, else by the end of it, else by its name; files: (path, text)."""
    rank = F.when(F.col("qualified_name") == qn, 0).when(F.endswith("qualified_name", F.lit(f".{qn}")), 1).when(F.col("name") == qn, 2)
    told = nodes.withColumn("_rank", rank).filter("_rank IS NOT NULL")
    n = told.filter(F.col("_rank") == told.agg(F.min("_rank")).scalar())
    return n.join(files, n["file_path"] == files["path"]).select("qualified_name", F.array_join(F.slice(F.split("text", "\n"), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n").alias("source"))


def semantic_query(terms: DataFrame, weights: DataFrame, vectors: DataFrame, keywords: list[str], k: int = 10) -> DataFrame:
    """(id, score): vectors (id, v) nearest to the idf-weighted sum of the keywords' term vectors (term, v). The sum is one row."""
    asked = sorted({x.lower() for x in keywords})
    rows = terms.filter(F.col("term").isin(asked)).join(weights, "term").select("v", "idf").collect()
    if not rows:
        return vectors.select("id", F.lit(0.0).alias("score")).limit(0)
    merged = [sum(r.idf * r.v[i] for r in rows) for i in range(len(rows[0].v))]
    return vector_topk(vectors, merged, k)


def search_files(files: DataFrame, pattern: str, path_like: str | None = None, mode: str = "compact", limit: int = 100) -> DataFrame:
    """Text search by mode: ``files`` gives (id, n), ``compact`` (id, line, text), ``full`` with the lines around."""
    f = files.filter(F.col("id").like(glob_to_like(path_like))) if path_like else files
    hits = search_lines(f, pattern, context=3 if mode == "full" else 0)
    if mode == "files":
        return hits.groupBy("id").agg(F.count(F.lit(1)).alias("n")).orderBy("id").limit(limit)
    return (hits if mode == "full" else hits.select("id", "line", "text")).orderBy("id", "line").limit(limit)
