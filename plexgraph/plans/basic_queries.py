"""Queries of scalar functions, lookups, search and traversal, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from plexgraph.functions import scalar as S
from plexgraph.graph import PropertyGraph, dedup_edges, dedup_nodes
from plexgraph.operators import lookup, search, traverse
from plexgraph.plans.projection import CODE_SQL, code_edges, code_graph, code_nodes, table
from plexgraph.plans.registry import register
from plexgraph.schema import flag, prop
from plexgraph.shared import spread

WITH = f"WITH {CODE_SQL}\n"


def scalar(name: str, source: str, key: str, columns, sql: str) -> None:
    """A query that projects functions of one table's columns; columns() makes them, as that needs a session."""
    def run(spark, sf_dir):
        df = code_nodes(spark, sf_dir) if source == "nodes" else code_edges(spark, sf_dir) if source == "edges" else spread(table(spark, sf_dir, source))
        return df.select(key, *[c.alias(n) for n, c in columns().items()])

    register(f"scalar_{name}", (WITH if source in ("nodes", "edges") else "") + sql)(run)


c = F.col
register("graph_nodes", WITH + "SELECT * FROM nodes")(code_nodes)
register("graph_edges", WITH + "SELECT * FROM edges")(code_edges)

_CAMEL = "regexp_replace({}, '([a-z])([A-Z])', '\\1 \\2', 'g')"
_MIXED = "replace(p_name, ' ', CASE WHEN p_partkey % 2 = 0 THEN 'X' ELSE '_cfg.' END)"
scalar("camel_split", "part", "p_partkey", lambda: {"v": S.camel_split(F.expr(_MIXED))}, f"SELECT p_partkey, {_CAMEL.format(_MIXED)} AS v FROM part")
_PAIRS = [x.split() for x in S.ABBREVIATIONS.replace("\n", " ").split(",")]
_ABBR = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in _PAIRS) + "}"
scalar("identifier_tokens", "part", "p_partkey", lambda: {"v": F.array_join(S.identifier_tokens(F.expr(_MIXED)), "|")}, f"SELECT p_partkey, array_to_string(list_concat(t, [x FOR x IN [{_ABBR}[y] FOR y IN t] IF x IS NOT NULL]), '|') AS v FROM (SELECT p_partkey, [x FOR x IN string_split_regex(lower(regexp_replace({_CAMEL.format('regexp_replace(m, ' + chr(39) + '[./_ (),:-]' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, '[^A-Za-z0-9 ]', '', 'g')), ' +') IF x <> ''] AS t FROM (SELECT p_partkey, {_MIXED} AS m FROM part))")
scalar("decorator_tokens", "part", "p_partkey", lambda: {"v": F.array_join(S.decorator_tokens(F.concat(F.lit("@app.routeFor_"), F.expr("replace(p_name, ' ', '_')"), F.lit("('/x')"))), "|")}, "SELECT p_partkey, 'route|' || array_to_string([x FOR x IN string_split(p_name, ' ') IF x <> 'new'], '|') AS v FROM part")
scalar("config_key_norm", "part", "p_partkey", lambda: {"v": S.config_key_norm(F.expr(_MIXED))}, f"SELECT p_partkey, lower(replace(trim(regexp_replace({_CAMEL.format('regexp_replace(m, ' + chr(39) + '[_.-]' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, ' +', ' ', 'g')), ' ', '_')) AS v FROM (SELECT p_partkey, {_MIXED} AS m FROM part)")
scalar("glob_like", "nodes", "id", lambda: {"a": c("file_path").like(S.glob_to_like("**/*.py")), "b": c("file_path").like(S.glob_to_like("**/economy/**")), "d": c("file_path").like(S.glob_to_like("src/**")), "e": c("file_path").like(S.glob_to_like("src/large/brand?.go"))}, "SELECT id, file_path LIKE '%%.py' AS a, file_path LIKE '%economy%' AS b, file_path LIKE 'src%' AS d, file_path LIKE 'src/large/brand_.go' AS e FROM nodes")
scalar("qn_package", "nodes", "id", lambda: {"p": S.qn_package(c("qualified_name")), "t": S.qn_top_package(c("qualified_name")), "one": S.qn_package(c("name"))}, "SELECT id, CASE WHEN len(s) >= 4 THEN s[3] WHEN len(s) >= 2 THEN s[2] ELSE '' END AS p, CASE WHEN len(s) >= 2 THEN s[2] ELSE '' END AS t, '' AS one FROM (SELECT id, string_split(qualified_name, '.') AS s FROM nodes)")
scalar("test_path", "nodes", "id", lambda: {"p": S.is_test_path(c("file_path")), "f": S.is_test_file_path(F.concat(F.lit("testdata/"), c("file_path"))), "n": S.is_test_name(c("name")), "prod": S.test_to_prod_path(c("file_path"))}, f"SELECT id, regexp_matches(file_path, '{S.TEST_PATH}') AS p, true AS f, regexp_matches(name, '{S.TEST_NAME}') AS n, CASE WHEN suffix(file_path, '_test.go') THEN regexp_replace(file_path, '_test\\.go$', '.go') WHEN regexp_matches(file_path, '(^|/)test_[^/]*\\.py$') THEN regexp_replace(file_path, '(^|/)test_([^/]*\\.py)$', '\\1\\2') END AS prod FROM nodes")
_ROUTE = "'/api/' || lower(p_type) || CASE p_partkey % 5 WHEN 0 THEN '/:id' WHEN 1 THEN '/{{id}}/x' WHEN 2 THEN '/<int:id>' WHEN 3 THEN '/$' || '{{id}}' ELSE '/a:b' END".replace("{{", "{").replace("}}", "}")
scalar("route_canon", "part", "p_partkey", lambda: {"v": S.route_canon(F.expr(_ROUTE))}, "SELECT p_partkey, '/api/' || lower(p_type) || CASE p_partkey % 5 WHEN 0 THEN '/{}' WHEN 1 THEN '/{}/x' WHEN 2 THEN '/{}' WHEN 3 THEN '/{}' ELSE '/a:b' END AS v FROM part")
scalar("url_path", "pages", "page_id", lambda: {"v": S.url_path(c("url"))}, "SELECT page_id, regexp_extract(url, '^[^/]*/[^/]*/[^/]*(/[^?]*)', 1) AS v FROM pages")
scalar("template_match", "pages", "page_id", lambda: {"v": S.template_match(S.url_path(c("url")), F.lit("/en/{}")), "w": S.template_match(S.url_path(c("url")), F.lit("/{}/{}/"))}, "SELECT page_id, regexp_full_match(u, '/?en/[^/]+/*') AS v, regexp_full_match(u, '/?[^/]+/[^/]+/*') AS w FROM (SELECT page_id, regexp_extract(url, '^[^/]*/[^/]*/[^/]*(/[^?]*)', 1) AS u FROM pages)")
scalar("confidence_band", "edges", "id", lambda: {"v": S.confidence_band(prop("confidence").cast("double"))}, "SELECT id, CASE WHEN k >= 0.7 THEN 'high' WHEN k >= 0.45 THEN 'medium' WHEN k >= 0.25 THEN 'speculative' ELSE '' END AS v FROM (SELECT id, CAST(json_extract_string(properties, '$.confidence') AS DOUBLE) AS k FROM edges)")
scalar("risk_label", "nodes", "id", lambda: {"v": S.risk(c("id") % 7)}, "SELECT id, CASE WHEN id % 7 <= 1 THEN 'CRITICAL' WHEN id % 7 = 2 THEN 'HIGH' WHEN id % 7 = 3 THEN 'MEDIUM' ELSE 'LOW' END AS v FROM nodes")
scalar("json_props", "nodes", "id", lambda: {"k": prop("complexity").cast("int"), "e": flag("is_entry_point"), "bad": prop("x", F.lit("no json"))}, "SELECT id, CAST(json_extract_string(properties, '$.complexity') AS INT) AS k, coalesce(json_extract_string(properties, '$.is_entry_point') = 'true', false) AS e, CAST(NULL AS VARCHAR) AS bad FROM nodes")
scalar("proximity", "nodes", "id", lambda: {"v": F.round(S.proximity(c("file_path"), F.lit("src/economy/brand1.py")), 6)}, "SELECT id, round(1 + 0.1 * CASE WHEN p[1] = 'src' THEN CASE WHEN p[2] = 'economy' THEN 2 ELSE 1 END ELSE 0 END / 2.0, 6) AS v FROM (SELECT id, string_split(file_path, '/') AS p FROM nodes)")
_FILES = "concat('pkg/', lower(p_type), CASE p_partkey % 6 WHEN 0 THEN '/__init__.py' WHEN 1 THEN '/index.ts' WHEN 2 THEN '/a.test.js' WHEN 3 THEN '\\\\b.go' WHEN 4 THEN '//.env.local' ELSE '' END)"
_NAMES = "CASE p_partkey % 4 WHEN 0 THEN '__file__' WHEN 1 THEN '' ELSE p_brand END"
scalar(
    "fqn", "part", "p_partkey",
    lambda: {"v": S.fqn(F.lit("proj"), F.expr(_FILES), F.expr(_NAMES)), "module": S.fqn(F.lit("proj"), F.expr(_FILES)), "folder": S.fqn_folder(F.lit("proj"), F.expr(_FILES)), "project": S.project_name(F.expr(_FILES))},
    f"""WITH p AS (SELECT p_partkey, replace({_FILES.replace(chr(92) * 2, chr(92))}, '\\', '/') AS f, {_NAMES} AS n, {_FILES.replace(chr(92) * 2, chr(92))} AS raw FROM part),
q AS (SELECT *, [x FOR x IN string_split(f, '/') IF x <> ''] AS whole, [x FOR x IN string_split(regexp_replace(f, '\\.[^./]*$', ''), '/') IF x <> ''] AS bare FROM p),
r AS (SELECT *, CASE WHEN n = '__file__' THEN whole WHEN n <> '' AND bare[-1] IN ('__init__', 'index') THEN bare[:-2] ELSE bare END AS own FROM q)
SELECT p_partkey, array_to_string(['proj'] || own || CASE WHEN n = '' THEN [] ELSE [n] END, '.') AS v, array_to_string(['proj'] || bare, '.') AS module, array_to_string(['proj'] || whole, '.') AS folder,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '[^A-Za-z0-9._-]', '-', 'g'), '-+', '-', 'g'), '\\.+', '.', 'g'), '^[.-]+|-+$', '', 'g') AS project FROM r""",
)
scalar("secrets", "documents", "doc_id", lambda: {"v": S.is_secret(c("source"), c("text"))}, f"SELECT doc_id, coalesce(regexp_matches(lower(source), '{'|'.join(S.SECRET_KEYS)}'), false) OR coalesce(regexp_matches(text, '{S.SECRET_VALUES}'), false) AS v FROM documents")
scalar("names", "orders", "o_orderkey", lambda: {"env": S.is_env_var_name(c("o_orderpriority")), "cfg": S.has_config_extension(F.concat(F.lit("a/b."), F.lower("o_orderstatus"), F.lit("/x.yml"))), "exc": S.is_checked_exception(c("o_orderpriority"))}, "SELECT o_orderkey, regexp_matches(o_orderpriority, '^[A-Z0-9_]{2,}$') AND regexp_matches(o_orderpriority, '[A-Z]') AS env, true AS cfg, NOT regexp_matches(o_orderpriority, 'Error|Panic') AS exc FROM orders")
scalar("sha256", "nodes", "id", lambda: {"v": F.sha2(c("qualified_name"), 256)}, "SELECT id, sha256(qualified_name) AS v FROM nodes")
scalar("minhash_hex", "part", "p_partkey", lambda: {"v": S.minhash_hex(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: c("p_partkey") * 64 + k)), "back": F.element_at(S.minhash_from_hex(S.minhash_hex(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: c("p_partkey") * 64 + k))), 64)}, "SELECT p_partkey, array_to_string([lower(printf('%08x', p_partkey * 64 + k)) FOR k IN range(64)], '') AS v, p_partkey * 64 + 63 AS back FROM part")


# lookups

def on_code(name: str, sql: str | None):
    def put(f):
        register(name, WITH + sql if sql else None)(lambda spark, sf_dir: f(code_graph(spark, sf_dir)))
        return f

    return put


_DEGREE = "(SELECT n.id, count(*) FILTER (e.t = 'i') AS i, count(*) FILTER (e.t = 'o') AS o FROM nodes n LEFT JOIN (SELECT target_id AS id, 'i' AS t FROM edges WHERE {0} UNION ALL SELECT source_id, 'o' FROM edges WHERE {0}) e ON e.id = n.id GROUP BY n.id)"
_D_CALLS = _DEGREE.format("type = 'CALLS'")
_D_BOTH = _DEGREE.format("type IN ('CALLS', 'INHERITS')")
on_code("lookup_degree_calls", f"SELECT id, i AS in_degree, o AS out_degree FROM {_D_CALLS}")(lambda g: lookup.degrees(g, ["CALLS"]))
on_code("lookup_qn_suffix", "SELECT id FROM nodes WHERE qualified_name = 'brand7.red_widget1' OR suffix(qualified_name, '.red_widget1') OR suffix(qualified_name, '.small_ring13')")(lambda g: lookup.by_qn_suffix(g.nodes, "red_widget1").unionByName(lookup.by_qn_suffix(g.nodes, "small_ring13")).select("id"))
on_code("lookup_lines", "SELECT id FROM nodes WHERE file_path = 'src/economy/brand2.go' AND start_line <= 300 AND end_line >= 100")(lambda g: lookup.in_lines(g.nodes, "src/economy/brand2.go", 100, 300).select("id"))
_HUNKS = "SELECT file_path AS path, min(start_line) + 3 AS start_line, min(start_line) + 40 AS end_line FROM nodes WHERE label = 'Interface' GROUP BY file_path"


def hunks(g: PropertyGraph):
    return g.nodes.filter("label = 'Interface'").groupBy(F.col("file_path").alias("path")).agg((F.min("start_line") + 3).alias("start_line"), (F.min("start_line") + 40).alias("end_line"))


on_code("lookup_range_overlap", f"SELECT n.id FROM nodes n WHERE EXISTS (SELECT 1 FROM ({_HUNKS}) h WHERE h.path = n.file_path AND n.start_line <= h.end_line AND n.end_line >= h.start_line)")(lambda g: lookup.in_hunks(g.nodes, hunks(g)).select("id"))
on_code("lookup_qn_to_id", "SELECT x.q AS qualified_name, n.id FROM (SELECT CASE WHEN id % 2 = 0 THEN qualified_name ELSE qualified_name || '?' END AS q FROM nodes) x LEFT JOIN nodes n ON n.qualified_name = x.q")(lambda g: lookup.qn_to_id(g.nodes, g.nodes.select(F.when(c("id") % 2 == 0, c("qualified_name")).otherwise(F.concat("qualified_name", F.lit("?"))).alias("qualified_name"))))
on_code("lookup_dependent_files", "SELECT DISTINCT s.file_path FROM edges e JOIN nodes t ON t.id = e.target_id AND t.file_path = 'src/small/brand3.py' JOIN nodes s ON s.id = e.source_id WHERE s.file_path <> 'src/small/brand3.py'")(lambda g: lookup.dependent_files(g, ["src/small/brand3.py"]))
on_code("lookup_neighbour_names", "SELECT coalesce(a.id, b.id) AS id, a.v AS callers, b.v AS callees FROM (SELECT e.target_id AS id, array_to_string(list_slice(list_sort(list(DISTINCT n.name)), 1, 10), '|') AS v FROM edges e JOIN nodes n ON n.id = e.source_id WHERE type IN ('CALLS', 'HTTP_CALLS', 'ASYNC_CALLS') GROUP BY 1) a FULL JOIN (SELECT e.source_id AS id, array_to_string(list_slice(list_sort(list(DISTINCT n.name)), 1, 10), '|') AS v FROM edges e JOIN nodes n ON n.id = e.target_id WHERE type IN ('CALLS', 'HTTP_CALLS', 'ASYNC_CALLS') GROUP BY 1) b ON a.id = b.id")(lambda g: lookup.neighbour_names(g).select("id", F.array_join("callers", "|").alias("callers"), F.array_join("callees", "|").alias("callees")))
on_code("lookup_callable_edges", "SELECT e.id, source_id, target_id, (SELECT count(*) FROM edges e JOIN nodes a ON a.id = source_id JOIN nodes b ON b.id = target_id WHERE type = 'CALLS' AND a.label IN ('Function', 'Method') AND b.label IN ('Function', 'Method')) > 100 AS truncated FROM edges e JOIN nodes a ON a.id = source_id JOIN nodes b ON b.id = target_id WHERE type = 'CALLS' AND a.label IN ('Function', 'Method') AND b.label IN ('Function', 'Method') ORDER BY e.id LIMIT 100")(lambda g: lookup.callable_edges(g, 100))
on_code("lookup_scoped_counts", "SELECT 'node' AS kind, label AS value, count(*) AS n FROM nodes WHERE file_path LIKE 'src/economy/%' GROUP BY label UNION ALL SELECT 'edge', type, count(*) FROM edges JOIN nodes n ON n.id = source_id WHERE file_path LIKE 'src/economy/%' GROUP BY type")(lambda g: lookup.counts(g, "src/economy/"))
on_code("lookup_edges_by_url", "SELECT id FROM edges WHERE contains(json_extract_string(properties, '$.url_path'), '/api/7/')")(lambda g: lookup.edges_by_url(g.edges, "/api/7/").select("id"))
on_code("lookup_distinct_files", "SELECT DISTINCT file_path FROM nodes")(lambda g: g.nodes.select("file_path").distinct())
on_code("lookup_coverage", "SELECT DISTINCT file_path AS rel_path, 'parsed' AS kind FROM nodes WHERE file_path LIKE 'src/large/%' UNION ALL SELECT 'src', 'dir'")(lambda g: lookup.coverage_of(g.nodes.select(F.col("file_path").alias("rel_path"), F.lit("parsed").alias("kind")).distinct().unionByName(g.nodes.limit(1).select(F.lit("src").alias("rel_path"), F.lit("dir").alias("kind"))), "src/large/"))


# graph maintenance

def doubled(g: PropertyGraph) -> PropertyGraph:
    n = g.nodes.withColumn("qualified_name", F.concat("project", F.lit(".q"), (F.col("id") % 400).cast("string")))
    return PropertyGraph(n, g.edges.withColumn("target_id", F.col("target_id") % 40).withColumn("source_id", F.col("source_id") % 40))


on_code("graph_node_dedup", "SELECT id, qualified_name FROM (SELECT *, row_number() OVER (PARTITION BY project, qualified_name ORDER BY file_path, start_line DESC, name DESC, label DESC, id) AS k FROM (SELECT id, project, project || '.q' || CAST(id % 400 AS VARCHAR) AS qualified_name, file_path, start_line, name, label FROM nodes)) WHERE k = 1")(lambda g: dedup_nodes(doubled(g).nodes).select("id", "qualified_name"))
on_code("graph_edge_dedup", "SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY source_id % 40, target_id % 40, type ORDER BY CAST(json_extract_string(properties, '$.confidence') AS DOUBLE) DESC, properties DESC, id) AS k FROM edges) WHERE k = 1")(lambda g: dedup_edges(doubled(g).edges).select("id"))
on_code("graph_orphan_edges", "SELECT id FROM edges WHERE source_id % 3 <> 0 AND target_id % 3 <> 0")(lambda g: PropertyGraph(g.nodes.filter("id % 3 <> 0"), g.edges).without_orphans().edges.select("id"))
on_code("graph_delete_cascade", "SELECT id FROM edges WHERE source_id NOT IN (SELECT id FROM nodes WHERE label = 'Class') AND target_id NOT IN (SELECT id FROM nodes WHERE label = 'Class')")(lambda g: g.without_nodes(g.nodes.filter("label = 'Class'")).edges.select("id"))
on_code("graph_merge", "SELECT source_id AS a, target_id AS b, type AS t FROM edges")(lambda g: g.merged(PropertyGraph(g.nodes.withColumn("id", F.col("id") + 1_000_000), g.edges.withColumns({"source_id": F.col("source_id") + 1_000_000, "target_id": F.col("target_id") + 1_000_000}))).edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.col("type").alias("t")))


# search

_FOUND = "SELECT n.id, label, name, qualified_name, file_path, i AS in_degree, o AS out_degree, count(*) OVER () AS total FROM nodes n JOIN " + _D_BOTH + " d ON d.id = n.id"
on_code("search_name_regex", f"{_FOUND} WHERE regexp_matches(name, '(?i)SMALL.*7$') ORDER BY name, n.id LIMIT 10")(lambda g: search.search_graph(g, name="SMALL.*7$"))
on_code("search_paged_total", f"{_FOUND} WHERE label = 'Function' AND lower(file_path) LIKE 'src%.py' ORDER BY name, n.id LIMIT 15 OFFSET 20")(lambda g: search.search_graph(g, label="Function", file="src/**/*.py", limit=15, offset=20))
on_code("search_degree_filter", f"{_FOUND} WHERE i + o >= 4 AND i + o <= 6 AND label <> 'Class' ORDER BY i + o DESC, name, n.id LIMIT 25")(lambda g: search.search_graph(g, min_degree=4, max_degree=6, exclude_labels=("Class",), sort="degree", limit=25))
on_code("search_relationship", f"{_FOUND} WHERE n.id IN (SELECT source_id FROM edges WHERE type = 'HTTP_CALLS') AND json_extract_string(properties, '$.is_entry_point') IS NULL ORDER BY name, n.id LIMIT 30")(lambda g: search.search_graph(g, relationship=["HTTP_CALLS"], direction="out", exclude_entry_points=True, limit=30))
register("search_bm25", "WITH t AS (SELECT doc_id AS id, [x FOR x IN string_split_regex(lower(regexp_replace(text, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+') IF x <> ''] AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS a FROM t), h AS (SELECT id, len(t) AS dl, q, len(list_filter(t, lambda x: x = q)) AS tf FROM t, (VALUES ('erha'), ('license'), ('on'), ('the')) v(q)), d AS (SELECT q, count(*) AS df FROM h WHERE tf > 0 GROUP BY q) SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 9) AS score FROM h JOIN d USING (q), s WHERE tf > 0 GROUP BY id ORDER BY sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) DESC, id LIMIT 10")(lambda spark, d: search.bm25(spread(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")), "erha license onThe").withColumn("score", F.round("score", 9)))
_QUERY = [((k * 37) % 17 - 8) / 8 for k in range(64)]
register("search_vector_topk", f"SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_QUERY}), 9) AS score FROM embeddings ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_QUERY}) DESC, vec_id LIMIT 10")(lambda spark, d: search.vector_topk(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), _QUERY).withColumn("score", F.round("score", 9)))
register("search_code_context", "WITH l AS (SELECT conv_id * 1000 + turn AS id, string_split(text, chr(10)) AS w FROM conversations), x AS (SELECT id, w, unnest(range(1, len(w) + 1)) AS k FROM l) SELECT id, CAST(k AS INT) AS line, w[k] AS text, CASE WHEN k > 1 THEN w[k - 1] ELSE '' END AS before, coalesce(w[k + 1], '') AS after FROM x WHERE regexp_matches(w[k], '(tion|ung)\\.$')")(lambda spark, d: search.search_lines(table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"), r"(tion|ung)\.$"))
on_code("search_enclosing", "SELECT path, line, id AS node FROM (SELECT h.path, h.line, n.id, row_number() OVER (PARTITION BY h.path, h.line ORDER BY n.end_line - n.start_line NULLS LAST, n.id) AS k FROM (SELECT DISTINCT file_path AS path, start_line + 5 AS line FROM nodes) h LEFT JOIN nodes n ON n.file_path = h.path AND h.line BETWEEN n.start_line AND n.end_line) WHERE k = 1")(lambda g: search.enclosing(g.nodes, g.nodes.select(F.col("file_path").alias("path"), (F.col("start_line") + 5).alias("line")).distinct()))


# traversal

def _bfs_sql(seeds: str, depth: int, types: str = "'CALLS'", a: str = "source_id", b: str = "target_id") -> str:
    return f"seeds AS ({seeds}), walk AS (SELECT id, 0 AS hop FROM seeds UNION SELECT e.{b}, hop + 1 FROM walk JOIN edges e ON e.{a} = walk.id AND e.type IN ({types}) WHERE hop < {depth}), seen AS (SELECT id, min(hop) AS hop FROM walk GROUP BY id HAVING min(hop) > 0)"


def on_walk(name: str, walk: str, sql: str):
    def put(f):
        register(name, f"WITH RECURSIVE {CODE_SQL}, {walk}\n{sql}")(lambda spark, sf_dir: f(code_graph(spark, sf_dir)))
        return f

    return put


_ONE, _MANY = "SELECT id FROM nodes WHERE id = 7", "SELECT id FROM nodes WHERE json_extract_string(properties, '$.is_entry_point') = 'true'"
one = lambda g: g.nodes.filter("id = 7").select("id")
many = lambda g: g.nodes.filter(flag("is_entry_point")).select("id")
on_walk("traverse_bfs_out", _bfs_sql(_ONE, 4), "SELECT id, hop FROM seen")(lambda g: traverse.bfs(g, one(g), max_depth=4))
on_walk("traverse_bfs_in", _bfs_sql(_ONE, 3, a="target_id", b="source_id"), "SELECT id, hop FROM seen")(lambda g: traverse.bfs(g, one(g), direction="inbound", max_depth=3))
on_walk("traverse_bfs_multi", _bfs_sql(_MANY, 3, "'CALLS', 'HTTP_CALLS'"), "SELECT id, hop FROM seen")(lambda g: traverse.bfs(g, many(g), ("CALLS", "HTTP_CALLS"), max_depth=3))
on_walk("traverse_trace_risk", _bfs_sql(_ONE, 5), "SELECT s.id, qualified_name, hop, CASE hop WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM seen s JOIN nodes n USING (id)")(lambda g: traverse.trace(g, one(g), depth=5))
on_walk("traverse_visited_edges", _bfs_sql(_ONE, 2), "SELECT e.id FROM edges e WHERE type = 'CALLS' AND source_id IN (SELECT id FROM seen UNION SELECT 7) AND target_id IN (SELECT id FROM seen UNION SELECT 7)")(lambda g: traverse.visited_edges(g, one(g), traverse.bfs(g, one(g), max_depth=2)).select("id"))
on_walk("traverse_impact_summary", _bfs_sql(_MANY, 4, a="target_id", b="source_id"), "SELECT count(*) FILTER (hop = 1) AS critical, count(*) FILTER (hop = 2) AS high, count(*) FILTER (hop = 3) AS medium, count(*) FILTER (hop > 3) AS low, count(*) AS total, true AS has_cross_service FROM seen")(lambda g: traverse.impact_summary(traverse.bfs(g, many(g), direction="inbound", max_depth=4), g.edges))
on_walk("traverse_detect_changes", _bfs_sql(f"SELECT n.id FROM nodes n WHERE EXISTS (SELECT 1 FROM ({_HUNKS}) h WHERE h.path = n.file_path AND n.start_line <= h.end_line AND n.end_line >= h.start_line)", 3, a="target_id", b="source_id"), "SELECT string_split(qualified_name, '.')[3] AS module, CASE hop WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' ELSE 'MEDIUM' END AS risk, count(*) AS impacted FROM seen JOIN nodes USING (id) GROUP BY ALL")(lambda g: traverse.detect_changes(g, hunks(g)))
on_walk("traverse_call_depth", _bfs_sql("SELECT id FROM nodes WHERE id NOT IN (SELECT target_id FROM edges WHERE type = 'CALLS')", 15), "SELECT n.id, coalesce(hop, 0) AS depth FROM nodes n LEFT JOIN seen USING (id)")(traverse.call_depth)
on_code("traverse_dead_code", f"SELECT n.id, CASE WHEN label NOT IN ('Function', 'Method') THEN 'structural' WHEN regexp_matches(file_path, '{S.TEST_PATH}') THEN 'test' WHEN json_extract_string(properties, '$.is_entry_point') = 'true' THEN 'entry' WHEN c IS NULL THEN 'dead' WHEN c = 1 THEN 'single' ELSE 'normal' END AS status FROM nodes n LEFT JOIN (SELECT target_id AS id, count(DISTINCT source_id) AS c FROM edges WHERE type IN ('CALLS', 'USAGE', 'CALL_REFERENCE') GROUP BY 1) USING (id)")(traverse.dead_code)
