"""Queries in the graph language, each with its SQL twin."""

from __future__ import annotations

from plexgraph.plans.cypher import execute
from plexgraph.plans.projection import CODE_SQL, TRADE_SQL, code_graph, trade_graph
from plexgraph.plans.registry import register

FLAGSHIP = "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.status = 'F' RETURN c.name AS name, count(o) AS n ORDER BY n DESC, name LIMIT 10"


def cypher(name: str, text: str, sql: str, graph: str = "code") -> None:
    base, build = (CODE_SQL, code_graph) if graph == "code" else (TRADE_SQL, trade_graph)
    register(f"cypher_{name}", f"WITH {base}\n{sql}")(lambda spark, sf_dir: execute(build(spark, sf_dir), text, max_rows=-1).df)


def _j(key: str, of: str = "n") -> str:
    return f"json_extract_string({of}.properties, '$.{key}')"


cypher("flagship", FLAGSHIP, f"SELECT c.name, count(*) AS n FROM nodes c JOIN edges e ON e.source_id = c.id AND e.type = 'PLACED' JOIN nodes o ON o.id = e.target_id AND o.label = 'Order' WHERE c.label = 'Customer' AND {_j('status', 'o')} = 'F' GROUP BY c.name ORDER BY n DESC, c.name LIMIT 10", "trade")
cypher("scan_label", "MATCH (n:Class) RETURN n.id AS id, n.name AS name", "SELECT id, name FROM nodes WHERE label = 'Class'")
cypher("label_alternation", "MATCH (n:Class|Interface) RETURN n.label AS label, count(*) AS n", "SELECT label, count(*) AS n FROM nodes WHERE label IN ('Class', 'Interface') GROUP BY label")
cypher("inline_props", 'MATCH (n:Function {brand: "Brand#7", loop_depth: 2}) RETURN n.qualified_name AS qn', f"SELECT qualified_name AS qn FROM nodes n WHERE label = 'Function' AND {_j('brand')} = 'Brand#7' AND CAST({_j('loop_depth')} AS INT) = 2")
cypher("expand_out", "MATCH (a:Function)-[r:CALLS]->(b:Method) RETURN a.id AS a, b.id AS b, r.line AS line", f"SELECT a.id AS a, b.id AS b, {_j('line', 'e')} AS line FROM nodes a JOIN edges e ON e.source_id = a.id AND e.type = 'CALLS' JOIN nodes b ON b.id = e.target_id WHERE a.label = 'Function' AND b.label = 'Method'")
cypher("expand_in", "MATCH (a:Class)<-[:INHERITS|USAGE]-(b) RETURN a.id AS a, b.id AS b", "SELECT a.id AS a, e.source_id AS b FROM nodes a JOIN edges e ON e.target_id = a.id AND e.type IN ('INHERITS', 'USAGE') WHERE a.label = 'Class'")
cypher("expand_any", "MATCH (a:Interface)-[:CALLS]-(b) RETURN a.id AS a, count(b) AS n", "SELECT a.id AS a, count(*) AS n FROM nodes a JOIN (SELECT source_id AS f FROM edges WHERE type = 'CALLS' UNION ALL SELECT target_id FROM edges WHERE type = 'CALLS') e ON e.f = a.id WHERE a.label = 'Interface' GROUP BY a.id")
cypher("two_hop", "MATCH (a:Class)-[:CALLS]->(b)-[:CALLS]->(c:Class) RETURN a.id AS a, b.id AS b, c.id AS c", "SELECT a.id AS a, e.target_id AS b, c.id AS c FROM nodes a JOIN edges e ON e.source_id = a.id AND e.type = 'CALLS' JOIN edges f ON f.source_id = e.target_id AND f.type = 'CALLS' AND f.id <> e.id JOIN nodes c ON c.id = f.target_id WHERE a.label = 'Class' AND c.label = 'Class'")
cypher("var_length_1_3", "MATCH (a:Interface)-[:CALLS*1..3]->(b:Class) RETURN a.id AS a, b.id AS b", f", r1 AS (SELECT DISTINCT a.id AS s, e.target_id AS t FROM nodes a JOIN edges e ON e.source_id = a.id AND e.type = 'CALLS' WHERE a.label = 'Interface'), r2 AS (SELECT DISTINCT s, e.target_id AS t FROM r1 JOIN edges e ON e.source_id = r1.t AND e.type = 'CALLS'), r3 AS (SELECT DISTINCT s, e.target_id AS t FROM r2 JOIN edges e ON e.source_id = r2.t AND e.type = 'CALLS') SELECT DISTINCT s AS a, t AS b FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3) x JOIN nodes n ON n.id = t AND n.label = 'Class' WHERE s <> t".lstrip())
cypher("var_length_2_2", "MATCH (a:Interface)-[:CALLS*2]->(b) RETURN a.id AS a, count(b) AS n", ", r1 AS (SELECT DISTINCT a.id AS s, e.target_id AS t FROM nodes a JOIN edges e ON e.source_id = a.id AND e.type = 'CALLS' WHERE a.label = 'Interface'), r2 AS (SELECT DISTINCT s, e.target_id AS t FROM r1 JOIN edges e ON e.source_id = r1.t AND e.type = 'CALLS') SELECT s AS a, count(*) AS n FROM (SELECT * FROM r2 WHERE s <> t EXCEPT SELECT * FROM r1) GROUP BY s")
cypher("optional_match_dead", "MATCH (f:Function) OPTIONAL MATCH (c)-[:CALLS]->(f) WITH f, c WHERE c IS NULL RETURN f.id AS id", "SELECT id FROM nodes n WHERE label = 'Function' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.target_id = n.id AND e.type = 'CALLS')")
cypher("optional_match_count", "MATCH (f:Method) OPTIONAL MATCH (f)-[:HTTP_CALLS]->(g) RETURN f.id AS id, count(g) AS n", "SELECT n.id, count(e.target_id) AS n FROM nodes n LEFT JOIN edges e ON e.source_id = n.id AND e.type = 'HTTP_CALLS' WHERE label = 'Method' GROUP BY n.id")
cypher("bound_join", "MATCH (a:Class)-[:CALLS]->(b) MATCH (c:Interface)-[:CALLS]->(b) RETURN a.id AS a, b.id AS b, c.id AS c", "SELECT a.id AS a, e.target_id AS b, c.id AS c FROM nodes a JOIN edges e ON e.source_id = a.id AND e.type = 'CALLS' JOIN edges f ON f.target_id = e.target_id AND f.type = 'CALLS' JOIN nodes c ON c.id = f.source_id WHERE a.label = 'Class' AND c.label = 'Interface'")
cypher("cross_patterns", "MATCH (a:Region), (b:Nation) WHERE a.id < b.id RETURN a.name AS a, b.name AS b", "SELECT a.name AS a, b.name AS b FROM nodes a, nodes b WHERE a.label = 'Region' AND b.label = 'Nation' AND a.id < b.id", "trade")
cypher("exists_semi", "MATCH (n:Function) WHERE EXISTS { (n)-[:HTTP_CALLS]->() } RETURN n.id AS id", "SELECT id FROM nodes n WHERE label = 'Function' AND EXISTS (SELECT 1 FROM edges e WHERE e.source_id = n.id AND e.type = 'HTTP_CALLS')")
cypher("not_exists_anti", "MATCH (n:Function) WHERE NOT EXISTS { (n)<-[:CALLS]-() } AND n.complexity < 30 RETURN n.id AS id", "SELECT id FROM nodes n WHERE label = 'Function' AND CAST(json_extract_string(n.properties, '$.complexity') AS INT) < 30 AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.target_id = n.id AND e.type = 'CALLS')")
cypher("exists_in_or", "MATCH (n:Class) WHERE n.complexity > 40 OR EXISTS { (n)-[:ASYNC_CALLS]-() } RETURN n.id AS id", f"SELECT id FROM nodes n WHERE label = 'Class' AND (CAST({_j('complexity')} AS INT) > 40 OR EXISTS (SELECT 1 FROM edges e WHERE (e.source_id = n.id OR e.target_id = n.id) AND e.type = 'ASYNC_CALLS'))")
cypher("where_bool_xor", "MATCH (n) WHERE (n.complexity >= 25 XOR n.loop_depth = 1) AND NOT (n.label = 'Class' OR n.start_line < 100) RETURN n.id AS id", f"SELECT id FROM nodes n WHERE (CAST({_j('complexity')} AS INT) >= 25) <> (CAST({_j('loop_depth')} AS INT) = 1) AND NOT (label = 'Class' OR start_line < 100)")
cypher("comparisons", "MATCH (n) WHERE n.complexity <> 7 AND n.start_line >= 10 AND n.end_line <= 300 AND n.loop_depth < 3 AND n.complexity > 3 RETURN count(*) AS n", f"SELECT count(*) AS n FROM nodes n WHERE CAST({_j('complexity')} AS INT) <> 7 AND start_line >= 10 AND end_line <= 300 AND CAST({_j('loop_depth')} AS INT) < 3 AND CAST({_j('complexity')} AS INT) > 3")
cypher("regex_contains_starts_ends", "MATCH (n) WHERE n.name =~ '(small|red)_.*[0-4]' OR (n.name STARTS WITH 'handle' AND n.file_path ENDS WITH '.go' AND n.file_path CONTAINS 'economy') RETURN n.id AS id", "SELECT id FROM nodes WHERE regexp_full_match(name, '(small|red)_.*[0-4]') OR (starts_with(name, 'handle') AND suffix(file_path, '.go') AND contains(file_path, 'economy'))")
cypher("in_null", "MATCH (n) WHERE n.loop_depth IN [1, 3] AND n.is_entry_point IS NULL AND n.route_path IS NOT NULL RETURN n.id AS id, n.route_path AS path", f"SELECT id, {_j('route_path')} AS path FROM nodes n WHERE CAST({_j('loop_depth')} AS INT) IN (1, 3) AND {_j('is_entry_point')} IS NULL AND {_j('route_path')} IS NOT NULL")
cypher("label_test", "MATCH (n) WHERE n:Class OR n:Interface RETURN count(n) AS n", "SELECT count(*) AS n FROM nodes WHERE label IN ('Class', 'Interface')")
cypher("coalesce_empty", "MATCH (n:Method) WHERE coalesce(n.route_method, 'none') = 'none' RETURN n.id AS id, coalesce(n.route_path, n.brand) AS at", f"SELECT id, coalesce(nullif({_j('route_path')}, ''), {_j('brand')}) AS at FROM nodes n WHERE label = 'Method' AND coalesce(nullif({_j('route_method')}, ''), 'none') = 'none'")
cypher("aggregates_all", "MATCH (n) RETURN n.label AS label, count(*) AS n, sum(n.complexity) AS s, avg(n.complexity) AS a, min(n.start_line) AS lo, max(n.end_line) AS hi", f"SELECT label, count(*) AS n, sum(CAST({_j('complexity')} AS DOUBLE)) AS s, avg(CAST({_j('complexity')} AS DOUBLE)) AS a, min(start_line) AS lo, max(end_line) AS hi FROM nodes n GROUP BY label")
cypher("min_max_json", "MATCH (n) RETURN n.label AS label, min(n.complexity) AS lo, max(n.complexity) AS hi, max(n.brand) AS brand", f"SELECT label, CAST(min(CAST({_j('complexity')} AS INT)) AS VARCHAR) AS lo, CAST(max(CAST({_j('complexity')} AS INT)) AS VARCHAR) AS hi, max({_j('brand')}) AS brand FROM nodes n GROUP BY label")
cypher("count_distinct", "MATCH (a)-[:CALLS]->(b) RETURN a.label AS label, count(DISTINCT b) AS callees, count(b) AS calls", "SELECT a.label, count(DISTINCT e.target_id) AS callees, count(*) AS calls FROM nodes a JOIN edges e ON e.source_id = a.id AND e.type = 'CALLS' GROUP BY a.label")
cypher("collect_sorted", "MATCH (a:Interface)-[:CALLS]->(b) RETURN a.id AS id, size(collect(DISTINCT b.file_path)) AS files, size(collect(b.name)) AS names", "SELECT a.id, count(DISTINCT b.file_path) AS files, count(b.name) AS names FROM nodes a JOIN edges e ON e.source_id = a.id AND e.type = 'CALLS' JOIN nodes b ON b.id = e.target_id WHERE a.label = 'Interface' GROUP BY a.id")
cypher("with_having", "MATCH (a)-[:CALLS]->(b) WITH b, count(a) AS callers WHERE callers >= 6 RETURN b.qualified_name AS qn, callers", "SELECT b.qualified_name AS qn, count(*) AS callers FROM edges e JOIN nodes a ON a.id = e.source_id JOIN nodes b ON b.id = e.target_id WHERE e.type = 'CALLS' GROUP BY b.id, b.qualified_name HAVING count(*) >= 6")
cypher("order_multi_skip_limit", "MATCH (n:Function) RETURN n.name AS name, n.complexity AS c, n.id AS id ORDER BY n.start_line DESC, name, id SKIP 5 LIMIT 20", f"SELECT name, {_j('complexity')} AS c, id FROM nodes n WHERE label = 'Function' ORDER BY start_line DESC, name, id LIMIT 20 OFFSET 5")
cypher("limit_zero", "MATCH (n) WITH n LIMIT 0 RETURN n.id AS id", "SELECT id FROM nodes LIMIT 0")
cypher("union", "MATCH (n:Class) RETURN n.file_path AS f UNION MATCH (n:Interface) RETURN n.file_path AS f", "SELECT file_path AS f FROM nodes WHERE label = 'Class' UNION SELECT file_path FROM nodes WHERE label = 'Interface'")
cypher("union_all", "MATCH (n:Class) RETURN n.file_path AS f UNION ALL MATCH (n:Interface) RETURN n.file_path AS f", "SELECT file_path AS f FROM nodes WHERE label IN ('Class', 'Interface')")
cypher("unwind", "UNWIND ['Class', 'Method', 'None'] AS l MATCH (n) WHERE n.label = l RETURN l AS label, count(n) AS n", "SELECT label, count(*) AS n FROM nodes WHERE label IN ('Class', 'Method') GROUP BY label")
cypher("case_when", "MATCH (n) RETURN CASE WHEN n.complexity > 30 THEN 'high' WHEN n.complexity > 10 THEN 'mid' ELSE 'low' END AS band, count(*) AS n", f"SELECT CASE WHEN CAST({_j('complexity')} AS INT) > 30 THEN 'high' WHEN CAST({_j('complexity')} AS INT) > 10 THEN 'mid' ELSE 'low' END AS band, count(*) AS n FROM nodes n GROUP BY 1")
cypher("distinct", "MATCH (n:Function) RETURN DISTINCT n.file_path AS f, n.loop_depth AS d", f"SELECT DISTINCT file_path AS f, {_j('loop_depth')} AS d FROM nodes n WHERE label = 'Function'")
cypher("scalar_functions", "MATCH (n:Class) RETURN n.id AS id, toUpper(left(n.name, 3)) AS l, right(n.name, 2) AS r, substring(n.name, 1, 4) AS s, size(n.name) AS k, reverse(n.name) AS b, replace(n.name, '_', '-') AS x, toInteger(n.complexity) AS c, toFloat(n.loop_depth) AS f, trim('  a ') AS t, toString(n.id) AS i, toLower(n.label) AS w, toBoolean(n.is_entry_point) AS e", f"SELECT id, upper(left(name, 3)) AS l, right(name, 2) AS r, substring(name, 2, 4) AS s, CAST(length(name) AS INT) AS k, reverse(name) AS b, replace(name, '_', '-') AS x, CAST({_j('complexity')} AS BIGINT) AS c, CAST({_j('loop_depth')} AS DOUBLE) AS f, 'a' AS t, CAST(id AS VARCHAR) AS i, lower(label) AS w, CAST({_j('is_entry_point')} AS BOOLEAN) AS e FROM nodes n WHERE label = 'Class'")
cypher("graph_functions", "MATCH (a:Class)-[r:CALLS]->(b) RETURN id(a) AS a, type(r) AS t, size(labels(b)) AS l, size(keys(a)) AS k", "SELECT a.id AS a, e.type AS t, 1 AS l, CAST(len(json_keys(a.properties)) AS INT) AS k FROM nodes a JOIN edges e ON e.source_id = a.id AND e.type = 'CALLS' WHERE a.label = 'Class'")
