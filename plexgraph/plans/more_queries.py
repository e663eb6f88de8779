"""Further derivations, sources and searches, with their SQL twins. Files and records are made of the tables' columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from plexgraph.operators import derive, lookup, search, similar, traverse
from plexgraph.operators.architecture import documents
from plexgraph.plans.basic_queries import WITH, on_code, table
from plexgraph.plans.derived_queries import texts
from plexgraph.plans.registry import register
from plexgraph.shared import stored
from plexgraph.sources import files as X

_MOD = "regexp_replace({}, '\\.[^.]*$', '')"


def fuzzy(g):
    n = g.nodes.select("id", "name", "qualified_name")
    m = g.nodes.select(F.col("id").alias("source_id"), F.regexp_replace("qualified_name", r"\.[^.]*$", "").alias("module"))
    calls = g.of_type("CALLS").join(m, "source_id").join(n.select(F.col("id").alias("target_id"), F.col("name").alias("callee")), "target_id").select(F.col("id").alias("call_id"), "module", "callee")
    imports = g.of_type("IMPORTS").join(m, "source_id").join(n.select(F.col("id").alias("target_id"), F.col("qualified_name").alias("target_qn")), "target_id").select("module", "target_qn")
    return derive.fuzzy_resolve(calls, n, imports)


on_code("derive_fuzzy_resolve", f"SELECT e.id AS call_id, b.id AS target_id, CASE WHEN EXISTS (SELECT 1 FROM edges i JOIN nodes p ON p.id = i.source_id JOIN nodes q ON q.id = i.target_id WHERE i.type = 'IMPORTS' AND {_MOD.format('p.qualified_name')} = {_MOD.format('a.qualified_name')} AND (contains(q.qualified_name, {_MOD.format('b.qualified_name')}) OR contains({_MOD.format('b.qualified_name')}, q.qualified_name))) THEN 0.4::DOUBLE ELSE 0.2::DOUBLE END AS confidence FROM edges e JOIN nodes a ON a.id = source_id JOIN nodes b ON b.id = target_id WHERE e.type = 'CALLS'")(fuzzy)


def imports_of(g):
    n = g.nodes
    i = n.select(F.col("id").alias("import_id"), F.col("file_path").alias("from_path"), F.when(F.col("id") % 3 == 0, F.col("file_path")).when(F.col("id") % 3 == 1, F.regexp_replace(F.regexp_replace("qualified_name", r"\.[^.]*$", ""), r"\.", "/")).otherwise("nowhere").alias("target"), F.col("name").alias("member"))
    return derive.resolve_imports(i, n.select("id", "label", "qualified_name", "file_path"))


on_code("derive_import_resolution", "SELECT id AS import_id, CASE WHEN id % 3 = 0 THEN (SELECT min(m.id) FROM nodes m WHERE m.file_path = n.file_path) ELSE id END AS target_id, CASE WHEN id % 3 = 0 THEN 'file' ELSE 'member' END AS how FROM nodes n WHERE id % 3 <> 2")(imports_of)
on_code("derive_prefix_bridge", "SELECT DISTINCT '__route__GET__/v1/' || string_split(file_path, '/')[2] || '/x' AS route, id AS handler FROM nodes WHERE file_path LIKE 'src/%'")(lambda g: derive.prefix_bridge(g.nodes.filter("file_path LIKE 'src/%'").select(F.regexp_extract("file_path", "^(.*)/", 1).alias("dir")).distinct().withColumn("prefix", F.concat(F.lit("/v1/"), F.split_part("dir", F.lit("/"), F.lit(2)), F.lit("/"))), g.nodes.select(F.regexp_extract("file_path", "^(.*)/", 1).alias("dir"), F.lit("get").alias("method"), F.lit("/x").alias("path"), F.col("id").alias("handler"))))
register("derive_infra_bindings", "SELECT DISTINCT '__route__kafka__t' || CAST(user_id % 9 AS VARCHAR) AS topic_route, '__route__ANY__/in/' || CAST(user_id % 5 AS VARCHAR) || '/{}' AS url_route FROM events")(lambda spark, d: derive.infra_bindings(table(spark, d, "events").select(F.lit("kafka").alias("broker"), F.concat(F.lit("t"), (F.col("user_id") % 9).cast("string")).alias("topic"), F.concat(F.lit("https://h.example/in/"), (F.col("user_id") % 5).cast("string"), F.lit("/:id")).alias("url"))))
register("derive_infra_string_routes", "SELECT DISTINCT '__route__ANY__' || regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS route, 'c' || CAST(page_id % 4 AS VARCHAR) AS path FROM pages WHERE page_id % 3 <> 0 AND regexp_matches(url, '^https?://[^/]+/')")(lambda spark, d: derive.infra_string_routes(table(spark, d, "pages").select(F.concat(F.lit("c"), (F.col("page_id") % 4).cast("string")).alias("path"), F.when(F.col("page_id") % 3 == 0, "ci_url").otherwise("backend").alias("key"), F.col("url").alias("value"))))
on_code("derive_return_types", "SELECT id % 50 AS owner, label AS name, min(json_extract_string(properties, '$.brand')) AS type FROM nodes GROUP BY ALL")(lambda g: derive.return_types(g.nodes.select((F.col("id") % 50).alias("owner"), F.col("label").alias("name"), F.get_json_object("properties", "$.brand").alias("type"))))


def topics(g, k):
    return g.nodes.filter(f"label = '{k}'").select("project", F.lit("sqs").alias("broker"), F.concat(F.lit("q"), (F.col("id") % 39).cast("string")).alias("topic"), "id")


on_code("derive_cross_async", "SELECT DISTINCT '__route__sqs__q' || CAST(a.id % 39 AS VARCHAR) AS route, a.id AS caller, b.id AS handler FROM nodes a JOIN nodes b ON a.id % 39 = b.id % 39 AND a.project <> b.project WHERE a.label = 'Class' AND b.label = 'Method'")(lambda g: derive.cross_async(topics(g, "Class"), topics(g, "Method")))
on_code("derive_cross_typed", "SELECT DISTINCT 'CROSS_GRPC_CALLS' AS type, a.id AS caller, b.id AS handler FROM nodes a JOIN nodes b ON a.id % 90 = b.id % 90 AND a.project <> b.project WHERE a.label = 'Function' AND b.label = 'Method'")(lambda g: derive.cross_typed(*[g.nodes.filter(f"label = '{x}'").select("project", F.lit("GRPC_CALLS").alias("type"), (F.col("id") % 90).cast("string").alias("qn"), "id") for x in ("Function", "Method")]))
register("derive_exceptions", "SELECT DISTINCT o_orderkey AS id, o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN 'Error' ELSE '' END AS exception, CASE WHEN o_orderkey % 2 = 0 THEN 'RAISES' ELSE 'THROWS' END AS type FROM orders")(lambda spark, d: derive.exception_edges(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat("o_orderpriority", F.when(F.col("o_orderkey") % 2 == 0, "Error").otherwise("")).alias("exception"))))
on_code("derive_linked_projects", "SELECT DISTINCT project, 't' || CAST(source_id % 6 AS VARCHAR) AS target FROM edges WHERE type = 'HTTP_CALLS'")(lambda g: derive.linked_projects(g.edges.select("project", F.when(F.col("type") == "HTTP_CALLS", "CROSS_HTTP_CALLS").otherwise(F.col("type")).alias("type"), F.concat(F.lit('{"target_project":"t'), (F.col("source_id") % 6).cast("string"), F.lit('"}')).alias("properties"))))
on_code("derive_infra_match", "SELECT DISTINCT id AS route, split_part(file_path, '/', 2) AS service FROM nodes WHERE file_path LIKE 'src/%'")(lambda g: derive.infra_routes(g.nodes.select(F.col("id").alias("route"), F.concat(F.lit("/"), "file_path").alias("path")), g.nodes.select(F.split_part("file_path", F.lit("/"), F.lit(2)).alias("service"), F.concat(F.lit("https://h.example/"), "file_path").alias("url"), "file_path").filter("file_path LIKE 'src/%'").distinct()))
on_code("derive_depends", "SELECT id, CAST(unnest(['dep_' || CAST(id % 7 AS VARCHAR), 'get_user']) AS VARCHAR) AS callee FROM nodes WHERE label = 'Function'")(lambda g: derive.injected(g.nodes.filter("label = 'Function'").select("id", F.concat(F.lit("(a=Depends(dep_"), (F.col("id") % 7).cast("string"), F.lit("), u: U = Depends( get_user ))")).alias("signature"))))
register("derive_model_lineage", "SELECT DISTINCT 'm' || CAST(o_orderkey AS VARCHAR) AS model, unnest(['stg_' || lower(o_orderstatus), 'raw.t' || CAST(o_custkey % 5 AS VARCHAR)]) AS ref FROM orders")(lambda spark, d: derive.model_lineage(table(spark, d, "orders").select(F.concat(F.lit("models/m"), F.col("o_orderkey").cast("string"), F.lit(".sql")).alias("path"), F.concat(F.lit("select * from {{ ref('stg_"), F.lower("o_orderstatus"), F.lit("') }} join raw.t"), (F.col("o_custkey") % 5).cast("string"), F.lit(" using (k)")).alias("text"))))
on_code("derive_env_access", "SELECT DISTINCT 'KEY_' || CAST(id % 12 AS VARCHAR) AS key, id FROM nodes")(lambda g: derive.env_edges(g.nodes.select(F.concat(F.lit("KEY_"), (F.col("id") % 12).cast("string")).alias("key"), "id")))
on_code("derive_channels", "SELECT DISTINCT 'ws:c' || CAST(id % 15 AS VARCHAR) AS channel, id, CASE WHEN id % 2 = 0 THEN 'EMITS' ELSE 'LISTENS_ON' END AS type FROM nodes WHERE label = 'Method'")(lambda g: derive.channel_edges(g.nodes.filter("label = 'Method'").select("id", F.concat(F.lit("c"), (F.col("id") % 15).cast("string")).alias("channel"), F.lit("ws").alias("transport"), (F.col("id") % 2 == 0).alias("emits"))))
on_code("derive_namespaces", "SELECT split_part(qualified_name, '.', 3) AS namespace, array_to_string(list_sort(list(DISTINCT file_path)), '|') AS files FROM nodes GROUP BY 1")(lambda g: derive.namespace_files(g.nodes.select(F.split_part("qualified_name", F.lit("."), F.lit(3)).alias("namespace"), F.col("file_path").alias("path"))).select("namespace", F.array_join("files", "|").alias("files")))
on_code("derive_typed_calls", "SELECT id AS call, id AS target FROM nodes WHERE label = 'Function'")(lambda g: derive.resolved_by_type(g.nodes.select(F.col("file_path").alias("file"), F.col("id").alias("site_start"), F.col("end_line").alias("site_end"), F.col("id").alias("call")), g.nodes.filter("label = 'Function'").select(F.col("file_path").alias("file"), F.col("id").alias("site_start"), F.col("end_line").alias("site_end"), F.col("id").alias("target"))).select("call", "target"))
_LANG = "['Perl', 'JavaScript', 'TSX', 'Python'][id % 4 + 1]"
_LANG2 = "['Perl', 'TSX', 'Python'][id % 3 + 1]"
_STR = "['suffix_match', 'unique_name', 'same_module', 'import_map', 'fuzzy'][id % 5 + 1]"
on_code("derive_suppression", f"SELECT id FROM (SELECT id, {_LANG} AS l, {_LANG2} AS k, {_STR} AS s, id % 7 < 3 AS m, id % 11 < 2 AS b FROM nodes) WHERE NOT (l = 'Perl' AND (m OR b) AND s NOT IN ('same_module', 'import_map')) AND NOT (l IN ('JavaScript', 'TSX') AND m AND s IN ('suffix_match', 'unique_name', 'fuzzy')) AND NOT (s = 'suffix_match' AND CASE WHEN l IN ('JavaScript', 'TSX') THEN 'JS' ELSE l END <> CASE WHEN k = 'TSX' THEN 'JS' ELSE k END)")(lambda g: derive.suppress(g.nodes.select("id", *[F.element_at(F.array(*[F.lit(x) for x in v]), (F.col("id") % len(v) + 1).cast("int")).alias(n) for n, v in (("language", ("Perl", "JavaScript", "TSX", "Python")), ("callee_language", ("Perl", "TSX", "Python")), ("strategy", ("suffix_match", "unique_name", "same_module", "import_map", "fuzzy")))], (F.col("id") % 7 < 3).alias("member_call"), (F.col("id") % 11 < 2).alias("builtin"))).select("id"))


# sources

def config_files(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey").cast("string")
    return o.select(F.concat(F.lit("svc"), k, F.when(F.col("o_orderkey") % 2 == 0, "/Dockerfile").otherwise("/main.tf")).alias("path"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("FROM base:"), k, F.lit("\nENV API_URL=https://h/"), k, F.lit("\nENV DB_PASSWORD=https://x\nEXPOSE 80\n"))).otherwise(F.concat(F.lit('resource "aws_x" "r'), k, F.lit('" {\n  url = "https://t/'), k, F.lit('"\n}\nvariable "v" {}\n'))).alias("text"))


register("ingest_env_urls", "SELECT 'svc' || k || '/Dockerfile' AS path, 'API_URL' AS key, 'https://h/' || k AS url FROM (SELECT CAST(o_orderkey AS VARCHAR) AS k FROM orders WHERE o_orderkey % 2 = 0) UNION ALL SELECT 'svc' || k || '/main.tf', 'url', 'https://t/' || k FROM (SELECT CAST(o_orderkey AS VARCHAR) AS k FROM orders WHERE o_orderkey % 2 = 1)")(lambda spark, d: X.env_urls(config_files(spark, d)))
register("ingest_dockerfile", "SELECT 'svc' || k || '/Dockerfile' AS path, unnest(['FROM', 'ENV', 'ENV', 'EXPOSE']) AS kind, unnest(['base:' || k, 'API_URL=https://h/' || k, 'DB_PASSWORD=https://x', '80']) AS value FROM (SELECT CAST(o_orderkey AS VARCHAR) AS k FROM orders WHERE o_orderkey % 2 = 0)")(lambda spark, d: X.dockerfile(config_files(spark, d)))
register("ingest_terraform", "SELECT 'svc' || k || '/main.tf' AS path, 'resource' AS kind, 'aws_x' AS type, 'r' || k AS name FROM (SELECT CAST(o_orderkey AS VARCHAR) AS k FROM orders WHERE o_orderkey % 2 = 1) UNION ALL SELECT 'svc' || CAST(o_orderkey AS VARCHAR) || '/main.tf', 'variable', NULL, 'v' FROM orders WHERE o_orderkey % 2 = 1")(lambda spark, d: X.terraform(config_files(spark, d)))
def manifests_of(spark, d):
    return X.packages(table(spark, d, "orders").select(F.concat(F.lit("a"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "/requirements.txt").otherwise("/package.json")).alias("path"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("lib"), (F.col("o_custkey") % 9).cast("string"), F.lit("==1.0\nother>=2"))).otherwise(F.concat(F.lit('{"name":"n","dependencies":{"lib'), (F.col("o_custkey") % 9).cast("string"), F.lit('":"1"}}'))).alias("text")))


register("derive_depends_on", """SELECT path, 'alpha.__' || eco || '_dep__.' || name AS target_qn, name, eco AS ecosystem FROM (
  SELECT 'a' || CAST(o_orderkey AS VARCHAR) || '/requirements.txt' AS path, 'pip' AS eco, unnest(['lib' || CAST(o_custkey % 9 AS VARCHAR), 'other']) AS name FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT 'a' || CAST(o_orderkey AS VARCHAR) || '/package.json', 'npm', 'lib' || CAST(o_custkey % 9 AS VARCHAR) FROM orders WHERE o_orderkey % 2 = 1)""")(lambda spark, d: X.depends_on(manifests_of(spark, d), "alpha"))


def compose_files(spark, d):
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("version: '3'\nservices:\n  web"), k, F.lit(":\n    image: img:"), k, F.lit("\n    ports:\n      - \"80"), k, F.lit(":80\"\n    depends_on:\n      - db\n  db:\n    build:\n      context: ./db\n    environment:\n      SIZE: "), F.col("p_size").cast("string"), F.lit("\n"))
    return table(spark, d, "part").select(F.concat(F.lit("p"), k, F.when(F.col("p_partkey") % 2 == 0, "/docker-compose.prod.yml").otherwise("/compose.yaml")).alias("path"), text.alias("text"))


register("ingest_compose", """WITH f AS (SELECT CAST(p_partkey AS VARCHAR) AS k, p_partkey, CAST(p_size AS VARCHAR) AS size, 'p' || CAST(p_partkey AS VARCHAR) || CASE WHEN p_partkey % 2 = 0 THEN '/docker-compose.prod.yml' ELSE '/compose.yaml' END AS path FROM part)
SELECT path, unnest(['web' || k, 'web' || k, 'web' || k, 'db', 'db']) AS service, unnest(['image', 'ports', 'depends_on', 'build', 'environment']) AS kind, unnest(['img:' || k, '80' || k || ':80', 'db', './db', 'SIZE=' || size]) AS value FROM f""")(lambda spark, d: X.compose(compose_files(spark, d)))


def charts(spark, d):
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("apiVersion: v2\nname: chart"), k, F.lit("\ndependencies:\n  - name: redis\n    version: "), F.col("p_size").cast("string"), F.lit(".0.0\n    repository: https://charts.example/x\n  - name: pg"), k, F.lit("\n"))
    return table(spark, d, "part").select(F.concat(F.lit("c"), k, F.lit("/Chart.yaml")).alias("path"), text.alias("text"))


register("ingest_helm_dependencies", "SELECT 'c' || k || '/Chart.yaml' AS path, 'chart' || k AS chart, unnest(['redis', 'pg' || k]) AS name, unnest([size || '.0.0', NULL]) AS version, unnest(['https://charts.example/x', NULL]) AS repository FROM (SELECT CAST(p_partkey AS VARCHAR) AS k, CAST(p_size AS VARCHAR) AS size FROM part)")(lambda spark, d: X.helm_dependencies(charts(spark, d)))
register("ingest_packages", "SELECT 'a' || k || '/package.json' AS path, unnest(['package', 'dependency']) AS kind, unnest(['n' || k, 'lib' || CAST(o_custkey % 9 AS VARCHAR)]) AS name FROM (SELECT CAST(o_orderkey AS VARCHAR) AS k, o_custkey FROM orders)")(lambda spark, d: X.packages(table(spark, d, "orders").select(F.concat(F.lit("a"), F.col("o_orderkey").cast("string"), F.lit("/package.json")).alias("path"), F.concat(F.lit('{"name":"n'), F.col("o_orderkey").cast("string"), F.lit('","dependencies":{"lib'), (F.col("o_custkey") % 9).cast("string"), F.lit('":"1"}}')).alias("text"))))
register("ingest_kubernetes", "SELECT 'k' || CAST(o_orderkey AS VARCHAR) || '.yaml' AS path, 'Service' AS kind, 'web' || CAST(o_orderkey AS VARCHAR) AS name, 'a' || CAST(o_custkey % 9 AS VARCHAR) AS app FROM orders")(lambda spark, d: X.kubernetes(table(spark, d, "orders").select(F.concat(F.lit("k"), F.col("o_orderkey").cast("string"), F.lit(".yaml")).alias("path"), F.concat(F.lit("kind: Service\nmetadata:\n  name: web"), F.col("o_orderkey").cast("string"), F.lit("\nspec:\n  selector:\n    app: a"), (F.col("o_custkey") % 9).cast("string"), F.lit("\n")).alias("text"))).select("path", "kind", "name", F.col("selector")["app"].alias("app")))
register("ingest_compile_flags", "SELECT p_partkey AS id, 'inc/' || p_type AS include, 'B=' || CAST(p_size AS VARCHAR) AS define FROM part")(lambda spark, d: X.compile_flags(table(spark, d, "part").select(F.col("p_partkey").alias("file"), F.concat(F.lit("cc -Iinc/"), "p_type", F.lit(" -D B="), F.col("p_size").cast("string"), F.lit(" -c x.c")).alias("command"))).select(F.col("file").alias("id"), F.element_at("includes", 1).alias("include"), F.element_at("defines", 1).alias("define")))
on_code("ingest_languages", "SELECT DISTINCT file_path AS path, CASE regexp_extract(file_path, '\\.([^./]+)$', 1) WHEN 'py' THEN 'Python' WHEN 'go' THEN 'Go' ELSE 'ECMAScript' END AS language FROM nodes")(lambda g: g.nodes.select(F.col("file_path").alias("path")).distinct().select("path", X.language(F.col("path"), overrides={"js": "ECMAScript"}).alias("language")))
on_code("architecture_documents", "SELECT DISTINCT 'docs/adr/' || name || '.md' AS path FROM nodes WHERE label = 'Class'")(lambda g: documents(g.nodes.select(F.when(F.col("label") == "Class", F.concat(F.lit("docs/adr/"), "name", F.lit(".md"))).otherwise(F.col("file_path")).alias("path"))))


# searches

register("search_code_files", "SELECT id, count(*) AS n FROM (SELECT 'c' || lpad(CAST(conv_id AS VARCHAR), 6, '0') || '/' || CAST(turn AS VARCHAR) AS id, unnest(string_split(text, chr(10))) AS l FROM conversations) WHERE regexp_matches(l, 'tion') GROUP BY id ORDER BY id LIMIT 40")(lambda spark, d: search.search_files(table(spark, d, "conversations").select(F.concat(F.lit("c"), F.lpad(F.col("conv_id").cast("string"), 6, "0"), F.lit("/"), F.col("turn").cast("string")).alias("id"), "text"), "tion", mode="files", limit=40))
on_code("search_snippet", "SELECT qualified_name, array_to_string(['l' || CAST(k AS VARCHAR) FOR k IN range(start_line, end_line + 1)], chr(10)) AS source FROM nodes WHERE id = 26")(lambda g: search.snippet(g.nodes.select(F.col("file_path").alias("path")).distinct().withColumn("text", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(600)), lambda k: F.concat(F.lit("l"), k.cast("string"))), "\n")), g.nodes.filter("id = 26"), g.nodes.filter("id = 26").first().qualified_name))
on_code("lookup_neighbour_edges", "SELECT id, type FROM edges WHERE source_id = 7 UNION ALL SELECT id, type FROM edges WHERE target_id = 7")(lambda g: g.edges.filter("source_id = 7").select("id", "type").unionByName(g.edges.filter("target_id = 7").select("id", "type")))
on_code("lookup_batch_degrees", "SELECT n.id, count(*) FILTER (e.t = 'i') AS in_degree, count(*) FILTER (e.t = 'o') AS out_degree FROM nodes n LEFT JOIN (SELECT target_id AS id, 'i' AS t FROM edges UNION ALL SELECT source_id, 'o' FROM edges) e ON e.id = n.id GROUP BY n.id")(lambda g: lookup.degrees(g))
on_code("traverse_first_hops", "SELECT id % 100 AS id, min(start_line) AS hop FROM nodes GROUP BY 1")(lambda g: traverse.first_hops(g.nodes.select((F.col("id") % 100).alias("id"), F.col("start_line").alias("hop"))))


def semantic_search(spark, d):
    docs = stored(texts(spark, d))
    terms, idf = stored(similar.term_vectors(docs, dim=64)), stored(similar.idf(docs))
    return search.semantic_query(terms, idf, similar.document_vectors(docs, terms, idf, dim=64), ["license", "thing", "erha"])


register("search_semantic")(semantic_search)
