"""Expectations of the graph operators on small graphs made here."""

import pytest
from pyspark.sql import functions as F

from plexgraph.functions import scalar as S
from plexgraph.graph import PropertyGraph, dedup_edges
from plexgraph.operators import community, derive, lookup, search, similar, traverse
from plexgraph.plans.cypher import CypherError, UnsupportedCypher, execute, parse, run_with_deadline, truncated
from plexgraph.schema import EDGE_SCHEMA, NODE_SCHEMA
from plexgraph.sources import documents, files, git, traces
from plexgraph.streaming import incremental


def graph(spark, nodes, edges):
    """nodes: (id, label, name, properties?), edges: (source, target, type, properties?)."""
    n = [(x[0], "p", x[1], x[2], f"p.src.m.{x[2]}", "src/m.py", 1 + 10 * k, 10 + 10 * k, x[3] if len(x) > 3 else "{}") for k, x in enumerate(nodes)]
    e = [(k, "p", x[0], x[1], x[2], x[3] if len(x) > 3 else "{}") for k, x in enumerate(edges)]
    return PropertyGraph(spark.createDataFrame(n, NODE_SCHEMA), spark.createDataFrame(e, EDGE_SCHEMA))


def ids(df, *cols):
    return sorted(tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect())


@pytest.fixture(scope="module")
def chain(spark):
    return graph(spark, [(1, "Function", "A"), (2, "Function", "B"), (3, "Function", "C"), (4, "Function", "D"), (5, "Class", "K")], [(1, 2, "CALLS"), (2, 3, "CALLS"), (3, 4, "CALLS"), (5, 1, "HTTP_CALLS")])


def test_bfs_hops_and_direction(spark, chain):
    one = chain.nodes.filter("id = 1")
    assert ids(traverse.bfs(chain, one, max_depth=3), "id", "hop") == [(2, 1), (3, 2), (4, 3)]
    assert ids(traverse.bfs(chain, one, max_depth=1), "id", "hop") == [(2, 1)]
    assert ids(traverse.bfs(chain, chain.nodes.filter("id = 3"), direction="inbound"), "id") == [1, 2]


def test_multi_source_leaves_seeds_out(spark):
    g = graph(spark, [(1, "Function", "A"), (2, "Function", "B"), (3, "Function", "mid"), (4, "Function", "leaf")], [(1, 3, "CALLS"), (3, 4, "CALLS"), (2, 4, "CALLS"), (1, 2, "CALLS")])
    assert ids(traverse.bfs(g, g.nodes.filter("id < 3")), "id", "hop") == [(3, 1), (4, 1)]


def test_wide_star(spark):
    g = graph(spark, [(0, "Function", "hub")] + [(k, "Function", f"f{k}") for k in range(1, 1201)], [(k, 0, "CALLS") for k in range(1, 1201)])
    seen = traverse.bfs(g, g.nodes.filter("id = 0"), direction="inbound")
    assert seen.count() == 1200
    assert traverse.visited_edges(g, g.nodes.filter("id = 0"), seen).count() == 1200
    cut, more = traverse.bounded(seen, 20)
    assert cut.count() == 20 and more


def test_impact(spark, chain):
    hops = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 3), (5, 4)], "id long, hop int")
    r = traverse.impact_summary(hops, chain.edges).first()
    assert (r.critical, r.high, r.medium, r.low, r.total, r.has_cross_service) == (2, 1, 1, 1, 5, True)


def test_edge_dedup_keeps_import_names_and_confidence(spark):
    g = graph(spark, [(1, "Function", "A"), (2, "Function", "B")], [(1, 2, "IMPORTS", '{"local_name":"A"}'), (1, 2, "IMPORTS", '{"local_name":"B"}'), (1, 2, "CALLS", '{"confidence":0.4}'), (1, 2, "CALLS", '{"confidence":0.95}'), (1, 2, "CALLS", "broker")])
    kept = dedup_edges(g.edges)
    assert ids(kept, "type", "properties") == [("CALLS", '{"confidence":0.95}'), ("IMPORTS", '{"local_name":"A"}'), ("IMPORTS", '{"local_name":"B"}')]


def test_search_pages_and_totals(spark, chain):
    r = search.search_graph(chain, label="Function", limit=1).collect()
    assert len(r) == 1 and r[0].total == 4
    assert search.search_graph(chain, label="Function", offset=100).count() == 0
    assert ids(search.search_graph(chain, max_degree=0), "name") == ["K"]
    assert ids(search.search_graph(chain, name="^a$"), "name") == ["A"] and search.search_graph(chain, name="^a$", case_sensitive=True).count() == 0


def test_range_overlap(spark, chain):
    assert ids(lookup.in_lines(chain.nodes, "src/m.py", 8, 15), "id") == [1, 2]
    assert lookup.in_lines(chain.nodes, "src/m.py", 100, 120).count() == 0


def test_cypher_dead_code_and_limit(spark, chain):
    q = lambda t: execute(chain, t)
    assert ids(q("MATCH (f:Function) OPTIONAL MATCH (c)-[:CALLS]->(f) WITH f, c WHERE c IS NULL RETURN f.name AS n").df, "n") == ["A"]
    assert q("MATCH (n:Function) RETURN n.name LIMIT 0").df.count() == 0
    assert q("MATCH (n:Function) RETURN n.name LIMIT 2").df.count() == 2
    assert ids(q("MATCH (a {name: 'A'})-[:CALLS*]->(b) RETURN b.name AS n").df, "n") == ["B", "C", "D"]
    assert q("MATCH (a)-[:CALLS*1..99]->(b) RETURN b.name").warnings
    assert q("MATCH (n) RETURN *").columns == ["n"]
    assert q("MATCH (n:Function) RETURN n.name").df.columns == ["n.name"]


@pytest.mark.parametrize("text", ["CREATE (n)", "MATCH (n) DELETE n", "MATCH (n) SET n.x = 1", "MERGE (n)", "CALL db.x()", "MATCH (n) WHERE n.x = $p RETURN n", "MATCH p = (n) RETURN p", "RETURN {a: 1}", "MATCH (n) RETURN shortestPath(n)", "RETURN [x IN [1, 2] | x]"])
def test_cypher_refuses(text):
    with pytest.raises(UnsupportedCypher, match="unsupported"):
        parse(text)


def test_cypher_limits_sort_keys():
    with pytest.raises(CypherError):
        parse("MATCH (n) RETURN n.a ORDER BY " + ", ".join(f"n.k{i}" for i in range(9)))
    with pytest.raises(CypherError):
        parse("MATCH (n RETURN n")


def test_globs_and_hints():
    assert [S.glob_to_like(x) for x in ("**/*.py", "**/dir/**", "src/**", "file?.txt", "plain")] == ["%%.py", "%dir%", "src%", "file_.txt", "plain"]
    assert S.regex_literals(".*Order.*Handler.*") == ["Order", "Handler"]
    assert S.regex_literals(".*ab.*") == [] and S.regex_literals("abc|def") == []


def test_scalars(spark):
    row = lambda **c: spark.range(1).select(*[v.alias(k) for k, v in c.items()]).first()
    r = row(a=S.qn_package(F.lit("project.internal.store.search.Search")), b=S.qn_package(F.lit("project.main.foo")), c=S.qn_package(F.lit("standalone")), d=S.route_canon(F.lit("/a/:id/x:y")), e=S.template_match(F.lit("/a/7/b"), F.lit("/a/{}/b/")), f=S.template_match(F.lit("/a//b"), F.lit("/a/{}/b")), g=F.array_join(S.identifier_tokens(F.lit("getCtxErr_msg")), " "), h=S.confidence_band(F.lit(0.5)), i=S.test_to_prod_path(F.lit("a/foo.test.ts")), j=S.fqn(F.lit("p"), F.lit("src/utils.go"), F.lit("Add")))
    assert list(r) == ["store", "main", "", "/a/{}/x:y", True, False, "get ctx err msg context error message", "medium", "a/foo.ts", "p.src.utils.Add"]
    assert S.resolve_relative("a/b/c.js", "../x/y") == "a/x/y" and S.resolve_relative("c.js", "../../x") is None


def test_communities(spark):
    def clique(a, n):
        return [(a + i, a + j) for i in range(n) for j in range(i)]

    c = community.leiden(20, clique(0, 10) + clique(10, 10) + [(0, 10)])
    assert len(set(c[:10])) == 1 and len(set(c[10:])) == 1 and c[0] != c[10]
    path = [(i, i + 1) for i in range(29)]
    assert len(set(community.leiden(30, path, resolution=5.0))) > len(set(community.leiden(30, path, resolution=0.1)))


def test_coupling_and_pairs(spark):
    rows = [(str(k), k, f) for k in range(4) for f in ("a", "b")] + [("9", 9, f"f{k}") for k in range(30)]
    c = spark.createDataFrame(rows, "commit_id string, ts long, file string")
    assert [tuple(r) for r in derive.change_coupling(c).collect()] == [("a", "b", 4, 1.0, 3)]


def test_similar_fingerprints(spark):
    same = list(range(0, 64 * 5, 5))
    other = [x if k < 48 else x + 1 for k, x in enumerate(same)]
    df = spark.createDataFrame([(1, "go", same), (2, "go", same), (3, "py", same), (4, "go", other)], "id long, ext string, fp array<long>")
    assert ids(similar.similar(df), "a", "b", "jaccard") == [(1, 2, 1.0)]
    assert spark.range(1).select(similar.jaccard(F.lit(same), F.lit(other)).alias("j")).first().j == 0.75
    capped = similar.capped(spark.createDataFrame([(1, k, 0.9) for k in range(2, 20)], "a long, b long, score double"))
    assert capped.count() == 10


def test_semantic_links_are_those_of_all_pairs(spark, data, monkeypatch):
    from plexgraph.plans import derived_queries

    got = ids(derived_queries.semantic(spark, data), "a", "b")
    monkeypatch.setattr(similar, "hyperplane_bands", lambda v, dim, **how: v.select("id", F.lit(0).alias("band"), F.lit("").alias("key")))
    want = ids(derived_queries.semantic(spark, data), "a", "b")
    assert want and len(set(got) & set(want)) >= 0.95 * len(set(got) | set(want))


def test_vectors_of_terms_and_documents(spark, monkeypatch):
    import math

    import numpy as np

    texts = {1: "a b a c d e f g".split(), 2: ["a"], 3: [], 4: "b b x".split(), 5: "h i".split()}
    df = spark.createDataFrame(list(texts.items()), "id long, tokens array<string>").coalesce(1)
    own = dict(zip("abcdefghix", similar.random_index(16)(list("abcdefghix"))))
    sums = {t: own[t].copy() for t in own}
    for w in texts.values():
        for i, x in enumerate(w):
            for j in range(max(0, i - 5), min(len(w), i + 6)):
                if i != j:
                    sums[x] += own[w[j]] / abs(i - j)
    unit = lambda v: v / np.linalg.norm(v)
    terms, idf = similar.term_vectors(df, 16), similar.idf(df)
    got = dict(terms.collect())
    assert set(got) == set(own) and all(np.allclose(got[t], unit(sums[t]), atol=1e-6) for t in own)
    df_of = {t: sum(t in w for w in texts.values()) for t in own}
    want = {k: unit(sum(math.log(5 / df_of[t]) * unit(sums[t]) for t in w)) for k, w in texts.items() if w}
    for numbers in (8_000_000, 3 * 16, 0):  # all, some and none of the terms are broadcast
        monkeypatch.setattr(similar, "NUMBERS", numbers)
        got = dict(similar.document_vectors(df, terms, idf, 16).collect())
        assert set(got) == set(want) and all(np.allclose(got[k], want[k], atol=1e-6) for k in want)
        rows = {r.id: r for r in similar.document_profiles(df, terms, idf, 16).collect()}
        for k in want:
            w = np.array([texts[k].count(t) * math.log(5 / df_of[t]) for t in set(texts[k])])
            assert np.allclose(rows[k].v, want[k], atol=1e-6) and np.allclose(sorted(rows[k].w), sorted(unit(w)), atol=1e-6)
            assert len(set(rows[k].terms)) == len(rows[k].terms)


def test_nearest_of_all_pairs(spark, monkeypatch):
    import numpy as np

    rng, n = np.random.default_rng(1), 60
    v = rng.normal(size=(n, 8))
    v[7] = v[5] = v[3]  # copies, and a row without terms
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    sparse = rng.random((n, 30)) * (rng.random((n, 30)) < np.r_[np.full(5, 0.7), np.full(25, 0.1)])
    sparse[[5, 7]], sparse[9] = sparse[3], 0
    norm = np.linalg.norm(sparse, axis=1, keepdims=True)
    sparse = np.divide(sparse, norm, out=sparse, where=norm > 0)
    rows = [(int(k), v[k].tolist(), (np.flatnonzero(sparse[k]) * 7 - 50).tolist(), sparse[k][sparse[k] > 0].tolist()) for k in range(n)]
    df = spark.createDataFrame(rows, "id long, v array<double>, terms array<long>, w array<double>")
    score = np.round(0.6 * v @ v.T + 0.2 * sparse @ sparse.T, 9)
    ends = [sorted((j for j in range(n) if j != i and score[i, j] >= 0.1), key=lambda j: (-score[i, j], j))[:4] for i in range(n)]
    want = sorted((i, j) for i in range(n) for j in ends[i] if i < j and i in ends[j])
    monkeypatch.setattr(similar, "MET", 20)
    monkeypatch.setattr(similar, "CELLS", 200)
    for group in (1000, 17):
        assert ids(similar.capped(similar.nearest(df, 0.6, 0.2, 0.1, 4, group), 4, 0.1), "a", "b") == want


def _keys_of_many_rows(spark, monkeypatch):
    """Plain rows for joins on frequent keys, and lists so short that each key has several."""
    import random

    monkeypatch.setattr(derive, "LIST", 3)
    monkeypatch.setattr(derive, "GRIDS", 2)
    monkeypatch.setattr(derive, "PAIRS", 4)
    return random.Random(7)


def _no_shuffle_of_pairs(df):
    """The last exchange is below the step that lists pairs."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("MapInArrow")] and "Repartition" not in plan[: plan.index("MapInArrow")]


def test_interfaces_of_equal_sets(spark, monkeypatch):
    rnd = _keys_of_many_rows(spark, monkeypatch)
    own = {k: {rnd.choice("abc") for _ in range(rnd.randint(1, 4))} for k in range(60)}
    label = {k: "Class" if k % 2 else "Interface" for k in own} | {99: "Interface"}
    rows = [(k, x) for k in own for x in own[k]] * 2 + [(99, "a"), (99, None), (1, None)]  # a method without a name is nobody's
    m = spark.createDataFrame(rows, "owner long, name string")
    got = derive.satisfied_interfaces(m, spark.createDataFrame(list(label.items()), "id long, label string"))
    _no_shuffle_of_pairs(got)
    assert ids(got, "class_id", "interface_id") == sorted((c, i) for c in own for i in own if label[c] == "Class" and label[i] == "Interface" and own[i] <= own[c])


def test_overrides_count_each_edge(spark, monkeypatch):
    rnd = _keys_of_many_rows(spark, monkeypatch)
    edges = [(rnd.randrange(4), rnd.randrange(4)) for _ in range(20)]
    methods = [(rnd.randrange(4), rnd.choice("xy"), k, "a.go" if k % 5 == 0 else "a.py") for k in range(40)]
    got = derive.overrides(spark.createDataFrame(edges, "source_id long, target_id long"), spark.createDataFrame(methods, "owner long, name string, id long, file_path string"))
    _no_shuffle_of_pairs(got)
    assert ids(got, "source_id", "target_id") == sorted((a[2], b[2]) for s, t in edges for a in methods for b in methods if a[0] == s and b[0] == t and a[1] == b[1] and a[3] != "a.go")


def test_overrides_of_short_lists_are_few_tasks(spark):
    n = 20 * spark.sparkContext.defaultParallelism
    edges, methods = [(k, k) for k in range(n)] * 2, [(k, "x", k, "a.py") for k in range(n)]
    got = derive.overrides(spark.createDataFrame(edges, "source_id long, target_id long"), spark.createDataFrame(methods, "owner long, name string, id long, file_path string"))
    assert got.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "struct" not in plan[: plan.index("MapInArrow")]  # plain values are listed by generated code
    assert ids(got, "source_id", "target_id") == sorted(edges)


def test_communities_are_found_in_one_way_at_every_size(spark, monkeypatch):
    monkeypatch.setattr(community, "_moved_singly", None)
    monkeypatch.setattr(community, "MAX_EDGES", 0, raising=False)
    pairs = [(10 * k + i, 10 * k + j) for k in range(6) for i in range(10) for j in range(i)] + [(10 * k, 10 * k + 10) for k in range(5)]
    e = spark.createDataFrame([(p, a, b, "CALLS") for p in "pq" for a, b in (pairs if p == "p" else pairs[:45])], "project string, source_id long, target_id long, type string")
    got = community.communities(PropertyGraph(None, e)).collect()
    whole = community.leiden(60, pairs)
    assert sorted((r.id, r.community) for r in got if r.project == "p") == [(k, int(min((whole == c).nonzero()[0]))) for k, c in enumerate(whole)]
    assert {(r.id, r.community) for r in got if r.project == "q"} == {(k, 0) for k in range(10)}


def test_cross_typed_gives_no_pair_twice(spark, monkeypatch):
    rnd = _keys_of_many_rows(spark, monkeypatch)
    side = lambda n: [(rnd.choice("pqr"), rnd.choice(["GRPC", "TRPC"]), rnd.choice("uv"), rnd.randrange(n)) for _ in range(40)] + [(None, "GRPC", "u", 5), ("p", None, "u", 6)]
    a, b = side(60), side(60)
    df = lambda rows: spark.createDataFrame(rows, "project string, type string, qn string, id long")
    want = {("CROSS_" + x[1], x[3], y[3]) for x in a for y in b if x[1] and x[1:3] == y[1:3] and x[0] and y[0] and x[0] != y[0]}
    assert ids(derive.cross_typed(df(a), df(b)), "type", "caller", "handler") == sorted(want)


def test_flows_but_direct_calls(spark, monkeypatch):
    rnd = _keys_of_many_rows(spark, monkeypatch)
    monkeypatch.setattr(derive, "BLOCKED", 2)
    calls = [(rnd.randrange(20), rnd.choice("rs")) for _ in range(40)]
    handlers = [(rnd.choice("rs"), rnd.randrange(20)) for _ in range(40)]
    direct = [(rnd.randrange(20), rnd.randrange(20)) for _ in range(60)] + [(1, k) for k in range(20)]
    want = {(c, h, r) for c, r in calls for q, h in handlers if q == r and c != h and (c, h) not in direct}
    got = derive.data_flows(spark.createDataFrame(calls, "caller long, route string"), spark.createDataFrame(handlers, "route string, handler long"), spark.createDataFrame(direct, "source_id long, target_id long"))
    assert ids(got, "caller", "handler", "route") == sorted(want)


def test_loop_depth_is_bounded_on_cycles(spark):
    nodes = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "id long, loop_depth long")
    calls = spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "source_id long, target_id long")
    d = dict(derive.loop_depths(nodes, calls, cap=16).collect())
    assert d[3] == 2 and d[1] == d[2] == 16


def test_loop_depth_of_a_long_chain(spark):
    n = 75
    nodes = spark.createDataFrame([(k, 1) for k in range(n)], "id long, loop_depth long").coalesce(1)
    calls = spark.createDataFrame([(k, k + 1) for k in range(n - 1)], "source_id long, target_id long").coalesce(1)
    assert dict(derive.loop_depths(nodes, calls).collect()) == {k: n - k for k in range(n)}


def test_ignore_rules():
    own = files.Ignore().add("*.log\n!keep.log\n/build\ndocs/**/x\n[ab].txt\ntmp/\n").add("*.py\n", "sub")
    got = [own.ignored(p) for p in ("a.log", "keep.log", "build/x", "src/build", "docs/q/x", "a.txt", "c.txt", "tmp/x", "tmp", "sub/d/e.py", "e.py")]
    assert got == [True, False, True, False, True, True, False, True, False, True, False]


def test_manifests_and_yaml(spark):
    assert files.manifest_packages("a/package.json", '{"name": "x", "dependencies": {"y": "1"}}') == [("package", "x"), ("dependency", "y")]
    assert files.manifest_packages("go.mod", "module a.b/c\n\nrequire (\n\tx.y/z v1\n)\n") == [("package", "a.b/c"), ("dependency", "x.y/z")]
    assert ("dependency", "serde") in files.manifest_packages("Cargo.toml", '[package]\nname = "n"\n[dependencies]\nserde = "1"\n')
    assert files.manifest_packages("package.json", "no json") == []
    text = "kind: Service\nmetadata:\n  name: web\nspec:\n  selector:\n    app: web\n---\nkind: Pod\nmetadata:\n  name: p\n  labels:\n    app: web\n"
    df = files.kubernetes(spark.createDataFrame([("k.yaml", text)], "path string, text string"))
    assert ids(df, "kind", "name") == [("Pod", "p"), ("Service", "web")]
    assert files.alias_target({"@/*": ["./src/*"]}, "@/a/b", "web") == "web/src/a/b"


def test_sources(spark):
    env = spark.createDataFrame([("a/.env", "API_URL=https://x/y\nSECRET_TOKEN=https://s\n"), ("b.py", "A=https://no")], "path string, text string")
    assert ids(files.env_urls(env), "key", "url") == [("API_URL", "https://x/y")]
    lang = spark.createDataFrame([("x/Dockerfile", ""), ("a.py", ""), ("run", "#!/usr/bin/env python3")], "p string, l string").select("p", files.language(F.col("p"), F.col("l")).alias("g"))
    assert ids(lang, "p", "g") == [("a.py", "Python"), ("run", "Python"), ("x/Dockerfile", "Dockerfile")]
    log = spark.createDataFrame([(0, k, v) for k, v in enumerate(["COMMIT:ab:12", "", "f.py", "g.py", "COMMIT:cd:13", "f.py"])], "part int, n int, value string")
    assert ids(git.parse_log(log), "commit_id", "file") == [("ab", "f.py"), ("ab", "g.py"), ("cd", "f.py")]


def test_spans(spark):
    s = spark.createDataFrame([({"http.method": "GET", "http.route": "/api/orders"}, "1000000000", "1050000000"), ({"db.system": "x"}, "1", "2")], traces_schema())
    assert [tuple(r) for r in traces.http_spans(s).collect()] == [("GET", "/api/orders", None, 50_000_000)]


def traces_schema():
    return "attributes map<string,string>, start_time string, end_time string"


def test_records():
    text = documents.render_record({"STACK": "b", "PURPOSE": "a"})
    assert text.startswith("## PURPOSE") and documents.parse_record(text) == {"PURPOSE": "a", "STACK": "b"}
    with pytest.raises(ValueError):
        documents.render_record({"STACK": "x" * 8001})


def test_publish_and_read(spark, chain, tmp_path):
    root = f"file://{tmp_path}/g"
    incremental.publish(chain, root, 1)
    incremental.publish(PropertyGraph(chain.nodes.filter("id > 1"), chain.edges), root, 2)
    assert incremental.current(spark, root).nodes.count() == 4
    assert incremental.verify_dump(100, 40) == "degraded" and incremental.verify_dump(40, 1) == "ok"


def test_patch_follows_names(spark, chain):
    fresh = graph(spark, [(90, "Function", "B")], [])
    new = PropertyGraph(fresh.nodes.withColumn("file_path", F.lit("src/b.py")), fresh.edges)
    old = PropertyGraph(chain.nodes.withColumn("file_path", F.when(F.col("id") == 2, "src/b.py").otherwise(F.col("file_path"))), chain.edges)
    got = incremental.patch(old, new, spark.createDataFrame([("src/b.py",)], "file_path string"))
    assert ids(got.edges, "source_id", "target_id") == [(1, 90), (3, 4), (5, 1)]


def test_names_of_files(spark):
    one = lambda **c: spark.range(1).select(*[v.alias(k) for k, v in c.items()]).first()
    fqn = lambda p, f, n=None: S.fqn(F.lit(p), F.lit(f), None if n is None else F.lit(n))
    r = one(a=fqn("myproj", "pkg/__init__.py", "Foo"), b=fqn("myproj", "src/index.ts", "App"), c=fqn("myproj", "cmd/server/main.go"), d=fqn("proj", "main.go", "main"), e=fqn("proj", "pkg/__init__.py"), f=fqn("proj", "pkg/.env.local", "__file__"), g=fqn("proj", "index.js", "x"), h=fqn(None, "a.py", "x"), i=fqn("proj", "", ""))
    assert tuple(r) == ("myproj.pkg.Foo", "myproj.src.App", "myproj.cmd.server.main", "proj.main.main", "proj.pkg.__init__", "proj.pkg..env.local.__file__", "proj.x", "", "proj")
    r = one(a=S.fqn_folder(F.lit("myproj"), F.lit("cmd/server")), b=S.project_name(F.lit("/Users/dev/project")), c=S.project_name(F.lit("/")), d=S.project_name(F.lit("/home/u/my  project..x/é")))
    assert tuple(r) == ("myproj.cmd.server", "Users-dev-project", "root", "home-u-my-project.x-c3a9")


def test_test_paths(spark):
    paths = ["internal/handler/handler.go", "src/__tests__/handler.test.ts", "src/test/java/com/example/Test.java", "tests/test_handler.py", "testdata/fixture.json", "", None]
    df = spark.createDataFrame([(k, p) for k, p in enumerate(paths)], "k int, p string")
    assert [r.t for r in df.orderBy("k").select(S.is_test_file_path(F.col("p")).alias("t")).collect()] == [False, True, True, True, True, False, False]
    r = spark.range(1).select(S.proximity(F.lit(None).cast("string"), F.lit("foo.c")), S.proximity(F.lit("foo.c"), F.lit(None).cast("string")), S.proximity(F.lit("src/main.c"), F.lit("src/main.c")), S.proximity(F.lit("src/foo/a.c"), F.lit("tests/bar/b.c"))).first()
    assert tuple(r) == (1.0, 1.0, 1.1, 1.0)


@pytest.mark.parametrize("bucket", [200, 3])
def test_similar_loses_no_pair(spark, bucket):
    import random

    rng, rows = random.Random(7), []
    for g in range(12):
        base = [rng.randrange(1000) for _ in range(64)]
        for _ in range(15):
            fp = list(base)
            for at in rng.sample(range(64), rng.randrange(5)):
                fp[at] = rng.randrange(1000)
            rows.append((len(rows), "py" if g % 2 else "go", fp))
    rows += [(1000 + k, "py", [1] * 64) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, ext string, fp array<long>")
    got = similar.similar(df, most=1000, bucket=bucket).collect()
    rep = {}
    for i, ext, fp in rows:
        rep.setdefault((ext, tuple(fp)), i)
    want = {(rep[ext, tuple(fp)], i, 1.0) for i, ext, fp in rows if rep[ext, tuple(fp)] != i}
    some = [(i, ext, fp) for (ext, fp), i in rep.items()]
    for i, e, f in some:
        want |= {(i, j, s) for j, h, x in some if i < j and e == h and (s := sum(p == q for p, q in zip(f, x)) / 64) >= 0.95}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_interfaces_by_their_rarest_method(spark):
    labels = [(1, "Interface"), (2, "Interface"), (3, "Interface")] + [(k, "Class") for k in range(10, 60)]
    methods = [(1, "close"), (1, "read"), (2, "close"), (3, "close"), (3, "never")] + [(k, "close") for k in range(10, 60)] + [(k, "read") for k in (12, 13, 13)]
    got = derive.satisfied_interfaces(spark.createDataFrame(methods, "owner long, name string"), spark.createDataFrame(labels, "id long, label string")).collect()
    assert sorted(tuple(r) for r in got) == sorted([(12, 1), (13, 1)] + [(k, 2) for k in range(10, 60)])


def test_resolution_chain(spark):
    names = ["proj.lib.App.Alpha.save", "proj.lib.App.Beta.save", "proj.lib.App.Gamma.save", "proj.svcA.Foo.Bar.run", "proj.svcB.Foo.Bar.run", "proj.pkg.worker.Process", "proj.pkg.worker.deep.Start", "proj.lib.authorization.requireAdmin", "proj.lib.users.requireAdmin", "proj.security_scan.scan_bash", "proj.cmd.main.helper", "proj.far.only"]
    nodes = spark.createDataFrame([(k, q.split(".")[-1], q, "a.go") for k, q in enumerate(names)], "id long, name string, qualified_name string, file_path string")
    imports = spark.createDataFrame([("proj.cmd.main", "worker", "proj.pkg.worker"), ("proj.cmd.main", "requireAdmin", "proj.lib.authorization"), ("proj.cmd.main", "_scan", "proj.security_scan.scan_bash")], "module string, local_name string, target_qn string")
    asked = ["App::Alpha::save", "App.Beta.save", "Other::Pkg::save", "Foo::Bar::run", "worker.Process", "worker.Start", "requireAdmin", "_scan", "helper", "only", "x.only", "none"]
    calls = spark.createDataFrame([(k, "proj.cmd.main", x) for k, x in enumerate(asked)], "call_id long, module string, callee string")
    got = {asked[r.call_id]: (names[r.target_id], r.strategy, round(r.confidence, 3)) for r in derive.resolve_calls(calls, nodes, imports).collect()}
    assert got == {
        "App::Alpha::save": ("proj.lib.App.Alpha.save", "qualified_suffix", 0.9), "App.Beta.save": ("proj.lib.App.Beta.save", "qualified_suffix", 0.9),
        "Other::Pkg::save": ("proj.lib.App.Alpha.save", "suffix_match", 0.275), "Foo::Bar::run": ("proj.svcA.Foo.Bar.run", "suffix_match", 0.275),
        "worker.Process": ("proj.pkg.worker.Process", "import_map", 0.95), "worker.Start": ("proj.pkg.worker.deep.Start", "import_map_suffix", 0.85),
        "requireAdmin": ("proj.lib.authorization.requireAdmin", "import_map", 0.95), "_scan": ("proj.security_scan.scan_bash", "import_map", 0.95),
        "helper": ("proj.cmd.main.helper", "same_module", 0.9), "only": ("proj.far.only", "unique_name", 0.375), "x.only": ("proj.far.only", "unique_name", 0.375),
    }


def test_ceiling_and_deadline(spark):
    nodes = spark.createDataFrame([(k, "p", "Class", f"c{k}", f"p.c{k}", "a.py", 1, 2, "{}") for k in range(5)], NODE_SCHEMA)
    g = PropertyGraph(nodes, spark.createDataFrame([], EDGE_SCHEMA))
    r = execute(g, "MATCH (n:Class) RETURN n.name AS name", max_rows=3)
    assert r.df.count() == 3 and truncated(r) and r.warnings == ["results are cut at 3 rows"]
    assert execute(g, "MATCH (n:Class) RETURN n.name AS name", max_rows=-1).df.count() == 5
    r = execute(g, "MATCH (n:Class) RETURN n.name AS name", max_rows=5)
    assert not truncated(r) and not r.warnings
    assert len(run_with_deadline(r, 60)) == 5
    slow = execute(g, "MATCH (n:Class) RETURN n.name AS name")
    from pyspark.sql.types import LongType

    wait = F.udf(lambda x: __import__("time").sleep(30) or x, LongType())
    slow.df = spark.range(1).select(wait("id"))
    with pytest.raises(Exception):
        run_with_deadline(slow, 2)


def test_merge_with_overlapping_ids(spark):
    a = graph(spark, [(1, "Function", "A"), (2, "Function", "B"), (3, "Function", "C")], [(1, 2, "CALLS"), (2, 3, "CALLS")])
    b = graph(spark, [(2, "Function", "A"), (3, "Function", "B"), (4, "Function", "C")], [(2, 3, "CALLS"), (3, 4, "CALLS")])
    assert ids(a.merged(b).edges, "source_id", "target_id") == [(1, 2), (2, 3)]


def test_leiden_check_reaches_the_ends_of_a_long_community(spark, monkeypatch):
    from plexgraph.plans.derived_queries import leiden_check

    n = 60  # a path, put into one community: its end is 59 steps from its smallest id
    g = graph(spark, [(k, "Function", f"f{k}") for k in range(n)], [(k, k + 1, "CALLS") for k in range(n - 1)])
    monkeypatch.setattr(community, "communities", lambda g: g.nodes.select("project", "id", F.lit(0).cast("long").alias("community")))
    assert leiden_check(g).select("nodes", "repeated", "unreached", "misnamed").first() == (n, 0, 0, 0)
    monkeypatch.setattr(community, "communities", lambda g: g.nodes.select("project", "id", (F.col("id") % 2).alias("community")))
    assert leiden_check(g).first().unreached == n - 2


def test_connected(spark):
    import random

    rnd = random.Random(3)
    order = rnd.sample(range(200), 200)
    chain = list(zip(order[:120], order[1:120])) + [(order[150], order[151]), (order[160], order[160])]
    want = {x: min(order[:120]) for x in order[:120]} | {x: min(order[150:152]) for x in order[150:152]}
    assert {r.id: r.root for r in traverse.connected(spark.createDataFrame(chain, "a long, b long")).collect()} == want


def test_leiden_of_many_nodes_moves_them_together(monkeypatch):
    import itertools

    import numpy as np

    pairs = [p for k in range(0, 300, 10) for p in itertools.combinations(range(k, k + 10), 2)] + [(k, k + 10) for k in range(0, 290, 10)]
    monkeypatch.setattr(community, "_moved_singly", None)
    monkeypatch.setattr(community, "TOGETHER", 0)
    c = community.leiden(300, pairs)
    assert all(len(set(c[k : k + 10])) == 1 for k in range(0, 300, 10)) and 10 <= len(set(c)) <= 30
    assert (community.leiden(5, np.empty((0, 2), np.int64)) == np.arange(5)).all()


def test_minhash_hex_is_made_once_for_each_reading(spark):
    from pyspark.sql.types import StringType

    made = spark.sparkContext.accumulator(0)

    def hexed(k):
        made.add(1)
        return "".join(f"{k + i:08x}" for i in range(64))

    df = spark.range(3).select("id", S.minhash_from_hex(F.udf(hexed, StringType())("id")).alias("v"))
    assert all(r.v == list(range(r.id, r.id + 64)) for r in df.collect()) and made.value == 3
    plan = spark.range(1).select(S.minhash_from_hex(F.md5(F.col("id").cast("string"))).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array(md5(") == 1


def test_nearest_selects_from_few_places(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng, n = np.random.default_rng(3), 3000
    v = rng.normal(size=(n, 4))
    v[1:40] = v[0]  # many equal scores: the smallest ids of them
    v /= np.linalg.norm(v, axis=1)[:, None]
    t = pa.table({"id": np.arange(n), "v": pa.array(list(v)), "terms": pa.array([[k % 7] for k in range(n)], pa.list_(pa.int64())), "w": pa.array([[1.0]] * n)}).combine_chunks()
    wide, partition = [], np.partition
    monkeypatch.setattr(np, "partition", lambda a, *more, **named: (wide.append(a.shape[1]), partition(a, *more, **named))[1])

    class Index:
        value = similar._index(t)

    got = pa.Table.from_batches(similar._best(Index, 0.6, 0.2, 0.3, 10)(t.slice(0, 300).to_batches())).to_pydict()
    score = np.round(0.6 * v[:300] @ v.T + 0.2 * (np.arange(300)[:, None] % 7 == np.arange(n) % 7), 9)
    score[np.arange(300), np.arange(300)] = -1
    want = [(i, int(j), score[i, j]) for i in range(300) for j in np.argsort(-score[i], kind="stable")[:10] if score[i, j] >= 0.3]
    assert list(zip(got["id"], got["near"])) == [w[:2] for w in want] and np.allclose(got["score"], [w[2] for w in want], atol=2e-9)
    assert wide and max(wide) < n / 10


def test_cooccurrence_adds_up_exactly(spark, monkeypatch):
    from collections import defaultdict

    monkeypatch.setattr(similar, "TOKENS", 7)  # texts of a batch are cut apart, never a text
    rows = [(k, list("axya")) for k in range(30)] + [(50, ["one"]), (51, []), (52, None), (53, list("abcabcddd"))]
    want = defaultdict(int)
    for _, t in rows:
        for i, x in enumerate(t or []):
            for j in range(1, 6):
                if i + j < len(t):
                    want[x, t[i + j]] += 60 // j
                    want[t[i + j], x] += 60 // j
    got = {(r.a, r.b): r.w for r in similar.cooccurrence(spark.createDataFrame(rows, "id long, tokens array<string>").coalesce(1)).collect()}
    assert got == {k: v / 60 for k, v in want.items()}


def test_import_resolution_meets_one_definition_of_a_file(spark):
    n = spark.range(300).selectExpr("id", "'Function' AS label", "concat('p.m.f', id) AS qualified_name", "'src/m.py' AS file_path")
    asked = spark.range(300).selectExpr("id AS import_id", "'src/a.py' AS from_path", "'src/m.py' AS target", "'' AS member")
    got = derive.resolve_imports(asked, n)
    assert {(r.import_id, r.target_id, r.how) for r in got.collect()} == {(k, 0, "file") for k in range(300)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("min(struct(rank") == 1  # the definitions are grouped before they are joined


def test_dependency_links_send_no_imports_to_the_driver(spark):
    deps = spark.createDataFrame([("a",), ("a",), ("p.b",)], "name string")
    got = derive.dependency_links(deps, spark.createDataFrame([(1, "p.a"), (2, "p.b"), (3, "a"), (4, "x/a.y")], "id long, qn string"))
    assert ids(got, "dep", "import_id", "confidence") == [("a", 1, 0.8), ("a", 3, 0.95), ("a", 4, 0.8), ("p.b", 2, 0.95)]
    small = spark.range(9).selectExpr("id", "concat('p.', id) AS qn")
    assert "Broadcast" not in derive.dependency_links(deps, small)._jdf.queryExecution().sparkPlan().toString()
