"""Edges derived from records: coupling, tests, tags, configuration, routes, interfaces, resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from plexgraph.functions.scalar import config_key_norm, decorator_tokens, has_config_extension, is_test_name, is_test_path, route_canon, template_match, test_to_prod_path
from plexgraph.graph import PropertyGraph
from plexgraph.schema import prop
from plexgraph.shared import stored

MAX_COMMIT_FILES = 20
MIN_CO_CHANGES = 3
MIN_COUPLING = 0.3


def _small_commits(commits: DataFrame, most: int) -> DataFrame:
    w = commits.select("commit_id", "ts", "file").distinct()
    size = w.groupBy("commit_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= most)
    return w.join(size.select("commit_id"), "commit_id")


def change_coupling(commits: DataFrame, most_files: int = MAX_COMMIT_FILES, least: int = MIN_CO_CHANGES, score: float = MIN_COUPLING) -> DataFrame:
    """(a, b, co_changes, coupling_score, last_co_change) of files changed together. Commits are at most ``most_files`` wide, so a commit gives a bounded number of pairs."""
    c = _small_commits(commits, most_files)
    files = c.groupBy("commit_id", "ts").agg(F.array_sort(F.collect_set("file")).alias("f"))
    pairs = files.select("ts", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.size("f")), lambda i: F.transform(F.slice("f", i + 1, F.size("f")), lambda b: F.struct(F.element_at("f", i.cast("int")).alias("a"), b.alias("b")))))).alias("p")).select("ts", "p.*")
    co = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("co_changes"), F.max("ts").alias("last_co_change")).filter(F.col("co_changes") >= least)
    n = c.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    co = co.join(n.select(F.col("file").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("file").alias("b"), F.col("n").alias("nb")), "b")
    return co.select("a", "b", "co_changes", (F.col("co_changes") / F.least("na", "nb")).alias("coupling_score"), "last_co_change").filter(F.col("coupling_score") >= score)


def file_temporal(commits: DataFrame, most_files: int = MAX_COMMIT_FILES) -> DataFrame:
    return _small_commits(commits, most_files).groupBy("file").agg(F.count(F.lit(1)).alias("change_count"), F.max("ts").alias("last_modified"))


def tests_edges(g: PropertyGraph) -> DataFrame:
    """TESTS: calls from a test-named definition in a test file to one outside."""
    n = g.nodes.select("id", "name", is_test_path(F.col("file_path")).alias("t"))
    s = n.filter(F.col("t") & is_test_name(F.col("name"))).select(F.col("id").alias("source_id"))
    d = n.filter(~F.col("t")).select(F.col("id").alias("target_id"))
    return g.of_type("CALLS").select("source_id", "target_id").join(s, "source_id").join(d, "target_id").select("source_id", "target_id")


def tests_file_edges(files: DataFrame) -> DataFrame:
    """TESTS_FILE: (source, target) where a test file's name leads to an existing file."""
    p = files.select(F.col("path").alias("source"), test_to_prod_path(F.col("path")).alias("target")).filter("target IS NOT NULL")
    return p.join(files.select(F.col("path").alias("target")), "target").select("source", "target")


def decorator_tags(nodes: DataFrame) -> DataFrame:
    """(id, tags): words of a node's decorators that two nodes at least have."""
    d = nodes.select("id", F.from_json(prop("decorators"), "array<string>").alias("d")).filter("d IS NOT NULL")
    words = d.select("id", F.explode(F.array_distinct(F.flatten(F.transform("d", decorator_tokens)))).alias("w"))
    common = words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("w")
    return words.join(common, "w").groupBy("id").agg(F.array_sort(F.collect_set("w")).alias("tags"))


def config_entries(nodes: DataFrame) -> DataFrame:
    """(id, norm) of configuration keys with two words at least, each of three letters at least."""
    c = nodes.filter((F.col("label") == "Variable") & has_config_extension(F.col("file_path"))).select("id", config_key_norm(F.col("name")).alias("norm"))
    parts = F.split("norm", "_")
    return c.filter((F.size(parts) >= 2) & F.forall(parts, lambda p: F.length(p) >= 3))


def config_links(config: DataFrame, symbols: DataFrame) -> DataFrame:
    """(config, symbol, confidence): a symbol (id, norm) that is the key (0.85) or holds it (0.75).

    Held keys are found by an equi-join: a key of k words is held by a name at a
    word's start and end only, so each name is cut into its runs of words.
    """
    s = symbols.select(F.col("id").alias("symbol"), F.col("norm").alias("whole"), F.split("norm", "_").alias("w"))
    runs = s.select("symbol", "whole", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.transform(F.sequence(i, F.size("w")), lambda j: F.array_join(F.slice("w", i, j - i + 1), "_")))))).alias("norm"))
    met = config.select(F.col("id").alias("config"), "norm").join(runs, "norm")
    return met.select("config", "symbol", F.when(F.col("norm") == F.col("whole"), 0.85).otherwise(0.75).alias("confidence")).distinct()


def dependency_links(deps: DataFrame, imports: DataFrame) -> DataFrame:
    """(dep, import_id, confidence): a dependency (name) that is an import (id, qn; 0.95) or a part of its name (0.8)."""
    names = F.explode(F.array_distinct(F.concat(F.split("qn", r"[./]"), F.array("qn"))))
    i = imports.select(F.col("id").alias("import_id"), "qn", names.alias("name")).select("import_id", "name", (F.col("name") == F.col("qn")).alias("whole"))
    # never the exploded imports to the driver, however small their files are: a hash table of each part's dependencies
    met = i.join(deps.select("name").distinct().hint("shuffle_hash"), "name")
    return met.groupBy(F.col("name").alias("dep"), "import_id").agg(F.max(F.when(F.col("whole"), 0.95).otherwise(0.8)).alias("confidence"))


def route_qn(method: Column, path: Column) -> Column:
    return F.concat(F.lit("__route__"), F.coalesce(F.upper(method), F.lit("ANY")), F.lit("__"), route_canon(path))


def routes_of(nodes: DataFrame) -> DataFrame:
    """(route, handler): decorated definitions whose path starts with a slash."""
    n = nodes.select(F.col("id").alias("handler"), prop("route_method").alias("m"), prop("route_path").alias("p"))
    return n.filter(F.startswith("p", F.lit("/"))).select(route_qn(F.col("m"), F.col("p")).alias("route"), "handler").distinct()


#: Rows of a key that are listed together, about; a pair of lists is a row of a shuffle, its pairs are not.
LIST = 1_000
#: Pairs of full lists that a task makes pairs of rows of.
GRIDS = 16
#: Pairs of rows that a task gives at once.
PAIRS = 100_000


def _lists(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(*keys, name): the other columns of rows as structs, in lists of about LIST."""
    one = F.struct(*[c for c in rows.columns if c not in keys])
    n = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / LIST).alias("_n"))
    return rows.join(n, keys).groupBy(*keys, F.pmod(F.xxhash64(one), "_n").alias("_part")).agg(F.collect_list(one).alias(name)).drop("_part")


def _dealt(met: DataFrame, times: Column | None = None) -> tuple[DataFrame, int]:
    """Rows of lists, stored, and in how many parts they are dealt out: by their pairs, so that short lists are not a task for every few."""
    met = stored(met)
    one = F.size("_l").cast("double") * F.size("_r")
    pairs = met.agg(F.sum(one if times is None else one * times)).first()[0] or 0
    return met, max(met.sparkSession.sparkContext.defaultParallelism, int(-(-pairs // (GRIDS * LIST * LIST))))


def _unlisted(met: DataFrame, *keep: str) -> DataFrame:
    """All pairs of a row's lists _l and _r. Rows are dealt out evenly, and what they list is in no shuffle."""
    met, parts = _dealt(met.select(*keep, "_l", "_r"))
    of = lambda c: met.schema[c].dataType.elementType.fields
    schema = StructType([*(met.schema[c] for c in keep), *of("_l"), *of("_r")])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for k in range(b.num_rows):
                left, right = b.column("_l")[k].values, b.column("_r")[k].values
                some, of = max(1, PAIRS // len(right)), np.arange(len(right))
                for at in range(0, len(left), some):
                    n = min(some, len(left) - at)
                    rows = pa.array(np.repeat(np.arange(at, at + n), len(right))), pa.array(np.tile(of, n))
                    cols = [c.take(i) for x, i in zip((left, right), rows) for c in x.flatten()]
                    held = [b.column(c).take(pa.array(np.full(n * len(right), k))) for c in keep]
                    yield pa.RecordBatch.from_arrays(held + cols, schema.names)

    return met.repartition(parts).mapInArrow(run, schema)


def _unlisted_in_place(met: DataFrame, times: str) -> DataFrame:
    """All pairs of a row's lists _l and _r of one column each, as often as ``times`` says, listed by generated code.

    Python only takes the columns out of the lists' structs, so that what is exploded are arrays of plain values.
    """
    met, parts = _dealt(met.select(times, "_l", "_r"), F.col(times))
    (a,), (b,) = (met.schema[c].dataType.elementType.fields for c in ("_l", "_r"))
    schema = StructType([met.schema[times], StructField("_l", ArrayType(a.dataType)), StructField("_r", ArrayType(b.dataType))])

    def run(batches):
        import pyarrow as pa

        for x in batches:
            lists = [pa.ListArray.from_arrays(x.column(c).offsets, x.column(c).values.field(0)) for c in ("_l", "_r")]
            yield pa.RecordBatch.from_arrays([x.column(times), *lists], schema.names)

    rows = met.repartition(parts).mapInArrow(run, schema)
    again = rows.select(F.explode(F.array_repeat(F.lit(True), F.col(times))), "_l", "_r").select("_l", "_r")
    return again.select(F.explode("_l").alias(a.name), "_r").select(a.name, F.explode("_r").alias(b.name))


def crossed(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """left joined with right on keys that many rows of both have, equal but for the order."""
    return _unlisted(_lists(left, list(keys), "_l").join(_lists(right, list(keys), "_r"), list(keys)), *keys)


#: Direct callees of a caller on one route that are told apart in place; of callers with more, the flows meet them in a join.
BLOCKED = 64


def data_flows(calls: DataFrame, handlers: DataFrame, direct: DataFrame) -> DataFrame:
    """(caller, handler, route): calls (caller, route) met with handlers (route, handler), unless the caller calls it directly (source_id, target_id).

    Both sides are made distinct before they meet, and a caller brings along which of the route's handlers it calls, so that flows are listed without a shuffle of them.
    """
    calls, handlers = stored(calls.select("caller", "route").distinct()), stored(handlers.select("route", "handler").distinct())
    d = stored(direct.select(F.col("source_id").alias("caller"), F.col("target_id").alias("handler")).distinct())
    blocked = d.join(handlers, "handler").join(calls, ["caller", "route"]).groupBy("caller", "route").agg(F.collect_set("handler").alias("blocked"))
    asked = calls.join(blocked, ["caller", "route"], "left")
    few = asked.filter(F.coalesce(F.size("blocked"), F.lit(0)) <= BLOCKED)
    few = crossed(few, handlers, "route").filter("caller <> handler AND (blocked IS NULL OR NOT array_contains(blocked, handler))")
    many = asked.filter(F.size("blocked") > BLOCKED).drop("blocked").join(handlers, "route").filter("caller <> handler").join(d, ["caller", "handler"], "left_anti")
    return few.select("caller", "handler", "route").unionByName(many)


def satisfied_interfaces(methods: DataFrame, labels: DataFrame) -> DataFrame:
    """(class_id, interface_id): every method name of the interface is one of the class. methods: (owner, name); labels: (id, label)."""
    m = methods.distinct().join(labels.withColumnRenamed("id", "owner"), "owner")
    i = m.filter("label = 'Interface'").select(F.col("owner").alias("interface_id"), "name")
    c = m.filter("label = 'Class'").select(F.col("owner").alias("class_id"), "name")
    # equal sets of methods meet once: only sets are joined on a name, and pairs are listed without a shuffle of them
    group = lambda x, owner: x.groupBy(owner).agg(F.array_sort(F.collect_list("name")).alias("names"), F.bool_and(F.col("name").isNotNull()).alias("whole")).select(owner, "names", "whole", F.md5(F.to_json(F.struct("names"))).alias("key"))
    i, c = stored(group(i, "interface_id").filter("whole")), stored(group(c, "class_id"))  # a name that is NULL is no class's
    sets = lambda x, names: x.groupBy("key").agg(F.first("names").alias(names))
    need, own = sets(i, "need").withColumnRenamed("key", "i_key"), stored(sets(c, "own").withColumnRenamed("key", "c_key"))
    # a set meets those that have the rarest of its methods, not those of every common name
    has = own.select("c_key", F.explode("own").alias("name"))
    often = has.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    rarest = need.select("i_key", "need", F.explode("need").alias("name")).join(often, "name", "left").groupBy("i_key").agg(F.first("need").alias("need"), F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "name")).alias("r")).filter("r.n > 0")
    met = rarest.select("i_key", "need", F.col("r.name").alias("name")).join(has, "name").join(own, "c_key")
    met = stored(met.filter(F.size(F.array_except("need", "own")) == 0).select("c_key", "i_key"))
    asked = i.select("interface_id", F.col("key").alias("i_key")).join(met, "i_key").select("interface_id", "c_key")
    return crossed(c.select("class_id", F.col("key").alias("c_key")), asked, "c_key").select("class_id", "interface_id")


def inheritance_edges(bases: DataFrame, nodes: DataFrame) -> DataFrame:
    """bases (id, base): the base's node by name, IMPLEMENTS if it is an interface, else INHERITS."""
    b = nodes.select(F.col("name").alias("base"), F.col("id").alias("target_id"), "label")
    return bases.join(b, "base").select(F.col("id").alias("source_id"), "target_id", F.when(F.col("label") == "Interface", "IMPLEMENTS").otherwise("INHERITS").alias("type")).filter("source_id <> target_id")


def overrides(inherits: DataFrame, methods: DataFrame) -> DataFrame:
    """(source_id, target_id): methods (owner, name, id, file_path) of equal name at both ends of an inheritance edge, Go left out."""
    m = methods.filter(~F.endswith("file_path", F.lit(".go")))
    a = _lists(m.select(F.col("owner").alias("source_id"), "name", F.col("id").alias("a")), ["source_id", "name"], "_l")
    b = _lists(methods.select(F.col("owner").alias("target_id"), "name", F.col("id").alias("b")), ["target_id", "name"], "_r")
    # an edge between owners counts as often as it occurs; lists of methods meet, and pairs are listed without a shuffle of them
    edges = inherits.groupBy("source_id", "target_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    met = edges.join(a, "source_id").join(b, ["target_id", "name"]).select("n", "_l", "_r")
    return _unlisted_in_place(met, "n").select(F.col("a").alias("source_id"), F.col("b").alias("target_id"))


MAX_CANDIDATES = 256
#: Scores of the ways to resolve a call.
STRATEGIES = {"import_map": 0.95, "import_map_suffix": 0.85, "same_module": 0.90, "qualified_suffix": 0.90, "unique_name": 0.75, "suffix_match": 0.55}


def _segments(c: Column) -> Column:
    return F.split(c, r"\.")


def _exactly(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(module, callee, target_id, strategy): the pairs that a whole or partial qualified name settles, by equi-joins alone.

    pairs: (module, callee, dotted, prefix, suffix, target); nodes: (id, name, qualified_name, file_path).
    """
    whole = nodes.groupBy(F.col("qualified_name").alias("key")).agg(F.min("id").alias("target_id"))
    of = F.min(F.struct(is_test_path(F.col("file_path")).alias("t"), "qualified_name", "id"))
    own = nodes.groupBy(F.concat_ws(".", F.regexp_replace("qualified_name", r"\.[^.]*$", ""), "name").alias("key")).agg(of.alias("o")).select("key", F.col("o.id").alias("target_id"))
    to = lambda strategy, rank, key: F.struct(F.lit(rank).alias("rank"), F.lit(strategy).alias("strategy"), key.alias("key"))
    tries = F.array(
        to("import_map", 0, F.when(F.col("suffix").isNull(), F.col("target"))),
        to("import_map", 1, F.concat("target", F.lit("."), F.coalesce("suffix", "prefix"))),
        to("same_module", 3, F.concat("module", F.lit("."), "dotted")),
        to("same_module", 4, F.concat("module", F.lit("."), "suffix")),
    )
    asked = pairs.select("module", "callee", F.explode(tries).alias("x")).select("module", "callee", "x.*").filter("key IS NOT NULL")
    found = asked.filter("rank < 2").join(whole, "key").unionByName(asked.filter("rank > 2").join(own, "key")).select("module", "callee", "rank", "strategy", "key", "target_id")

    # an import's target and what the name ends in: each definition under each of its leading parts
    dotted = pairs.filter("suffix IS NOT NULL")
    parts = _segments(F.col("qualified_name"))
    named = nodes.select(F.col("id").alias("target_id"), "qualified_name", parts.alias("p")).filter(F.size("p") > 1)
    heads = named.select("target_id", "qualified_name", F.element_at("p", -1).alias("last"), F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"), "p").withColumn("target", F.array_join(F.slice("p", 1, F.col("k")), "."))
    below = dotted.filter("target IS NOT NULL").withColumn("last", F.element_at(_segments(F.col("suffix")), -1)).join(heads.select("target", "last", "qualified_name", "target_id"), ["target", "last"])
    below = below.filter(F.endswith("qualified_name", F.concat(F.lit("."), F.col("suffix"))) & (F.length("qualified_name") >= F.length("target") + F.length("suffix") + 2))
    found = found.unionByName(below.select("module", "callee", F.lit(2).alias("rank"), F.lit("import_map_suffix").alias("strategy"), F.col("qualified_name").alias("key"), "target_id"))

    # the only definition whose qualified name ends in the whole dotted callee
    tails = named.select("target_id", "qualified_name", F.explode(F.sequence(F.lit(2), F.size("p"))).alias("k"), "p").withColumn("dotted", F.array_join(F.slice("p", F.size("p") - F.col("k") + 1, F.col("k")), "."))
    tails = tails.groupBy("dotted").agg(F.count_distinct("qualified_name").alias("n"), F.min("qualified_name").alias("key"), F.min("target_id").alias("target_id")).filter("n = 1")
    found = found.unionByName(dotted.join(tails, "dotted").select("module", "callee", F.lit(5).alias("rank"), F.lit("qualified_suffix").alias("strategy"), "key", "target_id"))
    best = found.groupBy("module", "callee").agg(F.min(F.struct("rank", "key", "target_id", "strategy")).alias("b"))
    return best.select("module", "callee", "b.target_id", "b.strategy")


def resolve_calls(calls: DataFrame, nodes: DataFrame, imports: DataFrame, most: int = MAX_CANDIDATES) -> DataFrame:
    """(call_id, target_id, strategy, confidence): the best definition for each call.

    calls: (call_id, module, callee), a callee being a name or a dotted (or ::) one;
    nodes: (id, name, qualified_name, file_path); imports: (module, local_name,
    target_qn). In order: the import's own target or what the callee names in it,
    what lies deeper in it, the caller's module, the only definition that ends in a
    dotted callee: these are equi-joins on qualified names. Only what they leave
    meets the definitions of its last segment, unless there are more than ``most``:
    the only one, or the nearest with a penalty of 3 / n; both are halved if no
    import of the module reaches the definition.
    """
    dotted = F.regexp_replace("callee", "::", ".")
    pairs = calls.select("module", "callee").distinct().withColumn("dotted", dotted)
    pairs = pairs.withColumns({"prefix": F.substring_index("dotted", ".", 1), "suffix": F.nullif(F.regexp_extract("dotted", r"^[^.]*\.(.+)$", 1), F.lit(""))})
    via = imports.groupBy("module", F.col("local_name").alias("prefix")).agg(F.min("target_qn").alias("target"))
    pairs = stored(pairs.join(via, ["module", "prefix"], "left"))
    exact = stored(_exactly(pairs, nodes))
    sure = F.element_at(F.create_map(*[F.lit(x) for k in STRATEGIES.items() for x in k]), F.col("strategy"))
    sure = exact.withColumn("confidence", sure)

    rest = pairs.join(exact.select("module", "callee"), ["module", "callee"], "left_anti").select("module", "callee", F.element_at(_segments(F.col("dotted")), -1).alias("name"))
    cand = nodes.select(F.col("id").alias("target_id"), "name", "qualified_name", "file_path").withColumn("home", F.regexp_replace("qualified_name", r"\.[^.]*$", ""))
    n = cand.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most)
    reach = imports.groupBy("module").agg(F.collect_set("target_qn").alias("seen"))
    home = F.col("home")
    # of each name in each package the best one stands for all, and whether a module reaches a package is asked once for each two
    of = F.struct(is_test_path(F.col("file_path")).alias("t"), "qualified_name", "target_id")
    cand = cand.groupBy("name", "home").agg(F.min(of).alias("c")).join(n, "name")
    met = rest.join(cand, "name")
    near = met.select("module", "home").distinct().join(reach, "module").filter(F.exists("seen", lambda q: F.contains(q, home) | F.contains(home, q))).select("module", "home", F.lit(True).alias("near"))
    half = F.when(F.col("near"), 1.0).otherwise(0.5)
    score = F.when(F.col("n") == 1, half * 0.75).otherwise(half * 0.55 * F.least(F.lit(1.0), 3.0 / F.col("n")))
    met = met.join(near, ["module", "home"], "left").withColumn("confidence", score)
    best = met.groupBy("module", "callee").agg(F.min(F.struct((-F.col("confidence")).alias("s"), "c.t", "c.qualified_name", "c.target_id", "confidence", "n")).alias("b"))
    guessed = best.select("module", "callee", "b.target_id", F.when(F.col("b.n") == 1, "unique_name").otherwise("suffix_match").alias("strategy"), "b.confidence")
    return calls.join(sure.unionByName(guessed), ["module", "callee"]).select("call_id", "target_id", "strategy", "confidence")


def resolved_by_type(calls: DataFrame, records: DataFrame) -> DataFrame:
    """Calls met with type-resolved records on the same bytes of the same file: these win over the registry."""
    return calls.join(records, ["file", "site_start", "site_end"])


def suppress(resolved: DataFrame) -> DataFrame:
    """Rules on (language, callee_language, member_call, builtin, strategy): what a language's calls may not be resolved by."""
    js = ["JavaScript", "TypeScript", "TSX"]
    family = lambda c: F.when(F.col(c).isin(js), "JS").otherwise(F.col(c))
    perl = (F.col("language") == "Perl") & (F.col("member_call") | F.col("builtin")) & ~(F.col("strategy").isin("same_module") | F.startswith("strategy", F.lit("import_map")))
    member = F.col("language").isin(js) & F.col("member_call") & F.col("strategy").isin("suffix_match", "unique_name", "field_type_hint", "fuzzy")
    across = (F.col("strategy") == "suffix_match") & (family("language") != family("callee_language"))
    return resolved.filter(~(perl | member | across))


#: Parts of a resolved name that tell what kind of library is called, in order.
FAMILIES = [
    ("route_registration", ["express.Router", "flask.route", "fastapi.APIRouter", "gin.Engine", "echo.Group"]),
    ("http", ["requests.", "axios", "fetch", "http.Client", "urllib", "HttpClient", "reqwest"]),
    ("async", ["kafka", "rabbitmq", "celery", "sqs", "pubsub", "nats"]),
    ("config", ["os.getenv", "viper", "dotenv", "ConfigParser"]),
    ("grpc", ["grpc"]),
    ("graphql", ["graphql", "apollo"]),
    ("trpc", ["trpc"]),
]


def classify_calls(calls: DataFrame) -> DataFrame:
    """calls (id, callee_qn, url) with the kind of edge they make; an HTTP or asynchronous call without a target is a plain one."""
    kind = None
    for name, parts in FAMILIES:
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.contains("callee_qn", F.lit(p))
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    to = {"route_registration": "HANDLES", "config": "CONFIGURES", "grpc": "GRPC_CALLS", "graphql": "GRAPHQL_CALLS", "trpc": "TRPC_CALLS"}
    c = calls.withColumn("family", kind)
    edge = F.when(F.col("family").isin("http") & (F.coalesce("url", F.lit("")) != ""), "HTTP_CALLS").when(F.col("family").isin("async") & (F.coalesce("url", F.lit("")) != ""), "ASYNC_CALLS")
    for f, e in to.items():
        edge = edge.when(F.col("family") == f, e)
    return c.select("id", "family", edge.otherwise("CALLS").alias("type"))


def cross_http(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """(caller_project, caller, target_project, handler, how): HTTP calls (project, caller, method, path) met with other projects' routes (project, method, path, handler).

    Exactly, by any method, or by template; the first way that finds one. Templates
    meet on their number of segments and their first fixed one.
    """
    shape = lambda p: F.size(F.split(F.regexp_replace(F.regexp_replace(p, "^/", ""), "/+$", ""), "/"))
    c = calls.select(F.col("project").alias("caller_project"), "caller", F.upper("method").alias("m"), route_canon(F.col("path")).alias("path"), F.col("path").alias("raw"))
    r = routes.select(F.col("project").alias("target_project"), F.coalesce(F.upper("method"), F.lit("ANY")).alias("rm"), route_canon(F.col("path")).alias("rpath"), "handler")
    same = c.join(r, F.col("path") == F.col("rpath")).filter("caller_project <> target_project AND (m = rm OR rm = 'ANY')").withColumn("how", F.when(F.col("m") == F.col("rm"), "exact").otherwise("any"))
    first = lambda p: F.split_part(F.regexp_replace(p, "^/", ""), F.lit("/"), F.lit(1))
    open_r = r.filter(F.contains("rpath", F.lit("{}"))).withColumns({"k": shape(F.col("rpath")), "s": first(F.col("rpath"))})
    keyed = c.withColumn("k", shape(F.col("raw"))).withColumn("s", F.explode(F.array_distinct(F.array(first(F.col("raw")), F.lit("{}")))))
    by = keyed.join(open_r, ["k", "s"]).filter("caller_project <> target_project AND (m = rm OR rm = 'ANY')").filter(template_match(F.col("raw"), F.col("rpath"))).withColumn("how", F.lit("template"))
    cols = ["caller_project", "caller", "target_project", "handler", "how"]
    rank = F.when(F.col("how") == "exact", 0).when(F.col("how") == "any", 1).otherwise(2)
    w = Window.partitionBy("caller_project", "caller", "raw").orderBy(rank)
    return same.select(*cols, "raw").unionByName(by.select(*cols, "raw")).withColumn("k", F.rank().over(w)).filter("k = 1").select(*cols).distinct()


def cross_channels(emits: DataFrame, listens: DataFrame) -> DataFrame:
    """(channel, emitter, listener): channels of one name across projects, the first listener of each project. (project, channel, id, transport)"""
    w = Window.partitionBy("project", "channel").orderBy("id")
    first = listens.withColumn("k", F.row_number().over(w)).filter("k = 1").select(F.col("project").alias("to_project"), "channel", F.col("id").alias("listener"))
    return emits.select(F.col("project").alias("from_project"), "channel", F.col("id").alias("emitter")).join(first, "channel").filter("from_project <> to_project").select("channel", "emitter", "listener").distinct()


def service_workloads(services: DataFrame, workloads: DataFrame) -> DataFrame:
    """(service, workload): a selector's value is the workload's name or the value of a label. services (service, selector map), workloads (workload, labels map)."""
    s = services.select("service", F.explode(F.map_values("selector")).alias("v"))
    w = workloads.select("workload", F.explode(F.array_union(F.map_values("labels"), F.array("workload"))).alias("v"))
    return s.join(w, "v").select("service", "workload").distinct()


def infra_routes(routes: DataFrame, services: DataFrame) -> DataFrame:
    """(route, service): an address's path holds the route's, and the service's name is in the file's path. routes (route, path), services (service, url, file_path)."""
    s = services.withColumn("path", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(F.split("url", "/"))), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(F.split("url", "/"), k, F.size(F.split("url", "/"))), "/"))))))
    return routes.join(s, "path").filter(F.contains("file_path", F.col("service"))).select("route", "service").distinct()


def rpc_in_services(services: DataFrame, methods: DataFrame) -> DataFrame:
    """(service, method): methods whose lines lie in a service of the same file. Both: (name, file_path, start_line, end_line)."""
    s = services.select(F.col("name").alias("service"), "file_path", F.col("start_line").alias("a"), F.col("end_line").alias("b"))
    return methods.join(s, "file_path").filter("start_line >= a AND end_line <= b").select("service", F.col("name").alias("method"))


def structure(files: DataFrame) -> DataFrame:
    """(parent, child, type): folders and files of the paths."""
    parts = F.split("path", "/")
    rows = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k - 1), "/").alias("parent"), F.array_join(F.slice(parts, 1, k), "/").alias("child"), F.when(k == F.size(parts), "CONTAINS_FILE").otherwise("CONTAINS_FOLDER").alias("type")))).alias("r"))
    return rows.select("r.*").distinct()


def channel_edges(records: DataFrame) -> DataFrame:
    """(channel, id, type): records (id, channel, transport, emits) to EMITS and LISTENS_ON."""
    return records.select(F.concat_ws(":", "transport", "channel").alias("channel"), "id", F.when(F.col("emits"), "EMITS").otherwise("LISTENS_ON").alias("type")).distinct()


def injected(signatures: DataFrame) -> DataFrame:
    """(id, callee): dependencies named in a signature as Depends(name)."""
    return signatures.select("id", F.explode(F.regexp_extract_all("signature", F.lit(r"Depends\(\s*([A-Za-z_][\w.]*)"), 1)).alias("callee"))


def model_lineage(files: DataFrame) -> DataFrame:
    """(model, ref): what templated SQL (path, text) refers to, by ref() and after FROM and JOIN."""
    model = F.regexp_extract("path", r"([^/]+)\.sql$", 1)
    refs = F.regexp_extract_all("text", F.lit(r"""\{\{\s*ref\(\s*['"]([^'"]+)"""), 1)
    tables = F.regexp_extract_all("text", F.lit(r"(?i)\b(?:from|join)\s+([A-Za-z_][\w.]*)"), 1)
    return files.filter(F.endswith("path", F.lit(".sql"))).select(model.alias("model"), F.explode(F.array_union(refs, tables)).alias("ref"))


def env_edges(access: DataFrame) -> DataFrame:
    """(key, id): records (id, key) to one EnvVar for each key."""
    return access.select("key", "id").distinct()


def import_map(imports: DataFrame) -> DataFrame:
    """(module, map of local name to name): the last record of a name wins by its text."""
    one = imports.groupBy("module", "local_name").agg(F.max("target_qn").alias("target_qn"))
    return one.groupBy("module").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("local_name", "target_qn")))).alias("map"))


def namespace_files(files: DataFrame) -> DataFrame:
    return files.groupBy("namespace").agg(F.array_sort(F.collect_set("path")).alias("files"))


def multi_pattern(texts: DataFrame, patterns: list[str]) -> DataFrame:
    """(id, mask): which of up to 63 strings a text (id, text) holds, as bits."""
    mask = F.lit(0).cast("long")
    for k, p in enumerate(patterns):
        mask = mask + F.when(F.contains("text", F.lit(p)), F.lit(1 << k)).otherwise(F.lit(0))
    return texts.select("id", mask.alias("mask"))


def loop_depths(nodes: DataFrame, calls: DataFrame, cap: int = 256, rounds: int | None = None) -> DataFrame:
    """(id, depth): a definition's own loop depth (id, loop_depth) plus the greatest of those it calls, along acyclic paths.

    Relaxation from the leaves up: each round a definition takes its own depth
    plus its callees' of the round before, until nothing changes. Depths never
    fall and end at ``cap``, as those on a cycle with a loop do, so a fixed point
    is reached. ``rounds``, if given, stops before it and cuts longer chains.
    """

    e = stored(calls.select("source_id", "target_id").filter("source_id <> target_id").distinct())
    cur, own = nodes.select("id", F.col("loop_depth").alias("depth")), nodes.select("id", "loop_depth")
    before, k = None, 0
    while rounds is None or k < rounds:
        k += 1
        best = e.join(cur.select(F.col("id").alias("target_id"), "depth"), "target_id").groupBy(F.col("source_id").alias("id")).agg(F.max("depth").alias("m"))
        cur = stored(own.join(best, "id", "left").select("id", F.least(F.lit(cap), F.col("loop_depth") + F.coalesce("m", F.lit(0))).alias("depth")))
        now = cur.agg(F.sum("depth")).first()[0]
        if now == before:
            break
        before = now
    return cur


def fuzzy_resolve(calls: DataFrame, nodes: DataFrame, imports: DataFrame, most: int = MAX_CANDIDATES) -> DataFrame:
    """(call_id, target_id, confidence): by name alone, 0.40 if it is the only definition and 0.30 for the first of several; halved if no import of the module reaches it."""
    cand = nodes.select(F.col("id").alias("target_id"), F.col("name").alias("callee"), "qualified_name")
    best = cand.groupBy("callee").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("qualified_name", "target_id")).alias("b")).filter(F.col("n") <= most)
    reach = imports.groupBy("module").agg(F.collect_set("target_qn").alias("seen"))
    m = calls.join(best, "callee").join(reach, "module", "left")
    home = F.regexp_replace("b.qualified_name", r"\.[^.]*$", "")
    near = F.coalesce(F.exists("seen", lambda q: F.contains(q, home) | F.contains(home, q)), F.lit(False))
    return m.select("call_id", "b.target_id", (F.when(F.col("n") == 1, 0.4).otherwise(0.3) * F.when(near, 1.0).otherwise(0.5)).alias("confidence"))


def resolve_imports(imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """(import_id, target_id, how): the first of exact file, module path, a member of the module, or the file beside the importer.

    imports: (import_id, from_path, target, member); nodes: (id, label, qualified_name, file_path).
    """
    n = nodes.select(F.col("id").alias("target_id"), "label", "qualified_name", "file_path")
    module = n.select("target_id", F.col("qualified_name").alias("key"), F.when(F.col("label").isin("Module", "File"), 3).otherwise(2).alias("rank"))
    path = n.select("target_id", F.col("file_path").alias("key"), F.lit(1).alias("rank")).filter("key IS NOT NULL")
    directory = F.regexp_replace("from_path", r"/?[^/]*$", "")
    keys = F.array(
        F.struct(F.col("target").alias("key"), F.lit("file").alias("how")),
        F.struct(F.concat_ws(".", F.regexp_replace("target", "/", "."), F.nullif("member", F.lit(""))).alias("key"), F.lit("member").alias("how")),
        F.struct(F.regexp_replace("target", "/", ".").alias("key"), F.lit("module").alias("how")),
        F.struct(F.concat_ws("/", F.nullif(directory, F.lit("")), "target").alias("key"), F.lit("sibling").alias("how")),
    )
    asked = imports.select("import_id", F.posexplode(keys).alias("try", "k")).select("import_id", "try", "k.key", "k.how")
    # of all that one key names only the best is met: a file may hold any number of definitions
    first = module.unionByName(path).groupBy("key").agg(F.min(F.struct("rank", "target_id")).alias("f")).select("key", "f.*")
    met = asked.join(first, "key")
    best = met.groupBy("import_id").agg(F.min(F.struct("try", "rank", "target_id", "how")).alias("b"))
    return best.select("import_id", "b.target_id", "b.how")


def prefix_bridge(prefixes: DataFrame, routes: DataFrame) -> DataFrame:
    """(route, handler): routes (dir, method, path, handler) below the prefix that a registration (dir, prefix) puts on their directory."""
    j = routes.join(prefixes, "dir")
    return j.select(route_qn(F.col("method"), F.concat(F.regexp_replace("prefix", "/$", ""), F.col("path"))).alias("route"), "handler").distinct()


def infra_bindings(bindings: DataFrame) -> DataFrame:
    """(topic_route, url_route): bindings (broker, topic, url) of a topic to an address."""
    topic = F.concat(F.lit("__route__"), F.coalesce("broker", F.lit("async")), F.lit("__"), F.col("topic"))
    return bindings.select(topic.alias("topic_route"), route_qn(F.lit(None).cast("string"), F.regexp_replace("url", r"^[a-z]+://[^/]*", "")).alias("url_route")).distinct()


#: Keys of configuration whose addresses are no routes.
DENIED_KEYS = r"(?i)(^|[_.-])(ci|upstream|registry|mirror|proxy|repository|homepage|docs?)([_.-]|$)"


def infra_string_routes(strings: DataFrame) -> DataFrame:
    """(route, path): addresses in configuration (path, key, value) as routes, denied keys left out."""
    s = strings.filter(F.col("value").rlike(r"^https?://[^/]+/") & ~F.col("key").rlike(DENIED_KEYS))
    return s.select(route_qn(F.lit(None).cast("string"), F.regexp_extract("value", r"^https?://[^/]+(/[^?#]*)", 1)).alias("route"), "path").distinct()


def return_types(methods: DataFrame) -> DataFrame:
    """(owner, name, type): one for each method; several are decided by their text."""
    return methods.filter("type IS NOT NULL AND type <> ''").groupBy("owner", "name").agg(F.min("type").alias("type"))


def cross_async(publishes: DataFrame, subscribes: DataFrame) -> DataFrame:
    """(route, caller, handler) of asynchronous calls across projects that name one broker and topic. Both: (project, broker, topic, id)."""
    route = F.concat(F.lit("__route__"), F.coalesce("broker", F.lit("async")), F.lit("__"), F.col("topic"))
    a = publishes.select(F.col("project").alias("p"), route.alias("route"), F.col("id").alias("caller"))
    b = subscribes.select(F.col("project").alias("q"), route.alias("route"), F.col("id").alias("handler"))
    return a.join(b, "route").filter("p <> q").select("route", "caller", "handler").distinct()


def cross_typed(calls: DataFrame, services: DataFrame) -> DataFrame:
    """(type, caller, handler): gRPC, GraphQL and tRPC calls met by their method's name across projects. (project, type, qn, id)"""
    a = _alone(calls.select(F.col("project").alias("p"), "type", "qn", F.col("id").alias("caller")), "caller")
    b = _alone(services.select(F.col("project").alias("q"), "type", "qn", F.col("id").alias("handler")), "handler")
    # ids of one name in one project give no pair twice: lists of them meet, and pairs are listed without a shuffle of them
    lists = _lists(a.filter("_one").drop("_one"), ["p", "type", "qn"], "_l").join(_lists(b.filter("_one").drop("_one"), ["q", "type", "qn"], "_r"), ["type", "qn"])
    once = _unlisted(lists.filter("p <> q").select("type", "_l", "_r"), "type")
    others = a.withColumnRenamed("_one", "_a").join(b.withColumnRenamed("_one", "_b"), ["type", "qn"]).filter("NOT (_a AND _b) AND p <> q").select("type", "caller", "handler").distinct()
    return once.unionByName(others).select(F.concat(F.lit("CROSS_"), "type").alias("type"), "caller", "handler")


def _alone(rows: DataFrame, column: str) -> DataFrame:
    """Distinct rows, and whether each is the only one of its type with its id."""
    rows = rows.distinct()
    n = rows.filter("type IS NOT NULL").groupBy(F.col("type").alias("_type"), F.col(column).alias("_id")).agg((F.count(F.lit(1)) == 1).alias("_one"))
    return stored(rows.join(n, (F.col("type") == F.col("_type")) & F.col(column).eqNullSafe(F.col("_id"))).drop("_type", "_id"))


def exception_edges(throws: DataFrame) -> DataFrame:
    """(id, exception, type): RAISES for unchecked ones, THROWS for the others."""
    return throws.select("id", "exception", F.when(F.col("exception").rlike("Error|Panic"), "RAISES").otherwise("THROWS").alias("type")).distinct()


def linked_projects(cross: DataFrame) -> DataFrame:
    """(project, target): distinct target projects of CROSS_ edges, from their properties."""
    return cross.filter(F.startswith("type", F.lit("CROSS_"))).select("project", prop("target_project").alias("target")).filter("target IS NOT NULL").distinct()
