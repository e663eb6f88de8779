"""Syntax tree to DataFrame.

Semantics chosen here, where openCypher leaves room or the source is silent:
NULL is three-valued, a missing property is NULL, and ``coalesce`` also passes
over ''. Ordering comparisons and equality are by number if both sides read as
numbers, else by text. ``=~`` matches whole strings. Relationships of one MATCH
are different from one another. A variable length gives distinct (start, end)
pairs at their least number of hops, start excluded. Ascending order puts NULL
last, descending first.

A binding table has, for each variable, its columns as ``variable__column``, so
that unused ones are pruned at the scan.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexgraph.graph import PropertyGraph
from plexgraph.plans.cypher.lexer import CypherError, UnsupportedCypher
from plexgraph.plans.cypher.parser import AGGREGATES, Expr, Match, Node, Pattern, Projection, Query, Rel, Unwind, parse
from plexgraph.schema import EDGE_COLUMNS, NODE_COLUMNS
from plexgraph.shared import stored

MAX_ROWS = 100_000
MAX_DEPTH = 10
#: Cross joins of unconnected patterns need an upper bound of the result.
MAX_CROSS_ROWS = 10_000_000


@dataclass
class CypherResult:
    df: DataFrame
    columns: list[str]
    warnings: list[str] = field(default_factory=list)
    whole: tuple = ()  # (all rows, the ceiling)


@dataclass
class _Bound:
    """A binding table: the kind of each variable (node, edge, value) and the DataFrame."""

    df: DataFrame | None
    kinds: dict[str, str]


def _col(var: str, column: str) -> str:
    return f"{var}__{column}"


class _Planner:
    def __init__(self, graph: PropertyGraph):
        self.g, self.warnings, self.fresh = graph, [], 0

    def unnamed(self) -> str:
        self.fresh += 1
        return f"_{self.fresh}"

    # patterns

    def node_scan(self, n: Node, var: str) -> DataFrame:
        df = self.g.nodes
        if n.labels:
            df = df.filter(F.col("label").isin(*n.labels))
        for k, v in n.props.items():
            df = df.filter(self.equal(self.raw(k, NODE_COLUMNS, lambda c: F.col(c)), v))
        return df.select(*[F.col(c).alias(_col(var, c)) for c in NODE_COLUMNS])

    @staticmethod
    def raw(key: str, columns: list[str], at) -> Column:
        return at(key) if key in columns else F.get_json_object(at("properties"), f"$.{key}")

    @staticmethod
    def equal(c: Column, v) -> Column:
        if isinstance(v, bool):
            return F.lower(c.cast("string")) == str(v).lower()
        if isinstance(v, (int, float)):
            return c.try_cast("double") == float(v)
        return c.cast("string") == v

    def edges(self, r: Rel, var: str) -> DataFrame:
        """Typed edges with _from and _to in the direction of the pattern."""
        df = self.g.of_type(*r.types)
        cols = [F.col(c).alias(_col(var, c)) for c in EDGE_COLUMNS]
        out = df.select(*cols, F.col("source_id").alias("_from"), F.col("target_id").alias("_to"))
        back = df.select(*cols, F.col("target_id").alias("_from"), F.col("source_id").alias("_to"))
        return out if r.direction == "out" else back if r.direction == "in" else out.unionByName(back.filter("_from <> _to"))

    def reach(self, r: Rel, starts: DataFrame) -> DataFrame:
        """(_from, _to, _hops): least hops within the range, from the ids in ``starts``."""
        low, high = r.hops
        if high is None or high > MAX_DEPTH or low > MAX_DEPTH:
            self.warnings.append(f"variable-length range clamped to {MAX_DEPTH} hops")
            low, high = min(low, MAX_DEPTH), MAX_DEPTH if high is None else min(high, MAX_DEPTH)
        e = self.edges(Rel(None, r.types, r.direction, None), "_e").select("_from", "_to").distinct()
        steps = e.select(F.col("_from").alias("_to"), F.col("_to").alias("_next"))
        here = starts.select(F.col("_from"), F.col("_from").alias("_to")).distinct()
        found = None
        for hop in range(1, high + 1):
            here = here.join(steps, "_to").select("_from", F.col("_next").alias("_to")).filter("_from <> _to").distinct()
            if high > 3 and found is not None:
                here = here.join(found.select("_from", "_to"), ["_from", "_to"], "left_anti")
            if high > 3:
                here = stored(here)
            level = here.withColumn("_hops", F.lit(hop))
            found = level if found is None else found.unionByName(level)
        least = found.groupBy("_from", "_to").agg(F.min("_hops").alias("_hops"))
        return least.filter(F.col("_hops") >= low)

    def pattern(self, p: Pattern, bound: _Bound, used: list[str]) -> _Bound:
        names = [n.var or self.unnamed() for n in p.nodes]
        order = range(len(p.rels))
        at = next((k for k, v in enumerate(names) if v in bound.kinds), 0)
        kinds = dict(bound.kinds)
        df = bound.df
        if names[at] in kinds:
            df = self.check(df, p.nodes[at], names[at])
        else:
            scan = self.node_scan(p.nodes[at], names[at])
            df = scan if df is None else self.crossed(df, scan)
            kinds[names[at]] = "node"
        for k in [*[j for j in order if j >= at], *[j for j in reversed(order) if j < at]]:
            forward = k >= at
            here, there = (k, k + 1) if forward else (k + 1, k)
            rel = p.rels[k]
            if not forward:
                rel = Rel(rel.var, rel.types, {"out": "in", "in": "out", "any": "any"}[rel.direction], rel.hops)
            df = self.expand(df, kinds, rel, names[here], p.nodes[there], names[there], used)
        return _Bound(df, kinds)

    def expand(self, df, kinds, rel: Rel, here: str, target: Node, there: str, used: list[str]):
        start = F.col(_col(here, "id"))
        if rel.hops:
            steps = self.reach(rel, df.select(start.alias("_from")).distinct())
            if rel.var:
                raise UnsupportedCypher("unsupported: a variable on a variable-length relationship")
        else:
            var = rel.var or self.unnamed()
            if var in kinds:
                raise UnsupportedCypher("unsupported: a relationship variable bound twice")
            steps = self.edges(rel, var)
            kinds[var] = "edge"
        if there in kinds:
            df = self.check(df, target, there)
            df = df.join(steps, (start == F.col("_from")) & (F.col(_col(there, "id")) == F.col("_to")))
        else:
            df = df.join(steps, start == F.col("_from"))
            df = df.join(self.node_scan(target, there), F.col("_to") == F.col(_col(there, "id")))
            kinds[there] = "node"
        df = df.drop("_from", "_to", "_hops")
        if not rel.hops:
            for other in used:
                df = df.filter(F.col(_col(other, "id")) != F.col(_col(var, "id")))
            used.append(var)
        return df

    def check(self, df: DataFrame, n: Node, var: str) -> DataFrame:
        if n.labels:
            df = df.filter(F.col(_col(var, "label")).isin(*n.labels))
        for k, v in n.props.items():
            df = df.filter(self.equal(self.raw(k, NODE_COLUMNS, lambda c: F.col(_col(var, c))), v))
        return df

    def crossed(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """Patterns without a common variable: refused where both sides are large."""
        n, m = a.count(), b.count()
        if n * m > MAX_CROSS_ROWS:
            raise CypherError(f"unconnected patterns would give {n * m} rows")
        return a.crossJoin(b)

    def match(self, m: Match, bound: _Bound) -> _Bound:
        used: list[str] = []
        if not m.optional or bound.df is None:
            for p in m.patterns:
                bound = self.pattern(p, bound, used)
            return self.filtered(bound, m.where)
        known = {n.var for p in m.patterns for n in p.nodes if n.var in bound.kinds} | {v for v in _variables(m.where) if v in bound.kinds}
        cols = [c for c in bound.df.columns if c.split("__")[0] in known]
        keys = [_col(v, "id") if bound.kinds[v] != "value" else v for v in sorted(known)]
        sub = _Bound(bound.df.select(*cols).distinct() if cols else None, {v: bound.kinds[v] for v in known})
        for p in m.patterns:
            sub = self.pattern(p, sub, used)
        sub = self.filtered(sub, m.where)
        new = [c for c in sub.df.columns if c.split("__")[0] not in known]
        right = sub.df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *new)
        if not keys:
            df = bound.df.join(right, F.lit(True), "left")
        else:
            cond = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
            df = bound.df.join(right, cond, "left").drop(*[f"_k{i}" for i in range(len(keys))])
        return _Bound(df, bound.kinds | sub.kinds)

    # predicates

    def filtered(self, bound: _Bound, where: Expr | None) -> _Bound:
        df = bound.df
        for part in _conjuncts(where):
            inner, negated = (part.args[0], True) if part.kind == "not" else (part, False)
            if inner.kind == "exists":
                var, ids = self.exists(inner.value, bound)
                df = df.join(ids, F.col(_col(var, "id")) == F.col("_from"), "left_anti" if negated else "left_semi")
                continue
            part, df, extra = self.with_flags(part, df, bound)
            df = df.filter(self.value(part, bound.kinds)).drop(*extra)
        return _Bound(df, bound.kinds)

    def exists(self, p: Pattern, bound: _Bound) -> tuple[str, DataFrame]:
        rel, (a, b) = p.rels[0], p.nodes
        if a.var not in bound.kinds:
            if b.var not in bound.kinds:
                raise CypherError("EXISTS needs a bound variable")
            a, b = b, a
            rel = Rel(rel.var, rel.types, {"out": "in", "in": "out", "any": "any"}[rel.direction], rel.hops)
        steps = self.edges(rel, "_x").select("_from", "_to")
        if b.labels or b.props:
            steps = steps.join(self.node_scan(b, "_y").select(F.col("_y__id").alias("_to")), "_to", "left_semi")
        return a.var, steps.select("_from").distinct()

    def with_flags(self, e: Expr, df: DataFrame, bound: _Bound):
        """EXISTS inside a larger condition becomes a column."""
        extra: list[str] = []

        def walk(x: Expr) -> Expr:
            nonlocal df
            if x.kind == "exists":
                var, ids = self.exists(x.value, bound)
                name = self.unnamed()
                df = df.join(ids.select(F.col("_from").alias(f"{name}f"), F.lit(True).alias(name)), F.col(_col(var, "id")) == F.col(f"{name}f"), "left").drop(f"{name}f")
                extra.append(name)
                return Expr("flag", name)
            return Expr(x.kind, x.value, [walk(a) for a in x.args])

        out = walk(e)
        return out, df, extra

    # values

    def value(self, e: Expr, kinds: dict) -> Column:
        v = lambda x: self.value(x, kinds)
        match e.kind:
            case "lit":
                return F.lit(e.value)
            case "flag":
                return F.coalesce(F.col(e.value), F.lit(False))
            case "column":
                return F.col(e.value)
            case "var":
                kind = kinds.get(e.value)
                if kind is None:
                    raise CypherError(f"unknown variable {e.value}")
                if kind == "value":
                    return F.col(f"`{e.value}`")
                columns = NODE_COLUMNS if kind == "node" else EDGE_COLUMNS
                whole = F.to_json(F.struct(*[F.col(_col(e.value, c)).alias(c) for c in columns]))
                return F.when(F.col(_col(e.value, "id")).isNotNull(), whole)
            case "prop":
                var = e.args[0].value
                kind = kinds.get(var)
                if kind in (None, "value"):
                    raise CypherError(f"{var} has no properties")
                columns = NODE_COLUMNS if kind == "node" else EDGE_COLUMNS
                return self.raw(e.value, columns, lambda c: F.col(_col(var, c)))
            case "label":
                return F.col(_col(e.args[0].value, "label")) == e.value
            case "is_null":
                a = e.args[0]
                if a.kind == "var" and kinds.get(a.value) in ("node", "edge"):
                    return F.col(_col(a.value, "id")).isNull()
                return v(a).isNull()
            case "not":
                return ~v(e.args[0])
            case "list":
                return F.array(*[v(a) for a in e.args])
            case "in":
                if e.args[1].kind != "list":
                    return F.array_contains(v(e.args[1]), v(e.args[0]))
                tests = [self.compare("=", e.args[0], a, kinds) for a in e.args[1].args]
                return _any(tests) if tests else F.lit(False)
            case "case":
                out = None
                for when, then in e.value:
                    out = F.when(v(when), v(then)) if out is None else out.when(v(when), v(then))
                return out.otherwise(v(e.args[0]))
            case "op":
                return self.operation(e, kinds)
            case "call":
                return self.call(e, kinds)
            case "exists":
                raise UnsupportedCypher("unsupported: EXISTS outside WHERE")
        raise CypherError(f"unexpected {e.kind}")

    def compare(self, op: str, a: Expr, b: Expr, kinds: dict) -> Column:
        f = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}[op]
        for x, y in ((a, b), (b, a)):
            if y.kind == "lit":
                if isinstance(y.value, bool):
                    return f(F.lower(self.value(x, kinds).cast("string")), F.lit(str(y.value).lower()))
                if isinstance(y.value, (int, float)):
                    got = self.value(x, kinds).try_cast("double")
                    return f(got, F.lit(float(y.value))) if x is a else f(F.lit(float(y.value)), got)
                if isinstance(y.value, str):
                    got = self.value(x, kinds).cast("string")
                    return f(got, F.lit(y.value)) if x is a else f(F.lit(y.value), got)
        p, q = self.value(a, kinds), self.value(b, kinds)
        m, n = p.try_cast("double"), q.try_cast("double")
        if op in ("=", "<>"):  # one form for numbers and texts, so that joins can hash it
            return f(F.coalesce(m.cast("string"), p.cast("string")), F.coalesce(n.cast("string"), q.cast("string")))
        return F.when(m.isNotNull() & n.isNotNull(), f(m, n)).otherwise(f(p.cast("string"), q.cast("string")))

    def operation(self, e: Expr, kinds: dict) -> Column:
        a, b = e.args
        if e.value in ("=", "<>", "<", "<=", ">", ">="):
            return self.compare(e.value, a, b, kinds)
        p, q = self.value(a, kinds), self.value(b, kinds)
        match e.value:
            case "AND":
                return p & q
            case "OR":
                return p | q
            case "XOR":
                return p != q
            case "=~":
                return F.rlike(p.cast("string"), F.concat(F.lit("^(?:"), q, F.lit(")$")))
            case "CONTAINS":
                return F.contains(p.cast("string"), q)
            case "STARTS WITH":
                return F.startswith(p.cast("string"), q)
            case "ENDS WITH":
                return F.endswith(p.cast("string"), q)
            case "+":
                if any(x.kind == "lit" and isinstance(x.value, str) for x in (a, b)):
                    return F.concat(p.cast("string"), q.cast("string"))
        return {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv, "%": operator.mod}[e.value](p.try_cast("double"), q.try_cast("double"))

    def call(self, e: Expr, kinds: dict) -> Column:
        name, distinct = e.value
        if name in AGGREGATES:
            return self.aggregate(name, distinct, e.args, kinds)
        if name in ("labels", "type", "id", "keys", "properties"):
            var = e.args[0].value
            if e.args[0].kind != "var" or kinds.get(var) not in ("node", "edge"):
                raise CypherError(f"{name}() needs a node or relationship")
            c = lambda x: F.col(_col(var, x))
            return {"labels": lambda: F.array(c("label")), "type": lambda: c("type"), "id": lambda: c("id"), "keys": lambda: F.array_sort(F.json_object_keys(c("properties"))), "properties": lambda: c("properties")}[name]()
        args = [self.value(a, kinds) for a in e.args]
        text = [a.cast("string") for a in args]
        number = lambda k: args[k].cast("int")
        match name:
            case "coalesce":
                return F.coalesce(*[F.when(t != "", t) for t in text[:-1]], text[-1]) if len(text) > 1 else F.when(text[0] != "", text[0])
            case "size" | "length":
                if e.args[0].kind == "list" or (e.args[0].kind == "call" and e.args[0].value[0] in ("labels", "keys", "collect")):
                    return F.size(args[0])
                return F.length(text[0])
            case "substring":
                return F.substring(text[0], number(1) + 1, number(2)) if len(args) > 2 else F.substring(text[0], number(1) + 1, F.lit(2**31 - 1))
            case "replace":
                return F.replace(text[0], text[1], text[2])
            case "left":
                return F.left(text[0], number(1))
            case "right":
                return F.right(text[0], number(1))
            case "tointeger":
                return text[0].try_cast("double").cast("long")
            case "tofloat":
                return text[0].try_cast("double")
            case "toboolean":
                return text[0].try_cast("boolean")
        return {"tolower": F.lower, "toupper": F.upper, "tostring": lambda x: x, "trim": F.trim, "ltrim": F.ltrim, "rtrim": F.rtrim, "reverse": F.reverse}[name](text[0])

    def aggregate(self, name: str, distinct: bool, args: list[Expr], kinds: dict) -> Column:
        if name == "count" and not args:
            return F.count(F.lit(1))
        a = args[0]
        value = F.col(_col(a.value, "id")) if a.kind == "var" and kinds.get(a.value) in ("node", "edge") and name == "count" else self.value(a, kinds)
        if name == "count":
            return F.countDistinct(value) if distinct else F.count(value)
        if name == "collect":
            return F.array_sort(F.collect_set(value) if distinct else F.collect_list(value))
        number = value.try_cast("double")
        if name in ("sum", "avg"):
            f = {("sum", False): F.sum, ("sum", True): F.sum_distinct, ("avg", False): F.avg}.get((name, distinct), lambda x: F.avg(x))
            return f(number)
        if a.kind == "prop" and a.value in ("id", "start_line", "end_line", "source_id", "target_id"):
            return {"min": F.min, "max": F.max}[name](value)
        f = {"min": F.min, "max": F.max}[name]
        text = f(value.cast("string"))
        whole = F.count(number) == F.count(value)  # all values are numbers
        return F.when(whole, f(F.struct(number.alias("n"), value.cast("string").alias("t"))).getField("t")).otherwise(text)

    # projections

    def project(self, p: Projection, bound: _Bound, last: bool) -> tuple[DataFrame, list[str]]:
        items = [(i.expr, i.alias) for i in p.items]
        if p.star:
            items = [(Expr("var", v), v) for v in bound.kinds if not v.startswith("_")]
        names = [a for _, a in items]
        if len(set(names)) < len(names):
            raise CypherError("two columns of one name")
        grouped = any(_aggregates(e) for e, _ in items)
        by_text = {repr(e): a for e, a in items}

        def key(e: Expr) -> Column | None:
            if e.kind == "var" and e.value in names:
                return F.col(f"`{e.value}`")
            return F.col(f"`{by_text[repr(e)]}`") if repr(e) in by_text else None

        hidden: list[tuple[Column, str]] = []
        order: list[Column] = []
        for e, down in p.order:
            c = key(e)
            if c is None:
                if grouped or p.distinct:
                    raise CypherError("ORDER BY must use what is returned")
                hidden.append((self.value(e, bound.kinds), f"_o{len(hidden)}"))
                c = F.col(hidden[-1][1])
            order.append(c.desc_nulls_first() if down else c.asc_nulls_last())
        df = bound.df
        if grouped:
            plain = [(e, a) for e, a in items if not _aggregates(e)]
            keys = [self.value(e, bound.kinds).alias(a) for e, a in plain]
            aggs = [self.value(e, bound.kinds).alias(a) for e, a in items if _aggregates(e)]
            # whole nodes are grouped by their id and keep their columns for later clauses
            carry = [c for e, _ in plain if e.kind == "var" and bound.kinds.get(e.value) in ("node", "edge") for c in df.columns if c.startswith(f"{e.value}__")] if not last else []
            keys += [F.col(c) for c in carry]
            df = df.groupBy(*keys).agg(*aggs)
            df = df.select(*[f"`{n}`" for n in names], *carry)
        else:
            carry = [c for e, _ in items if e.kind == "var" and bound.kinds.get(e.value) in ("node", "edge") for c in df.columns if c.startswith(f"{e.value}__")] if not last else []
            df = df.select(*[self.value(e, bound.kinds).alias(a) for e, a in items], *carry, *[c.alias(a) for c, a in hidden])
        if p.distinct:
            df = df.distinct()
        if order:
            df = df.orderBy(*order)
        if p.skip:
            df = df.offset(p.skip)
        if p.limit is not None:
            df = df.limit(p.limit)
        return df.drop(*[a for _, a in hidden]), names

    def run(self, q: Query) -> tuple[DataFrame, list[str]]:
        bound = _Bound(None, {})
        for c in q.clauses:
            if isinstance(c, Match):
                bound = self.match(c, bound)
            elif isinstance(c, Unwind):
                df = self.g.nodes.sparkSession.range(1).select() if bound.df is None else bound.df
                bound = _Bound(df.withColumn(c.alias, F.explode(self.value(c.expr, bound.kinds))), bound.kinds | {c.alias: "value"})
            else:
                if bound.df is None:
                    bound = _Bound(self.g.nodes.sparkSession.range(1).select(), {})
                df, names = self.project(c, bound, False)
                kinds = {}
                exprs = {i.alias: i.expr for i in c.items} or {v: Expr("var", v) for v in names}
                for n in names:
                    e = exprs[n]
                    old = bound.kinds.get(e.value) if e.kind == "var" else None
                    if old in ("node", "edge"):
                        df = df.drop(n)
                        for col in [x for x in df.columns if x.startswith(f"{e.value}__")]:
                            df = df.withColumnRenamed(col, f"{n}__{col.split('__', 1)[1]}")
                    kinds[n] = old if old in ("node", "edge") else "value"
                bound = self.filtered(_Bound(df, kinds), c.where)
        if bound.df is None:
            bound = _Bound(self.g.nodes.sparkSession.range(1).select(), {})
        df, names = self.project(q.ret, bound, True)
        if q.union:
            every, rest = q.union
            other, theirs = self.run(rest)
            if theirs != names:
                raise CypherError("the parts of a UNION return different columns")
            df = df.unionByName(other) if every else df.unionByName(other).distinct()
        return df, names


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _aggregates(e: Expr) -> bool:
    inner = [x for w in e.value for x in w] if e.kind == "case" else []
    return (e.kind == "call" and e.value[0] in AGGREGATES) or any(_aggregates(a) for a in [*e.args, *inner])


def _variables(e: Expr | None) -> set[str]:
    if e is None:
        return set()
    out = {e.value} if e.kind == "var" else {n.var for n in e.value.nodes if n.var} if e.kind == "exists" else set()
    inner = [x for w in e.value for x in w] if e.kind == "case" else []
    return out.union(*[_variables(a) for a in [*e.args, *inner]])


def _conjuncts(e: Expr | None) -> list[Expr]:
    if e is None:
        return []
    if e.kind == "op" and e.value == "AND":
        return [x for a in e.args for x in _conjuncts(a)]
    return [e]


def execute(graph: PropertyGraph, text: str, project: str | None = None, max_rows: int = 0) -> CypherResult:
    """Plans a query; only the check of an unconnected pattern's size runs before the DataFrame does.

    At most ``max_rows`` rows, 100,000 where that is 0, all where it is negative; ``truncated`` tells whether that cuts any off.
    """
    planner = _Planner(graph.of_project(project))
    df, names = planner.run(parse(text))
    most = max_rows or MAX_ROWS
    return CypherResult(df if most < 0 else df.limit(most), names, planner.warnings, (df, most))


def truncated(result: CypherResult) -> bool:
    """Runs the query as far as its ceiling and one row more; a cut becomes a warning of the result."""
    df, most = result.whole
    cut = most >= 0 and df.limit(most + 1).count() > most
    if cut:
        result.warnings.append(f"results are cut at {most} rows")
    return cut


def run_with_deadline(result: CypherResult, seconds: float) -> list:
    """Collects a result; the query's jobs are cancelled after ``seconds``."""
    import threading
    import uuid

    sc = result.df.sparkSession.sparkContext
    group = f"cypher-{uuid.uuid4().hex}"
    timer = threading.Timer(seconds, lambda: sc.cancelJobGroup(group))
    sc.setJobGroup(group, "cypher", interruptOnCancel=True)
    timer.start()
    try:
        return result.df.collect()
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)
