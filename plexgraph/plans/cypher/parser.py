"""Tokens to a syntax tree, by recursive descent."""

from __future__ import annotations

from dataclasses import dataclass, field

from plexgraph.plans.cypher.lexer import CypherError, Token, UnsupportedCypher, lex

MAX_SORT_KEYS = 8

#: Clauses of openCypher outside the subset.
REFUSED = "CREATE DELETE DETACH SET REMOVE MERGE CALL YIELD FOREACH LOAD DROP ON USING EXPLAIN PROFILE CONSTRAINT INDEX COMMIT ROLLBACK".split()
AGGREGATES = {"count", "sum", "avg", "min", "max", "collect"}
FUNCTIONS = set("tolower toupper tostring tointeger tofloat toboolean size length trim ltrim rtrim reverse coalesce substring replace left right labels type id keys properties".split())


@dataclass
class Node:
    var: str | None
    labels: list[str]
    props: dict


@dataclass
class Rel:
    var: str | None
    types: list[str]
    direction: str  # out, in, any
    hops: tuple[int, int | None] | None  # None: one plain relationship


@dataclass
class Pattern:
    nodes: list[Node]
    rels: list[Rel]


@dataclass
class Expr:
    """kind: lit, var, prop, call, op, not, is_null, in, label, exists, case, list."""

    kind: str
    value: object = None
    args: list = field(default_factory=list)


@dataclass
class Item:
    expr: Expr
    alias: str


@dataclass
class Projection:
    items: list[Item]
    star: bool = False
    distinct: bool = False
    order: list[tuple[Expr, bool]] = field(default_factory=list)
    skip: int = 0
    limit: int | None = None
    where: Expr | None = None


@dataclass
class Match:
    patterns: list[Pattern]
    optional: bool
    where: Expr | None


@dataclass
class Unwind:
    expr: Expr
    alias: str


@dataclass
class Query:
    clauses: list
    ret: Projection
    union: tuple[bool, Query] | None = None  # (all, next)


class _Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, lex(text), 0

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def is_word(self, *words: str) -> bool:
        return all(t.kind == "word" and t.text.upper() == w for t, w in zip(self.tokens[self.at :], words)) and len(self.tokens) - self.at > len(words) - 1

    def take_word(self, *words: str) -> bool:
        if self.is_word(*words):
            self.at += len(words)
            return True
        return False

    def take(self, op: str) -> bool:
        if self.now.kind == "op" and self.now.text == op:
            self.at += 1
            return True
        return False

    def need(self, op: str) -> None:
        if not self.take(op):
            self.fail(f"expected {op!r}")

    def need_word(self, *words: str) -> None:
        if not self.take_word(*words):
            self.fail(f"expected {' '.join(words)}")

    def fail(self, what: str):
        t = self.now
        if t.kind == "word" and t.text.upper() in REFUSED:
            raise UnsupportedCypher(f"unsupported clause {t.text.upper()}")
        if t.kind == "op" and t.text == "$":
            raise UnsupportedCypher("unsupported query parameters")
        raise CypherError(f"{what} at {t.at}, found {t.text or 'the end'!r}")

    def name(self) -> str:
        t = self.now
        if t.kind not in ("word", "name"):
            self.fail("expected a name")
        self.at += 1
        return t.text

    def number(self) -> int:
        t = self.now
        if t.kind != "number" or "." in t.text:
            self.fail("expected a whole number")
        self.at += 1
        return int(t.text)

    # clauses

    def query(self) -> Query:
        clauses: list = []
        withs = unwinds = 0
        while True:
            if self.take_word("OPTIONAL", "MATCH"):
                clauses.append(self.match(True))
            elif self.take_word("MATCH"):
                clauses.append(self.match(False))
            elif self.take_word("UNWIND"):
                unwinds += 1
                expr = self.expr()
                self.need_word("AS")
                clauses.append(Unwind(expr, self.name()))
            elif self.take_word("WITH"):
                withs += 1
                p = self.projection()
                p.where = self.expr() if self.take_word("WHERE") else None
                clauses.append(p)
            elif self.take_word("RETURN"):
                ret = self.projection()
                break
            else:
                self.fail("expected a clause")
            if withs > 1 or unwinds > 1:
                raise UnsupportedCypher("unsupported: more than one WITH or UNWIND in a query")
        out = Query(clauses, ret)
        if self.take_word("UNION"):
            out.union = (self.take_word("ALL"), self.query())
        return out

    def match(self, optional: bool) -> Match:
        patterns = [self.pattern()]
        while self.take(","):
            patterns.append(self.pattern())
        return Match(patterns, optional, self.expr() if self.take_word("WHERE") else None)

    def pattern(self) -> Pattern:
        if self.now.kind == "word" and self.tokens[self.at + 1].text == "=":
            raise UnsupportedCypher("unsupported: paths as values")
        if self.now.kind == "word":
            raise UnsupportedCypher(f"unsupported: path function {self.now.text}")
        nodes, rels = [self.node()], []
        while self.now.kind == "op" and self.now.text in ("-", "<-"):
            rels.append(self.rel())
            nodes.append(self.node())
        return Pattern(nodes, rels)

    def node(self) -> Node:
        self.need("(")
        var = self.name() if self.now.kind in ("word", "name") else None
        labels = []
        if self.take(":"):
            labels.append(self.name())
            while self.take("|"):
                labels.append(self.name())
        props: dict = {}
        if self.take("{"):
            while not self.take("}"):
                key = self.name()
                self.need(":")
                value = self.atom()
                if value.kind != "lit":
                    raise UnsupportedCypher("unsupported: a property map needs literals")
                props[key] = value.value
                self.take(",")
        self.need(")")
        return Node(var, labels, props)

    def rel(self) -> Rel:
        left = self.take("<-")
        if not left:
            self.need("-")
        var, types, hops = None, [], None
        if self.take("["):
            var = self.name() if self.now.kind in ("word", "name") else None
            if self.take(":"):
                types.append(self.name())
                while self.take("|"):
                    self.take(":")
                    types.append(self.name())
            if self.take("*"):
                low = self.number() if self.now.kind == "number" else None
                if self.take(".."):
                    hops = (1 if low is None else low, self.number() if self.now.kind == "number" else None)
                else:
                    hops = (1, None) if low is None else (low, low)
            self.need("]")
        right = self.take("->")
        if not right:
            self.need("-")
        return Rel(var, types, "any" if left == right else "in" if left else "out", hops)

    def projection(self) -> Projection:
        out = Projection([], distinct=self.take_word("DISTINCT"))
        if self.take("*"):
            out.star = True
        while not out.star:
            start = self.now.at
            expr = self.expr()
            text = self.text[start : self.tokens[self.at - 1].at + len(self.tokens[self.at - 1].text)].strip()
            if expr.kind == "prop":
                text = f"{expr.args[0].value}.{expr.value}"
            out.items.append(Item(expr, self.name() if self.take_word("AS") else text))
            if not self.take(","):
                break
        if self.take_word("ORDER", "BY"):
            while True:
                expr = self.expr()
                down = self.take_word("DESC") or self.take_word("DESCENDING")
                if not down:
                    self.take_word("ASC") or self.take_word("ASCENDING")
                out.order.append((expr, down))
                if not self.take(","):
                    break
            if len(out.order) > MAX_SORT_KEYS:
                raise CypherError(f"more than {MAX_SORT_KEYS} sort keys")
        if self.take_word("SKIP"):
            out.skip = self.number()
        if self.take_word("LIMIT"):
            out.limit = self.number()
        return out

    # expressions

    def expr(self) -> Expr:
        return self.binary(0)

    def binary(self, level: int) -> Expr:
        words = ("OR", "XOR", "AND")
        if level == 3:
            if self.take_word("NOT"):
                return Expr("not", args=[self.binary(3)])
            return self.comparison()
        out = self.binary(level + 1)
        while self.take_word(words[level]):
            out = Expr("op", words[level], [out, self.binary(level + 1)])
        return out

    def comparison(self) -> Expr:
        left = self.sum()
        if self.take_word("IS", "NOT", "NULL"):
            return Expr("not", args=[Expr("is_null", args=[left])])
        if self.take_word("IS", "NULL"):
            return Expr("is_null", args=[left])
        if self.take_word("IN"):
            return Expr("in", args=[left, self.sum()])
        for words in (("STARTS", "WITH"), ("ENDS", "WITH"), ("CONTAINS",)):
            if self.take_word(*words):
                return Expr("op", " ".join(words), [left, self.sum()])
        for op in ("=~", "<>", "!=", "<=", ">=", "=", "<", ">"):
            if self.take(op):
                return Expr("op", "<>" if op == "!=" else op, [left, self.sum()])
        return left

    def sum(self) -> Expr:
        out = self.product()
        while self.now.kind == "op" and self.now.text in "+-":
            op = self.now.text
            self.at += 1
            out = Expr("op", op, [out, self.product()])
        return out

    def product(self) -> Expr:
        out = self.atom()
        while self.now.kind == "op" and self.now.text in "*/%":
            op = self.now.text
            self.at += 1
            out = Expr("op", op, [out, self.atom()])
        return out

    def atom(self) -> Expr:
        t = self.now
        if self.take("("):
            out = self.expr()
            self.need(")")
            return out
        if self.take("-"):
            got = self.atom()
            if got.kind != "lit":
                self.fail("expected a number")
            return Expr("lit", -got.value)
        if self.take("["):
            items = []
            while not self.take("]"):
                items.append(self.expr())
                if self.is_word("IN") or self.is_word("WHERE") or self.now.text == "|":
                    raise UnsupportedCypher("unsupported: list comprehensions")
                self.take(",")
            if any(i.kind == "in" for i in items):
                raise UnsupportedCypher("unsupported: list comprehensions")
            return Expr("list", args=items)
        if t.text == "{" and t.kind == "op":
            raise UnsupportedCypher("unsupported: map literals")
        if t.kind == "number":
            self.at += 1
            return Expr("lit", float(t.text) if "." in t.text else int(t.text))
        if t.kind == "string":
            self.at += 1
            return Expr("lit", t.text)
        for word, value in (("TRUE", True), ("FALSE", False), ("NULL", None)):
            if self.take_word(word):
                return Expr("lit", value)
        if self.take_word("CASE"):
            return self.case()
        if self.is_word("EXISTS") and self.tokens[self.at + 1].text == "{":
            self.at += 2
            self.take_word("MATCH")
            p = self.pattern()
            self.need("}")
            if len(p.rels) != 1:
                raise UnsupportedCypher("unsupported: EXISTS over more than one relationship")
            return Expr("exists", p)
        name = self.name()
        if self.take("("):
            return self.call(name)
        if self.take("."):
            return Expr("prop", self.name(), [Expr("var", name)])
        if self.now.text == ":" and self.now.kind == "op":
            self.at += 1
            return Expr("label", self.name(), [Expr("var", name)])
        return Expr("var", name)

    def call(self, name: str) -> Expr:
        low = name.lower()
        if low not in AGGREGATES | FUNCTIONS:
            raise UnsupportedCypher(f"unsupported function {name}")
        distinct = self.take_word("DISTINCT")
        if low == "count" and self.take("*"):
            self.need(")")
            return Expr("call", ("count", False))
        args = []
        while not self.take(")"):
            args.append(self.expr())
            if not self.take(",") and self.now.text != ")":
                self.fail("expected ')'")
        return Expr("call", (low, distinct), args)

    def case(self) -> Expr:
        subject = None if self.is_word("WHEN") else self.expr()
        branches, other = [], Expr("lit", None)
        while self.take_word("WHEN"):
            when = self.expr()
            self.need_word("THEN")
            branches.append((when if subject is None else Expr("op", "=", [subject, when]), self.expr()))
        if self.take_word("ELSE"):
            other = self.expr()
        self.need_word("END")
        return Expr("case", branches, [other])


def parse(text: str) -> Query:
    p = _Parser(text)
    out = p.query()
    p.take(";")
    if p.now.kind != "end":
        p.fail("expected the end")
    return out
