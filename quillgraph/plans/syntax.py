"""Syntax trees of the Cypher subset, and the parser that builds them."""

from __future__ import annotations

from dataclasses import dataclass, field

from .lexer import CypherError, Token, tokens


@dataclass(frozen=True)
class Literal:
    value: object


@dataclass(frozen=True)
class ListOf:
    items: tuple


@dataclass(frozen=True)
class Param:
    name: str


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Prop:
    owner: object
    name: str


@dataclass(frozen=True)
class Index:
    owner: object
    at: object


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    distinct: bool = False
    star: bool = False


@dataclass(frozen=True)
class Op:
    """A unary or binary operation; `not`, `neg`, `isnull`, `notnull`, `and`, `or`, `xor`, comparisons, arithmetic."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Node:
    var: str
    labels: tuple[str, ...]
    props: tuple[tuple[str, object], ...]
    named: bool


@dataclass(frozen=True)
class Rel:
    var: str
    types: tuple[str, ...]
    props: tuple[tuple[str, object], ...]
    direction: str  # out, in, both
    lo: int | None  # both set for a variable length
    hi: int | None
    named: bool


@dataclass(frozen=True)
class Path:
    var: str | None
    nodes: tuple[Node, ...]
    rels: tuple[Rel, ...]


@dataclass(frozen=True)
class Match:
    paths: tuple[Path, ...]
    where: object | None
    optional: bool


@dataclass(frozen=True)
class Unwind:
    source: object
    var: str


@dataclass(frozen=True)
class Item:
    expr: object
    alias: str


@dataclass(frozen=True)
class Project:
    items: tuple[Item, ...]
    star: bool
    distinct: bool
    order: tuple[tuple[object, bool], ...]  # (expression, descending)
    skip: int | None
    limit: int | None
    where: object | None
    final: bool


@dataclass(frozen=True)
class Exists:
    """EXISTS { ... }: whether a pattern can be found for the variables at hand."""

    match: Match


@dataclass(frozen=True)
class Subquery:
    """CALL { ... }: a query for each row, on the variables that its first WITH imports."""

    query: Union


@dataclass(frozen=True)
class Procedure:
    """CALL name(...) YIELD column AS variable, ...; without YIELD every column under its own name."""

    name: str
    yields: tuple[tuple[str, str], ...]
    where: object | None


@dataclass
class Query:
    clauses: list = field(default_factory=list)


@dataclass
class Union:
    parts: list[Query]
    all: bool


AGGREGATES = frozenset({"count", "sum", "avg", "min", "max", "collect"})
RESERVED = frozenset(
    "match optional where with return union unwind order skip limit as and or xor not in is null starts ends contains distinct by asc desc ascending descending true false all on call yield".split()
)


class Parser:
    def __init__(self, text: str):
        self.text, self.toks, self.at, self.fresh = text, tokens(text), 0, 0

    # helpers
    @property
    def now(self) -> Token:
        return self.toks[self.at]

    def word(self, *names: str, ahead: int = 0) -> bool:
        t = self.toks[min(self.at + ahead, len(self.toks) - 1)]
        return t.kind == "name" and t.text.lower() in names

    def sym(self, *texts: str, ahead: int = 0) -> bool:
        t = self.toks[min(self.at + ahead, len(self.toks) - 1)]
        return t.kind == "symbol" and t.text in texts

    def fail(self, wanted: str):
        raise CypherError(f"expected {wanted} at {self.now.at}, found {self.now.text or 'the end'!r}")

    def take(self, text: str) -> Token:
        if not (self.sym(text) or self.word(text)):
            self.fail(text)
        self.at += 1
        return self.toks[self.at - 1]

    def maybe(self, text: str) -> bool:
        if self.sym(text) or self.word(text):
            self.at += 1
            return True
        return False

    def name(self) -> str:
        if self.now.kind == "quoted" or self.now.kind == "name":
            self.at += 1
            return self.toks[self.at - 1].text
        self.fail("a name")

    def anonymous(self, kind: str) -> str:
        self.fresh += 1
        return f"_{kind}{self.fresh}"

    # query
    def parse(self) -> Union:
        parts, keep_all = [self.single()], None
        while self.maybe("union"):
            every = self.maybe("all")
            if keep_all not in (None, every):
                raise CypherError("UNION and UNION ALL cannot be mixed")
            keep_all = every
            parts.append(self.single())
        self.maybe(";")
        if self.now.kind != "end":
            self.fail("the end")
        return Union(parts, bool(keep_all))

    def single(self) -> Query:
        out = Query()
        while True:
            if self.word("match") or self.word("optional"):
                optional = self.maybe("optional")
                self.take("match")
                paths = [self.path()]
                while self.maybe(","):
                    paths.append(self.path())
                out.clauses.append(Match(tuple(paths), self.expr() if self.maybe("where") else None, optional))
            elif self.maybe("unwind"):
                source = self.expr()
                self.take("as")
                out.clauses.append(Unwind(source, self.name()))
            elif self.maybe("call"):
                out.clauses.append(self.call())
                if isinstance(out.clauses[-1], Procedure) and self.now.kind == "end":
                    yields = out.clauses[-1].yields
                    out.clauses.append(Project(tuple(Item(Var(v), v) for _, v in yields), not yields, False, (), None, None, None, True))
                    return out
            elif self.maybe("with"):
                out.clauses.append(self.projection(False))
            elif self.maybe("return"):
                out.clauses.append(self.projection(True))
                return out
            else:
                self.fail("MATCH, OPTIONAL MATCH, UNWIND, CALL, WITH or RETURN")

    def call(self) -> Subquery | Procedure:
        if self.maybe("{"):
            parts, every = [self.single()], False
            while self.maybe("union"):
                every = self.maybe("all") or every
                parts.append(self.single())
            self.take("}")
            return Subquery(Union(parts, every))
        name = self.name()
        while self.maybe("."):
            name += "." + self.name()
        if self.maybe("("):
            self.take(")")
        yields, where = [], None
        if self.maybe("yield"):
            while True:
                column = self.name()
                yields.append((column, self.name() if self.maybe("as") else column))
                if not self.maybe(","):
                    break
            where = self.expr() if self.maybe("where") else None
        return Procedure(name.lower(), tuple(yields), where)

    def projection(self, final: bool) -> Project:
        distinct, star, items = self.maybe("distinct"), False, []
        if self.maybe("*"):
            star = True
            more = self.maybe(",")
        else:
            more = True
        while more:
            start = self.now.at
            e = self.expr()
            end = self.now.at
            alias = self.name() if self.maybe("as") else self.alias(e, self.text[start:end])
            items.append(Item(e, alias))
            more = self.maybe(",")
        order, skip, limit, where = [], None, None, None
        if self.maybe("order"):
            self.take("by")
            while True:
                e = self.expr()
                down = self.maybe("desc") or self.maybe("descending")
                _ = down or self.maybe("asc") or self.maybe("ascending")
                order.append((e, down))
                if not self.maybe(","):
                    break
        if self.maybe("skip"):
            skip = self.count()
        if self.maybe("limit"):
            limit = self.count()
        if not final and self.maybe("where"):
            where = self.expr()
        return Project(tuple(items), star, distinct, tuple(order), skip, limit, where, final)

    def count(self) -> int:
        if self.now.kind != "number" or not self.now.text.isdigit():
            self.fail("a whole number")
        self.at += 1
        return int(self.toks[self.at - 1].text)

    @staticmethod
    def alias(e, text: str) -> str:
        if isinstance(e, Var):
            return e.name
        if isinstance(e, Prop) and isinstance(e.owner, Var):
            return f"{e.owner.name}_{e.name}"
        return "".join(c if c.isalnum() else "_" for c in text.strip()).strip("_")

    # patterns
    def path(self) -> Path:
        var = None
        if self.now.kind in ("name", "quoted") and self.sym("=", ahead=1):
            var = self.name()
            self.take("=")
        nodes, rels = [self.node()], []
        while self.sym("-") or self.sym("<"):
            rels.append(self.rel())
            nodes.append(self.node())
        return Path(var, tuple(nodes), tuple(rels))

    def node(self) -> Node:
        self.take("(")
        named = self.now.kind in ("name", "quoted")
        var, labels = self.name() if named else self.anonymous("n"), []
        while self.maybe(":"):
            labels.append(self.name())
        props = self.map() if self.sym("{") else ()
        self.take(")")
        return Node(var, tuple(labels), props, named)

    def rel(self) -> Rel:
        left = self.maybe("<")
        self.take("-")
        var, types, props, lo, hi, named = self.anonymous("r"), [], (), None, None, False
        if self.maybe("["):
            if self.now.kind in ("name", "quoted"):
                var, named = self.name(), True
            if self.maybe(":"):
                types.append(self.name())
                while self.maybe("|"):
                    self.maybe(":")
                    types.append(self.name())
            if self.maybe("*"):
                lo = self.count() if self.now.kind == "number" else None
                if self.maybe(".."):
                    hi = self.count() if self.now.kind == "number" else -1
                elif lo is not None:
                    hi = lo
                lo, hi = 1 if lo is None else lo, -1 if hi is None else hi
            if self.sym("{"):
                props = self.map()
            self.take("]")
        self.take("-")
        right = self.maybe(">")
        if left and right:
            raise CypherError(f"a relationship cannot point both ways at {self.now.at}")
        return Rel(var, tuple(types), props, "in" if left else "out" if right else "both", lo, hi, named)

    def map(self) -> tuple:
        self.take("{")
        out = []
        while not self.sym("}"):
            key = self.name()
            self.take(":")
            out.append((key, self.expr()))
            if not self.maybe(","):
                break
        self.take("}")
        return tuple(out)

    # expressions, weakest binding first
    def expr(self):
        left = self.xor()
        while self.maybe("or"):
            left = Op("or", (left, self.xor()))
        return left

    def xor(self):
        left = self.conj()
        while self.maybe("xor"):
            left = Op("xor", (left, self.conj()))
        return left

    def conj(self):
        left = self.negation()
        while self.maybe("and"):
            left = Op("and", (left, self.negation()))
        return left

    def negation(self):
        if self.maybe("not"):
            return Op("not", (self.negation(),))
        return self.comparison()

    def comparison(self):
        left = self.sum()
        while True:
            if self.sym("=", "<>", "<", ">", "<=", ">=", "=~"):
                op = self.now.text
                self.at += 1
                left = Op(op, (left, self.sum()))
            elif self.maybe("contains"):
                left = Op("contains", (left, self.sum()))
            elif self.word("starts", "ends"):
                op = self.now.text.lower()
                self.at += 1
                self.take("with")
                left = Op(op, (left, self.sum()))
            elif self.maybe("in"):
                left = Op("in", (left, self.sum()))
            elif self.maybe("is"):
                op = "notnull" if self.maybe("not") else "isnull"
                self.take("null")
                left = Op(op, (left,))
            else:
                return left

    def sum(self):
        left = self.product()
        while self.sym("+", "-"):
            op = self.now.text
            self.at += 1
            left = Op(op, (left, self.product()))
        return left

    def product(self):
        left = self.unary()
        while self.sym("*", "/", "%"):
            op = self.now.text
            self.at += 1
            left = Op(op, (left, self.unary()))
        return left

    def unary(self):
        if self.maybe("-"):
            return Op("neg", (self.unary(),))
        return self.postfix()

    def postfix(self):
        e = self.atom()
        while True:
            if self.sym(".") and not self.sym("..", ahead=0):
                self.at += 1
                e = Prop(e, self.name())
            elif self.maybe("["):
                e = Index(e, self.expr())
                self.take("]")
            else:
                return e

    def atom(self):
        t = self.now
        if t.kind == "number":
            self.at += 1
            return Literal(int(t.text) if t.text.isdigit() else float(t.text))
        if t.kind == "string":
            self.at += 1
            return Literal(t.text)
        if t.kind == "param":
            self.at += 1
            return Param(t.text[1:])
        if self.maybe("("):
            e = self.expr()
            self.take(")")
            return e
        if self.maybe("["):
            items = []
            while not self.sym("]"):
                items.append(self.expr())
                if not self.maybe(","):
                    break
            self.take("]")
            return ListOf(tuple(items))
        if t.kind == "name" and t.text.lower() in ("true", "false", "null") and not self.sym("(", ahead=1):
            self.at += 1
            return Literal({"true": True, "false": False, "null": None}[t.text.lower()])
        if t.kind == "name" and t.text.lower() == "case" and not self.sym("(", ahead=1):
            return self.case()
        if t.kind == "name" and t.text.lower() == "exists" and self.sym("{", ahead=1):
            self.at += 2
            self.maybe("match")
            paths = [self.path()]
            while self.maybe(","):
                paths.append(self.path())
            where = self.expr() if self.maybe("where") else None
            self.take("}")
            return Exists(Match(tuple(paths), where, False))
        if t.kind == "name" and self.sym("(", ahead=1):
            self.at += 2
            if self.maybe("*"):
                self.take(")")
                return Call(t.text.lower(), (), star=True)
            distinct, args = self.maybe("distinct"), []
            while not self.sym(")"):
                args.append(self.expr())
                if not self.maybe(","):
                    break
            self.take(")")
            return Call(t.text.lower(), tuple(args), distinct)
        if t.kind == "quoted" or t.kind == "name" and t.text.lower() not in RESERVED:
            self.at += 1
            return Var(t.text)
        self.fail("an expression")


    def case(self):
        """CASE [subject] WHEN ... THEN ... [ELSE ...] END, as conditions and values in turn and the value otherwise."""
        self.take("case")
        subject = None if self.word("when") else self.expr()
        args = []
        while self.maybe("when"):
            test = self.expr()
            self.take("then")
            args += [test if subject is None else Op("=", (subject, test)), self.expr()]
        if not args:
            self.fail("WHEN")
        args.append(self.expr() if self.maybe("else") else Literal(None))
        self.take("end")
        return Op("case", tuple(args))


def parse(text: str) -> Union:
    """The syntax tree of a query; CypherError if it is none of the subset."""
    return Parser(text).parse()


def walk(e):
    """An expression and everything inside it."""
    yield e
    for child in getattr(e, "args", None) or getattr(e, "items", None) or [getattr(e, k) for k in ("owner", "at") if hasattr(e, k) and not isinstance(getattr(e, k), (str, int))]:
        yield from walk(child)
