"""Binding of syntax trees to a catalog, and the DataFrame plans they become.

Every bound node and relationship keeps an identity column until the last projection, so grouping, counting and
relationship uniqueness go by identity, not by properties. The plan builder applies rules that Catalyst has no means
for: types are enumerated by the labels they can join, undirected hops become a union of both directions without
swapped self-loops, only relationships that can be the same edge are held apart, patterns are entered at their most
selective node, a node table is joined only if a property of it is read, and only columns that the query names are
carried.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import frontier
from .catalog import EdgeTable, Graph
from .lexer import CypherError
from .syntax import AGGREGATES, Call, Exists, Index, Item, ListOf, Literal, Match, Node, Op, Param, Procedure, Project, Prop, Query, Rel, Subquery, Union, Unwind, Var, parse, walk

#: Functions whose value is a list.
LISTS = frozenset(("collect", "labels", "nodes", "relationships", "range", "split", "keys"))
MOST_HOPS = 30


@dataclass(frozen=True)
class Bound:
    """What a name stands for: a node, a relationship, a path or a value."""

    kind: str
    labels: frozenset[str] = frozenset()  # of a node
    props: tuple[str, ...] = ()  # columns at hand
    text_id: bool = False  # ids are compared as text, since several labels are possible


Scope = dict[str, Bound]


def c(name: str) -> Column:
    return F.col(f"`{name}`")


def _id(var: str) -> str:
    return f"{var}__id"


def _label(var: str) -> str:
    return f"{var}__label"


def _prop(var: str, name: str) -> str:
    return f"{var}__p_{name}"


def _value(var: str) -> str:
    return f"{var}__v"


def _columns(var: str, b: Bound) -> list[str]:
    if b.kind in ("node", "rel"):
        return [_id(var), _label(var), *(_prop(var, p) for p in b.props)]
    return [_value(var)]


@dataclass
class Uses:
    """Properties that a query reads of each variable, and variables it returns whole."""

    props: dict[str, set[str]] = field(default_factory=dict)
    whole: set[str] = field(default_factory=set)

    def expression(self, e, whole: bool) -> None:
        if isinstance(e, Prop) and isinstance(e.owner, Var):
            self.props.setdefault(e.owner.name, set()).add(e.name)
        elif isinstance(e, Var):
            if whole:
                self.whole.add(e.name)
        elif isinstance(e, Call):
            for a in e.args:
                self.expression(a, whole and e.name == "collect" or e.name in ("properties", "collect"))
        elif isinstance(e, Op):
            for a in e.args:
                self.expression(a, False)
        elif isinstance(e, Index):
            self.expression(e.owner, whole)
            self.expression(e.at, False)
        elif isinstance(e, ListOf):
            for a in e.items:
                self.expression(a, whole)
        elif isinstance(e, Exists):
            self.match(e.match)

    def match(self, match: Match) -> None:
        if match.where is not None:
            self.expression(match.where, False)
        for path in match.paths:
            for part in (*path.nodes, *path.rels):
                for _, e in part.props:
                    self.expression(e, False)

    @classmethod
    def of(cls, query: Query, inner: bool = False, uses: Uses | None = None) -> Uses:
        uses = uses or cls()
        for clause in query.clauses:
            if isinstance(clause, Match):
                uses.match(clause)
            elif isinstance(clause, Unwind):
                uses.expression(clause.source, False)
            elif isinstance(clause, Subquery):
                for part in clause.query.parts:
                    cls.of(part, True, uses)
            elif isinstance(clause, Procedure):
                if clause.where is not None:
                    uses.expression(clause.where, False)
            else:
                for item in clause.items:
                    uses.expression(item.expr, clause.final and not inner)
                for e, _ in clause.order:
                    uses.expression(e, False)
                if clause.where is not None:
                    uses.expression(clause.where, False)
        return uses


def _aggregates(e) -> bool:
    return any(isinstance(x, Call) and x.name in AGGREGATES for x in walk(e))


def _emptied(e):
    """An expression with its aggregates over no rows."""
    if isinstance(e, Call) and e.name in AGGREGATES:
        return Literal(0) if e.name in ("count", "sum") else ListOf(()) if e.name == "collect" else Literal(None)
    if isinstance(e, Call | Op):
        return replace(e, args=tuple(map(_emptied, e.args)))
    return e


def _replaced(e, old, new):
    """An expression with a part of it replaced."""
    if e == old:
        return new
    return replace(e, args=tuple(_replaced(a, old, new) for a in e.args)) if isinstance(e, Call | Op) else e


def _deep(e):
    """An expression and the conditions of patterns inside it."""
    for x in walk(e):
        yield x
        if isinstance(x, Exists):
            for part in (p for path in x.match.paths for p in (*path.nodes, *path.rels)):
                for _, own in part.props:
                    yield from _deep(own)
            if x.match.where is not None:
                yield from _deep(x.match.where)


class Compiler:
    def __init__(self, spark: SparkSession, graph: Graph, params: dict | None = None):
        self.spark, self.graph, self.params = spark, graph, params or {}
        self.uses = Uses()

    # queries
    def query(self, text: str) -> DataFrame:
        tree: Union = parse(text)
        frames = [self.single(q) for q in tree.parts]
        if any(sorted(f.columns) != sorted(frames[0].columns) for f in frames):
            raise CypherError("the parts of a UNION must return the same columns")
        out = reduce(DataFrame.unionByName, frames)
        return out if tree.all or len(frames) == 1 else out.distinct()

    def single(self, query: Query) -> DataFrame:
        self.uses = Uses.of(query)
        return self.clauses(None, {}, query.clauses, ())[0]

    def clauses(self, df: DataFrame | None, scope: Scope, clauses: list, keep: tuple[str, ...]) -> tuple[DataFrame, Scope]:
        """Clauses in order. `keep` are variables of an outer query, for each binding of which they stand alone."""
        for clause in clauses:
            if isinstance(clause, Match):
                df, scope = self.optional(df, scope, clause) if clause.optional else self.match(df, scope, clause)
            elif isinstance(clause, Unwind):
                source = self.expr(clause.source, scope)
                df = (self.one_row() if df is None else df).withColumn(_value(clause.var), F.explode(source))
                scope = scope | {clause.var: Bound("value")}
            elif isinstance(clause, Subquery):
                df, scope = self.subquery(self.one_row() if df is None else df, scope, clause.query)
            elif isinstance(clause, Procedure):
                df, scope = self.procedure(df, scope, clause)
            else:
                df, scope = self.project(self.one_row() if df is None else df, scope, clause, keep)
        return df, scope

    # subqueries and procedures
    def filtered(self, df: DataFrame, scope: Scope, where) -> DataFrame:
        """Rows for which a condition holds. An EXISTS that stands alone, or negated, is a semi or anti join; inside
        other conditions it is a flag that is joined on."""
        if isinstance(where, Op) and where.name == "and":
            return self.filtered(self.filtered(df, scope, where.args[0]), scope, where.args[1])
        negated, e = False, where
        while isinstance(e, Op) and e.name == "not":
            negated, e = not negated, e.args[0]
        if isinstance(e, Exists):
            return self.found(df, scope, e.match, "left_anti" if negated else "left_semi")
        columns = df.columns
        for n, inner in enumerate(dict.fromkeys(x for x in walk(where) if isinstance(x, Exists))):
            df = self.found(df, scope, inner.match, "left", f"__found{n}")
            where, scope = _replaced(where, inner, Var(f"__found{n}")), scope | {f"__found{n}": Bound("value")}
        return df.where(self.expr(where, scope)).select(*(c(k) for k in columns))

    def found(self, df: DataFrame, scope: Scope, match: Match, how: str, flag: str = "") -> DataFrame:
        """df joined with the distinct bindings of its variables for which the pattern is found."""
        named = {x.var for p in match.paths for x in (*p.nodes, *p.rels)}
        inside = [match.where, *(e for p in match.paths for x in (*p.nodes, *p.rels) for _, e in x.props)]
        named |= {x.name for e in inside if e is not None for y in _deep(e) for x in walk(y) if isinstance(x, Var)} | {x.var for e in inside if e is not None for y in _deep(e) if isinstance(y, Exists) for p in y.match.paths for x in p.nodes}
        shared = [v for v in scope if v in named and scope[v].kind != "rels"]
        held = [k for v in shared for k in _columns(v, scope[v])]
        inner, _ = self.match(df.select(*(c(k) for k in held)).distinct() if held else None, {v: scope[v] for v in shared}, match)
        keys = inner.select(*(c(k).alias(f"__{k}") for k in held), F.lit(True).alias("__hit"))
        keys = keys.distinct() if held else keys.limit(1)
        on = reduce(lambda x, y: x & y, (c(k).eqNullSafe(c(f"__{k}")) for k in held), F.lit(True))
        out = df.join(keys, on, how)
        return out if how != "left" else out.withColumn(_value(flag), F.coalesce("__hit", F.lit(False))).drop("__hit", *(f"__{k}" for k in held))

    def subquery(self, df: DataFrame, scope: Scope, union: Union) -> tuple[DataFrame, Scope]:
        """A query for each row: run once for the distinct values of what it imports, grouped and cut by them, and joined back.

        Where it only aggregates, a row for which nothing is found has the aggregates of no rows.
        """
        parts, held, defaults, after = [], None, {}, {}
        for query in union.parts:
            first, clauses = query.clauses[0], list(query.clauses)
            imports: tuple[str, ...] = ()
            if isinstance(first, Project) and not first.final and not first.order and first.limit is None and first.where is None and all(isinstance(i.expr, Var) and i.alias == i.expr.name for i in first.items):
                imports, clauses = tuple(i.alias for i in first.items) or tuple(v for v in scope if scope[v].kind != "rels"), clauses[1:]
            for v in imports:
                self._lookup(v, scope)
            own = [k for v in imports for k in _columns(v, scope[v])]
            if held is not None and held != own:
                raise CypherError("the parts of a subquery must import the same variables")
            held = own
            last = clauses[-1] = replace(clauses[-1], final=False)
            inner, found = self.clauses(df.select(*(c(k) for k in held)).distinct() if held else None, {v: scope[v] for v in imports}, clauses, imports)
            after = {v: b for v, b in found.items() if v not in imports}
            if any(v in scope for v in after):
                raise CypherError("a subquery returns a variable that is bound already")
            if len(union.parts) == 1 and last.items and not last.star and all(_aggregates(i.expr) for i in last.items):
                defaults = {_value(i.alias): self.expr(_emptied(i.expr), {}) for i in last.items}
            fresh = [k for v, b in after.items() for k in _columns(v, b)]
            parts.append(inner.select(*(c(k).alias(f"__{k}") for k in held), *(c(k) for k in fresh)))
        if any(sorted(p.columns) != sorted(parts[0].columns) for p in parts):
            raise CypherError("the parts of a UNION must return the same columns")
        found = reduce(DataFrame.unionByName, parts)
        found = found if union.all or len(parts) == 1 else found.distinct()
        if not held:
            return df.crossJoin(found), scope | after
        on = reduce(lambda x, y: x & y, (c(k).eqNullSafe(c(f"__{k}")) for k in held))
        out = df.join(found, on, "left" if defaults else "inner").drop(*(f"__{k}" for k in held))
        kinds = {f.name: f.dataType for f in found.schema.fields}
        return out.withColumns({k: F.coalesce(c(k), e.cast(kinds[k])) for k, e in defaults.items()}), scope | after

    def procedure(self, df: DataFrame | None, scope: Scope, call: Procedure) -> tuple[DataFrame, Scope]:
        """A table of the catalog for every row so far."""
        schema = self.graph.schema
        tables = {
            "db.labels": ("label", schema.labels), "db.relationshiptypes": ("relationshipType", schema.types),
            "db.propertykeys": ("propertyKey", sorted({p for names in schema.props.values() for p in names})),
        }
        if call.name not in tables:
            raise CypherError(f"unknown procedure {call.name}")
        column, values = tables[call.name]
        yields = call.yields or ((column, column),)
        if any(name != column for name, _ in yields):
            raise CypherError(f"{call.name} yields {column}")
        rows = self.spark.createDataFrame([(v,) for v in values], "v string").select(*(c("v").alias(_value(v)) for _, v in yields))
        rows = F.broadcast(rows)  # as many as the catalog has names: Spark does not know, and would move the nodes to them
        df = rows if df is None else df.crossJoin(rows)
        scope = scope | {v: Bound("value") for _, v in yields}
        return (df if call.where is None else self.filtered(df, scope, call.where)), scope

    def one_row(self) -> DataFrame:
        return self.spark.range(1).select()

    # patterns
    def _props_of(self, var: str, labels: frozenset[str]) -> list[str]:
        every = list(dict.fromkeys(p for v in sorted(labels) for p in self.graph.nodes[v].props))
        return every if var in self.uses.whole else [p for p in every if p in self.uses.props.get(var, ())]

    def _equal(self, frame: DataFrame, props, scope: Scope) -> Column | None:
        """The condition of an inline map on the columns of a base table."""
        tests = []
        for name, e in props:
            value = self.expr(e, scope)
            tests.append(c(name) == value if name in frame.columns else F.lit(False))
        return reduce(lambda a, b: a & b, tests) if tests else None

    def node_frame(self, node: Node, bound: Bound) -> DataFrame:
        parts = []
        for label in sorted(bound.labels):
            table = self.graph.nodes[label]
            frame = table.frame
            test = self._equal(frame, node.props, {})
            frame = frame if test is None else frame.where(test)
            key = c(table.id).cast("string") if bound.text_id else c(table.id)
            parts.append(
                frame.select(key.alias(_id(node.var)), F.lit(label).alias(_label(node.var)), *(c(p).alias(_prop(node.var, p)) for p in bound.props if p in frame.columns))
            )
        if not parts:
            raise CypherError(f"no label fits ({node.var})")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def tables(self, rel: Rel, left: frozenset[str], right: frozenset[str]) -> list[tuple[EdgeTable, bool]]:
        """Relationship tables that can join the labels, each with whether it is walked against its direction."""
        out = []
        for e in self.graph.edges:
            if rel.types and e.type not in rel.types:
                continue
            if rel.direction in ("out", "both") and e.source in left and e.target in right:
                out.append((e, False))
            if rel.direction in ("in", "both") and e.target in left and e.source in right:
                out.append((e, True))
        return out

    def edge_frame(self, rel: Rel, left: Bound, right: Bound) -> DataFrame:
        """(r__from, r__from_label, r__to, r__to_label, r__id, r__label, properties) as seen from the left end."""
        wanted = self._rel_props(rel)
        parts = []
        for e, against in self.tables(rel, left.labels, right.labels):
            frame = e.frame
            test = self._equal(frame, rel.props, {})
            frame = frame if test is None else frame.where(test)
            both = rel.direction == "both" and e.source == e.target
            if both and against:  # a self-loop is met once, not in both directions
                frame = frame.where(c(e.src) != c(e.dst))
            a, b = (e.dst, e.src) if against else (e.src, e.dst)
            la, lb = (e.target, e.source) if against else (e.source, e.target)
            key = F.concat_ws(":", F.lit(e.type), *(c(k).cast("string") for k in e.id))
            parts.append(
                frame.select(
                    (c(a).cast("string") if left.text_id else c(a)).alias(f"{rel.var}__from"), F.lit(la).alias(f"{rel.var}__from_label"),
                    (c(b).cast("string") if right.text_id else c(b)).alias(f"{rel.var}__to"), F.lit(lb).alias(f"{rel.var}__to_label"),
                    key.alias(_id(rel.var)), F.lit(e.type).alias(_label(rel.var)), *(c(p).alias(_prop(rel.var, p)) for p in wanted if p in frame.columns),
                )
            )
        if not parts:
            raise CypherError(f"no relationship [{rel.var}{':' + '|'.join(rel.types) if rel.types else ''}] joins {sorted(left.labels)} and {sorted(right.labels)}")
        return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)

    def _rel_props(self, rel: Rel) -> list[str]:
        every = list(dict.fromkeys(p for e in self.graph.edges if not rel.types or e.type in rel.types for p in e.props))
        return every if rel.var in self.uses.whole else [p for p in every if p in self.uses.props.get(rel.var, ())]

    def _labels(self, match: Match, scope: Scope) -> dict[str, frozenset[str]]:
        """Possible labels of each node variable: those it names, narrowed by what relationships can join."""
        every = frozenset(self.graph.nodes)
        labels: dict[str, frozenset[str]] = {}
        for path in match.paths:
            for n in path.nodes:
                own = labels.get(n.var, scope[n.var].labels if n.var in scope else every)
                for name in n.labels:
                    if name not in every:
                        raise CypherError(f"unknown label {name}")
                    own &= {name}
                labels[n.var] = own
        changed = True
        while changed:
            changed = False
            for path in match.paths:
                for a, r, b in zip(path.nodes, path.rels, path.nodes[1:], strict=False):
                    if r.hi is not None:
                        continue
                    fits = [(e.target, e.source) if against else (e.source, e.target) for e, against in self.tables(r, labels[a.var], labels[b.var])]
                    for var, own in ((a.var, frozenset(x for x, _ in fits)), (b.var, frozenset(y for _, y in fits))):
                        if labels[var] - own:
                            labels[var], changed = labels[var] & own, True
        return labels

    def match(self, df: DataFrame | None, scope: Scope, match: Match) -> tuple[DataFrame, Scope]:
        labels = self._labels(match, scope)
        nodes: dict[str, Node] = {}
        for path in match.paths:
            for n in path.nodes:
                nodes[n.var] = replace(n, props=tuple(dict.fromkeys((*nodes[n.var].props, *n.props)))) if n.var in nodes else n
        for var, own in labels.items():
            if not own:
                raise CypherError(f"no label fits ({var})")
            if var in scope and scope[var].kind != "node":
                raise CypherError(f"{var} is no node")
        known = dict(scope)
        plan = {
            v: scope.get(v) or Bound("node", labels[v], tuple(self._props_of(v, labels[v])), len(labels[v]) > 1) for v in nodes
        }
        steps = [(path, a, r, b) for path in match.paths for a, r, b in zip(path.nodes, path.rels, path.nodes[1:], strict=False)]
        done: list[Rel] = []

        def reads_node(v: str) -> bool:
            return bool(plan[v].props or nodes[v].props)

        def bind(frame: DataFrame, v: str) -> DataFrame:
            """Join the node table of a variable whose id is at hand, if something of it is read."""
            known[v] = plan[v]
            if not reads_node(v):
                return frame
            table = self.node_frame(nodes[v], plan[v])
            on = [_id(v)] + ([_label(v)] if len(plan[v].labels) > 1 else [])
            if len(on) == 1:
                table = table.drop(_label(v))
            return frame.join(table, on)

        def checked(frame: DataFrame, v: str) -> DataFrame:
            """Apply inline properties to a variable bound by an earlier clause."""
            for name, e in nodes[v].props:
                frame = frame.where(c(_prop(v, name)) == self.expr(e, known)) if name in known[v].props else frame.where(F.lit(False))
            return frame

        for v in nodes:
            if v in scope:
                df = checked(df, v)
        equalities = self._where_equalities(match.where)

        def appeal(v: str) -> tuple:
            names = {p for p, _ in nodes[v].props}
            keyed = any(self.graph.nodes[x].id in names for x in plan[v].labels)
            return (keyed, bool(names), v in equalities)

        left = list(steps)
        waiting = [v for v in nodes if v not in known]
        while left or waiting:
            at_hand = [s for s in left if s[1].var in known or s[3].var in known]
            if not at_hand:
                # a new component starts at its most selective node, or at a relationship if no node is read
                v = max(waiting, key=lambda x: (appeal(x), -waiting.index(x)))
                near = [s for s in left if v in (s[1].var, s[3].var) and s[2].hi is None]
                if not reads_node(v) and near and near[0][1].var != near[0][3].var:
                    _, a, r, b = near[0]
                    frame = self._renamed(self.edge_frame(r, plan[a.var], plan[b.var]), r, a.var, b.var)
                    frame = bind(bind(frame, a.var), b.var)
                    left.remove(near[0])
                    done.append(r)
                    known[r.var] = self._rel_bound(r)
                else:
                    frame = self.node_frame(nodes[v], plan[v])
                    known[v] = plan[v]
                df = frame if df is None else df.crossJoin(frame)
            else:
                at_hand.sort(key=lambda s: (not (s[1].var in known and s[3].var in known), s[2].hi is not None, tuple(not x for x in appeal(s[3].var if s[1].var in known else s[1].var))))
                step = at_hand[0]
                _, a, r, b = step
                left.remove(step)
                df = self._hop(df, known, plan, a.var, r, b.var, nodes, bind)
                done.append(r)
            waiting = [v for v in nodes if v not in known]
        df = self._apart(df, done)
        for path in match.paths:
            if path.var:
                fixed = sum(r.hi is None for r in path.rels)
                length = reduce(lambda x, y: x + y, (F.size(c(f"{r.var}__ids")) for r in path.rels if r.hi is not None), F.lit(fixed))
                df, known[path.var] = df.withColumn(_value(path.var), length.cast("long")), Bound("value")
        if match.where is not None:
            df = self.filtered(df, known, match.where)
        return df, known

    @staticmethod
    def _where_equalities(where) -> set[str]:
        if where is None:
            return set()
        return {a.owner.name for e in walk(where) if isinstance(e, Op) and e.name == "=" for a in e.args if isinstance(a, Prop) and isinstance(a.owner, Var)}

    def _rel_bound(self, r: Rel) -> Bound:
        return Bound("rel", frozenset(r.types), tuple(self._rel_props(r)))

    def _renamed(self, frame: DataFrame, r: Rel, a: str, b: str) -> DataFrame:
        names = {f"{r.var}__from": _id(a), f"{r.var}__from_label": _label(a), f"{r.var}__to": _id(b), f"{r.var}__to_label": _label(b)}
        frame = frame.withColumnsRenamed(names)
        for p in self._rel_props(r):
            if _prop(r.var, p) not in frame.columns:
                frame = frame.withColumn(_prop(r.var, p), F.lit(None))
        return frame

    def _hop(self, df: DataFrame, known: Scope, plan: dict[str, Bound], a: str, r: Rel, b: str, nodes: dict[str, Node], bind) -> DataFrame:
        """Follow a relationship from an end that is bound."""
        if a not in known:
            turned = {"out": "in", "in": "out", "both": "both"}[r.direction]
            return self._hop(df, known, plan, b, replace(r, direction=turned), a, nodes, bind)
        if r.hi is not None:
            return self._walk(df, known, plan, a, r, b, nodes, bind)
        frame = self._renamed(self.edge_frame(r, known[a], known.get(b, plan[b])), r, a, b) if a != b else self.edge_frame(r, known[a], known[a])
        known[r.var] = self._rel_bound(r)
        if a == b:
            frame = frame.where(c(f"{r.var}__from") == c(f"{r.var}__to"))
            frame = self._renamed(frame.drop(f"{r.var}__to", f"{r.var}__to_label"), r, a, a)
            on = [_id(a)] + ([_label(a)] if len(known[a].labels) > 1 else [])
            return df.join(frame if len(on) > 1 else frame.drop(_label(a)), on)
        on = [_id(a)] + ([_label(a)] if len(known[a].labels) > 1 else [])
        frame = frame if len(on) > 1 else frame.drop(_label(a))
        if b in known:
            on += [_id(b)] + ([_label(b)] if len(known[b].labels) > 1 else [])
            return df.join(frame if _label(b) in on else frame.drop(_label(b)), on)
        return bind(df.join(frame, on), b)

    def _leaving(self, r: Rel) -> frontier.Leaving:
        """Relationships that leave nodes of some labels, of whatever label they reach."""
        every = Bound("node", frozenset(self.graph.nodes), (), True)

        def leaving(labels: frozenset[str]) -> tuple[DataFrame, frozenset[str]] | None:
            fits = self.tables(r, labels, every.labels)
            if not fits:
                return None
            edges = self.edge_frame(r, Bound("node", labels, (), True), every)
            names = (f"{r.var}__from", f"{r.var}__from_label", f"{r.var}__to", f"{r.var}__to_label", _id(r.var))
            return edges.select(*(c(x).alias(y) for x, y in zip(names, frontier.EDGE, strict=True))), frozenset(e.source if against else e.target for e, against in fits)

        return leaving

    def _walk(self, df: DataFrame, known: Scope, plan: dict[str, Bound], a: str, r: Rel, b: str, nodes: dict[str, Node], bind) -> DataFrame:
        """Follow a relationship of variable length from the distinct nodes at hand, and from the other end too if that
        is bound or has properties of its own; then join the trails back."""
        if r.hi < 0 or r.hi > MOST_HOPS:
            raise CypherError(f"a variable length needs an upper bound of at most {MOST_HOPS}")
        if r.lo and self._leaving(r)(known[a].labels) is None:
            raise CypherError(f"no relationship of [{r.var}] leaves {sorted(known[a].labels)}")
        ids = f"{r.var}__ids"
        ends = lambda frame, v: frame.select(c(_id(v)).cast("string").alias("start"), c(_label(v)).alias("start_label")).distinct()
        turned = replace(r, direction={"out": "in", "in": "out", "both": "both"}[r.direction])
        other = df if b in known else self.node_frame(nodes[b], plan[b]) if nodes[b].props else None
        if other is not None:
            trails = frontier.two_sided(ends(df, a), known[a].labels, self._leaving(r), ends(other, b), plan[b].labels, self._leaving(turned), r.lo, r.hi)
        else:
            trails = frontier.one_sided(ends(df, a), known[a].labels, self._leaving(r), r.lo, r.hi).where(c("at_label").isin(*plan[b].labels))
        known[r.var] = Bound("rels")
        walked = trails.select(*(c(x).alias(f"{r.var}__{x}") for x in ("start", "start_label", "at", "at_label")), c("edges").alias(ids))
        same = (c(_id(a)).cast("string") == c(f"{r.var}__start")) & (c(_label(a)) == c(f"{r.var}__start_label"))
        if b in known:
            same = same & (c(_id(b)).cast("string") == c(f"{r.var}__at")) & (c(_label(b)) == c(f"{r.var}__at_label"))
        out = df.join(walked, same)
        gone = [f"{r.var}__{x}" for x in ("start", "start_label", "at", "at_label")]
        if b in known:
            return out.drop(*gone)
        table = self.graph.nodes[min(plan[b].labels)]
        key = c(f"{r.var}__at") if plan[b].text_id else c(f"{r.var}__at").cast(table.frame.schema[table.id].dataType)
        return bind(out.withColumn(_id(b), key).withColumn(_label(b), c(f"{r.var}__at_label")).drop(*gone), b)

    def _apart(self, df: DataFrame, rels: list[Rel]) -> DataFrame:
        """Within a MATCH no relationship is bound twice; only pairs that share a type can be."""
        for x, y in combinations(rels, 2):
            if x.types and y.types and not set(x.types) & set(y.types):
                continue
            ix, iy = f"{x.var}__ids", f"{y.var}__ids"
            if x.hi is None and y.hi is None:
                df = df.where(c(_id(x.var)) != c(_id(y.var)))
            elif x.hi is not None and y.hi is not None:
                df = df.where(~F.arrays_overlap(c(ix), c(iy)))
            else:
                one, many = (y, ix) if x.hi is not None else (x, iy)
                df = df.where(~F.array_contains(c(many), c(_id(one.var))))
        return df

    def optional(self, df: DataFrame | None, scope: Scope, match: Match) -> tuple[DataFrame, Scope]:
        """Matches from the distinct bindings it starts from, joined back by an outer join."""
        shared = [v for p in match.paths for v in dict.fromkeys(n.var for n in p.nodes) if v in scope]
        if match.where is not None:
            shared += [e.name for e in walk(match.where) if isinstance(e, Var) and e.name in scope]
        shared = list(dict.fromkeys(shared))
        base = self.one_row() if df is None else df
        held = [k for v in shared for k in _columns(v, scope[v])]
        inner, found = self.match(base.select(*(c(k) for k in held)).distinct() if held else None, {v: scope[v] for v in shared}, match)
        fresh = [k for v, b in found.items() if v not in shared for k in (_columns(v, b) if b.kind != "rels" else [])]
        inner = inner.select(*(c(k).alias(f"__{k}") for k in held), *(c(k) for k in fresh))
        on = reduce(lambda x, y: x & y, (c(k).eqNullSafe(c(f"__{k}")) for k in held), F.lit(True))
        out = base.join(inner, on, "left").drop(*(f"__{k}" for k in held))
        return out, scope | {v: b for v, b in found.items() if v not in scope}

    # projections
    def project(self, df: DataFrame, scope: Scope, p: Project, keep: tuple[str, ...] = ()) -> tuple[DataFrame, Scope]:
        items = ([Item(Var(v), v) for v, b in scope.items() if not v.startswith("_") and b.kind != "rels"] if p.star else []) + list(p.items)
        items = [Item(Var(v), v) for v in keep if all(i.alias != v for i in items)] + items
        if len({i.alias for i in items}) < len(items):
            raise CypherError("a column name occurs twice")
        after: Scope = {}
        columns: list[Column] = []
        sums: list[Column] = []
        for item in items:
            e = item.expr
            if isinstance(e, Var) and e.name in scope and scope[e.name].kind in ("node", "rel"):
                b = scope[e.name]
                after[item.alias] = b
                columns += [c(x).alias(y) for x, y in zip(_columns(e.name, b), _columns(item.alias, b), strict=True)]
            else:
                after[item.alias] = Bound("value")
                (sums if _aggregates(e) else columns).append(self.expr(e, scope).alias(_value(item.alias)))
        names = [n for v, b in after.items() for n in _columns(v, b)]
        if sums:
            df = df.groupBy(*columns).agg(*sums) if columns else df.agg(*sums)
            df = self._sorted(df, p, after, dict(after), items, keep)
        elif p.distinct:
            df = self._sorted(df.select(*columns).distinct(), p, after, dict(after), items, keep)
        elif p.order:
            # sort keys may be variables that are not returned
            both = df.select("*", *(x for x in columns if self._name(x) not in df.columns))
            df = self._sorted(both, p, after, scope | after, items, keep)
        else:
            df = self._sorted(df.select(*columns), p, after, dict(after), items, keep)
        df = df.select(*(c(n) for n in names))
        if p.where is not None:
            df = self.filtered(df, after, p.where)
        if p.final:
            df = df.select(*(self._returned(v, b).alias(v) for v, b in after.items()))
        return df, after

    @staticmethod
    def _name(column: Column) -> str:
        return column._jc.toString().rsplit(" AS ", 1)[-1].strip("`")

    def _sorted(self, df: DataFrame, p: Project, after: Scope, scope: Scope, items: list[Item], keep: tuple[str, ...]) -> DataFrame:
        keys = []
        known = {i.expr: i.alias for i in items}
        for e, down in p.order:
            k = self.expr(Var(known[e]), after) if e in known else self.expr(e, scope)
            keys.append(k.desc_nulls_first() if down else k.asc_nulls_last())
        if keep:
            # inside a subquery the first rows are those of each binding; an order alone says nothing outside it
            if p.skip or p.limit is not None:
                part = Window.partitionBy(*(c(k) for v in keep for k in _columns(v, after[v]))).orderBy(*(keys or [F.lit(0)]))
                low = p.skip or 0
                place = F.row_number().over(part)
                df = df.withColumn("__place", place).where((c("__place") > low) & (F.lit(True) if p.limit is None else c("__place") <= low + p.limit)).drop("__place")
            return df
        if keys:
            df = df.orderBy(*keys)
        if p.skip:
            df = df.offset(p.skip)
        return df if p.limit is None else df.limit(p.limit)

    def _returned(self, v: str, b: Bound) -> Column:
        if b.kind in ("node", "rel"):
            whole = F.struct(*(c(_prop(v, x)).alias(x) for x in b.props)) if b.props else F.struct(c(_id(v)).alias("id"))
            return F.when(c(_label(v)).isNotNull(), whole)
        return c(_value(v))

    # expressions
    def expr(self, e, scope: Scope) -> Column:
        if isinstance(e, Literal):
            return F.lit(e.value)
        if isinstance(e, ListOf):
            return F.array(*(self.expr(x, scope) for x in e.items))
        if isinstance(e, Param):
            if e.name not in self.params:
                raise CypherError(f"no parameter ${e.name}")
            return F.lit(self.params[e.name])
        if isinstance(e, Var):
            b = self._lookup(e.name, scope)
            return c(_id(e.name)) if b.kind in ("node", "rel") else c(_value(e.name))
        if isinstance(e, Prop):
            if isinstance(e.owner, Var):
                b = self._lookup(e.owner.name, scope)
                if b.kind in ("node", "rel"):
                    return c(_prop(e.owner.name, e.name)) if e.name in b.props else F.lit(None)
            return self.expr(e.owner, scope).getField(e.name)
        if isinstance(e, Index):
            return F.get(self.expr(e.owner, scope), self.expr(e.at, scope))
        if isinstance(e, Call):
            return self.call(e, scope)
        return self.operation(e, scope)

    @staticmethod
    def _lookup(name: str, scope: Scope) -> Bound:
        if name not in scope:
            raise CypherError(f"unknown variable {name}")
        return scope[name]

    def operation(self, e: Op, scope: Scope) -> Column:
        args = [self.expr(a, scope) for a in e.args]
        if e.name == "case":
            whens = list(zip(args[:-1:2], args[1::2], strict=True))
            return reduce(lambda out, x: out.when(*x), whens[1:], F.when(*whens[0])).otherwise(args[-1])
        a, b = args[0], args[-1]
        if e.name in ("=", "<>"):
            same = a == b
            ends = [scope.get(x.name) for x in e.args if isinstance(x, Var)]
            if len(ends) == 2 and all(x is not None and x.kind == "node" for x in ends):
                x, y = e.args
                same = (a.cast("string") == b.cast("string")) & (c(_label(x.name)) == c(_label(y.name)))
            return same if e.name == "=" else ~same
        simple = {
            "<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b, "and": lambda: a & b, "or": lambda: a | b, "not": lambda: ~a,
            "xor": lambda: a != b, "isnull": a.isNull, "notnull": a.isNotNull, "contains": lambda: a.contains(b), "starts": lambda: a.startswith(b), "ends": lambda: a.endswith(b),
            "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b), "%": lambda: a % b, "neg": lambda: -a, "=~": lambda: F.regexp_like(a, F.concat(F.lit("^(?:"), b, F.lit(")$"))),
        }
        if e.name in simple:
            return simple[e.name]()
        if e.name == "in":
            if isinstance(e.args[1], ListOf):
                return reduce(lambda x, y: x | y, (a == self.expr(x, scope) for x in e.args[1].items), F.lit(False))
            return F.array_contains(b, a)
        if e.name == "+":
            lists = [isinstance(x, ListOf) or isinstance(x, Call) and x.name in LISTS for x in e.args]
            if any(lists):  # an element is appended to a list, or put before it
                return F.concat(*(x if known or isinstance(y, Var | Prop) else F.array(x) for x, y, known in zip(args, e.args, lists, strict=True)))
            text = any(isinstance(x, Literal) and isinstance(x.value, str) for x in e.args)
            return F.concat(a.cast("string"), b.cast("string")) if text else a + b
        raise CypherError(f"unknown operation {e.name}")

    def call(self, e: Call, scope: Scope) -> Column:
        name = e.name
        of = scope.get(e.args[0].name) if e.args and isinstance(e.args[0], Var) else None
        entity = of is not None and of.kind in ("node", "rel")
        if name in AGGREGATES:
            if name == "count" and e.star:
                return F.count(F.lit(1))
            var = e.args[0].name if entity else None
            if name == "count":
                if entity:
                    return F.count_distinct(c(_label(var)), c(_id(var))) if e.distinct else F.count(c(_label(var)))
                x = self.expr(e.args[0], scope)
                return F.count_distinct(x) if e.distinct else F.count(x)
            x = self._returned(var, of) if entity else self.expr(e.args[0], scope)
            if name == "collect":
                return F.collect_set(x) if e.distinct else F.collect_list(x)
            if name == "sum":
                return F.coalesce(F.sum_distinct(x) if e.distinct else F.sum(x), F.lit(0))
            return {"avg": F.avg, "min": F.min, "max": F.max}[name](x)
        if name in ("labels", "type", "id", "properties") and entity:
            var = e.args[0].name
            if name == "labels":
                return F.array(c(_label(var)))
            return c(_label(var)) if name == "type" else c(_id(var)) if name == "id" else self._returned(var, of)
        args = [self.expr(a, scope) for a in e.args]
        known = {
            "date": lambda x: F.to_date(x), "datetime": lambda x: F.to_timestamp_ntz(x), "localdatetime": lambda x: F.to_timestamp_ntz(x), "time": lambda x: x.cast("string"),
            "tolower": F.lower, "toupper": F.upper, "trim": F.trim, "size": lambda x: F.size(x).cast("long"),
            "length": lambda x: x, "abs": F.abs, "round": lambda x: F.round(x), "floor": F.floor, "ceil": F.ceil, "sqrt": F.sqrt, "coalesce": F.coalesce, "tostring": lambda x: x.cast("string"),
            "tointeger": lambda x: x.try_cast("long"), "tofloat": lambda x: x.try_cast("double"), "substring": lambda x, i, n=None: F.substr(x, i + 1, n), "split": lambda x, s: F.split(x, F.concat(F.lit("\\Q"), s, F.lit("\\E"))), "exists": lambda x: x.isNotNull(),
            "range": lambda x, y: F.sequence(x, y), "head": lambda x: F.get(x, F.lit(0)), "char_length": F.length,
        }
        if name not in known:
            raise CypherError(f"unknown function {name}")
        try:
            return known[name](*args)
        except TypeError as error:
            raise CypherError(f"{name} does not take {len(args)} arguments") from error
