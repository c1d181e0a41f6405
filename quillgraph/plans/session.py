"""Running Cypher over a graph: plans, results as rows, and what the validator and the executor report."""

from __future__ import annotations

import re
import threading
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .catalog import Graph, GraphSchema
from .compiler import Compiler
from .lexer import CypherError
from .syntax import Exists, Match, Node, Procedure, Prop, Rel, Subquery, Var, parse, walk


@dataclass
class Execution:
    success: bool
    rows: list[dict] = field(default_factory=list)
    error: str | None = None
    elapsed_ms: float = 0.0


@dataclass
class Verdict:
    """Syntax, schema and property checks; a score is matched over referenced names, null if none is referenced."""

    syntax_valid: bool
    schema_score: float | None
    properties_score: float | None
    route_to: str
    problems: list[str] = field(default_factory=list)

    @property
    def is_valid(self) -> bool:
        return self.route_to == "accept"


class GraphSession:
    """Queries over one graph. Usable as a context manager; temporary state is none."""

    def __init__(self, spark: SparkSession, graph: Graph):
        self.spark, self.graph = spark, graph

    def __enter__(self) -> GraphSession:
        return self

    def __exit__(self, *exc) -> None:
        return None

    def cypher(self, text: str, params: dict | None = None) -> DataFrame:
        """The plan of a query; CypherError if it is no query of the subset or names what the graph lacks."""
        return Compiler(self.spark, self.graph, params).query(text)

    def execute(self, text: str, params: dict | None = None, timeout_s: float = 10.0, limit: int = 1_000_000) -> Execution:
        """Run a query and collect its rows; errors, timeouts and more than `limit` rows are reported, not raised."""
        tag, start, jobs = f"cypher-{uuid.uuid4().hex}", time.perf_counter(), self.spark.sparkContext
        late, done = threading.Event(), threading.Event()

        def stop() -> None:
            if done.wait(timeout_s):
                return
            late.set()
            while not done.wait(0.2):  # the query may still be planned, and have no job to stop yet
                jobs.cancelJobsWithTag(tag)

        jobs.addJobTag(tag)  # also holds for the jobs of tables that a plan writes on its way
        threading.Thread(target=stop, daemon=True).start()
        rows, error = [], None
        try:
            rows = [r.asDict(recursive=True) for r in self.cypher(text, params).limit(limit + 1).collect()]
            if len(rows) > limit:
                rows, error = [], f"more than {limit} rows"
        except Exception as e:
            error = str(e)
        finally:
            done.set()
            jobs.removeJobTag(tag)
        elapsed = (time.perf_counter() - start) * 1000
        if late.is_set():
            return Execution(False, [], f"timed out after {timeout_s} s", elapsed)
        return Execution(error is None, rows, error, elapsed)

    def validate(self, text: str) -> Verdict:
        return validate(text, self.graph.schema)


def validate(text: str, schema: GraphSchema) -> Verdict:
    """Syntax first, then labels and types, then properties; the first failure decides where to go back to."""
    try:
        tree = parse(text)
    except CypherError as e:
        return Verdict(False, 0.0, None, "query_generator", [str(e)])
    names, problems = [], []
    owners: dict[str, list[str]] = {}
    props: list[tuple[str, str, bool]] = []
    for query in tree.parts:
        owners.clear()
        for part in _parts(query):
            if isinstance(part, Node | Rel):
                legal, given = (schema.labels, part.labels) if isinstance(part, Node) else (schema.types, part.types)
                owners.setdefault(part.var, []).extend(given)
                for g in given:
                    names.append(g in legal)
                    if g not in legal:
                        problems.append(f"unknown {'label' if isinstance(part, Node) else 'relationship type'} {g}")
        for part in _parts(query):
            found = [(part.var, k) for k, _ in part.props] if isinstance(part, Node | Rel) else []
            if isinstance(part, Prop) and isinstance(part.owner, Var):
                found = [(part.owner.name, part.name)]
            for var, key in found:
                if owners.get(var):
                    props.append((var, key, any(key in schema.props.get(o, []) for o in owners[var])))
    schema_score = sum(names) / len(names) if names else 1.0
    if schema_score < 1.0:
        return Verdict(True, schema_score, None, "schema_linker", problems)
    problems += [f"{var} has no property {key}" for var, key, ok in props if not ok]
    score = sum(ok for *_, ok in props) / len(props) if props else None
    return Verdict(True, schema_score, score, "accept" if score in (None, 1.0) else "schema_linker", problems)


def _parts(query):
    """Every node, relationship and expression of a query, and of the queries and patterns inside it."""
    for clause in query.clauses:
        if isinstance(clause, Match):
            yield from _match_parts(clause)
        elif isinstance(clause, Subquery):
            for part in clause.query.parts:
                yield from _parts(part)
        elif hasattr(clause, "items"):
            for e in [i.expr for i in clause.items] + [e for e, _ in clause.order] + [clause.where]:
                yield from _expressions(e)
        else:
            yield from _expressions(clause.where if isinstance(clause, Procedure) else clause.source)


def _match_parts(match: Match):
    for path in match.paths:
        for part in (*path.nodes, *path.rels):
            yield part
            for _, e in part.props:
                yield from _expressions(e)
    yield from _expressions(match.where)


def _expressions(e):
    for x in walk(e) if e is not None else ():
        yield x
        if isinstance(x, Exists):
            yield from _match_parts(x.match)


_RELATION = re.compile(r"\[[^\]{]*:")


def mentions_relationship(text: str) -> bool:
    """Whether a pattern has a typed relationship."""
    return bool(_RELATION.search(text))
