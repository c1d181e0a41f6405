"""Typed property graphs over tables: one DataFrame per node label and per relationship type."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class NodeTable:
    """Nodes of a label; `id` is the column that identifies them, every other column is a property."""

    label: str
    id: str
    frame: DataFrame

    @property
    def props(self) -> list[str]:
        return self.frame.columns


@dataclass(frozen=True)
class EdgeTable:
    """Relationships of a type between two labels, with an id of their own (a column name, or several).

    The table is a DataFrame, or a function that makes one when the type is first read.
    """

    type: str
    source: str
    target: str
    src: str
    dst: str
    id: tuple[str, ...]
    table: DataFrame | Callable[[], DataFrame]
    props: tuple[str, ...] = ()

    @cached_property
    def frame(self) -> DataFrame:
        return self.table() if callable(self.table) else self.table


@dataclass(frozen=True)
class PathDecl:
    type: str
    source: str
    target: str


@dataclass
class GraphSchema:
    """Labels, (type, source, target) paths and properties of labels and types."""

    labels: list[str]
    paths: list[PathDecl]
    props: dict[str, list[str]] = field(default_factory=dict)

    @property
    def types(self) -> list[str]:
        return list(dict.fromkeys(p.type for p in self.paths))

    def to_prompt(self, include_properties: bool = True, max_paths: int | None = None) -> str:
        """The schema as text, one path a line, then the properties by owner."""
        lines = [f"(:{p.source})-[:{p.type}]->(:{p.target})" for p in self.paths[:max_paths]]
        if include_properties:
            lines += [f"{owner}: {', '.join(names)}" for owner, names in self.props.items() if names]
        return "\n".join(lines)

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
        """labels(label), paths(idx, type, source, target) and props(owner, prop)."""
        return (
            spark.createDataFrame([(v,) for v in self.labels], "label string"),
            spark.createDataFrame([(i, p.type, p.source, p.target) for i, p in enumerate(self.paths)], "idx int, type string, source string, target string"),
            spark.createDataFrame([(o, p) for o, ps in self.props.items() for p in ps], "owner string, prop string"),
        )


class Graph:
    """A catalog of node and relationship tables. A type may join several pairs of labels, by several tables."""

    def __init__(self, nodes: list[NodeTable], edges: list[EdgeTable]):
        self.nodes = {n.label: n for n in nodes}
        self.edges = edges
        for e in edges:
            for label in (e.source, e.target):
                if label not in self.nodes:
                    raise ValueError(f"{e.type} joins the unknown label {label}")

    @property
    def schema(self) -> GraphSchema:
        props = {n.label: list(n.props) for n in self.nodes.values()}
        for e in self.edges:
            props.setdefault(e.type, []).extend(p for p in e.props if p not in props.get(e.type, []))
        return GraphSchema(list(self.nodes), [PathDecl(e.type, e.source, e.target) for e in self.edges], props)

    def counts(self) -> DataFrame:
        """(kind, name, n) of every label and relationship type."""
        parts = [n.frame.agg(F.count("*").alias("n")).select(F.lit("label").alias("kind"), F.lit(n.label).alias("name"), "n") for n in self.nodes.values()]
        parts += [e.frame.agg(F.count("*").alias("n")).select(F.lit("type"), F.lit(e.type), "n") for e in self.edges]
        return reduce(DataFrame.union, parts).groupBy("kind", "name").agg(F.sum("n").alias("n"))

    def duplicate_ids(self) -> DataFrame:
        """(label, id, n): violations of the uniqueness of node ids."""
        parts = [
            n.frame.groupBy(F.col(n.id).cast("string").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(n.label).alias("label"), "id", "n")
            for n in self.nodes.values()
        ]
        return reduce(DataFrame.union, parts)

    def dangling(self) -> DataFrame:
        """(type, end, n): relationships whose source or target is no node."""
        parts = []
        for e in self.edges:
            for end, label, key in (("source", e.source, e.src), ("target", e.target, e.dst)):
                node = self.nodes[label]
                ids = node.frame.select(F.col(node.id).alias("_id"))
                lost = e.frame.join(ids, F.col(key) == F.col("_id"), "left_anti")
                parts.append(lost.agg(F.count("*").alias("n")).select(F.lit(e.type).alias("type"), F.lit(end).alias("end"), "n"))
        return reduce(DataFrame.union, parts)
