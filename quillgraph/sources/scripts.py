"""Seed scripts of any size as graphs: read in parallel, statement by statement.

Spark's text reader cuts the files at the ends of statements, wherever they are stored, and every task parses its own.
The parsed rows are written once; labels, properties and their types are found from them by an aggregation, and each
label and relationship type becomes a typed table. Only these names ever reach the driver.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalog import EdgeTable, Graph, NodeTable
from ..plans.written import materialise
from .seeds import read_seed

END = ";\n"
STATEMENT = "kind string, label string, source string, source_key string, source_value string, target string, target_key string, target_value string, names array<string>, kinds array<string>, texts array<string>"
#: A literal's kind and the column type that holds it.
TYPES = {"string": "string", "boolean": "boolean", "long": "bigint", "double": "double", "date": "date", "datetime": "timestamp_ntz", "time": "string"}
_NAMES = [c.split()[0] for c in STATEMENT.split(", ")]


def _text(v: object) -> str | None:
    return None if v is None else str(v).lower() if isinstance(v, bool) else str(v)


def statements(script: str) -> list[tuple]:
    """Rows (STATEMENT) of the statements in a piece of a script; kind is node, edge, unique, index or refused."""
    none = (None,) * 6

    def props(found: dict) -> tuple:
        return list(found), [k for k, _ in found.values()], [_text(v) for _, v in found.values()]

    try:
        seed = read_seed(script)
    except (ValueError, KeyError, StopIteration) as e:
        return [("refused", f"{type(e).__name__}: {e}: {script.strip()[:80]}", *none, [], [], [])]
    out = [("node", label, *none, *props(p)) for label, rows in seed.nodes.items() for p in rows]
    out += [("edge", kind, a[0], a[1], _text(a[2]), b[0], b[1], _text(b[2]), *props(p)) for kind, a, b, p in seed.edges]
    out += [("unique", label, None, key, *none[2:], [], [], []) for label, key in seed.keys.items()]
    return out + [("index", x, *none, [], [], []) for x in seed.indexes]


def parsed(spark: SparkSession, path: str) -> DataFrame:
    """A written table of the statements of all scripts under a path, with a number of their own (`id`)."""

    def run(batches):
        for batch in batches:
            rows = [row for piece in batch.column("value").to_pylist() for row in statements(piece)]
            kinds = [pa.string()] * 8 + [pa.list_(pa.string())] * 3
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=_NAMES)

    pieces = spark.read.option("lineSep", END).text(path)
    return materialise(pieces.mapInArrow(run, STATEMENT).withColumn("id", F.monotonically_increasing_id()))


def _typed(rows: DataFrame, columns: dict[str, str], *more: Column) -> DataFrame:
    value = lambda n: F.get("texts", F.array_position("names", F.lit(n)).cast("int") - 1)
    return rows.select(*more, *(value(n).cast(kind).alias(n) for n, kind in columns.items()))


def load_scripts(spark: SparkSession, path: str) -> Graph:
    """The graph of all scripts under a path, in whatever order their statements stand.

    A property's type is that of its literals: numbers of both kinds are doubles, other kinds that do not agree are text,
    and a property that is always null is text. A label's key is its unique property, or else the first by name. A MATCH
    that finds nothing creates nothing. Statements of other kinds, and strings that hold a statement's end, raise.
    """
    rows = parsed(spark, path)
    refused = rows.where("kind = 'refused'").select("label").limit(3).collect()
    if refused:
        raise ValueError("; ".join(r["label"] for r in refused))
    # as many rows as there are names: labels and types by property and kind
    seen: dict[tuple[str, str], dict[str, set]] = {}
    ends: dict[str, set] = {}
    for r in rows.where("kind in ('node', 'edge')").select("kind", "label", "source", "target", F.explode_outer(F.arrays_zip("names", "kinds")).alias("p")).select("kind", "label", "source", "target", "p.names", "p.kinds").distinct().collect():
        own = seen.setdefault((r["kind"], r["label"]), {})
        if r["kind"] == "edge":
            ends.setdefault(r["label"], set()).add((r["source"], r["target"]))
        if r["names"] is not None:
            own.setdefault(r["names"], set()).update({r["kinds"]} - {"null"})
    unique = {r["label"]: r["source_key"] for r in rows.where("kind = 'unique'").select("label", "source_key").distinct().collect()}

    def kinds(own: dict[str, set]) -> dict[str, str]:
        return {n: "double" if k == {"long", "double"} else TYPES[next(iter(k))] if len(k) == 1 else "string" for n, k in sorted(own.items())}

    nodes, places = {}, {}
    for (kind, label), own in sorted(seen.items()):
        if kind == "node":
            columns = kinds(own)
            key = unique.get(label) or next(iter(columns))
            made = rows.where((F.col("kind") == "node") & (F.col("label") == label))
            nodes[label] = NodeTable(label, key, _typed(made, columns))
            places[label] = made
    edges = []
    for label, pairs in sorted(ends.items()):
        for source, target in sorted(pairs):
            if source not in nodes or target not in nodes:
                continue
            made = rows.where((F.col("kind") == "edge") & (F.col("label") == label) & (F.col("source") == source) & (F.col("target") == target))
            columns = kinds(seen[("edge", label)])
            for end, of in (("source", source), ("target", target)):
                at = places[of].select(F.posexplode("names").alias("at", f"{end}_key"), "texts", "names").select(
                    f"{end}_key", F.get("texts", F.col("at")).alias(f"{end}_value"), F.get("texts", F.array_position("names", F.lit(nodes[of].id)).cast("int") - 1).alias(f"_{end}")
                )
                made = made.join(at, [f"{end}_key", f"{end}_value"])
            ids = [F.col(f"_{end}").cast(nodes[of].frame.schema[nodes[of].id].dataType).alias(name) for end, of, name in (("source", source, "src"), ("target", target, "dst"))]
            edges.append(EdgeTable(label, source, target, "src", "dst", ("edge_id",), _typed(made, columns, F.col("id").alias("edge_id"), *ids), tuple(columns)))
    return Graph(list(nodes.values()), edges)
