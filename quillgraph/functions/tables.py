"""Table functions over pattern text, for LATERAL joins in SQL and in the DataFrame API."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .patterns import parse_pattern

ROW = "kind string, pos int, alias string, name string, src string, tgt string, direction string, active boolean"


class PatternRows:
    """A row for each node (alias, label as name) and each relationship (type as name, ends, direction, active filter) of
    a pattern, each kind counted from 1 in the order of the text; none for text without a pattern."""

    def eval(self, text: str | None) -> Iterator[tuple]:
        found = parse_pattern(text)
        for n, x in enumerate(found["nodes"], 1):
            yield "node", n, x["alias"], x["label"], None, None, None, None
        for n, x in enumerate(found["rels"], 1):
            yield "relationship", n, None, x["type"], x["src"], x["tgt"], x["direction"], x["active"]


#: For DataFrames: df.lateralJoin(pattern_rows(F.col("text").outer())).
pattern_rows = F.udtf(PatternRows, returnType=ROW, useArrow=True)


def register(spark: SparkSession, name: str = "pattern_rows") -> None:
    """Make the function known to SQL: SELECT ... FROM t, LATERAL pattern_rows(t.text)."""
    spark.udtf.register(name, pattern_rows)


def parts_of(text: Column) -> Column:
    """The same rows as an array, from parse_schema_pattern(), for plans that need no join."""
    from .patterns import parse_schema_pattern

    parsed = parse_schema_pattern(text)
    none = lambda kind: F.lit(None).cast(kind)
    nodes = F.transform(parsed["nodes"], lambda x, i: F.struct(F.lit("node").alias("kind"), (i + 1).alias("pos"), x["alias"].alias("alias"), x["label"].alias("name"), none("string").alias("src"), none("string").alias("tgt"), none("string").alias("direction"), none("boolean").alias("active")))
    rels = F.transform(parsed["rels"], lambda x, i: F.struct(F.lit("relationship").alias("kind"), (i + 1).alias("pos"), none("string").alias("alias"), x["type"].alias("name"), x["src"].alias("src"), x["tgt"].alias("tgt"), x["direction"].alias("direction"), x["active"].alias("active")))
    return F.concat(nodes, rels)
