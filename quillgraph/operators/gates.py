"""Quality gates of a benchmark: each is a frame of violations, empty if the gate passes."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import extract_schema_pattern, relationship_count, relationship_types
from ..plans.catalog import GraphSchema
from ..plans.session import validate


def distribution(items: DataFrame, kind: str, expected: dict[str | None, int]) -> DataFrame:
    """(kind, expected, found) where counts differ; null is a kind."""
    spark = items.sparkSession
    want = spark.createDataFrame(list(expected.items()), f"{kind} string, expected long")
    found = items.groupBy(F.col(kind).alias("_k")).agg(F.count("*").alias("found"))
    both = want.join(found, want[kind].eqNullSafe(found["_k"]), "full")
    zero = F.lit(0).cast("long")
    return both.select(F.coalesce(kind, "_k").alias(kind), F.coalesce("expected", zero).alias("expected"), F.coalesce("found", zero).alias("found")).where("expected <> found")


def duplicates(items: DataFrame, key: Column, name: str = "key") -> DataFrame:
    return items.groupBy(key.alias(name)).agg(F.count("*").alias("n")).where("n > 1")


def hop_honesty(items: DataFrame, cypher: str, declared: str, most: int = 3) -> DataFrame:
    """Items whose declared hops are not those of the pattern, or too many."""
    # a filter is not pushed below what an array yields, so texts are parsed once, and where the rows have been dealt to
    hops = F.coalesce(relationship_count(extract_schema_pattern(cypher)), F.lit(0).cast("long"))
    counted = items.select("*", F.explode(F.array(hops)).alias("hops"))
    return counted.where((F.col("hops") != F.col(declared)) | (F.col("hops") > most))


def type_coverage(items: DataFrame, item: str, cypher: str, types: list[str], least: int = 3) -> DataFrame:
    """(type, items) of relationship types that occur in fewer than `least` items, absent ones with 0."""
    used = items.select(item, F.explode(relationship_types(cypher)).alias("type")).groupBy("type").agg(F.count_distinct(item).alias("items"))
    return cover(items.sparkSession.createDataFrame([(t,) for t in types], "type string"), used, "type", "items", least)


def cover(wanted: DataFrame, counts: DataFrame, key: str, n: str, least: int) -> DataFrame:
    both = wanted.join(counts, key, "left").select(key, F.coalesce(n, F.lit(0).cast("long")).alias(n))
    return both.where(F.col(n) < least)


def once(queries: DataFrame, text: str) -> DataFrame:
    """Distinct query texts, each to be executed once and joined back."""
    return queries.select(text).distinct()


VERDICT = "syntax boolean, schema_score double, property_score double, route string, problems array<string>"


def validated(queries: DataFrame, schema: GraphSchema, text: str = "cypher") -> DataFrame:
    """queries with `verdict` (VERDICT) of the validator; each distinct text of a batch is checked once."""

    @F.pandas_udf(VERDICT)
    def judge(texts: pd.Series) -> pd.DataFrame:
        known = {t: validate(t or "", schema) for t in texts.unique()}
        rows = [known[t] for t in texts]
        return pd.DataFrame([(v.syntax_valid, v.schema_score, v.properties_score, v.route_to, list(v.problems)) for v in rows], columns=["syntax", "schema_score", "property_score", "route", "problems"])

    return queries.withColumn("verdict", judge(text))


def invalid(queries: DataFrame, schema: GraphSchema, text: str = "cypher") -> tuple[DataFrame, DataFrame]:
    """The violations of two gates: queries that do not parse, and those that name what the schema lacks."""
    checked = validated(queries, schema, text)
    return checked.where(~F.col("verdict.syntax")), checked.where(F.col("verdict.syntax") & (F.col("verdict.route") != "accept"))


def empty_results(queries: DataFrame, counts: DataFrame, text: str, n: str = "n_rows") -> DataFrame:
    """Queries that return no row; those that failed (null count) are left to the gate of syntax."""
    return queries.join(counts, text, "left").where(F.col(n) == 0)


def report(gates: dict[str, DataFrame]) -> DataFrame:
    """(gate, violations, passed) of every gate, and the row `all`."""
    parts = [df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("gate"), "violations") for name, df in gates.items()]
    rows = reduce(DataFrame.union, parts).withColumn("passed", F.col("violations") == 0)
    whole = rows.agg(F.sum("violations").alias("violations"), F.bool_and("passed").alias("passed")).select(F.lit("all").alias("gate"), "violations", "passed")
    return rows.union(whole)
