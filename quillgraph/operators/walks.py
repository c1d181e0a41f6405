"""Walks over a graph schema, their text, and templates over them: training rows without a model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalog import GraphSchema


def moves(spark: SparkSession, schema: GraphSchema, undirected: frozenset[str], temporal: frozenset[str]) -> DataFrame:
    """(label, idx, type, arrow, other, temporal): the ways to leave a label along a declared path."""
    rows = []
    for i, p in enumerate(schema.paths):
        flag = p.type in temporal
        if p.type in undirected:
            rows.append((p.source, i, p.type, "-", p.target, flag))
            if p.source != p.target:
                rows.append((p.target, i, p.type, "-", p.source, flag))
        else:
            rows += [(p.source, i, p.type, "->", p.target, flag), (p.target, i, p.type, "<-", p.source, flag)]
    return spark.createDataFrame(rows, "label string, idx int, type string, arrow string, other string, temporal boolean")


def walks(step: DataFrame, most: int = 3) -> DataFrame:
    """(start, hops, active_pos): walks of 1 to `most` hops that use no declared path twice, and a variant with the
    active filter for each of their temporal hops (active_pos from 0, null without)."""
    hop = F.struct("idx", "type", "arrow", "other", "temporal")
    now = step.select(F.col("label").alias("start"), F.array(hop).alias("hops"), F.array("idx").alias("used"))
    levels = [now]
    for _ in range(most - 1):
        at = F.element_at("hops", -1)["other"]
        now = (
            now.withColumn("label", at).join(step, "label").where(~F.array_contains("used", F.col("idx")))
            .select("start", F.concat("hops", F.array(hop)).alias("hops"), F.concat("used", F.array("idx")).alias("used"))
        )
        levels.append(now)
    key = F.array_join(F.transform("hops", lambda h: F.concat(h["idx"].cast("string"), h["arrow"])), ",")
    every = reduce(DataFrame.union, levels).drop("used").withColumn("key", key).dropDuplicates(["start", "key"])
    variants = F.filter(F.transform("hops", lambda h, i: F.when(h["temporal"], i)), lambda i: i.isNotNull())
    return every.withColumn("active_pos", F.explode(F.concat(F.array(F.lit(None).cast("int")), variants))).select("start", "hops", "key", "active_pos")


def render(start: Column, hops: Column, active: Column, short: dict[str, str]) -> Column:
    """A walk as a pattern; variables are numbered from their second use of a label's short name."""
    names = F.create_map(*(F.lit(x) for kv in short.items() for x in kv))
    labels = F.concat(F.array(start), F.transform(hops, lambda h: h["other"]))

    def var(i: Column, label: Column) -> Column:
        base = names[label]
        before = F.size(F.filter(F.slice(labels, 1, i), lambda x: names[x] == base))
        return F.concat(base, F.when(before > 0, (before + 1).cast("string")).otherwise(""))

    node = lambda i, label: F.concat(F.lit("("), var(i, label), F.lit(":"), label, F.lit(")"))
    head = F.concat(F.lit("("), names[start], F.lit(":"), start, F.lit(")"))

    def part(h: Column, i: Column) -> Column:
        box = F.concat(F.lit("[:"), h["type"], F.when(active == i, " {active:true}").otherwise(""), F.lit("]"))
        left, right = F.when(h["arrow"] == "<-", "<-").otherwise("-"), F.when(h["arrow"] == "->", "->").otherwise("-")
        return F.concat(left, box, right, node(i + 1, h["other"]))

    return F.concat(head, F.array_join(F.transform(hops, part), ""))


def multi_pairs(paths: DataFrame, least: int = 2) -> DataFrame:
    """(source, target, n): label pairs that several types join."""
    return paths.groupBy("source", "target").agg(F.count_distinct("type").alias("n")).where(F.col("n") >= least)


def ambiguous_rows(pairs: DataFrame, paths: DataFrame, forms: list[str], samples: int) -> DataFrame:
    """forms x samples rows for each pair, the type taken round robin from the pair's types in declared order."""
    spark = pairs.sparkSession
    types = paths.join(pairs, ["source", "target"], "left_semi").groupBy("source", "target").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "type"))), lambda x: x["type"]).alias("types"))
    grid = spark.createDataFrame([(i, f, k) for i, f in enumerate(forms) for k in range(samples)], "form_no int, form string, k int")
    both = types.join(F.broadcast(grid))  # forms x samples rows, set by the call
    return both.withColumn("type", F.element_at("types", F.pmod(F.col("k"), F.size("types")) + 1)).select("source", "target", "form_no", "form", "k", "type")


def phrases(rows: DataFrame, hops: str, wraps: dict[str, str], leaf: Column) -> Column:
    """A nested noun phrase: the leaf wrapped by each hop's template ('... {np} ...'), keyed by type and arrow."""
    table = F.create_map(*(F.lit(x) for kv in wraps.items() for x in kv))
    return F.aggregate(hops, leaf, lambda np, h: F.replace(F.try_element_at(table, F.concat(h["type"], h["arrow"])), F.lit("{np}"), np))


def pick(pool: list[str], key: Column) -> Column:
    """A member of a pool, decided by the md5 of the key: the same on every engine."""
    number = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long")
    return F.element_at(F.array(*map(F.lit, pool)), (number % len(pool) + 1).cast("int"))


def attribute_questions(rows: DataFrame, attributes: dict[str, list[str]], phrase: str = "phrase", label: str = "label") -> DataFrame:
    """rows once for each attribute of their label, with `attribute` and `question`; a label without any has no row."""
    table = F.create_map(*(x for k, v in attributes.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))))
    asked = rows.withColumn("attribute", F.explode(F.try_element_at(table, F.col(label))))
    return asked.withColumn("question", F.concat(F.lit("What is the "), F.col("attribute"), F.lit(" of "), F.col(phrase), F.lit("?")))
