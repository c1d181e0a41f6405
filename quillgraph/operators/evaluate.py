"""Result-set equality and the evaluation of attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.strings import is_id
from ..plans.written import materialise
from .candidates import cosine


def normalised(value: Column, kind: T.DataType) -> Column:
    """A value as text that equals another's iff they are equal up to six decimals and the order of map entries."""
    if isinstance(kind, T.FloatType | T.DoubleType | T.DecimalType):
        x = F.round(value.cast("double"), 6)
        return F.coalesce(F.when(x == F.round(x, 0), F.format_string("%.0f", x + F.lit(0.0))).otherwise(x.cast("string")), F.lit("\\N"))
    if isinstance(kind, T.ArrayType):
        inner = F.transform(value, lambda v: normalised(v, kind.elementType))
        return F.coalesce(F.concat(F.lit("["), F.array_join(inner, ","), F.lit("]")), F.lit("\\N"))
    if isinstance(kind, T.StructType):
        parts = F.array(*(F.concat(F.lit(f"{f.name}="), normalised(value[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)))
        return F.when(value.isNull(), F.lit("\\N")).otherwise(F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")))
    if isinstance(kind, T.MapType):
        pairs = F.transform(F.map_entries(value), lambda e: F.concat(e["key"].cast("string"), F.lit("="), normalised(e["value"], kind.valueType)))
        return F.coalesce(F.concat(F.lit("{"), F.array_join(F.array_sort(pairs), ","), F.lit("}")), F.lit("\\N"))
    return F.coalesce(value.cast("string"), F.lit("\\N"))


def _text(types: dict[str, T.DataType], columns: list[str]) -> Column:
    """The normalised values of a row by position; names do not matter, places do."""
    parts = [F.regexp_replace(normalised(F.col(f"`{c}`"), types[c]), "([\\u0001\\\\])", "\\\\$1") for c in columns]
    return F.concat_ws("\u0001", *parts) if parts else F.lit("")


def row_text(df: DataFrame) -> DataFrame:
    """One column `row`, the text of every row."""
    return df.select(_text({f.name: f.dataType for f in df.schema.fields}, df.columns).alias("row"))


def fingerprint(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, n_rows, n_columns, fingerprint) that equal sets of rows share, whatever their order and repeats; one row
    without keys.

    Rows are deduplicated and their hashes added up, so nothing is gathered; two independent hashes make a chance
    agreement of different sets negligible, and row_sets_equal decides exactly.
    """
    own = [c for c in df.columns if c not in keys]
    types = {f.name: f.dataType for f in df.schema.fields}
    distinct = df.select(*keys, _text(types, own).alias("row")).distinct()
    total = lambda seed: F.coalesce(F.sum(F.xxhash64(F.lit(seed), "row").cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)")).cast("string")
    return distinct.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.concat_ws(":", total(1), total(2)).alias("fingerprint")).withColumn("n_columns", F.lit(len(own)))


def row_sets_equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row (equal): set equality of rows by position. Empty results are equal."""
    a, b = row_text(left).distinct().withColumn("_side", F.lit(1)), row_text(right).distinct().withColumn("_side", F.lit(2))
    sides = a.union(b).groupBy("row").agg(F.count("*").alias("n"))
    same = F.lit(len(left.columns) == len(right.columns))
    lonely = sides.agg(F.count_if(F.col("n") < 2).alias("lonely"), F.count("*").alias("n"))
    return lonely.select(((F.col("n") == 0) | (same & (F.col("lonely") == 0))).alias("equal"))


def _ranked(df: DataFrame, values: list[str], own: list[str], tag: str) -> DataFrame:
    """A written table of the distinct rows of df in order, each with the places [_from, _to) that its repeats take.

    A row is its normalised values (`_row`) and the columns `own`. The order is that of the values as sorted texts, then
    by position. Rows are dealt out by ranges of it, and the counts of the ranges before tell where a range begins;
    repeats are counted first, by hash and without a sort, so no row is a hot key.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    rows = df.select(F.array(*(normalised(F.col(f"`{v}`"), types[v]) for v in values)).alias("_row"), *(F.col(f"`{v}`") for v in own))
    order = ["_key", "_row", *(f"`{v}`" for v in own)]
    distinct = rows.groupBy("_row", *(f"`{v}`" for v in own)).agg(F.count("*").alias("_n")).withColumn("_key", F.array_sort("_row"))
    dealt = materialise(distinct.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy("_part").agg(F.sum("_n").alias("_c"))  # a row for each range
    before = F.sum("_c").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")
    inside = F.sum("_n").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    placed = dealt.withColumn("_inside", inside).join(F.broadcast(parts.select("_part", before.alias("_before"))), "_part")
    end = F.col("_before") + F.col("_inside")
    return materialise(placed.select((end - F.col("_n")).alias("_from"), end.alias("_to"), F.struct("_row", *(F.col(f"`{v}`") for v in own)).alias(tag)))


def similar_sets(left: DataFrame, right: DataFrame, values: list[str], embedding_of: dict[str, str], threshold: float = 0.95) -> DataFrame:
    """One row (n_left, n_right, unlike, similar): results aligned by the order of their rows' values, place by place.

    Texts that have an embedding column agree if the cosine reaches the threshold, unless one of them is an identifier;
    everything else must be equal, floats up to six decimals. `unlike` counts the places that do not agree, and results
    are similar if they are of equal length and there is none. Equal results of any length are similar.

    Distinct rows take ranges of places. Ranges are cut into blocks of places, each a task's work, and inside a block
    every row goes with the one of the other side that holds its place: as many comparisons as there are rows at most.
    """
    own = list(dict.fromkeys([*(v for v in values if v in embedding_of), *embedding_of.values()]))
    a, b = _ranked(left, values, own, "a"), _ranked(right, values, own, "b")
    n_left, n_right = (x.agg(F.coalesce(F.max("_to"), F.lit(0))).first()[0] for x in (a, b))
    block = max(1 << 16, max(n_left, n_right) // 20_000)

    def cut(df: DataFrame, tag: str, other: str) -> DataFrame:
        blocks = F.explode(F.sequence(F.floor(F.col("_from") / block), F.floor((F.col("_to") - 1) / block))).alias("_block")
        return df.select(blocks, "_from", F.col(tag)).select("_block", F.greatest("_from", F.col("_block") * block).alias("_at"), tag, F.lit(None).cast((b if other == "b" else a).schema[other].dataType).alias(other))

    events = cut(a, "a", "b").unionByName(cut(b, "b", "a"))
    so_far = Window.partitionBy("_block").orderBy("_at")
    # rows of both sides that begin at one place see each other, and the first of them takes no place
    seen = so_far.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = events.select(
        "_block", "_at", F.last("a", True).over(seen).alias("a"), F.last("b", True).over(seen).alias("b"),
        F.coalesce(F.lead("_at").over(so_far), F.least((F.col("_block") + 1) * block, F.lit(max(n_left, n_right)))).alias("_end"),
    )
    fits = F.lit(True)
    for i, v in enumerate(values):
        same = F.col("a._row")[i].eqNullSafe(F.col("b._row")[i])
        if v in embedding_of:
            x, y, e = F.col(f"a.`{v}`"), F.col(f"b.`{v}`"), embedding_of[v]
            near = ~is_id(x) & ~is_id(y) & (cosine(F.col(f"a.`{e}`"), F.col(f"b.`{e}`")) >= threshold)
            same = same | F.coalesce(near, F.lit(False))
        fits = fits & same
    short = F.lit(min(n_left, n_right))
    places = F.greatest(F.least("_end", short) - F.col("_at"), F.lit(0))
    unlike = both.agg(F.coalesce(F.sum(F.when((places == 0) | fits, F.lit(0)).otherwise(places)), F.lit(0)).alias("unlike"))
    return unlike.select(F.lit(n_left).cast("long").alias("n_left"), F.lit(n_right).cast("long").alias("n_right"), "unlike", ((F.col("unlike") == 0) & F.lit(n_left == n_right)).alias("similar"))


def divergent(sets: DataFrame, item: str, position: str, print_: str = "fingerprint") -> DataFrame:
    """Pairs of interpretations of one item (first < second) whose result sets are the same: violations of divergence."""
    a = sets.select(item, F.col(position).alias("first"), F.col(print_).alias("_p"))
    b = sets.select(item, F.col(position).alias("second"), F.col(print_).alias("_p"))
    return a.join(b, [item, "_p"]).where(F.col("first") < F.col("second")).select(item, "first", "second")


def outcome(executed: Column, equals_default: Column, equals_any: Column) -> Column:
    """invalid_query, null (right), valid_non_default or wrong_result; without gold the outcome is null."""
    return (
        F.when(~F.coalesce(executed, F.lit(False)), "invalid_query")
        .when(equals_default.isNull() | equals_default, F.lit(None))
        .when(F.coalesce(equals_any, F.lit(False)), "valid_non_default")
        .otherwise("wrong_result")
    )
