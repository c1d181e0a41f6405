"""Sharding by sampled splitters, in DataFrame functions only.

Records are ordered by (hash of the text, id): copies stand side by side, and a group of copies of any size is still
divisible by id. A size-weighted sample of that order gives quantile boundaries, which cut the order into ranges of
about equal bytes; a range that turns out overfull is cut again by a sample of its own. One aggregation counts the
rows and bytes of each range, and from their running sums every record knows its exact place in the whole order without
a global sort. A shard is a stretch of that order of 1 / shards of all bytes.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialise

OVERHEAD = 16
DRAWS = 40.0


def _uniform(*parts: Column | str, seed: int) -> Column:
    """A number in [0, 1) that only the named columns decide."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11) / F.lit(float(1 << 53))


def _splitters(keys: DataFrame, draws: Column, scope: Column, seed: int) -> DataFrame:
    """Boundaries (h, key) within each scope, one after about every DRAWS size-weighted draws.

    `draws` is a record's expected number of draws; one below 1 is the chance to be drawn once, a heavy record counts
    for all its draws. So the sample has about DRAWS rows a boundary, whatever the input.
    """
    drawn = keys.select("h", "key", scope.alias("scope"), F.greatest(draws, F.lit(1.0)).alias("w"), draws.alias("draws")).where(_uniform("h", "key", seed=seed) < F.col("draws"))
    # the sample is dealt out by ranges of its order, and sums of the ranges before tell where the sum of one begins
    dealt = materialise(drawn.select("scope", "h", "key", "w").repartitionByRange("scope", "h", "key").withColumn("piece", F.spark_partition_id()))
    sums = dealt.groupBy("scope", "piece").agg(F.sum("w").alias("sum"))
    ahead = Window.partitionBy("scope").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("scope", "piece", F.coalesce(F.sum("sum").over(ahead), F.lit(0.0)).alias("before"))
    inside = Window.partitionBy("scope", "piece").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("before") + F.sum("w").over(inside)
    step = dealt.join(starts, ["scope", "piece"]).withColumn("upto", upto)
    return step.where(F.floor(F.col("upto") / DRAWS) > F.floor((F.col("upto") - F.col("w")) / DRAWS)).select("h", "key").distinct()


def shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", seed: int = 5, rows_per_range: int = 50_000) -> DataFrame:
    """Deal documents into `shards` shards of near equal bytes; a record's size is the UTF-8 bytes of its text plus 16.

    Returns id_col, size, text_crc32, law ('bytes'), shard, slot (gapless from 0 in each shard) and grown_shard
    (null under this law). Shards differ from each other by at most about the size of one record. Equal texts stand
    together, so a group of copies shares a shard unless it lies across a boundary. A null text has size 16 and a null
    checksum; a null id counts as the smallest; repeated rows are placed one by one, ties by size and checksum; very long
    texts count by their size; other columns, whatever their names, are ignored; an empty table gives no rows.
    """
    text = F.col(text_col)
    rows = materialise(
        docs.select(
            F.col(id_col).alias("id"),
            F.coalesce(F.xxhash64(text), F.lit(0)).alias("h"),
            F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("key"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD).alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        )
    )
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    wanted, total = max(8 * shards, ceil(n / rows_per_range)), max(total, 1)
    cut = materialise(_splitters(rows.select("h", "key", "size"), F.col("size") * (DRAWS * wanted / total), F.lit(0), seed))
    placed, sums = _placed(rows, cut, wanted)
    # a range overfull in bytes is cut again by boundaries drawn inside it; at most a third of the ranges can be
    over = sums.where((F.col("n_bytes") > 3.0 * total / wanted) & (F.col("n_rows") > 1))
    if over.limit(1).count():
        full = placed.join(F.broadcast(over.select("range")), "range")
        cut = materialise(cut.union(_splitters(full, F.col("size") * (DRAWS * wanted / total), F.col("range"), seed + 1)).distinct())
        placed, sums = _placed(rows, cut, wanted)
    # rows of `sums`: the ranges; their running totals need one task, over as many rows as there are ranges
    ahead = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        "range",
        F.coalesce(F.sum("n_rows").over(ahead), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("n_bytes").over(ahead), F.lit(0)).alias("bytes_before"),
    )
    within = Window.partitionBy("range").orderBy("h", "key", "size", "text_crc32")
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = (
        placed.join(starts, "range")
        .withColumn("at", F.col("rows_before") + F.row_number().over(within) - 1)
        .withColumn("middle", F.col("bytes_before") + F.sum("size").over(upto) - F.col("size") / 2)
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.col("middle") * shards / float(total))).cast("int"))
    )
    ordered = materialise(ordered.select("id", "size", "text_crc32", "shard", "at"))
    fronts = ordered.groupBy("shard").agg(F.min("at").alias("front"))  # one row a shard
    return ordered.join(F.broadcast(fronts), "shard").select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("at") - F.col("front")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def _placed(rows: DataFrame, cut: DataFrame, wanted: int) -> tuple[DataFrame, DataFrame]:
    """Records with their ranges, and the rows and bytes of each range."""
    placed = materialise(_place(rows, cut, wanted))
    return placed, placed.groupBy("range").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"))


def _place(rows: DataFrame, cut: DataFrame, wanted: int) -> DataFrame:
    """The range of each record: how many boundaries (h, key) are at or before it.

    The hash space is split into slots, about as many as ranges; a slot carries the boundaries inside it, in order, and
    the number of those in earlier slots, so a record looks at the few boundaries of its own slot only. A text with very
    many copies has all its boundaries in one slot: there a record looks at every s-th of them first, s being the root
    of their number, and then at s more.
    """
    bits = max(12, wanted.bit_length())
    slot = F.shiftright("h", 64 - bits)
    inside = cut.withColumn("slot", slot).groupBy("slot").agg(F.array_sort(F.collect_list(F.struct("h", "key"))).alias("cuts"))
    before = Window.partitionBy(F.lit(0)).orderBy("slot")
    upto = inside.withColumn("upto", F.sum(F.size("cuts")).over(before))
    # every slot has a row, so that records of slots without a boundary know the boundaries before them too
    every = cut.sparkSession.range(-(1 << (bits - 1)), 1 << (bits - 1)).select(F.col("id").alias("slot"))
    every = every.join(upto, "slot", "left").withColumn("before", F.coalesce(F.max("upto").over(before), F.lit(0)) - F.coalesce(F.size("cuts"), F.lit(0)))
    every = every.withColumn("cuts", F.coalesce("cuts", F.array().cast("array<struct<h:bigint,key:bigint>>")))
    step = F.greatest(F.ceil(F.sqrt(F.size("cuts"))), F.lit(1)).cast("int")
    heads = F.filter("cuts", lambda _, i: i % F.col("step") == 0)
    # a row a slot and all boundaries, as many as ranges: one in rows_per_range records
    table = every.withColumn("step", step).select("slot", "before", "cuts", "step", heads.alias("heads"))
    table = F.broadcast(table) if wanted <= BROADCAST_ROWS else table
    own = F.struct("h", "key")
    passed = lambda of: F.size(F.filter(of, lambda c: c <= own))
    block = F.greatest(passed("heads") - 1, F.lit(0)) * F.col("step")
    within = passed(F.slice("cuts", block + 1, F.col("step")))
    return rows.withColumn("slot", slot).join(table, "slot").withColumn("range", F.col("before") + block + within).drop("slot", "before", "cuts", "step", "heads")
