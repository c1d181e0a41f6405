"""Ranking and coverage statistics, percentiles, constrained selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.written import materialise

#: Distinct values that one window may rank by itself.
FEW_VALUES = 1 << 18


def exact_sum(value: Column | str) -> Column:
    """The sum of finite doubles by their first six decimals, added as decimals: the same in whatever order rows come."""
    value = F.col(value) if isinstance(value, str) else value
    return F.sum(value.cast("decimal(28,6)")).cast("double")


def running(grid: DataFrame, keys: list[str], value: str, n: str) -> DataFrame:
    """grid with `_upto` and `_all`: the sums of `n` up to a row's value, itself included, and over its key.

    The grid is written once. A small one is ranked by a window over each key. The rows of a larger one are dealt out by
    ranges of key and value, a window runs inside each range, and the sums of a key's ranges, as many as there are
    partitions, give where it starts; so no task sorts all values of a key.
    """
    written = materialise(grid)
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    if written.count() <= FEW_VALUES:
        upto = F.sum(n).over(whole.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
        return written.withColumns({"_upto": upto, "_all": F.sum(n).over(whole)})
    dealt = materialise(written.repartitionByRange(*keys, value).withColumn("_piece", F.spark_partition_id()))
    sums = dealt.groupBy(*keys, "_piece").agg(F.sum(n).alias("_sum"))
    before = F.sum("_sum").over(whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum")
    starts = sums.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_piece").alias("_place"), before.alias("_before"), F.sum("_sum").over(whole).alias("_all"))
    same = dealt["_piece"] == starts["_place"]
    for i, k in enumerate(keys):
        same = same & dealt[k].eqNullSafe(starts[f"_k{i}"])
    inside = Window.partitionBy(*keys, "_piece").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    both = dealt.join(starts, same).withColumn("_upto", F.col("_before") + F.sum(n).over(inside))
    return both.drop("_piece", "_place", "_before", *(f"_k{i}" for i in range(len(keys))))


def roc_auc(df: DataFrame, score: str, positive: Column, keys: list[str] | None = None) -> DataFrame:
    """(keys, n_pos, n_neg, auc): Mann-Whitney with mid-ranks, 0.5 if a class is empty.

    Rows are first aggregated to distinct scores, whose running counts give the ranks.
    """
    keys = keys or []
    grid = df.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count("*").alias("_n"), F.sum(positive.cast("long")).alias("_p"))
    mid = F.col("_upto") - (F.col("_n") - 1) / F.lit(2.0)
    agg = running(grid, keys, score, "_n").withColumn("_mid", mid).groupBy(*keys).agg(F.sum("_p").alias("n_pos"), F.sum(F.col("_n") - F.col("_p")).alias("n_neg"), F.sum(F.col("_mid") * F.col("_p")).alias("_s"))
    u = (F.col("_s") - F.col("n_pos") * (F.col("n_pos") + 1) / F.lit(2.0)) / (F.col("n_pos").cast("double") * F.col("n_neg"))
    return agg.select(*keys, "n_pos", "n_neg", F.when((F.col("n_pos") == 0) | (F.col("n_neg") == 0), F.lit(0.5)).otherwise(u).alias("auc"))


def coverage(beams: DataFrame, gold: DataFrame, item: str, sig: str, rank: str) -> DataFrame:
    """(item, covered, em_at_1): whether any beam, and the first, has a gold signature."""
    hits = beams.join(gold.select(item, sig).distinct().withColumn("_gold", F.lit(True)), [item, sig], "left")
    hit = F.coalesce("_gold", F.lit(False))
    return hits.groupBy(item).agg(F.bool_or(hit).alias("covered"), F.coalesce(F.bool_or(hit & (F.col(rank) == 1)), F.lit(False)).alias("em_at_1"))


def hallucination(beams: DataFrame, item: str, names: str, legal: Column) -> DataFrame:
    """(item, share): beams that mention a name out of the legal array."""
    bad = F.size(F.array_except(names, legal)) > 0
    return beams.groupBy(item).agg(F.avg(bad.cast("double")).alias("share"))


def select_constrained(settings: DataFrame, least_coverage: float = 0.85) -> DataFrame:
    """The row of best (auc, least hallucination) among settings (setting, cov, auc, hallucination) that cover enough,
    else the one of best coverage, then auc."""
    ok = F.col("cov") >= least_coverage
    order = [
        F.desc(ok.cast("int")), F.desc(F.when(ok, F.col("auc")).otherwise(F.col("cov"))), F.desc(F.when(ok, -F.col("hallucination")).otherwise(F.col("auc"))), F.asc("setting"),
    ]
    return settings.withColumn("qualified", ok).orderBy(*order).limit(1)


def nearest_rank(df: DataFrame, value: str, keys: list[str] | None = None, points: tuple[int, ...] = (50, 90, 95, 99)) -> DataFrame:
    """(keys, count, mean, max, p50, ...) with nearest-rank percentiles.

    Running counts of distinct values give every percentile without a sort of all rows.
    """
    keys = keys or []
    grid = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranked = running(grid, keys, value, "_n")
    cut = lambda p: F.greatest(F.ceil(F.col("_all") * p / F.lit(100.0)), F.lit(1))
    return ranked.groupBy(*keys).agg(
        F.sum("_n").alias("count"), (F.sum(F.col(value) * F.col("_n")) / F.sum("_n")).alias("mean"), F.max(value).alias("max"),
        *(F.min(F.when(F.col("_upto") >= cut(p), F.col(value))).alias(f"p{p}") for p in points),
    )


def stratified(df: DataFrame, stratum: str, order: list[str], quota: int) -> DataFrame:
    """The first `quota` rows of each stratum by `order`."""
    w = Window.partitionBy(stratum).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= quota).drop("_n")


def auc_table(df: DataFrame, signals: list[str], positive: Column, priors: dict[str, float] | None = None) -> DataFrame:
    """(signal, auc, prior, gain) of several score columns at once."""
    long = df.select(positive.alias("_pos"), *signals).unpivot(["_pos"], signals, "signal", "_score")
    out = roc_auc(long, "_score", F.col("_pos"), ["signal"]).select("signal", "auc")
    known = F.create_map(*(F.lit(x) for kv in (priors or {"": 0.5}).items() for x in kv))
    return out.withColumn("prior", F.coalesce(F.try_element_at(known, F.col("signal")), F.lit(0.5))).withColumn("gain", F.col("auc") - F.col("prior"))


def score_settings(beams: DataFrame, gold: DataFrame, ambiguous: DataFrame, sig: str, names: str, legal: Column) -> DataFrame:
    """(setting, cov, hallucination, auc) of decoding settings.

    beams is (setting, item, rank, sig, names), gold (item, sig) and ambiguous (item, is_ambiguous). Coverage and the
    share of beams with a name out of the legal array are means over items; the area under the curve is that of the
    items' beam entropies.
    """
    from .ambiguity import entropy_of_beams

    keyed = gold.select("item", sig).distinct().withColumn("_gold", F.lit(True))
    hits = beams.join(keyed, ["item", sig], "left").withColumn("_bad", (F.size(F.array_except(names, legal)) > 0).cast("double"))
    item = hits.groupBy("setting", "item").agg(F.bool_or(F.coalesce("_gold", F.lit(False))).cast("double").alias("covered"), F.avg("_bad").alias("bad"))
    means = item.groupBy("setting").agg(F.avg("covered").alias("cov"), F.avg("bad").alias("hallucination"))
    # different counts may have the same entropy, up to the last bits: those are ties
    spread = entropy_of_beams(beams, ["setting", "item"], sig).withColumn("entropy", F.round("entropy", 12)).join(ambiguous, "item")
    curve = roc_auc(spread, "entropy", F.col("is_ambiguous"), ["setting"]).select("setting", "auc")
    return means.join(curve, "setting")


def finding(table: DataFrame, flat: float = 0.01) -> DataFrame:
    """(best, best_auc, spread, is_flat, finding) of an auc_table(): whether its signals differ by more than `flat`."""
    one = table.agg(F.max_by("signal", F.struct("auc", "signal")).alias("best"), F.max("auc").alias("best_auc"), (F.max("auc") - F.min("auc")).alias("spread"))
    level = F.round("spread", 12) <= flat
    text = F.when(level, F.lit("no signal stands out")).otherwise(F.concat(F.col("best"), F.lit(" separates best")))
    return one.withColumn("is_flat", level).withColumn("finding", text)
