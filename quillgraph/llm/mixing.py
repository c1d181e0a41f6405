"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each source gets a rate, the mean number of times its documents should appear. A hash of (seed, id) gives every
document a uniform number, and inverting the Poisson distribution of its source's rate at that number gives its count:
the same on every run and every machine, independent between documents, and with no pass over the other documents.
Documents are exploded by their counts and sorted by a hash of (seed, id, copy): a global shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Longer rates are split into chunks of this mean, each with a hash of its own: exp(-rate) stays a normal number.
CHUNK = 64.0


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of an md5 of the parts."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def _cdf(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson variable of mean `rate` <= CHUNK, up to a tail below 2 ** -53."""
    longest = F.ceil(rate + 10 * F.sqrt(rate) + 20).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))
    steps = F.aggregate(
        F.sequence(F.lit(1), longest),
        start,
        lambda s, i: F.struct(
            (s["p"] * rate / i).alias("p"), F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + s["p"] * rate / i)).alias("cdf")
        ),
    )
    return steps["cdf"]


def rates(docs: DataFrame, weights: DataFrame | None = None, source_col: str = "source", text_col: str = "text", power: float = 0.5, total: float = 1.0) -> DataFrame:
    """(source, n_docs, n_bytes, rate): the mean repetitions that give each source its share of the bytes.

    The output aims at `total` times the bytes of docs. `weights` is (source, weight); sources without a weight get
    none. By default the weight of a source is its bytes to `power`, which flattens large sources.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(
        F.count("*").alias("n_docs"), F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")).alias("n_bytes")
    )
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow(F.col("n_bytes").cast("double"), F.lit(power)))
    else:
        own = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("weight"))
        weighed = sizes.join(own, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    weighed = materialise(weighed)  # a row a source
    all_bytes, all_weights = weighed.agg(F.sum("n_bytes"), F.sum("weight")).first()
    aim = float(all_bytes or 0) * float(total)
    share = F.col("weight") / F.lit(float(all_weights or 1.0))
    rate = F.when(F.col("n_bytes") > 0, share * F.lit(aim) / F.col("n_bytes")).otherwise(F.lit(0.0))
    return weighed.select("source", "n_docs", "n_bytes", F.round(rate, 9).alias("rate"))


def counted(docs: DataFrame, rated: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: int = 17) -> DataFrame:
    """docs with `_rate` and `_copies`, each document's Poisson count."""
    chunks = F.greatest(F.ceil(F.col("rate") / CHUNK), F.lit(1)).cast("int")
    table = rated.select(F.col("source").alias("_source"), F.col("rate").alias("_rate"), chunks.alias("_chunks"), _cdf(F.col("rate") / chunks).alias("_cdf"))
    both = docs.join(table, docs[source_col].eqNullSafe(table["_source"]))

    def one(i: Column) -> Column:
        u = uniform(F.lit(seed), F.col(id_col), i)
        return F.size(F.filter("_cdf", lambda c: c < u))

    first = one(F.lit(1))
    many = F.aggregate(F.sequence(F.lit(1), F.col("_chunks")), F.lit(0), lambda s, i: s + one(i))
    copies = F.when(F.col("_chunks") == 1, first).otherwise(many)
    return both.withColumn("_copies", copies.cast("int")).drop("_source", "_chunks", "_cdf")


def mix(
    docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", power: float = 0.5, total: float = 1.0, seed: int = 17
) -> DataFrame:
    """Replicate documents by Poisson counts so that sources take their target shares, in a globally shuffled order.

    Returns the columns of docs and `_rate`, `_copies`, `_copy` (from 1) and `_order`, by which rows are sorted. A
    document whose count is 0 has no row. A null source is a source of its own; a source whose texts are all null or
    empty has the rate 0. Rows that repeat an id, and rows with a null id, share one draw. An empty table gives none.
    Columns of docs must not begin with these five names, all of which start with an underscore.
    """
    rated = rates(docs, weights, source_col, text_col, power, total)
    copies = counted(docs, rated, id_col, source_col, seed).where("_copies > 0")
    copies = copies.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("order"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("_copy").cast("string")))
    return copies.withColumn("_order", order).orderBy("_order")
