"""Training-data preparation: exclusion reasons, deduplication, disjointness, splits, mixes, token inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import extract_schema_pattern, has_relationship_type
from ..functions.strings import normalised_question
from ..plans.catalog import GraphSchema
from ..plans.written import materialise
from .gates import validated
from .similar import near_any


def hash_order(seed: int, key: Column | str) -> Column:
    """A reproducible shuffle key: the same on every engine that has md5."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def with_reasons(rows: DataFrame, cypher: str = "cypher", keep_node_only: bool = False, schema: GraphSchema | None = None) -> DataFrame:
    """rows with `pattern` and `reason` (kept, parse, node_only, or syntax where a schema is given to validate with)."""
    df = rows.withColumn("pattern", extract_schema_pattern(cypher))
    reason = F.when(F.col("pattern").isNull(), "parse")
    if schema is not None:
        df = validated(df, schema, cypher)
        reason = reason.when(~F.col("verdict.syntax"), "syntax")
    if not keep_node_only:
        reason = reason.when(~has_relationship_type("pattern"), "node_only")
    return df.withColumn("reason", reason.otherwise("kept")).drop("verdict")


def first_wins(rows: DataFrame, text: str, position: list[str], keep: list[str] | None = None) -> DataFrame:
    """One row for each normalised text, the first by position; with `keep`, these columns of it.

    Texts are grouped by a 128-bit digest, on the way into the shuffle. With `keep` the wanted columns go with the
    position, in one aggregation. Without, the first positions are joined back by position and digest, so no text is
    shuffled as a key and no key is hot.
    """
    keyed = rows.withColumn("_digest", F.md5(normalised_question(F.coalesce(text, F.lit("")))))
    if keep is not None:
        return keyed.groupBy("_digest").agg(F.min_by(F.struct(*keep), F.struct(*position)).alias("_first")).select("_first.*")
    first = keyed.groupBy(F.col("_digest").alias("_of")).agg(F.min(F.struct(*position)).alias("_first")).select("_of", "_first.*")
    first = first.select("_of", *(F.col(p).alias(f"_{p}") for p in position))
    same = keyed["_digest"] == first["_of"]
    for p in position:
        same = same & keyed[p].eqNullSafe(first[f"_{p}"])
    return keyed.join(first, same, "left_semi").drop("_digest")


def disjoint(rows: DataFrame, blocked: DataFrame, text: str, block_text: str, ratio: float = 0.9) -> DataFrame:
    """Rows whose text is neither equal to a blocked one (normalised) nor within `ratio` of one by token sets.

    Exact copies go by an anti-join on digests, others by a similarity join of the distinct texts that are left
    (similar.near_any), which a ratio over 1 leaves out. Rows without a text stay.
    """
    block = blocked.select(normalised_question(block_text).alias("text")).where("text is not null").distinct()
    keyed = rows.withColumn("_n", normalised_question(text)).withColumn("_key", F.md5("_n"))
    left = keyed.join(block.select(F.md5("text").alias("_key")), "_key", "left_anti")
    if ratio > 1:
        return left.drop("_n", "_key")
    left = materialise(left)  # texts are normalised once
    found = near_any(left.where("_n is not null").groupBy(F.col("_key").alias("key")).agg(F.any_value("_n").alias("text")), block, ratio)
    return left.join(found.select(F.col("key").alias("_key")), "_key", "left_anti").drop("_n", "_key")


def split(rows: DataFrame, key: str, seed: int = 13, share: float = 0.1) -> DataFrame:
    """rows with `part`: exactly floor(n * share) of them are eval, the first by hash order.

    The cut is found by counting hash prefixes, and only the prefix in which it falls is ranked, so no task sorts all
    rows.
    """
    df = rows.withColumn("_h", hash_order(seed, key))
    n = df.count()
    want = int(n * share + 1e-9)
    prefix = F.substring("_h", 1, 4)
    counts = df.groupBy(prefix.alias("_p")).agg(F.count("*").alias("_c"))  # 16 ** 4 rows at most
    w = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = counts.withColumn("_upto", F.sum("_c").over(w)).withColumn("_before", F.col("_upto") - F.col("_c"))
    both = df.withColumn("_p", prefix).join(edge, "_p")
    inside = (F.col("_before") < want) & (F.col("_upto") > want)
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("_h", key))
    ranked = both.where(inside).withColumn("_r", rank + F.col("_before")).withColumn("part", F.when(F.col("_r") <= want, "eval").otherwise("train")).drop("_r")
    rest = both.where(~inside).withColumn("part", F.when(F.col("_upto") <= want, "eval").otherwise("train"))
    return rest.unionByName(ranked).drop("_h", "_p", "_c", "_upto", "_before")


def cap(rows: DataFrame, key: str, most: int, seed: int = 13) -> DataFrame:
    """At most `most` rows, the first by hash order."""
    return rows.orderBy(hash_order(seed, key), key).limit(most)


def mix(own: DataFrame, replay: DataFrame, key: str, most: int, seed: int = 13) -> DataFrame:
    """All own rows and at most `most` replayed ones, shuffled by hash order."""
    return own.unionByName(cap(replay, key, most, seed)).orderBy(hash_order(seed + 1, key), key)


def model_inputs(rows: DataFrame, prompt: str, completion: str, length: int, pad: int) -> DataFrame:
    """input_ids, attention_mask and labels of a fixed length: the prompt's labels are -100, long rows are cut."""
    ids = F.concat(prompt, completion)
    labels = F.concat(F.transform(prompt, lambda _: F.lit(-100)), F.col(completion))
    n = F.least(F.size(ids), F.lit(length))
    fill = lambda x, v: F.concat(F.slice(x, 1, length), F.array_repeat(F.lit(v), F.lit(length) - n))
    return rows.withColumns({"input_ids": fill(ids, pad), "attention_mask": F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(length) - n)), "labels": fill(labels, -100)})
