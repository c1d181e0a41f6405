"""Ambiguity scores of distributions, and verdicts read from model text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import extract_json_object, normalised_pattern

TYPES = ("schema", "entity", "intent", "temporal")
T_SCHEMA, T_ENTITY = 0.6, 0.8


#: Sums of doubles depend on the order of the rows; sums of decimals do not, and partial sums still combine.
_EXACT = "decimal(38,20)"


def _order_free_sum(value: Column) -> Column:
    return F.sum(value.try_cast(_EXACT)).cast("double")


def entropy_of_candidates(df: DataFrame, keys: list[str], score: str, out: str = "entropy") -> DataFrame:
    """Shannon entropy of the scores of a slot over log2 of their number; 0 for one candidate or no mass.

    Scores count as shares of the largest one of the slot, so the sums are of numbers up to 1 and equal sets of scores
    have equal entropies to the last bit, however the rows are dealt out.
    """
    slot = Window.partitionBy(*keys)
    scaled = df.select(*keys, F.try_divide(F.col(score), F.max(score).over(slot)).alias("_x"), (F.max(score).over(slot) > 0).alias("_some"))
    share = scaled.withColumn("_p", F.try_divide(F.col("_x"), F.sum(F.col("_x").try_cast(_EXACT)).over(slot).cast("double")))
    plogp = F.when(F.col("_p") > 0, F.col("_p") * F.log2("_p")).otherwise(F.lit(0.0))
    agg = share.groupBy(*keys).agg(F.count("*").alias("_k"), F.bool_or("_some").alias("_some"), _order_free_sum(-plogp).alias("_h"))
    return agg.select(*keys, F.when((F.col("_k") > 1) & F.col("_some"), F.col("_h") / F.log2(F.col("_k").cast("double"))).otherwise(F.lit(0.0)).alias(out))


def entropy_of_beams(df: DataFrame, keys: list[str], beam: str, out: str = "entropy") -> DataFrame:
    """Natural-log entropy of distinct beams over ln of the number of beams. Not the measure of candidates.

    A function of the counts alone, whatever the order of rows; all beams different is exactly 1, all the same exactly 0.
    """
    counts = df.groupBy(*keys, beam).agg(F.count("*").alias("_c"))
    agg = counts.groupBy(*keys).agg(F.sum("_c").cast("double").alias("_n"), _order_free_sum(F.col("_c") * F.ln(F.col("_c").cast("double"))).alias("_s"))
    mixed = F.when(F.col("_s") == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.col("_s") / (F.col("_n") * F.ln("_n")))
    single = F.abs(mixed) < F.lit(1e-15)
    return agg.select(*keys, F.when((F.col("_n") > 1) & ~single, mixed).otherwise(F.lit(0.0)).alias(out))


def with_normal_beams(df: DataFrame, beam: str) -> DataFrame:
    """df with the beam's pattern without white space and variable names, for the measures over normalised patterns."""
    return df.withColumn(beam, normalised_pattern(beam))


def dominance(df: DataFrame, keys: list[str], beam: str, out: str = "dominance") -> DataFrame:
    """One less the share of the commonest beam."""
    counts = df.groupBy(*keys, beam).agg(F.count("*").alias("_c"))
    return counts.groupBy(*keys).agg((F.lit(1.0) - F.max("_c") / F.sum("_c")).alias(out))


def ambiguity_scores(questions: DataFrame, schema_slots: DataFrame, entity_spans: DataFrame) -> DataFrame:
    """(question_id, schema_entropy, entity_entropy): maxima over relationship slots and over spans with two candidates.

    schema_slots is (question_id, slot, prob), entity_spans (question_id, span, posterior); 0 where nothing counts.
    """
    s = entropy_of_candidates(schema_slots.where(F.col("slot").startswith("rel_")), ["question_id", "slot"], "prob")
    e = entropy_of_candidates(entity_spans, ["question_id", "span"], "posterior")
    out = questions.select("question_id").join(s.groupBy("question_id").agg(F.max("entropy").alias("schema_entropy")), "question_id", "left")
    out = out.join(e.groupBy("question_id").agg(F.max("entropy").alias("entity_entropy")), "question_id", "left")
    return out.select("question_id", F.coalesce("schema_entropy", F.lit(0.0)).alias("schema_entropy"), F.coalesce("entity_entropy", F.lit(0.0)).alias("entity_entropy"))


def fallback(schema_entropy: Column, entity_entropy: Column, t_schema: float = T_SCHEMA, t_entity: float = T_ENTITY) -> tuple[Column, Column]:
    """(is_ambiguous, detected_types) by thresholds alone."""
    s, e = schema_entropy >= t_schema, entity_entropy >= t_entity
    return s | e, F.array_compact(F.array(F.when(s, "schema"), F.when(e, "entity")))


def verdicts(df: DataFrame, text: str = "text", schema: str = "schema_entropy", entity: str = "entity_entropy", t_schema: float = T_SCHEMA, t_entity: float = T_ENTITY) -> DataFrame:
    """df with is_ambiguous, detected_types and parsed, from a JSON verdict or else from the entropies.

    Only a JSON boolean is taken for a verdict; unknown types are dropped, an unambiguous verdict has none.
    """
    verdict = F.from_json(F.col("_json"), "is_ambiguous boolean, detected_types array<string>")
    raw = df.withColumn("_json", extract_json_object(text)).withColumn("_v", verdict)
    said = F.col("_v.is_ambiguous").isNotNull()
    flag, types = fallback(F.col(schema), F.col(entity), t_schema, t_entity)
    legal = F.filter(F.coalesce("_v.detected_types", F.array().cast("array<string>")), lambda t: t.isin(*TYPES))
    none = F.array().cast("array<string>")
    return (
        raw.withColumn("is_ambiguous", F.when(said, F.col("_v.is_ambiguous")).otherwise(flag))
        .withColumn("detected_types", F.when(said, F.when(F.col("_v.is_ambiguous"), legal).otherwise(none)).otherwise(types))
        .withColumn("parsed", said)
        .drop("_json", "_v")
    )


def commitments(df: DataFrame, text: str = "text", tried: str = "tried") -> DataFrame:
    """df with `decision` and `committed`, from a disambiguator's text and the array of patterns tried before.

    exhausted: the JSON says null; accept: a new pattern, kept as it stands; next: anything else (no JSON, blank,
    repeated), for which the next untried candidate is to be taken.
    """
    raw = df.withColumn("_json", extract_json_object(text))
    v = F.try_parse_json("_json")
    kind = F.schema_of_variant(F.try_variant_get(v, "$.committed_pattern", "variant"))
    value = F.trim(F.try_variant_get(v, "$.committed_pattern", "string"))
    fresh = (kind == "STRING") & (value != "") & ~F.coalesce(F.array_contains(F.col(tried), value), F.lit(False))
    decision = F.when(kind == "VOID", "exhausted").when(fresh, "accept").otherwise("next")
    return raw.withColumn("decision", decision).withColumn("committed", F.when(F.col("decision") == "accept", value)).drop("_json")
