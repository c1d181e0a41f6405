"""Steps that ask a model, as joins with its completions, and the build of a training set out of the other operators.

A step renders prompts, hands them to a CompletionSource and reads what comes back; which model answered, and how it
decoded, is the source's business and is described by a Decoding.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompts
from ..functions.patterns import extract_schema_pattern, referenced_names
from ..functions.strings import normalised_question
from ..plans.catalog import GraphSchema
from ..sources.benchmark import CompletionSource, write_jsonl
from . import ambiguity, candidates, prep


@dataclass(frozen=True)
class Decoding:
    """How completions are drawn: diverse beams with a penalty, or samples with a temperature and a nucleus."""

    strategy: str
    k: int = 5
    diversity_penalty: float | None = None
    temperature: float | None = None
    top_p: float | None = None

    def __post_init__(self):
        if self.strategy not in ("beam", "sample"):
            raise ValueError(f"unknown strategy {self.strategy}")
        if self.k < 1 or self.strategy == "beam" and self.temperature is not None or self.strategy == "sample" and self.diversity_penalty is not None:
            raise ValueError("beams take a diversity penalty, samples a temperature, and k is positive")

    def settings(self) -> dict:
        """The settings that apply, by name."""
        return {k: v for k, v in asdict(self).items() if v is not None}


def beam(k: int = 5, diversity_penalty: float = 1.0) -> Decoding:
    return Decoding("beam", k, diversity_penalty=diversity_penalty)


def sampling(k: int = 5, temperature: float = 0.7, top_p: float = 0.95) -> Decoding:
    return Decoding("sample", k, temperature=temperature, top_p=top_p)


def asked(questions: DataFrame, stage: str, text: Column, attempt: Column | None = None) -> DataFrame:
    """(question_id, stage, attempt, prompt) of questions."""
    no = attempt if attempt is not None else F.lit(0)
    return questions.select(F.col("question_id").cast("string").alias("question_id"), F.lit(stage).alias("stage"), no.cast("int").alias("attempt"), text.alias("prompt"))


def link(questions: DataFrame, source: CompletionSource, schema: GraphSchema, min_valid: int = 1) -> tuple[DataFrame, DataFrame]:
    """Questions (question_id, question) to candidate distributions and their status: prompt, completions, mapping."""
    said = source.complete(asked(questions, "schema_linker", prompts.prompt(F.col("question"), schema.to_prompt())))
    return candidates.candidate_mapping(said.select("question_id", "rank", "text", "score"), schema, min_valid)


def detect(scored: DataFrame, source: CompletionSource, schema: str, t_schema: float = ambiguity.T_SCHEMA, t_entity: float = ambiguity.T_ENTITY) -> DataFrame:
    """Questions with entropies (question_id, question, schema_entropy, entity_entropy) and the verdict on each; one
    without a completion is judged by its entropies alone."""
    said = source.complete(asked(scored, "ambiguity_detector", prompts.prompt(F.col("question"), schema)))
    first = said.groupBy("question_id").agg(F.min_by("text", "rank").alias("text"))
    both = scored.withColumn("question_id", F.col("question_id").cast("string")).join(first, "question_id", "left")
    return ambiguity.verdicts(both, t_schema=t_schema, t_entity=t_entity).drop("text")


def disambiguate(open_: DataFrame, choices: DataFrame, source: CompletionSource, schema: str, mode: str = "automated") -> DataFrame:
    """(question_id, decision, committed) of questions (question_id, question, tried).

    A model's new pattern is accepted, a null ends the question; otherwise the first of `choices` (question_id, choice,
    pattern) whose text was not tried is taken (`next`), and where there is none the question is exhausted. Only the
    automated mode can be run over a table: asking a person raises.
    """
    if mode != "automated":
        raise ValueError(f"resolution mode {mode} cannot run over a table of questions")
    tried = F.coalesce("tried", F.array().cast("array<string>"))
    base = open_.withColumn("question_id", F.col("question_id").cast("string")).withColumn("tried", tried)
    said = source.complete(asked(base, "disambiguator", prompts.prompt(F.col("question"), schema, ("Tried", prompts.tried_block(F.col("tried"))))))
    first = said.groupBy("question_id").agg(F.min_by("text", "rank").alias("text"))
    judged = ambiguity.commitments(base.join(first, "question_id", "left"))
    done = base.select("question_id", F.explode("tried").alias("pattern"))
    left = candidates.next_untried(choices.withColumn("question_id", F.col("question_id").cast("string")), done, "question_id", "pattern").select("question_id", F.col("pattern").alias("_next"))
    both = judged.join(left, "question_id", "left")
    return both.select(
        "question_id",
        F.when((F.col("decision") == "next") & F.col("_next").isNull(), "exhausted").otherwise(F.col("decision")).alias("decision"),
        F.when(F.col("decision") == "accept", F.col("committed")).when(F.col("decision") == "next", F.col("_next")).alias("committed"),
    )


def blocklist(spark: SparkSession, *paths: str, field: str = "question") -> DataFrame:
    """One field of several JSON array files; files that do not exist, and objects without the field, are passed over."""
    from pyspark.errors import AnalysisException

    out = spark.createDataFrame([], f"{field} string")
    for path in paths:
        try:
            found = spark.read.schema(f"{field} string").option("multiLine", True).json(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        out = out.union(found.where(F.col(field).isNotNull()))
    return out


@dataclass
class TrainingSet:
    """The four sinks' rows and one row of counts."""

    linker_train: DataFrame
    linker_eval: DataFrame
    generator_train: DataFrame
    generator_eval: DataFrame
    report: DataFrame
    types: DataFrame

    def write(self, folder: str) -> None:
        for name in ("linker_train", "linker_eval", "generator_train", "generator_eval"):
            write_jsonl(getattr(self, name), f"{folder}/{name}")
        self.report.write.mode("overwrite").json(f"{folder}/report")


def training_set(
    rows: DataFrame, blocked: DataFrame, schema: str, block_text: str = "question", ratio: float = 0.9, seed: int = 13, share: float = 0.1, most: int | None = None
) -> TrainingSet:
    """Gate, deduplicate, cap and split rows (row_id, question, pattern, cypher), and render them for both models.

    Rows near a blocked question go first, then repeats of a question (the first by row_id stays), then what is over
    `most` by hash order. Both models get the same split. `types` counts the kept rows of each relationship type.
    """
    gated = prep.disjoint(rows, blocked, "question", block_text, ratio)
    single = prep.first_wins(gated, "question", ["row_id"])
    kept = single if most is None else prep.cap(single, "row_id", most, seed)
    parts = prep.split(kept, "row_id", seed, share)
    linker = parts.select("part", prompts.prompt(F.col("question"), schema).alias("prompt"), F.col("pattern").alias("completion"))
    generator = parts.select("part", prompts.prompt(F.col("question"), schema, ("Pattern", F.col("pattern"))).alias("prompt"), F.col("cypher").alias("completion"))
    counts = [("raw", rows), ("after_gate", gated), ("after_dedup", single), ("kept", kept), ("train", parts.where("part = 'train'")), ("eval", parts.where("part = 'eval'"))]
    each = counts[0][1].agg(F.count("*").alias("raw"))
    for name, df in counts[1:]:
        each = each.crossJoin(df.agg(F.count("*").alias(name)))  # one row each
    report = each.select(
        "raw", (F.col("raw") - F.col("after_gate")).alias("gate_dropped"), (F.col("after_gate") - F.col("after_dedup")).alias("duplicate_dropped"),
        (F.col("after_dedup") - F.col("kept")).alias("trimmed"), "kept", "train", "eval",
    )
    types = kept.select(F.explode(referenced_names("pattern")[1]).alias("type")).groupBy("type").agg(F.count("*").alias("n"))
    of = lambda df, part: df.where(F.col("part") == part).drop("part")
    return TrainingSet(of(linker, "train"), of(linker, "eval"), of(generator, "train"), of(generator, "eval"), report, types)


def gold_patterns(queries: DataFrame) -> DataFrame:
    """(question_id, position, pattern) of labelled queries (question_id, position, cypher) that have a pattern."""
    return queries.withColumn("pattern", extract_schema_pattern("cypher")).where("pattern is not null").select("question_id", "position", "pattern")


def questions_once(rows: DataFrame, text: str) -> DataFrame:
    """Distinct normalised questions of rows, with how many rows ask each."""
    return rows.groupBy(normalised_question(text).alias("question")).agg(F.count("*").alias("n"))
