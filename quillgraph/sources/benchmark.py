"""Benchmarks, JSON lines, completions and reports."""

from __future__ import annotations

import json
import os
from abc import ABC, abstractmethod
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = (
    "question_id string, question string, num_hops int, is_ambiguous boolean, ambiguity_type string, default_interp string, cypher_default string, "
    "interpretations array<struct<interp:string,cypher:string>>"
)
TYPES = ("schema", "entity", "intent", "temporal")
COMPLETION = "question_id string, stage string, attempt int, rank int, text string, score double"
TRAINING = "prompt string, completion string"


def read_benchmark(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Items of a JSON array file. With strict, the first violation fails the query that reads it."""
    items = spark.read.schema(ITEM).option("multiLine", True).json(path)
    if not strict:
        return items
    problem = reduce(lambda a, b: F.coalesce(a, b), (F.when(test, F.lit(name)) for name, test in rules().items()))
    checked = items.withColumn("_p", F.when(problem.isNotNull(), F.raise_error(F.concat(F.lit("benchmark item "), F.coalesce("question_id", F.lit("?")), F.lit(": "), problem))))
    return checked.where("_p is null").drop("_p")


def rules() -> dict[str, object]:
    """Structural checks by name, each true where it is violated."""
    kind = F.col("ambiguity_type")
    return {
        "missing field": F.col("question_id").isNull() | F.col("question").isNull() | F.col("cypher_default").isNull() | F.col("is_ambiguous").isNull(),
        "illegal type": kind.isNotNull() & ~kind.isin(*TYPES),
        "flag and type disagree": F.coalesce(F.col("is_ambiguous") != kind.isNotNull(), F.lit(True)),
        "ambiguous without interpretations": F.coalesce(F.col("is_ambiguous"), F.lit(False)) & (F.coalesce(F.size("interpretations"), F.lit(0)) < 1),
    }


def violations(items: DataFrame) -> DataFrame:
    """(question_id, rule) of every violated check."""
    parts = [items.where(test).select("question_id", F.lit(name).alias("rule")) for name, test in rules().items()]
    return reduce(DataFrame.union, parts)


def ambiguous_items(items: DataFrame) -> DataFrame:
    return items.where("is_ambiguous")


def items_by_type(items: DataFrame) -> DataFrame:
    """(ambiguity_type, n, question_ids); the unambiguous ones are the group of the null type."""
    return items.groupBy("ambiguity_type").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("question_id")).alias("question_ids"))


def labelled_queries(items: DataFrame) -> DataFrame:
    """(question_id, position, cypher): the default query (0) and those of the interpretations."""
    every = F.concat(F.array("cypher_default"), F.transform(F.coalesce("interpretations", F.array().cast("array<struct<interp:string,cypher:string>>")), lambda i: i["cypher"]))
    return items.select("question_id", F.posexplode(every).alias("position", "cypher"))


def read_jsonl(spark: SparkSession, path: str, schema: str = TRAINING) -> DataFrame:
    """Rows of a JSON lines file; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_report(directory: str, name: str, markdown: str, values: dict, tag: str = "") -> tuple[str, str]:
    """A markdown text and a JSON object on the driver, names suffixed by the tag so that runs do not overwrite others."""
    os.makedirs(directory, exist_ok=True)
    stem = os.path.join(directory, name + (f"-{tag}" if tag else ""))
    with open(stem + ".md", "w", encoding="utf-8") as f:
        f.write(markdown)
    with open(stem + ".json", "w", encoding="utf-8") as f:
        json.dump(values, f, indent=2, sort_keys=True)
    return stem + ".md", stem + ".json"


def write_results(df: DataFrame, path: str, by: tuple[str, ...] = ("model_key", "tag")) -> None:
    df.write.mode("append").partitionBy(*by).parquet(path)


def merge_config(path: str, key: str, value) -> dict:
    """Set one key of a map in a file and keep the others: JSON, or YAML where the name says so and a reader is there."""
    as_yaml = path.endswith((".yaml", ".yml"))
    if as_yaml:
        import yaml  # not a requirement of the package

        load, dump = yaml.safe_load, lambda v, f: yaml.safe_dump(v, f, sort_keys=False)
    else:
        load, dump = json.load, lambda v, f: json.dump(v, f, indent=2)
    found = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            found = load(f) or {}
    found[key] = value
    with open(path, "w", encoding="utf-8") as f:
        dump(found, f)
    return found


def read_split(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """(question, schema, cypher) of a data set's split, whatever else it has."""
    return spark.read.format(form).load(path).select("question", "schema", "cypher")


def cache_beams(completions: DataFrame, path: str) -> DataFrame:
    """Write completions once, by stage, and read them back, so that scores can be recomputed without a model."""
    completions.select("question_id", "attempt", "rank", "text", "score", "stage").write.mode("overwrite").partitionBy("stage").parquet(path)
    return load_beams(completions.sparkSession, path)


def load_beams(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COMPLETION).parquet(path).select("question_id", "stage", "attempt", "rank", "text", "score")


class CompletionSource(ABC):
    """Where model text comes from: a table of completions for a table of prompts."""

    @abstractmethod
    def complete(self, prompts: DataFrame) -> DataFrame:
        """prompts (question_id, stage, attempt, prompt) to rows of COMPLETION."""


class RecordedCompletions(CompletionSource):
    """Completions that were recorded before, matched by question, stage and attempt."""

    def __init__(self, table: DataFrame):
        self.table = table

    def complete(self, prompts: DataFrame) -> DataFrame:
        return self.table.join(prompts.select("question_id", "stage", "attempt"), ["question_id", "stage", "attempt"], "left_semi")
