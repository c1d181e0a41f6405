"""Evaluation metrics over a table of attempts, one pass of conditional aggregates per condition.

attempts: condition, question_id, attempt_no, is_correct, matches_any, ambiguity_type (null: unambiguous),
failure_mode, syntax_valid, schema_score, route_to, evaluated, retry_count. The last attempt of a question is its
final one. Denominators are questions, never attempts; a ratio over nothing is 0; what a condition cannot have is NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = ("schema", "entity", "intent", "temporal")
#: Order and titles of the rendered tables.
CONDITIONS = ("baseline", "schema_grounded", "disambiguation_enhanced")


def ratio(hits: Column, of: Column) -> Column:
    return F.coalesce(F.try_divide(F.sum(F.when(hits & of, 1).otherwise(0)).cast("double"), F.sum(F.when(of, 1).otherwise(0))), F.lit(0.0))


def per_question(attempts: DataFrame) -> DataFrame:
    """One row a question and condition: the final attempt, and what the first validation and evaluation were."""
    last = F.struct("attempt_no")
    fields = ["is_correct", "matches_any", "ambiguity_type", "syntax_valid", "schema_score", "route_to", "retry_count"]
    first_eval = F.when(F.col("evaluated"), F.struct("attempt_no", "is_correct", "failure_mode"))
    return attempts.groupBy("condition", "question_id").agg(
        *(F.max_by(c, last).alias(c) for c in fields),
        F.min_by("route_to", last).alias("first_route"),
        F.min(F.when(F.col("evaluated") & F.col("is_first_attempt"), F.struct("attempt_no", "is_correct"))).alias("_first"),
        F.min_by(F.struct("failure_mode"), F.when(F.col("evaluated") & F.col("is_first_attempt"), F.col("attempt_no"))).alias("_first_failure"),
        F.count(first_eval).alias("n_evaluated"),
    )


def bundle(attempts: DataFrame) -> DataFrame:
    """(condition, n_total, n_ambiguous, and the rates of the evaluation); empty input gives no rows."""
    q, yes = per_question(attempts), F.lit(True)
    true = lambda c: F.coalesce(c, F.lit(False))
    accepted, syntax = true(F.col("route_to") == "accept"), true(F.col("syntax_valid"))
    initial = true(F.col("first_route") == "accept")
    wrong_first = true(F.col("_first_failure.failure_mode") == "wrong_result")
    return q.groupBy("condition").agg(
        F.count("*").alias("n_total"),
        F.count("ambiguity_type").alias("n_ambiguous"),
        ratio(true(F.col("is_correct")), yes).alias("ex"),
        ratio(true(F.col("matches_any")), yes).alias("ea"),
        ratio(accepted, yes).alias("kg_valid"),
        ratio(syntax, yes).alias("syntax"),
        ratio(true(F.col("schema_score") >= 1.0), syntax).alias("schema_given_syntax"),
        ratio(true(F.col("_first.is_correct")), yes).alias("pass_at_1"),
        ratio(true(F.col("matches_any")), F.col("ambiguity_type").isNotNull()).alias("ambiguous_ea"),
        ratio(initial, yes).alias("initial_valid"),
        ratio(accepted, yes).alias("post_valid"),
        ratio(accepted, ~initial).alias("structural_repair"),
        ratio(true(F.col("is_correct")), wrong_first).alias("semantic_repair"),
        F.avg(F.col("retry_count").cast("double")).alias("average_iterations"),
    )


def by_type(attempts: DataFrame) -> DataFrame:
    """(condition, ambiguity_type, n, ea) for each of the four types, absent ones with n 0 and ea 0."""
    q = per_question(attempts)
    types = q.select("condition").distinct().withColumn("ambiguity_type", F.explode(F.array(*map(F.lit, TYPES))))
    found = q.where("ambiguity_type is not null").groupBy("condition", "ambiguity_type").agg(F.count("*").alias("n"), F.avg(F.coalesce("matches_any", F.lit(False)).cast("double")).alias("ea"))
    return types.join(found, ["condition", "ambiguity_type"], "left").select("condition", "ambiguity_type", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("ea", F.lit(0.0)).alias("ea"))


def detection(predictions: DataFrame, questions: DataFrame) -> DataFrame:
    """One row (tp, fp, fn, prec, rec, f1, dsr) from predictions (question_id, attempt_no, predicted) and final
    questions (question_id, is_ambiguous, is_correct).

    The last prediction of a question counts; questions never predicted count nowhere. DSR is the share of right
    answers among questions ever flagged.
    """
    last = predictions.groupBy("question_id").agg(F.max_by("predicted", "attempt_no").alias("predicted"), F.bool_or("predicted").alias("ever"))
    both = last.join(questions, "question_id", "left").withColumn("truth", F.coalesce("is_ambiguous", F.lit(False)))
    c = both.agg(
        F.count_if(F.col("predicted") & F.col("truth")).alias("tp"), F.count_if(F.col("predicted") & ~F.col("truth")).alias("fp"), F.count_if(~F.col("predicted") & F.col("truth")).alias("fn"),
        ratio(F.coalesce("is_correct", F.lit(False)), F.col("ever") & F.col("is_correct").isNotNull()).alias("dsr"),
    )
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    c = c.withColumn("prec", zero(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")))).withColumn("rec", zero(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))))
    return c.withColumn("f1", f1(F.col("prec"), F.col("rec")))


def f1(precision: Column, recall: Column) -> Column:
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def with_undetected(metrics: DataFrame, detected: DataFrame, condition: str = "disambiguation_enhanced") -> DataFrame:
    """Metrics with the detection columns of one condition; NaN for the conditions that detect nothing."""
    d = detected.select("prec", "rec", "f1", "dsr").withColumn("condition", F.lit(condition))
    both = metrics.join(d, "condition", "left")
    nan = F.lit(float("nan"))
    return both.select(*metrics.columns, *(F.coalesce(c, nan).alias(c) for c in ("prec", "rec", "f1", "dsr")))


def assemble(questions: DataFrame, finals: DataFrame) -> DataFrame:
    """Every question with its final evaluation; one never evaluated is an invalid query that answers nothing."""
    both = questions.join(finals, "question_id", "left")
    return both.withColumn("failure_mode", F.when(F.col("is_correct").isNull(), "invalid_query").otherwise(F.col("failure_mode"))).withColumns(
        {c: F.coalesce(c, F.lit(False)) for c in ("is_correct", "matches_any")}
    )


def long_form(metrics: DataFrame, names: list[str]) -> DataFrame:
    return metrics.unpivot(["condition"], names, "metric", "value")


def render(metrics: DataFrame, names: list[str], titles: dict[str, str] | None = None) -> str:
    """Metrics by condition as a markdown table in percent, NaN as a dash. The frame is a handful of rows."""
    rows = {r["condition"]: r for r in metrics.collect()}
    order = [c for c in CONDITIONS if c in rows] + sorted(set(rows) - set(CONDITIONS))
    show = lambda v: "-" if v is None or v != v else f"{100 * v:.1f}"
    lines = ["| metric | " + " | ".join(order) + " |", "|---" * (len(order) + 1) + "|"]
    lines += [f"| {(titles or {}).get(n, n)} | " + " | ".join(show(rows[c][n]) for c in order) + " |" for n in names]
    return "\n".join(lines)


#: Titles of the three tables and what each shows: the answers, the repair of queries, the detection of ambiguity.
TABLES = {
    "Answers": ("n_total", "ex", "ea", "ambiguous_ea", "pass_at_1"),
    "Validity and repair": ("initial_valid", "post_valid", "kg_valid", "syntax", "schema_given_syntax", "structural_repair", "semantic_repair"),
    "Ambiguity": ("prec", "rec", "f1", "dsr"),
}


def tables(metrics: DataFrame) -> DataFrame:
    """(title, line_no, metric, condition, value) of the three tables, conditions in their order; NaN where a condition
    has no such value."""
    known = [(title, i, n) for title, names in TABLES.items() for i, n in enumerate(names) if n in metrics.columns]
    place = metrics.sparkSession.createDataFrame(known, "title string, line_no int, metric string")
    wide = metrics.select("condition", *(F.col(n).cast("double").alias(n) for _, _, n in known))
    return long_form(wide, [n for _, _, n in known]).join(F.broadcast(place), "metric").select("title", "line_no", "metric", "condition", "value")


def render_tables(metrics: DataFrame) -> str:
    """The three tables as markdown, each under its title."""
    return "\n\n".join(f"## {title}\n\n{render(metrics, [n for n in names if n in metrics.columns])}" for title, names in TABLES.items())
