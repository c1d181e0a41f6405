"""Prompt texts as column expressions: candidates, entities, tried patterns and error feedback."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lines(items: Column, one) -> Column:
    return F.array_join(F.transform(items, one), "\n")


def two_decimals(x: Column) -> Column:
    """A number with two decimals, the nearest to the double itself and ties to even, as printf does: format_string rounds
    the decimal text of a double, and ties up."""
    return F.call_function("format_number", x.cast("double"), F.lit("0.00"))


def candidate_block(slots: Column) -> Column:
    """slots: array of (slot, candidates: array of (text, prob)); scores with two decimals."""
    one = lambda c: F.concat(F.lit("  - "), c["text"], F.lit(" ("), two_decimals(c["prob"]), F.lit(")"))
    return lines(slots, lambda s: F.concat(s["slot"], F.lit(":\n"), lines(s["candidates"], one)))


def entity_block(spans: Column) -> Column:
    """spans: array of (span, candidates: array of (label, name, posterior))."""
    one = lambda c: F.concat(F.lit("  - "), c["label"], F.lit(" "), c["name"], F.lit(" ("), two_decimals(c["posterior"]), F.lit(")"))
    return lines(spans, lambda s: F.concat(F.lit('"'), s["span"], F.lit('":\n'), lines(s["candidates"], one)))


def tried_block(tried: Column) -> Column:
    return F.when(F.size(tried) > 0, lines(tried, lambda t: F.concat(F.lit("- "), t))).otherwise(F.lit("none"))


def error_feedback(query: Column, problems: Column) -> Column:
    return F.concat(F.lit("Failed query: "), query, F.lit("\nProblems: "), F.array_join(problems, "; "))


def prompt(question: Column, schema: Column | str, *blocks: tuple[str, Column], feedback: Column | None = None) -> Column:
    """Titled blocks, the question last; the feedback block only where there is feedback."""
    parts = [F.concat(F.lit("Schema:\n"), F.lit(schema) if isinstance(schema, str) else schema)]
    parts += [F.concat(F.lit(f"{title}:\n"), block) for title, block in blocks]
    if feedback is not None:
        parts.append(F.when(feedback.isNotNull(), feedback))
    parts.append(F.concat(F.lit("Question: "), question))
    return F.concat_ws("\n\n", *parts)


def paraphrases(text: Column, most: int) -> Column:
    """The first `most` lines of a completion without list numbers; blank lines dropped."""
    clean = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*[0-9]+[.)]\s*", "")))
    return F.slice(F.filter(clean, lambda x: x != ""), 1, most)
