"""String normalisation and similarity as column expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised_question(text: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(text, r"^\s+|\s+$", "")), r"\s+", " ")


def is_id(text: Column | str) -> Column:
    return F.rlike(F.trim(text), F.lit(r"^[A-Z]{2,5}-[0-9]{3,}$"))


def tokens(text: Column | str) -> Column:
    """Sorted distinct lower-cased words."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")))


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence of two strings, a row of bits at a time."""
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for ch in b:
        both = row & at.get(ch, 0)
        row = (row + both | row - both) & full
    return len(a) - row.bit_count()


def _lcs(a: pa.Array, b: pa.Array) -> pa.Array:
    known: dict[tuple, int | None] = {}
    for pair in zip(a.to_pylist(), b.to_pylist(), strict=True):
        if pair not in known:
            known[pair] = None if None in pair else lcs_length(*pair)
    return pa.array([known[pair] for pair in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int32())


_lcs.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}  # the names are strings here


def lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two strings, in an Arrow function: bit vectors have no column form."""
    return F.arrow_udf(_lcs, "int")(a, b)


def indel(a: Column, b: Column) -> Column:
    """2 * LCS / (length a + length b), 1 for two empty strings."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(F.lit(2.0) * lcs(a, b) / total)


def token_set(a: Column, b: Column) -> Column:
    """Token-set similarity in [0, 1]: the best Indel of common words against either side's words, and of the rests."""
    x, y = tokens(a), tokens(b)
    both, only_a, only_b = F.array_intersect(x, y), F.array_except(x, y), F.array_except(y, x)
    join = lambda *parts: F.array_join(F.concat(*parts), " ")
    common, ra, rb = join(both), join(only_a), join(only_b)
    wa, wb = join(both, only_a), join(both, only_b)
    lead = F.when(F.size(both) > 0, F.greatest(_prefix(common, wa), _prefix(common, wb))).otherwise(F.lit(0.0))
    best = F.greatest(lead, _rest(common, ra, rb, F.size(both) > 0))
    subset = (F.size(both) > 0) & ((F.size(only_a) == 0) | (F.size(only_b) == 0))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).when(subset, F.lit(1.0)).otherwise(best)


def _prefix(short: Column, whole: Column) -> Column:
    """Indel of a string with one that begins with it: the common subsequence is the shorter string."""
    return F.lit(2.0) * F.length(short) / (F.length(short) + F.length(whole))


def _rest(common: Column, ra: Column, rb: Column, shared: Column) -> Column:
    """Indel of common + ' ' + rest on both sides: only the rests need aligning."""
    head = F.when(shared, F.length(common) + 1).otherwise(0)
    return F.lit(2.0) * (head + lcs(ra, rb)) / (2 * head + F.length(ra) + F.length(rb))
