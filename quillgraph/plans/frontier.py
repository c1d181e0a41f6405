"""Walks of variable length: trails (no relationship twice) of lo to hi hops, hop by hop.

The state of a trail is (start, start_label, at, at_label, edges). A few hops are one lazy plan. More are an iteration:
the relationships are written once, in buckets by the node they leave, so no hop shuffles them again; every hop reads the table of the hop before and writes its own, and the iteration
ends with the first empty one, so the work is one join a hop and grows with the trails there are, not with hi. With both
ends known, trails are grown from both, half the hops each, and meet: one of n hops is its first (n + 1) / 2, rounded
down, and the rest, whose relationships must be others.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .written import discard, materialise, materialise_by

#: Walks of up to so many hops stay one plan.
LAZY_HOPS = 3
EDGE = ("from", "from_label", "to", "to_label", "edge")
#: The relationships that leave nodes of some labels, as EDGE columns of text, and the labels they reach; None if there are none.
Leaving = Callable[[frozenset[str]], tuple[DataFrame, frozenset[str]] | None]


def _start(starts: DataFrame) -> DataFrame:
    """Trails without a hop, from distinct (start, start_label)."""
    return starts.select("start", "start_label", F.col("start").alias("at"), F.col("start_label").alias("at_label"), F.array().cast("array<string>").alias("edges"))


def _hop(trails: DataFrame, edges: DataFrame) -> DataFrame:
    joined = trails.join(edges, ["at", "at_label"])
    fresh = joined.where(~F.array_contains("edges", F.col("edge")))
    return fresh.select("start", "start_label", F.col("to").alias("at"), F.col("to_label").alias("at_label"), F.concat("edges", F.array("edge")).alias("edges"))


def grow(starts: DataFrame, labels: frozenset[str], leaving: Leaving, hops: int, lazy: bool) -> list[DataFrame]:
    """Trails of 0, 1, ... hops, up to `hops` or as far as there are any."""
    found = [_start(starts) if lazy else materialise(_start(starts))]
    written: dict[frozenset[str], DataFrame] = {}
    for _ in range(hops):
        step = leaving(labels)
        if step is None:
            break
        edges = step[0].withColumnsRenamed({"from": "at", "from_label": "at_label"})
        if not lazy and labels not in written:
            written[labels] = materialise_by(edges, "at", "at_label")
        trails = _hop(found[-1], edges if lazy else written[labels])
        if not lazy:
            trails = materialise(trails)
            if trails.isEmpty():
                discard(trails)
                break
        found.append(trails)
        labels = step[1]
    discard(*written.values())
    return found


def one_sided(starts: DataFrame, labels: frozenset[str], leaving: Leaving, lo: int, hi: int) -> DataFrame:
    """Trails of lo to hi hops from starts, distinct (start, start_label)."""
    found = grow(starts, labels, leaving, hi, hi <= LAZY_HOPS)
    discard(*found[:lo])
    return reduce(DataFrame.union, found[lo:]) if found[lo:] else _none(found[0])


def _none(like: DataFrame) -> DataFrame:
    return like.sparkSession.createDataFrame([], like.schema)


def two_sided(starts: DataFrame, labels: frozenset[str], leaving: Leaving, ends: DataFrame, end_labels: frozenset[str], arriving: Leaving, lo: int, hi: int) -> DataFrame:
    """Trails of lo to hi hops from starts to ends, both distinct (start, start_label), by halves that meet."""
    lazy = hi <= LAZY_HOPS
    first = grow(starts, labels, leaving, (hi + 1) // 2, lazy)
    second = grow(ends, end_labels, arriving, hi // 2, lazy)
    parts = []
    for n in range(lo, hi + 1):
        a, b = (n + 1) // 2, n // 2
        if a >= len(first) or b >= len(second):
            break
        back = second[b].select(F.col("start").alias("end"), F.col("start_label").alias("end_label"), "at", "at_label", F.reverse("edges").alias("rest"))
        met = first[a].join(back, ["at", "at_label"]).where(~F.arrays_overlap("edges", "rest"))
        parts.append(met.select("start", "start_label", F.col("end").alias("at"), F.col("end_label").alias("at_label"), F.concat("edges", "rest").alias("edges")))
    return reduce(DataFrame.union, parts) if parts else _none(_start(starts))
