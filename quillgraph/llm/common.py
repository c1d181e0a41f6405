"""Shared plumbing: cutting lineage, word dictionaries of Arrow columns, components of a link graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.written import discard, materialise, shared_dir

__all__ = ["components", "discard", "join_counted", "materialise", "shared_dir", "slices", "small_batches", "words"]

SLICE_BYTES = 16 << 20


def small_batches(spark: SparkSession, rows: int = 500, size: int = 4 << 20) -> None:
    """Let the session hand whole texts to Python in batches of few rows: a batch of the usual 10,000 rows of text is
    held by the JVM and by the worker at once. Settings that are lower already stay.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key).lower().rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


HOT_SHARE = 1000
EDGES_PER_TASK = 200_000
#: Rows of a few dozen bytes that a broadcast may have; beyond it another way takes its place.
BROADCAST_ROWS = 500_000
#: Rows that join_counted() broadcasts: the driver holds them collected, hashed and in blocks, several times their size.
HASHED_ROWS = 100_000


def join_counted(left: DataFrame, right: DataFrame, key: str, n: str, total: int, rows: int) -> DataFrame:
    """left joined to right, a written table of at most `rows` rows, one for each key, which has in `n` the number of
    rows of left with that key; `n` is left out of the result.

    A table of at most HASHED_ROWS is broadcast. Of a larger one, the keys with more than one in HOT_SHARE of the
    `total` rows, fewer than HOT_SHARE keys whatever the input, are broadcast, so that no task gets all rows of one, and
    the others are shuffled.
    """
    if rows <= HASHED_ROWS:
        return left.join(F.broadcast(right.drop(n)), key)
    hot = F.broadcast(right.where(F.col(n) * HOT_SHARE > total).drop(n))
    cold = right.where(F.col(n) * HOT_SHARE <= total).drop(n)
    return left.join(hot, key).unionByName(left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a piece holds at most `limit` bytes of text (a single longer text stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
        start = total = 0
        for i, n in enumerate(sizes.tolist()):
            if total + n > limit and i > start:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def words(texts: pa.Array, lower: bool = False, letters: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Split on ASCII white space: (code of each word, dictionary of distinct words, offsets of each text in the codes).

    With `lower` A-Z become a-z; with `letters` words are the runs of letters of the lower-cased text.
    """
    # a copy without an offset: some Arrow kernels misread slices
    texts = pc.fill_null(texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()), "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.split_pattern_regex(pc.utf8_lower(texts), r"\P{L}+") if letters else pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    counts = np.asarray(pc.list_value_length(lists), dtype=np.int64)
    full = np.asarray(pc.binary_length(flat), dtype=np.int64) > 0
    if not full.all():
        owner = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(owner[full], minlength=len(counts))
        flat = flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    offsets = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=offsets[1:])
    return np.asarray(coded.indices, dtype=np.int64), coded.dictionary, offsets


def _shape(edges: DataFrame) -> tuple[int, bool]:
    """The number of distinct links, and whether they are stars: each larger end has one link and is no smaller end, so
    the smaller ends are the components. Neither of the steps below changes stars, and one of them changes all else."""
    ends = edges.select(F.inline(F.array(F.struct("u", F.lit(1).alias("up")), F.struct(F.col("v").alias("u"), F.lit(0).alias("up")))))
    by_end = ends.groupBy("u").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    links, others = by_end.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if((F.col("up") > 1) | (F.col("up") == 1) & (F.col("n") > 1))).first()
    return links, not others


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links as (node, component): each linked node and the smallest node it reaches.

    Alternates large-star and small-star steps; every step is an aggregation and an equi-join in which the centres of
    large stars are broadcast, a bounded number of them, so no neighbourhood is gathered in one place. Self-links and
    repeats are ignored; nodes without a link to another node are absent from the result.
    """
    # few links need few tasks, however many partitions a shuffle has
    parts = max(1, links.count() // EDGES_PER_TASK)
    keep = lambda df: materialise(df.coalesce(parts))
    edges = keep(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    n, done = _shape(edges)
    while not done:
        small = n <= HASHED_ROWS
        both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        low = low if small else keep(low)
        # no more rows than links, repeats among them; the few of a small graph are derived twice rather than written
        large = join_counted(both, low, "u", "n", 2 * n, 2 * n if not small else n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large if small else keep(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        least = least if small else keep(least)
        stars = least.select("u", F.col("m").alias("v"))
        old = (edges, low, large, least)
        edges = keep(join_counted(large, least, "u", "n", n, n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(stars).distinct())
        discard(*old)
        n, done = _shape(edges)
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = keep(stars.union(stars.select(F.col("component").alias("node"), "component")).distinct())
    discard(edges)
    return out
