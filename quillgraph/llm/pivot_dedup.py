"""Embedding near-duplicates by a pivot-permutation index.

A bounded sample gives reference vectors (pivots). Every vector is described by its nearest pivots, and stands in the
inverted list of each of them. Two vectors are compared if they share enough pivots; a pair is the business of the
list of its first shared pivot only, so it is verified once, in double precision. A list that is too long for a task is
split by a second shared pivot; what is still too long, a crowd of vectors near the same pivots, is dealt into block
pairs of bounded size. A block sends on each vector's number of links and a spanning set of its links, not its pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialise
from .vectors import matrix, read, sample, unit

BLOCK = 2048


def _pivots(vectors: DataFrame, count: int, dim: int, seed: int) -> np.ndarray:
    """Well separated unit vectors out of a sample of 4 * count, so that a crowd of copies gives one pivot."""
    x = unit(sample(vectors, 4 * count, dim, seed)) if count else np.zeros((0, dim))
    chosen: list[int] = []
    for i in range(len(x)):
        if len(chosen) == count:
            break
        if not chosen or (x[chosen] @ x[i]).max() < 0.9:
            chosen.append(i)
    return x[chosen] if chosen else np.eye(1, dim)


def _describe(pivots: np.ndarray, dim: int, prefix: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                near = unit(matrix(part.column("vec"), dim)) @ pivots.T
                order = np.sort(np.argsort(-near, axis=1, kind="stable")[:, :prefix], axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1) * order.shape[1], pa.int32()), pa.array(order.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("copies"), part.column("vec"), lists], names=["id", "copies", "vec", "lists"])

    return run


def _masks(lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pivots that several rows have, in order, and each row's as a bit mask over them."""
    several, n = np.unique(lists, return_counts=True)
    several = several[n > 1]
    at = np.minimum(np.searchsorted(several, lists), max(len(several) - 1, 0))
    masks = np.zeros((len(lists), max(1, -(-len(several) // 64))), np.uint64)
    if len(several):
        hit = several[at] == lists
        rows = np.arange(len(lists))
        for k in range(lists.shape[1]):
            bit = np.where(hit[:, k], np.uint64(1) << (at[:, k] % 64).astype(np.uint64), np.uint64(0))
            masks[rows, at[:, k] // 64] |= bit
    return several, masks


def _lowest(words: np.ndarray) -> np.ndarray:
    """Index of the lowest set bit of each row of 64-bit words, which is cleared."""
    rows = np.arange(len(words))
    word = (words != 0).argmax(axis=1)
    value = words[rows, word]
    low = value & (~value + np.uint64(1))
    words[rows, word] ^= low
    return word * 64 + np.bitwise_count(low - np.uint64(1)).astype(np.int64)


def _compare(dim: int, threshold: float, shared: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        ids, copies, blocks = group["id"].to_numpy(), group["copies"].to_numpy(), group["block"].to_numpy()
        lo, hi, pivot, second = (int(group[c].iloc[0]) for c in ("lo", "hi", "pivot", "second"))
        x = unit(matrix(group["vec"], dim))
        several, masks = _masks(np.stack(group["lists"].to_numpy()))
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for i in range(0, len(ids), 64):
            mine, rest = slice(i, i + 64), slice(i + 1, None)
            both = np.zeros((len(masks[mine]), len(masks[rest])), np.uint8)
            for w in range(masks.shape[1]):
                both += np.bitwise_count(masks[mine, None, w] & masks[None, rest, w])
            ok = both >= shared
            if lo != hi:  # a pair belongs to the one block pair that both of its blocks name
                ok &= blocks[mine, None] != blocks[None, rest]
            a, b = np.nonzero(ok)
            a, b = a + i, b + i + 1
            keep = b > a
            a, b = a[keep], b[keep]
            common = masks[a] & masks[b]
            keep = several[_lowest(common)] == pivot if len(a) else keep[:0]
            if second >= 0 and len(a):
                keep &= several[_lowest(common)] == second
            a, b = a[keep], b[keep]
            keep = np.zeros(len(a), bool)
            for at in range(0, len(a), 1 << 16):
                part = slice(at, at + (1 << 16))
                keep[part] = (x[a[part]] * x[b[part]]).sum(axis=1) >= threshold
            a, b = a[keep], b[keep]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            for v in np.unique(a):
                old = np.unique(np.append(root[b[a == v]], root[v]))
                if len(old) > 1:
                    root[np.isin(root, old)] = old[0]
        at = np.flatnonzero(links)
        return pd.DataFrame({"id": ids[at], "links": links[at], "root": ids[root[at]]})

    return run


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, pivots: int | None = None, prefix: int = 10, shared: int = 2, seed: int = 1
) -> DataFrame:
    """Link vectors whose cosine is at least `threshold`; (id_col, n_links, component_id, kept), one row per id.

    n_links counts the other vectors linked directly, component_id is the smallest id reachable by links (itself
    included) and kept says whether that is the vector's own. No pair under the threshold is linked; a pair over it is
    found if the two share `shared` of their `prefix` nearest pivots. The number of pivots grows with the square root
    of the vectors, so a list does too; they are fitted on a sample of at most four times as many vectors.
    Null, zero or non-finite vectors, those with null components and those of another than the commonest length link
    with nothing and keep a row. Equal vectors are compared once and counted each. Rows of a repeated id are one
    vector, the smallest; rows with a null id are left out. Of pivots equally near the first drawn counts; other
    columns, whatever their names, are ignored. An empty table gives no rows.
    """
    usable, dim = read(vectors, id_col, vec_col)
    usable = materialise(usable)
    classes = materialise(usable.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    n = classes.count()
    if pivots is None:
        pivots = max(32, 1 << round(np.log2(2 * max(n, 1) ** 0.5)))
    chosen = _pivots(classes, min(pivots, n), dim, seed)
    shared = min(shared, len(chosen))
    entries = materialise(
        classes.mapInArrow(_describe(chosen, dim, min(prefix, len(chosen))), "id long, copies long, vec binary, lists array<int>")
    )
    listed = entries.select("id", "copies", "vec", "lists", F.explode("lists").alias("pivot"))
    # one row a pivot: the square root of the vectors
    lengths = entries.select(F.explode("lists").alias("pivot")).groupBy("pivot").agg(F.count("*").alias("length"))
    if shared > 1:
        later = F.filter("lists", lambda q: q > F.col("pivot"))
        seconds = F.when(F.col("length") > BLOCK, later).otherwise(F.array(F.lit(-1)))
    else:
        seconds = F.array(F.lit(-1))
    listed = listed.join(F.broadcast(lengths), "pivot").withColumn("second", F.explode(seconds)).drop("length")
    sizes = (
        entries.select("lists", F.explode("lists").alias("pivot")).join(F.broadcast(lengths), "pivot").select("pivot", F.explode(seconds).alias("second"))
        .groupBy("pivot", "second").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")).where("parts > 1")
    )
    spread = (
        listed.join(sizes, ["pivot", "second"], "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("pivot", "second", "id", "copies", "vec", "lists", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    )
    found = materialise(
        spread.groupBy("pivot", "second", "lo", "hi").applyInPandas(_compare(dim, threshold, shared), "id long, links long, root long")
    )
    roots = components(found.select("id", "root"), "id", "root").select(F.col("node").alias("rep"), "component")
    linked = found.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    members = usable.join(classes.select("vec", F.col("id").alias("rep"), "copies"), "vec").select("id", "rep", "copies")
    members = members.join(linked, "rep", "left").join(roots, "rep", "left")
    known = members.select(
        F.col("id").alias("own"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    every = vectors.select(F.col(id_col).cast("long").alias("own")).where("own is not null").distinct().join(known, "own", "left")
    every = every.select(F.col("own").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "own").alias("component_id"))
    return every.withColumn("kept", F.col(id_col) == F.col("component_id"))
