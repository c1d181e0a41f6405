"""Approximate nearest neighbours: an inverted file of coarse centroids over product-quantised residuals.

Centroids and codebooks are fitted on a bounded sample; every vector is indexed under its nearest centroid with the
codes of its residual and the length of its quantisation error. Lists are laid out in shards of bounded size (a long
list is dealt over several), and a block of queries meets the shards that hold lists it probes, each a packed row. There an asymmetric
distance table per query estimates the inner product of every row of the probed lists; the best rows are scored
exactly, and so is every other row whose estimate plus its error could still reach the k-th of them, so nothing that is
probed is missed. How many lists are probed is learned: a few queries are answered exactly over all rows, and as many
lists are taken as hold the wanted share of those answers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches
from .vectors import matrix, read, sample

SHARD = 8192
QUERIES = 4096
FIRST = 64


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = 0.5 * (centres * centres).sum(axis=1)
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = (x[at : at + 4096] @ centres.T - half).argmax(axis=1)
    return out


def kmeans(x: np.ndarray, count: int, rounds: int, seed: int) -> np.ndarray:
    distinct = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    centres = distinct[np.sort(rng.choice(len(distinct), min(count, len(distinct)), replace=False))].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        for d in range(x.shape[1]):
            sums[:, d] = np.bincount(own, weights=x[:, d], minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


class Index:
    """The fitted parts: coarse centroids, and one codebook of at most 256 entries for each run of dimensions."""

    def __init__(self, x: np.ndarray, lists: int, parts: int, seed: int):
        self.centres = kmeans(x, lists, 8, seed)
        self.runs = [r for r in np.array_split(np.arange(x.shape[1]), min(parts, x.shape[1]))]
        residual = x - self.centres[_nearest(x, self.centres)]
        self.books = [kmeans(residual[:, r], 256, 6, seed + 1 + i) for i, r in enumerate(self.runs)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and length of the quantisation error of each row."""
        own = _nearest(x, self.centres)
        residual = x - self.centres[own]
        codes = np.stack([_nearest(residual[:, r], b) for r, b in zip(self.runs, self.books, strict=True)], axis=1)
        rest = residual - np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], axis=1)
        return own, codes.astype(np.uint8), np.sqrt((rest * rest).sum(axis=1))

    def estimate(self, q: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Inner products of queries with rows, from the centroids and the queries' tables of codebook products."""
        out = (q @ self.centres.T)[:, lists]
        for i, (r, b) in enumerate(zip(self.runs, self.books, strict=True)):
            out += (q[:, r] @ b.T)[:, codes[:, i]]
        return out


def _pack_rows(group: pd.DataFrame) -> pd.DataFrame:
    """A shard of at most about SHARD rows as one row of arrays, by id."""
    rows = group.sort_values("id")
    flat = lambda c, kind: rows[c].to_numpy().astype(kind).tobytes()
    return pd.DataFrame({"shard": rows["shard"].iloc[:1], "ids": [flat("id", "<i8")], "lists": [flat("list", "<i4")], "err": [flat("err", "<f8")], "x": [b"".join(rows["vec"])], "codes": [b"".join(rows["codes"])]})


def _pack_queries(group: pd.DataFrame) -> pd.DataFrame:
    """At most about QUERIES queries of a shard as one row of arrays."""
    probes = [np.asarray(p, "<i4") for p in group["probes"]]
    counts = np.array([len(p) for p in probes], "<i4")
    return pd.DataFrame({"shard": group["shard"].iloc[:1], "own": [group["id"].to_numpy().astype("<i8").tobytes()], "q": [b"".join(group["vec"])], "many": [counts.tobytes()], "probes": [np.concatenate(probes).tobytes()]})


def _search(index: Index, dim: int, k: int):
    """The k best rows of a shard for each query of a block, for rows that hold one of each."""

    def one(row: dict) -> list[tuple]:
        ids, lists, err = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["lists"], "<i4"), np.frombuffer(row["err"], "<f8")
        x, codes = np.frombuffer(row["x"], "<f8").reshape(-1, dim), np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1)
        asked, every, many = np.frombuffer(row["own"], "<i8"), np.frombuffer(row["q"], "<f8").reshape(-1, dim), np.frombuffer(row["many"], "<i4")
        whose, probes = np.repeat(np.arange(len(many)), many), np.frombuffer(row["probes"], "<i4")
        found = []
        for at in range(0, len(asked), 32):
            q, own = every[at : at + 32], asked[at : at + 32]
            inside = (whose >= at) & (whose < at + 32)
            probed = np.zeros((len(q), len(index.centres)), bool)
            probed[whose[inside] - at, probes[inside]] = True
            guess = index.estimate(q, lists, codes)
            guess[~probed[:, lists] | (ids[None, :] == own[:, None])] = -np.inf
            reach = guess + np.sqrt((q * q).sum(axis=1))[:, None] * err * (1 + 1e-9) + 1e-9
            for i in range(len(q)):
                open_ = np.flatnonzero(guess[i] > -np.inf)
                if not len(open_):
                    continue
                best = open_ if len(open_) <= FIRST else open_[np.argpartition(-guess[i, open_], FIRST - 1)[:FIRST]]
                score = (x[best] * q[i]).sum(axis=1)
                if len(best) < len(open_):
                    bar = np.partition(score, len(score) - k)[len(score) - k] if len(score) >= k else -np.inf
                    more = np.setdiff1d(open_[reach[i, open_] >= bar], best)
                    best, score = np.append(best, more), np.append(score, (x[more] * q[i]).sum(axis=1))
                top = np.lexsort((ids[best], -score))[:k]
                found.append((np.full(len(top), own[i]), ids[best[top]], score[top]))
        return found

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                found = one(batch.slice(at, 1).to_pylist()[0])
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["query_id", "vec_id", "score"])

    return run


def _probes(index: Index, rows: DataFrame, asked: DataFrame, dim: int, k: int, recall: float, probe_on: int, seed: int) -> int:
    """How many lists, nearest first, hold `recall` of the true neighbours of a bounded sample of queries."""
    some = asked.orderBy(F.xxhash64(F.lit(seed + 7), "id"), "id").limit(probe_on).collect()
    if not some:
        return 1
    ids, q = np.array([r["id"] for r in some]), matrix([bytes(r["vec"]) for r in some], dim)

    def best(batches):
        for batch in batches:
            if batch.num_rows:
                own, lists = np.asarray(batch.column("id")), np.asarray(batch.column("list"))
                score = q @ matrix(batch.column("vec"), dim).T
                score[ids[:, None] == own[None, :]] = -np.inf
                top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                which = np.repeat(np.arange(len(ids)), top.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(lists[top.ravel()]), pa.array(own[top.ravel()]), pa.array(score[which, top.ravel()])], names=["q", "list", "id", "score"])

    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc("id"))
    # probe_on * k rows
    true = rows.mapInArrow(best, "q long, list int, id long, score double").withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= k) & (F.col("score") > float("-inf"))).select("q", "list").collect()
    rank = np.argsort(np.argsort(-(q @ index.centres.T), axis=1, kind="stable"), axis=1)
    needed = np.sort([rank[r["q"], r["list"]] for r in true])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1 if len(needed) else 1


def nearest(
    vectors: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, lists: int | None = None, recall: float = 0.95, least_rows: int = 20, parts: int = 16, fit_on: int = 16_384, probe_on: int = 64, seed: int = 3
) -> DataFrame:
    """The k rows of largest inner product found for each query: (query_id, rank from 1, vec_id, score).

    `is_query` is a condition on the column `id` that tells which rows are queries; a query's own row is no candidate
    of its own. Scores are inner products of the original vectors in double precision, ties go to the smaller id.
    A query probes as many of its nearest lists as hold `recall` of the true neighbours of `probe_on` queries drawn by a
    hash, and further ones until they hold least_rows * k rows, so a small table is searched whole. Vectors that are
    null, zero, not finite, have null components or another than the commonest length take no part, nor do null ids;
    rows of a repeated id are one vector, the smallest; other columns, whatever their names, are ignored. An empty table
    gives no rows. There are about as many lists as the square root of the rows. The index is fitted on at most
    `fit_on` vectors, or four a list if that is more, and holds all of them.
    """
    usable, dim = read(vectors, id_col, vec_col)
    usable = materialise(usable)
    spark, n = usable.sparkSession, usable.count()
    if lists is None:
        lists = max(1, 1 << round(np.log2(max(n, 1) ** 0.5)))
    index = Index(sample(usable, max(fit_on, 4 * lists), dim, seed) if n else np.ones((1, dim)), lists, parts, seed)

    def assign(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                own, codes, err = index.encode(matrix(part.column("vec"), dim))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("vec"), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(err)],
                    names=["id", "vec", "list", "codes", "err"],
                )

    rows = materialise(usable.mapInArrow(assign, "id long, vec binary, list int, codes binary, err double"))
    # as many counts as there are lists: the square root of the rows
    counts = np.zeros(len(index.centres), np.int64)
    for own, c in rows.groupBy("list").count().collect():
        counts[own] = c
    first, spread = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    shard = held = 0
    for i, c in enumerate(counts.tolist()):
        if held and held + c > SHARD:
            shard, held = shard + 1, 0
        first[i], spread[i] = shard, max(1, -(-c // SHARD))
        held += c
        if c > SHARD:
            shard, held = shard + int(spread[i]), 0
    asked = usable.where(is_query)
    probes = _probes(index, rows, asked, dim, k, recall, probe_on, seed)
    layout = spark.createDataFrame(pd.DataFrame({"list": np.arange(len(counts), dtype=np.int32), "first": first, "spread": spread}))
    placed = rows.join(F.broadcast(layout), "list").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("id"), F.col("spread"))).drop("first", "spread")

    def probe(batches):
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                q = matrix(part.column("vec"), dim)
                order = np.argsort(-(q @ index.centres.T), axis=1, kind="stable")
                seen = np.cumsum(counts[order], axis=1)
                for i in range(len(q)):
                    many = max(probes, int(np.searchsorted(seen[i], least_rows * k)) + 1)
                    p = np.sort(order[i, :many])
                    home = np.repeat(first[p], spread[p])
                    home = np.unique(home + np.arange(len(home)) - np.repeat(np.cumsum(spread[p]) - spread[p], spread[p]))
                    out += [(int(s), part.column("id")[i].as_py(), part.column("vec")[i].as_py(), p.astype(np.int32).tolist()) for s in home]
            for at in range(0, len(out), 10_000):
                some = list(zip(*out[at : at + 10_000], strict=True))
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(some, kinds, strict=True)], names=["shard", "id", "vec", "probes"])

    blocks = max(1, -(-asked.count() // QUERIES))
    asked = asked.mapInArrow(probe, "shard long, id long, vec binary, probes array<int>").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    # shards and blocks of queries meet as packed rows: each is shuffled once, however many of the others it meets
    packed = placed.groupBy("shard").applyInPandas(_pack_rows, "shard long, ids binary, lists binary, err binary, x binary, codes binary")
    asking = asked.groupBy("shard", "block").applyInPandas(_pack_queries, "shard long, own binary, q binary, many binary, probes binary")
    small_batches(spark)
    found = asking.join(packed, "shard").mapInArrow(_search(index, dim, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
