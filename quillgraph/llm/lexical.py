"""Ranked lexical search over shards of documents.

Queries are taken in blocks of bounded size, whose terms and items are broadcast. One pass over the documents writes
shards: compressed rows of postings (term to documents and occurrences) of the block's terms, and the documents' lengths.
Totals over all shards give the weights of terms, which are at most as many as the block has. Each shard then turns its
postings into integer impacts once, and every item adds up those of its terms, one term after the other, in a dense
array over the shard's documents. The best of a shard, equal scores by smaller id, are merged in two steps.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, slices, small_batches, words

SLICE = 4 << 20
BLOCK_BYTES = 16 << 20
SHARD_DOCS, SHARD_POSTINGS = 1 << 15, 1 << 20
SALTS = 32
_SHARD = "ids array<long>, lengths array<long>, terms array<int>, holders array<long>, at array<int>, times array<long>, n_docs long, n_words long"
#: ASCII letters and digits and all bytes of other characters belong to terms; capitals become small.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """words() of texts whose other ASCII characters are blank: (code of each term, distinct terms, offsets)."""
    whole = pc.fill_null(texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()), "")
    _, offsets, data = whole.buffers()
    plain = pa.py_buffer((data.to_pybytes() if data else b"").translate(_TABLE))
    return words(pa.Array.from_buffers(pa.large_string(), len(whole), [None, offsets, plain]))


class _Shard:
    """Documents with a term of the block, gathered until there are enough for a row."""

    def __init__(self):
        self.ids, self.lengths, self.at, self.term, self.times = [], [], [], [], []
        self.docs = self.postings = self.n_docs = self.n_words = 0

    def add(self, ids: pa.Array, codes: np.ndarray, offsets: np.ndarray, known: np.ndarray, size: int) -> None:
        n = np.diff(offsets)
        self.n_docs += int((n > 0).sum())
        self.n_words += int(n.sum())
        term, owner = known[codes], np.repeat(np.arange(len(n)), n)
        found = term >= 0
        pairs, times = np.unique(owner[found] * size + term[found], return_counts=True)
        owner, term = np.divmod(pairs, size) if size else (pairs, pairs)
        kept, at = np.unique(owner, return_inverse=True)
        self.ids.append(ids.take(pa.array(kept)))
        self.lengths.append(n[kept])
        self.at.append(at + self.docs)
        self.term.append(term)
        self.times.append(times)
        self.docs += len(kept)
        self.postings += len(pairs)

    def row(self) -> pa.RecordBatch:
        ids = pa.chunked_array(self.ids, pa.int64()).combine_chunks() if self.ids else pa.array([], pa.int64())
        order = np.asarray(pc.sort_indices(ids), dtype=np.int64)  # nulls last
        place = np.empty(self.docs, np.int64)
        place[order] = np.arange(self.docs)
        lengths, at, term, times = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.lengths, self.at, self.term, self.times))
        by = np.lexsort((place[at], term))
        distinct, holders = np.unique(term, return_counts=True)
        cols = [ids.take(pa.array(order)), lengths[order], distinct.astype(np.int32), holders, place[at][by].astype(np.int32), times[by]]
        whole = lambda c: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c if isinstance(c, pa.Array) else pa.array(c))
        counts = [pa.array([x], pa.int64()) for x in (self.n_docs, self.n_words)]
        return pa.RecordBatch.from_arrays([*map(whole, cols), *counts], names=[c.split()[0] for c in _SHARD.split(", ")])


def shards(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """Rows of postings of the vocabulary's terms over docs (id, text), a row for each shard."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        own, vocab = _Shard(), shared.value
        for batch in slices(batches, "text", SLICE):
            codes, distinct, offsets = terms(batch.column("text"))
            known = pc.fill_null(pc.index_in(distinct, vocab), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            own.add(batch.column("id"), codes, offsets, known, len(vocab))
            if own.docs >= SHARD_DOCS or own.postings >= SHARD_POSTINGS:
                yield own.row()
                own = _Shard()
        if own.n_docs:
            yield own.row()

    return docs.mapInArrow(run, _SHARD)


def top(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest positive scores, equal ones by place; all positive ones, if fewer. In no order."""
    if k < len(scores):
        least = scores[np.argpartition(scores, len(scores) - k)[len(scores) - k :]].min()
        if least > 0:
            above = np.flatnonzero(scores > least)
            return np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])
    return np.flatnonzero(scores > 0)


def _search(index: DataFrame, items: list[np.ndarray], item_ids: list, weights: np.ndarray, n_docs: int, n_words: int, k: int, first: int) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast((items, item_ids, weights))

    def run(batches):
        wanted, names, w = shared.value
        for batch in batches:
            for r in range(batch.num_rows):
                ids = batch.column("ids")[r].values
                lengths, distinct, holders, at, times = (batch.column(c)[r].values.to_numpy() for c in ("lengths", "terms", "holders", "at", "times"))
                norm = 100 - 90 + (90 * lengths * n_docs) // n_words
                impact = np.repeat(w[distinct], holders) * ((1_000_000_000 * times) // (1000 * times + 8 * norm[at]))
                row = np.full(len(w), -1, np.int64)
                row[distinct] = np.arange(len(distinct))
                sums, bounds = np.zeros(len(ids), np.int64), [0, *np.cumsum(holders).tolist()]
                who, where, score = [], [], []
                for i, own in enumerate(wanted):
                    sums[:] = 0
                    for t in row[own].tolist():
                        if t >= 0:
                            sums[at[bounds[t] : bounds[t + 1]]] += impact[bounds[t] : bounds[t + 1]]
                    best = top(sums, k)
                    who.append(np.full(len(best), i))
                    where.append(best)
                    score.append(sums[best])
                who, where, score = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (who, where, score))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(who + first), pa.array([names[i] for i in who.tolist()], pa.int64()), ids.take(pa.array(where)), pa.array(score)], names=["item", "item_id", "doc_id", "score"]
                )

    return index.select("ids", "lengths", "terms", "holders", "at", "times").mapInArrow(run, "item long, item_id long, doc_id long, score long")


def rank_documents(items: DataFrame, docs: DataFrame, k: int = 10, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for every row of items.

    Terms are runs of ASCII letters and digits and of all other characters beyond ASCII; only A-Z are lower-cased. With N
    documents that have a term, L terms in all, n in a document, df documents that hold a term and tf occurrences, the
    score sums floor(1000 * ln((2 N + 2) / (2 df + 1))) * (10^9 tf div (1000 tf + 8 (10 + 90 n N div L))) over an item's
    distinct terms. Ranks count from 1, equal scores by ascending id, rows without an id after all others.

    Null, empty and blank texts have no term: such an item has no rows, such a document is in no result and no total. Rows
    that repeat, of items and of documents, each count. Very long texts are read whole, other columns, whatever their
    names, are ignored, and an empty table on either side gives no rows. Items are taken in blocks of about `block_bytes`
    of text, each a pass over the documents: only such a block and its terms are ever on the driver or broadcast.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("octet_length(text) > 0")
    blocks = 1 + (asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes
    found = []
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64(F.lit(12), "item_id", "text"), F.lit(blocks)) == block).toArrow()
        codes, distinct, offsets = terms(mine.column("text").combine_chunks()) if mine.num_rows else (np.zeros(0, np.int64), pa.array([], pa.large_string()), np.zeros(1, np.int64))
        if not len(codes):
            continue
        own = [np.unique(codes[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        index = materialise(shards(base, distinct))
        n_docs, n_words = index.agg(F.sum("n_docs"), F.sum("n_words")).first()
        if not n_docs:
            continue
        holding = index.select(F.explode(F.arrays_zip("terms", "holders")).alias("x")).select("x.terms", "x.holders")
        weights = np.zeros(len(distinct), np.int64)
        for term, df in holding.groupBy("terms").agg(F.sum("holders")).collect():  # as many rows as the block has terms
            weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        found.append(_search(index, own, mine.column("item_id").to_pylist(), weights, n_docs, n_words, k, block << 32))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    every = reduce(DataFrame.union, found)
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = Window.partitionBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).orderBy(*best)
    near = every.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k)
    out = near.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best))).where(F.col("rank") <= k)
    return out.select("item_id", "rank", "doc_id", "score")
