"""Harmonic packing of token sequences.

Each document is tokenised, ends with one closing id and is cut into pieces whose lengths fall into reciprocal-capacity
classes: class k holds lengths in (C/(k+1), C/k], and every bin of class k takes k pieces. Cuts are made at whole
capacities and at the largest C/k that still fits, down to `tail`, so these pieces fill the bins of their class but for
a division's remainder; what is left over, under `tail` ids, goes as it is to the class of its length. So a bin wastes
less than `tail` ids. Workers number their pieces by class
independently: the count of pieces a worker has of each class gives its first bin and slot, so no bin needs two passes
and nothing but (workers x classes) counts is shared. The few pieces that do not fill a last bin of their class, a number that the capacity bounds, share bins by best fit.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, slices, small_batches, words

#: Fixed values of the vocabulary's pre-tokenizer: contractions, runs of letters, single digits, runs of others.
LEAST_WORKERS, DOCS_A_WORKER = 256, 20_000
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Within these characters Unicode composition changes nothing and lower-casing goes character by character.
PLAIN = regex.compile(r"[\x21-\x7e¡-į]+")
#: A run of letters among them, with at most one mark after it.
SIMPLE = r"^[A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}]+[.,;:!?]?$"
MARKS = ".,;:!?"
KNOWN = 1_000_000
SLICE = 8 << 20


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions starts[0], starts[0] + 1, ... of runs of the given sizes, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0, dtype=np.int32) + np.repeat((starts - (ends - sizes)).astype(np.int32), sizes)


class WordTokenizer:
    """Ids of a word-end BPE vocabulary; equals encoding each text whole, but works on distinct words.

    Tokens never span white space, so a text's ids are those of its words. The ids of the lower-cased pieces of words
    are kept, in arrays, up to a bounded number of pieces; unusual words are encoded by the library as they stand.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        vocab = self.lib.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known, self.bank, self.sizes = pa.array([], pa.large_string()), np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def _raw(self, text: str) -> np.ndarray:
        return np.array(self.lib.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")  # without offsets

    def _learn(self, new: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of lower-cased pieces and their counts, many in one call: a piece ends where a word-end id is."""
        ids, sizes = [], []
        for at in range(0, len(new), 4000):
            some = new[at : at + 4000]
            raw = self._raw(" ".join(some))
            stops = np.flatnonzero(self.ends[raw]) + 1
            if len(stops) == len(some):
                ids.append(raw), sizes.append(np.diff(stops, prepend=0))
            else:
                each = [self._raw(w) for w in some]
                ids.extend(each), sizes.append(np.array([len(x) for x in each], np.int64))
        return ids, sizes

    @staticmethod
    def _split(word: str) -> list[str] | None:
        """The pieces of a word, or None if only the library can tell."""
        if not (word.isprintable() if word.isascii() else PLAIN.fullmatch(word)) or "<|" in word:
            return None
        return PIECES.findall(word.lower())

    def _lookup(self, pieces: pa.Array) -> np.ndarray:
        """Where in the bank each of the distinct pieces is; new ones are learned."""
        if len(self.known) > KNOWN:
            self._forget()
        at = np.asarray(pc.fill_null(pc.index_in(pieces, value_set=self.known), -1), np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = pieces.take(pa.array(new))
            ids, sizes = self._learn(fresh.to_pylist())
            at[new] = len(self.known) + np.arange(len(new))
            self.known = pa.concat_arrays([self.known, fresh])
            self.bank, self.sizes = np.concatenate([self.bank, *ids]), np.concatenate([self.sizes, *sizes])
        return at

    def encode_words(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words one after the other, and how many each has."""
        easy = np.asarray(pc.match_substring_regex(distinct, SIMPLE))
        simple, odd = np.flatnonzero(easy), np.flatnonzero(~easy)
        low = pc.utf8_lower(distinct.take(pa.array(simple)))
        stems = pc.ascii_rtrim(low, MARKS)
        marked = np.asarray(pc.binary_length(low)) > np.asarray(pc.binary_length(stems))
        mark = pc.utf8_slice_codeunits(low.filter(pa.array(marked)), -1)
        others = [self._split(w) for w in distinct.take(pa.array(odd)).to_pylist()]
        loose = [p for ps in others if ps for p in ps]
        coded = pa.concat_arrays([stems, mark, pa.array(loose, pa.large_string())]).dictionary_encode()
        place = self._lookup(coded.dictionary)[np.asarray(coded.indices, np.int64)]
        # the pieces of every word in order: stem, then mark, or those of an odd word
        owner = np.concatenate([simple, simple[marked], np.repeat(odd, [len(ps or ()) for ps in others])])
        order = np.argsort(owner, kind="stable")
        place, owner = place[order], owner[order]
        starts = np.cumsum(self.sizes) - self.sizes
        many = self.sizes[place]
        ids = self.bank[_spread(starts[place], many)]
        sizes = np.bincount(owner, weights=many, minlength=len(distinct)).astype(np.int64)
        raw = [(i, self._raw(distinct[i].as_py())) for i, ps in zip(odd.tolist(), others, strict=True) if ps is None]
        if raw:
            first = np.cumsum(sizes) - sizes
            ids = np.insert(ids, np.repeat([first[i] for i, _ in raw], [len(x) for _, x in raw]), np.concatenate([x for _, x in raw]))
            sizes[[i for i, _ in raw]] = [len(x) for _, x in raw]
        return ids, sizes

    def encode(self, texts: pa.Array, closing: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, each text followed by the closing id, and the offsets of the texts."""
        codes, distinct, offsets = words(texts)
        bank, sizes = self.encode_words(distinct)
        bank, sizes = np.append(bank, np.uint32(closing)).astype("<u4"), np.append(sizes, 1)
        starts = np.cumsum(sizes) - sizes
        n = len(offsets) - 1
        sequence = np.full(len(codes) + n, len(sizes) - 1, np.int32)
        at = offsets[1:] + np.arange(n)
        body = np.ones(len(sequence), bool)
        body[at] = False
        sequence[body] = codes
        each = sizes[sequence]
        return bank[_spread(starts[sequence], each)], np.concatenate([[0], np.cumsum(each)[at]]).astype(np.int64)


_LOADED: dict[str, WordTokenizer] = {}


def cuts(lengths: np.ndarray, capacity: int, tail: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, length) of each piece, in order: whole capacities, then the largest C/k that fits and so on down to
    `tail`, then the rest.
    """
    sizes = [capacity // k for k in range(2, capacity // tail + 1)]
    many = np.zeros((len(lengths), len(sizes) + 2), np.int64)
    size = np.tile(np.array([capacity, *sizes, 0]), (len(lengths), 1))
    many[:, 0], rest = lengths // capacity, lengths % capacity
    for k, s in enumerate(sizes):
        many[:, k + 1] = rest >= s
        rest = rest - s * many[:, k + 1]
    many[:, -1], size[:, -1] = rest > 0, rest
    many = many.ravel()
    return np.repeat(np.arange(len(lengths)).repeat(len(sizes) + 2), many), np.repeat(size.ravel(), many)


def _cut(tokenizer: str, capacity: int, tail: int, closing: int, with_ids: bool):
    def run(batches):
        model = _LOADED.get(tokenizer) or _LOADED.setdefault(tokenizer, WordTokenizer(tokenizer))
        for batch in slices(batches, "text", SLICE):
            ids, offsets = model.encode(batch.column("text"), closing)
            row, length = cuts(np.diff(offsets), capacity, tail)
            begin = np.cumsum(length) - length
            bounds, memory = np.append(begin, len(ids)).tolist(), memoryview(ids).cast("B")
            crc = [zlib.crc32(memory[4 * i : 4 * j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
            where = pa.array(row)
            cols = [
                batch.column("id").take(where), batch.column("row").take(where), pa.array(begin - offsets[row]), pa.array(length),
                pa.array(crc, pa.int64()), pa.array(np.diff(offsets)[row]),
            ]
            names = ["id", "row", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int64))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, tail: int = 64, closing: int = 1, workers: int | None = None, with_ids: bool = False
) -> DataFrame:
    """Pack documents into sequences of at most `capacity` ids, one row a piece.

    Returns id_col, start, length, ids_crc32, doc_tokens, sequence_id and offset (and `ids`, if asked for). A null or
    empty text is one piece that holds the closing id. Each row of docs is a document of its own, repeated rows and
    null ids too; very long texts are cut into as many pieces as they need; other columns, whatever their names, are
    ignored. Pieces of equal length are placed in the order of id and start. Sequence ids are unique, not gapless. An
    empty table gives no rows. There is a worker for every DOCS_A_WORKER documents, LEAST_WORKERS at least.
    """
    workers = workers or max(LEAST_WORKERS, docs.count() // DOCS_A_WORKER)
    small_batches(docs.sparkSession, rows=2000, size=8 << 20)
    kinds = "id long, row long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<long>" if with_ids else "")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col)).alias("row"))
    pieces = base.mapInArrow(_cut(tokenizer, capacity, tail, closing, with_ids), kinds)
    pieces = materialise(
        pieces.withColumn("class", F.floor(F.lit(capacity) / F.col("length")).cast("long"))
        .withColumn("worker", F.pmod(F.xxhash64("row", "start"), F.lit(workers)).cast("int"))
        .drop("row")
    )
    counts = pieces.groupBy("class", "worker").agg(F.count("*").alias("n"))
    # at most workers x (quotients of the capacity) rows: a window of one row for each worker
    before, all_of = Window.partitionBy("class").orderBy("worker"), Window.partitionBy("class")
    first = counts.select("class", "worker", (F.sum("n").over(before) - F.col("n")).alias("first"), F.sum("n").over(all_of).alias("total"))
    own = Window.partitionBy("class", "worker").orderBy("id", "start", "ids_crc32")
    placed = (
        pieces.join(first, ["class", "worker"])
        .withColumn("place", F.col("first") + F.row_number().over(own) - 1)
        .withColumn("bin", F.floor(F.col("place") / F.col("class")))
        .withColumn("full", (F.col("bin") + 1) * F.col("class") <= F.col("total"))
        .drop("worker", "first", "total")
    )
    inside = Window.partitionBy("class", "bin").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = placed.where("full").withColumn("offset", F.sum("length").over(inside) - F.col("length"))
    full = full.withColumn("sequence_id", F.col("bin") * (capacity + 1) + F.col("class"))
    # the last bin of each class, fewer than `class` pieces of it: about 10,000 pieces in all at most, whatever the input
    rest = placed.where("not full").groupBy().applyInPandas(_best_fit(capacity), full.select(placed.columns + ["offset", "sequence_id"]).schema)
    return full.select(rest.columns).union(rest).select(
        F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", F.col("sequence_id").cast("long").alias("sequence_id"),
        F.col("offset").cast("long").alias("offset"), *(["ids"] if with_ids else []),
    )


def _best_fit(capacity: int):
    """Pieces that fill no bin of their class share bins, longest first; these bins have the sequence ids 0, -1, ..."""

    def run(group):
        group = group.sort_values(["length", "class", "place"], ascending=[False, True, True])
        free: list[int] = []
        bins, offsets = [], []
        for n in group["length"]:
            fits = [(room, i) for i, room in enumerate(free) if room >= n]
            room, i = min(fits) if fits else (capacity, len(free))
            if not fits:
                free.append(capacity)
            bins.append(-i), offsets.append(capacity - room)
            free[i] = room - int(n)
        return group.assign(offset=offsets, sequence_id=bins)

    return run
