"""Language identification by words first, backing off to shorter and shorter character n-grams.

A known word counts with its log frequency in each language. An unseen word is scored by its longest n-grams of which
at least one is known (4, 3, 2, then 1 characters, word ends marked), averaged over those known. Each word's evidence is
normalised over the languages, so seen and unseen words weigh alike, and a text's evidence is the sum over its words.

Counts are kept sparsely, by key and language, in arrays; nothing is cut from them, so any number of languages, words
and n-grams of the labelled sample can be held. A slice of texts is scored column by column, without a step in Python
for a word.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices, small_batches, words

LONGEST = 4
SMOOTH = 0.5
SLICE = 4 << 20
UNKNOWN = "und"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Grams:
    """The n-grams of words as 64-bit keys, with the words they belong to."""

    def __init__(self, some: pa.Array):
        marked = [f"<{w}>" for w in some.to_pylist()]
        self.size = np.fromiter(map(len, marked), np.int64, len(marked))
        self.first = np.cumsum(self.size) - self.size
        self.points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)

    def of(self, n: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the n-grams of the words `which`, and the position in `which` of each one's word."""
        first, size = self.first[which], self.size[which]
        if n == 1:  # single characters come without the marks
            first, size = first + 1, size - 2
        many = np.maximum(size - n + 1, 0)
        owner = np.repeat(np.arange(len(which)), many)
        at = np.arange(len(owner)) + np.repeat(first - (np.cumsum(many) - many), many)
        key = np.full(len(at), n, np.uint64)
        for k in range(n):
            key = _mixed(key + self.points[at + k] * np.uint64(0x9E3779B97F4A7C15))
        return key, owner


class Table:
    """Counts by key and language: log frequencies less their log-sum over the languages, in sparse rows.

    The log frequency of key i in language l is base[l] + value of (i, l) - rest[i]; a pair that is not stored has the
    value 0, that of a count of zero.
    """

    def __init__(self, row: np.ndarray, lang: np.ndarray, n: np.ndarray, rows: int, totals: np.ndarray):
        norm = totals + SMOOTH * (rows + 1)
        order = np.argsort(row, kind="stable")
        row, lang, n = row[order], lang[order], n[order].astype(float)
        self.starts = np.searchsorted(row, np.arange(rows + 1))
        self.lang, self.value = lang.astype(np.int32), np.log1p(n / SMOOTH).astype(np.float32)
        self.base = np.log(SMOOTH / norm)
        self.rest = np.log((SMOOTH / norm).sum() + np.bincount(row, weights=n / norm[lang], minlength=rows)).astype(np.float32)
        self.often = np.bincount(row, weights=n, minlength=rows) >= 2

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position in rows, language, value) of what is stored for `rows`."""
        first = self.starts[rows]
        many = self.starts[rows + 1] - first
        owner = np.repeat(np.arange(len(rows)), many)
        at = np.arange(len(owner)) + np.repeat(first - (np.cumsum(many) - many), many)
        return owner, self.lang[at], self.value[at]


class Model:
    """Log frequencies of known words and n-grams by language."""

    def __init__(self, langs: list[str], vocabulary: pa.Array, known: Table | None, grams: list[tuple[np.ndarray, Table] | None]):
        self.langs, self.vocabulary, self.known, self.grams = langs, vocabulary, known, grams
        self.base = np.zeros((LONGEST + 2, len(langs)))  # by what a word was found in: nothing, n-grams of n, words
        for n, found in enumerate(grams):
            if found is not None:
                self.base[n] = found[1].base
        if known is not None:
            self.base[LONGEST + 1] = known.base

    def _words(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, tuple, np.ndarray]:
        """For each word: what it was found in, what to take off, its (word, language, value) entries, known well."""
        kind, rest, often = np.zeros(len(distinct), np.int64), np.zeros(len(distinct)), np.zeros(len(distinct), bool)
        at = np.asarray(pc.fill_null(pc.index_in(distinct, value_set=self.vocabulary), -1), np.int64)
        seen = np.flatnonzero(at >= 0)
        kind[seen], rest[seen], often[seen] = LONGEST + 1, self.known.rest[at[seen]], self.known.often[at[seen]]
        owner, lang, value = self.known.entries(at[seen])
        parts = [(seen[owner], lang, value)]
        left = np.flatnonzero(at < 0)
        pieces = Grams(distinct.take(pa.array(left)))
        which = np.arange(len(left))
        for n in range(LONGEST, 0, -1):
            if self.grams[n] is None or not len(which):
                continue
            keys, table = self.grams[n]
            key, owner = pieces.of(n, which)
            pos = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = np.flatnonzero(keys[pos] == key)
            pos, owner = pos[hit], owner[hit]
            many = np.bincount(owner, minlength=len(which))
            found = np.flatnonzero(many)
            word = left[which[found]]
            kind[word] = n
            rest[word] = np.bincount(owner, weights=table.rest[pos], minlength=len(which))[found] / many[found]
            e, lang, value = table.entries(pos)
            parts.append((left[which[owner[e]]], lang, value / many[owner[e]]))
            which = which[many == 0]
        return kind, rest, tuple(np.concatenate(c) for c in zip(*parts, strict=True)), often

    def measure(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, share of known words and margin over the second language per word of each text."""
        codes, distinct, offsets = words(texts, letters=True)
        n = len(offsets) - 1
        if not self.langs or not len(codes):
            return [UNKNOWN] * n, np.zeros(n), np.zeros(n), np.zeros(n)
        kind, rest, (word, lang, value), often = self._words(distinct)
        owner = np.repeat(np.arange(n), np.diff(offsets))
        order = np.argsort(lang, kind="stable")
        word, value, cuts = word[order], value[order], np.searchsorted(lang[order], np.arange(len(self.langs) + 1))
        evidence = np.empty((n, len(self.langs)))
        for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            column = self.base[kind, k] - rest + np.bincount(word[i:j], weights=value[i:j], minlength=len(distinct))
            evidence[:, k] = np.bincount(owner, weights=column[codes], minlength=n)
        some = np.diff(offsets)
        count = np.maximum(some, 1)
        best = evidence.argmax(axis=1)
        score = 1 / np.exp(evidence - evidence.max(axis=1, keepdims=True)).sum(axis=1)
        two = np.partition(evidence, -2, axis=1)[:, -2:] if len(self.langs) > 1 else np.zeros((n, 2))
        langs = [self.langs[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist(), strict=True)]
        known = np.bincount(owner, weights=often[codes], minlength=n)
        return langs, np.where(some > 0, score, 0.0), known / count, (two[:, -1] - two[:, 0]) / count

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        return self.measure(texts)[:2]


def _count_words(batches):
    for batch in slices(batches, "text", SLICE):
        codes, distinct, offsets = words(batch.column("text"), letters=True)
        langs = batch.column("lang").dictionary_encode()
        names = len(langs.dictionary)
        owner = np.repeat(np.asarray(langs.indices, np.int64), np.diff(offsets))
        pairs, n = np.unique(codes * max(names, 1) + owner, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [distinct.take(pa.array(pairs // max(names, 1))).cast(pa.string()), langs.dictionary.take(pa.array(pairs % max(names, 1))).cast(pa.string()), pa.array(n, pa.int64())], names=["word", "lang", "n"]
        )


def _count_grams(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        langs = batch.column("lang").dictionary_encode()
        code, n = np.asarray(langs.indices, np.int64), np.asarray(batch.column("n"), np.int64)
        pieces, every = Grams(batch.column("word")), np.arange(batch.num_rows)
        for size in range(1, LONGEST + 1):
            key, owner = pieces.of(size, every)
            order = np.lexsort((code[owner], key))
            key, lang, many = key[order], code[owner][order], n[owner][order]
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (lang[1:] != lang[:-1])])) if len(key) else np.zeros(0, np.int64)
            total = np.add.reduceat(many, new) if len(new) else many
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[new].view(np.int64)), pa.array(np.full(len(new), size, np.int32)), langs.dictionary.take(pa.array(lang[new])).cast(pa.string()), pa.array(total, pa.int64())],
                names=["key", "size", "lang", "n"],
            )


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_on: int = 20_000) -> Model:
    """A model of every word and n-gram of a bounded sample of labelled texts.

    `fit_on` is the expected number of texts in the sample, drawn by a hash of the id and the text; that alone bounds the
    model. Rows of one id, or of none, are drawn each by its text; rows that repeat both are in the sample together.
    """
    small_batches(labelled.sparkSession)
    base = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    share = min(1.0, fit_on / max(1, base.select("lang").count()))
    drawn = base.where(F.pmod(F.xxhash64(F.lit(11), "id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)) + (share == 1.0))
    counts = materialise(drawn.select("text", "lang").mapInArrow(_count_words, "word string, lang string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n")))
    by_key = counts.mapInArrow(_count_grams, "key long, size int, lang string, n long").groupBy("key", "size", "lang").agg(F.sum("n").alias("n"))
    # the counts of the bounded sample
    seen, grams = counts.toArrow(), by_key.toArrow()
    langs = sorted(set(seen.column("lang").unique().to_pylist()))
    names = pa.array(langs, pa.string())

    def table(row: np.ndarray, rows: int, part: pa.Table) -> Table:
        lang = np.asarray(pc.index_in(part.column("lang").combine_chunks(), value_set=names), np.int64)
        n = np.asarray(part.column("n"), np.int64)
        return Table(row, lang, n, rows, 1 + np.bincount(lang, weights=n, minlength=len(langs)))

    if not langs:
        return Model([], pa.array([], pa.large_string()), None, [None] * (LONGEST + 1))
    coded = seen.column("word").combine_chunks().cast(pa.large_string()).dictionary_encode()
    found: list[tuple[np.ndarray, Table] | None] = [None]
    for size in range(1, LONGEST + 1):
        part = grams.filter(pc.equal(grams.column("size"), size))
        keys, row = np.unique(np.asarray(part.column("key"), np.int64).view(np.uint64), return_inverse=True)
        found.append((keys, table(row, len(keys), part)) if len(keys) else None)
    return Model(langs, coded.dictionary, table(np.asarray(coded.indices, np.int64), len(coded.dictionary), seen), found)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) for each row: the language of most evidence and its posterior at equal priors.

    `und` with score 0 if the text is null or has no letter, or no language was learned. Whole texts are read. Of
    languages with equal evidence the first by name is predicted.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in slices(batches, "text", SLICE):
            langs, score = own.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(langs, pa.string()), pa.array(np.round(score, 9))], names=["id", "lang_pred", "score"])

    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def measure(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """predict() with the label (lang_col) and two measures that do not grow with a text: `known`, the share of its words
    that the sample has at least twice, and `margin`, the evidence per word over that of the second language (0 if there
    is one only).
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in slices(batches, "text", SLICE):
            langs, *numbers = own.measure(batch.column("text"))
            columns = [batch.column("id"), batch.column("lang"), pa.array(langs, pa.string()), *(pa.array(np.round(x, 9)) for x in numbers)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "lang", "lang_pred", "score", "known", "margin"])

    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    out = base.mapInArrow(run, "id long, lang string, lang_pred string, score double, known double, margin double")
    return out.withColumnsRenamed({"id": id_col, "lang": lang_col})


def identify(docs: DataFrame, learn_from: Callable[[DataFrame], DataFrame], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fit on the rows that `learn_from` selects and predict every row: (id_col, lang_pred, score).

    Only text and language of the selected rows are learned from; a prediction reads the text alone. Null texts and
    languages are not learned from; repeated rows are predicted each; very long texts are read whole, in slices of
    their own; other columns, whatever their names, are ignored; an empty table gives no rows, and without any labelled
    row every prediction is `und`.
    """
    return predict(docs, fit(learn_from(docs), id_col, text_col, lang_col), id_col, text_col)
