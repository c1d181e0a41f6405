"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or abstain on every document. The votes are counted by pattern over all documents
(at most 3 ** labellers patterns), and expectation-maximisation on these counts estimates how often each labeller is
right on good and on bad documents. The posterior of a document's pattern is its weak label, and weak labels of a
bounded sample train a logistic scorer over hashed features of the shapes of words, which then scores every document.

Texts are read as arrays of character classes, so no step in Python is taken for a word. The labellers know no
language: none holds a list of words.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices, small_batches, words

BUCKETS = 1 << 14
SLICE = 1 << 20
PIECE = 8
SPACE, UPPER, LETTER, DIGIT, PLAIN, SYMBOL, UNSEEN = range(7)
LABELLERS = ("case", "symbols", "repeats", "bare", "recurrence", "stops")
_CLASSES = np.full(0x110000, UNSEEN, np.uint8)


def _class(point: int) -> int:
    """ASCII white space, capital, other letter or mark, digit, plain punctuation, or symbol."""
    ch = chr(point)
    if ch in " \t\n\v\f\r":
        return SPACE
    kind = unicodedata.category(ch)
    if kind == "Lu":
        return UPPER
    return LETTER if kind[0] in "LM" else DIGIT if kind[0] == "N" else PLAIN if ch in ".,;:!?'\"()-" else SYMBOL


def _classes(points: np.ndarray) -> np.ndarray:
    out = _CLASSES[points]
    new = np.unique(points[out == UNSEEN])
    if len(new):
        _CLASSES[new] = [_class(p) for p in new.tolist()]
        out = _CLASSES[points]
    return out


def _vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    return np.where(bad, -1, np.where(good, 1, 0)).astype(np.int8)


def votes(n: np.ndarray, s: dict[str, np.ndarray]) -> np.ndarray:
    """One column per labeller (LABELLERS), from sums over each document's words; n counts the words."""
    chars, w = s["chars"], np.maximum(n, 1)
    some = (n >= 8) | (chars >= 200)  # evidence enough, in a script without white space too
    caps, symbols = s["capitals"] / np.maximum(s["letters"], 1), s["symbols"] / np.maximum(chars, 1)
    repeated, bare, ends, loud = s["repeats"] / np.maximum(n - 1, 1), s["bare"] / w, s["ends"] / w, s["loud"] / w
    recurring = s["recurring"] / w
    cols = [
        _vote(some & (caps > 0.15), some & (caps < 0.02)),
        _vote(some & (symbols > 0.03), some & (symbols < 0.005)),
        _vote((n >= 8) & (repeated > 0.08) & (s["repeats"] >= 3), (n >= 8) & (repeated < 0.01)),
        _vote((n >= 8) & (bare > 0.06), (n >= 8) & (bare < 0.01)),
        _vote((n >= 100) & (recurring < 0.02), (n >= 100) & (recurring > 0.1)),
        _vote((n >= 8) & (loud > 0.08) | (n >= 60) & (ends < 0.002), (n >= 8) & (ends > 0.01) & (ends < 0.3) & (loud < 0.01)),
    ]
    return np.stack(cols, axis=1)


def _pieces(points: np.ndarray, kinds: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shapes of words, and the word of each.

    A shape has letters by case and digits as classes and other characters as they are, runs cut to two; of a shape
    longer than PIECE classes each run of PIECE is a shape of its own, so a word is read whole however long it is.
    """
    code = np.where(kinds <= DIGIT, kinds, points + 8).astype(np.uint32)
    same = (code[1:] == code[:-1]) & (word[1:] == word[:-1])
    code, word = (x[~np.concatenate([[False, False], same[1:] & same[:-1]])[: len(x)]] for x in (code, word))
    if not len(code):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    place = np.arange(len(code)) - np.repeat(first, np.diff(np.append(first, len(code))))
    new = np.flatnonzero(place % PIECE == 0)
    h = (code.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * (np.uint64(2) * (place % PIECE).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    h = np.add.reduceat(h, new)
    return (h ^ (h >> np.uint64(32))) >> np.uint64(8), word[new]


def _features(batches):
    for batch in slices(batches, "text", SLICE):
        texts = batch.column("text")
        codes, distinct, offsets = words(texts)
        n, docs = np.diff(offsets), len(offsets) - 1
        whole = [t or "" for t in texts.to_pylist()]
        points = np.frombuffer("\n".join([*whole, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
        kinds = _classes(points)
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in whole), np.int64, docs))
        inside = kinds != SPACE
        edge = np.diff(inside.astype(np.int8), prepend=0)
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        owner = np.searchsorted(ends, start, "right")

        def upto(mask: np.ndarray) -> np.ndarray:
            return np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])

        letters, digits = upto((kinds == UPPER) | (kinds == LETTER)), upto(kinds == DIGIT)
        begins = ends - np.fromiter((len(t) + 1 for t in whole), np.int64, docs)
        per_doc = lambda c: (c[ends] - c[begins]).astype(float)
        per_word = lambda mask: np.bincount(owner[mask], minlength=docs).astype(float)
        capital = kinds == UPPER
        capital[start] = False
        last = points[stop - 1] if len(stop) else points[:0]
        before = points[np.maximum(stop - 2, 0)] if len(stop) else points[:0]
        end = (last == ord(".")) | (last == ord("?")) | (last == ord("!"))
        again = np.concatenate([[False], (owner[1:] == owner[:-1]) & (codes[1:] == codes[:-1])])[: len(codes)]
        pairs, times = np.unique(owner * max(len(distinct), 1) + codes, return_counts=True)
        sums = {
            "letters": per_doc(letters), "capitals": per_doc(upto(capital)), "symbols": per_doc(upto(kinds == SYMBOL)), "chars": per_doc(upto(inside)), "repeats": per_word(again),
            "bare": per_word((letters[stop] == letters[start]) & (digits[stop] == digits[start])), "ends": per_word(end),
            "loud": per_word(end & (last != ord(".")) & (last == before) & (stop - start > 1)),
            "recurring": np.bincount(pairs // max(len(distinct), 1), weights=times * (times > 1), minlength=docs),
        }
        cast = votes(n, sums)
        # hashed features: shapes, pairs of neighbouring shapes, and "the word before again"
        at = np.flatnonzero(inside)
        shapes, of = _pieces(points[at], kinds[at], np.repeat(np.arange(len(start)), stop - start))
        whose = owner[of]
        both = whose[1:] == whose[:-1]
        joined = (shapes[:-1] * np.uint64(31) + shapes[1:]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
        who = np.concatenate([whose, whose[1:][both], owner[again]])
        what = np.concatenate([shapes % np.uint64(BUCKETS), joined[both] % np.uint64(BUCKETS), np.full(int(again.sum()), 1, np.uint64)]).astype(np.int64)
        keys, c = np.unique(who * BUCKETS + what, return_counts=True)
        value = np.sqrt(c / np.maximum(np.bincount(whose, minlength=docs), 1)[keys // BUCKETS]).astype(np.float32)
        cuts = np.searchsorted(keys // BUCKETS, np.arange(docs + 1))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"), pa.array(n, pa.int64()), pa.array(["".join("-0+"[v + 1] for v in r) for r in cast.tolist()], pa.string()),
                pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(keys % BUCKETS, pa.int32())), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(value)),
            ],
            names=["id", "n_words", "votes", "at", "value"],
        )


def accuracies(patterns: dict[str, int], rounds: int = 200, trust: float = 2.0) -> tuple[float, np.ndarray, dict[str, float]]:
    """EM over vote patterns: (share of good documents, P(good vote | good, bad) of each labeller, P(good) of each pattern).

    An abstention says nothing. Each labeller knows one kind of bad document, so it may miss most bad ones but is built
    to vote against hardly any good one. A Beta prior says so: it counts as `trust` times the documents that a labeller
    has voted on, with one false alarm in 500 good ones. All rates are estimated; the votes can move any of them.
    """
    if not patterns:
        return 0.5, np.zeros((0, 2)), {}
    keys = sorted(patterns)
    v = np.array([["-0+".index(c) - 1 for c in k] for k in keys])
    n = np.array([patterns[k] for k in keys], float)
    prior, right = 0.8, np.tile([0.99, 0.75], (v.shape[1], 1))
    for _ in range(rounds):
        logs = np.log([prior, 1 - prior])[None, :] + ((v == 1)[:, :, None] * np.log(right) + (v == -1)[:, :, None] * np.log(1 - right)).sum(axis=1)
        post = 1 / (1 + np.exp(logs[:, 1] - logs[:, 0]))
        w = np.stack([n * post, n * (1 - post)], axis=1)
        # one made-up vote of each kind in each class keeps every rate off 0 and 1
        yes = (v == 1).T @ w + 1
        cast = (v != 0).T @ w + 2
        yes[:, 0] += trust * cast[:, 0] * (1 - 1 / 500)
        cast[:, 0] *= 1 + trust
        new = yes / cast
        prior = float(np.clip(w[:, 0].sum() / n.sum(), 0.01, 0.99))
        if np.abs(new - right).max() < 1e-9:
            break
        right = new
    return prior, right, dict(zip(keys, post.tolist(), strict=True))


def train(lengths: np.ndarray, cols: np.ndarray, vals: np.ndarray, target: np.ndarray, rounds: int = 300, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by full-batch Adam; features of all rows in a row, `lengths` of them each."""
    weights, bias = np.zeros(BUCKETS), 0.0
    if not len(target):
        return weights, bias
    rows, cols, vals = np.repeat(np.arange(len(lengths)), lengths), cols.astype(np.int64), vals.astype(float)
    m, s, step = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), rate
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, weights=weights[cols] * vals, minlength=len(lengths)) + bias, -30, 30)))
        err = (p - target) / len(target)
        g = np.append(np.bincount(cols, weights=err[rows] * vals, minlength=BUCKETS) + decay * weights, err.sum())
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        move = step * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
        weights, bias, step = weights - move[:-1], bias - move[-1], step * 0.99
    return weights, float(bias)


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_on: int = 20_000, cut: float = 0.5) -> DataFrame:
    """Score every row: (id_col, votes, weak_label, score, keep).

    `votes` has a sign per labeller (+ good, - bad, 0 abstains), weak_label the posterior of that pattern, score the
    trained scorer's probability that the document is good, keep whether it reaches `cut`. A null, empty or blank text
    has score 0 and is not kept. Labellers abstain on texts of fewer than eight words and 200 characters. Very long
    texts and words are read whole; a score on the cut is kept. Repeated rows are scored each, other columns, whatever
    their names, are ignored, an empty table gives no rows. Vote patterns are counted over all documents; the scorer is
    trained on about `fit_on` of them, drawn by a hash of the id.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    seen = materialise(base.mapInArrow(_features, "id long, n_words long, votes string, at array<int>, value array<float>"))
    # at most 3 ** len(LABELLERS) rows
    patterns = {r["votes"]: r["n"] for r in seen.where("n_words > 0").groupBy("votes").agg(F.count("*").alias("n")).collect()}
    _, _, posterior = accuracies(patterns)
    total = sum(patterns.values())
    share = min(1.0, fit_on / max(1, total))
    drawn = seen.where((F.col("n_words") > 0) & (F.pmod(F.xxhash64(F.lit(8), "id"), F.lit(1 << 30)) < int(share * (1 << 30)) + (share == 1.0)))
    sample = drawn.orderBy(F.xxhash64(F.lit(9), "id"), "id").limit(2 * fit_on).select("votes", "at", "value").toArrow()
    at, value = (sample.column(c).combine_chunks() for c in ("at", "value"))
    target = np.array([posterior[v] for v in sample.column("votes").to_pylist()])
    weights, bias = train(np.diff(np.asarray(at.offsets)), np.asarray(at.flatten()), np.asarray(value.flatten()), target)
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias, posterior))

    def run(batches):
        w, b, label = shared.value
        for batch in batches:
            n = np.asarray(batch.column("n_words"))
            at, value = batch.column("at"), batch.column("value")
            owner = np.repeat(np.arange(len(n)), np.diff(np.asarray(at.offsets)))
            z = np.bincount(owner, weights=w[np.asarray(at.flatten())] * np.asarray(value.flatten()), minlength=len(n)) + b
            p = np.where(n > 0, np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 9), 0.0)
            weak = [label.get(v, 0.0) if c else 0.0 for v, c in zip(batch.column("votes").to_pylist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("votes"), pa.array(np.round(weak, 9)), pa.array(p), pa.array(p >= cut)], names=["id", "votes", "weak_label", "score", "keep"]
            )

    return seen.mapInArrow(run, "id long, votes string, weak_label double, score double, keep boolean").withColumnRenamed("id", id_col)
