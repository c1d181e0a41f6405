"""Maximal runs of repeated words, by partition refinement.

Positions of a batch of documents start in classes of equal words. Step by step the classes are refined to positions of
equal factors, one word longer each time: i and j stay together if i + 1 and j + 1 did. A class is split only by the
smaller parts of classes that the step before has split, so a position is touched a logarithmic number of times. Each
class is a linked list in text order. Neighbours in a list whose distance equals the length of the factors are a square
of a root that is no power, and squares of one period at consecutive positions are a run of exactly that least period.

A run has at least `least` words and `exponent` times its period, so documents drop out of the refinement once factors
are longer than their words divided by that exponent. Classes never mix documents, so a batch is refined at once; steps
that touch few positions, the most by far, are taken one position at a time, the others with arrays.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, words

SLICE = 4 << 20
FEW = 12
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, `counts` of them."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts - starts, counts)


class _Classes:
    """Classes of positions: number and place of each position, members of a class in a row, neighbours in text order."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        order = np.argsort(codes, kind="stable")
        self.members, self.place = order, np.empty(n, np.int64)
        self.place[order] = np.arange(n)
        first = np.flatnonzero(np.diff(codes[order], prepend=-1))
        self.number = np.empty(n, np.int64)
        self.number[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
        self.begin, self.size = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        self.begin[: len(first)], self.size[: len(first)] = first, np.diff(np.append(first, n))
        self.count = len(first)
        self.following, self.preceding = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        near = self.number[order[1:]] == self.number[order[:-1]]
        self.following[order[:-1][near]], self.preceding[order[1:][near]] = order[1:][near], order[:-1][near]
        self.mark = np.zeros(n, bool)
        #: who got which neighbour, and in which step
        self.log: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.single: list[tuple[int, int, int]] = []
        held = np.flatnonzero(self.following >= 0)
        self._note(held, self.following[held] - held, 1)
        names = ("members", "place", "number", "begin", "size", "following", "preceding")
        self.views = tuple(memoryview(getattr(self, x)) for x in names)

    def _note(self, at: np.ndarray, gap: np.ndarray, step: int) -> None:
        self.log.append((at, gap, np.full(len(at), step)))

    def split(self, at: np.ndarray, splitter: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions `at` (each once) leave their class, together with those of the same splitter; (positions, splitter)
        of the parts that the next step must look at: all parts of a class but a largest one."""
        order = np.lexsort((at, splitter, self.number[at]))
        at, splitter = at[order], splitter[order]
        old = self.number[at]
        new_part = np.concatenate([[True], (old[1:] != old[:-1]) | (splitter[1:] != splitter[:-1])])
        heads = np.flatnonzero(new_part)
        amount, of = np.diff(np.append(heads, len(at))), old[heads]
        new_class = np.concatenate([[True], of[1:] != of[:-1]])
        first = np.flatnonzero(new_class)
        touched = np.add.reduceat(amount, first)
        parts = np.diff(np.append(first, len(of)))
        rest = self.size[of[first]] - touched
        real = (rest > 0) | (parts > 1)
        if not real.any():
            return at[:0], at[:0]
        # a class without a rest keeps its number for the last of its parts
        which = np.cumsum(new_class) - 1
        last = np.zeros(len(of), bool)
        last[first + parts - 1] = True
        moves = real[which] & ~(last & (rest[which] == 0))
        biggest = np.maximum(np.maximum.reduceat(amount, first), rest)
        # one of the largest parts is left out: the rest if it is one, else the first of its size
        large = amount == biggest[which]
        seen = np.cumsum(large) - np.repeat(np.concatenate([[0], np.cumsum(large)])[first], parts)
        skip = large & (seen == 1) & (rest[which] < biggest[which])
        show_rest = real & (rest > 0) & (rest < biggest)
        go = _expand(heads[moves], amount[moves])
        group = np.repeat(np.arange(int(moves.sum())), amount[moves])
        # the places of those that go are the last ones of their class; who stood there and stays takes theirs
        gone, home = at[go], old[go]
        left = np.bincount(which[moves], weights=amount[moves], minlength=len(first)).astype(np.int64)
        some = left > 0
        owner = of[first][some]
        bound = self.begin[owner] + self.size[owner] - left[some]
        self.mark[gone] = True
        tail = _expand(bound, left[some])
        displaced = self.members[tail]
        displaced = displaced[~self.mark[displaced]]
        slot = self.place[gone]
        vacated = slot[slot < np.repeat(bound, left[some])]
        self.members[vacated], self.place[displaced] = displaced, vacated
        self.members[tail], self.place[gone] = gone, tail
        self.mark[gone] = False
        self.size[owner] -= left[some]
        fresh = self.count + np.arange(int(moves.sum()))
        sizes = amount[moves]
        self.begin[fresh], self.size[fresh] = tail[np.concatenate([[0], np.cumsum(sizes)[:-1]])] if len(fresh) else 0, sizes
        self.number[gone] = fresh[group]
        self.count += len(fresh)
        # lists: chains of those that go are cut out of the old list, then each part is a list of its own
        by_place = np.lexsort((gone, home))
        g = gone[by_place]
        joined = np.concatenate([[False], self.following[g[:-1]] == g[1:]])
        chain = np.flatnonzero(~joined)
        before, after = self.preceding[g[chain]], self.following[g[np.append(chain[1:], len(g)) - 1]]
        has, to = before >= 0, after >= 0
        self.following[before[has]], self.preceding[after[to]] = after[has], before[to]
        both = has & to
        self._note(before[both], after[both] - before[both], step)
        self._note(before[has & ~to], np.zeros(int((has & ~to).sum()), np.int64), step)
        near = np.concatenate([group[1:] == group[:-1], [False]])
        follow = np.where(near, np.append(gone[1:], -1), -1)
        self.preceding[gone] = np.where(np.concatenate([[False], near[:-1]]), np.concatenate([[-1], gone[:-1]]), -1)
        self.following[gone] = follow
        self._note(gone, np.where(follow >= 0, follow - gone, 0), step)
        shown = real[which] & ~skip
        pick = _expand(heads[shown], amount[shown])
        rests = of[first][show_rest]
        others = self.members[_expand(self.begin[rests], self.size[rests])]
        found = np.concatenate([at[pick], others])
        return found, self.number[found]

    def split_few(self, at: list[int], splitter: list[int], step: int) -> tuple[list[int], list[int]]:
        """split() for a handful of positions."""
        members, place, number, begin, size, following, preceding = self.views
        parts: dict[int, dict[int, list[int]]] = {}
        for i, s in zip(at, splitter, strict=True):
            parts.setdefault(number[i], {}).setdefault(s, []).append(i)
        note = self.single.append
        found: list[int] = []
        for old, by in parts.items():
            rest = size[old] - sum(map(len, by.values()))
            if not rest and len(by) == 1:
                continue
            groups = list(by.values())
            biggest = max(rest, max(map(len, groups)))
            skipped = rest == biggest
            for k, own in enumerate(groups):
                own.sort()
                if skipped or len(own) < biggest:
                    found += own
                else:
                    skipped = True
                if not rest and k == len(groups) - 1:
                    continue  # keeps the number; the others have left its list
                new, end = self.count, begin[old] + size[old]
                self.count += 1
                for i in own:
                    end -= 1
                    other, slot = members[end], place[i]
                    members[slot], place[other] = other, slot
                    members[end], place[i] = i, end
                    number[i] = new
                    a, b = preceding[i], following[i]
                    if a >= 0:
                        following[a] = b
                        note((a, b - a if b >= 0 else 0, step))
                    if b >= 0:
                        preceding[b] = a
                size[old] -= len(own)
                begin[new], size[new] = end, len(own)
                prev = -1
                for i in own:
                    preceding[i] = prev
                    if prev >= 0:
                        following[prev] = i
                        note((prev, i - prev, step))
                    prev = i
                following[prev] = -1
                note((prev, 0, step))
            if rest and rest < biggest:
                found += members[begin[old] : begin[old] + rest].tolist()
        return found, [number[i] for i in found]


def runs(codes: np.ndarray, offsets: np.ndarray, least: int = 6, exponent: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of every run, by document, start and period.

    codes are the words of all documents in a row, offsets where each document begins and, last, where the last ends.
    """
    counts = np.diff(offsets)
    docs, none = len(counts), np.zeros(0, np.int64)
    if not counts.sum():
        return none, none, none, none
    # a closing word of its own after each document
    doc = np.repeat(np.arange(docs), counts + 1)
    close = np.cumsum(counts + 1) - 1
    text = np.full(len(doc), -1, np.int64)
    inside = np.ones(len(doc), bool)
    inside[close] = False
    text[inside] = codes[offsets[0] : offsets[-1]]
    width = int(text.max()) + 2
    _, start = np.unique(doc * width + text + 1, return_inverse=True)
    classes = _Classes(start.astype(np.int64))
    limit = (counts // exponent)[doc]
    # the first step splits by every class; the last position of a document goes by its closing word
    at = np.flatnonzero(inside & (limit > 1))
    splitter = classes.number[at + 1]
    number, size, bound, word = classes.views[2], classes.views[4], memoryview(limit), memoryview(inside)
    step = 1
    while len(at):
        step += 1
        if len(at) > FEW:
            at, splitter = np.asarray(at), np.asarray(splitter)
            found, its = classes.split(at, splitter, step)
            # a factor that goes on before a document's first word is none, and documents leave at their limit
            ahead = found - 1
            keep = (ahead >= 0) & (limit[ahead] > step) & inside[ahead]
            keep &= classes.size[classes.number[ahead]] > 1
            at, splitter = ahead[keep], its[keep]
        else:
            if not isinstance(at, list):
                at, splitter = at.tolist(), splitter.tolist()
            found, its = classes.split_few(at, splitter, step)
            pairs = [(i - 1, s) for i, s in zip(found, its, strict=True) if i and bound[i - 1] > step and word[i - 1] and size[number[i - 1]] > 1]
            at, splitter = [i for i, _ in pairs], [s for _, s in pairs]
    log = [np.concatenate(x) for x in zip(*classes.log, strict=True)]
    if classes.single:
        log = [np.concatenate([a, b]) for a, b in zip(log, np.array(classes.single, np.int64).T, strict=True)]
    who, gap, since = log
    # the last note of a step holds, until the next step that has one
    order = np.lexsort((np.arange(len(who)), since, who))
    who, gap, since = who[order], gap[order], since[order]
    until = np.append(np.where(who[1:] == who[:-1], since[1:], np.iinfo(np.int64).max), np.iinfo(np.int64).max)
    square = (gap > 0) & (since <= gap) & (gap < until) & (gap <= np.maximum(limit[who], 1))
    if not square.any():
        return none, none, none, none
    at, period = who[square], gap[square]
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    head = np.flatnonzero(np.concatenate([[True], (period[1:] != period[:-1]) | (at[1:] != at[:-1] + 1)]))
    tail = np.append(head[1:], len(at)) - 1
    first, period, length = at[head], period[head], at[tail] - at[head] + 2 * period[head]
    good = length >= np.maximum(least, exponent * period)
    first, period, length = first[good], period[good], length[good]
    of = doc[first]
    order = np.lexsort((period, first, of))
    return of[order], (first - (close - counts)[of])[order], length[order], period[order]


def _collapsed(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether each of n words stays: those that a run contains after its first period go."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) == 0


def _digest(doc_ids: list, codes: np.ndarray, tokens: list[bytes], offsets: np.ndarray, recur) -> list[tuple]:
    n = np.diff(offsets)
    if recur is not None:
        codes = np.concatenate([codes[a:b][recur(i, int(b - a))] for i, a, b in zip(doc_ids, offsets[:-1], offsets[1:], strict=True)] or [codes])
    of, start, length, period = runs(codes, offsets)
    bounds = np.searchsorted(of, np.arange(len(doc_ids) + 1))
    out = []
    for k, i in enumerate(doc_ids):
        s, ln, q = (x[bounds[k] : bounds[k + 1]].tolist() for x in (start, length, period))
        best = max(zip(s, ln, q, strict=True), key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in zip(s, ln, q, strict=True))
        own = codes[offsets[k] : offsets[k + 1]]
        if s:
            own = own[_collapsed(int(n[k]), *(np.array(x) for x in (s, ln, q)))]
        text = b" ".join([tokens[c] for c in own.tolist()])
        out.append((i, len(s), *(best or (None, None, None)), best[1] * 1000 // best[2] if best else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
    return out


def planted(doc_id: int | None, n: int) -> np.ndarray:
    """Which original word stands at each place: one document in ten repeats a stretch of its words to its end."""
    out = np.arange(n)
    if doc_id is None or not n:
        return out
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return out
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    out[a:] = a + (out[a:] - a) % p
    return out


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recur=None) -> DataFrame:
    """The runs of every row: (doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256).

    Words are split on ASCII white space and compared as they are. A run has at least six words and four times its least
    period, and is maximal. start, length, period and exponent_milli (1000 * length / period, rounded down) are those of
    the run of greatest length / period, ties to the smallest start, then period; null if there is none. runs_sha256 is
    the digest of `start,length,period` and a line feed for each run by start, then period; collapsed_sha256 that of the
    words without repeats, joined by one space. `recur(doc_id, n)` may give another order of a row's words first.

    Null, empty and blank texts have no word and no run, and the digests of the empty text. Very long texts are read
    whole: a row of n words takes n log n steps. Repeated rows and null ids have a row each, other columns, whatever
    their names, are ignored, an empty table gives no rows. Nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in slices(batches, "text", SLICE):
            codes, distinct, offsets = words(batch.column("text"))
            tokens = distinct.cast(pa.large_binary()).to_pylist()
            rows = _digest(batch.column("doc_id").to_pylist(), codes, tokens, offsets, recur)
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return base.mapInArrow(run, SCHEMA)
