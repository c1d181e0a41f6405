from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import bayes_dedup
from quillgraph.llm.bayes_dedup import banding, least_matches, near_duplicates
from quillgraph.llm.common import components

SCHEMA = "doc_id long, text string, n long, component_id string"


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t, *_ in rows]
    root = {i: i for i, _ in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for x in range(len(sets)):
        for y in range(x):
            (i, s), (j, t) = sets[x], sets[y]
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {(i, len(s), find(i)) for i, s in sets}


def corpus(seed=0):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for g in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 160))]
        if g % 5 == 0:
            words[5:5] = passage  # a passage that many documents share
        for c in range(rng.choice([1, 1, 2, 4, 9])):
            w = list(words)
            for _ in range(c):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(w), 0, "x"))
    return rows


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_against_brute_force(spark, k, percent, monkeypatch):
    monkeypatch.setattr(bayes_dedup, "SMALL_BUCKET", 3)  # the block pairs are used too
    monkeypatch.setattr(bayes_dedup, "BLOCK", 4)
    monkeypatch.setattr(bayes_dedup, "WIDE_BLOCK", 6)
    monkeypatch.setattr(bayes_dedup, "FIRST_BANDS", 1)
    rows = corpus(k)
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), words_per_shingle=k, percent=percent).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == brute(rows, k, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_edges(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [
        (9, "Same  text here now", 0, ""), (4, "same TEXT\there\nnow", 0, ""), (5, None, 0, ""), (6, "", 0, ""), (7, " \t ", 0, ""), (8, "two words", 0, ""), (3, "Two Words", 0, ""),
        (10, "É a b c", 0, ""), (11, "é a b c", 0, ""), (12, long, 0, ""), (13, long + " end", 0, ""), (9, "Same  text here now", 0, ""), (None, "same text here now", 0, ""),
    ]
    got = sorted(near_duplicates(spark.createDataFrame(rows, SCHEMA), words_per_shingle=3, percent=85).collect(), key=str)
    by = {(r["doc_id"], r["component_id"], r["kept"]) for r in got}
    assert len(got) == len(rows)
    assert by == {(9, 4, False), (4, 4, True), (5, 5, True), (6, 6, True), (7, 7, True), (8, 3, False), (3, 3, True), (10, 10, True), (11, 11, True), (12, 12, True), (13, 12, False), (None, None, True)}
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_ids(spark):
    """An id with several texts is one document with the links of all of them; copies of one row change nothing."""
    text = lambda seed: " ".join(f"t{seed}w{i}" for i in range(40))
    rows = [(5, text(1)), (5, text(2)), (3, text(1) + " more"), (9, text(2) + " end"), (9, text(2) + " end"), (7, text(3)), (7, text(3)), (1, text(4))]
    got = near_duplicates(spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA), words_per_shingle=3, percent=85).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == [(1, 38, 1), (3, 39, 3), (5, 38, 3), (5, 38, 3), (7, 38, 7), (7, 38, 7), (9, 39, 3), (9, 39, 3)]


def test_bounds():
    for percent in (80, 85, 95):
        rows, bands = banding(percent / 100, 256, 1e-5)
        assert (1 - (percent / 100) ** rows) ** bands <= 1e-5 and rows * bands <= 256
    table = least_matches(0.85, 256, 1e-5)
    assert [n for n, _ in table] == list(range(32, 257, 32)) and all(0 < m < 0.85 * n for n, m in table)
    assert [m / n for n, m in table] == sorted(m / n for n, m in table)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 150), (150, 175)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 150, 150: 150, 175: 150}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hub(spark):
    """A star of many copies: the base links each of them, and the result is one group."""
    rng = random.Random(3)
    base = [f"v{rng.randrange(10_000)}" for _ in range(100)]
    rows = []
    for i in range(120):
        w = list(base)
        w[rng.randrange(100)] = f"e{i}"
        rows.append((i, " ".join(w), 0, ""))
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), words_per_shingle=3, percent=85)
    assert got.select(F.count_distinct("component_id"), F.count_if("kept")).first()[:] == (1, 1)


def test_near_copies_go_out_once(spark):
    """Buckets that one component fills are one unit, and its members meet the others only; where a component has
    different members in each bucket, buckets stay apart."""
    from quillgraph.llm.bayes_dedup import _Corpus, _dealt

    of = "key long, node long, component long, size long"
    same = [(k, n, n if n < 10 else 1000, 300) for k in range(36) for n in range(300)]
    units = _Corpus.units(None, spark.createDataFrame(same, of))
    rows = units.collect()
    assert len(rows) == 300 and {(r["unit"], r["whole"]) for r in rows} == {(1000, True)}
    dealt = _dealt(units, 50).collect()
    assert len(dealt) == 290 + 10 * 7  # 36 * 300 * 6 in blocks of each bucket
    apart = [(k, k * 100 + n, k * 100 if n == 0 else 9000, 100) for k in range(20) for n in range(100)]
    rows = _Corpus.units(None, spark.createDataFrame(apart, of)).collect()
    assert len(rows) == 2000 and len({r["unit"] for r in rows}) == 20 and not any(r["whole"] for r in rows)
