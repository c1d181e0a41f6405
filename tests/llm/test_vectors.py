from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm.ivfpq import nearest
from quillgraph.llm.pivot_dedup import near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, copies string"


def table(spark, vectors, odd=()):
    rows = [(i, [float(x) for x in v], 0, "x") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows + [(len(rows) + i, v, 0, "y") for i, v in enumerate(odd)], SCHEMA)


def crowd(n=160, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(0, 40, 4):  # chains of near copies, and some exact ones
        x[i + 1], x[i + 2] = x[i] + 0.12 * rng.normal(size=dim), x[i] + 0.25 * rng.normal(size=dim)
    x[50:70] = x[50] + 0.05 * rng.normal(size=(20, dim))
    x[70:73] = x[70]
    return x.astype(np.float32).astype(float)


def brute_links(x, t=0.95):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = u @ u.T >= t
    np.fill_diagonal(links, False)
    lab = np.arange(len(x))
    while True:
        new = np.minimum(lab, np.where(links, lab[None, :], len(x)).min(axis=1))
        if (new == lab).all():
            return links.sum(axis=1), lab
        lab = new


ODD = [None, [0.0] * 16, [float("nan")] * 16, [1.0] * 15 + [float("inf")], [1.0] * 15 + [None], [1.0, 2.0], []]


def test_near_vectors(spark):
    x = crowd()
    got = near_vectors(table(spark, x, ODD)).orderBy("vec_id").collect()
    n, component = brute_links(x)
    assert len(got) == len(x) + len(ODD)
    # every pair over the threshold shares two of its ten nearest pivots here
    assert [r["n_links"] for r in got[: len(x)]] == n.tolist()
    assert [r["component_id"] for r in got[: len(x)]] == component.tolist()
    assert all(r["n_links"] == 0 and r["kept"] and r["component_id"] == r["vec_id"] for r in got[len(x) :])


def test_near_vectors_blocks(spark, monkeypatch):
    """Lists longer than a block are compared in block pairs, each pair once."""
    from quillgraph.llm import pivot_dedup

    monkeypatch.setattr(pivot_dedup, "BLOCK", 8)
    x = crowd(n=90, seed=2)
    got = near_vectors(table(spark, x)).orderBy("vec_id").collect()
    n, component = brute_links(x)
    assert [(r["n_links"], r["component_id"]) for r in got] == list(zip(n.tolist(), component.tolist(), strict=True))


@pytest.mark.parametrize("n", [2000, 8000])
def test_recall_on_planted_pairs(spark, n):
    """Pairs of cosine just over the threshold among random vectors: at least 0.95 of them are found, and no other."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 32))
    for i in range(0, n // 4, 2):
        u, v = x[i] / np.linalg.norm(x[i]), rng.normal(size=32)
        v -= (v @ u) * u
        x[i + 1] = (0.955 * u + np.sqrt(1 - 0.955**2) * v / np.linalg.norm(v)) * rng.uniform(0.5, 2)
    x = x.astype(np.float32).astype(float)
    got = near_vectors(table(spark, x)).where("n_links > 0").collect()
    links, _ = brute_links(x)
    assert all(r["n_links"] <= links[r["vec_id"]] for r in got)
    assert sum(r["n_links"] for r in got) >= 0.95 * links.sum()


def test_repeats_and_empty(spark):
    rows = [(5, [1.0, 0.0], 0, ""), (5, [1.0, 0.0], 0, ""), (3, [2.0, 0.0], 1, ""), (None, [1.0, 0.0], 1, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(tuple(r) for r in near_vectors(df).collect()) == [(3, 1, 3, True), (5, 1, 3, False)]
    assert near_vectors(df.limit(0)).count() == 0
    assert nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0


def brute_top(x, ids, queries, k):
    out = {}
    for q in queries:
        order = sorted((-float((x[q] * x[i]).sum()), ids[i]) for i in range(len(x)) if i != q)
        out[ids[q]] = order[:k]
    return out


@pytest.mark.parametrize("n", [15, 900])
def test_nearest(spark, n):
    x = crowd(max(n, 160), seed=3)[:n]
    got = nearest(table(spark, x, ODD), F.col("id") % 20 == 0).collect()
    want = brute_top(x, list(range(n)), range(0, n, 20), 20)
    found: dict = {}
    for r in got:
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(found) == set(want)
    hits = 0
    for q, top in want.items():
        ranks = found[q]
        assert sorted(ranks) == list(range(1, min(20, n - 1) + 1))
        scores = [ranks[i][1] for i in sorted(ranks)]
        assert scores == sorted(scores, reverse=True) and q not in {v for v, _ in ranks.values()}
        assert all(s == pytest.approx(float((x[q] * x[v]).sum()), abs=1e-12) for v, s in ranks.values())
        hits += len({v for v, _ in ranks.values()} & {v for _, v in top})
    recall = hits / sum(map(len, want.values()))
    assert recall == 1.0 if n <= 400 else recall >= 0.9


def test_nearest_ties(spark):
    df = table(spark, [[1.0, 0.0]] * 5 + [[0.0, 1.0]])
    got = nearest(df, F.col("id") == 2, k=3).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(1, 0, 1.0), (2, 1, 1.0), (3, 3, 1.0)]
