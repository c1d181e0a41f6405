from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillgraph.llm import lexical as X

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
rng = random.Random(12)


def split(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def expected(items, docs, k):
    held = [(i, split(t)) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    n_docs, n_words = len(held), sum(len(w) for _, w in held)
    counts = [(i, len(w), Counter(w)) for i, w in held]
    df = Counter(t for _, _, c in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        scored = []
        for i, n, c in counts:
            m = 100 - 90 + 90 * n * n_docs // n_words
            s = sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(split(text)) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def test_terms():
    texts = ["a-B c9", None, "", "ÀÉ İx ﬁ日本!語", "\x00\x7f~`x_y", "'don't'", "ÄA"]
    codes, distinct, offsets = X.terms(pa.array(["gone", *texts]).slice(1))
    got = [[distinct[c].as_py() for c in codes[a:b]] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert got == [split(t) for t in texts]


def test_top_keeps_ties_of_smaller_places():
    for _ in range(300):
        s = np.array([rng.randrange(4) for _ in range(rng.randrange(30))], np.int64)
        k = rng.randrange(1, 12)
        want = sorted((i for i in range(len(s)) if s[i] > 0), key=lambda i: (-s[i], i))[:k]
        assert sorted(X.top(s, k).tolist()) == sorted(want)


@pytest.mark.parametrize(("docs_a_shard", "block"), [(1 << 15, 16 << 20), (7, 400)])
def test_equal_to_brute_force(spark, monkeypatch, docs_a_shard, block):
    """One shard a task and many; one block of items and several; ties, nulls, repeated rows and ids, names that clash."""
    monkeypatch.setattr(X, "SHARD_DOCS", docs_a_shard)
    vocab = ["alpha", "Beta", "γάμμα", "d4", "e", "F", "日本", "the", "the"]
    text = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", ",", "'s", "\n"]) for _ in range(n))
    docs = [(i, text(rng.randrange(30)), 1, "x") for i in range(300)] + [(i, "twin alpha", 2, "x") for i in range(400, 440)]
    docs += [(500, None, 1, "x"), (501, "", 1, "x"), (502, " ?! ", 1, None), (None, "alpha rare", 1, "x"), (503, "rare " * 50_000, 1, "x"), (7, "rare twin", 1, "x"), (7, "rare twin", 1, "x")]
    items = [(i, text(rng.randrange(1, 12)), 1) for i in range(30)] + [(100, "twin", 1), (101, "rare", 1), (102, "unknown", 1), (103, None, 1), (104, "...", 1), (None, "e", 1), (100, "twin", 1), (105, "the the THE", 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, rank int, score string").repartition(6)
    q = spark.createDataFrame(items, "item_id long, text string, doc_id int")
    got = X.rank_documents(q, d, block_bytes=block)
    assert sorted(map(tuple, got.collect()), key=str) == expected([x[:2] for x in items], [x[:2] for x in docs], 10)
    assert X.rank_documents(q.where("false"), d).count() == 0 and X.rank_documents(q, d.where("false")).count() == 0
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
