from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from quillgraph.llm import runs as R

rng = random.Random(13)


def slow_runs(w: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by trying all periods and keeping the least one of each stretch."""
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and not any(s <= i and s + ln >= j + q and q % p == 0 for (s, ln), p in found.items()):
                found[(i, j - i + q)] = q
            i = j + 1
    return sorted((s, ln, q) for (s, ln), q in found.items())


def texts():
    out = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 7 + ["b"], list("abab") * 2, list("abababab") + ["c"] * 9, list("aabaabaabaab"), list("abcabcabcabcab") * 2, ["x"] * 40, list("abcd" * 3)]
    for _ in range(400):
        alphabet = rng.choice(["ab", "abc", "abcdefgh"])
        w = [rng.choice(alphabet) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            p = [rng.choice(alphabet) for _ in range(rng.randrange(1, 9))]
            w += (p * 9)[: rng.randrange(1, 9 * len(p))]
        out.append(w + [rng.choice(alphabet) for _ in range(rng.randrange(9))])
    long = [rng.choice("abcdefghijklmnop") + rng.choice("xyz") for _ in range(900)]
    return out + [long, long[:200] * 5 + long, long + long, long[:100] + long[300:340] * 7 + long]


def flat(lists):
    known: dict = {}
    codes = np.array([known.setdefault(x, len(known)) for w in lists for x in w], np.int64)
    return codes, np.concatenate([[0], np.cumsum([len(w) for w in lists])]).astype(np.int64)


@pytest.mark.parametrize("few", [0, 12, 10**9])
@pytest.mark.parametrize("together", [True, False])
def test_equal_to_all_periods(monkeypatch, few, together):
    """Refinement with arrays only, with single positions only and mixed; a batch of documents, and each alone."""
    monkeypatch.setattr(R, "FEW", few)
    all_ = texts()
    want = [slow_runs(w) for w in all_]
    got: list = [[] for _ in all_]
    if together:
        for of, *r in zip(*(x.tolist() for x in R.runs(*flat(all_))), strict=True):
            got[of].append(tuple(r))
    else:
        for k, w in enumerate(all_[:150] + all_[-4:]):
            k = k if k < 150 else len(all_) - 154 + k
            got[k] = list(zip(*(x.tolist() for x in R.runs(*flat([w]))[1:]), strict=True))
        got[150:-4] = want[150:-4]
    assert got == want and sum(map(len, want)) > 300


def expected(doc_id, text):
    w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if x]
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = slow_runs(w)
    drop = {i for s, ln, q in found for i in range(s + q, s + ln)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_query_on_rows_of_every_kind(spark):
    """Nulls, empty and blank texts, other white space, repeated rows, null ids, clashing names, a long text."""
    body = [" ".join(w) for w in texts()[:120]]
    rows = [(i, t, 1, "x") for i, t in enumerate(body)] + [(900, None, 1, "x"), (901, " \t\r\n", 2, None), (None, "a a a a a a a", 1, "x"), (902, "é é é é é é", 1, "x"), (902, "é é é é é é", 1, "x")]
    rows += [(903, "a\x0ba\x0ca\ta\ra\na b", 1, "x"), (904, "", 1, ""), (905, "w " * 30_000, 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, period int, number string").repartition(5)
    got = sorted((tuple(r) for r in R.find_runs(df, recur=R.planted).collect()), key=str)
    want = sorted((expected(i, t) for i, t, *_ in rows if i != 905), key=str)
    assert [r for r in got if r[0] != 905] == want
    big = next(r for r in got if r[0] == 905)
    assert big[:6] == (905, 1, 0, 30_000, 1, 30_000_000)
    assert R.find_runs(df.where("false")).count() == 0 and sum(r[1] for r in want) > 60
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(120))
