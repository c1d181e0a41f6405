from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.llm.common import slices, words
from quillgraph.llm.langid import fit, identify, predict
from quillgraph.llm.packing import WordTokenizer, cuts, pack
from quillgraph.llm.weak_quality import accuracies, score_quality

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def test_words_and_slices():
    texts = ["  a b\ta ", "", None, "A\x0bé\x0c x\r\n", "one"]
    codes, distinct, offsets = words(pa.array(texts, pa.string()), lower=True)
    own = [[distinct[c].as_py() for c in codes[i:j]] for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
    assert own == [["a", "b", "a"], [], [], ["a", "é", "x"], ["one"]]
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 10] * 7 + [None, "y" * 100])], names=["text"])
    parts = list(slices(iter([batch]), "text", 25))
    assert [p.num_rows for p in parts] == [2, 2, 2, 2, 1] and sum((p.column("text").to_pylist() for p in parts), []) == batch.column("text").to_pylist()


ODD = [
    "Hello, World! It's 2024-11-26; isn't IT?", "", " \t\n", "<|endoftext|> and <|startoftext|>x", "İstanbul ΣΑΣ ǅ ß ﬁ", "éà  nbsp em\u0085x", "a\x00b\x1cc", "日本語 テスト 123", "!!??...--", "don't we'll they're",
    "x" * 3000, "ÀÉÎ õü ñandú, être!", "​zero‍width", "naïve_café__", "½ ² ٣",
]


def test_tokenizer_equals_library():
    model = WordTokenizer(PATH)
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("abc ABC.,'é1 \n-Σ") for _ in range(rng.randrange(200))) for _ in range(200)]
    ids, offsets = model.encode(pa.array(texts, pa.string()), 1)
    for t, i, j in zip(texts, offsets[:-1], offsets[1:], strict=True):
        assert ids[i:j].tolist() == [*model.lib.encode(t, add_special_tokens=False).ids, 1], t


def test_cuts():
    """Each document's pieces are whole, exact reciprocals of the capacity or a tail, largest first."""
    lengths = np.array([1, 5, 63, 64, 65, 127, 2047, 2048, 2049, 5000, 40_000])
    row, length = cuts(lengths, 2048, 64)
    for i, n in enumerate(lengths.tolist()):
        parts = length[row == i].tolist()
        assert sum(parts) == n and parts == sorted(parts, reverse=True)
        assert all(p in {2048 // k for k in range(1, 33)} or p < 64 for p in parts)


def test_pack(spark):
    rng = random.Random(2)
    texts = ODD + [None, "long " * 30_000] + [" ".join(rng.choice(["alpha", "Beta", "gamma,"]) for _ in range(rng.randrange(900))) for _ in range(120)]
    rows = [(i, t, "own", 7) for i, t in enumerate(texts)] + [(3, texts[3], "own", 7), (None, "no id", "own", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, class string, bin int")
    got = pack(df, PATH, with_ids=True).collect()
    lib = WordTokenizer(PATH).lib
    per_id: dict = {}
    for r in got:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        per_id.setdefault(r["doc_id"], []).append(r)
    want: dict = {}
    for i, t, *_ in rows:
        want.setdefault(i, []).append([*lib.encode(t or "", add_special_tokens=False).ids, 1])
    for i, docs in want.items():
        pieces = sorted(per_id[i], key=lambda r: r["start"])
        assert sum(r["length"] for r in pieces) == sum(map(len, docs)) and {r["doc_tokens"] for r in pieces} == {len(d) for d in docs}
        if len(docs) == 1:
            assert [x for r in pieces for x in r["ids"]] == docs[0] and [r["start"] for r in pieces] == np.cumsum([0, *(r["length"] for r in pieces[:-1])]).tolist()
    seqs: dict = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padding = total = 0
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
        total += at
    assert padding / (padding + total) < 0.05
    assert pack(df.limit(0), PATH).count() == 0


def language_rows():
    pools = {"en": "the of and house water walking thing green".split(), "de": "der die und haus wasser gehen ding grün".split(), "fr": "le la et maison eau marcher chose vert".split()}
    rng = random.Random(4)
    rows = []
    for i in range(120):
        lang = ["en", "de", "fr"][i % 3]
        rows.append((i, " ".join(rng.choice(pools[lang]) for _ in range(rng.randrange(5, 60))) + ".", lang, "src"))
    return rows + [(500, None, "en", "s"), (501, "", "en", "s"), (502, "123 !! --", None, "s"), (503, "Housing greenish waters", None, "s"), (504, "wasserfall gehend", None, "s")]


def test_language(spark):
    df = spark.createDataFrame(language_rows(), "doc_id long, text string, lang string, score string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(df, lambda d: d.where("doc_id % 2 = 0")).collect()}
    assert len(got) == 125
    held_out = [i for i in range(120) if i % 2]
    assert all(got[i][0] == ["en", "de", "fr"][i % 3] for i in held_out)
    assert got[500] == got[501] == got[502] == ("und", 0.0)
    # unseen words are scored by their n-grams
    assert got[503][0] == "en" and got[504][0] == "de" and all(0 < s <= 1 for k, (_, s) in got.items() if k not in (500, 501, 502))
    # a prediction reads the text alone
    blind = predict(df.withColumn("lang", F.lit("de")), fit(df.where("doc_id % 2 = 0")))
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in blind.collect()} == got
    none = identify(df, lambda d: d.where("false"))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    assert identify(df.limit(0), lambda d: d).count() == 0


def quality_rows():
    rng = random.Random(6)
    words_ = "the of and to in house water thing walking green was is that garden stone light paper river".split()
    rows = []
    for i in range(300):
        w = [rng.choice(words_) for _ in range(rng.randrange(40, 200))]
        kind = i % 12
        if kind == 0:
            w = [x.upper() + "!!" for x in w]
        elif kind == 1:
            w = [x + rng.choice(["%%%", "***", "$$$"]) for x in w]
        elif kind == 2:
            w = [x for x in w for _ in range(20)]
        elif kind == 3:
            w = [y for x in w for y in (x, "|")]
        elif kind > 3:
            w = [x + ("." if n % 9 == 8 else "") for n, x in enumerate(w)]
        rows.append((i, " ".join(w), "x", kind > 3))
    return rows


def test_quality(spark):
    rows = quality_rows()
    df = spark.createDataFrame([r[:3] for r in rows] + [(900, None, "x"), (901, "", "x"), (902, "short but fine", "x"), (0, rows[0][1], "x")], "doc_id long, text string, votes string")
    got = [r for r in score_quality(df).collect()]
    assert len(got) == 304
    keep = {r["doc_id"]: r["keep"] for r in got}
    assert all(keep[i] == good for i, _, _, good in rows)
    assert not keep[900] and not keep[901] and keep[902]
    assert score_quality(df.limit(0)).count() == 0


def test_em():
    """Accuracies of made-up labellers are found again from their votes alone."""
    rng = random.Random(8)
    right = [(0.999, 0.4), (0.999, 0.6), (0.999, 0.5), (0.999, 0.7)]
    counts: dict = {}
    for _ in range(20_000):
        good = rng.random() < 0.8
        votes = "".join("+" if rng.random() < (a if good else b) else "-" for a, b in right)
        counts[votes] = counts.get(votes, 0) + 1
    prior, found, post = accuracies(counts)
    assert prior == pytest.approx(0.8, abs=0.03) and np.allclose(found[:, 1], [b for _, b in right], atol=0.06)
    assert post["----"] < 0.01 < 0.95 < post["++++"]


def brute_language(pairs, texts):
    """The model's formulas word by word, in dictionaries: (language, score, known share, margin) of each text."""
    import math

    import regex

    letters, langs = regex.compile(r"\p{L}+"), sorted({v for _, v in pairs})
    words_, grams_ = {}, {n: {} for n in range(1, 5)}

    def pieces(w, n):
        m = f"<{w}>" if n > 1 else w
        return [m[i : i + n] for i in range(len(m) - n + 1)]

    for text, lang in pairs:
        for w in letters.findall(text.lower()):
            words_.setdefault(w, {}).setdefault(lang, 0)
            words_[w][lang] += 1
            for n in grams_:
                for g in pieces(w, n):
                    grams_[n].setdefault(g, {}).setdefault(lang, 0)
                    grams_[n][g][lang] += 1

    def logs(table):
        totals = {v: 1 + sum(c.get(v, 0) for c in table.values()) + 0.5 * (len(table) + 1) for v in langs}
        out = {}
        for key, c in table.items():
            raw = [math.log((c.get(v, 0) + 0.5) / totals[v]) for v in langs]
            z = math.log(sum(math.exp(x) for x in raw))
            out[key] = [x - z for x in raw]
        return out

    word_logs, gram_logs = logs(words_), {n: logs(t) for n, t in grams_.items()}
    out = []
    for text in texts:
        found = letters.findall((text or "").lower())
        total, known = [0.0] * len(langs), 0
        for w in found:
            known += sum(words_.get(w, {}).values()) >= 2
            own = word_logs.get(w)
            for n in range(4, 0, -1):
                if own is None and (hits := [gram_logs[n][g] for g in pieces(w, n) if g in gram_logs[n]]):
                    own = [sum(x) / len(hits) for x in zip(*hits, strict=True)]
            total = [a + b for a, b in zip(total, own or [0.0] * len(langs), strict=True)]
        best = max(range(len(langs)), key=lambda k: (total[k], -k))
        score = 1 / sum(math.exp(x - total[best]) for x in total)
        two = sorted(total)[-2:]
        out.append((langs[best] if found else "und", score if found else 0.0, known / max(len(found), 1), (two[1] - two[0]) / max(len(found), 1)))
    return out


def test_language_against_brute_force(spark):
    """Every measure of every text against the formulas by hand, many languages, very long texts and ties among them."""
    rng = random.Random(12)
    pools = {f"l{k:03}": ["".join(rng.choice("abcdefghij"[k % 5 : k % 5 + 6]) for _ in range(rng.randrange(1, 7))) for _ in range(12)] for k in range(230)}
    pairs = [(" ".join(rng.choice(pool) for _ in range(rng.randrange(3, 30))), lang) for lang, pool in pools.items() for _ in range(2)]
    model = fit(spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(pairs)], "doc_id long, text string, lang string"))
    assert len(model.langs) == 230  # no language is left out
    texts = [t for t, _ in pairs[::9]] + ["zzz qqq", "Éa-b c1d", "", None, "1 2 3", "a", "abc " * 4000, "x" * 20_000, pairs[0][0] + " " + pairs[5][0]]
    got = model.measure(pa.array(texts, pa.string()))
    for own, want in zip(zip(*(list(x) for x in got), strict=True), brute_language(pairs, texts), strict=True):
        assert own[0] == want[0] and own[1:] == pytest.approx(want[1:], abs=1e-4)


def test_quality_votes_by_hand():
    """Sums over words against a loop over words; long words count whole, and scripts without white space are judged."""
    from quillgraph.llm.weak_quality import LABELLERS, _features

    rng = random.Random(13)
    texts = ["", None, "  ", "one", "日本語の文章です。" * 40, "§¶†" * 100, "A" * 300] + [" ".join(rng.choice(["Word", "word", "WORD", "a%b", "|", "end.", "wow!!", "x1", "12"]) for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["id", "text"])
    rows = [r for b in _features(iter([batch])) for r in b.to_pylist()]
    plain = ".,;:!?'\"()-"
    for text, r in zip(texts, rows, strict=True):
        w = (text or "").split()
        n, chars = len(w), sum(map(len, w))
        letters = sum(c.isalpha() for x in w for c in x)
        caps = sum(c.isupper() for x in w for c in x[1:]) / max(letters, 1)
        symbols = sum(not c.isalnum() and c not in plain for x in w for c in x) / max(chars, 1)
        some = n >= 8 or chars >= 200
        again = sum(a == b for a, b in zip(w, w[1:], strict=False))
        bare, ends = sum(not any(map(str.isalnum, x)) for x in w) / max(n, 1), sum(x[-1] in ".?!" for x in w) / max(n, 1)
        loud, recurring = sum(x.endswith(("!!", "??")) for x in w) / max(n, 1), sum(w.count(x) > 1 for x in w) / max(n, 1)
        vote = lambda bad, good: "-" if bad else "+" if good else "0"
        want = [
            vote(some and caps > 0.15, some and caps < 0.02), vote(some and symbols > 0.03, some and symbols < 0.005), vote(n >= 8 and again / max(n - 1, 1) > 0.08 and again >= 3, n >= 8 and again / max(n - 1, 1) < 0.01),
            vote(n >= 8 and bare > 0.06, n >= 8 and bare < 0.01), vote(n >= 100 and recurring < 0.02, n >= 100 and recurring > 0.1), vote(n >= 8 and loud > 0.08 or n >= 60 and ends < 0.002, n >= 8 and 0.01 < ends < 0.3 and loud < 0.01),
        ]
        assert (r["n_words"], r["votes"]) == (n, "".join(want)), (text or "")[:80]
        assert len(r["votes"]) == len(LABELLERS)
    # a long word has as many shapes as it has pieces: its end counts
    one, other = (next(_features(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([t])], names=["id", "text"])]))).column("at")[0].as_py() for t in ("aB1" * 40 + "x", "aB1" * 40 + "%"))
    assert one != other


def test_quality_edges(spark):
    """Very long texts, repeated rows and ties of the score get one answer each."""
    rows = [(1, "the house is green and the garden is quiet. " * 3000), (2, "same words here. " * 20), (2, "same words here. " * 20), (3, "same words here. " * 20), (None, "no id but text.")]
    got = score_quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5 and len({(r["score"], r["keep"]) for r in got if r["doc_id"] in (2, 3)}) == 1


def test_sample_is_drawn_row_by_row(spark):
    """Rows of one id, and rows without any, are drawn each by itself, not in or out together."""
    rows = [(None, f"der hund und die katze {i}", "de") for i in range(300)] + [(7, f"the dog and the cat {i}", "en") for i in range(300)]
    model = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), fit_on=60)
    assert model.langs == ["de", "en"]
