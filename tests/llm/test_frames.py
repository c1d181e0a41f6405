from __future__ import annotations

import json
import math
import zlib

import pytest
from pyspark.sql import functions as F

from quillgraph.llm.mixing import mix, rates
from quillgraph.llm.pages import extract, lines, shared
from quillgraph.llm.sharding import shards
from quillgraph.llm.toolcalls import link

DOCS = "doc_id long, text string, source string, shard int, range string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "r") for i, t, s in rows], DOCS)


@pytest.mark.parametrize("hot", [False, True])
def test_shards(spark, hot):
    rows = [(i, ("copy" if hot and i % 3 else f"text {i} é") * (1 + i % 7), "a") for i in range(3000)] + [(5000, None, "a"), (5001, "", "a"), (5002, "x" * 2000, "a"), (7, "twice", "a"), (None, "no id", "a")]
    got = shards(docs(spark, rows), rows_per_range=200).collect()
    assert len(got) == len(rows) and {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    want = sorted((str(i), len((t or "").encode()) + 16, None if t is None else zlib.crc32(t.encode())) for i, t, _ in rows)
    assert sorted(((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got), key=str) == sorted(want, key=str)
    by: dict = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    assert sorted(by) == list(range(40)) and all(sorted(r["slot"] for r in g) == list(range(len(g))) for g in by.values())
    sizes = [sum(r["size"] for r in g) for s, g in by.items()]
    assert max(sizes) - min(sizes) <= 2 * 2016
    usual = sorted(sizes)[1:-1]
    assert max(usual) < 1.5 * min(usual)


@pytest.mark.parametrize("hot", [False, True])
def test_shards_against_brute_force(spark, hot):
    """Every placement against one sorted list of all records."""
    rows = [(i, ("copy" if hot and i % 2 else f"text {i}") * (1 + i % 5), "a") for i in range(2500)] + [(3, "again", "a"), (3, "again", "a"), (9000, None, "a"), (9001, "long " * 20_000, "a")]
    df = docs(spark, rows)
    keyed = df.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).alias("size"), F.crc32("text").alias("crc")).collect()
    order = sorted((r["h"], r["doc_id"], r["size"], -1 if r["crc"] is None else r["crc"]) for r in keyed)
    total, at, want, front = sum(r[2] for r in order), 0, [], {}
    for place, (_, i, size, _) in enumerate(order):
        shard = min(39, int((at + size / 2) * 40 / total))
        front.setdefault(shard, place)
        want.append((i, size, shard, place - front[shard]))
        at += size
    got = [(r["doc_id"], r["size"], r["shard"], r["slot"]) for r in shards(df, rows_per_range=100).collect()]
    assert sorted(got) == sorted(want)


def test_shards_few(spark):
    got = shards(docs(spark, [(1, "a", "s"), (2, "b", "s")])).collect()
    assert len(got) == 2 and all(r["slot"] == 0 for r in got)
    assert shards(docs(spark, [])).count() == 0


def test_mix(spark):
    rows = [(i, "word " * (1 + i % 9), "big" if i % 3 else f"s{i % 12}") for i in range(6000)] + [(9000, None, "nulls"), (9001, "x", None)]
    df = docs(spark, rows)
    rated = {r["source"]: (r["n_bytes"], r["rate"]) for r in rates(df).collect()}
    total, roots = sum(b for b, _ in rated.values()), sum(b**0.5 for b, _ in rated.values())
    for b, rate in rated.values():
        assert rate == pytest.approx(b**0.5 / roots * total / b if b else 0.0, abs=1e-8)
    out = mix(df)
    assert out.columns == [*df.columns, "_rate", "_copies", "_copy", "_order"]
    got = {r["source"]: r["b"] for r in out.groupBy("source").agg(F.sum(F.octet_length("text")).alias("b")).collect()}
    for s in ("big", "s0", "s3"):
        b, rate = rated[s]
        assert got[s] == pytest.approx(b * rate, rel=6 / math.sqrt(b * rate / 25))
    assert "nulls" not in got
    again = mix(df.repartition(7))
    assert sorted(out.select("doc_id", "_copy").collect(), key=str) == sorted(again.select("doc_id", "_copy").collect(), key=str)
    order = [r["_order"] for r in out.collect()]
    assert order == sorted(order)
    assert mix(df.limit(0)).count() == 0


def test_mix_edges(spark):
    """Rows without an id, repeated ids and very long texts draw as others do."""
    rows = [(None, "no id", "a"), (None, "none either", "a"), (5, "x", "a"), (5, "y", "a"), (6, "long " * 50_000, "b")]
    got = mix(docs(spark, rows), total=8.0).groupBy("doc_id", "text").agg(F.max("_copies").alias("c"), F.count("*").alias("n")).collect()
    per = {(r["doc_id"], r["text"][:9]): r["c"] for r in got}
    assert all(r["c"] == r["n"] for r in got)
    assert per.get((5, "x")) == per.get((5, "y")) and per.get((None, "no id")) == per.get((None, "none eith"))


def test_mix_weights_and_large_rates(spark):
    df = docs(spark, [(i, "0123456789", "a" if i < 40 else "b") for i in range(400)])
    weights = spark.createDataFrame([("a", 1.0)], "source string, weight double")
    out = mix(df, weights, total=20.0)  # rate 200: several hashes a document
    copies = [r["_copies"] for r in out.select("doc_id", "_copies").distinct().collect()]
    assert out.where("source = 'b'").count() == 0 and len(copies) == 40
    assert sum(copies) == pytest.approx(8000, rel=0.05) and min(copies) > 100


def test_counts_invert_poisson(spark):
    """Counts against the distribution function, by hand."""
    import hashlib

    df = docs(spark, [(i, "0123456789", "a" if i % 2 else "b") for i in range(300)])
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "source string, weight double")
    got = {r["doc_id"]: r["_copies"] for r in mix(df, weights).select("doc_id", "_copies").distinct().collect()}
    for i in range(300):
        rate = 0.5 if i % 2 else 1.5
        u = (int(hashlib.md5(f"17:{i}:1".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        k, p = 0, math.exp(-rate)
        c = p
        while c < u:
            k += 1
            p *= rate / k
            c += p
        assert got.get(i, 0) == k


PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><script>var t="</p><p>no";</script><style>p{{}}</style></head><body class="has-sidebar"><nav><ul><li><a href="/a">Home</a></li></ul></nav>'
    '<div class="cookie-notice">We use cookies</div><article class="post comments-closed"><h1>{h}</h1><p>First &amp; <b>bold</b>\n  text&nbsp;here.<br><p>Second {n} &lt;tag&gt; &eacute;<aside>An aside</aside>'
    '<div class="ad-box">Buy</div><form><p>Sign up</p><input></form><p>Third <a href="x">link</a>.</p><section id="comments"><p>Nice!</p></section></article>'
    "<div>Plain template</div><footer>&copy; 2024 {n}</footer></body></html>"
)


def test_pages(spark):
    rows = [(i, f"https://Site.example/a/{i}?q=1", PAGE.format(h=f"Head {i}", n=i), "t") for i in range(5)]
    rows += [(10, "https://x.example/1", None, "t"), (11, None, "", "t"), (12, "https://x.example/2", "<p>only<p>text <", "t"), (13, "nonsense", "<article><p>cut off", "t"), (3, rows[3][1], rows[3][2], "t")]
    got = {r["page_id"]: r for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    for i in range(5):
        assert got[i]["text"] == f"Head {i}\nFirst & bold text here.\nSecond {i} <tag> é\nThird link."
        assert got[i]["n_chars"] == len(got[i]["text"])
    assert [got[i]["text"] for i in (10, 11, 12, 13)] == ["", "", "only\ntext <", "cut off"]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_differencing(spark):
    """Without an element for the article, lines shared with the nearest page are the template; copies are not."""
    page = "<div>Welcome to the site</div><div>{a}</div><p>{b}</p><div><a>Next</a></div><div>All rights reserved</div>"
    rows = [(1, "http://h/a/1", page.format(a="Alpha story", b="It begins."), ""), (2, "http://h/a/2", page.format(a="Beta story", b="It ends."), ""), (3, "http://h/b/9", page.format(a="Beta story", b="It ends."), ""), (4, "http://other/a/1", page.format(a="Alone", b="No neighbour."), "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, x string").coalesce(1)
    got = {r["page_id"]: r["text"] for r in extract(df).collect()}
    assert got[1] == "Alpha story\nIt begins." and got[2] == "Beta story\nIt ends."
    assert "Alone" in got[4] and "Welcome to the site" in got[4]


def site(rng, n):
    """Pages of two sites without an element for the article, some copies among them."""
    rows = []
    for i in range(n):
        host = rng.choice(["a", "b"])
        same = [r[2] for r in rows if r[1].startswith(f"http://{host}.")]
        own = rng.choice(same) if same and rng.random() < 0.2 else None
        body = "".join(f"<p>{rng.choice(['story', 'tale'])} {rng.randrange(400)}</p>" for _ in range(rng.randrange(1, 5)))
        page = f"<div>Welcome to {host}</div><ul><li><a href='/'>Home</a></li></ul>{body}<div>Rights {host}</div>" + ("<article><p>x</p><p><a>more</a></p></article>" if rng.random() < 0.2 else "")
        rows.append((i, f"http://{host}.example/{rng.randrange(5)}/{rng.randrange(50)}", own or page))
    return rows


def brute_extract(rows):
    """Every page against the different pages beside it, in one list of all pages."""
    from quillgraph.llm.pages import NEIGHBOURS, main_text

    order = sorted((u.split("/")[2], "/" + "/".join(u.split("/")[3:]), i, lines(h)) for i, u, h in rows)
    out = {}
    for at, (host, path, i, own) in enumerate(order):
        near = []
        for step in (-1, 1):
            k, last, seen = at + step, own, []
            while 0 <= k < len(order) and order[k][0] == host and len(seen) < NEIGHBOURS:
                if order[k][3] != last:
                    seen.append((order[k][1], order[k][3]))
                    last = order[k][3]
                elif seen:
                    seen[-1] = (order[k][1], last) if step < 0 else seen[-1]
                k += step
            near += seen[::-1] if step < 0 else seen
        mine = path
        while at > 0 and order[at - 1][0] == host and order[at - 1][3] == own:
            at -= 1
            mine = order[at][1]
        prefix = lambda p, q: next((n for n, (x, y) in enumerate(zip(p, q)) if x != y), min(len(p), len(q)))
        near.sort(key=lambda r: -prefix(r[0], mine))
        out[i] = main_text(own, [r[1] for r in near])
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_extraction_against_brute_force(spark, parts):
    """The same texts however the order of pages is cut, and those of a plain scan; the template goes, stories stay."""
    import random

    rows = site(random.Random(9), 150)
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string").repartition(5)
    got = {r["page_id"]: r["text"] for r in extract(df, parts=parts).collect()}
    assert got == brute_extract(rows)
    bare = [t for i, t in got.items() if "<article>" not in rows[i][2]]
    assert not any("Welcome" in t or "Rights" in t or "Home" in t for t in bare) and all("story" in t or "tale" in t for t in bare)


def test_names():
    from quillgraph.llm.pages import NAMES, _names

    assert all(_names(v, NAMES) for v in ("ad", "ad-box", "site-footer", "comments", "cookie_notice", "related-posts"))
    assert not any(_names(v, NAMES) for v in ("related-work", "share-price", "nav-open", "has-sidebar", "comments-closed", "post", "article-body"))


@pytest.mark.parametrize("cells", [1 << 24, 4])
def test_lcs(monkeypatch, cells):
    import random

    from quillgraph.llm import pages

    monkeypatch.setattr(pages, "CELLS", cells)

    def brute(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(12))] for _ in range(2))
        at = sorted(shared(a, b))
        assert len(at) == brute(a, b)
        it = iter(b)
        assert all(x in it for x in (a[i] for i in at))  # a subsequence of b


def test_cut_off_tag():
    assert [t for t, *_ in lines('<p>one 1 < 2</p><p>two <a href="http://x')] == ["one 1 < 2", "two"]
    assert [t for t, *_ in lines("<p>one</p")] == ["one"]


def test_forms_and_named_parts():
    """A form around the page is none of its forms, and parts of an article that share a name with boilerplate keep their prose."""
    page = '<body><form action="/x"><header>top</header><article><h1>Title</h1><p>One.</p><form><label>Mail</label><input><p>Join us</p></form>{}</article><footer>end</footer></form></body>'
    text = lambda part: [t for t, core, _ in lines(page.format(part)) if core]
    assert text("") == ["Title", "One."]
    assert text('<section class="share"><p>Share price rose.</p><p><a href="#">Tweet</a> <a href="#">Post</a></p></section>') == ["Title", "One.", "Share price rose."]
    assert text('<div class="newsletter"><p>Subscribe now.</p></div><div class="comments"><p>First!</p></div>') == ["Title", "One."]
    assert [t for t, *_ in lines('<body><p>Text.</p><div class="share"><p>Share this</p></div><form class="search"><p>Find</p></form></body>')] == ["Text."]
    assert [t for t, *_ in lines('<form role="search"><section><p>Find</p></section></form><p>Text.</p>')] == ["Text."]
    assert [t for t, *_ in lines("<form>" * 50_000 + "<p>x")] == [] and [t for t, *_ in lines("<FORM><main><p>x</p></main></FORM><p>y")] == ["x", "y"]


def test_lines_flags():
    got = lines("<body>x<article><header><h1>Title</h1><p>by me</p></header><p><a>Only</a> <a>links</a></p>y</article></body>")
    assert [t for t, *_ in got] == ["x", "Title", "Only links", "y"] and [c for _, c, _ in got] == [False, True, True, True] and got[2][2]


TOOLS = [("search", "q", "string", True), ("search", "n", "integer", False), ("ping", None, None, None)]


def test_toolcalls(spark):
    def call(i, name, args, **more):
        return {"id": i, "name": name, "arguments": args, **more}

    a1 = json.dumps({"content": "let me look", "tool_calls": [call("c1", "search", {"q": "x", "n": 2.0}), call("c2", "search", {"n": "two", "q": "y"}), call("c3", "nope", {})]})
    a2 = json.dumps({"tool_calls": [call("c4", "search", {}), call("c5", "ping", {"b": 1, "a": [1.50, None]}), call("c1", "ping", {}), {"name": "ping", "arguments": {}}, call("c6", "ping", "text")]})
    deps = json.dumps({"tool_calls": [call("d1", "ping", {}, depends_on=["d2"]), call("d2", "ping", {}), call("k1", "ping", {}, depends_on=["k2"]), call("k2", "ping", {}, depends_on=["k1"])]})
    rows = [
        (1, 0, "user", "hi \"there\"\n"), (1, 1, "assistant", a1), (1, 2, "tool", json.dumps({"tool_call_id": "c2", "content": {"z": 1, "a": 2}})), (1, 3, "tool", json.dumps({"tool_call_id": "c1", "content": "ok"})),
        (1, 4, "tool", json.dumps({"tool_call_id": "zz", "content": 1})), (1, 5, "assistant", a2), (1, 6, "tool", json.dumps({"tool_call_id": "c1", "content": "late"})), (2, 0, "assistant", "{not json"), (2, 1, "assistant", deps),
        (2, 2, "user", None), (3, 0, "tool", "plain"), (1, 0, "user", "hi \"there\"\n"),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, json string, kind string")
    tools = spark.createDataFrame(TOOLS, "name string, parameter string, type string, required boolean")
    got = [r.asDict() for r in link(df, tools).collect()]
    by = {(r["conv_id"], r["turn"], r["item"]): r for r in got}
    assert len(got) == 22  # 5 messages, a content, 4 results, 12 calls
    calls = {(r["turn"], r["item"]): (r["call_id"], r["linked"], r["problem"]) for r in got if r["kind"] == "call" and r["conv_id"] == 1}
    assert calls == {
        (1, 1): ("c1", True, None), (1, 2): ("c2", True, "type of n"), (1, 3): ("c3", False, "unknown tool"), (5, 1): ("c4", False, "missing q"), (5, 2): ("c5", False, None),
        (5, 3): ("c1", False, "repeated identifier"), (5, 4): (None, False, "no identifier"), (5, 5): ("c6", False, "arguments are no object"),
    }
    results = {r["turn"]: (r["linked"], r["problem"], r["at_turn"]) for r in got if r["kind"] == "result"}
    assert results == {2: (True, None, 1), 3: (True, None, 1), 4: (False, "no call", 4), 6: (False, "repeated identifier", 1)}
    assert by[(1, 5, 2)]["json"] == '{"arguments":{"a":[1.5,null],"b":1},"id":"c5","name":"ping","role":"assistant","type":"call"}'
    assert by[(1, 2, 0)]["json"] == '{"content":{"a":2,"z":1},"id":"c2","role":"tool","type":"result"}'
    assert by[(1, 0, 0)]["json"] == json.dumps({"content": 'hi "there"\n', "role": "user"}, separators=(",", ":"))
    assert by[(2, 2, 0)]["json"] == '{"content":null,"role":"user"}' and by[(2, 0, 0)]["kind"] == "message" and by[(3, 0, 0)]["kind"] == "message"
    order = [(r["call_id"], r["kind"]) for r in got if r["conv_id"] == 1 and r["turn"] in (1, 2, 3)]
    assert order == [(None, "message"), ("c1", "call"), ("c1", "result"), ("c2", "call"), ("c2", "result"), ("c3", "call")]
    levels = {r["call_id"]: (r["level"], r["problem"]) for r in got if r["conv_id"] == 2 and r["kind"] == "call"}
    assert levels["d2"][0] < levels["d1"][0] and levels["k1"][1] == levels["k2"][1] == "cycle" and levels["d1"][1] is None
    assert link(df.limit(0)).count() == 0


@pytest.mark.parametrize("gathered", [64, 1])
def test_toolcall_levels(spark, monkeypatch, gathered):
    """Places of calls against a walk by hand, settled in one row or by joins alike; cycles and what is behind them."""
    import random

    from quillgraph.llm import toolcalls

    monkeypatch.setattr(toolcalls, "GATHERED", gathered)
    rng = random.Random(3)
    rows, needs = [], {}
    for conv in range(6):
        for turn in range(8):
            of = [f"c{rng.randrange(8)}" for _ in range(rng.randrange(3))] if conv else [f"c{turn - 1}"]
            needs[conv, f"c{turn}"] = {n for n in of if n != "c-1"}
            rows.append((conv, turn, "assistant", json.dumps({"tool_calls": [{"id": f"c{turn}", "name": "ping", "arguments": {"text": "long " * 2000}, "depends_on": of}]})))
    got = link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()

    def place(conv, call, above=()):
        """(at_turn, level), or None in or behind a cycle."""
        if call in above:
            return None
        best = (int(call[1:]), 0)
        for n in needs[conv, call]:
            under = place(conv, n, (*above, call))
            if under is None:
                return None
            best = max(best, (under[0], under[1] + 1))
        return best

    for r in got:
        want = place(r["conv_id"], r["call_id"])
        assert (r["problem"] == "cycle") == (want is None)
        assert (r["at_turn"], r["level"]) == ((r["turn"], 1) if want is None else (want[0], want[1] + 1))


def test_toolcalls_null_conversation_and_repeats(spark):
    """Calls without a conversation and repeated rows stay as they are when a call depends on another."""
    deps = json.dumps({"tool_calls": [{"id": "d1", "name": "ping", "arguments": {}, "depends_on": ["d2"]}, {"id": "d2", "name": "ping", "arguments": {}}]})
    back = json.dumps({"tool_call_id": "d1", "content": 1})
    for convs in ([None], [1], [1, None]):
        rows = [(c, 0, "assistant", deps) for c in convs for _ in range(3)] + [(c, 1, "tool", back) for c in convs for _ in range(2)]
        got = link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
        for c in convs:
            calls = [r for r in got if r["conv_id"] == c and r["kind"] == "call"]
            assert sorted(r["call_id"] for r in calls) == ["d1"] * 3 + ["d2"] * 3
            level = {r["call_id"]: r["level"] for r in calls}
            assert level["d2"] < level["d1"] and all(r["linked"] == (r["call_id"] == "d1") for r in calls)
            assert [(r["linked"], r["problem"]) for r in got if r["conv_id"] == c and r["kind"] == "result"] == [(True, None)] * 2


def test_numbers_are_written_in_one_way(spark):
    """Arguments as an object and as JSON in a string: equal numbers are equal text and pass the same checks."""
    numbers = ["1e2", "100", "100.0", "1.50", "1E-2", "-0", "0.0", "12345678901234567890123", "2.5e3"]
    rows = []
    for i, n in enumerate(numbers):
        for k, arguments in enumerate((f'{{"x":{n},"y":[{n}]}}', json.dumps(f'{{"x":{n},"y":[{n}]}}'))):
            rows.append((2 * i + k, 0, "assistant", f'{{"tool_calls":[{{"id":"a","name":"f","arguments":{arguments}}}]}}'))
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    tools = spark.createDataFrame([("f", "x", "integer", True)], "name string, parameter string, type string, required boolean")
    got = {r["conv_id"]: (r["json"], r["problem"]) for r in link(chats, tools).collect()}
    assert all(got[2 * i] == got[2 * i + 1] for i in range(len(numbers)))
    assert {got[0][0], got[2][0], got[4][0]} == {'{"arguments":{"x":100,"y":[100]},"id":"a","name":"f","role":"assistant","type":"call"}'}
    assert [n for i, n in enumerate(numbers) if got[2 * i][1]] == ["1.50", "1E-2"]
