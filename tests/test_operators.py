from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import strings
from quillgraph.operators import ambiguity, entities, evaluate, metrics, prep, retry, stats, walks
from quillgraph.plans.catalog import GraphSchema, PathDecl
from quillgraph.sources import benchmark

COLUMNS = "condition string, question_id string, attempt_no int, is_first_attempt boolean, is_correct boolean, matches_any boolean, ambiguity_type string, failure_mode string, syntax_valid boolean, schema_score double, route_to string, evaluated boolean, retry_count int"


def attempt(q, no=1, first=True, ok=True, fits=True, kind=None, failure=None, syntax=True, schema=1.0, route="accept", evaluated=True, retries=0):
    return ("c", q, no, first, ok, fits, kind, failure, syntax, schema, route, evaluated, retries)


def bundle(spark, *rows):
    return metrics.bundle(spark.createDataFrame(list(rows), COLUMNS)).first()


def test_overall(spark):
    b = bundle(
        spark, attempt("1"), attempt("2"), attempt("3", ok=False, kind="schema", failure="valid_non_default"),
        attempt("4", ok=False, fits=False, failure="invalid_query", syntax=False, schema=0.0, route="query_generator", evaluated=False),
    )
    assert (b["ex"], b["ea"], b["kg_valid"], b["syntax"], b["pass_at_1"], b["n_ambiguous"]) == (0.5, 0.75, 0.75, 0.75, 0.5, 1)


def test_retry_then_correct(spark):
    b = bundle(spark, attempt("1", ok=False, fits=False, failure="wrong_result"), attempt("1", 2, first=False))
    assert (b["ex"], b["pass_at_1"], b["semantic_repair"]) == (1.0, 0.0, 1.0)


def test_structural_repair(spark):
    bad = dict(schema=0.5, route="schema_linker", evaluated=False, ok=False)
    b = bundle(spark, attempt("1", **bad), attempt("1", 2, first=False), attempt("2", **bad))
    assert (b["initial_valid"], b["structural_repair"]) == (0.0, 0.5)


def test_detection_and_table(spark):
    p = spark.createDataFrame([("q1", 1, True), ("q3", 1, False), ("q3", 2, True)], "question_id string, attempt_no int, predicted boolean")
    q = spark.createDataFrame([("q1", True, True), ("q2", True, False), ("q3", False, False)], "question_id string, is_ambiguous boolean, is_correct boolean")
    d = metrics.detection(p, q)
    row = d.first()
    # q2 was never predicted, so it is no false negative
    assert (row["tp"], row["fp"], row["fn"], row["prec"], row["rec"], row["dsr"]) == (1, 1, 0, 0.5, 1.0, 0.5)
    m = metrics.bundle(spark.createDataFrame([("baseline", *attempt("1")[1:]), ("disambiguation_enhanced", *attempt("1")[1:])], COLUMNS))
    text = metrics.render(metrics.with_undetected(m, d), ["ex", "dsr", "f1"])
    assert text.splitlines()[2:] == ["| ex | 100.0 | 100.0 |", "| dsr | - | 50.0 |", "| f1 | - | 66.7 |"]


def test_recorded_f1(spark):
    got = spark.range(1).select(metrics.f1(F.lit(0.75), F.lit(0.192))).first()[0]
    assert round(100 * got, 1) == 30.6


def test_entropies(spark):
    df = spark.createDataFrame([("u", "a", 0.25), ("u", "b", 0.25), ("u", "c", 0.25), ("u", "d", 0.25), ("s", "a", 1.0), ("z", "a", 0.0), ("z", "b", 0.0), ("w", "a", 2.0), ("w", "b", 2.0)], "q string, x string, p double")
    assert {r["q"]: r["entropy"] for r in ambiguity.entropy_of_candidates(df, ["q"], "p").collect()} == {"u": 1.0, "s": 0.0, "z": 0.0, "w": 1.0}
    beams = spark.createDataFrame([("q", "a"), ("q", "a"), ("q", "b"), ("r", "a")], "q string, b string")
    got = {r["q"]: r["entropy"] for r in ambiguity.entropy_of_beams(beams, ["q"], "b").collect()}
    assert got["r"] == 0.0 and got["q"] == pytest.approx(0.5793801642856950)


def test_spans(spark):
    asked = [
        ("List the barges that Ada Quill moored near Saltmarsh", ["Saltmarsh", "Ada Quill"]), ("Who sailed for grey haven?", ["Grey Haven"]),
        ("Which crews joined Operation Tall Ship", ["Operation Tall Ship"]), ('Find the "red buoy"', ["red buoy"]), ("Quill", []), ("", []),
        # a mark of the other kind belongs to the mention
        ('say "it\'s" and "that\'s"', ["that's", "it's"]), ("a 'so \"called\"' thing", ['so "called"']), ("Ask Ada or ADA or Ada Quill", ["Ada Quill", "Ask Ada"]),
    ]
    df = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(asked)], "i int, q string")
    places = ("Saltmarsh", "Grey Haven")
    got = {r["i"]: r["s"] for r in df.select("i", entities.extract_spans("q", places).alias("s")).collect()}
    assert [sorted(got[i]) for i in range(len(asked))] == [sorted(s) for _, s in asked]


def test_posterior(spark):
    m = spark.createDataFrame([("x", i, 0.9) for i in range(15)] + [("y", 1, 0.8), ("z", 1, 0.5)], "span string, id int, s double")
    out = entities.posterior(m, ["span"], "s", [F.asc("id")])
    got = {r["span"]: (r["n"], round(r["t"], 9)) for r in out.groupBy("span").agg(F.count("*").alias("n"), F.sum("posterior").alias("t")).collect()}
    assert got == {"x": (10, 1.0), "y": (1, 1.0)}


def test_resolve(spark):
    cache = spark.createDataFrame([("1", "Sailor", ["Ada Quill"], "Ada Quill"), ("2", "Sailor", ["Ada Fenn", "Addie"], "Ada Fenn"), ("3", "Barge", ["Ada"], "Ada")], "node_id string, label string, name_values array<string>, display_name string")
    spans = spark.createDataFrame([("q", "Ada"), ("q", "Qiull Ada"), ("q", "Nobody")], "question_id string, span string")
    labels = spark.createDataFrame([("q", "Port")], "question_id string, label string")
    got = {(r["span"], r["node_id"]): round(r["posterior"], 3) for r in entities.resolve(spans, cache, labels, forced=("Sailor",)).collect()}
    assert got[("Ada", "1")] == got[("Ada", "2")] == 0.5 and ("Ada", "3") not in got and ("Nobody", "1") not in got
    assert ("Qiull Ada", "1") in got


def test_row_sets(spark):
    a = spark.createDataFrame([(1, 0.1234561, ["x", "y"], "t"), (2, None, None, None)], "i int, d double, l array<string>, s string")
    same = spark.createDataFrame([(2, None, None, None), (1, 0.1234562, ["x", "y"], "t"), (2, None, None, None)], "p int, q double, r array<string>, s2 string")
    other = spark.createDataFrame([(1, 0.12, ["y", "x"], "t"), (2, None, None, None)], a.schema)
    equal = lambda x, y: evaluate.row_sets_equal(x, y).first()["equal"]
    assert equal(a, same) and not equal(a, other) and equal(a.limit(0), other.limit(0)) and not equal(a, a.select("i"))
    assert evaluate.fingerprint(a).first()["fingerprint"] == evaluate.fingerprint(same).first()["fingerprint"] != evaluate.fingerprint(other).first()["fingerprint"]


def test_auc(spark):
    def auc(scores, labels):
        df = spark.createDataFrame(list(zip(map(float, scores), labels, strict=True)), "s double, y boolean")
        return stats.roc_auc(df, "s", F.col("y")).first()["auc"]

    assert auc([1, 2, 3, 4], [False, False, True, True]) == 1.0
    assert auc([4, 3, 2, 1], [False, False, True, True]) == 0.0
    assert auc([1, 1], [False, True]) == 0.5 and auc([1, 2], [True, True]) == 0.5
    assert auc([1, 2, 2, 3, 4], [False, False, True, True, True]) == pytest.approx(5.5 / 6)


def test_nearest_rank(spark):
    row = stats.nearest_rank(spark.createDataFrame([(float(i),) for i in range(1, 11)], "v double"), "v").first()
    assert (row["count"], row["p50"], row["p90"], row["p95"], row["p99"], row["max"]) == (10, 5.0, 9.0, 10.0, 10.0, 10.0)


def test_split_and_gates(spark):
    df = spark.createDataFrame([(i,) for i in range(137)], "id int")
    parts = prep.split(df, "id")
    assert parts.where("part = 'eval'").count() == 13 and parts.count() == 137
    rows = spark.createDataFrame([(1, "Who  IS it?"), (2, "who is it?"), (3, "who is at home?"), (4, "where is the car")], "id int, q string")
    assert [r["id"] for r in prep.first_wins(rows, "q", ["id"]).orderBy("id").collect()] == [1, 3, 4]
    assert sorted(tuple(r) for r in prep.first_wins(rows, "q", ["id"], ["q", "id"]).collect()) == [("Who  IS it?", 1), ("where is the car", 4), ("who is at home?", 3)]
    blocked = spark.createDataFrame([("Where is the cars",), ("WHO is it?",)], "b string")
    assert [r["id"] for r in prep.disjoint(rows, blocked, "q", "b").orderBy("id").collect()] == [3]


V3 = GraphSchema(
    ["Person", "Incident", "Case", "Location", "Vehicle", "Phone"],
    [PathDecl(t, "Person", "Incident") for t in ("SUSPECTED_OF", "WITNESSED", "VICTIM_OF", "INVESTIGATES")]
    + [PathDecl("CONTAINS", "Case", "Incident"), PathDecl("OCCURRED_AT", "Incident", "Location"), PathDecl("LIVES_AT", "Person", "Location"), PathDecl("OWNS", "Person", "Vehicle"), PathDecl("USES_PHONE", "Person", "Phone"), PathDecl("CALLED", "Phone", "Phone"), PathDecl("ASSOCIATED_WITH", "Person", "Person")],
)


def test_walks(spark):
    step = walks.moves(spark, V3, frozenset({"ASSOCIATED_WITH"}), frozenset({"LIVES_AT", "OWNS", "USES_PHONE", "ASSOCIATED_WITH"}))
    w = walks.walks(step)
    assert w.where("active_pos is null").count() == 463 and w.count() == 840
    short = {"Person": "p", "Incident": "i", "Case": "c", "Location": "l", "Vehicle": "v", "Phone": "ph"}
    texts = {r["t"] for r in w.select(walks.render(F.col("start"), F.col("hops"), F.col("active_pos"), short).alias("t")).collect()}
    assert len(texts) == 840 and "(p:Person)-[:ASSOCIATED_WITH {active:true}]-(p2:Person)-[:OWNS]->(v:Vehicle)" in texts


@pytest.mark.parametrize(
    ("condition", "steps", "extra", "want"),
    [
        ("baseline", ["accept"], {}, dict(failed=False, retry_count=0, generations=1, links=0, first_flags="1")),
        ("baseline", ["syntax", "syntax", "accept"], {}, dict(failed=False, generations=3, feedbacks="011")),
        ("baseline", ["syntax"], {}, dict(failed=True, reason="max_syntax_retries_exhausted", generations=3, evaluations=0)),
        ("disambiguation_enhanced", ["schema", "accept"], {}, dict(links=2, retry_count=1, commits=1, feedbacks="01")),
        ("disambiguation_enhanced", ["schema"], {}, dict(failed=True, reason="max_schema_retries_exhausted", links=4, retry_count=3)),
        ("disambiguation_enhanced", ["accept"], dict(outcomes=["wrong_result", "correct"]), dict(evaluations=2, first_flags="10", retry_count=0)),
        ("disambiguation_enhanced", ["accept"], dict(ambiguous=True, exhausted_at=1), dict(failed=False, evaluations=0, generations=0)),
        ("schema_grounded", ["accept"], dict(linked=False), dict(failed=True, reason="schema_linker_no_valid_beams", links=1)),
    ],
)
def test_retry(condition, steps, extra, want):
    got = retry.fold(condition, steps, **extra)
    assert {k: got[k] for k in want} == want


def test_retry_frame(spark):
    rows = [("a", "baseline", i, v, None, True, False, None) for i, v in enumerate(["syntax", "accept"])] + [("b", "baseline", 0, "schema", None, True, False, None)]
    df = spark.createDataFrame(rows, "question_id string, condition string, step int, verdict string, outcome string, linked boolean, ambiguous boolean, exhausted_at int")
    got = {r["question_id"]: (r["failed"], r["generations"]) for r in retry.run(df).collect()}
    assert got == {"a": (False, 2), "b": (True, 4)}


def test_benchmark(spark, tmp_path):
    ok = dict(question_id="1", question="q", num_hops=1, is_ambiguous=False, ambiguity_type=None, default_interp="d", cypher_default="MATCH (a) RETURN a", interpretations=[])
    items = [ok, ok | dict(question_id="2", ambiguity_type=""), ok | dict(question_id="3", is_ambiguous=True), ok | dict(question_id="4", is_ambiguous=True, ambiguity_type="schema", interpretations=[dict(interp="i", cypher="MATCH (b) RETURN b")])]
    path = tmp_path / "b.json"
    path.write_text(json.dumps(items))
    df = benchmark.read_benchmark(spark, str(path))
    assert {(r["question_id"], r["rule"]) for r in benchmark.violations(df).collect()} == {("2", "illegal type"), ("2", "flag and type disagree"), ("3", "flag and type disagree"), ("3", "ambiguous without interpretations")}
    assert benchmark.labelled_queries(df).where("question_id = '4'").count() == 2 and benchmark.ambiguous_items(df).count() == 2
    with pytest.raises(Exception, match="illegal type|disagree"):
        benchmark.read_benchmark(spark, str(path), strict=True).collect()
    benchmark.write_jsonl(spark.createDataFrame([("p", "é")], benchmark.TRAINING), str(tmp_path / "t"))
    assert benchmark.read_jsonl(spark, str(tmp_path / "t")).first()["completion"] == "é"


def test_streams(spark, tmp_path):
    from quillgraph.streaming import events as E

    rows = [(i % 5, f"2024-01-0{1 + i % 3} 10:00:00", "view", float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp_ntz("ts"))
    df.write.parquet(str(tmp_path / "in"))
    for name, stream in (("dedup", E.deduplicated(E.read_events(spark, str(tmp_path / "in"), 100))), ("days", E.windowed(E.read_events(spark, str(tmp_path / "in"), 100)))):
        q = stream.writeStream.format("memory").queryName(name).outputMode("append" if name == "dedup" else "complete").option("checkpointLocation", str(tmp_path / f"c{name}")).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert spark.table("dedup").count() == 5 and spark.table("days").agg(F.sum("n")).first()[0] == 10


def test_disjoint_is_complete(spark):
    """Every pair is held against token_set() itself: reordered, added, joined and misspelt words."""
    texts = ["ring small", "small ring in a box", "smallring", "smal ring", "small rings", "big ring", "a", "", None, "where is the nearest stations please", "stations please where the nearest is", "something else"]
    blocks = ["Small  RING", "where is the nearest station please", "ab", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, q string")
    blocked = spark.createDataFrame([(b,) for b in blocks], "b string")
    norm = strings.normalised_question
    pairs = rows.crossJoin(blocked).where((norm("q") == norm("b")) | (strings.token_set(norm("q"), norm("b")) >= 0.9))
    gone = {r["id"] for r in pairs.collect()}
    assert {r["id"] for r in prep.disjoint(rows, blocked, "q", "b").collect()} == set(range(len(texts))) - gone
    assert gone >= {0, 1, 3, 4, 7, 9, 10} and not gone & {2, 5, 6, 8, 11}


def test_resolve_is_complete(spark):
    """Every pair at the threshold, errors at the start of a name and short names among them."""
    texts = ["johnson", "smith", "katherine", "steven", "aXbYc", "ab", "Mary Anne Lee"]
    names = ["jhonson", "msith", "catherine", "estevan", "abc", "ba", "b", "maryanne lee", "Anne", "lee mary", "unrelated"]
    spans = spark.createDataFrame([("q", t) for t in texts], "question_id string, span string")
    cache = spark.createDataFrame([(n, "Person", [n], n) for n in names], "node_id string, label string, name_values array<string>, display_name string")
    every = spans.crossJoin(cache).withColumn("s", strings.token_set(F.col("span"), F.col("node_id")))
    for least in (0.75, 0.6):
        want = {(r["span"], r["node_id"]): r["s"] for r in every.where(F.col("s") >= least).collect()}
        got = {(r["span"], r["node_id"]): r["match_score"] for r in entities.resolve(spans, cache, threshold=least, most=99).collect()}
        assert got == want
        assert {("johnson", "jhonson"), ("smith", "msith"), ("katherine", "catherine"), ("steven", "estevan"), ("aXbYc", "abc")} <= set(got)


@pytest.mark.parametrize("ratio", [0.6, 0.82, 0.9, 1.0])
def test_similarity_join_equals_all_pairs(spark, ratio):
    """Random texts and variants of them, with words left out, added, joined, cut and misspelt: no pair is missed."""
    import random

    from quillgraph.operators import similar

    rng = random.Random(int(ratio * 100))
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.choice([1, 2, 3, 5, 6, 8, 11, 40]))) for _ in range(60)]

    def vary(t):
        w = t.split(" ")
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w))
            how = rng.randrange(6)
            if how == 0:
                w.insert(i, rng.choice(vocab))
            elif how == 1 and len(w) > 1:
                del w[i]
            elif how == 2 and i:
                w[i - 1 : i + 1] = [w[i - 1] + w[i]]
            elif how == 3:
                k = rng.randrange(len(w[i]) + 1)
                w[i] = w[i][:k] + rng.choice("abz") + w[i][k:]
            elif how == 4 and len(w[i]) > 1:
                k = rng.randrange(len(w[i]))
                w[i] = w[i][:k] + w[i][k + 1 :]
            else:
                rng.shuffle(w)
        return " ".join(w)

    blocks = list({" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 14))) for _ in range(60)})
    texts = list({vary(rng.choice(blocks)) for _ in range(500)} | {" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 30))) for _ in range(100)} | {"", " "})
    t = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    b = spark.createDataFrame([(x,) for x in blocks], "text string")
    want = {i for i, x in enumerate(texts) if any(similar.near_pair(x, y, ratio) for y in blocks)}
    assert {r["key"] for r in similar.near_any(t, b, ratio).collect()} == want and 100 < len(want) < len(texts) + (ratio < 0.7)
    # the exact test is token_set() itself
    some = spark.createDataFrame([(i, texts[i], rng.choice(blocks)) for i in range(0, len(texts), 9)], "i long, a string, b string")
    for r in some.select("a", "b", (strings.token_set(F.col("a"), F.col("b")) >= ratio).alias("near")).collect():
        assert similar.near_pair(r["a"], r["b"], ratio) == r["near"]


@pytest.mark.parametrize("parts", [1, 5])
def test_similar_sets_equals_alignment_by_hand(spark, parts):
    """Places of sorted rows, repeats and all, under any dealing out; identifiers and numbers are exact."""
    import random

    rng = random.Random(parts)
    where = {"red": [1.0, 0.0], "crimson": [0.99, 0.05], "green": [0.0, 1.0], "AB-001": [1.0, 0.0], "AB-002": [1.0, 0.0]}

    def draw(n, words):
        return [(rng.randrange(3), rng.choice(words)) for _ in range(n)]

    def by_hand(a, b):
        order = lambda rows: sorted(rows, key=lambda r: (sorted(map(str, r)), list(map(str, r))))
        cos = lambda x, y: sum(p * q for p, q in zip(where[x], where[y], strict=True)) / (sum(p * p for p in where[x]) * sum(p * p for p in where[y])) ** 0.5
        fits = lambda x, y: x == y or ("-" not in x + y and cos(x, y) >= 0.95)
        unlike = sum(not (x[0] == y[0] and fits(x[1], y[1])) for x, y in zip(order(a), order(b), strict=False))
        return (len(a), len(b), unlike, unlike == 0 and len(a) == len(b))

    cases = [(draw(40, ["red", "green"]), draw(40, ["crimson", "green"])), (draw(30, list(where)), draw(33, list(where))), ([(1, "red")] * 9 + [(2, "red")], [(1, "crimson")] * 9 + [(2, "red")]), ([(1, "AB-001")], [(1, "AB-002")]), ([], []), ([], [(1, "red")])]
    for a, b in cases:
        frames = [spark.createDataFrame([(n, t, where[t]) for n, t in rows], "n long, t string, e array<double>").repartition(parts) for rows in (a, b)]
        assert tuple(evaluate.similar_sets(*frames, ["n", "t"], {"t": "e"}).first()) == by_hand(a, b)


def test_entropies_do_not_depend_on_the_order_of_rows(spark):
    """Equal multisets of counts or scores have the same entropy to the last bit, however the rows are dealt out."""
    import math

    rows = [(q, f"b{(i * (7 if q % 2 else 3)) % 11}", 1.0 / (1 + (i * (5 if q % 2 else 9)) % 13)) for q in range(6) for i in range(143)]
    base = spark.createDataFrame(rows, "q long, beam string, score double")
    seen = set()
    for parts in (1, 3, 17):
        for df in (base.repartition(parts), base.orderBy(F.desc("score"), "beam"), base.orderBy("beam")):
            e = ambiguity.entropy_of_beams(df, ["q"], "beam").collect()
            c = ambiguity.entropy_of_candidates(df, ["q"], "score").collect()
            seen |= {("beam", r["entropy"]) for r in e} | {("candidate", r["entropy"]) for r in c}
    assert len(seen) == 2
    found = dict(seen)
    assert abs(found["beam"] - math.log(11) / math.log(143)) < 1e-12
    p = [1 / (1 + i) for i in range(13)]
    want = -sum(x / sum(p) / 11 * math.log2(x / sum(p) / 11) for x in p) * 11 / math.log2(143)
    assert abs(found["candidate"] - want) < 1e-12


@pytest.mark.parametrize("parts", [1, 4, 200])
def test_settings_under_any_partitioning(spark, parts):
    rows = [(s, i, ("abc"[(i * k + s) % 3] if i % 2 else "abcd"[k % (1 + i % 4)]), ["a"]) for s in range(2) for i in range(40) for k in range(1 + i % 7)]
    b = spark.createDataFrame(rows, "setting long, item long, sig string, names array<string>").repartition(parts)
    gold = spark.createDataFrame([(i, "a") for i in range(40)], "item long, sig string")
    flags = spark.createDataFrame([(i, i % 2 == 0) for i in range(40)], "item long, is_ambiguous boolean")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r["setting"]: r["auc"] for r in stats.score_settings(b, gold, flags, "sig", "names", F.array(F.lit("a"))).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    import math
    from collections import Counter

    for s in range(2):
        e = {}
        for i in range(40):
            c = Counter(r[2] for r in rows if r[:2] == (s, i))
            n = sum(c.values())
            e[i] = round(1 - sum(x * math.log(x) for x in c.values()) / (n * math.log(n)), 10) if n > 1 else 0.0
        pairs = [(a, b) for a in range(0, 40, 2) for b in range(1, 40, 2)]
        want = sum((e[a] > e[b]) + 0.5 * (e[a] == e[b]) for a, b in pairs) / len(pairs)
        assert abs(got[s] - want) < 1e-12


def test_equal_results_whatever_the_order_of_rows(spark, monkeypatch):
    """Sums that are computed twice are equal, though rows come in another order each time."""
    import random

    from quillgraph.queries import evaluation

    dice = F.udf(lambda _: random.random(), "double").asNondeterministic()
    rows = spark.range(20000).select(F.lit("A").alias("l_returnflag"), F.lit("F").alias("l_linestatus"), (F.col("id") * 997.13 + 0.37).alias("l_extendedprice"))
    monkeypatch.setattr(evaluation, "table", lambda *_: rows.withColumn("d", dice("l_extendedprice")).repartitionByRange(4, "d"))
    # without reuse rows are dealt anew for either side, as on a cluster blocks arrive in any order
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        found = evaluation.x_rowset_equal(spark, "").collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert {r["pair"]: r["equal"] for r in found}["rounding"]


def test_pieces_are_cut_once_a_text(spark):
    """The greatest length that gives enough pieces is found once a text: with a search for each word 4,000 texts of 60 words took over 100 s."""
    import time

    from pyspark.sql import functions as F

    from quillgraph.operators import similar

    words = F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.substr(F.md5((F.col("id") * 100 + i).cast("string")), F.lit(1), (i % 9 + 2).cast("int")))
    texts = spark.range(0, 4000, 1, 1).select(words.alias("words"))
    began = time.time()
    sizes = texts.select(F.size(similar._pieces(F.col("words"), F.lit(40))).alias("n")).agg(F.min("n"), F.max("n")).first()
    assert tuple(sizes)[1] == 40 and time.time() - began < 30


def test_similar_sets_counts_rows_without_sorting_them(spark, capsys, monkeypatch):
    """Repeats are counted by hash and places meet in one window: no aggregation sorts rows to carry their values along."""
    from pyspark.sql import functions as F

    from quillgraph.operators import evaluate

    write, plans = evaluate.materialise, []

    def seen(df):
        df.explain()
        plans.append(capsys.readouterr().out)
        return write(df)

    monkeypatch.setattr(evaluate, "materialise", seen)
    rows = spark.range(60).select((F.col("id") % 7).alias("n"), F.concat(F.lit("t"), F.col("id") % 3).alias("t"), F.array(F.lit(1.0), F.lit(2.0)).alias("e"))
    out = evaluate.similar_sets(rows, rows.withColumn("t", F.concat("t", F.lit("!"))), ["n", "t"], {"t": "e"})
    out.explain()
    plans.append(capsys.readouterr().out)
    assert tuple(out.first()) == (60, 60, 0, True)
    assert len(plans) == 5 and not any("SortAggregate" in p for p in plans)
