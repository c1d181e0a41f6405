from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import patterns as P
from quillgraph.functions import prompts, strings
from quillgraph.operators import candidates
from quillgraph.plans.catalog import GraphSchema, PathDecl


@pytest.mark.parametrize(
    ("cypher", "pattern"),
    [
        ("MATCH (p:Sailor {name:'x'})-[:OWNS]->(v:Barge) RETURN v", "(p:Sailor)-[:OWNS]->(v:Barge)"),
        ("MATCH (p)-[l:MOORED_AT {active:TRUE, from_date:date('2020-01-01')}]-(x) RETURN x", "(p)-[l:MOORED_AT {active:true, from_date}]-(x)"),
        ("MATCH (a), (b {hidden:false, n:3}) MATCH (c)<-[:T]-(d) WITH c RETURN c", "(a), (b {hidden:false})\n(c)<-[:T]-(d)"),
        ("OPTIONAL MATCH (a {s:'MATCH (x'})--(b) WHERE a.x = ') RETURN' RETURN a", "(a)--(b)"),
        ("match (a)-->(b) return a", "(a)-->(b)"),
        ("RETURN 1", None),
        ("MATCH (a RETURN a", None),
        ("", None),
        (None, None),
    ],
)
def test_schema_pattern(cypher, pattern):
    assert P.schema_pattern(cypher) == pattern


def test_parse_pattern():
    got = P.parse_pattern("(p:Sailor)-[r:OWNS {active:true}]->(:Barge), (x)<-[]-(y:Z)--")
    assert got["ok"] and [n["label"] for n in got["nodes"]] == ["Sailor", "Barge", None, "Z"]
    assert [(r["type"], r["direction"], r["active"]) for r in got["rels"]] == [("OWNS", "->", True), (None, "<-", False)]
    assert not P.parse_pattern("(a")["ok"] and not P.parse_pattern("")["ok"]


@pytest.mark.parametrize(
    ("text", "found"),
    [("so {\"a\": {\"b\": 1}} and {", '{"a": {"b": 1}}'), ('```json\n{"a": "}"}\n```', '{"a": "}"}'), ("{bad} {\"a\": 1}", None), ("none", None), (None, None), ("[1]", None)],
)
def test_json_object(text, found):
    got = P.json_object(text)
    assert (got and got.strip()) == found


def test_clean_cypher(spark):
    cases = {
        "Sure:\n```cypher\nMATCH (a)\\nRETURN a\n```\nbye": "MATCH (a)\nRETURN a", "Here it is\nMATCH (a)\nRETURN a\n\nIt finds a.": "MATCH (a)\nRETURN a", "```\nno statement\n```": "no statement",
        "```Cypher\nwith 1 AS x\n  RETURN x```": "with 1 AS x\n  RETURN x", "an open ```\nMATCH (b)": "MATCH (b)", "": "", "  prose only \n": "prose only", "CALL x()\r\nYIELD y\n \t\nRETURN z": "CALL x()\nYIELD y",
    }
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert [r for r in df.select(P.clean_cypher("t").alias("got"), "want").collect() if r["got"] != r["want"]] == []
    assert spark.createDataFrame([(None,)], "t string").select(P.clean_cypher("t").alias("x")).first()["x"] is None


def test_referenced_names(spark):
    q = "MATCH (a:Ship:Vessel {n:'x'})-[r:SAILS|:TOWS*1..3 {k:1}]->(:`Old Port`)<-[:AT]-(c) WHERE a.x > 1 RETURN c"
    row = spark.createDataFrame([(q,)], "q string").select(*(c.alias(n) for c, n in zip(P.referenced_names("q"), ("labels", "types")))).first()
    assert (row["labels"], row["types"]) == (["Old Port", "Ship", "Vessel"], ["AT", "SAILS", "TOWS"])


def test_columns(spark):
    df = spark.createDataFrame([("\n  \n a \nb", "MATCH (x)-[r:A_B|C]->(y)<-[:A_B]-(z)", "( p : Sailor)-[r:T]->()")], "t string, q string, p string")
    row = df.select(
        P.first_line("t").alias("line"), P.relationship_types("q").alias("types"), P.relationship_count("q").alias("n"), P.has_relationship_type("p").alias("typed"),
        P.normalised_pattern(F.lit("(p:Sailor) -[r:T]-> (x:Y)")).alias("norm"), strings.normalised_question(F.lit("  Who\n IS it ")).alias("q2"),
        strings.is_id(F.lit(" SAI-001 ")).alias("id"), strings.is_id(F.lit("P-1")).alias("no"),
    ).first()
    assert tuple(row) == ("a", ["A_B", "C"], 2, True, "(:Sailor)-[:T]->(:Y)", "who is it", True, False)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(max(new[-1], row[j], row[j - 1] + (x == y)))
        row = new
    return row[-1]


def brute_token_set(a, b):
    x, y = sorted(set(a.lower().split())), sorted(set(b.lower().split()))
    if not x or not y:
        return 0.0
    both, oa, ob = [t for t in x if t in y], [t for t in x if t not in y], [t for t in y if t not in x]
    if both and (not oa or not ob):
        return 1.0
    ind = lambda p, q: 2 * lcs(p, q) / (len(p) + len(q)) if p or q else 1.0
    c, wa, wb = " ".join(both), " ".join(both + oa), " ".join(both + ob)
    return max(ind(wa, wb), ind(" ".join(oa), " ".join(ob)) if not both else 0, *((ind(c, wa), ind(c, wb)) if both else (0,)))


def test_token_set(spark):
    names = ["James Whitfield", "whitfield james", "Jim Whitfeld", "James", "Anna B", "", "operation night owl", "night owl"]
    rows = [(a, b) for a in names for b in names]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", strings.token_set(F.col("a"), F.col("b")).alias("s")).collect()
    for r in got:
        assert r["s"] == pytest.approx(brute_token_set(r["a"], r["b"])), r


SCHEMA = GraphSchema(["Sailor", "Storm"], [PathDecl(t, "Sailor", "Storm") for t in ("SAILED_IN", "LOGGED", "LOST_IN")])


def mapping(spark, texts, scores=None):
    rows = [("q", i + 1, t, float((scores or [-1.0] * len(texts))[i])) for i, t in enumerate(texts)]
    return candidates.candidate_mapping(spark.createDataFrame(rows, "question_id string, rank int, text string, score double"), SCHEMA)


def test_candidates_merge_and_rank(spark):
    p = "(p:Sailor)-[:{}]->(i:Storm)"
    got, status = mapping(spark, [p.format(t) for t in ("SAILED_IN", "LOGGED", "SAILED_IN", "LOST_IN", "NO_SUCH")])
    rows = {r["name"]: (r["slot"], r["rank"], round(r["prob"], 6)) for r in got.collect()}
    assert rows == {"SAILED_IN": ("rel_1", 1, 0.5), "LOGGED": ("rel_1", 2, 0.25), "LOST_IN": ("rel_1", 3, 0.25)}
    assert tuple(status.first())[1:] == (5, 4, "ok")


def test_candidates_agree_and_temporal(spark):
    same, _ = mapping(spark, ["(p:Sailor)-[:LOGGED]->(i:Storm)", "(i:Storm)<-[:LOGGED]-(p:Sailor)"][:1] * 2)
    assert {(r["slot"], r["prob"]) for r in same.collect()} == {("rel_1", 1.0), ("node_1", 1.0), ("node_2", 1.0)}
    temporal, _ = mapping(spark, ["(p:Sailor)-[:LOGGED]->(i:Storm)", "(p:Sailor)-[:LOGGED {active:true}]->(i:Storm)"])
    assert {(r["slot"], r["active"]) for r in temporal.collect()} == {("rel_1_temporal", True), ("rel_1_temporal", False)}
    none, status = mapping(spark, ["(p)-[r]->(i:Storm)", "nothing"])
    assert none.count() == 0 and status.first()["status"] == "no_valid_beams"


def test_prompt_pieces(spark):
    row = spark.range(1).select(prompts.paraphrases(F.lit("1. a?\n\n2) b?\nc"), 2).alias("p"), prompts.tried_block(F.array().cast("array<string>")).alias("t")).first()
    assert row["p"] == ["a?", "b?"] and row["t"] == "none"


def test_prompt_decimals(spark):
    """Scores are rounded as doubles are printed: 0.845 is less than it says, and ties go to the even digit."""
    values = [0.125, 0.375, 0.845, 0.005, 1.0, 0.0]
    one = lambda *names: F.array(*(F.struct(*(F.lit("x").alias(n) for n in names[:-1]), F.lit(v).alias(names[-1])) for v in values))
    slots = F.array(F.struct(F.lit("s").alias("slot"), one("text", "prob").alias("candidates")))
    spans = F.array(F.struct(F.lit("s").alias("span"), one("label", "name", "posterior").alias("candidates")))
    row = spark.range(1).select(prompts.candidate_block(slots).alias("c"), prompts.entity_block(spans).alias("e")).first()
    assert row["c"] == "\n".join(["s:", *(f"  - x ({v:.2f})" for v in values)])
    assert row["e"] == "\n".join(['"s":', *(f"  - x x ({v:.2f})" for v in values)])


def test_pattern_rows(spark):
    """The table function gives the rows that the parsed pattern exploded gives, in a lateral join."""
    from quillgraph.functions import tables

    texts = ["(a:A)-[:R {active:true}]->(b:B), (c)--(:D)", "(a)<-[r:S]-()", "", None, "(a", "no pattern", "(a:A)-[:R]->(b)-[:T]-(c:C)"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = sorted(map(tuple, df.select("id", F.inline(tables.parts_of(F.col("text")))).collect()), key=str)
    got = df.lateralJoin(tables.pattern_rows(F.col("text").outer())).drop("text")
    assert sorted(map(tuple, got.collect()), key=str) == want and len(want) == 14
    tables.register(spark)
    df.createOrReplaceTempView("pattern_texts")
    sql = spark.sql("SELECT id, p.* FROM pattern_texts t, LATERAL pattern_rows(t.text) p")
    assert sorted(map(tuple, sql.collect()), key=str) == want


def test_rows_of_patterns_are_parsed_by_batches(spark, tmp_path):
    """No Python call for each row: the plan has a vectorised parser and no table function."""
    from quillgraph.queries import linking

    spark.sql("SELECT 1L AS event_id, 2L AS user_id, 'view' AS event_type, 60D AS value").write.parquet(f"{tmp_path}/events.parquet")
    rows = linking.p_rows(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "UDTF" not in plan and "ArrowEvalPython" in plan
    assert {(r["kind"], r["pos"], r["name"], r["active"]) for r in rows.collect()} == {("node", 1, "User_2", None), ("node", 2, "Day", None), ("relationship", 1, "VIEW", True)}


def test_hops_are_parsed_once_after_rows_are_dealt(spark, tmp_path):
    """The filter on hops stays above the shuffle that spreads the rows, and the parser is called once."""
    from quillgraph.queries import evaluation

    spark.sql("SELECT id AS event_id, id AS user_id FROM range(20)").write.parquet(f"{tmp_path}/events.parquet")
    rows = evaluation.b_hops(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("Exchange")
    assert {r["event_id"] for r in rows.collect()} == {i for i in range(20) if i % 5 != i % 4 or i % 5 > 3}
