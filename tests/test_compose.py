"""Composed steps, lookups and sources that no query covers."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import candidates, compose, gates, metrics, retry, stats
from quillgraph.plans.catalog import GraphSchema, PathDecl
from quillgraph.plans.lexer import CypherError
from quillgraph.plans.session import GraphSession
from quillgraph.sources import benchmark
from quillgraph.sources.seeds import load_seed

SCHEMA = GraphSchema(["Ship", "Port", "Crew"], [PathDecl("AT", "Ship", "Port"), PathDecl("SERVES", "Crew", "Ship")], {"Ship": ["name"], "Crew": ["rank"], "AT": ["since"]})


def test_decoding():
    assert compose.beam(5, 1.5).settings() == {"strategy": "beam", "k": 5, "diversity_penalty": 1.5}
    assert compose.sampling(3, 0.2, 0.9).settings() == {"strategy": "sample", "k": 3, "temperature": 0.2, "top_p": 0.9}
    for wrong in (dict(strategy="beam", temperature=1.0), dict(strategy="sample", diversity_penalty=1.0), dict(strategy="greedy"), dict(strategy="beam", k=0)):
        with pytest.raises(ValueError):
            compose.Decoding(**wrong)


def test_committed_elements(spark):
    p = spark.createDataFrame(
        [("a", "(c:Crew)-[:SERVES {active:true}]->(s:Ship)"), ("b", "(s:Ship)<-[:SERVES {active:true}]-(c:Crew)"), ("c", "(s:Ship)-[:AT]->(p:Port), (x:Crew)"), ("d", "(s:Ship)-[r]-(p:Port)"), ("e", "no pattern (")],
        "question_id string, pattern string",
    )
    have = spark.createDataFrame(
        [("a", "relationship_type", "SERVES", "Crew", "Ship", True), ("b", "relationship_type", "SERVES", "Crew", "Ship", False), ("b", "node_label", "Ship", None, None, False)],
        "question_id string, element_type string, name string, source_label string, target_label string, active boolean",
    )
    got = {(r["question_id"], r["slot"]): (r["name"], r["active"], r["origin"]) for r in candidates.committed_elements(p, have).collect()}
    assert got == {
        ("a", "rel_1"): ("SERVES", True, "exact"), ("b", "rel_1"): ("SERVES", False, "plain"), ("c", "rel_1"): ("AT", False, "new"), ("c", "node_1"): ("Crew", False, "new"),
        ("d", "node_1"): ("Ship", False, "new"), ("d", "node_2"): ("Port", False, "new"),
    }


def test_pruned():
    small = candidates.pruned(SCHEMA, [("AT", "Ship", "Port")])
    assert small.labels == ["Ship", "Port"] and small.types == ["AT"] and small.props == {"Ship": ["name"], "AT": ["since"]}


def test_interactive_mode_raises(spark):
    with pytest.raises(ValueError):
        compose.disambiguate(spark.range(1), spark.range(1), benchmark.RecordedCompletions(spark.range(1)), "", mode="interactive")


def test_retry_remembers_what_was_tried():
    out = retry.fold("disambiguation_enhanced", ["accept"], ambiguous=True, outcomes=["wrong_result", "correct"], choices=["x", "x", "y"])
    assert out["tried"] == ["x", "y"] and out["commits"] == 2 and out["verdict"] == "accept"
    over = retry.fold("disambiguation_enhanced", ["schema"], ambiguous=True, choices=["x"])
    assert over["tried"] == ["x"] and over["commits"] == 2 and over["generations"] == 1


def test_blocklist_and_beams(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"question": "Who?", "x": 1}, {"x": 2}]))
    got = compose.blocklist(spark, str(tmp_path / "a.json"), str(tmp_path / "absent.json"))
    assert [r["question"] for r in got.collect()] == ["Who?"]
    rows = [("q", "schema_linker", 0, 1, "t", -1.0), ("q", "disambiguator", 1, 1, "u", 0.0)]
    beams = benchmark.cache_beams(spark.createDataFrame(rows, benchmark.COMPLETION), str(tmp_path / "beams"))
    assert sorted(tuple(r) for r in beams.collect()) == sorted(rows) and benchmark.load_beams(spark, str(tmp_path / "beams")).where("stage = 'schema_linker'").count() == 1


def test_merge_config(tmp_path):
    for name in ("c.json", "c.yaml"):
        if name.endswith("yaml"):
            pytest.importorskip("yaml")
        path = str(tmp_path / name)
        benchmark.merge_config(path, "a", {"k": 5})
        assert benchmark.merge_config(path, "b", [1]) == {"a": {"k": 5}, "b": [1]} == benchmark.merge_config(path, "b", [1])


def test_read_split(spark, tmp_path):
    spark.createDataFrame([("q", "s", "c", 1)], "question string, schema string, cypher string, extra int").write.parquet(str(tmp_path / "train"))
    assert benchmark.read_split(spark, str(tmp_path / "train")).columns == ["question", "schema", "cypher"]


def test_gates(spark):
    q = spark.createDataFrame([("MATCH (s:Ship) RETURN s.name",), ("MATCH (s:Ship RETURN s",), ("MATCH (s:Boat) RETURN s",), (None,)], "cypher string")
    syntax, schema = gates.invalid(q, SCHEMA)
    assert syntax.count() == 2 and [r["cypher"] for r in schema.collect()] == ["MATCH (s:Boat) RETURN s"]


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_running_sums(spark, monkeypatch, few):
    """Against a plain cumulative sum, with and without keys, by ranges and by one window a key."""
    monkeypatch.setattr(stats, "FEW_VALUES", few)
    rows = [(i % 3, float((i * 37) % 500), 1 + i % 4) for i in range(1500)]
    grid = spark.createDataFrame(rows, "k int, v double, n int").groupBy("k", "v").agg(F.sum("n").alias("n"))
    want = {(r["k"], r["v"]): r["n"] for r in grid.collect()}
    for keys in (["k"], []):
        df = grid if keys else grid.groupBy("v").agg(F.sum("n").alias("n"))
        for r in stats.running(df, keys, "v", "n").collect():
            mine = {x: n for x, n in want.items() if not keys or x[0] == r["k"]}
            assert r["_upto"] == sum(n for x, n in mine.items() if x[1] <= r["v"]) and r["_all"] == sum(mine.values())


def test_rendered_tables(spark):
    m = spark.createDataFrame([("baseline", 4.0, 0.5, float("nan")), ("disambiguation_enhanced", 4.0, 0.75, 0.5)], "condition string, n_total double, ex double, f1 double")
    text = metrics.render_tables(m)
    assert "## Answers" in text and "| ex | 50.0 | 75.0 |" in text and "| f1 | - | 50.0 |" in text
    assert {(r["title"], r["metric"]) for r in metrics.tables(m).collect()} == {("Answers", "n_total"), ("Answers", "ex"), ("Ambiguity", "f1")}


def test_cypher_expressions(spark):
    session = GraphSession(spark, load_seed(spark, "CREATE (:Ship {ship_id:'S1', name:'Ada.Bo', tons:3});\nCREATE (:Ship {ship_id:'S2', name:'Cy', tons:9});"))
    one = lambda text: [tuple(r) for r in session.cypher(text).collect()]
    assert one("MATCH (s:Ship) RETURN CASE WHEN s.tons > 5 THEN 'big' ELSE 'small' END AS x ORDER BY x") == [("big",), ("small",)]
    assert one("MATCH (s:Ship) RETURN CASE s.name WHEN 'Cy' THEN 1 END AS x ORDER BY x") == [(1,), (None,)]
    assert one("MATCH (s:Ship {ship_id:'S1'}) RETURN split(s.name, '.') AS x, substring(s.name, 1) AS y, substring(s.name, 0, 3) AS z") == [(["Ada", "Bo"], "da.Bo", "Ada")]
    assert one("MATCH (s:Ship {ship_id:'S1'}) RETURN [1, 2] + [3] AS x, [1] + 2 AS y, exists(s.name) AS z") == [([1, 2, 3], [1, 2], True)]
    with pytest.raises(CypherError):
        one("MATCH (s:Ship) RETURN substring(s.name) AS x")


def test_timeout(spark):
    from quillgraph.plans.catalog import Graph, NodeTable

    slow = spark.range(200_000).repartition(4).where("sha2(repeat(cast(id as string), 20000), 512) <> ''")
    out = GraphSession(spark, Graph([NodeTable("N", "id", slow)], [])).execute("MATCH (n:N) RETURN count(*) AS n", timeout_s=0.3)
    assert not out.success and "timed out" in out.error and out.rows == []
