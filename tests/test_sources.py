from __future__ import annotations

import datetime

import pytest

from quillgraph.operators import registry
from quillgraph.plans.catalog import Graph, NodeTable
from quillgraph.plans.session import GraphSession
from quillgraph.sources.scripts import load_scripts
from quillgraph.sources.seeds import load_seed

SCRIPT = """// a harbour; and its people
CREATE CONSTRAINT sailor_id IF NOT EXISTS FOR (p:Sailor) REQUIRE p.sailor_id IS UNIQUE;
CREATE (:Sailor {sailor_id:'S1', name:'Ann; Lee // x', born:date('1980-02-03'), score:1});
CREATE (:Sailor {sailor_id:'S2', name:'Bo', born:null, score:2.5}); CREATE (:Sailor {sailor_id:'S3', name:'O\\'Cy'});
CREATE INDEX coast IF NOT EXISTS FOR (l:Harbour) ON (l.coast);
CREATE (:Harbour {h_id:7, coast:'X', since:datetime('2020-01-01T00:00:00')});
MATCH (p:Sailor {sailor_id:'S1'}), (l:Harbour {h_id:7}) CREATE (p)-[:MOORED_AT {active:true}]->(l);
MATCH (p:Sailor {name:'Bo'}), (l:Harbour {h_id:7}) CREATE (p)-[:MOORED_AT {active:false}]->(l);
MATCH (p:Sailor {sailor_id:'S1'}), (q:Sailor {sailor_id:'S2'}) CREATE (p)<-[:MET]-(q);
MATCH (p:Sailor {sailor_id:'S1'}), (q:Sailor {sailor_id:'S2'}) CREATE (p)<-[:MET]-(q);
MATCH (p:Sailor {sailor_id:'S9'}), (q:Sailor {sailor_id:'S2'}) CREATE (p)-[:MET]->(q);
"""
QUESTIONS = (
    "MATCH (p:Sailor) RETURN p.name AS a, p.born AS b, p.score AS c", "MATCH (p:Sailor)-[m:MOORED_AT]->(l:Harbour) RETURN p.name AS a, m.active AS b, l.since AS c",
    "MATCH (q:Sailor)-[:MET]->(p:Sailor) RETURN q.name AS a, p.name AS b, count(*) AS n",
)


def answers(session):
    return [sorted((tuple(r) for r in session.cypher(q).collect()), key=str) for q in QUESTIONS]


def test_scripts_equal_the_seed_read_whole(spark, tmp_path):
    """Read in parts, statements in two files in any order, against the script read as one text."""
    lines = SCRIPT.splitlines(keepends=True)
    (tmp_path / "a").mkdir()
    (tmp_path / "a/1.cypher").write_text("".join(lines[6:]))
    (tmp_path / "a/2.cypher").write_text("".join(lines[:6]))
    graph = load_scripts(spark, str(tmp_path / "a"))
    got = answers(GraphSession(spark, graph))
    assert got == answers(GraphSession(spark, load_seed(spark, SCRIPT)))
    assert sorted(got[0]) == [("Ann; Lee // x", datetime.date(1980, 2, 3), 1.0), ("Bo", None, 2.5), ("O'Cy", None, None)]
    assert got[1] == [("Ann; Lee // x", True, datetime.datetime(2020, 1, 1)), ("Bo", False, datetime.datetime(2020, 1, 1))]
    assert got[2] == [("Bo", "Ann; Lee // x", 2)]
    assert graph.nodes["Sailor"].id == "sailor_id" and graph.duplicate_ids().count() == 0
    (tmp_path / "a/3.cypher").write_text("DROP EVERYTHING;\n")
    with pytest.raises(ValueError, match="DROP"):
        load_scripts(spark, str(tmp_path / "a"))


def test_registry_versions(spark):
    day = datetime.date
    entries = [("v1", "A", "id", ["old"], [], None, day(2020, 1, 1)), ("v1", "A", "id", ["name"], [], day(2020, 1, 2), None), ("v2", "A", "id", ["name", "old"], ["old"], day(2021, 1, 1), None), ("v3", "A", "id", ["name"], [], day(2030, 1, 1), None)]
    table = spark.createDataFrame(entries, registry.SCHEMA)
    assert registry.resolve(table, ["v1"], day(2019, 5, 5)) == {"v1": {"A": ("id", ["old"], [])}}
    assert registry.resolve(table, ["v1"], day(2022, 5, 5)) == {"v1": {"A": ("id", ["name"], [])}}
    assert list(registry.resolve(table, None, day(2022, 5, 5))) == ["v2"] and list(registry.resolve(table, None, day(2031, 5, 5))) == ["v3"]
    with pytest.raises(ValueError, match="v3"):
        registry.resolve(table, ["v1", "v3"], day(2022, 5, 5))
    graph = Graph([NodeTable("A", "id", spark.createDataFrame([(1, "x", "y"), (2, None, "z")], "id long, name string, old string"))], [])
    got = registry.entity_caches({"v1": graph, "v2": graph}, table, ["v1", "v2"], day(2022, 5, 5))
    assert sorted((r["version"], r["node_id"], r["display_name"]) for r in got.collect()) == [("v1", "1", "x"), ("v2", "1", "x"), ("v2", "2", "z")]
    with pytest.raises(ValueError, match="v2"):
        registry.entity_caches({"v1": graph}, table, ["v1", "v2"], day(2022, 5, 5))
