from __future__ import annotations

import random

import pytest

from quillgraph.plans.catalog import EdgeTable, Graph, NodeTable
from quillgraph.plans.lexer import CypherError
from quillgraph.plans.session import GraphSession
from quillgraph.plans.syntax import parse
from quillgraph.sources.seeds import load_seed, read_seed

SEED = """
CREATE CONSTRAINT sailor_id IF NOT EXISTS FOR (p:Sailor) REQUIRE p.sailor_id IS UNIQUE;
CREATE INDEX coast IF NOT EXISTS FOR (l:Harbour) ON (l.coast); // comment
CREATE (:Sailor {sailor_id:'SAI-001', name:'Ann; Lee', born:date('1980-02-03'), alias:null});
CREATE (:Sailor {sailor_id:'SAI-002', name:'Bo', born:null});
CREATE (:Sailor {sailor_id:'SAI-003', name:'Cy', score:-1.5});
CREATE (:Harbour {harbour_id:'HAR-001', coast:'X'});
CREATE (:Harbour {harbour_id:'HAR-002', coast:'Y'});
MATCH (p:Sailor {sailor_id:'SAI-001'}), (l:Harbour {harbour_id:'HAR-001'}) CREATE (p)-[:MOORED_AT {active:true, since:date('2020-01-01'), until:null}]->(l);
MATCH (p:Sailor {sailor_id:'SAI-001'}), (l:Harbour {harbour_id:'HAR-002'}) CREATE (p)-[:MOORED_AT {active:false, since:date('2010-01-01'), until:date('2019-12-31')}]->(l);
MATCH (p:Sailor {sailor_id:'SAI-002'}), (l:Harbour {harbour_id:'HAR-001'}) CREATE (p)-[:MOORED_AT {active:true, since:date('2021-01-01'), until:null}]->(l);
MATCH (a:Sailor {sailor_id:'SAI-001'}), (b:Sailor {sailor_id:'SAI-002'}) CREATE (a)-[:MET_WITH]->(b);
MATCH (a:Sailor {sailor_id:'SAI-003'}), (b:Sailor {sailor_id:'SAI-003'}) CREATE (a)-[:MET_WITH]->(b);
MATCH (a:Sailor {sailor_id:'SAI-009'}), (b:Sailor {sailor_id:'SAI-002'}) CREATE (a)-[:MET_WITH]->(b);
"""


@pytest.fixture(scope="module")
def session(spark):
    return GraphSession(spark, load_seed(spark, SEED))


def rows(session, text, **params):
    return sorted((tuple(r) for r in session.cypher(text, params).collect()), key=str)


def test_seed():
    seed = read_seed(SEED)
    assert {k: len(v) for k, v in seed.nodes.items()} == {"Sailor": 3, "Harbour": 2} and len(seed.edges) == 6
    assert seed.keys == {"Sailor": "sailor_id"} and len(seed.indexes) == 1


def test_catalog(session):
    assert {(r["kind"], r["name"], r["n"]) for r in session.graph.counts().collect()} == {("label", "Sailor", 3), ("label", "Harbour", 2), ("type", "MOORED_AT", 3), ("type", "MET_WITH", 2)}
    assert session.graph.duplicate_ids().count() == 0
    assert "(:Sailor)-[:MOORED_AT]->(:Harbour)" in session.graph.schema.to_prompt()


def test_patterns(session):
    assert rows(session, "MATCH (p:Sailor)-[:MOORED_AT {active:true}]->(l:Harbour {coast:'X'}) RETURN p.name") == [("Ann; Lee",), ("Bo",)]
    # neighbours at the same place: the two relationships are different ones
    assert rows(session, "MATCH (p:Sailor)-[:MOORED_AT]->(l)<-[:MOORED_AT]-(q:Sailor) RETURN p.name AS a, q.name AS b") == [("Ann; Lee", "Bo"), ("Bo", "Ann; Lee")]
    # in separate clauses they may be the same
    assert len(rows(session, "MATCH (p:Sailor)-[:MOORED_AT]->(l) MATCH (l)<-[:MOORED_AT]-(q:Sailor) RETURN p.name AS a, q.name AS b")) == 5


def test_undirected_and_self_loop(session):
    assert rows(session, "MATCH (a:Sailor)-[:MET_WITH]-(b:Sailor) RETURN a.name AS a, b.name AS b") == [("Ann; Lee", "Bo"), ("Bo", "Ann; Lee"), ("Cy", "Cy")]
    assert rows(session, "MATCH (a:Sailor)-[:MET_WITH]->(a) RETURN a.name AS a") == [("Cy",)]


def test_untyped(session):
    assert rows(session, "MATCH (p:Sailor {sailor_id:'SAI-001'})-[r]->(x) RETURN type(r) AS t, labels(x)[0] AS l, count(*) AS n") == [("MET_WITH", "Sailor", 1), ("MOORED_AT", "Harbour", 2)]


def test_nulls_dates_params(session):
    assert rows(session, "MATCH (p:Sailor)-[l:MOORED_AT]->(x) WHERE l.since <= date('2015-06-01') AND (l.until IS NULL OR l.until >= date('2015-06-01')) RETURN x.coast AS t") == [("Y",)]
    assert rows(session, "MATCH (p:Sailor) WHERE p.alias IS NULL AND p.name = $n RETURN p.sailor_id AS id", n="Bo") == [("SAI-002",)]
    assert rows(session, "MATCH (p:Sailor) WHERE p.nothing = 1 RETURN p.name") == []
    assert [r["n"] for r in session.cypher("MATCH (p:Sailor) RETURN p.name AS n ORDER BY p.born, p.name").collect()] == ["Ann; Lee", "Bo", "Cy"]
    assert [r["n"] for r in session.cypher("MATCH (p:Sailor) RETURN p.name AS n ORDER BY p.born DESC, p.name").collect()] == ["Bo", "Cy", "Ann; Lee"]


def test_optional_collect_union(session):
    assert rows(session, "MATCH (p:Sailor) OPTIONAL MATCH (p)-[:MOORED_AT {active:true}]->(l) RETURN p.name AS n, count(l) AS c") == [("Ann; Lee", 1), ("Bo", 1), ("Cy", 0)]
    assert rows(session, "MATCH (p:Sailor)-[:MOORED_AT]->(l) WITH p, collect(l.coast) AS coasts WHERE size(coasts) > 1 RETURN p.name AS n") == [("Ann; Lee",)]
    assert rows(session, "MATCH (l:Harbour) RETURN l.coast AS t UNION MATCH (l:Harbour {coast:'X'}) RETURN l.coast AS t") == [("X",), ("Y",)]
    assert len(rows(session, "MATCH (l:Harbour) RETURN l.coast AS t UNION ALL MATCH (l:Harbour {coast:'X'}) RETURN l.coast AS t")) == 3


def test_variable_length(session):
    assert rows(session, "MATCH p = (a:Sailor {sailor_id:'SAI-001'})-[*1..2]-(b) RETURN length(p) AS n, count(p) AS c") == [(1, 3), (2, 2)]
    with pytest.raises(CypherError):
        session.cypher("MATCH (a)-[*]->(b) RETURN a")


def test_exists(session):
    assert rows(session, "MATCH (p:Sailor) WHERE EXISTS { (p)-[:MOORED_AT {active:true}]->() } RETURN p.name") == [("Ann; Lee",), ("Bo",)]
    assert rows(session, "MATCH (p:Sailor) WHERE NOT EXISTS { MATCH (p)-[:MOORED_AT]->(l) WHERE l.coast = 'Y' } RETURN p.name") == [("Bo",), ("Cy",)]
    assert rows(session, "MATCH (p:Sailor) WHERE p.name = 'Cy' OR NOT NOT EXISTS { (p)-[:MOORED_AT]->({coast:'Y'}) } RETURN p.name") == [("Ann; Lee",), ("Cy",)]
    assert rows(session, "MATCH (p:Sailor)-[:MOORED_AT]->(l) WITH p, l WHERE EXISTS { (q:Sailor)-[:MOORED_AT]->(l) WHERE q.name <> p.name } RETURN DISTINCT p.name") == [("Ann; Lee",), ("Bo",)]
    # nested, and without a variable of the outer query
    assert rows(session, "MATCH (p:Sailor) WHERE EXISTS { (p)-[:MET_WITH]-(q) WHERE EXISTS { (q)-[:MOORED_AT]->({coast:'Y'}) } } RETURN p.name") == [("Bo",)]
    assert len(rows(session, "MATCH (p:Sailor) WHERE EXISTS { (:Harbour {coast:'X'}) } RETURN p.name")) == 3
    assert rows(session, "MATCH (p:Sailor) WHERE EXISTS { (:Harbour {coast:'Z'}) } RETURN p.name") == []


def test_subqueries(session):
    each = "MATCH (p:Sailor) CALL { WITH p MATCH (p)-[:MOORED_AT]->(l) RETURN count(l) AS n, collect(l.coast) AS coasts, max(l.coast) AS last } RETURN p.name AS name, n, size(coasts) AS k, last"
    assert rows(session, each) == [("Ann; Lee", 2, 2, "Y"), ("Bo", 1, 1, "X"), ("Cy", 0, 0, None)]
    assert rows(session, "MATCH (p:Sailor) CALL { WITH p MATCH (p)-[:MOORED_AT]->(l) RETURN l ORDER BY l.coast DESC LIMIT 1 } RETURN p.name AS name, l.coast AS t") == [("Ann; Lee", "Y"), ("Bo", "X")]
    assert rows(session, "MATCH (p:Sailor) CALL { WITH p MATCH (p)-[:MOORED_AT]->(l) RETURN l.coast AS t SKIP 1 } RETURN p.name AS name, count(t) AS n") == [("Ann; Lee", 1)]
    assert rows(session, "MATCH (p:Sailor) CALL { MATCH (l:Harbour) RETURN count(l) AS n } RETURN p.name AS name, n") == [("Ann; Lee", 2), ("Bo", 2), ("Cy", 2)]
    both = "MATCH (p:Sailor) CALL { WITH p MATCH (p)-[:MOORED_AT]->(l) RETURN l.coast AS t UNION WITH p MATCH (p)-[:MET_WITH]-(q) RETURN q.name AS t } RETURN p.name AS name, t"
    assert rows(session, both) == [("Ann; Lee", "Bo"), ("Ann; Lee", "X"), ("Ann; Lee", "Y"), ("Bo", "Ann; Lee"), ("Bo", "X"), ("Cy", "Cy")]
    # aggregates inside are those of each row, in WITH too
    assert rows(session, "MATCH (p:Sailor) CALL { WITH p MATCH (p)-[:MOORED_AT]->(l) WITH count(l) AS n WHERE n > 1 RETURN n } RETURN p.name AS name, n") == [("Ann; Lee", 2)]
    for text in ("MATCH (p:Sailor) CALL { WITH q RETURN 1 AS x } RETURN x", "MATCH (p:Sailor) CALL { MATCH (l:Harbour) RETURN l AS p } RETURN p", "CALL db.nothing() YIELD label RETURN label", "CALL db.labels() YIELD name RETURN name"):
        with pytest.raises(CypherError):
            session.cypher(text)


def test_procedures(session):
    assert rows(session, "CALL db.labels()") == [("Harbour",), ("Sailor",)]
    assert rows(session, "CALL db.relationshipTypes() YIELD relationshipType AS t WHERE t STARTS WITH 'MET' RETURN t") == [("MET_WITH",)]
    assert ("coast",) in rows(session, "CALL db.propertyKeys() YIELD propertyKey RETURN propertyKey")
    v = session.validate("MATCH (p:Sailor) WHERE EXISTS { (p)-[:NO_SUCH]->() } CALL { WITH p MATCH (p)-[:MET_WITH]->(q:Nobody) RETURN q } RETURN p")
    assert (v.route_to, len(v.problems)) == ("schema_linker", 2)
    assert session.validate("CALL db.labels() YIELD label MATCH (p:Sailor) WHERE p.name = label RETURN p").is_valid


def test_errors_and_verdicts(session):
    assert session.execute("MATCH (p:Sailor {sailor_id:'none'}) RETURN p.name AS n").rows == []
    many = session.execute("MATCH (p:Sailor) RETURN p.name AS n", limit=2)
    assert not many.success and many.rows == [] and "more than 2" in many.error
    assert len(session.execute("MATCH (p:Sailor) RETURN p.name AS n", limit=3).rows) == 3
    bad = session.execute("MATCH (p:Sailor RETURN p")
    assert not bad.success and bad.error
    assert session.validate("MATCH (p:Sailor RETURN p").route_to == "query_generator"
    v = session.validate("MATCH (p:Sailor)-[:NO_SUCH]->(l:Harbour) RETURN p.name")
    assert (v.route_to, v.schema_score) == ("schema_linker", pytest.approx(2 / 3))
    v = session.validate("MATCH (p:Sailor) RETURN p.colour, p.name")
    assert (v.route_to, v.properties_score) == ("schema_linker", 0.5)
    assert session.validate("MATCH (p:Sailor) RETURN p").is_valid
    for text in ("MATCH (a) RETURN b", "RETURN", "MATCH (a)<-[r]->(b) RETURN a", "FOO"):
        with pytest.raises(CypherError):
            session.cypher(text)


def test_plan_rules(session):
    """A node table of which nothing is read is not joined, and types that cannot fit are not in the union."""
    plan = session.cypher("MATCH (p:Sailor)-[:MOORED_AT]->(l:Harbour) RETURN count(*) AS n")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_parser_precedence():
    q = parse("MATCH (a) WHERE NOT a.x = 1 OR a.y > 2 AND a.z IN [1, -2] RETURN a.x + 2 * 3 AS v").parts[0]
    assert q.clauses[0].where.name == "or" and q.clauses[1].items[0].expr.name == "+"


def test_random_patterns(spark):
    """Random chains over a random graph against a search by hand."""
    rng = random.Random(5)
    nodes = {label: list(range(4)) for label in "AB"}
    edges = [(n, t, s, rng.randrange(4), d, rng.randrange(4)) for n, (t, s, d) in enumerate(rng.choices([("R", "A", "B"), ("S", "B", "A"), ("T", "A", "A")], k=24))]
    tables = [NodeTable(label, "id", spark.createDataFrame([(i,) for i in ids], "id long")) for label, ids in nodes.items()]
    kinds = sorted({(t, s, d) for _, t, s, _, d, _ in edges})
    frames = [EdgeTable(t, s, d, "src", "dst", ("eid",), spark.createDataFrame([(n, i, j) for n, t2, _, i, _, j in edges if t2 == t], "eid long, src long, dst long")) for t, s, d in kinds]
    session = GraphSession(spark, Graph(tables, frames))
    for _ in range(6):
        labels = [rng.choice(["A", "B", ""]) for _ in range(3)]
        rels = [(rng.choice(["R", "S", "T", ""]), rng.choice(["out", "in", "both"])) for _ in range(2)]

        def hop(at, rel, used, want):
            for n, t, s, i, d, j in edges:
                if n in used or rel[0] and t != rel[0]:
                    continue
                ends = []
                if rel[1] in ("out", "both") and (s, i) == at:
                    ends.append((d, j))
                if rel[1] in ("in", "both") and (d, j) == at and not (rel[1] == "both" and (s, i) == (d, j)):
                    ends.append((s, i))
                yield from ((n, e) for e in ends if not want or e[0] == want)

        found = sum(1 for label in nodes for k in nodes[label] if not labels[0] or label == labels[0] for n1, x in hop((label, k), rels[0], (), labels[1]) for _ in hop(x, rels[1], (n1,), labels[2]))
        arrow = {"out": ("-", "->"), "in": ("<-", "-"), "both": ("-", "-")}
        text = f"(x0{':' + labels[0] if labels[0] else ''})"
        for i, (t, way) in enumerate(rels):
            text += f"{arrow[way][0]}[{':' + t if t else ''}]{arrow[way][1]}(x{i + 1}{':' + labels[i + 1] if labels[i + 1] else ''})"
        try:
            got = session.cypher(f"MATCH {text} RETURN count(*) AS n").first()["n"]
        except CypherError:
            got = 0  # no relationship type fits the labels
        assert got == found, text


def _dense(spark, seed: int, n: int, m: int):
    rng = random.Random(seed)
    edges = [(k, rng.randrange(n), rng.randrange(n)) for k in range(m)]
    nodes = spark.createDataFrame([(i, i % 3) for i in range(n)], "id long, colour long")
    frame = spark.createDataFrame(edges, "eid long, src long, dst long")
    return edges, GraphSession(spark, Graph([NodeTable("N", "id", nodes)], [EdgeTable("E", "N", "N", "src", "dst", ("eid",), frame)]))


@pytest.mark.parametrize("way", ["out", "both"])
def test_long_walks(spark, way):
    """Trails from one end and from both, at bounds that are planned whole and at ones that are iterated."""
    edges, session = _dense(spark, 8, 7, 9)
    found = []

    def go(at, used, start):
        if used:
            found.append((start, at, len(used)))
        if len(used) == 6:
            return
        for k, i, j in edges:
            if k not in used:
                ends = {j} if i == at else set()
                ends |= {i} if way == "both" and j == at else set()
                for e in ends:
                    go(e, (*used, k), start)

    for i in range(7):
        go(i, (), i)
    arrow = "->" if way == "out" else "-"
    for lo, hi in ((1, 2), (2, 5), (3, 6), (5, 5)):
        want = sorted(x for x in found if lo <= x[2] <= hi)
        got = session.cypher(f"MATCH p = (a:N)-[:E*{lo}..{hi}]{arrow}(b:N) RETURN a.id AS a, b.id AS b, length(p) AS n")
        assert sorted(map(tuple, got.collect())) == want
        got = session.cypher(f"MATCH p = (a:N {{colour:1}})-[:E*{lo}..{hi}]{arrow}(b:N {{colour:0}}) RETURN a.id AS a, b.id AS b, length(p) AS n")
        assert sorted(map(tuple, got.collect())) == [x for x in want if x[0] % 3 == 1 and x[1] % 3 == 0]
        got = session.cypher(f"MATCH (a:N {{colour:1}})-[:E]->(b:N) WITH DISTINCT a, b MATCH p = (a)-[:E*{lo}..{hi}]{arrow}(b) RETURN a.id AS a, b.id AS b, length(p) AS n")
        pairs = {(i, j) for _, i, j in edges if i % 3 == 1}
        assert sorted(map(tuple, got.collect())) == [x for x in want if x[:2] in pairs]
    loops = session.cypher(f"MATCH p = (a:N)-[:E*1..5]{arrow}(a) RETURN a.id AS a, length(p) AS n")
    assert sorted(map(tuple, loops.collect())) == sorted((a, n) for a, b, n in found if a == b and n <= 5)
    # no trail is longer than there are relationships, so the iteration ends long before its bound
    assert session.cypher(f"MATCH p = (a:N {{id:0}})-[:E*7..30]{arrow}(b:N) RETURN max(length(p)) AS n").first()["n"] in (None, 7, 8, 9)


def test_walks_end_at_a_time_limit(spark):
    """A bound of 30 on a dense graph has more trails than can be counted: the time limit ends it."""
    _, session = _dense(spark, 9, 12, 120)
    out = session.execute("MATCH p = (a:N)-[*1..30]-(b:N) RETURN count(p) AS n", timeout_s=4.0)
    assert not out.success and "timed out" in out.error and out.rows == [] and out.elapsed_ms < 60_000
    assert spark.range(3).count() == 3


def test_hops_do_not_shuffle_relationships(spark):
    """Relationships are written in buckets by the node they leave: a join on it shuffles the trails alone."""
    from pyspark.sql import functions as F

    from quillgraph.plans.written import discard, materialise, materialise_by

    edges = materialise_by(spark.range(50).select(F.col("id").cast("string").alias("at"), F.lit("A").alias("at_label"), (F.col("id") + 1).alias("to")), "at", "at_label")
    trails = materialise(spark.range(5).select(F.col("id").cast("string").alias("at"), F.lit("A").alias("at_label"))).hint("merge")
    joined = trails.join(edges, ["at", "at_label"])
    assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(r["to"] for r in joined.collect()) == [1, 2, 3, 4, 5]
    before = spark.catalog.listTables()
    discard(edges)
    assert len(spark.catalog.listTables()) == len(before) - 1


def test_names_of_the_catalog_go_to_the_nodes(spark, capsys):
    """The few labels are broadcast; the nodes, one value of six for each, are neither broadcast nor shuffled to them."""
    from quillgraph.plans.tpch import star

    star(spark, "/root/testdata/sf0.001").cypher("CALL db.labels() YIELD label MATCH (x) WHERE labels(x)[0] = label RETURN label, count(x) AS n").explain()
    plan = capsys.readouterr().out
    assert "BuildLeft" in plan and "BuildRight" not in plan and "SortMergeJoin" not in plan


def test_pairs_of_parts_are_dealt_out_by_number(spark, monkeypatch):
    """Tasks grow with the lines, whatever few bytes a shuffle has; the pairs are those of a nested loop."""
    from pyspark.sql import functions as F

    from quillgraph.plans import tpch

    monkeypatch.setattr(tpch, "LINES_PER_TASK", 100, raising=False)
    rows = [(i // 3, i * 7 % 41) for i in range(900)] + [(5, p) for p in range(40)]
    pairs = tpch.co_listed(spark.createDataFrame(rows, "l_orderkey long, l_partkey long"))
    assert sorted(map(tuple, pairs.collect())) == sorted({(p, q) for o, p in rows for x, q in rows if o == x and p < q})
    assert pairs.select(F.spark_partition_id().alias("task")).distinct().count() > 10
