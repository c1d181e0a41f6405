"""Graph pattern queries in Cypher (family G) over the star and event graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.catalog import EdgeTable, Graph, NodeTable
from ..plans.tpch import star, star_graph, stream, table, trail
from . import Book

BOOK = Book()


def _star(name: str, cypher: str, sql: str | None) -> None:
    BOOK.add(name, sql)(lambda spark, sf_dir: star(spark, sf_dir).cypher(cypher))


def _stream(name: str, cypher: str, sql: str | None) -> None:
    BOOK.add(name, sql)(lambda spark, sf_dir: stream(spark, sf_dir).cypher(cypher))


def _trail(name: str, cypher: str, sql: str | None) -> None:
    BOOK.add(name, sql)(lambda spark, sf_dir: trail(spark, sf_dir).cypher(cypher))


FLAGSHIP = "MATCH (c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region {r_name:'ASIA'}) RETURN c.c_name AS c_name, n.n_name AS n_name"

_star("g_label_scan", "MATCH (r:Region) RETURN r.r_name AS name", "SELECT r_name AS name FROM region")
_star("g_hop1", "MATCH (n:Nation)-[:IN_REGION]->(r:Region {r_name:'EUROPE'}) RETURN n.n_name AS nation", "SELECT n_name AS nation FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'")
_star("g_chain2", FLAGSHIP, "SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
_star(
    "g_chain3",
    "MATCH (o:Order {o_orderpriority:'1-URGENT'})<-[:PLACED]-(c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN o.o_orderkey AS okey, c.c_name AS name, r.r_name AS region",
    "SELECT o_orderkey AS okey, c_name AS name, r_name AS region FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderpriority = '1-URGENT'",
)
_star("g_reverse", "MATCH (r:Region {r_name:'AMERICA'})<-[:IN_REGION]-(n:Nation)<-[:BASED_IN]-(s:Supplier) RETURN s.s_name AS supplier, n.n_name AS nation", "SELECT s_name AS supplier, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'AMERICA'")
_star("g_inline_multi", "MATCH (p:Part {p_type:'SMALL', p_size:5}) RETURN p.p_partkey AS pkey, p.p_name AS name", "SELECT p_partkey AS pkey, p_name AS name FROM part WHERE p_type = 'SMALL' AND p_size = 5")
_star(
    "g_where_string",
    "MATCH (p:Part) WHERE p.p_name CONTAINS 'ring' OR p.p_name STARTS WITH 'red' OR p.p_name ENDS WITH 'bolt' RETURN p.p_partkey AS pkey, p.p_name AS name",
    "SELECT p_partkey AS pkey, p_name AS name FROM part WHERE contains(p_name, 'ring') OR starts_with(p_name, 'red') OR ends_with(p_name, 'bolt')",
)
_star(
    "g_where_or",
    "MATCH (c:Customer)-[:IN_NATION]->(n:Nation) WHERE (c.c_mktsegment = 'MACHINERY' OR c.c_mktsegment = 'HOUSEHOLD') AND NOT c.c_acctbal < 5000 RETURN c.c_name AS name, n.n_name AS nation",
    "SELECT c_name AS name, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment IN ('MACHINERY', 'HOUSEHOLD') AND c_acctbal >= 5000",
)
_star("g_where_in", "MATCH (o:Order) WHERE o.o_orderstatus IN ['F', 'P'] AND o.o_totalprice > 400000 RETURN o.o_orderkey AS okey", "SELECT o_orderkey AS okey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice > 400000")
for _flag in ("true", "false"):
    _star(
        f"g_edge_filter_{_flag}",
        f"MATCH (o:Order)-[:CONTAINS {{active:{_flag}}}]->(p:Part {{p_size:7}}) RETURN o.o_orderkey AS okey, p.p_partkey AS pkey",
        f"SELECT l_orderkey AS okey, p_partkey AS pkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 7 AND (l_linestatus = 'O') = {_flag}",
    )
_star(
    "g_edge_project",
    "MATCH (o:Order)-[l:CONTAINS]->(p:Part {p_brand:'Brand#2'}) WHERE l.l_quantity >= 45 RETURN o.o_orderkey AS okey, l.l_quantity AS quantity, l.l_shipdate AS shipped, p.p_name AS name",
    "SELECT l_orderkey AS okey, l_quantity AS quantity, l_shipdate AS shipped, p_name AS name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#2' AND l_quantity >= 45",
)
_stream("g_untyped", "MATCH (u:User)-[r]->(d:Day) WHERE r.value > 60 RETURN u.name AS name, type(r) AS kind, r.value AS value", "SELECT c_name AS name, upper(event_type) AS kind, value FROM events JOIN customer ON user_id = c_custkey WHERE value > 60")
_stream(
    "g_alternation",
    "MATCH (u:User)-[r:PURCHASE|SIGNUP]->(d:Day {month:1}) RETURN type(r) AS kind, count(r) AS n, count(DISTINCT u) AS users",
    "SELECT upper(event_type) AS kind, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE event_type IN ('purchase', 'signup') AND month(ts) = 1 GROUP BY 1",
)
_star(
    "g_undirected",
    "MATCH (p:Part {p_partkey:7})-[:CO_LISTED]-(q:Part) RETURN q.p_partkey AS pkey, q.p_name AS name",
    "SELECT p_partkey AS pkey, p_name AS name FROM (SELECT DISTINCT b.l_partkey AS q FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = 7 AND b.l_partkey <> 7) JOIN part ON q = p_partkey",
)
_star(
    "g_edge_unique",
    "MATCH (p:Part)<-[:CONTAINS]-(o:Order {o_orderstatus:'P', o_orderpriority:'2-HIGH'})-[:CONTAINS]->(q:Part) RETURN o.o_orderkey AS okey, count(*) AS pairs",
    "SELECT o_orderkey AS okey, n * (n - 1) AS pairs FROM (SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P' AND o_orderpriority = '2-HIGH' GROUP BY 1) WHERE n > 1",
)
_star(
    "g_multi_match",
    "MATCH (c:Customer)-[:PLACED]->(o:Order {o_orderstatus:'P'}) MATCH (o)-[:SUPPLIED_BY]->(s:Supplier) MATCH (s)-[:BASED_IN]->(n:Nation {n_nationkey:3}) RETURN c.c_name AS name, o.o_orderkey AS okey, s.s_name AS supplier",
    "SELECT c_name AS name, o_orderkey AS okey, s_name AS supplier FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE o_orderstatus = 'P' AND s_nationkey = 3",
)
_star(
    "g_branch",
    "MATCH (c:Customer)-[:PLACED]->(o:Order), (c)-[:IN_NATION]->(n:Nation {n_nationkey:5}), (o)-[:CONTAINS]->(p:Part {p_size:3}) RETURN c.c_name AS name, o.o_orderkey AS okey, p.p_partkey AS pkey",
    "SELECT c_name AS name, o_orderkey AS okey, p_partkey AS pkey FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE c_nationkey = 5 AND p_size = 3",
)
_star("g_cartesian", "MATCH (r:Region), (n:Nation) WHERE n.n_nationkey < r.r_regionkey RETURN r.r_name AS region, n.n_name AS nation", "SELECT r_name AS region, n_name AS nation FROM region, nation WHERE n_nationkey < r_regionkey")
_star(
    "g_anonymous",
    "MATCH (:Region {r_name:'ASIA'})<-[:IN_REGION]-(n)<-[:BASED_IN]-() RETURN n.n_name AS nation, count(*) AS suppliers",
    "SELECT n_name AS nation, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1",
)
_stream(
    "g_temporal_overlap",
    "MATCH (u:User)-[r:PURCHASE]->(d:Day) WHERE r.ts <= datetime('2024-01-20T00:00:00') AND (r.until IS NULL OR r.until >= datetime('2024-01-10T00:00:00')) RETURN u.name AS name, r.ts AS ts, r.until AS until",
    """SELECT c_name AS name, ts, CASE WHEN value < 50 THEN ts + INTERVAL 2 DAY END AS until FROM events JOIN customer ON user_id = c_custkey
       WHERE event_type = 'purchase' AND ts <= TIMESTAMP '2024-01-20 00:00:00' AND (value >= 50 OR ts + INTERVAL 2 DAY >= TIMESTAMP '2024-01-10 00:00:00')""",
)
_star("g_date", "MATCH (o:Order) WHERE o.o_orderdate >= date('2000-01-01') RETURN count(o) AS n", "SELECT count(*) AS n FROM orders WHERE o_orderdate >= DATE '2000-01-01'")
_star("g_distinct", "MATCH (c:Customer)-[:PLACED]->(o:Order {o_orderstatus:'P'}) RETURN DISTINCT c.c_name AS name", "SELECT DISTINCT c_name AS name FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P'")
_star("g_count", "MATCH (c:Customer {c_mktsegment:'NO SUCH'})-[:PLACED]->(o:Order) RETURN count(o) AS n", "SELECT count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'NO SUCH'")
_star(
    "g_count_distinct",
    "MATCH (n:Nation)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o:Order) RETURN n.n_name AS nation, count(DISTINCT c) AS customers, count(o) AS orders",
    "SELECT n_name AS nation, count(DISTINCT c_custkey) AS customers, count(*) AS orders FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY n_nationkey, n_name",
)
_star(
    "g_group_with",
    "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS n, sum(o.o_totalprice) AS total RETURN c.c_name AS name, n, round(total) AS total",
    "SELECT c_name AS name, count(*) AS n, round(sum(o_totalprice)) AS total FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name",
)
_star(
    "g_having",
    "MATCH (c:Customer)-[r:PLACED]->(:Order) WITH c, count(r) AS n WHERE n > 12 RETURN count(c) AS busy",
    "SELECT count(*) AS busy FROM (SELECT o_custkey FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) > 12)",
)
_star(
    "g_order_hidden_key",
    "MATCH (c:Customer) RETURN c.c_name AS name ORDER BY c.c_acctbal DESC, c.c_custkey LIMIT 25",
    "SELECT c_name AS name FROM customer ORDER BY c_acctbal DESC NULLS FIRST, c_custkey LIMIT 25",
)
_star(
    "g_topk",
    "MATCH (s:Supplier)<-[:SUPPLIED_BY]-(o:Order) WITH s, count(*) AS n RETURN s.s_name AS supplier, n ORDER BY n DESC, s.s_name LIMIT 10",
    "SELECT s_name AS supplier, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY s_suppkey, s_name ORDER BY n DESC, supplier LIMIT 10",
)
_star(
    "g_varlen",
    "MATCH (r:Region {r_name:'AFRICA'})<-[*1..3]-(x) RETURN labels(x)[0] AS label, count(*) AS walks",
    """WITH n AS (SELECT n_nationkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'AFRICA'),
       c AS (SELECT c_custkey AS k FROM customer WHERE c_nationkey IN (FROM n)), s AS (SELECT s_suppkey AS k FROM supplier WHERE s_nationkey IN (FROM n))
       SELECT 'Nation' AS label, count(*) AS walks FROM n UNION ALL SELECT 'Customer', count(*) FROM c UNION ALL SELECT 'Supplier', count(*) FROM s
       UNION ALL SELECT 'Order', count(*) FROM lineitem WHERE l_suppkey IN (FROM s)""",
)
_star(
    "g_path_count",
    "MATCH path = (n:Nation {n_nationkey:1})<-[:IN_NATION]-(:Customer)-[:PLACED*1..1]->(:Order) RETURN count(path) AS paths, min(length(path)) AS hops",
    "SELECT count(*) AS paths, CAST(min(2) AS BIGINT) AS hops FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 1",
)
PLACED = "placed AS (SELECT event_id, user_id, event_type, row_number() OVER w AS place, lead(event_id) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"
_trail(
    "g_walk30",
    "MATCH p = (a:Event {place:1})-[:NEXT*1..30]->(b:Event) RETURN length(p) AS hops, count(p) AS walks, count(DISTINCT b) AS ends",
    f"""WITH RECURSIVE {PLACED}, walk AS (
        SELECT event_id AS a, next AS b, 1 AS hops FROM placed WHERE place = 1 AND next IS NOT NULL
        UNION ALL SELECT w.a, p.next, w.hops + 1 FROM walk w JOIN placed p ON p.event_id = w.b WHERE w.hops < 30 AND p.next IS NOT NULL
    ) SELECT CAST(hops AS BIGINT) AS hops, count(*) AS walks, count(DISTINCT b) AS ends FROM walk GROUP BY hops""",
)
_trail(
    "g_walk30_between",
    "MATCH (a:Event {place:1})-[:BY]->(u:User)<-[:BY]-(b:Event {kind:'purchase'}) MATCH p = (a)-[:NEXT*1..30]->(b) RETURN u.user_id AS user_id, b.event_id AS event_id, length(p) AS hops",
    f"""WITH RECURSIVE {PLACED}, walk AS (
        SELECT user_id, next AS b, 1 AS hops FROM placed WHERE place = 1 AND next IS NOT NULL
        UNION ALL SELECT w.user_id, p.next, w.hops + 1 FROM walk w JOIN placed p ON p.event_id = w.b WHERE w.hops < 30 AND p.next IS NOT NULL
    ) SELECT w.user_id, b AS event_id, CAST(hops AS BIGINT) AS hops FROM walk w JOIN placed p ON p.event_id = w.b WHERE event_type = 'purchase'""",
)
BOOK.add(
    "g_catalog_counts",
    """SELECT 'label' AS kind, 'Region' AS name, count(*) AS n FROM region UNION ALL SELECT 'label', 'Nation', count(*) FROM nation UNION ALL SELECT 'label', 'Customer', count(*) FROM customer
       UNION ALL SELECT 'label', 'Supplier', count(*) FROM supplier UNION ALL SELECT 'label', 'Part', count(*) FROM part UNION ALL SELECT 'label', 'Order', count(*) FROM orders
       UNION ALL SELECT 'type', 'IN_REGION', count(*) FROM nation UNION ALL SELECT 'type', 'IN_NATION', count(*) FROM customer UNION ALL SELECT 'type', 'BASED_IN', count(*) FROM supplier
       UNION ALL SELECT 'type', 'PLACED', count(*) FROM orders UNION ALL SELECT 'type', 'CONTAINS', count(*) FROM lineitem UNION ALL SELECT 'type', 'SUPPLIED_BY', count(*) FROM lineitem
       UNION ALL SELECT 'type', 'CO_LISTED', count(*) FROM (SELECT DISTINCT a.l_partkey, b.l_partkey AS q FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey)""",
)(lambda spark, sf_dir: star_graph(spark, sf_dir).counts())
BOOK.add(
    "g_node_return",
    "SELECT r_regionkey AS k, r_name AS name FROM region WHERE r_regionkey < 3",
)(lambda spark, sf_dir: star(spark, sf_dir).cypher("MATCH (r:Region) WHERE r.r_regionkey < 3 RETURN r").select(F.col("r.r_regionkey").alias("k"), F.col("r.r_name").alias("name")))
_star(
    "g_optional",
    "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order {o_orderstatus:'P'}) RETURN c.c_custkey AS ckey, count(o) AS pending",
    "SELECT c_custkey AS ckey, count(o_orderkey) AS pending FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1",
)
_star("g_union", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation) RETURN n.n_name AS nation UNION MATCH (s:Supplier)-[:BASED_IN]->(n:Nation) RETURN n.n_name AS nation", "SELECT n_name AS nation FROM nation JOIN customer ON c_nationkey = n_nationkey UNION SELECT n_name FROM nation JOIN supplier ON s_nationkey = n_nationkey")
_star("g_union_all", "MATCH (c:Customer {c_mktsegment:'MACHINERY'}) RETURN c.c_name AS name UNION ALL MATCH (s:Supplier) RETURN s.s_name AS name", "SELECT c_name AS name FROM customer WHERE c_mktsegment = 'MACHINERY' UNION ALL SELECT s_name FROM supplier")
_star(
    "g_exists",
    "MATCH (c:Customer) WHERE EXISTS { MATCH (c)-[:PLACED]->(o:Order {o_orderstatus:'P'}) WHERE o.o_totalprice > c.c_acctbal * 20 } AND NOT EXISTS { (c)-[:PLACED]->(:Order)-[:SUPPLIED_BY]->(:Supplier)-[:BASED_IN]->(n:Nation)<-[:IN_NATION]-(c) } RETURN c.c_custkey AS ckey",
    """SELECT c_custkey AS ckey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > c_acctbal * 20)
       AND NOT EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE o_custkey = c_custkey AND s_nationkey = c_nationkey)""",
)
_star(
    "g_exists_either",
    "MATCH (p:Part) WHERE p.p_size = 5 OR EXISTS { (p)<-[l:CONTAINS]-(o:Order {o_orderstatus:'P'}) WHERE l.l_quantity >= 48 AND EXISTS { (o)<-[:PLACED]-(:Customer {c_mktsegment:'MACHINERY'}) } } RETURN p.p_partkey AS pkey",
    """SELECT p_partkey AS pkey FROM part WHERE p_size = 5 OR EXISTS (SELECT 1 FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
       WHERE l_partkey = p_partkey AND l_quantity >= 48 AND o_orderstatus = 'P' AND c_mktsegment = 'MACHINERY')""",
)
_star(
    "g_call_count",
    "MATCH (c:Customer)-[:IN_NATION]->(n:Nation) CALL { WITH c MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_orderstatus = 'P' RETURN count(o) AS pending, sum(o.o_totalprice) AS total } RETURN n.n_name AS nation, max(pending) AS most, count(*) AS customers, round(sum(total)) AS total",
    """SELECT n_name AS nation, max(pending) AS most, count(*) AS customers, round(sum(total)) AS total FROM customer JOIN nation ON n_nationkey = c_nationkey,
       LATERAL (SELECT count(*) AS pending, coalesce(sum(o_totalprice), 0) AS total FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') GROUP BY n_nationkey, n_name""",
)
_star(
    "g_call_topk",
    "MATCH (c:Customer {c_mktsegment:'MACHINERY'}) CALL { WITH c MATCH (c)-[:PLACED]->(o:Order) RETURN o ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 2 } RETURN c.c_name AS name, o.o_orderkey AS okey, o.o_totalprice AS price",
    """SELECT c_name AS name, o_orderkey AS okey, o_totalprice AS price FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r
       FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY') WHERE r <= 2""",
)
_star(
    "g_db_labels",
    "CALL db.labels() YIELD label MATCH (x) WHERE labels(x)[0] = label RETURN label, count(x) AS n",
    "SELECT 'Region' AS label, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders",
)
_stream(
    "g_db_types",
    "CALL db.relationshipTypes() YIELD relationshipType AS kind WHERE kind <> 'VIEW' CALL { WITH kind MATCH (:User)-[r]->(:Day) WHERE type(r) = kind RETURN count(r) AS n, avg(r.value) AS mean } RETURN kind, n, round(mean * 100) AS mean",
    "SELECT upper(event_type) AS kind, count(*) AS n, round(avg(value) * 100) AS mean FROM events WHERE event_type <> 'view' GROUP BY 1",
)
_star("g_unwind", "UNWIND [1, 3, 5] AS size MATCH (p:Part) WHERE p.p_size = size RETURN size, count(p) AS parts", "SELECT CAST(p_size AS INTEGER) AS size, count(*) AS parts FROM part WHERE p_size IN (1, 3, 5) GROUP BY 1")
_star("g_skip", "MATCH (c:Customer) RETURN c.c_custkey AS ckey ORDER BY c.c_custkey SKIP 20 LIMIT 15", "SELECT c_custkey AS ckey FROM customer ORDER BY 1 LIMIT 15 OFFSET 20")
_star(
    "g_collect",
    "MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.r_name AS region, size(collect(DISTINCT n.n_name)) AS nations",
    "SELECT r_name AS region, count(DISTINCT n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name",
)
_star(
    "g_backquoted",
    "MATCH (n:`Nation`) RETURN n.`n_name` AS `name_0`",
    "SELECT n_name AS name_0 FROM nation",
)


@BOOK.add(
    "g_constraints",
    """SELECT 'unique' AS gate, 'Customer' AS name, count(*) AS n FROM (SELECT c_custkey FROM customer GROUP BY 1 HAVING count(*) > 1)
       UNION ALL SELECT 'unique', 'Order', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
       UNION ALL SELECT 'dangling', 'PLACED', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
       UNION ALL SELECT 'dangling', 'CONTAINS', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)""",
)
def g_constraints(spark, sf_dir):
    """Uniqueness and referential integrity of the graph's tables."""
    graph = star_graph(spark, sf_dir)
    wanted = spark.createDataFrame([("unique", "Customer"), ("unique", "Order"), ("dangling", "PLACED"), ("dangling", "CONTAINS")], "gate string, name string")
    unique = graph.duplicate_ids().groupBy(F.lit("unique").alias("gate"), F.col("label").alias("name")).agg(F.count("*").alias("bad"))
    dangling = graph.dangling().where("end = 'source' AND type = 'PLACED' OR end = 'target' AND type = 'CONTAINS'")
    found = unique.union(dangling.select(F.lit("dangling"), "type", "n"))
    return wanted.join(found, ["gate", "name"], "left").select("gate", "name", F.coalesce("bad", F.lit(0).cast("long")).alias("n"))


@BOOK.add(
    "g_violations",
    """SELECT 'unique' AS gate, 'Segment' AS name, CAST(c_nationkey AS VARCHAR) AS id, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 1
       UNION ALL SELECT 'dangling', 'PLACED source', NULL, count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
       UNION ALL SELECT 'dangling', 'PLACED target', NULL, count(*) FROM orders WHERE o_orderstatus = 'P'""",
)
def g_violations(spark, sf_dir):
    """A graph that breaks its constraints: ids that repeat, and relationships whose ends are missing."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    nodes = [NodeTable("Customer", "c_custkey", customer.where("c_acctbal > 0")), NodeTable("Segment", "c_nationkey", customer), NodeTable("Order", "o_orderkey", orders.where("o_orderstatus <> 'P'"))]
    graph = Graph(nodes, [EdgeTable("PLACED", "Customer", "Order", "o_custkey", "o_orderkey", ("o_orderkey",), orders)])
    lost = graph.dangling().select(F.lit("dangling").alias("gate"), F.concat_ws(" ", "type", "end").alias("name"), F.lit(None).cast("string").alias("id"), "n")
    return graph.duplicate_ids().select(F.lit("unique").alias("gate"), F.col("label").alias("name"), "id", "n").union(lost)
