"""The star schema and the event stream as a property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog import EdgeTable, Graph, NodeTable
from .session import GraphSession

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of few files over all cores, for work in which parsing is the cost and not reading."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, 1))


#: Lines that one task of co_listed() joins; an order has a few.
LINES_PER_TASK = 250_000


def co_listed(lineitem: DataFrame) -> DataFrame:
    """Distinct pairs (p1, p2), p1 < p2, of parts that occur in the same order: an undirected edge, stored once.

    Lines are counted (in the files' footers) and dealt out by order to as many tasks as they need, and the pairs by
    part, so that no task's memory grows with the table; adaptive plans go by compressed bytes, and those are few.
    """
    n = max(1, -(-lineitem.count() // LINES_PER_TASK))
    line = lineitem.select("l_orderkey", "l_partkey").repartition(n, "l_orderkey")
    a, b = line.withColumnRenamed("l_partkey", "p1"), line.withColumnRenamed("l_partkey", "p2")
    return a.join(b.hint("merge"), "l_orderkey").where("p1 < p2").select("p1", "p2").repartition(2 * n, "p1", "p2").distinct()


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    region, nation, customer, supplier, part, orders, lineitem = (
        table(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
    )
    lines = lineitem.withColumn("active", F.col("l_linestatus") == "O")
    line_id = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    line_props = ("l_quantity", "l_extendedprice", "l_discount", "l_shipdate", "l_returnflag", "active")
    return Graph(
        [
            NodeTable("Region", "r_regionkey", region), NodeTable("Nation", "n_nationkey", nation), NodeTable("Customer", "c_custkey", customer),
            NodeTable("Supplier", "s_suppkey", supplier), NodeTable("Part", "p_partkey", part), NodeTable("Order", "o_orderkey", orders),
        ],
        [
            EdgeTable("IN_REGION", "Nation", "Region", "n_nationkey", "n_regionkey", ("n_nationkey",), nation),
            EdgeTable("IN_NATION", "Customer", "Nation", "c_custkey", "c_nationkey", ("c_custkey",), customer),
            EdgeTable("BASED_IN", "Supplier", "Nation", "s_suppkey", "s_nationkey", ("s_suppkey",), supplier),
            EdgeTable("PLACED", "Customer", "Order", "o_custkey", "o_orderkey", ("o_orderkey",), orders, ("o_orderdate", "o_totalprice")),
            EdgeTable("CONTAINS", "Order", "Part", "l_orderkey", "l_partkey", line_id, lines, line_props),
            EdgeTable("SUPPLIED_BY", "Order", "Supplier", "l_orderkey", "l_suppkey", line_id, lines, line_props),
            EdgeTable("CO_LISTED", "Part", "Part", "p1", "p2", ("p1", "p2"), lambda: co_listed(lineitem)),
        ],
    )


def event_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Users and days; every kind of event is a relationship type of its own between the same two labels."""
    # an event of a small value lasts two days, others are open
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")).withColumn("until", F.when(F.col("value") < 50, F.col("ts") + F.expr("INTERVAL 2 DAYS")))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    days = events.select("day").distinct().withColumn("month", F.month("day").cast("long"))
    return Graph(
        [NodeTable("User", "user_id", users), NodeTable("Day", "day", days)],
        [
            EdgeTable(kind.upper(), "User", "Day", "user_id", "day", ("event_id",), events.where(F.col("event_type") == kind), ("value", "ts", "until"))
            for kind in EVENT_TYPES
        ],
    )


def trail_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Users, and their events as nodes that are chained by time: chains as long as a user has events."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("kind"), "value")
    by_time = Window.partitionBy("user_id").orderBy("ts", "event_id")
    placed = events.withColumn("place", F.row_number().over(by_time)).withColumn("next", F.lead("event_id").over(by_time))
    users = events.select("user_id").distinct()
    return Graph(
        [NodeTable("Event", "event_id", placed.drop("next")), NodeTable("User", "user_id", users)],
        [
            EdgeTable("NEXT", "Event", "Event", "event_id", "next", ("event_id",), placed.where("next is not null").select("event_id", "next")),
            EdgeTable("BY", "Event", "User", "event_id", "user_id", ("event_id",), events.select("event_id", "user_id")),
        ],
    )


def star(spark: SparkSession, sf_dir: str) -> GraphSession:
    return GraphSession(spark, star_graph(spark, sf_dir))


def stream(spark: SparkSession, sf_dir: str) -> GraphSession:
    return GraphSession(spark, event_graph(spark, sf_dir))


def trail(spark: SparkSession, sf_dir: str) -> GraphSession:
    return GraphSession(spark, trail_graph(spark, sf_dir))
