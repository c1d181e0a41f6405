"""Queries of data preparation (families T, J, S) and the streaming extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import prep, stats, walks
from ..plans.catalog import GraphSchema, PathDecl
from ..plans.tpch import table
from . import Book

BOOK = Book()
NORM = r"regexp_replace(lower(regexp_replace(text, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g')), '[ \t\n\r\f\v]+', ' ', 'g')"


def docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


@BOOK.add("t_dedup_first", f"SELECT min(doc_id) AS doc_id FROM (SELECT doc_id, {NORM} AS t FROM documents) GROUP BY t")
def t_dedup_first(spark, sf_dir):
    return prep.first_wins(docs(spark, sf_dir), "text", ["doc_id"], ["doc_id"])


@BOOK.add("t_gate_exact", f"SELECT doc_id FROM documents WHERE {NORM} NOT IN (SELECT {NORM} FROM documents WHERE source = 'src1')")
def t_gate_exact(spark, sf_dir):
    from ..functions.strings import normalised_question

    d = docs(spark, sf_dir)
    blocked = d.where("source = 'src1'").select(normalised_question("text").alias("_b")).distinct()
    return d.join(blocked, normalised_question("text") == F.col("_b"), "left_anti").select("doc_id")


@BOOK.add(
    "t_gate_fuzzy",
    f"""WITH d AS (SELECT doc_id, n, list_distinct(list_filter(string_split(n, ' '), lambda x: x <> '')) AS t FROM (SELECT doc_id, {NORM} AS n FROM documents)),
    b AS (SELECT DISTINCT {NORM} AS bn FROM benchmark), bt AS (SELECT bn, list_distinct(list_filter(string_split(bn, ' '), lambda x: x <> '')) AS bt FROM b),
    pairs AS (SELECT doc_id, list_sort(list_intersect(t, bt)) AS w, list_sort(list_filter(t, lambda x: NOT list_contains(bt, x))) AS oa, list_sort(list_filter(bt, lambda x: NOT list_contains(t, x))) AS ob FROM d, bt WHERE len(t) > 0 AND len(bt) > 0),
    s AS (SELECT doc_id, len(w) > 0 AND (len(oa) = 0 OR len(ob) = 0) AS subset, length(array_to_string(w, ' ')) AS c, CASE WHEN len(w) > 0 THEN length(array_to_string(w, ' ')) + 1 ELSE 0 END AS head, array_to_string(oa, ' ') AS ra, array_to_string(ob, ' ') AS rb FROM pairs),
    lead AS (SELECT DISTINCT doc_id FROM s WHERE subset OR (c > 0 AND 2 * c / (2 * c + 1 + least(length(ra), length(rb))) >= 0.9)),
    alike AS (SELECT * FROM s WHERE doc_id NOT IN (FROM lead) AND 2 * (head + least(length(ra), length(rb))) / (2 * head + length(ra) + length(rb)) >= 0.9
        AND levenshtein(ra, rb) <= 2 * (0.1 * (2 * head + length(ra) + length(rb)) + 1)),
    m AS (SELECT *, list_reduce(list_concat([list_transform(range(0, length(rb) + 1), lambda i: 0)], list_transform(string_split(ra, ''), lambda ch: [CAST(ascii(ch) AS BIGINT)])),
            lambda prev, ch: list_reduce(list_concat([[CAST(0 AS BIGINT)]], list_transform(range(1, length(rb) + 1), lambda j: [j])),
                lambda acc, j: list_append(acc, greatest(acc[-1], prev[j[1] + 1], prev[j[1]] + CASE WHEN ascii(rb[j[1]]) = ch[1] THEN 1 ELSE 0 END))))[-1] AS lcs FROM alike)
    SELECT doc_id FROM d WHERE n IS NULL OR (n NOT IN (FROM b) AND doc_id NOT IN (FROM lead) AND doc_id NOT IN (SELECT doc_id FROM m WHERE 2 * (head + lcs) / (2 * head + length(ra) + length(rb)) >= 0.9))""",
)
def t_gate_fuzzy(spark, sf_dir):
    """Documents that are neither equal to a text of the benchmark nor within 0.9 of one."""
    return prep.disjoint(docs(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"), "text", "text", 0.9).select("doc_id")


@BOOK.add(
    "t_split_md5",
    "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('13|' || doc_id), doc_id) <= floor((SELECT count(*) FROM documents) * 0.1 + 1e-9) THEN 'eval' ELSE 'train' END AS part FROM documents",
)
def t_split_md5(spark, sf_dir):
    return prep.split(docs(spark, sf_dir).select("doc_id"), "doc_id").select("doc_id", "part")


@BOOK.add("t_cap", "SELECT doc_id FROM documents ORDER BY md5('13|' || doc_id), doc_id LIMIT 200")
def t_cap(spark, sf_dir):
    return prep.cap(docs(spark, sf_dir).select("doc_id"), "doc_id", 200)


@BOOK.add("t_mix", "SELECT doc_id FROM documents WHERE lang = 'fr' UNION ALL (SELECT doc_id FROM documents WHERE lang = 'en' ORDER BY md5('13|' || doc_id), doc_id LIMIT 100)")
def t_mix(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "lang")
    return prep.mix(d.where("lang = 'fr'"), d.where("lang = 'en'"), "doc_id", 100).select("doc_id")


@BOOK.add(
    "t_percentiles",
    """SELECT lang, count(*) AS count, round(avg(n_chars), 6) AS mean, max(n_chars) AS max, CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY n_chars) AS BIGINT) AS p50, CAST(percentile_disc(0.9) WITHIN GROUP (ORDER BY n_chars) AS BIGINT) AS p90,
    CAST(percentile_disc(0.95) WITHIN GROUP (ORDER BY n_chars) AS BIGINT) AS p95, CAST(percentile_disc(0.99) WITHIN GROUP (ORDER BY n_chars) AS BIGINT) AS p99 FROM documents GROUP BY 1""",
)
def t_percentiles(spark, sf_dir):
    out = stats.nearest_rank(docs(spark, sf_dir), "n_chars", ["lang"])
    return out.withColumn("mean", F.round("mean", 6))


@BOOK.add("t_reason_counts", "SELECT CASE event_type WHEN 'error' THEN 'parse' WHEN 'view' THEN 'node_only' ELSE 'kept' END AS reason, count(*) AS n FROM events GROUP BY 1")
def t_reason_counts(spark, sf_dir):
    q = F.when(F.col("event_type") == "error", "MATCH (u:User RETURN u").when(F.col("event_type") == "view", "MATCH (u:User) RETURN u").otherwise("MATCH (u:User)-[:X]->(d) RETURN d")
    return prep.with_reasons(table(spark, sf_dir, "events").select(q.alias("cypher"))).groupBy("reason").agg(F.count("*").alias("n"))


#: The declared paths of the star graph, of which PLACED is dated and CO_LISTED undirected.
SCHEMA = GraphSchema(
    ["Region", "Nation", "Customer", "Supplier", "Part", "Order"],
    [PathDecl("IN_REGION", "Nation", "Region"), PathDecl("IN_NATION", "Customer", "Nation"), PathDecl("BASED_IN", "Supplier", "Nation"), PathDecl("PLACED", "Customer", "Order"), PathDecl("CONTAINS", "Order", "Part"), PathDecl("SUPPLIED_BY", "Order", "Supplier"), PathDecl("CO_LISTED", "Part", "Part")],
)
MOVES = """WITH RECURSIVE p AS (SELECT * FROM (VALUES (0, 'IN_REGION', 'Nation', 'Region'), (1, 'IN_NATION', 'Customer', 'Nation'), (2, 'BASED_IN', 'Supplier', 'Nation'), (3, 'PLACED', 'Customer', 'Order'), (4, 'CONTAINS', 'Order', 'Part'), (5, 'SUPPLIED_BY', 'Order', 'Supplier'), (6, 'CO_LISTED', 'Part', 'Part')) AS v(idx, type, s, t)),
    m AS (SELECT s AS label, idx, '->' AS arrow, t AS other FROM p WHERE idx <> 6 UNION ALL SELECT t, idx, '<-', s FROM p WHERE idx <> 6 UNION ALL SELECT s, idx, '-', t FROM p WHERE idx = 6),
    w AS (SELECT label AS start, [idx] AS used, idx || arrow AS key, other AS at_, 1 AS n FROM m UNION ALL SELECT start, list_append(used, m.idx), key || ',' || m.idx || m.arrow, m.other, n + 1 FROM w JOIN m ON m.label = at_ WHERE n < 3 AND NOT list_contains(used, m.idx))"""


#: The same walks with their labels, types and arrows in lists, for texts.
SPELT = MOVES[: MOVES.index("m AS")] + """m AS (SELECT s AS label, idx, type, '->' AS arrow, t AS other FROM p WHERE idx <> 6 UNION ALL SELECT t, idx, type, '<-', s FROM p WHERE idx <> 6 UNION ALL SELECT s, idx, type, '-', t FROM p WHERE idx = 6),
    w AS (SELECT label AS start, [idx] AS used, idx || arrow AS key, [label, other] AS labels, [type] AS types, [arrow] AS arrows, 1 AS n FROM m
        UNION ALL SELECT start, list_append(used, m.idx), key || ',' || m.idx || m.arrow, list_append(labels, m.other), list_append(types, m.type), list_append(arrows, m.arrow), n + 1 FROM w JOIN m ON m.label = labels[-1] WHERE n < 3 AND NOT list_contains(used, m.idx))"""


def star_walks(spark) -> DataFrame:
    return walks.walks(walks.moves(spark, SCHEMA, frozenset({"CO_LISTED"}), frozenset({"PLACED"})))


@BOOK.add("t_walks", MOVES + " SELECT start, key, CAST(NULL AS INTEGER) AS active_pos FROM w UNION ALL SELECT start, key, CAST(list_position(used, 3) - 1 AS INTEGER) FROM w WHERE list_contains(used, 3)")
def t_walks(spark, sf_dir):
    return star_walks(spark).select("start", "key", "active_pos")


@BOOK.add(
    "t_walk_text",
    SPELT + """, a AS (SELECT *, CAST(NULL AS INTEGER) AS active_pos FROM w UNION ALL SELECT *, CAST(list_position(used, 3) - 1 AS INTEGER) FROM w WHERE list_contains(used, 3)),
    v AS (SELECT *, list_transform(range(1, len(labels) + 1), lambda i: lower(labels[i][1]) || CASE WHEN len(list_filter(labels[1:i - 1], lambda x: x[1] = labels[i][1])) > 0 THEN CAST(len(list_filter(labels[1:i - 1], lambda x: x[1] = labels[i][1])) + 1 AS VARCHAR) ELSE '' END) AS vars FROM a)
    SELECT start, key, active_pos, '(' || vars[1] || ':' || start || ')' || array_to_string(list_transform(range(1, len(types) + 1), lambda i: CASE arrows[i] WHEN '<-' THEN '<-' ELSE '-' END || '[:' || types[i] ||
        CASE WHEN active_pos IS NOT NULL AND active_pos = i - 1 THEN ' {active:true}' ELSE '' END || ']' || CASE arrows[i] WHEN '->' THEN '->' ELSE '-' END || '(' || vars[i + 1] || ':' || labels[i + 1] || ')'), '') AS pattern FROM v""",
)
def t_walk_text(spark, sf_dir):
    """Every walk as a pattern."""
    short = {"Region": "r", "Nation": "n", "Customer": "c", "Supplier": "s", "Part": "p", "Order": "o"}
    w = star_walks(spark)
    return w.select("start", "key", "active_pos", walks.render(F.col("start"), F.col("hops"), F.col("active_pos"), short).alias("pattern"))


@BOOK.add("t_multi_pairs", "SELECT 'User' AS source, 'Day' AS target, count(DISTINCT event_type) AS n FROM events HAVING count(DISTINCT event_type) >= 2")
def t_multi_pairs(spark, sf_dir):
    paths = table(spark, sf_dir, "events").select(F.col("event_type").alias("type"), F.lit("User").alias("source"), F.lit("Day").alias("target"))
    return walks.multi_pairs(paths)


@BOOK.add("t_round_robin", "SELECT f AS form_no, k, ['click', 'error', 'purchase', 'signup', 'view'][k % 5 + 1] AS type FROM range(0, 3) AS a(f0), range(0, 7) AS b(k0), (SELECT 1), LATERAL (SELECT CAST(f0 AS INTEGER) AS f, CAST(k0 AS INTEGER) AS k)")
def t_round_robin(spark, sf_dir):
    kinds = table(spark, sf_dir, "events").select(F.col("event_type").alias("type"), F.lit("User").alias("source"), F.lit("Day").alias("target")).distinct()
    kinds = kinds.withColumn("idx", F.row_number().over(Window.partitionBy("source", "target").orderBy("type")))
    return walks.ambiguous_rows(walks.multi_pairs(kinds), kinds, ["a {x}", "b {x}", "c {x}"], 7).select("form_no", "k", "type")


@BOOK.add(
    "t_phrases",
    SPELT + " SELECT start, key, list_reduce(list_concat([lower(start)], list_transform(range(1, len(types) + 1), lambda i: lower(types[i]) || arrows[i])), lambda np, x: 'the ' || x || ' of ' || np) AS phrase FROM w",
)
def t_phrases(spark, sf_dir):
    """Nested noun phrases of every walk, by templates of type and arrow."""
    wraps = {f"{t}{a}": f"the {t.lower()}{a} of {{np}}" for t in SCHEMA.types for a in ("->", "<-", "-")}
    w = star_walks(spark).where("active_pos is null")
    return w.select("start", "key", walks.phrases(w, "hops", wraps, F.lower("start")).alias("phrase"))


@BOOK.add("t_type_counters", "SELECT event_type AS type, count(DISTINCT user_id) AS n FROM events GROUP BY 1")
def t_type_counters(spark, sf_dir):
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("types"))
    return per.select(F.explode("types").alias("type")).groupBy("type").agg(F.count("*").alias("n"))


@BOOK.add("t_model_inputs", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(least(l_linenumber + 2, 6) AS INTEGER) AS tokens, CAST(least(l_linenumber, 6) AS INTEGER) AS masked FROM lineitem")
def t_model_inputs(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("p", F.sequence(F.lit(1), F.col("l_linenumber"))).withColumn("c", F.array(F.lit(7), F.lit(8)))
    out = prep.model_inputs(li, "p", "c", 6, 0)
    masked = F.size(F.filter(F.arrays_zip("labels", "attention_mask"), lambda x: (x["labels"] == -100) & (x["attention_mask"] == 1)))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.aggregate("attention_mask", F.lit(0), lambda s, x: s + x).alias("tokens"), masked.alias("masked"))


@BOOK.add(
    "s_interval_state",
    """WITH r AS (SELECT *, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events)
    SELECT event_id, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS failures FROM r""",
)
def s_interval_state(spark, sf_dir):
    """Failures of a user since the last purchase (an extension: running retry state)."""
    from ..streaming.events import retry_state

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("failed", F.col("event_type") == "error").withColumn("run", F.sum((F.col("event_type") == "purchase").cast("int")).over(w))
    return retry_state(e).select("event_id", "failures")


@BOOK.add("j_anti_semi", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS pending FROM customer")
def j_anti_semi(spark, sf_dir):
    """Semi and anti joins, put together again."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    on = F.col("c_custkey") == F.col("o_custkey")
    yes, no = c.join(o, on, "left_semi"), c.join(o, on, "left_anti")
    return yes.select("c_custkey", F.lit(True).alias("pending")).union(no.select("c_custkey", F.lit(False)))
