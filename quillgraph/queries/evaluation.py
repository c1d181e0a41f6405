"""Queries over result sets, metrics, probe statistics and benchmark gates (families X, M, Q, B).

Events stand in for attempts: a user is a question, its events are attempts in order, the last one is final.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import evaluate, gates, metrics, stats
from ..plans.tpch import spread, star, table
from . import Book

BOOK = Book()


def attempts(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    no = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    kind, user = F.col("event_type"), F.col("user_id") % 5
    types = F.element_at(F.array(*map(F.lit, metrics.TYPES)), user.cast("int"))
    return e.withColumn("attempt_no", no).select(
        F.when(user < 3, "schema_grounded").otherwise("disambiguation_enhanced").alias("condition"), F.col("user_id").alias("question_id"), "attempt_no",
        (F.col("attempt_no") == 1).alias("is_first_attempt"), kind.isin("purchase", "signup").alias("is_correct"), (kind != "error").alias("matches_any"),
        F.when(user > 0, types).alias("ambiguity_type"), F.when(kind == "error", "wrong_result").alias("failure_mode"), (F.col("value") < 90).alias("syntax_valid"),
        F.when(F.col("value") < 50, 1.0).otherwise(0.5).alias("schema_score"), F.when(F.col("value") < 50, "accept").when(F.col("value") < 90, "schema_linker").otherwise("query_generator").alias("route_to"),
        (F.col("value") < 90).alias("evaluated"), F.least(F.col("attempt_no") - 1, F.lit(3)).cast("int").alias("retry_count"),
    )


ATTEMPTS = """WITH a AS (SELECT CASE WHEN user_id % 5 < 3 THEN 'schema_grounded' ELSE 'disambiguation_enhanced' END AS condition, user_id AS question_id,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back,
    event_type IN ('purchase', 'signup') AS ok, event_type <> 'error' AS fits, CASE WHEN user_id % 5 > 0 THEN ['schema', 'entity', 'intent', 'temporal'][user_id % 5] END AS kind,
    event_type = 'error' AS wrong, value < 90 AS syn, value < 50 AS acc FROM events),
    q AS (SELECT f.condition, f.question_id, f.ok, f.fits, f.kind, f.syn, f.acc, f.no, i.acc AS acc1, i.syn AND i.ok AS ok1, i.syn AND i.wrong AS wrong1 FROM a f JOIN a i USING (question_id) WHERE f.back = 1 AND i.no = 1)"""


@BOOK.add(
    "m_rates",
    ATTEMPTS + """ SELECT condition, count(*) AS n_total, count(kind) AS n_ambiguous, round(avg(ok::INT), 6) AS ex, round(avg(fits::INT), 6) AS ea, round(avg(acc::INT), 6) AS kg_valid, round(avg(syn::INT), 6) AS syntax,
    round(coalesce(avg(acc::INT) FILTER (syn), 0), 6) AS schema_given_syntax, round(avg(ok1::INT), 6) AS pass_at_1, round(coalesce(avg(fits::INT) FILTER (kind IS NOT NULL), 0), 6) AS ambiguous_ea,
    round(avg(acc1::INT), 6) AS initial_valid, round(avg(acc::INT), 6) AS post_valid, round(coalesce(avg(acc::INT) FILTER (NOT acc1), 0), 6) AS structural_repair,
    round(coalesce(avg(ok::INT) FILTER (wrong1), 0), 6) AS semantic_repair, round(avg(least(no - 1, 3)), 6) AS average_iterations FROM q GROUP BY 1""",
)
def m_rates(spark, sf_dir):
    m = metrics.bundle(attempts(spark, sf_dir))
    return m.select("condition", "n_total", "n_ambiguous", *(F.round(c, 6).alias(c) for c in m.columns[3:]))


@BOOK.add(
    "m_by_type",
    ATTEMPTS + """ SELECT condition, t AS ambiguity_type, count(question_id) AS n, round(coalesce(avg(fits::INT), 0), 6) AS ea
    FROM (SELECT DISTINCT condition FROM q) CROSS JOIN (SELECT unnest(['schema', 'entity', 'intent', 'temporal']) AS t) LEFT JOIN q USING (condition) WHERE kind = t OR kind IS NULL AND false GROUP BY ALL
    UNION ALL SELECT condition, t, 0, 0 FROM (SELECT DISTINCT condition FROM q) CROSS JOIN (SELECT unnest(['schema', 'entity', 'intent', 'temporal']) AS t) WHERE (condition, t) NOT IN (SELECT (condition, kind) FROM q WHERE kind IS NOT NULL)""",
)
def m_by_type(spark, sf_dir):
    return metrics.by_type(attempts(spark, sf_dir)).select("condition", "ambiguity_type", "n", F.round("ea", 6).alias("ea"))


CONFUSION = """WITH p AS (SELECT user_id, event_type = 'click' AS pred, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back, event_type FROM events),
    l AS (SELECT user_id, bool_or(pred AND back = 1) AS pred, bool_or(pred) AS ever, bool_or(event_type IN ('purchase', 'signup') AND back = 1) AS ok, user_id % 5 > 0 AS truth FROM p GROUP BY user_id),
    c AS (SELECT count(*) FILTER (pred AND truth) AS tp, count(*) FILTER (pred AND NOT truth) AS fp, count(*) FILTER (NOT pred AND truth) AS fn, coalesce(avg(ok::INT) FILTER (ever), 0) AS dsr FROM l),
    r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS prec, coalesce(tp / nullif(tp + fn, 0), 0) AS rec FROM c)"""


def detected(spark, sf_dir) -> DataFrame:
    a = attempts(spark, sf_dir)
    e = table(spark, sf_dir, "events")
    no = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    predictions = e.select(F.col("user_id").alias("question_id"), no.alias("attempt_no"), (F.col("event_type") == "click").alias("predicted"))
    final = metrics.per_question(a).select("question_id", F.col("ambiguity_type").isNotNull().alias("is_ambiguous"), "is_correct")
    return metrics.detection(predictions, final)


@BOOK.add("m_confusion_f1", CONFUSION + " SELECT tp, fp, fn, round(prec, 6) AS prec, round(rec, 6) AS rec, round(coalesce(2 * prec * rec / nullif(prec + rec, 0), 0), 6) AS f1 FROM r")
def m_confusion_f1(spark, sf_dir):
    return detected(spark, sf_dir).select("tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("prec", "rec", "f1")))


@BOOK.add("m_dsr", CONFUSION + " SELECT round(dsr, 6) AS dsr FROM r")
def m_dsr(spark, sf_dir):
    return detected(spark, sf_dir).select(F.round("dsr", 6).alias("dsr"))


@BOOK.add(
    "m_repair",
    ATTEMPTS + " SELECT condition, round(coalesce(avg(acc::INT) FILTER (NOT acc1), 0), 6) AS structural_repair, round(coalesce(avg(ok::INT) FILTER (wrong1), 0), 6) AS semantic_repair FROM q GROUP BY 1",
)
def m_repair(spark, sf_dir):
    m = metrics.bundle(attempts(spark, sf_dir))
    return m.select("condition", F.round("structural_repair", 6).alias("structural_repair"), F.round("semantic_repair", 6).alias("semantic_repair"))


@BOOK.add("m_table_pivot", ATTEMPTS + ", m AS (SELECT condition, avg(ok::INT) AS ex, avg(fits::INT) AS ea FROM q GROUP BY 1) SELECT 'ex' AS metric, round(max(ex) FILTER (condition = 'schema_grounded'), 6) AS schema_grounded, round(max(ex) FILTER (condition = 'disambiguation_enhanced'), 6) AS disambiguation_enhanced FROM m UNION ALL SELECT 'ea', round(max(ea) FILTER (condition = 'schema_grounded'), 6), round(max(ea) FILTER (condition = 'disambiguation_enhanced'), 6) FROM m")
def m_table_pivot(spark, sf_dir):
    long = metrics.long_form(metrics.bundle(attempts(spark, sf_dir)), ["ex", "ea"])
    wide = long.groupBy("metric").pivot("condition", ["schema_grounded", "disambiguation_enhanced"]).agg(F.max("value"))
    return wide.select("metric", F.round("schema_grounded", 6).alias("schema_grounded"), F.round("disambiguation_enhanced", 6).alias("disambiguation_enhanced"))


@BOOK.add("m_assemble", "SELECT c_custkey AS question_id, coalesce(bool_or(event_type = 'purchase'), false) AS is_correct, CASE WHEN count(event_id) = 0 THEN 'invalid_query' END AS failure_mode FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1")
def m_assemble(spark, sf_dir):
    finals = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("question_id")).agg(F.bool_or(F.col("event_type") == "purchase").alias("is_correct")).select("question_id", "is_correct", F.lit(False).alias("matches_any"), F.lit(None).cast("string").alias("failure_mode"))
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("question_id"))
    return metrics.assemble(asked, finals).select("question_id", "is_correct", "failure_mode")


@BOOK.add(
    "x_rowset_equal",
    """SELECT 'same' AS pair, true AS equal UNION ALL SELECT 'other order and names', true UNION ALL SELECT 'swapped columns', false UNION ALL
    SELECT 'fewer rows', count(*) = (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem)) FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem WHERE l_returnflag <> 'A')
    UNION ALL SELECT 'rounding', true UNION ALL SELECT 'both empty', true""",
)
def x_rowset_equal(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    a = li.select("l_returnflag", "l_linestatus")
    # both sides are computed anew: sums of doubles would depend on the order of rows
    agg = li.groupBy("l_returnflag").agg(stats.exact_sum("l_extendedprice").alias("s"))
    pairs = {
        "same": (a, a), "other order and names": (a, a.toDF("x", "y").distinct().orderBy(F.desc("x"))), "swapped columns": (a, a.select("l_linestatus", "l_returnflag")),
        "fewer rows": (a, a.where("l_returnflag <> 'A'")), "rounding": (agg, agg.select("l_returnflag", (F.col("s") + 1e-8).alias("t"))), "both empty": (a.where("false"), agg.where("false")),
    }
    parts = [evaluate.row_sets_equal(x, y).select(F.lit(name).alias("pair"), "equal") for name, (x, y) in pairs.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@BOOK.add(
    "x_similar",
    """WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, 'x' || l_returnflag AS t, l_returnflag AS f, CAST(l_quantity AS BIGINT) AS q, [l_orderkey % 50, l_linenumber, 1.0]::DOUBLE[] AS e FROM lineitem),
    r AS (SELECT k, n, t || '!' AS t, f, CASE WHEN f = 'A' THEN q + 1 ELSE q END AS q, CASE WHEN n = 6 THEN [1.0, e[1], -e[2]] ELSE [e[1] + 1, e[2], e[3]] END AS e FROM l),
    pairs AS (
        SELECT 'wording' AS pair, row_number() OVER (ORDER BY list_sort([k::VARCHAR, n::VARCHAR, t]), [k::VARCHAR, n::VARCHAR, t]) AS at, 'l' AS side, [k::VARCHAR, n::VARCHAR] AS own, e FROM l
        UNION ALL SELECT 'wording', row_number() OVER (ORDER BY list_sort([k::VARCHAR, n::VARCHAR, t]), [k::VARCHAR, n::VARCHAR, t]), 'r', [k::VARCHAR, n::VARCHAR], e FROM r
        UNION ALL SELECT 'repeats', row_number() OVER (ORDER BY list_sort([f, q::VARCHAR]), [f, q::VARCHAR]), 'l', [f, q::VARCHAR], NULL FROM l
        UNION ALL SELECT 'repeats', row_number() OVER (ORDER BY list_sort([f, q::VARCHAR]), [f, q::VARCHAR]), 'r', [f, q::VARCHAR], NULL FROM r
        UNION ALL SELECT 'fewer', row_number() OVER (ORDER BY list_sort([f, q::VARCHAR]), [f, q::VARCHAR]), 'l', [f, q::VARCHAR], NULL FROM l
        UNION ALL SELECT 'fewer', row_number() OVER (ORDER BY list_sort([f, q::VARCHAR]), [f, q::VARCHAR]), 'r', [f, q::VARCHAR], NULL FROM l WHERE n < 7
        UNION ALL SELECT 'same', row_number() OVER (ORDER BY list_sort([f, q::VARCHAR]), [f, q::VARCHAR]), 'l', [f, q::VARCHAR], NULL FROM l
        UNION ALL SELECT 'same', row_number() OVER (ORDER BY list_sort([f, q::VARCHAR]), [f, q::VARCHAR]), 'r', [f, q::VARCHAR], NULL FROM l
    ), met AS (SELECT a.pair, a.own = b.own AND (a.e IS NULL OR coalesce(list_cosine_similarity(a.e, b.e) >= 0.95, false)) AS fits FROM pairs a JOIN pairs b ON a.pair = b.pair AND a.at = b.at AND a.side = 'l' AND b.side = 'r'),
    n AS (SELECT pair, count(*) FILTER (side = 'l') AS n_left, count(*) FILTER (side = 'r') AS n_right FROM pairs GROUP BY 1), u AS (SELECT pair, count(*) FILTER (NOT fits) AS unlike FROM met GROUP BY 1)
    SELECT pair, n_left, n_right, unlike, unlike = 0 AND n_left = n_right AS similar FROM n JOIN u USING (pair)""",
)
def x_similar(spark, sf_dir):
    """Two results as long as lineitem, place by place: other wording, repeats of few rows, fewer rows, the same."""
    li = table(spark, sf_dir, "lineitem")
    n, a = F.col("n"), F.col("f") == "A"
    left = li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.concat(F.lit("x"), "l_returnflag").alias("t"), F.col("l_returnflag").alias("f"), F.col("l_quantity").cast("long").alias("q"), F.array((F.col("l_orderkey") % 50).cast("double"), F.col("l_linenumber").cast("double"), F.lit(1.0)).alias("e"))
    e = F.when(n == 6, F.array(F.lit(1.0), F.col("e")[0], -F.col("e")[1])).otherwise(F.array(F.col("e")[0] + 1, F.col("e")[1], F.col("e")[2]))
    right = left.select("k", "n", F.concat("t", F.lit("!")).alias("t"), "f", F.when(a, F.col("q") + 1).otherwise(F.col("q")).alias("q"), e.alias("e"))
    parts = {
        "wording": (left, right, ["k", "n", "t"], {"t": "e"}), "repeats": (left, right, ["f", "q"], {}), "fewer": (left, left.where("n < 7"), ["f", "q"], {}), "same": (left, left, ["f", "q"], {}),
    }
    rows = [evaluate.similar_sets(x, y, values, vectors).select(F.lit(name).alias("pair"), "*") for name, (x, y, values, vectors) in parts.items()]
    return reduce(DataFrame.union, rows)


@BOOK.add(
    "x_divergence",
    """WITH s AS (SELECT user_id AS item, list_position(['click', 'error', 'view'], event_type) - 1 AS pos, list_sort(list(DISTINCT strftime(ts, '%a'))) AS days FROM events WHERE event_type IN ('click', 'error', 'view') GROUP BY ALL)
    SELECT a.item, CAST(a.pos AS INTEGER) AS first, CAST(b.pos AS INTEGER) AS second FROM s a JOIN s b ON a.item = b.item AND a.pos < b.pos AND a.days = b.days""",
)
def x_divergence(spark, sf_dir):
    """Interpretations of one item whose results are the same set: weekdays on which a user clicked, failed or looked."""
    e = table(spark, sf_dir, "events").where("event_type in ('click', 'error', 'view')")
    pos = F.array_position(F.array(*map(F.lit, ("click", "error", "view"))), F.col("event_type")) - 1
    sets = evaluate.fingerprint(e.select(F.col("user_id").alias("item"), pos.cast("int").alias("pos"), F.date_format("ts", "E").alias("day")), ("item", "pos"))
    return evaluate.divergent(sets, "item", "pos")


@BOOK.add("x_outcome", "SELECT event_id, CASE WHEN value >= 90 THEN 'invalid_query' WHEN event_type IN ('purchase', 'signup') THEN NULL WHEN event_type <> 'error' THEN 'valid_non_default' ELSE 'wrong_result' END AS failure FROM events")
def x_outcome(spark, sf_dir):
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select("event_id", evaluate.outcome(F.col("value") < 90, kind.isin("purchase", "signup"), kind != "error").alias("failure"))


AUC = """WITH d AS (SELECT lang, n_chars, quality = 1 AS pos FROM documents JOIN labels USING (doc_id)), g AS (SELECT {k} n_chars, count(*) AS n, sum(pos::INT) AS p FROM d GROUP BY ALL),
    m AS (SELECT *, sum(n) OVER ({w} ORDER BY n_chars) - (n - 1) / 2 AS mid FROM g), s AS (SELECT {k} CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n - p) AS BIGINT) AS n_neg, sum(mid * p) AS s FROM m {g})
    SELECT {k} n_pos, n_neg, round(CASE WHEN n_pos = 0 OR n_neg = 0 THEN 0.5 ELSE (s - n_pos * (n_pos + 1) / 2) / (n_pos::DOUBLE * n_neg) END, 6) AS auc FROM s"""


def labelled(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")


@BOOK.add("q_auc", AUC.format(k="", w="", g=""))
def q_auc(spark, sf_dir):
    return stats.roc_auc(labelled(spark, sf_dir), "n_chars", F.col("quality") == 1).select("n_pos", "n_neg", F.round("auc", 6).alias("auc"))


@BOOK.add("q_auc_by_group", AUC.format(k="lang,", w="PARTITION BY lang", g="GROUP BY lang"))
def q_auc_by_group(spark, sf_dir):
    return stats.roc_auc(labelled(spark, sf_dir), "n_chars", F.col("quality") == 1, ["lang"]).select("lang", "n_pos", "n_neg", F.round("auc", 6).alias("auc"))


@BOOK.add(
    "q_auc_table",
    """WITH d AS (SELECT n_chars::DOUBLE AS length_, (-doc_id)::DOUBLE AS age, quality = 1 AS pos FROM documents JOIN labels USING (doc_id)), l AS (UNPIVOT d ON length_, age INTO NAME signal VALUE score),
    g AS (SELECT signal, score, count(*) AS n, sum(pos::INT) AS p FROM l GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY signal ORDER BY score) - (n - 1) / 2 AS mid FROM g),
    s AS (SELECT signal, sum(p) AS np, sum(n - p) AS nn, sum(mid * p) AS s FROM m GROUP BY 1), a AS (SELECT signal, (s - np * (np + 1) / 2) / (np::DOUBLE * nn) AS auc FROM s)
    SELECT signal, round(auc, 6) AS auc, CASE signal WHEN 'length_' THEN 0.622::DOUBLE ELSE 0.5::DOUBLE END AS prior, round(auc - CASE signal WHEN 'length_' THEN 0.622 ELSE 0.5 END, 6) AS gain FROM a""",
)
def q_auc_table(spark, sf_dir):
    df = labelled(spark, sf_dir).select("quality", F.col("n_chars").cast("double").alias("length_"), (-F.col("doc_id")).cast("double").alias("age"))
    out = stats.auc_table(df, ["length_", "age"], F.col("quality") == 1, {"length_": 0.622})
    return out.select("signal", F.round("auc", 6).alias("auc"), "prior", F.round("gain", 6).alias("gain"))


@BOOK.add(
    "q_select_constrained",
    """WITH s AS (SELECT event_type AS setting, round(avg((value < 30)::INT), 6) AS cov, round(avg(value) / 100, 6) AS auc, round(avg((value > 90)::INT), 6) AS hallucination FROM events GROUP BY 1)
    SELECT *, cov >= 0.85 AS qualified FROM s ORDER BY (cov >= 0.85)::INT DESC, CASE WHEN cov >= 0.85 THEN auc ELSE cov END DESC, CASE WHEN cov >= 0.85 THEN -hallucination ELSE auc END DESC, setting LIMIT 1""",
)
def q_select_constrained(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("setting")).agg(
        F.round(F.avg((F.col("value") < 30).cast("int")), 6).alias("cov"), F.round(F.avg("value") / 100, 6).alias("auc"), F.round(F.avg((F.col("value") > 90).cast("int")), 6).alias("hallucination")
    )
    return stats.select_constrained(s)


@BOOK.add("q_stratified", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events) WHERE n <= 24")
def q_stratified(spark, sf_dir):
    return stats.stratified(table(spark, sf_dir, "events"), "event_type", ["event_id"], 24).select("event_type", "event_id")


@BOOK.add("q_rates_by_type", "SELECT event_type, count(*) AS n, round(avg((value < 50)::INT), 6) AS rate FROM events GROUP BY 1")
def q_rates_by_type(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg((F.col("value") < 50).cast("double")), 6).alias("rate"))


@BOOK.add("b_distribution", "SELECT p_type AS kind, CAST(400 AS BIGINT) AS expected, count(*) AS found FROM part GROUP BY 1 HAVING count(*) <> 400")
def b_distribution(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumnRenamed("p_type", "kind")
    kinds = [r["kind"] for r in part.select("kind").distinct().collect()]
    return gates.distribution(part, "kind", {k: 400 for k in kinds})


@BOOK.add("b_coverage", "SELECT t AS type, count(DISTINCT p_partkey) AS items FROM (SELECT unnest(['Brand#1', 'Brand#2', 'Brand#3', 'Brand#99']) AS t) LEFT JOIN part ON p_brand = t AND p_size > 40 GROUP BY 1 HAVING count(DISTINCT p_partkey) < 20")
def b_coverage(spark, sf_dir):
    used = table(spark, sf_dir, "part").where("p_size > 40").groupBy(F.col("p_brand").alias("type")).agg(F.count_distinct("p_partkey").alias("items"))
    wanted = spark.createDataFrame([(t,) for t in ("Brand#1", "Brand#2", "Brand#3", "Brand#99")], "type string")
    return gates.cover(wanted, used, "type", "items", 20)


@BOOK.add(
    "b_type_coverage",
    """WITH t AS (SELECT k || '_' || d AS type FROM (VALUES ('CLICK'), ('VIEW'), ('PURCHASE'), ('NEVER')) AS a(k), (VALUES ('MON'), ('TUE'), ('WED'), ('THU'), ('FRI'), ('SAT'), ('SUN')) AS b(d)),
    u AS (SELECT upper(event_type) || '_' || upper(strftime(ts, '%a')) AS type, count(DISTINCT user_id) AS n FROM events GROUP BY 1)
    SELECT type, coalesce(n, 0) AS items FROM t LEFT JOIN u USING (type) WHERE coalesce(n, 0) < 130""",
)
def b_type_coverage(spark, sf_dir):
    """Types that occur in the queries of fewer than 130 users, by kind of event and weekday, or in none."""
    used = F.concat(F.upper("event_type"), F.lit("_"), F.upper(F.date_format("ts", "E")))
    items = table(spark, sf_dir, "events").select(F.col("user_id").alias("item"), F.concat(F.lit("MATCH (u)-[:"), used, F.lit("|SEEN]->(d) RETURN u")).alias("cypher"))
    wanted = [f"{k}_{d}" for k in ("CLICK", "VIEW", "PURCHASE", "NEVER") for d in ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")]
    return gates.type_coverage(items, "item", "cypher", wanted, 130)


@BOOK.add("b_unique", "SELECT p_name AS key, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def b_unique(spark, sf_dir):
    return gates.duplicates(table(spark, sf_dir, "part"), F.col("p_name"))


@BOOK.add("b_hops", "SELECT event_id, event_id % 5 AS hops FROM events WHERE event_id % 5 <> user_id % 4 OR event_id % 5 > 3")
def b_hops(spark, sf_dir):
    """Queries of none to four hops whose declared number, made of the user, is another, or which have too many."""
    hop = F.concat(F.lit("-[:HOP {at:'"), F.col("user_id").cast("string"), F.lit("]'}]->()"))
    q = F.concat(F.lit("MATCH (a)"), F.repeat(hop, (F.col("event_id") % 5).cast("int")), F.lit(" RETURN a"))
    items = spread(table(spark, sf_dir, "events")).select("event_id", q.alias("cypher"), (F.col("user_id") % 4).alias("declared"))
    return gates.hop_honesty(items, "cypher", "declared").select("event_id", "hops")


@BOOK.add(
    "b_nonempty",
    """SELECT 'MATCH (n:Nation {n_nationkey:' || n_nationkey || '})<-[:BASED_IN]-(s:Supplier) WHERE s.s_acctbal > 9000 RETURN s.s_name AS a' AS cypher
    FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)""",
)
def b_nonempty(spark, sf_dir):
    """The same question of every nation, asked twice, executed once; those without rows are reported."""
    s = star(spark, sf_dir)
    text = F.concat(F.lit("MATCH (n:Nation {n_nationkey:"), F.col("n_nationkey").cast("string"), F.lit("})<-[:BASED_IN]-(s:Supplier) WHERE s.s_acctbal > 9000 RETURN s.s_name AS a"))
    asked = table(spark, sf_dir, "nation").select(text.alias("cypher"))
    texts = gates.once(asked.union(asked), "cypher")
    # each text is a plan of its own; there are as many as nations
    counts = [s.cypher(r["cypher"]).agg(F.count("*").alias("n_rows")).select(F.lit(r["cypher"]).alias("cypher"), "n_rows") for r in texts.collect()]
    return gates.empty_results(texts, reduce(DataFrame.union, counts), "cypher").select("cypher")


@BOOK.add(
    "b_report",
    """WITH g AS (SELECT 'unique' AS gate, count(*) AS violations FROM (SELECT p_name FROM part GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'keys', count(*) FROM (SELECT p_partkey FROM part GROUP BY 1 HAVING count(*) > 1))
    SELECT gate, violations, violations = 0 AS passed FROM g UNION ALL SELECT 'all', CAST(sum(violations) AS BIGINT), bool_and(violations = 0) FROM g""",
)
def b_report(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return gates.report({"unique": gates.duplicates(part, F.col("p_name")), "keys": gates.duplicates(part, F.col("p_partkey"))})
