"""Queries over composed steps: model completions joined back, lookups, gates, settings and the training-set build.

The event stream stands in for model output here too: an event, or a user, is a question.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import patterns, prompts, strings
from ..operators import ambiguity, candidates, compose, gates, metrics, prep, registry, retry, stats, walks
from ..plans.catalog import GraphSchema, PathDecl
from ..plans.tpch import star, stream, table
from ..sources import benchmark
from ..sources.benchmark import RecordedCompletions
from . import Book
from .evaluation import ATTEMPTS, CONFUSION, attempts, detected
from .linking import ALL_BEAMS, BOOK as LINKING, EVENT_SCHEMA, LEGAL, beams, completions
from .preparation import SPELT, star_walks

BOOK = Book()


@BOOK.add(
    "c_committed",
    """WITH e AS (SELECT event_id, upper(event_type) AS t, event_id % 2 = 1 AS live, event_id % 3 AS m FROM events)
    SELECT event_id, 'rel_1' AS slot, 'relationship_type' AS element_type, t AS name, 'User' AS source_label, 'Day' AS target_label, CASE WHEN live AND m = 0 THEN false ELSE live END AS active,
        CASE WHEN live AND m = 1 OR NOT live AND m = 0 THEN 'exact' WHEN live AND m = 0 THEN 'plain' ELSE 'new' END AS origin FROM e
    UNION ALL SELECT event_id, 'node_1', 'node_label', 'Extra', NULL, NULL, false, 'new' FROM e WHERE NOT live""",
)
def c_committed(spark, sf_dir):
    """Committed patterns looked up among the candidates of their question, with both fallbacks."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("question_id"), F.upper("event_type").alias("t"), (F.col("event_id") % 2 == 1).alias("live"), (F.col("event_id") % 3).alias("m"))
    text = F.when(F.col("live"), F.concat(F.lit("(d:Day)<-[r:"), "t", F.lit(" {active:true}]-(u:User), (u)-[x]-(d)"))).otherwise(F.concat(F.lit("(u:User)-[:"), "t", F.lit("]->(d:Day), (x:Extra)")))
    known = e.where("m < 2").select("question_id", F.lit("relationship_type").alias("element_type"), F.col("t").alias("name"), F.lit("User").alias("source_label"), F.lit("Day").alias("target_label"), (F.col("m") == 1).alias("active"))
    return candidates.committed_elements(e.select("question_id", text.alias("pattern")), known).withColumnRenamed("question_id", "event_id")


@BOOK.add(
    "c_link_status",
    f"""WITH {ALL_BEAMS}, n AS (SELECT question_id, count(*) AS n_beams, count(*) FILTER (kind <> 'error') AS n_valid FROM beams GROUP BY 1)
    SELECT CAST(question_id AS VARCHAR) AS question_id, n_beams, n_valid, CASE WHEN n_valid < 3 THEN 'no_valid_beams' ELSE 'ok' END AS status FROM n""",
)
def c_link_status(spark, sf_dir):
    """Prompts for every user, their recorded completions, and what came of them; at least three beams have to be valid."""
    said = completions(spark, sf_dir, None).select("question_id", F.lit("schema_linker").alias("stage"), F.lit(0).alias("attempt"), "rank", "text", "score")
    questions = table(spark, sf_dir, "events").select(F.col("user_id").alias("question_id")).distinct().withColumn("question", F.concat(F.lit("What did "), "question_id", F.lit(" do?")))
    return compose.link(questions, RecordedCompletions(said), EVENT_SCHEMA, min_valid=3)[1]


@BOOK.add(
    "a_detect",
    """WITH v AS (SELECT event_id, value / 100 AS s, event_id % 10 / 10 AS e, event_type FROM events)
    SELECT CAST(event_id AS VARCHAR) AS question_id, event_type IN ('purchase', 'signup', 'view') AS parsed,
        CASE WHEN event_type IN ('purchase', 'signup') THEN true WHEN event_type = 'view' THEN false ELSE s >= 0.6 OR e >= 0.8 END AS is_ambiguous,
        CASE WHEN event_type = 'purchase' THEN 'schema,intent' WHEN event_type = 'signup' THEN 'entity' WHEN event_type = 'view' THEN ''
            ELSE concat_ws(',', CASE WHEN s >= 0.6 THEN 'schema' END, CASE WHEN e >= 0.8 THEN 'entity' END) END AS detected FROM v""",
)
def a_detect(spark, sf_dir):
    """Verdicts of recorded completions; clicks have none and errors an unreadable one, so their entropies decide."""
    e = table(spark, sf_dir, "events")
    text = (
        F.when(F.col("event_type") == "purchase", 'Yes.\n{"is_ambiguous": true, "detected_types": ["schema", "intent", "mood"]}').when(F.col("event_type") == "signup", '```json\n{"is_ambiguous": true, "detected_types": ["entity"]}\n```')
        .when(F.col("event_type") == "view", '{"is_ambiguous": false, "detected_types": ["schema"]}').otherwise('{"is_ambiguous": "perhaps"')
    )
    said = e.where("event_type <> 'click'").select(F.col("event_id").cast("string").alias("question_id"), F.lit("ambiguity_detector").alias("stage"), F.lit(0).alias("attempt"), F.lit(1).alias("rank"), text.alias("text"), F.lit(0.0).alias("score"))
    scored = e.select(F.col("event_id").alias("question_id"), F.concat(F.lit("About "), "event_type").alias("question"), (F.col("value") / 100).alias("schema_entropy"), (F.col("event_id") % 10 / 10).alias("entity_entropy"))
    out = compose.detect(scored, RecordedCompletions(said), EVENT_SCHEMA.to_prompt())
    return out.select("question_id", "parsed", "is_ambiguous", F.array_join("detected_types", ",").alias("detected"))


@BOOK.add(
    "d_choose",
    """WITH e AS (SELECT event_id, event_type AS k, event_id % 3 AS n FROM events)
    SELECT CAST(event_id AS VARCHAR) AS question_id, CASE WHEN k = 'error' OR k IN ('view', 'click') AND n = 2 THEN 'exhausted' WHEN k IN ('view', 'click') THEN 'next' ELSE 'accept' END AS decision,
        CASE WHEN k IN ('purchase', 'signup') THEN '(u:User)-[:' || upper(k) || ']->(d:Day)' WHEN k IN ('view', 'click') AND n < 2 THEN 'choice ' || (n + 1) END AS committed FROM e""",
)
def d_choose(spark, sf_dir):
    """Decisions of a disambiguator with two ranked choices, none, one or both of which were tried before."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("question_id"), "event_type", F.col("event_id") % 3 == 0, (F.col("event_id") % 3).alias("n"))
    text = (
        F.when(F.col("event_type") == "error", '{"committed_pattern": null}').when(F.col("event_type") == "view", "cannot say")
        .otherwise(F.concat(F.lit('{"committed_pattern": "(u:User)-[:'), F.upper("event_type"), F.lit(']->(d:Day)"}')))
    )
    said = e.select(F.col("question_id").cast("string").alias("question_id"), F.lit("disambiguator").alias("stage"), F.lit(0).alias("attempt"), F.lit(1).alias("rank"), text.alias("text"), F.lit(0.0).alias("score"))
    tried = F.concat(F.slice(F.array(F.lit("choice 1"), F.lit("choice 2")), F.lit(1), F.col("n").cast("int")), F.array(F.lit("(u:User)-[:CLICK]->(d:Day)")))
    choices = e.select("question_id", F.explode(F.array(F.lit(2), F.lit(1))).alias("choice")).withColumn("pattern", F.concat(F.lit("choice "), F.col("choice").cast("string")))
    return compose.disambiguate(e.select("question_id", F.lit("Which?").alias("question"), tried.alias("tried")), choices, RecordedCompletions(said), EVENT_SCHEMA.to_prompt())


SHOP = GraphSchema(["User", "Day"], [PathDecl(k.upper(), "User", "Day") for k in LEGAL], {"User": ["name"], "Day": ["date"]})


@BOOK.add(
    "b_validated",
    """SELECT event_id, event_id % 7 <> 0 AS syntax, CASE WHEN event_id % 7 = 0 THEN 'query_generator' WHEN event_type = 'error' OR event_id % 5 = 0 THEN 'schema_linker' ELSE 'accept' END AS route,
    round(CASE WHEN event_id % 7 = 0 THEN 0 WHEN event_type = 'error' THEN 2.0 / 3 ELSE 1 END, 6) AS schema_score FROM events""",
)
def b_validated(spark, sf_dir):
    """A table of queries through the validator: some do not parse, error events name no declared type, some a property
    that the label lacks."""
    kind = F.upper("event_type")
    q = F.concat(F.lit("MATCH (u:User)-[r:"), kind, F.lit("]->(d:Day) WHERE u."), F.when(F.col("event_id") % 5 == 0, "colour").otherwise("name"), F.lit(" = 'x' RETURN d.date"), F.when(F.col("event_id") % 7 == 0, " RETURN").otherwise(""))
    out = gates.validated(table(spark, sf_dir, "events").select("event_id", q.alias("cypher")), SHOP)
    return out.select("event_id", "verdict.syntax", "verdict.route", F.round("verdict.schema_score", 6).alias("schema_score"))


@BOOK.add(
    "b_validity_gates",
    """SELECT 'syntax' AS gate, count(*) FILTER (event_id % 7 = 0) AS violations, count(*) FILTER (event_id % 7 = 0) = 0 AS passed FROM events
    UNION ALL SELECT 'schema', count(*) FILTER (event_id % 7 <> 0 AND event_type = 'error'), count(*) FILTER (event_id % 7 <> 0 AND event_type = 'error') = 0 FROM events
    UNION ALL SELECT 'all', count(*) FILTER (event_id % 7 = 0 OR event_type = 'error'), count(*) FILTER (event_id % 7 = 0 OR event_type = 'error') = 0 FROM events""",
)
def b_validity_gates(spark, sf_dir):
    q = F.concat(F.lit("MATCH (u:User)-[:"), F.upper("event_type"), F.lit("]->(d:Day) RETURN u.name"), F.when(F.col("event_id") % 7 == 0, " ORDER").otherwise(""))
    syntax, schema = gates.invalid(table(spark, sf_dir, "events").select(q.alias("cypher")), SHOP)
    return gates.report({"syntax": syntax, "schema": schema})


@BOOK.add(
    "q_settings",
    """WITH b AS (SELECT event_id % 3 AS setting, user_id AS item, event_type AS sig FROM events),
    per AS (SELECT setting, item, max((sig = 'purchase')::INT) AS covered, avg((sig = 'error')::INT) AS bad FROM b GROUP BY ALL),
    c AS (SELECT setting, item, sig, count(*) AS c FROM b GROUP BY ALL), n AS (SELECT setting, item, sum(c) AS n FROM c GROUP BY ALL),
    h AS (SELECT setting, item, round(CASE WHEN max(n) > 1 THEN -sum(c / n * ln(c / n)) / ln(max(n)) ELSE 0 END, 9) AS e, item % 2 = 0 AS y FROM c JOIN n USING (setting, item) GROUP BY ALL),
    r AS (SELECT *, rank() OVER (PARTITION BY setting ORDER BY e) + (count(*) OVER (PARTITION BY setting, e) - 1) / 2.0 AS rk FROM h),
    a AS (SELECT setting, sum(rk) FILTER (y) AS s, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS q FROM r GROUP BY 1)
    SELECT setting, round(cov, 6) AS cov, round(hal, 6) AS hallucination, round(CASE WHEN p = 0 OR q = 0 THEN 0.5 ELSE (s - p * (p + 1) / 2.0) / (p * q) END, 6) AS auc
    FROM (SELECT setting, avg(covered) AS cov, avg(bad) AS hal FROM per GROUP BY 1) JOIN a USING (setting)""",
)
def q_settings(spark, sf_dir):
    """Coverage, hallucination and the separation of ambiguous questions, setting by setting."""
    e = table(spark, sf_dir, "events")
    b = e.select((F.col("event_id") % 3).alias("setting"), F.col("user_id").alias("item"), F.col("event_type").alias("sig"), F.array("event_type").alias("names"))
    items = e.select(F.col("user_id").alias("item")).distinct()
    gold = items.withColumn("sig", F.lit("purchase"))
    out = stats.score_settings(b, gold, items.withColumn("is_ambiguous", F.col("item") % 2 == 0), "sig", "names", F.array(*map(F.lit, LEGAL)))
    return out.select("setting", *(F.round(c, 6).alias(c) for c in ("cov", "hallucination", "auc")))


@BOOK.add(
    "q_normal_entropy",
    f"""WITH {ALL_BEAMS}, c AS (SELECT question_id, kind, count(*) AS c FROM beams GROUP BY ALL), n AS (SELECT question_id, sum(c) AS n FROM c GROUP BY 1)
    SELECT question_id, round(CASE WHEN max(n) > 1 THEN -sum(c / n * ln(c / n)) / ln(max(n)) ELSE 0 END, 6) AS entropy, round(1 - max(c) / max(n), 6) AS dominance FROM c JOIN n USING (question_id) GROUP BY 1""",
)
def q_normal_entropy(spark, sf_dir):
    """Beams that differ in white space and variable names only count as one."""
    b = beams(spark, sf_dir, None)
    var = F.concat(F.lit("u"), F.col("rank").cast("string"))
    b = b.withColumn("beam", F.concat(F.lit("("), var, F.lit(":User) -[r:"), F.upper("kind"), F.lit("]->  (d:Day)")))
    same = ambiguity.with_normal_beams(b, "beam")
    out = ambiguity.entropy_of_beams(same, ["question_id"], "beam").join(ambiguity.dominance(same, ["question_id"], "beam"), "question_id")
    return out.select("question_id", F.round("entropy", 6).alias("entropy"), F.round("dominance", 6).alias("dominance"))


@BOOK.add(
    "q_finding",
    """WITH s AS (SELECT user_id % 2 = 0 AS y, value AS a, -value AS b, event_id % 7 AS c FROM events), l AS (SELECT y, 'a' AS signal, a AS v FROM s UNION ALL SELECT y, 'b', b FROM s UNION ALL SELECT y, 'c', c FROM s),
    r AS (SELECT *, rank() OVER (PARTITION BY signal ORDER BY v) + (count(*) OVER (PARTITION BY signal, v) - 1) / 2.0 AS rk FROM l),
    t AS (SELECT signal, (sum(rk) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / (count(*) FILTER (y) * CAST(count(*) FILTER (NOT y) AS DOUBLE)) AS auc FROM r GROUP BY 1)
    SELECT arg_max(signal, auc) AS best, round(max(auc), 6) AS best_auc, round(max(auc) - min(auc), 6) AS spread, max(auc) - min(auc) <= 0.01 AS is_flat,
        CASE WHEN max(auc) - min(auc) <= 0.01 THEN 'no signal stands out' ELSE arg_max(signal, auc) || ' separates best' END AS finding FROM t""",
)
def q_finding(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 2 == 0).alias("y"), F.col("value").alias("a"), (-F.col("value")).alias("b"), (F.col("event_id") % 7).cast("double").alias("c"))
    out = stats.finding(stats.auc_table(e, ["a", "b", "c"], F.col("y")))
    return out.select("best", F.round("best_auc", 6).alias("best_auc"), F.round("spread", 6).alias("spread"), "is_flat", "finding")


@BOOK.add(
    "q_gold_patterns",
    """SELECT c_custkey AS question_id, 0 AS position, '(c:Customer)-[:IN_NATION]->(n:Nation)' AS pattern FROM customer
    UNION ALL SELECT c_custkey, 1, '(c:Customer)' FROM customer WHERE c_custkey % 3 = 0""",
)
def q_gold_patterns(spark, sf_dir):
    """Patterns of the default query and of interpretations; queries without one are dropped."""
    q = F.concat(F.lit("MATCH (c:Customer)-[:IN_NATION]->(n:Nation {n_nationkey:"), F.col("c_nationkey").cast("string"), F.lit("}) RETURN c"))
    other = F.concat(F.lit("MATCH (c:Customer {c_mktsegment:'"), "c_mktsegment", F.lit("'}) RETURN c"))
    some = F.when(F.col("c_custkey") % 3 == 0, F.array(F.struct(F.lit("i").alias("interp"), other.alias("cypher")), F.struct(F.lit("j").alias("interp"), F.lit(None).cast("string").alias("cypher"))))
    items = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("question_id"), q.alias("cypher_default"), some.alias("interpretations"))
    return compose.gold_patterns(benchmark.labelled_queries(items))


@BOOK.add(
    "p_names",
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Brand|' ELSE '' END || 'Part_' || p_size AS labels, 'MADE_BY' || CASE WHEN p_partkey % 3 = 0 THEN '|SOLD_BY' ELSE '' END AS types FROM part""",
)
def p_names(spark, sf_dir):
    """Labels and types that a query mentions, alternatives and back quotes too."""
    q = F.concat(
        F.lit("MATCH (p:`Part_"), F.col("p_size").cast("string"), F.lit("` {p_name:'"), "p_name", F.lit("'})-[:MADE_BY"), F.when(F.col("p_partkey") % 6 == 0, "|:SOLD_BY").when(F.col("p_partkey") % 3 == 0, "|SOLD_BY").otherwise(""), F.lit("]->(b"),
        F.when(F.col("p_partkey") % 2 == 0, ":Brand").otherwise(""), F.lit(") RETURN b"),
    )
    labels, types = patterns.referenced_names(q)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(labels, "|").alias("labels"), F.array_join(types, "|").alias("types"))


@BOOK.add(
    "p_blocks",
    """SELECT c_custkey, 'Schema:' || chr(10) || 's' || chr(10) || chr(10) || 'Candidates:' || chr(10) || 'rel_1:' || chr(10) || '  - ' || c_mktsegment || ' (' || printf('%.2f', abs(c_acctbal) / 10000) || ')' || chr(10) || chr(10) ||
    'Entities:' || chr(10) || '"' || c_name || '":' || chr(10) || '  - Customer ' || c_name || ' (1.00)' || chr(10) || chr(10) || 'Question: Who is ' || c_name || '?' AS prompt FROM customer""",
)
def p_blocks(spark, sf_dir):
    """Prompts with the blocks of candidates and of entities, for every customer."""
    slots = F.array(F.struct(F.lit("rel_1").alias("slot"), F.array(F.struct(F.col("c_mktsegment").alias("text"), (F.abs(F.col("c_acctbal")) / 10000).alias("prob"))).alias("candidates")))
    spans = F.array(F.struct(F.col("c_name").alias("span"), F.array(F.struct(F.lit("Customer").alias("label"), F.col("c_name").alias("name"), F.lit(1.0).alias("posterior"))).alias("candidates")))
    text = prompts.prompt(F.concat(F.lit("Who is "), "c_name", F.lit("?")), "s", ("Candidates", prompts.candidate_block(slots)), ("Entities", prompts.entity_block(spans)))
    return table(spark, sf_dir, "customer").select("c_custkey", text.alias("prompt"))


@BOOK.add(
    "m_tables",
    ATTEMPTS + """, m AS (SELECT condition, count(*)::DOUBLE AS n_total, avg(ok::INT) AS ex, avg(fits::INT) AS ea, coalesce(avg(fits::INT) FILTER (kind IS NOT NULL), 0) AS ambiguous_ea, avg(ok1::INT) AS pass_at_1, avg(acc1::INT) AS initial_valid,
        avg(acc::INT) AS post_valid, avg(acc::INT) AS kg_valid, avg(syn::INT) AS syntax, coalesce(avg(acc::INT) FILTER (syn), 0) AS schema_given_syntax, coalesce(avg(acc::INT) FILTER (NOT acc1), 0) AS structural_repair,
        coalesce(avg(ok::INT) FILTER (wrong1), 0) AS semantic_repair FROM q GROUP BY 1),
    l AS (UNPIVOT m ON n_total, ex, ea, ambiguous_ea, pass_at_1, initial_valid, post_valid, kg_valid, syntax, schema_given_syntax, structural_repair, semantic_repair INTO NAME metric VALUE value)
    SELECT CASE WHEN list_contains(['n_total', 'ex', 'ea', 'ambiguous_ea', 'pass_at_1'], metric) THEN 'Answers' ELSE 'Validity and repair' END AS title,
        CAST(coalesce(list_position(['n_total', 'ex', 'ea', 'ambiguous_ea', 'pass_at_1'], metric), list_position(['initial_valid', 'post_valid', 'kg_valid', 'syntax', 'schema_given_syntax', 'structural_repair', 'semantic_repair'], metric)) - 1 AS INTEGER) AS line_no,
        metric, condition, round(value, 6) AS value FROM l""",
)
def m_tables(spark, sf_dir):
    """The tables of the evaluation in long form; detection is in m_detection_table."""
    out = metrics.tables(metrics.bundle(attempts(spark, sf_dir)))
    return out.withColumn("value", F.round("value", 6))


@BOOK.add(
    "m_detection_table",
    CONFUSION + """, v AS (SELECT prec, rec, coalesce(2 * prec * rec / nullif(prec + rec, 0), 0) AS f1, dsr FROM r)
    SELECT metric, 'disambiguation_enhanced' AS condition, round(value, 6) AS value FROM (UNPIVOT v ON prec, rec, f1, dsr INTO NAME metric VALUE value)""",
)
def m_detection_table(spark, sf_dir):
    both = metrics.with_undetected(metrics.bundle(attempts(spark, sf_dir)), detected(spark, sf_dir))
    out = metrics.tables(both).where("title = 'Ambiguity' and not isnan(value)")
    return out.select("metric", "condition", F.round("value", 6).alias("value"))


TRAINED = """WITH rows AS (SELECT p_partkey AS row_id, lower(p_name) AS q, p_partkey % 9 AS m FROM part),
    gated AS (SELECT * FROM rows WHERE q NOT IN (SELECT lower(p_name) FROM part WHERE p_partkey % 10 = 1)),
    firsts AS (SELECT min(row_id) AS row_id FROM gated GROUP BY q), kept AS (SELECT g.* FROM gated g JOIN firsts USING (row_id))"""


def trained(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("row_id"), F.concat(F.lit(" "), "p_name").alias("question"),
        F.concat(F.lit("(p:Part)-[:T"), (F.col("p_partkey") % 9).cast("string"), F.lit("]->(s:Supplier)")).alias("pattern"), F.lit("MATCH (p) RETURN p").alias("cypher"),
    )
    blocked = table(spark, sf_dir, "part").where("p_partkey % 10 = 1").select(F.col("p_name").alias("question"))
    return compose.training_set(rows, blocked, "s", ratio=1.01)


@BOOK.add(
    "t_build_report",
    TRAINED + """ SELECT (SELECT count(*) FROM rows) AS raw, (SELECT count(*) FROM rows) - (SELECT count(*) FROM gated) AS gate_dropped, (SELECT count(*) FROM gated) - count(*) AS duplicate_dropped, CAST(0 AS BIGINT) AS trimmed,
    count(*) AS kept, count(*) - CAST(floor(count(*) * 0.1 + 1e-9) AS BIGINT) AS train, CAST(floor(count(*) * 0.1 + 1e-9) AS BIGINT) AS eval FROM kept""",
)
def t_build_report(spark, sf_dir):
    """Counts of the training-set build: gate, deduplication, cap, split."""
    return trained(spark, sf_dir).report


@BOOK.add(
    "t_build_rows",
    TRAINED + """, p AS (SELECT *, row_number() OVER (ORDER BY md5('13|' || row_id), row_id) <= floor((SELECT count(*) FROM kept) * 0.1 + 1e-9) AS ev, (SELECT p_name FROM part WHERE p_partkey = row_id) AS name FROM kept)
    SELECT CASE WHEN ev THEN 'generator_eval' ELSE 'generator_train' END AS sink, 'Schema:' || chr(10) || 's' || chr(10) || chr(10) || 'Pattern:' || chr(10) || '(p:Part)-[:T' || m || ']->(s:Supplier)' || chr(10) || chr(10) || 'Question:  ' || name AS prompt, 'MATCH (p) RETURN p' AS completion FROM p
    UNION ALL SELECT CASE WHEN ev THEN 'linker_eval' ELSE 'linker_train' END, 'Schema:' || chr(10) || 's' || chr(10) || chr(10) || 'Question:  ' || name, '(p:Part)-[:T' || m || ']->(s:Supplier)' FROM p""",
)
def t_build_rows(spark, sf_dir):
    """The rows of the four sinks."""
    built = trained(spark, sf_dir)
    parts = [getattr(built, n).select(F.lit(n).alias("sink"), "prompt", "completion") for n in ("linker_train", "linker_eval", "generator_train", "generator_eval")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@BOOK.add("t_build_types", TRAINED + " SELECT 'T' || m AS type, count(*) AS n FROM kept GROUP BY 1")
def t_build_types(spark, sf_dir):
    """Relationship types of the kept rows."""
    return trained(spark, sf_dir).types


@BOOK.add(
    "t_reasons_syntax",
    "SELECT CASE event_type WHEN 'error' THEN 'parse' WHEN 'signup' THEN 'syntax' ELSE 'kept' END AS reason, count(*) AS n FROM events GROUP BY 1",
)
def t_reasons_syntax(spark, sf_dir):
    """Exclusion reasons with the validator: node-only queries are kept here, and queries with a pattern may still not parse."""
    kind = F.col("event_type")
    q = F.when(kind == "error", "MATCH (u:User RETURN u").when(kind == "signup", "MATCH (u:User)-[:SIGNUP]->(d) RETURN RETURN d").when(kind == "view", "MATCH (u:User) RETURN u").otherwise("MATCH (u:User)-[:CLICK]->(d) RETURN d")
    out = prep.with_reasons(table(spark, sf_dir, "events").select(q.alias("cypher")), keep_node_only=True, schema=SHOP)
    return out.groupBy("reason").agg(F.count("*").alias("n"))


ITEMS = """WITH items AS (SELECT CASE WHEN c_custkey % 11 <> 0 THEN c_custkey END AS question_id, c_name AS question, c_custkey % 2 = 0 AS flag,
    CASE WHEN c_custkey % 13 = 0 THEN 'mood' WHEN c_custkey % 2 = 0 OR c_custkey % 17 = 0 THEN ['schema', 'entity', 'intent', 'temporal'][c_custkey % 4 + 1] END AS kind, CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE c_custkey % 3 END AS many FROM customer)"""


def items(spark, sf_dir):
    """Benchmark items made of customers, some of which break the rules."""
    key = F.col("c_custkey")
    types = F.element_at(F.array(*map(F.lit, benchmark.TYPES)), (key % 4 + 1).cast("int"))
    other = F.transform(F.sequence(F.lit(1), F.lit(2)), lambda i: F.struct(F.concat(F.lit("i"), i.cast("string")).alias("interp"), F.concat(F.lit("RETURN "), i.cast("string")).alias("cypher")))
    return table(spark, sf_dir, "customer").select(
        F.when(key % 11 != 0, key.cast("string")).alias("question_id"), F.col("c_name").alias("question"), F.lit(1).alias("num_hops"), (key % 2 == 0).alias("is_ambiguous"),
        F.when(key % 13 == 0, "mood").when((key % 2 == 0) | (key % 17 == 0), types).alias("ambiguity_type"), F.lit("d").alias("default_interp"), F.lit("RETURN 0").alias("cypher_default"),
        F.slice(other, F.lit(1), F.when(key % 7 == 0, 0).otherwise(key % 3).cast("int")).alias("interpretations"),
    )


@BOOK.add(
    "s_violations",
    ITEMS + """ SELECT CAST(question_id AS VARCHAR) AS question_id, 'missing field' AS rule FROM items WHERE question_id IS NULL
    UNION ALL SELECT CAST(question_id AS VARCHAR), 'illegal type' FROM items WHERE kind = 'mood' UNION ALL SELECT CAST(question_id AS VARCHAR), 'flag and type disagree' FROM items WHERE flag <> (kind IS NOT NULL)
    UNION ALL SELECT CAST(question_id AS VARCHAR), 'ambiguous without interpretations' FROM items WHERE flag AND many = 0""",
)
def s_violations(spark, sf_dir):
    return benchmark.violations(items(spark, sf_dir))


@BOOK.add("s_by_type", ITEMS + " SELECT kind AS ambiguity_type, count(*) AS n, count(question_id) AS named FROM items GROUP BY 1")
def s_by_type(spark, sf_dir):
    out = benchmark.items_by_type(items(spark, sf_dir))
    return out.select("ambiguity_type", "n", F.size("question_ids").cast("long").alias("named"))


@BOOK.add("s_ambiguous", ITEMS + " SELECT CAST(question_id AS VARCHAR) AS question_id, question FROM items WHERE flag")
def s_ambiguous(spark, sf_dir):
    return benchmark.ambiguous_items(items(spark, sf_dir)).select("question_id", "question")


@BOOK.add("s_labelled_queries", ITEMS + " SELECT CAST(question_id AS VARCHAR) AS question_id, CAST(n AS INTEGER) AS position, 'RETURN ' || n AS cypher FROM items, range(0, 3) AS r(n) WHERE n <= many")
def s_labelled_queries(spark, sf_dir):
    return benchmark.labelled_queries(items(spark, sf_dir))


@BOOK.add("s_schema_prompt", "SELECT '(:User)-[:CLICK]->(:Day)' || chr(10) || '(:User)-[:PURCHASE]->(:Day)' || chr(10) || 'User: name' || chr(10) || 'Day: date' AS schema, count(*) AS users FROM (SELECT DISTINCT user_id FROM events)")
def s_schema_prompt(spark, sf_dir):
    """The schema's text with a cap on its paths."""
    users = table(spark, sf_dir, "events").select(F.count_distinct("user_id").alias("users"))
    return users.select(F.lit(SHOP.to_prompt(max_paths=2)).alias("schema"), "users")


@BOOK.add("p_normal_pattern", "SELECT event_id, '(:User)-[:' || upper(event_type) || ']->(:Day)' AS pattern FROM events")
def p_normal_pattern(spark, sf_dir):
    text = F.concat(F.lit("(u"), F.col("event_id").cast("string"), F.lit(":User)\n -[r_1:"), F.upper("event_type"), F.lit("] -> ( d:Day )"))
    return table(spark, sf_dir, "events").select("event_id", F.replace(patterns.normalised_pattern(text), F.lit("(d:Day)"), F.lit("(:Day)")).alias("pattern"))


@BOOK.add("p_is_id", "SELECT c_custkey, c_custkey % 3 = 0 AND c_custkey >= 100 AS is_id FROM customer")
def p_is_id(spark, sf_dir):
    key = F.col("c_custkey")
    text = F.concat(F.when(key % 3 == 0, " CUS-").when(key % 3 == 1, "C-").otherwise("cus-"), key.cast("string"), F.lit(" "))
    return table(spark, sf_dir, "customer").select("c_custkey", strings.is_id(text).alias("is_id"))


@BOOK.add("p_paraphrases", "SELECT p_partkey, p_name || '|' || upper(p_name) AS kept FROM part")
def p_paraphrases(spark, sf_dir):
    text = F.concat(F.lit("1. "), "p_name", F.lit("\n\n 2)  "), F.upper("p_name"), F.lit("\n3. a third"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(prompts.paraphrases(text, 2), "|").alias("kept"))


@BOOK.add("c_uniform", LINKING.sql["c_candidate_mapping_all"].replace("-value / 10 AS score", "0.0 AS score"))
def c_uniform(spark, sf_dir):
    """Beams of equal scores: probabilities are shares of the beams."""
    mapping, _ = candidates.candidate_mapping(completions(spark, sf_dir, None).withColumn("score", F.lit(0.0)), EVENT_SCHEMA)
    return mapping.select("question_id", "slot", "name", F.round("prob", 6).alias("prob"))


@BOOK.add("t_pick", "SELECT p_partkey, ['a', 'b', 'c'][CAST('0x' || substr(md5(CAST(p_partkey AS VARCHAR)), 1, 8) AS BIGINT) % 3 + 1] AS form FROM part")
def t_pick(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", walks.pick(["a", "b", "c"], F.col("p_partkey")).alias("form"))


@BOOK.add(
    "t_attribute_questions",
    SPELT + """, f AS (SELECT start, key, labels[-1] AS label, list_reduce(list_concat([lower(start)], list_transform(range(1, len(types) + 1), lambda i: lower(types[i]) || arrows[i])), lambda np, x: 'the ' || x || ' of ' || np) AS phrase FROM w)
    SELECT start, key, attribute, 'What is the ' || attribute || ' of ' || phrase || '?' AS question FROM f JOIN (VALUES ('Part', 'brand'), ('Part', 'size'), ('Nation', 'name')) AS a(owner, attribute) ON owner = label""",
)
def t_attribute_questions(spark, sf_dir):
    """Every walk's phrase with each attribute of the label it ends at."""
    wraps = {f"{t}{a}": f"the {t.lower()}{a} of {{np}}" for t in ("IN_REGION", "IN_NATION", "BASED_IN", "PLACED", "CONTAINS", "SUPPLIED_BY", "CO_LISTED") for a in ("->", "<-", "-")}
    w = star_walks(spark).where("active_pos is null")
    rows = w.select("start", "key", F.element_at("hops", -1)["other"].alias("label"), walks.phrases(w, "hops", wraps, F.lower("start")).alias("phrase"))
    return walks.attribute_questions(rows, {"Part": ["brand", "size"], "Nation": ["name"]}).select("start", "key", "attribute", "question")


@BOOK.add(
    "x_execute",
    """SELECT 'nations' AS name, true AS success, count(*) AS n_rows FROM nation UNION ALL SELECT 'asia', true, count(*) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'
    UNION ALL SELECT 'broken', false, 0""",
)
def x_execute(spark, sf_dir):
    """What the executor reports of queries that run and of one that does not."""
    session = star(spark, sf_dir)
    texts = {"nations": "MATCH (n:Nation) RETURN n.n_name", "asia": "MATCH (n:Nation)-[:IN_REGION]->(:Region {r_name:'ASIA'}) RETURN n.n_name", "broken": "MATCH (n:Nation RETURN n"}
    done = {k: session.execute(t, timeout_s=120) for k, t in texts.items()}
    return spark.createDataFrame([(k, e.success, len(e.rows)) for k, e in done.items()], "name string, success boolean, n_rows long")


@BOOK.add(
    "g_case",
    "SELECT n_name AS n_name, CASE WHEN r_name = 'ASIA' THEN 'east' WHEN r_name = 'EUROPE' THEN 'west' ELSE 'other' END AS side, string_split(r_name, 'I') AS parts, substr(n_name, 2) AS rest FROM nation JOIN region ON n_regionkey = r_regionkey",
)
def g_case(spark, sf_dir):
    """CASE, split and substring over a hop."""
    return star(spark, sf_dir).cypher(
        "MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.n_name AS n_name, CASE WHEN r.r_name = 'ASIA' THEN 'east' WHEN r.r_name = 'EUROPE' THEN 'west' ELSE 'other' END AS side, split(r.r_name, 'I') AS parts, substring(n.n_name, 1) AS rest"
    )


RETRIES = """WITH RECURSIVE a AS (
        SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, CASE event_type WHEN 'click' THEN 'syntax' WHEN 'error' THEN 'schema' ELSE 'accept' END AS v, event_type <> 'purchase' AND user_id % 2 = 0 AS wrong FROM events
    ), n AS (SELECT user_id, max(step) AS n FROM a GROUP BY 1), m AS (
        SELECT user_id, 0 AS step, 0 AS rounds, 0 AS again, 0 AS syn, 0 AS evaluations, '' AS first_flags, '' AS feedbacks, false AS feedback, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS VARCHAR) AS verdict, false AS done FROM n
        UNION ALL
        SELECT user_id, step + 1, CASE WHEN v = 'schema' AND rounds < 3 THEN rounds + 1 ELSE rounds END, CASE WHEN v = 'schema' THEN 0 WHEN once THEN again + 1 ELSE again END,
            CASE WHEN v = 'syntax' THEN syn + 1 ELSE 0 END, evaluations + (v = 'accept')::INT, first_flags || CASE WHEN v = 'accept' THEN CASE WHEN rounds = 0 AND again = 0 THEN '1' ELSE '0' END ELSE '' END,
            feedbacks || feedback::INT, v <> 'accept', CASE WHEN v = 'syntax' AND syn = 2 THEN 'max_syntax_retries_exhausted' WHEN v = 'schema' AND rounds = 3 THEN 'max_schema_retries_exhausted' END, v,
            CASE v WHEN 'syntax' THEN syn = 2 WHEN 'schema' THEN rounds = 3 ELSE NOT once END
        FROM (SELECT m.*, a.v, a.v = 'accept' AND a.wrong AND m.again = 0 AS once FROM m JOIN n ON n.user_id = m.user_id JOIN a ON a.user_id = m.user_id AND a.step = least(m.step + 1, n.n) WHERE NOT m.done)
    ) SELECT CAST(user_id AS VARCHAR) AS question_id, reason IS NOT NULL AS failed, reason, rounds AS retry_count, step AS generations, evaluations, first_flags, feedbacks, verdict FROM m WHERE done"""
RETRY_COLUMNS = ("question_id", "failed", "reason", "retry_count", "generations", "evaluations", "first_flags", "feedbacks", "verdict")


def attempts_of(spark, sf_dir):
    """Events as attempts: clicks fail on syntax, errors on the schema, and only a purchase is right."""
    kind = F.col("event_type")
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    verdict = F.when(kind == "click", "syntax").when(kind == "error", "schema").otherwise("accept")
    condition = F.when(F.col("user_id") % 2 == 0, "disambiguation_enhanced").otherwise("schema_linked")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("question_id"), step.alias("step"), F.col("ts").cast("timestamp").alias("ts"), condition.alias("condition"), verdict.alias("verdict"),
        F.when(verdict == "accept", F.when(kind == "purchase", "correct").otherwise("wrong_result")).alias("outcome"), F.lit(True).alias("linked"), F.lit(False).alias("ambiguous"), F.lit(None).cast("int").alias("exhausted_at"), F.lit(None).cast("array<string>").alias("choices"),
    )


@BOOK.add("x_retry", RETRIES)
def x_retry(spark, sf_dir):
    """The retry loops of every user, folded over the whole script."""
    return retry.run(attempts_of(spark, sf_dir)).select(*RETRY_COLUMNS)


@BOOK.add("x_retry_stream", RETRIES)
def x_retry_stream(spark, sf_dir):
    """The same over a stream of attempts, with a state for each user; a row of a later time ends the stream's time."""
    from ..plans.written import shared_dir
    from ..streaming.retries import final_states

    own = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    attempts = attempts_of(spark, sf_dir)
    end = attempts.agg((F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts")).select(
        *(F.col("ts") if f.name == "ts" else F.lit(0 if f.name == "step" else "end" if f.name == "question_id" else None).cast(f.dataType).alias(f.name) for f in attempts.schema.fields)
    )
    attempts.unionByName(end).write.parquet(f"{own}/attempts")
    stream = spark.readStream.schema(attempts.schema).parquet(f"{own}/attempts").withColumn("linked", F.coalesce("linked", F.lit(False)))
    query = final_states(stream).writeStream.format("parquet").option("path", f"{own}/final").option("checkpointLocation", f"{own}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{own}/final").where("question_id <> 'end'").select(*RETRY_COLUMNS)


@BOOK.add(
    "e_registry_versions",
    """SELECT 'v2' AS version, 'Customer' AS label, CAST(c_custkey AS VARCHAR) AS node_id, c_name AS display_name, c_mktsegment AS segment FROM customer
    UNION ALL SELECT 'v2', 'Supplier', CAST(s_suppkey AS VARCHAR), s_name, NULL FROM supplier UNION ALL SELECT 'v3', 'User', CAST(c_custkey AS VARCHAR), c_name, NULL FROM customer""",
)
def e_registry_versions(spark, sf_dir):
    """Entity caches of two versions of the registry, each over its own graph, in one plan."""
    day = datetime.date
    entries = [
        ("v2", "Customer", "c_custkey", ["c_address"], [], None, day(2023, 12, 31)), ("v2", "Customer", "c_custkey", ["c_name"], ["c_mktsegment"], day(2024, 1, 1), None), ("v2", "Supplier", "s_suppkey", ["s_name"], [], None, None),
        ("v2", "Part", "p_partkey", ["p_name"], [], day(2025, 1, 1), None), ("v3", "User", "user_id", ["name"], [], day(2024, 3, 1), None), ("v4", "User", "user_id", ["segment"], [], None, None),
    ]
    table_ = spark.createDataFrame(entries, registry.SCHEMA)
    caches = registry.entity_caches({"v2": star(spark, sf_dir).graph, "v3": stream(spark, sf_dir).graph}, table_, ["v2", "v3"], day(2024, 6, 1))
    return caches.select("version", "label", "node_id", "display_name", F.try_element_at("extra", F.lit("c_mktsegment")).alias("segment"))


@BOOK.add(
    "s_script_graph",
    """SELECT n_name AS nation, count(*) AS customers, max(c_acctbal) AS most, count(*) FILTER (c_custkey % 3 = 0) AS active FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name""",
)
def s_script_graph(spark, sf_dir):
    """A seed script of all customers and nations, written by Spark into several files, loaded in several tasks and queried."""
    from ..plans.session import GraphSession
    from ..plans.written import shared_dir
    from ..sources.scripts import load_scripts

    own = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    said = lambda c: F.concat(F.lit("'"), F.regexp_replace(c, r"(['\\\\])", r"\\$1"), F.lit("'"))
    c = table(spark, sf_dir, "customer").repartition(4)
    key = F.col("c_custkey").cast("string")
    people = F.concat(F.lit("CREATE (:Customer {c_id:"), key, F.lit(", name:"), said(F.concat("c_name", F.lit("; // it's")))  , F.lit(", balance:"), F.format_string("%.2f", "c_acctbal"), F.lit("});"))
    homes = F.concat(F.lit("MATCH (c:Customer {c_id:"), key, F.lit("}), (n:Nation {n_id:"), F.col("c_nationkey").cast("string"), F.lit("}) CREATE (c)-[:LIVES_IN {active:"), (F.col("c_custkey") % 3 == 0).cast("string"), F.lit("}]->(n);"))
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("CREATE (:Nation {n_id:"), F.col("n_nationkey").cast("string"), F.lit(", name:"), said(F.col("n_name")), F.lit("}); // a nation")))
    keys = spark.range(1).select(F.explode(F.array(*(F.lit(f"CREATE CONSTRAINT k{x} IF NOT EXISTS FOR (x:{x}) REQUIRE x.{k} IS UNIQUE;") for x, k in (("Customer", "c_id"), ("Nation", "n_id"))))))
    c.select(people).union(c.select(homes)).union(nations).union(keys).write.text(own)
    graph = GraphSession(spark, load_scripts(spark, own))
    return graph.cypher("MATCH (c:Customer)-[l:LIVES_IN]->(n:Nation) RETURN n.name AS nation, count(c) AS customers, max(c.balance) AS most, sum(CASE WHEN l.active THEN 1 ELSE 0 END) AS active")


def _own(spark) -> str:
    from ..plans.written import shared_dir

    return f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"


@BOOK.add("s_jsonl", "SELECT text AS prompt, source AS completion, count(*) AS n FROM documents GROUP BY ALL")
def s_jsonl(spark, sf_dir):
    """Training rows written as JSON lines and read back, whatever is in their texts; with blank lines beside them."""
    own = _own(spark)
    benchmark.write_jsonl(table(spark, sf_dir, "documents").select(F.col("text").alias("prompt"), F.col("source").alias("completion")), own)
    spark.range(3).select(F.lit("").alias("value")).write.mode("append").text(own)
    return benchmark.read_jsonl(spark, own).groupBy("prompt", "completion").agg(F.count("*").alias("n"))


@BOOK.add("s_split", "SELECT item_id, 'q' || item_id AS question, text AS schema, 'RETURN ' || item_id AS cypher FROM benchmark")
def s_split(spark, sf_dir):
    """A data set's split with more columns than are asked for."""
    own = _own(spark)
    item = F.col("item_id").cast("string")
    rows = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("q"), item).alias("question"), F.lit(1).alias("more"), F.col("text").alias("schema"), F.concat(F.lit("RETURN "), item).alias("cypher"))
    rows.write.parquet(own)
    return benchmark.read_split(spark, own).select(F.substring("question", 2, 20).cast("long").alias("item_id"), "question", "schema", "cypher")


@BOOK.add("s_results", "SELECT event_type AS model_key, user_id % 3 AS tag, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL UNION ALL SELECT 'again', 0, count(*), round(sum(value), 4) FROM events WHERE user_id % 3 = 0")
def s_results(spark, sf_dir):
    """Results of several runs in one place: a later run adds its partition and leaves the others."""
    own = _own(spark)
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("model_key"), (F.col("user_id") % 3).alias("tag"), "value")
    benchmark.write_results(e, own)
    benchmark.write_results(e.where("tag = 0").withColumn("model_key", F.lit("again")), own)
    return spark.read.parquet(own).groupBy("model_key", F.col("tag").cast("long").alias("tag")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@BOOK.add("s_beam_cache", f"WITH {ALL_BEAMS} SELECT CASE WHEN rank % 2 = 0 THEN 'linker' ELSE 'generator' END AS stage, CAST(question_id AS VARCHAR) AS question_id, kind AS text, count(*) AS n, round(sum(score), 6) AS score FROM beams GROUP BY ALL")
def s_beam_cache(spark, sf_dir):
    """Beams written once by stage, and scored again from there."""
    b = beams(spark, sf_dir, None)
    said = b.select(F.col("question_id").cast("string").alias("question_id"), F.when(F.col("rank") % 2 == 0, "linker").otherwise("generator").alias("stage"), F.lit(0).alias("attempt"), F.col("rank").cast("int").alias("rank"), F.col("kind").alias("text"), "score")
    return benchmark.cache_beams(said, _own(spark)).groupBy("stage", "question_id", "text").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("score"))


@BOOK.add("t_blocklist", "SELECT text AS question, count(*) AS n FROM benchmark WHERE item_id % 5 <> 4 GROUP BY 1")
def t_blocklist(spark, sf_dir):
    """Questions of two benchmark files, of objects that have one, where a third file is missing."""
    own = _own(spark)
    items = table(spark, sf_dir, "benchmark").withColumn("question", F.when(F.col("item_id") % 5 != 4, F.col("text")))
    for part in (0, 1):  # a benchmark file is one JSON array
        items.where(F.col("item_id") % 2 == part).agg(F.to_json(F.collect_list(F.struct("item_id", "question"))).alias("value")).coalesce(1).write.text(f"{own}/{part}")
    return compose.blocklist(spark, f"{own}/0", f"{own}/1", f"{own}/none").groupBy("question").agg(F.count("*").alias("n"))
