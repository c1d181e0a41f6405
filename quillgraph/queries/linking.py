"""Queries over candidate distributions, entities, ambiguity and pattern text (families P, C, E, A, D).

The event stream stands in for model output: a user is a question, events are beams or candidates, values are scores.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns, prompts, strings, tables
from ..operators import ambiguity, candidates, entities, stats
from ..plans.catalog import GraphSchema, PathDecl
from ..plans.tpch import spread, star_graph, table
from . import Book

BOOK = Book()
LEGAL = ("click", "purchase", "signup", "view")


def beams(spark, sf_dir, k: int | None = 5) -> DataFrame:
    """(question_id, rank, kind, score): the first k events of each user as scored beams, or all of them without k."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("rank", F.row_number().over(w))
    e = e if k is None else e.where(F.col("rank") <= k)
    return e.select(F.col("user_id").alias("question_id"), F.col("rank").cast("long").alias("rank"), F.col("event_type").alias("kind"), (-F.col("value") / 10).alias("score"))


BEAMS = """beams AS (SELECT user_id AS question_id, rank, event_type AS kind, -value / 10 AS score FROM
    (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank FROM events) WHERE rank <= 5)"""
SCORED = f"""WITH {BEAMS}, tops AS (SELECT question_id, kind, max(score) AS top, min(rank) AS first_seen FROM beams GROUP BY ALL),
    lse AS (SELECT question_id, kind, max(top) + ln(sum(exp(score - top))) AS score, min(first_seen) AS first_seen FROM beams JOIN tops USING (question_id, kind) GROUP BY question_id, kind),
    best AS (SELECT question_id, max(score) AS best FROM lse GROUP BY 1),
    ranked AS (SELECT question_id, kind, exp(score - best) / sum(exp(score - best)) OVER (PARTITION BY question_id) AS prob,
        row_number() OVER (PARTITION BY question_id ORDER BY score DESC, first_seen) AS rank FROM lse JOIN best USING (question_id))"""


def merged(spark, sf_dir, k: int | None = 5) -> DataFrame:
    b = beams(spark, sf_dir, k)
    first = b.groupBy("question_id", "kind").agg(F.min("rank").alias("first_seen"))
    return candidates.logsumexp(b, ["question_id", "kind"], "score").join(first, ["question_id", "kind"])


def ranked(spark, sf_dir, k: int | None = 5) -> DataFrame:
    out = candidates.softmax_rank(merged(spark, sf_dir, k), ["question_id"], "score", [F.asc("first_seen")])
    return out.withColumn("rank", F.col("rank").cast("long"))


@BOOK.add("c_logsumexp", SCORED + " SELECT question_id, kind, round(score, 6) AS score FROM lse")
def c_logsumexp(spark, sf_dir, k: int | None = 5):
    return merged(spark, sf_dir, k).select("question_id", "kind", F.round("score", 6).alias("score"))


@BOOK.add("c_softmax_rank", SCORED + " SELECT question_id, kind, round(prob, 6) AS prob, rank FROM ranked")
def c_softmax_rank(spark, sf_dir, k: int | None = 5):
    return ranked(spark, sf_dir, k).select("question_id", "kind", F.round("prob", 6).alias("prob"), "rank")


@BOOK.add("c_top1", SCORED + " SELECT question_id, kind, round(prob, 6) AS prob FROM ranked WHERE rank = 1")
def c_top1(spark, sf_dir, k: int | None = 5):
    return candidates.top1(ranked(spark, sf_dir, k), ["question_id"]).select("question_id", "kind", F.round("prob", 6).alias("prob"))


@BOOK.add(
    "c_substitutions",
    SCORED + """ SELECT DISTINCT question_id, CAST(0 AS BIGINT) AS choice, CAST(NULL AS VARCHAR) AS slot, CAST(NULL AS VARCHAR) AS kind FROM ranked
    UNION ALL SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY prob DESC, rank), 'rel_1', kind FROM ranked WHERE rank > 1""",
)
def c_substitutions(spark, sf_dir, k: int | None = 5):
    return candidates.substitutions(ranked(spark, sf_dir, k).withColumn("slot", F.lit("rel_1")), "question_id", "slot", "kind")


def completions(spark, sf_dir, k: int | None = 5) -> DataFrame:
    """Beams as pattern text: the event type is the relationship, every other beam is written from the far end."""
    kind, back = F.upper("kind"), F.col("rank") % 2 == 0
    text = F.when(back, F.concat(F.lit("(d:Day)<-[:"), kind, F.lit("]-(u:User)"))).otherwise(F.concat(F.lit("\n(u:User)-[:"), kind, F.lit("]->(d:Day)")))
    return beams(spark, sf_dir, k).select(F.col("question_id").cast("string").alias("question_id"), F.col("rank").cast("int").alias("rank"), text.alias("text"), "score")


EVENT_SCHEMA = GraphSchema(["User", "Day"], [PathDecl(k.upper(), "User", "Day") for k in LEGAL])


@BOOK.add(
    "c_candidate_mapping",
    f"""WITH {BEAMS}, valid AS (SELECT * FROM beams WHERE kind <> 'error'),
    spread AS (SELECT question_id, count(DISTINCT kind) AS kinds, count(DISTINCT rank % 2) AS ways FROM valid GROUP BY 1),
    tops AS (SELECT question_id, kind, max(score) AS top, min(rank) AS seen FROM valid GROUP BY ALL),
    lse AS (SELECT question_id, kind, max(top) + ln(sum(exp(score - top))) AS score FROM valid JOIN tops USING (question_id, kind) GROUP BY question_id, kind),
    nodes AS (SELECT question_id, CASE WHEN rank % 2 = 0 THEN pos[2] ELSE pos[1] END AS name, pos[1] AS spot, score FROM valid, (VALUES (['User', 'Day']), (['Day', 'User'])) AS t(pos)),
    slots AS (
        SELECT question_id, 'rel_1' AS slot, upper(kind) AS name, score FROM lse JOIN spread USING (question_id) WHERE kinds > 1
        UNION ALL SELECT question_id, CASE spot WHEN 'User' THEN 'node_1' ELSE 'node_2' END, name, ln(sum(exp(score))) FROM nodes JOIN spread USING (question_id) WHERE ways > 1 GROUP BY ALL
        UNION ALL SELECT question_id, 'rel_1', upper(kind), 0 FROM lse JOIN spread USING (question_id) WHERE kinds = 1 AND ways = 1
        UNION ALL SELECT question_id, s, CASE WHEN (s = 'node_1') = (rank % 2 = 1) THEN 'User' ELSE 'Day' END, 0 FROM (SELECT question_id, min(rank) AS rank FROM valid GROUP BY 1) JOIN spread USING (question_id), (VALUES ('node_1'), ('node_2')) AS t(s) WHERE kinds = 1 AND ways = 1
    )
    SELECT CAST(question_id AS VARCHAR) AS question_id, slot, name, round(exp(score) / sum(exp(score)) OVER (PARTITION BY question_id, slot), 6) AS prob FROM slots""",
)
def c_candidate_mapping(spark, sf_dir, k: int | None = 5):
    """Parse, validate, align, merge and normalise beams of pattern text; error events are out of the schema."""
    mapping, _ = candidates.candidate_mapping(completions(spark, sf_dir, k), EVENT_SCHEMA)
    return mapping.select("question_id", "slot", "name", F.round("prob", 6).alias("prob"))


@BOOK.add(
    "p_rows",
    """WITH s AS (SELECT event_id, upper(event_type) AS kind, user_id, value >= 50 AS on_, event_id % 2 = 0 AS back FROM events)
    SELECT event_id, 'node' AS kind, 1 AS pos, CASE WHEN back THEN 'd' ELSE 'u' END AS alias, CASE WHEN back THEN 'Day' ELSE 'User_' || user_id END AS name, NULL::VARCHAR AS src, NULL::VARCHAR AS tgt, NULL::VARCHAR AS direction, NULL::BOOLEAN AS active FROM s
    UNION ALL SELECT event_id, 'node', 2, CASE WHEN back THEN '_n0' ELSE 'd' END, CASE WHEN back THEN 'User_' || user_id ELSE 'Day' END, NULL, NULL, NULL, NULL FROM s
    UNION ALL SELECT event_id, 'relationship', 1, NULL, kind, CASE WHEN back THEN 'd' ELSE 'u' END, CASE WHEN back THEN '_n0' ELSE 'd' END, CASE WHEN back THEN '<-' ELSE '->' END, on_ FROM s""",
)
def p_rows(spark, sf_dir):
    """Nodes and relationships of a pattern for every event as rows; texts are parsed by batches, where the table function
    would be entered row by row."""
    user = F.concat(F.lit("User_"), F.col("user_id").cast("string"))
    box = F.concat(F.lit("[:"), F.upper("event_type"), F.when(F.col("value") >= 50, " {since, active:true}]").otherwise(" {since}]"))
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("(d:Day {n:1})<-"), box, F.lit("-(:"), user, F.lit(")"))).otherwise(F.concat(F.lit("(u:"), user, F.lit(")-"), box, F.lit("->(d:Day)")))
    return spread(table(spark, sf_dir, "events").select("event_id", text.alias("text"))).select("event_id", F.inline(tables.parts_of(F.col("text"))))


@BOOK.add(
    "c_prefilter_cosine",
    """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
    s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT e::DOUBLE[] FROM q)) AS sim FROM embeddings)
    SELECT vec_id, round(sim, 6) AS similarity FROM s WHERE sim >= 0.3 OR vec_id IN (SELECT vec_id FROM s ORDER BY sim DESC, vec_id LIMIT 20)""",
)
def c_prefilter_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    asked = e.orderBy("vec_id").first()["embedding"]
    out = candidates.cosine_prefilter(e, F.array(*(F.lit(float(x)) for x in asked)), "embedding", "vec_id")
    return out.select("vec_id", F.round("similarity", 6).alias("similarity"))


@BOOK.add(
    "a_entropy_candidates",
    SCORED + """, h AS (SELECT question_id, count(*) AS k, -sum(prob * log2(prob)) AS h FROM ranked WHERE prob > 0 GROUP BY 1)
    SELECT question_id, round(CASE WHEN k <= 1 THEN 0 ELSE h / log2(k) END, 6) AS entropy FROM h""",
)
def a_entropy_candidates(spark, sf_dir, k: int | None = 5):
    out = ambiguity.entropy_of_candidates(ranked(spark, sf_dir, k), ["question_id"], "prob")
    return out.select("question_id", F.round("entropy", 6).alias("entropy"))


@BOOK.add(
    "a_entropy_beams",
    f"""WITH {BEAMS}, c AS (SELECT question_id, kind, count(*) AS c FROM beams GROUP BY ALL), n AS (SELECT question_id, sum(c) AS n FROM c GROUP BY 1)
    SELECT question_id, round(CASE WHEN max(n) > 1 THEN -sum(c / n * ln(c / n)) / ln(max(n)) ELSE 0 END, 6) AS entropy FROM c JOIN n USING (question_id) GROUP BY 1""",
)
def a_entropy_beams(spark, sf_dir, k: int | None = 5):
    return ambiguity.entropy_of_beams(beams(spark, sf_dir, k), ["question_id"], "kind").select("question_id", F.round("entropy", 6).alias("entropy"))


@BOOK.add("a_dominance", f"WITH {BEAMS}, c AS (SELECT question_id, kind, count(*) AS c FROM beams GROUP BY ALL) SELECT question_id, round(1 - max(c) / sum(c), 6) AS dominance FROM c GROUP BY 1")
def a_dominance(spark, sf_dir, k: int | None = 5):
    return ambiguity.dominance(beams(spark, sf_dir, k), ["question_id"], "kind").select("question_id", F.round("dominance", 6).alias("dominance"))


@BOOK.add(
    "a_scores",
    SCORED + """, h AS (SELECT question_id, count(*) AS k, -sum(prob * log2(prob)) AS h FROM ranked WHERE prob > 0 GROUP BY 1), x AS (SELECT question_id, CASE WHEN k <= 1 THEN 0 ELSE h / log2(k) END AS s FROM h)
    , p AS (SELECT user_id, event_id % 3 AS span, value / sum(value) OVER (PARTITION BY user_id, event_id % 3) AS p FROM events),
    e AS (SELECT user_id, span, CASE WHEN count(*) <= 1 THEN 0 ELSE coalesce(-sum(CASE WHEN p > 0 THEN p * log2(p) END), 0) / log2(count(*)) END AS e FROM p GROUP BY ALL), m AS (SELECT user_id, max(e) AS e FROM e GROUP BY 1)
    SELECT c_custkey AS question_id, round(coalesce(s, 0), 6) AS schema_entropy, round(coalesce(e, 0), 6) AS entity_entropy FROM customer LEFT JOIN x ON c_custkey = question_id LEFT JOIN m ON c_custkey = user_id""",
)
def a_scores(spark, sf_dir, k: int | None = 5):
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("question_id"))
    slots = ranked(spark, sf_dir, k).withColumn("slot", F.lit("rel_1"))
    # the values of a user's events stand for the posteriors of candidates, every third event for a span
    spans = table(spark, sf_dir, "events").select(F.col("user_id").alias("question_id"), (F.col("event_id") % 3).alias("span"), F.col("value").alias("posterior"))
    out = ambiguity.ambiguity_scores(asked, slots, spans)
    return out.select("question_id", F.round("schema_entropy", 6).alias("schema_entropy"), F.round("entity_entropy", 6).alias("entity_entropy"))


@BOOK.add(
    "a_fallback",
    """SELECT event_id, value / 100 >= 0.6 OR (event_id % 10) / 10 >= 0.8 AS is_ambiguous,
    concat_ws(',', CASE WHEN value / 100 >= 0.6 THEN 'schema' END, CASE WHEN (event_id % 10) / 10 >= 0.8 THEN 'entity' END) AS detected FROM events""",
)
def a_fallback(spark, sf_dir):
    flag, types = ambiguity.fallback(F.col("value") / 100, (F.col("event_id") % 10) / 10)
    return table(spark, sf_dir, "events").select("event_id", flag.alias("is_ambiguous"), F.array_join(types, ",").alias("detected"))


@BOOK.add(
    "p_json_verdict",
    """WITH v AS (SELECT event_id, value / 100 AS s, event_type = 'error' AS broken, event_type IN ('purchase', 'signup') AS flag, event_type FROM events)
    SELECT event_id, NOT broken AS parsed, CASE WHEN broken THEN s >= 0.6 ELSE flag END AS is_ambiguous,
    CASE WHEN broken THEN CASE WHEN s >= 0.6 THEN 'schema' ELSE '' END WHEN flag THEN 'intent' ELSE '' END AS detected FROM v""",
)
def p_json_verdict(spark, sf_dir):
    """Verdicts inside prose and code fences; error events are malformed and fall back to the thresholds."""
    body = F.format_string('Answer:\n```json\n{"is_ambiguous": %s, "detected_types": ["intent", "%s"], "rationale": "a {brace} in text"}\n```', F.col("event_type").isin("purchase", "signup").cast("string"), F.col("event_type"))
    df = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "error", F.concat(body, F.lit("")).substr(1, 30)).otherwise(body).alias("text"), (F.col("value") / 100).alias("schema_entropy"), F.lit(0.0).alias("entity_entropy"))
    return ambiguity.verdicts(df).select("event_id", "parsed", "is_ambiguous", F.array_join("detected_types", ",").alias("detected"))


@BOOK.add(
    "p_commitments",
    """SELECT event_id, CASE event_type WHEN 'error' THEN 'exhausted' WHEN 'view' THEN 'next' WHEN 'click' THEN 'next' ELSE 'accept' END AS decision,
    CASE WHEN event_type IN ('purchase', 'signup') THEN '(u:User)-[:' || upper(event_type) || ']->(d:Day)' END AS committed FROM events""",
)
def p_commitments(spark, sf_dir):
    """Commitments of a disambiguator: null, unparseable, repeated and new ones."""
    pattern = F.concat(F.lit("(u:User)-[:"), F.upper("event_type"), F.lit("]->(d:Day)"))
    text = (
        F.when(F.col("event_type") == "error", '{"committed_pattern": null}')
        .when(F.col("event_type") == "view", "no answer")
        .otherwise(F.concat(F.lit('{"committed_pattern": "'), pattern, F.lit('"}')))
    )
    df = table(spark, sf_dir, "events").select("event_id", text.alias("text"), F.array(F.lit("(u:User)-[:CLICK]->(d:Day)")).alias("tried"))
    return ambiguity.commitments(df).select("event_id", "decision", "committed")


@BOOK.add("p_first_line", "SELECT conv_id, turn, coalesce(trim(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1]), '') AS line FROM conversations")
def p_first_line(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", patterns.first_line("text").alias("line"))


@BOOK.add("p_normalise", r"SELECT doc_id, md5(regexp_replace(lower(regexp_replace(text, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g')), '[ \t\n\r\f\v]+', ' ', 'g')) AS digest FROM documents")
def p_normalise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(strings.normalised_question("text")).alias("digest"))


#: Digits as letters, for names of relationship types.
LETTERS = "translate(user_id::VARCHAR, '0123456789', 'ABCDEFGHIJ')"


@BOOK.add(
    "p_rel_types",
    f"""SELECT event_id, array_to_string(list_sort(list_distinct(list_concat([upper(event_type), 'BY_' || {LETTERS}], CASE event_type WHEN 'click' THEN ['VIEW'] ELSE [] END))), '|') AS types,
    2 + event_id % 2 AS hops, true AS typed FROM events""",
)
def p_rel_types(spark, sf_dir):
    by = F.concat(F.lit("BY_"), F.translate(F.col("user_id").cast("string"), "0123456789", "ABCDEFGHIJ"))
    q = F.concat(
        F.lit("MATCH (u:User)-[r:"), F.when(F.col("event_type") == "click", "VIEW|CLICK").otherwise(F.upper("event_type")), F.lit(" {active:true}]->(d), (d)-[:"), by, F.lit("]-(x)"),
        F.when(F.col("event_id") % 2 == 1, F.concat(F.lit("<-[:"), F.upper("event_type"), F.lit("]-(y)"))).otherwise(""), F.lit(" RETURN u"),
    )
    df = spread(table(spark, sf_dir, "events").select("event_id", q.alias("q"))).withColumn("p", patterns.extract_schema_pattern("q"))
    return df.select("event_id", F.array_join(patterns.relationship_types("q"), "|").alias("types"), patterns.relationship_count("p").alias("hops"), patterns.has_relationship_type("p").alias("typed"))


@BOOK.add(
    "p_schema_pattern",
    "SELECT event_id, '(u:User_' || user_id || ')-[r:' || upper(event_type) || ' {e' || event_id || ', active:true}]->(d:Day' || CASE WHEN event_id % 2 = 0 THEN ' {open:false}' ELSE '' END || ')' AS pattern FROM events",
)
def p_schema_pattern(spark, sf_dir):
    day = F.when(F.col("event_id") % 2 == 0, ", open:False").otherwise("")
    q = F.concat(
        F.lit("MATCH (u:User_"), F.col("user_id").cast("string"), F.lit(" {name:'a) {b'})-[r:"), F.upper("event_type"), F.lit(" {e"), F.col("event_id").cast("string"), F.lit(":date('2024-01-01'), active:TRUE}]->(d:Day {month:"),
        F.month("ts").cast("string"), day, F.lit("}) WHERE r.value > 3 RETURN u.name ORDER BY u.name"),
    )
    return spread(table(spark, sf_dir, "events").select("event_id", q.alias("q"))).select("event_id", patterns.extract_schema_pattern("q").alias("pattern"))


@BOOK.add("p_clean_fence", "SELECT event_id, 'MATCH (u:User {user_id:' || user_id || '})' || chr(10) || 'RETURN u.' || event_type || '_' || event_id AS cypher FROM events")
def p_clean_fence(spark, sf_dir):
    text = F.concat(F.lit("Sure!\n```cypher\nMATCH (u:User {user_id:"), F.col("user_id").cast("string"), F.lit("})\\nRETURN u."), F.col("event_type"), F.lit("_"), F.col("event_id").cast("string"), F.lit("\n```\nThis finds users."))
    return table(spark, sf_dir, "events").select("event_id", patterns.clean_cypher(text).alias("cypher"))


@BOOK.add(
    "p_render",
    SCORED + " SELECT question_id, '(u:User)-[:' || upper(kind) || ']->(d:Day), (x:Xtra)' AS pattern FROM ranked WHERE rank = 1",
)
def p_render(spark, sf_dir, k: int | None = 5):
    def element(kind, name, source=None, target=None):
        return F.struct(F.lit(kind).alias("element_type"), name.alias("name"), F.lit(source).cast("string").alias("source_label"), F.lit(target).cast("string").alias("target_label"), F.lit(False).alias("active"))

    parts = F.array(element("relationship_type", F.upper("kind"), "User", "Day"), element("node_label", F.lit("User")), element("node_label", F.lit("Xtra")))
    best = candidates.top1(ranked(spark, sf_dir, k), ["question_id"])
    return best.select("question_id", candidates.render(parts).alias("pattern"))


@BOOK.add("p_prompt", "SELECT r_regionkey AS id, 'Schema:' || chr(10) || 's' || chr(10) || chr(10) || 'Tried:' || chr(10) || '- ' || r_name || chr(10) || chr(10) || 'Failed query: q' || chr(10) || 'Problems: a; ' || r_name || chr(10) || chr(10) || 'Question: ' || r_name AS prompt FROM region")
def p_prompt(spark, sf_dir):
    name = F.col("r_name")
    text = prompts.prompt(name, "s", ("Tried", prompts.tried_block(F.array(name))), feedback=prompts.error_feedback(F.lit("q"), F.array(F.lit("a"), name)))
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), text.alias("prompt"))


@BOOK.add(
    "e_posterior_topn",
    """WITH m AS (SELECT c_nationkey, c_custkey, c_acctbal / 10000 AS s FROM customer WHERE c_acctbal / 10000 >= 0.75),
    t AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY s DESC, c_custkey) AS rank FROM m)
    SELECT c_nationkey AS span, c_custkey AS node_id, rank, round(s / sum(s) OVER (PARTITION BY c_nationkey), 6) AS posterior FROM t WHERE rank <= 10""",
)
def e_posterior_topn(spark, sf_dir):
    m = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("span"), F.col("c_custkey").alias("node_id"), (F.col("c_acctbal") / 10000).alias("s"))
    out = entities.posterior(m, ["span"], "s", [F.asc("node_id")])
    return out.select("span", "node_id", F.col("rank").cast("long").alias("rank"), F.round("posterior", 6).alias("posterior"))


@BOOK.add(
    "e_token_set",
    r"""WITH names AS (SELECT DISTINCT p_name AS n, list_sort(list_distinct(string_split(p_name, ' '))) AS t FROM part),
    pairs AS (SELECT a.n AS a, b.n AS b, list_sort(list_intersect(a.t, b.t)) AS w, list_sort(list_filter(a.t, lambda x: NOT list_contains(b.t, x))) AS oa, list_sort(list_filter(b.t, lambda x: NOT list_contains(a.t, x))) AS ob
        FROM names a JOIN names b ON a.n < b.n AND list_has_any(a.t, b.t)),
    s AS (SELECT a, b, len(oa) = 0 OR len(ob) = 0 AS subset, length(array_to_string(w, ' ')) AS c, array_to_string(oa, ' ') AS ra, array_to_string(ob, ' ') AS rb FROM pairs),
    m AS (SELECT *, list_reduce(list_concat([list_transform(range(0, length(rb) + 1), lambda i: 0)], list_transform(string_split(ra, ''), lambda ch: [CAST(ascii(ch) AS BIGINT)])),
            lambda prev, ch: list_reduce(list_concat([[CAST(0 AS BIGINT)]], list_transform(range(1, length(rb) + 1), lambda j: [j])),
                lambda acc, j: list_append(acc, greatest(acc[-1], prev[j[1] + 1], prev[j[1]] + CASE WHEN ascii(rb[j[1]]) = ch[1] THEN 1 ELSE 0 END))))[-1] AS lcs FROM s)
    SELECT a, b, round(CASE WHEN subset THEN 1 ELSE greatest(2 * c / (2 * c + 1 + length(ra)), 2 * c / (2 * c + 1 + length(rb)), 2 * (c + 1 + lcs) / (2 * (c + 1) + length(ra) + length(rb))) END, 6) AS score FROM m""",
)
def e_token_set(spark, sf_dir):
    """Token-set similarity of all pairs of part names that share a word."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    a = names.select(F.col("p_name").alias("a"), F.explode(strings.tokens("p_name")).alias("t"))
    b = names.select(F.col("p_name").alias("b"), F.explode(strings.tokens("p_name")).alias("t"))
    pairs = a.join(b, "t").where("a < b").select("a", "b").distinct()
    return pairs.select("a", "b", F.round(strings.token_set(F.col("a"), F.col("b")), 6).alias("score"))


@BOOK.add("e_entity_cache", "SELECT 'Customer' AS label, CAST(c_custkey AS VARCHAR) AS node_id, c_name AS display_name, c_mktsegment AS segment FROM customer UNION ALL SELECT 'Supplier', CAST(s_suppkey AS VARCHAR), s_name, NULL FROM supplier")
def e_entity_cache(spark, sf_dir):
    registry = {"Customer": ("c_custkey", ["c_name"], ["c_mktsegment"]), "Supplier": ("s_suppkey", ["s_name"], []), "Absent": ("x", ["x"], [])}
    cache = entities.entity_cache(star_graph(spark, sf_dir), registry)
    return cache.select("label", "node_id", "display_name", F.try_element_at("extra", F.lit("c_mktsegment")).alias("segment"))


@BOOK.add(
    "e_resolve",
    r"""WITH names AS (SELECT DISTINCT p_name AS n, list_sort(list_distinct(string_split(p_name, ' '))) AS t FROM part),
    pairs AS (SELECT a.n AS a, b.n AS b, list_sort(list_intersect(a.t, b.t)) AS w, list_sort(list_filter(a.t, lambda x: NOT list_contains(b.t, x))) AS oa, list_sort(list_filter(b.t, lambda x: NOT list_contains(a.t, x))) AS ob FROM names a, names b),
    s AS (SELECT a, b, len(w) > 0 AND (len(oa) = 0 OR len(ob) = 0) AS subset, length(array_to_string(w, ' ')) AS c, CASE WHEN len(w) > 0 THEN length(array_to_string(w, ' ')) + 1 ELSE 0 END AS head, array_to_string(oa, ' ') AS ra, array_to_string(ob, ' ') AS rb FROM pairs),
    m AS (SELECT *, list_reduce(list_concat([list_transform(range(0, length(rb) + 1), lambda i: 0)], list_transform(string_split(ra, ''), lambda ch: [CAST(ascii(ch) AS BIGINT)])),
            lambda prev, ch: list_reduce(list_concat([[CAST(0 AS BIGINT)]], list_transform(range(1, length(rb) + 1), lambda j: [j])),
                lambda acc, j: list_append(acc, greatest(acc[-1], prev[j[1] + 1], prev[j[1]] + CASE WHEN ascii(rb[j[1]]) = ch[1] THEN 1 ELSE 0 END))))[-1] AS lcs FROM s),
    scored AS (SELECT a, b, CASE WHEN subset THEN 1 ELSE greatest(CASE WHEN c > 0 THEN 2 * c / (2 * c + 1 + length(ra)) ELSE 0 END, CASE WHEN c > 0 THEN 2 * c / (2 * c + 1 + length(rb)) ELSE 0 END, 2 * (head + lcs) / (2 * head + length(ra) + length(rb))) END AS score FROM m),
    found AS (SELECT a AS span, 'Part' AS label, CAST(p_partkey AS VARCHAR) AS node_id, score FROM scored JOIN part ON p_name = b WHERE score >= 0.75),
    top AS (SELECT *, row_number() OVER (PARTITION BY span ORDER BY round(score, 9) DESC, node_id) AS rank FROM found)
    SELECT span, label, node_id, round(score, 6) AS match_score, round(score / sum(score) OVER (PARTITION BY span), 6) AS posterior, rank FROM top WHERE rank <= 10""",
)
def e_resolve(spark, sf_dir):
    """Part names as mentions, resolved among the supplier and part names of the graph."""
    registry = {"Part": ("p_partkey", ["p_name"], []), "Supplier": ("s_suppkey", ["s_name"], [])}
    cache = entities.entity_cache(star_graph(spark, sf_dir), registry)
    spans = table(spark, sf_dir, "part").select(F.col("p_name").alias("question_id"), F.col("p_name").alias("span")).distinct()
    labels = spans.select("question_id", F.lit("Part").alias("label"))
    out = entities.resolve(spans, cache, labels)
    return out.select("span", "label", "node_id", F.round("match_score", 6).alias("match_score"), F.round("posterior", 6).alias("posterior"), F.col("rank").cast("long").alias("rank"))


PADDED = r"' ' || regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g') || ' '"


@BOOK.add(
    "e_spans",
    r"""WITH tok AS (SELECT conv_id, turn, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS k FROM conversations),
    f AS (SELECT conv_id, turn, s, i, regexp_full_match(s, '[A-Z][a-z]+') AS nm, regexp_full_match(s, '\s+') AS ws FROM (SELECT conv_id, turn, unnest(k) AS s, generate_subscripts(k, 1) AS i FROM tok)),
    g AS (SELECT *, nm OR ws AND coalesce(lag(nm) OVER o, false) AND coalesce(lead(nm) OVER o, false) AS inside, first_value(ws) OVER o AS lead_ws FROM f WINDOW o AS (PARTITION BY conv_id, turn ORDER BY i)),
    h AS (SELECT *, sum((NOT inside)::INT) OVER (PARTITION BY conv_id, turn ORDER BY i) AS island FROM g),
    quotes AS (SELECT conv_id, turn, unnest(q) AS s, generate_subscripts(q, 1) AS i FROM (SELECT conv_id, turn, regexp_extract_all(text, '"[^"]+"|''[^'']+''') AS q FROM conversations)),
    found AS (
        SELECT conv_id, turn, 1 AS rule, min(i) AS at_, string_agg(s, '' ORDER BY i) AS s FROM h WHERE inside GROUP BY conv_id, turn, island HAVING count(*) FILTER (nm) > 1
        UNION ALL SELECT conv_id, turn, 2, i, s FROM g WHERE nm AND NOT (i = 1 OR i = 2 AND lead_ws)
        UNION ALL SELECT conv_id, turn, 3, i, trim(substr(s, 2, length(s) - 2)) FROM quotes
    ),
    one AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, lower(s) ORDER BY rule, at_) AS again FROM found WHERE s <> ''),
    listed AS (SELECT conv_id, turn, list(s ORDER BY length(s) DESC, rule, at_) AS l FROM one WHERE again = 1 GROUP BY ALL)
    SELECT conv_id, turn, coalesce(array_to_string(list_reduce(list_concat([[]::VARCHAR[]], list_transform(l, lambda x: [x])), lambda acc, x:
        CASE WHEN len(list_filter(acc, lambda k: lower(k) <> lower(x[1]) AND contains("""
    + PADDED.format("k") + ", " + PADDED.format("x[1]") + r"""))) > 0 THEN acc ELSE list_append(acc, x[1]) END), '|'), '') AS spans FROM conversations LEFT JOIN listed USING (conv_id, turn)""",
)
def e_spans(spark, sf_dir):
    """Mentions in every conversation turn."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(entities.extract_spans("text"), "|").alias("spans"))


@BOOK.add(
    "q_coverage",
    f"WITH {BEAMS} SELECT question_id, bool_or(kind = 'purchase') AS covered, bool_or(kind = 'purchase' AND rank = 1) AS em_at_1 FROM beams GROUP BY 1",
)
def q_coverage(spark, sf_dir, k: int | None = 5):
    b = beams(spark, sf_dir, k)
    gold = b.select("question_id").distinct().withColumn("kind", F.lit("purchase"))
    return stats.coverage(b, gold, "question_id", "kind", "rank")


@BOOK.add("q_hallucination", f"WITH {BEAMS} SELECT question_id, round(avg(CASE WHEN kind = 'error' THEN 1.0 ELSE 0.0 END), 6) AS share FROM beams GROUP BY 1")
def q_hallucination(spark, sf_dir, k: int | None = 5):
    legal = F.array(*map(F.lit, LEGAL))
    out = stats.hallucination(beams(spark, sf_dir, k).withColumn("names", F.array("kind")), "question_id", "names", legal)
    return out.select("question_id", F.round("share", 6).alias("share"))


@BOOK.add("q_signatures", f"WITH {BEAMS} SELECT question_id, rank, 'User>' || upper(kind) || '>Day/' AS signature FROM beams")
def q_signatures(spark, sf_dir, k: int | None = 5):
    """The canonical form of beams written from either end is the same."""
    parsed = candidates.parse_beams(completions(spark, sf_dir, k), EVENT_SCHEMA, check=False)
    return parsed.select(F.col("question_id").cast("long").alias("question_id"), F.col("rank").cast("long").alias("rank"), patterns.signature(F.col("parsed")).alias("signature"))


#: The same queries over every event of a user, each with a twin of its own: the SQL of the ones above stops at rank 5.
ALL_BEAMS = BEAMS.replace(" WHERE rank <= 5", "")
for _query in (
    c_logsumexp, c_softmax_rank, c_top1, c_substitutions, c_candidate_mapping, a_entropy_candidates, a_entropy_beams, a_dominance, a_scores, p_render, q_coverage, q_hallucination,
    q_signatures,
):
    BOOK.add(f"{_query.__name__}_all", BOOK.sql[_query.__name__].replace(BEAMS, ALL_BEAMS))(partial(_query, k=None))
