"""The corpus operators as queries over the test tables: thin wrappers that fix parameters and derive digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bayes_dedup import near_duplicates
from .ivfpq import nearest
from .langid import identify
from .lexical import rank_documents
from .mixing import mix
from .packing import pack
from .pages import extract
from .pivot_dedup import near_vectors
from .runs import find_runs, planted
from .secrets import find_secrets
from .sharding import shards
from .toolcalls import link
from .weak_quality import score_quality


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_pivot_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of embeddings with its links at cosine 0.95 or more; vectors without a direction link with nothing."""
    return near_vectors(_read(spark, sf_dir, "embeddings"))


def op2_ivfpq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 rows of largest inner product for every vector whose id is divisible by 20, among all other vectors."""
    return nearest(_read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def tool_chats(chats: DataFrame) -> DataFrame:
    """Conversations with tools, made of the rows of a table that has none: every row stays, at four times its turn, and
    each assistant turn is followed by a call that measures it and, in two of three conversations, by its result.

    Calls of every fifth conversation need the call two turns later, others the one two turns before, and some both,
    which is a cycle. Some calls have an argument of a wrong type, lack one or name no tool, and some results no call.
    """
    conv, turn, start = F.col("conv_id"), F.col("turn"), F.substring(F.regexp_replace("text", "[^A-Za-z]", ""), 1, 8)
    said = chats.where("role = 'assistant'")
    size = F.char_length("text")
    arguments = F.struct(
        F.when(conv % 4 == 1, F.to_variant_object(F.struct(size.cast("string").alias("is")))).otherwise(F.to_variant_object(F.struct(size.alias("is")))).alias("chars"),
        F.when(conv % 4 != 2, start).alias("start"),
    )
    arguments = F.regexp_replace(F.to_json(arguments), r'\{"is":("?[0-9]+"?)\}', "$1")
    needs = F.array_compact(F.array(
        F.when((conv % 5 == 0) | (conv % 7 == 3), F.concat(F.lit("c"), (turn + 2).cast("string"))), F.when((conv % 5 != 0) & (turn >= 2), F.concat(F.lit("c"), (turn - 2).cast("string")))
    ))
    call = F.concat(
        F.lit('{"tool_calls":[{"id":"c'), turn.cast("string"), F.lit('","name":"'), F.when(conv % 6 == 5, "weigh").otherwise("measure"), F.lit('","arguments":'), arguments,
        F.lit(',"depends_on":'), F.to_json(needs), F.lit("}]}"),
    )
    result = F.concat(F.lit('{"tool_call_id":"'), F.when(conv % 9 == 4, "x").otherwise("c"), turn.cast("string"), F.lit('","content":{"ok":true,"n":'), size.cast("string"), F.lit("}}"))
    parts = [
        chats.select(conv, (turn * 4).alias("turn"), "role", "text"),
        said.select(conv, (turn * 4 + 1).alias("turn"), F.lit("assistant").alias("role"), call.alias("text")),
        said.where(conv % 3 != 2).select(conv, (turn * 4 + 2).alias("turn"), F.lit("tool").alias("role"), result.alias("text")),
    ]
    return parts[0].union(parts[1]).union(parts[2])


def op3_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages, calls and results of tool_chats(), linked, ordered and checked against the tools declared here."""
    tools = spark.sql("SELECT * FROM VALUES ('measure', 'chars', 'integer', true), ('measure', 'start', 'string', true), ('measure', 'note', 'boolean', false) AS t(name, parameter, type, required)")
    return link(tool_chats(_read(spark, sf_dir, "conversations")), tools)


def op4_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each copy of a document, with its rate, its number of copies and the key by which rows are shuffled."""
    mixed = mix(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", F.col("_rate").alias("rate"), F.col("_copies").cast("long").alias("copies"), F.col("_copy").cast("long").alias("copy"), F.col("_order").alias("shuffle_key"))


def op5_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    return shards(_read(spark, sf_dir, "documents"))


def op6_url_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(_read(spark, sf_dir, "pages"))


def op7_word_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the labelled ones of two of three folds of ids; a null id is in none held out."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs, lambda d: d.where(fold != 1))
    return out.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document: its votes, weak label, score and whether it is kept."""
    return score_quality(_read(spark, sf_dir, "documents"))


def op9_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    import public_tokenizers

    return pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_bayes_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of three-word shingles are similar by 85 of 100 or more."""
    return near_duplicates(_read(spark, sf_dir, "documents"), words_per_shingle=3, percent=85)


def op11_structural_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document: assignments, access keys, long hex, and encoded keys and tokens whose structure holds."""
    return find_secrets(_read(spark, sf_dir, "documents"))


def op12_csr_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents of highest score for every benchmark item."""
    return rank_documents(_read(spark, sf_dir, "benchmark"), _read(spark, sf_dir, "documents"))


def op13_partition_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of repeated words in every document, one in ten of which is first made to repeat its end."""
    return find_runs(_read(spark, sf_dir, "documents"), recur=planted)


QUERIES = {
    "op1_pivot_dedup": op1_pivot_dedup,
    "op2_ivfpq": op2_ivfpq,
    "op3_toolcalls": op3_toolcalls,
    "op4_poisson_mix": op4_poisson_mix,
    "op5_sampled_splitters": op5_sampled_splitters,
    "op6_url_differencing": op6_url_differencing,
    "op7_word_backoff": op7_word_backoff,
    "op8_weak_labels": op8_weak_labels,
    "op9_harmonic_packing": op9_harmonic_packing,
    "op10_bayes_minhash": op10_bayes_minhash,
    "op11_structural_secrets": op11_structural_secrets,
    "op12_csr_impacts": op12_csr_impacts,
    "op13_partition_runs": op13_partition_runs,
}

SQL = {
    "op1_pivot_dedup": """
        WITH RECURSIVE usable AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id
            WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.95
        ), reach AS (
            SELECT vec_id AS n, vec_id AS r FROM usable
            UNION
            SELECT reach.n, links.b FROM reach JOIN links ON links.a = reach.r
        ), roots AS (SELECT n, min(r) AS root FROM reach GROUP BY n),
        degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, root AS component_id, e.vec_id = root AS kept
        FROM embeddings e JOIN roots ON roots.n = e.vec_id LEFT JOIN degrees d ON d.a = e.vec_id
    """,
    "op3_toolcalls": """
        WITH RECURSIVE said AS (
            SELECT conv_id AS conv, turn, length(text) AS size, substr(regexp_replace(text, '[^A-Za-z]', '', 'g'), 1, 8) AS start FROM conversations WHERE role = 'assistant'
        ), called AS (
            SELECT conv, turn * 4 + 1 AS turn, json_object('tool_calls', json_array(json_object(
                'id', 'c' || turn, 'name', CASE WHEN conv % 6 = 5 THEN 'weigh' ELSE 'measure' END,
                'arguments', CASE WHEN conv % 4 = 1 THEN json_object('chars', CAST(size AS VARCHAR), 'start', start) WHEN conv % 4 = 2 THEN json_object('chars', size) ELSE json_object('chars', size, 'start', start) END,
                'depends_on', to_json(list_filter([CASE WHEN conv % 5 = 0 OR conv % 7 = 3 THEN 'c' || (turn + 2) END, CASE WHEN conv % 5 <> 0 AND turn >= 2 THEN 'c' || (turn - 2) END], lambda x: x IS NOT NULL))
            ))) AS j FROM said
        ), returned AS (
            SELECT conv, turn * 4 + 2 AS turn, json_object('tool_call_id', CASE WHEN conv % 9 = 4 THEN 'x' ELSE 'c' END || turn, 'content', json_object('ok', true, 'n', size)) AS j FROM said WHERE conv % 3 <> 2
        ), tools(name, parameter, kind, required) AS (
            VALUES ('measure', 'chars', 'UBIGINT', true), ('measure', 'start', 'VARCHAR', true), ('measure', 'note', 'BOOLEAN', false)
        ), calls AS (
            SELECT conv, turn, j ->> '$.tool_calls[0].id' AS id, j ->> '$.tool_calls[0].name' AS name, json_extract(j, '$.tool_calls[0].arguments') AS arguments,
                CAST(json_extract(j, '$.tool_calls[0].depends_on') AS VARCHAR[]) AS needs FROM called
        ), results AS (SELECT conv, turn, j ->> '$.tool_call_id' AS id, json_extract(j, '$.content') AS content FROM returned),
        edges AS (
            SELECT e.conv, e.id, e.need FROM (SELECT conv, id, unnest(needs) AS need FROM calls) e JOIN calls c ON c.conv = e.conv AND c.id = e.need
        ), amounts AS (SELECT conv, count(*) AS n FROM calls GROUP BY conv),
        reach AS (
            SELECT conv, id, turn AS at_turn, 0 AS level FROM calls
            UNION
            SELECT e.conv, e.id, r.at_turn, r.level + 1 FROM reach r JOIN edges e ON e.conv = r.conv AND e.need = r.id JOIN amounts a ON a.conv = r.conv WHERE r.level < a.n
        ), places AS (
            SELECT r.conv, r.id, max(struct_pack(at_turn := r.at_turn, level := r.level)) AS place, max(r.level) >= any_value(a.n) AS loose
            FROM reach r JOIN amounts a ON a.conv = r.conv GROUP BY r.conv, r.id
        ), wrong AS (
            SELECT c.conv, c.id, arg_min(CASE WHEN json_extract(c.arguments, '$.' || t.parameter) IS NULL THEN 'missing ' ELSE 'type of ' END || t.parameter, t.parameter) AS problem
            FROM calls c JOIN tools t ON t.name = c.name
            WHERE CASE WHEN json_extract(c.arguments, '$.' || t.parameter) IS NULL THEN t.required ELSE json_type(c.arguments, '$.' || t.parameter) <> t.kind END GROUP BY c.conv, c.id
        ), sound AS (
            SELECT c.*, r.id IS NOT NULL AS linked, CASE WHEN p.loose THEN 'cycle' WHEN c.name NOT IN (SELECT name FROM tools) THEN 'unknown tool' ELSE w.problem END AS problem,
                CASE WHEN p.loose THEN c.turn ELSE p.place.at_turn END AS at_turn, CASE WHEN p.loose THEN 1 ELSE p.place.level + 1 END AS level
            FROM calls c JOIN places p ON p.conv = c.conv AND p.id = c.id LEFT JOIN results r ON r.conv = c.conv AND r.id = c.id LEFT JOIN wrong w ON w.conv = c.conv AND w.id = c.id
        )
        SELECT conv_id, turn * 4 AS turn, CAST(0 AS INTEGER) AS item, 'message' AS kind, CAST(NULL AS VARCHAR) AS call_id, CAST(NULL AS BOOLEAN) AS linked, CAST(NULL AS VARCHAR) AS problem, turn * 4 AS at_turn,
            CAST(0 AS INTEGER) AS level, CAST(json_object('content', text, 'role', role) AS VARCHAR) AS json FROM conversations
        UNION ALL
        SELECT conv, turn, 1, 'call', id, linked, problem, at_turn, level, CAST(json_object('arguments', arguments, 'id', id, 'name', name, 'role', 'assistant', 'type', 'call') AS VARCHAR) FROM sound
        UNION ALL
        SELECT r.conv, r.turn, 0, 'result', r.id, s.id IS NOT NULL, CASE WHEN s.id IS NULL THEN 'no call' END, coalesce(s.at_turn, r.turn), coalesce(s.level, 1),
            CAST(json_object('content', json_object('n', json_extract(content, '$.n'), 'ok', json_extract(content, '$.ok')), 'id', r.id, 'role', 'tool', 'type', 'result') AS VARCHAR)
        FROM results r LEFT JOIN sound s ON s.conv = r.conv AND s.id = r.id
    """,
    "op4_poisson_mix": """
        WITH sizes AS (
            SELECT source, CAST(sum(coalesce(strlen(text), 0)) AS DOUBLE) AS n_bytes FROM documents GROUP BY source
        ), rates AS (
            SELECT source, round(CASE WHEN n_bytes > 0 THEN (pow(n_bytes, 0.5) / (SELECT sum(pow(n_bytes, 0.5)) FROM sizes)) * (SELECT sum(n_bytes) FROM sizes) / n_bytes ELSE 0 END, 9) AS rate FROM sizes
        ), chances AS (
            SELECT source, rate, i, sum(CASE WHEN rate > 0 THEN exp(i * ln(rate) - rate - lgamma(i + 1)) WHEN i = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY i) AS cdf
            FROM rates, range(0, 200) AS steps(i)
        ), drawn AS (
            SELECT doc_id, source, (CAST('0x' || substr(md5('17:' || doc_id || ':1'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents
        ), counts AS (
            SELECT doc_id, d.source, rate, count(*) AS copies FROM drawn d JOIN chances c ON d.source = c.source AND c.cdf < d.u GROUP BY ALL
        )
        SELECT doc_id, source, rate, CAST(copies AS BIGINT) AS copies, CAST(copy AS BIGINT) AS copy, md5('17:order:' || doc_id || ':' || copy) AS shuffle_key
        FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM counts)
    """,
    "op10_bayes_minhash": """
        WITH RECURSIVE listed AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM listed
        ), grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
        both_ AS (
            SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
            FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id AND least(a.n, b.n) * 100 >= 85 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id
        ), links AS (SELECT a, b FROM both_ WHERE 100 * c >= 85 * (na + nb - c)),
        reach AS (
            SELECT doc_id AS n, doc_id AS r FROM documents
            UNION
            SELECT reach.n, links.b FROM reach JOIN links ON links.a = reach.r
        ), roots AS (SELECT n, min(r) AS root FROM reach GROUP BY n)
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, root AS component_id, s.doc_id = root AS kept FROM sets s JOIN roots ON roots.n = s.doc_id
    """,
    "op12_csr_impacts": r"""
        WITH held AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
        ), totals AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_words FROM held WHERE len(w) > 0),
        asked AS (
            SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark
        ), postings AS (
            SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM held) WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term
        ), weights AS (
            SELECT term, CAST(floor(1000 * ln(CAST(2 * (SELECT n_docs FROM totals) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM postings GROUP BY term
        ), impacts AS (
            SELECT doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * (SELECT n_docs FROM totals)) // (SELECT n_words FROM totals)))) AS impact FROM postings JOIN weights USING (term)
        ), scores AS (SELECT item_id, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM asked JOIN impacts USING (term) GROUP BY item_id, doc_id)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
    """,
}
