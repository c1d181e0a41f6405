"""Candidate distributions: aligning beams, merging scores, ranking, commitment and its alternatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import first_line, label_of, parse_schema_pattern
from ..plans.catalog import GraphSchema


def logsumexp(df: DataFrame, keys: list[str], score: str, out: str = "score") -> DataFrame:
    """ln of the summed exponentials by key, without overflow: the maximum is taken out first."""
    top = df.groupBy(*keys).agg(F.max(score).alias("_top"))
    both = df.join(top, keys)
    return both.groupBy(*keys).agg((F.max("_top") + F.ln(F.sum(F.exp(F.col(score) - F.col("_top"))))).alias(out))


def softmax_rank(df: DataFrame, slot: list[str], score: str, ties: list[Column]) -> DataFrame:
    """Probabilities of log scores within a slot (`prob`) and their rank from 1; ties fall in the order of `ties`."""
    whole = Window.partitionBy(*slot)
    shifted = df.withColumn("_e", F.exp(F.col(score) - F.max(score).over(whole)))
    prob = shifted.withColumn("prob", F.col("_e") / F.sum("_e").over(whole)).drop("_e")
    return prob.withColumn("rank", F.row_number().over(whole.orderBy(F.desc(score), *ties)))


def parse_beams(completions: DataFrame, schema: GraphSchema, check: bool = True) -> DataFrame:
    """completions (question_id, rank, text, score) with `parsed` and `valid`.

    A beam is valid if its first line parses, has a node or relationship, and every label and (single) type is in the
    schema; an untyped relationship makes it invalid.
    """
    df = completions.withColumn("parsed", parse_schema_pattern(first_line("text")))
    if not check:
        return df.withColumn("valid", F.col("parsed.ok"))
    labels, types = F.array(*map(F.lit, schema.labels)), F.array(*map(F.lit, schema.types))
    nodes = F.forall("parsed.nodes", lambda n: n["label"].isNull() | F.array_contains(labels, n["label"]))
    rels = F.forall("parsed.rels", lambda r: r["type"].isNotNull() & F.coalesce(F.array_contains(types, r["type"]), F.lit(False)))
    return df.withColumn("valid", F.col("parsed.ok") & nodes & rels)


ELEMENT = ["element_type", "name", "source_label", "target_label", "active"]


def _elements(parsed: Column) -> Column:
    """Relationships, from source to target, and labelled nodes of a parsed pattern as (kind, pos, ELEMENT), each by position from 1."""
    none = F.lit(None).cast("string")

    def rel(r: Column, i: Column) -> Column:
        a, b, back = label_of(parsed["nodes"], r["src"]), label_of(parsed["nodes"], r["tgt"]), r["direction"] == "<-"
        return F.struct(
            F.lit("rel_").alias("kind"), (i + 1).alias("pos"), F.lit("relationship_type").alias("element_type"), r["type"].alias("name"),
            F.when(back, b).otherwise(a).alias("source_label"), F.when(back, a).otherwise(b).alias("target_label"), r["active"].alias("active"),
        )

    def node(n: Column, i: Column) -> Column:
        return F.struct(F.lit("node_").alias("kind"), (i + 1).alias("pos"), F.lit("node_label").alias("element_type"), n["label"].alias("name"), none.alias("source_label"), none.alias("target_label"), F.lit(False).alias("active"))

    return F.concat(F.transform(parsed["rels"], rel), F.filter(F.transform(parsed["nodes"], node), lambda x: x["name"].isNotNull()))


def align(beams: DataFrame) -> DataFrame:
    """(question_id, slot, ELEMENT, first_seen, score) of beams (question_id, rank, score, elements), which are dealt out
    by question already: every step after that is a window or a grouping inside the question, without a shuffle.

    A hop whose triple varies across the beams of a question is slot rel_N; one whose triple agrees but whose active
    filter varies is rel_N_temporal; a node whose label varies is node_N. Scores of equal elements are merged by
    log-sum-exp. Where nothing varies, every element of the first beam is a slot.
    """
    question = Window.partitionBy("question_id")
    spot = Window.partitionBy("question_id", "kind", "pos")
    rows = beams.select("question_id", "rank", "score", F.min("rank").over(question).alias("_first"), "elements").select("question_id", "rank", "score", "_first", F.inline("elements"))
    triple = F.struct("name", "source_label", "target_label")
    differs = lambda x: ~F.min(x).over(spot).eqNullSafe(F.max(x).over(spot))
    seen = rows.withColumns({"_triples": differs(triple), "_states": differs(F.col("active"))})
    own = F.concat("kind", F.col("pos").cast("string"))
    seen = seen.withColumn("slot", F.when(F.col("_triples"), own).when(F.col("_states"), F.concat(own, F.lit("_temporal"))))
    seen = seen.withColumn("_varies", F.count("slot").over(question) > 0)
    kept = seen.where(F.col("slot").isNotNull() | (~F.col("_varies") & (F.col("rank") == F.col("_first"))))
    kept = kept.withColumn("active", F.col("active") & F.col("_states") & ~F.col("_triples")).withColumn("slot", F.coalesce("slot", own))
    by = ["question_id", "slot", *ELEMENT]
    # elements that all beams share have probability 1, whatever their scores
    shifted = kept.withColumn("score", F.when(F.col("_varies"), F.col("score")).otherwise(F.lit(0.0))).withColumn("_top", F.max("score").over(Window.partitionBy(*by)))
    return shifted.groupBy(*by).agg(F.min("rank").alias("first_seen"), (F.max("_top") + F.ln(F.sum(F.exp(F.col("score") - F.col("_top"))))).alias("score"))


def beam_status(beams: DataFrame, min_valid: int = 1) -> DataFrame:
    """(question_id, n_beams, n_valid, status) of parsed beams: no_valid_beams where fewer than `min_valid` are valid."""
    status = beams.groupBy("question_id").agg(F.count("*").alias("n_beams"), F.count_if("valid").alias("n_valid"))
    return status.withColumn("status", F.when(F.col("n_valid") < max(min_valid, 1), "no_valid_beams").otherwise("ok"))


def candidate_mapping(completions: DataFrame, schema: GraphSchema, min_valid: int = 1) -> tuple[DataFrame, DataFrame]:
    """Distributions (question_id, slot, rank, ELEMENT, prob) and status (question_id, n_beams, n_valid, status).

    Where all valid beams agree, every element of the first is a slot of its own with probability 1. Questions with
    fewer than `min_valid` valid beams have the status `no_valid_beams` and no candidates.

    The beams are shuffled once, by question and with their elements only; a question's beams, which a decoder's width
    bounds, are in one task.
    """
    beams = parse_beams(completions, schema)
    status = beam_status(beams, min_valid)
    dealt = beams.where("valid").select("question_id", "rank", "score", _elements(F.col("parsed")).alias("elements")).repartition("question_id")
    enough = dealt.withColumn("_n", F.count("*").over(Window.partitionBy("question_id"))).where(F.col("_n") >= min_valid) if min_valid > 1 else dealt
    ranked = softmax_rank(align(enough), ["question_id", "slot"], "score", [F.asc("first_seen"), F.asc("name"), F.asc("active")])
    return ranked.select("question_id", "slot", "rank", *ELEMENT, "prob"), status


def top1(candidates: DataFrame, keys: list[str], rank: str = "rank") -> DataFrame:
    return candidates.where(F.col(rank) == 1).drop(rank).select(*keys, *[c for c in candidates.columns if c not in (*keys, rank)])


def substitutions(candidates: DataFrame, question: str, slot: str, element: str, prob: str = "prob", rank: str = "rank") -> DataFrame:
    """Commitments to try in order: the best of every slot (0), then one lower candidate at a time by falling score.

    Returns (question, choice, slot, element), slot null for choice 0, whose element is null too.
    """
    subs = candidates.where(F.col(rank) > 1)
    order = Window.partitionBy(question).orderBy(F.desc(prob), F.asc(slot), F.asc(rank))
    rest = subs.select(question, F.row_number().over(order).cast("long").alias("choice"), slot, element)
    base = candidates.select(question).distinct().select(question, F.lit(0).cast("long").alias("choice"), F.lit(None).cast("string").alias(slot), F.lit(None).cast("string").alias(element))
    return base.unionByName(rest)


def next_untried(choices: DataFrame, tried: DataFrame, question: str, text: str, order: str = "choice") -> DataFrame:
    """The first choice of each question whose text was not tried, exhausted questions absent."""
    left = choices.where(F.col(text) != "").join(tried.select(question, text).distinct(), [question, text], "left_anti")
    return left.groupBy(question).agg(F.min_by(F.struct(*left.columns), order).alias("_best")).select("_best.*")


def render(committed: Column) -> Column:
    """Elements of a commitment (array of ELEMENT structs) as a pattern: relationships, then labels no relationship has.

    Property elements (element_type 'property', owner in source_label) are listed at their owner.
    """
    props = F.filter(committed, lambda e: e["element_type"] == "property")

    def node(label: Column) -> Column:
        names = F.array_join(F.transform(F.filter(props, lambda p: p["source_label"] == label), lambda p: p["name"]), ", ")
        return F.concat(F.lit("("), F.coalesce(F.nullif(F.lower(F.substr(label, F.lit(1), F.lit(1))), F.lit("")), F.lit("n")), F.lit(":"), label, F.when(names != "", F.concat(F.lit(" {"), names, F.lit("}"))).otherwise(""), F.lit(")"))

    blank = lambda c: F.coalesce(c, F.lit(""))
    rels = F.filter(committed, lambda e: e["element_type"] == "relationship_type")
    used = F.flatten(F.transform(rels, lambda r: F.array(r["source_label"], r["target_label"])))
    lone = F.filter(committed, lambda e: (e["element_type"] == "node_label") & ~F.coalesce(F.array_contains(used, e["name"]), F.lit(False)))
    parts = F.concat(
        F.transform(rels, lambda r: F.concat(node(blank(r["source_label"])), F.lit("-[:"), r["name"], F.lit("]->"), node(blank(r["target_label"])))),
        F.transform(lone, lambda n: node(n["name"])),
    )
    return F.array_join(parts, ", ")


def committed_elements(patterns: DataFrame, known: DataFrame, pattern: str = "pattern") -> DataFrame:
    """(question_id, slot, element columns, origin) of each committed pattern, one a question.

    `known` has the element columns of a question's candidates. A typed relationship, oriented from source to target, is
    looked up among its question's with the same active filter (origin `exact`), then among those without one (`plain`),
    and stands for itself where neither is (`new`); an untyped one commits nothing. Labels that no typed relationship
    touches follow as node_1, node_2, ...
    """
    parsed = patterns.select("question_id", parse_schema_pattern(pattern).alias("p")).where("p.ok")
    hops = parsed.select("question_id", F.col("p.nodes").alias("_of"), F.posexplode("p.rels").alias("pos", "r")).where("r.type is not null")
    a, b, back = label_of(F.col("_of"), F.col("r.src")), label_of(F.col("_of"), F.col("r.tgt")), F.col("r.direction") == "<-"
    hops = hops.select(
        "question_id", F.concat(F.lit("rel_"), (F.col("pos") + 1).cast("string")).alias("slot"), F.col("r.type").alias("name"),
        F.when(back, b).otherwise(a).alias("source_label"), F.when(back, a).otherwise(b).alias("target_label"), F.col("r.active").alias("active"),
    )
    by = ["question_id", "name", "source_label", "target_label"]
    have = known.where("element_type = 'relationship_type'").groupBy(*by).agg(F.bool_or("active").alias("_active"), F.bool_or(~F.col("active")).alias("_plain"))
    have = have.select(*(F.col(c).alias(f"_{c}") for c in by), "_active", "_plain")
    same = hops["question_id"] == have["_question_id"]
    for c in by[1:]:
        same = same & hops[c].eqNullSafe(have[f"_{c}"])
    both = hops.join(have, same, "left")
    exact = F.when(F.col("active"), F.col("_active")).otherwise(F.col("_plain"))
    origin = F.when(exact, "exact").when(F.col("_plain"), "plain").otherwise("new")
    rels = both.select(
        "question_id", "slot", F.lit("relationship_type").alias("element_type"), "name", "source_label", "target_label",
        F.when(origin == "plain", F.lit(False)).otherwise(F.col("active")).alias("active"), origin.alias("origin"),
    )
    typed = F.filter("p.rels", lambda r: r["type"].isNotNull())
    label = lambda alias: label_of(F.col("p.nodes"), alias)
    touched = F.flatten(F.transform(typed, lambda r: F.array(label(r["src"]), label(r["tgt"]))))
    lone = F.filter("p.nodes", lambda n: n["label"].isNotNull() & ~F.coalesce(F.array_contains(F.array_compact(touched), n["label"]), F.lit(False)))
    nodes = parsed.select("question_id", F.posexplode(F.transform(lone, lambda n: n["label"])).alias("pos", "name"))
    none = F.lit(None).cast("string")
    spots = nodes.select(
        "question_id", F.concat(F.lit("node_"), (F.col("pos") + 1).cast("string")).alias("slot"), F.lit("node_label").alias("element_type"), "name",
        none.alias("source_label"), none.alias("target_label"), F.lit(False).alias("active"), F.lit("new").alias("origin"),
    )
    return rels.union(spots)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def cosine_prefilter(paths: DataFrame, question: Column, embedding: str, key: str, top_k: int = 20, threshold: float = 0.3) -> DataFrame:
    """Paths similar enough to the question, and the top_k in any case; all of them if there are no more than top_k."""
    scored = paths.withColumn("similarity", cosine(F.col(embedding), question))
    floor = scored.orderBy(F.desc("similarity"), key).limit(top_k).select(F.col(key).alias("_k"))
    near = scored.where(F.col("similarity") >= threshold).select(F.col(key).alias("_k"))
    keep = near.union(floor).distinct()
    return scored.join(keep, F.col(key) == F.col("_k"), "left_semi")


def pruned(schema: GraphSchema, kept: list[tuple[str, str, str]]) -> GraphSchema:
    """The schema of the kept paths (type, source, target): labels that no path touches, and their properties, go."""
    wanted = set(kept)
    paths = [p for p in schema.paths if (p.type, p.source, p.target) in wanted]
    labels = {x for p in paths for x in (p.source, p.target)}
    types = {p.type for p in paths}
    return GraphSchema([x for x in schema.labels if x in labels], paths, {k: v for k, v in schema.props.items() if k in labels | types})
