"""Chat formatting: tool-call linking, in DataFrame functions only.

An assistant turn whose text is a JSON object with `tool_calls` holds calls
({"content": ..., "tool_calls": [{"id", "name", "arguments", "depends_on"}]}), a turn of role `tool` whose text is a
JSON object with `tool_call_id` holds a result ({"tool_call_id", "content"}); every other turn is a plain message.
Calls and results meet by an equi-join on (conversation, identifier). A result follows its call, and a call follows
the results of the calls it names in `depends_on`; everything else keeps its turn. Arguments are checked against the
parameters of the tool, and every row is written as canonical JSON: sorted keys, no spaces, normal numbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

CALLS = "struct<content:string,tool_calls:array<struct<id:string,name:string,arguments:string,depends_on:array<string>>>>"
RESULT = "struct<tool_call_id:string,content:variant>"
#: JSON Schema types and the variant types that satisfy them.
TYPES = {
    "string": "^STRING$", "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$", "number": "^(BIGINT|DOUBLE|DECIMAL)", "boolean": "^BOOLEAN$", "array": "^ARRAY", "object": "^OBJECT",
}


def no_tools(like: DataFrame) -> DataFrame:
    """An empty table of tool parameters."""
    return like.sparkSession.createDataFrame([], "name string, parameter string, type string, required boolean")


GATHERED = 64


def _level(calls: DataFrame) -> DataFrame:
    """calls with `at_turn` and `level`: the turn after which a call can come, and its depth below others of that turn.

    A call comes after the latest place of what it needs: places rise along depends_on until nothing changes. A chain
    has at most as many calls as its conversation, so a call with a longer chain lies in a cycle or behind one: its
    level is -1. A conversation of at most GATHERED calls is settled in one row, whatever the number of conversations.
    Longer ones, which no row could hold, are settled by joins: where no call needs more than one, chains are followed
    in steps that double, so rounds grow with the logarithm of their length; otherwise calls are placed as soon as all
    they need are, a round for each link of the longest chain that ends. Cycles take no rounds.
    """
    edges = calls.select("conv", "call_id", F.explode("depends_on").alias("needs")).distinct()
    # rows of a table may repeat: one row for each call of a conversation
    now = materialise(calls.groupBy("conv", "call_id").agg(F.min("turn").alias("turn")))

    def at(df: DataFrame, call: str = "call_id") -> Column:
        """The rows of df of the same conversation (a null one is like any other) and call."""
        return df["conv"].eqNullSafe(F.col("_conv")) & (df[call] == F.col("_id"))

    known = now.select(F.col("conv").alias("_conv"), F.col("call_id").alias("_id"))
    edges = materialise(edges.join(known, at(edges, "needs"), "left_semi"))
    if not edges.limit(1).count():
        return calls.withColumn("at_turn", F.col("turn")).withColumn("level", F.lit(0))
    sizes = now.groupBy(F.col("conv").alias("_conv")).agg(F.count("*").alias("calls"))
    short = sizes.where(F.col("calls") <= GATHERED)
    places = _gathered(*(df.join(short.select("_conv"), df["conv"].eqNullSafe(F.col("_conv")), "left_semi") for df in (now, edges)))
    long = sizes.where(F.col("calls") > GATHERED)
    needs = edges.groupBy("conv", "call_id").agg(F.count("*").alias("n")).groupBy(F.col("conv").alias("_c")).agg(F.max("n").alias("needs"))
    long = materialise(long.join(needs, F.col("_conv").eqNullSafe(F.col("_c")), "left").select("_conv", "calls", F.coalesce("needs", F.lit(0)).alias("needs")))
    for settle, which in ((_by_doubling, F.col("needs") <= 1), (_by_rounds, F.col("needs") > 1)):
        some = long.where(which)
        most = some.agg(F.max("calls")).first()[0]
        if most:
            places = places.union(settle(*(df.join(some.select("_conv"), df["conv"].eqNullSafe(F.col("_conv")), "left_semi") for df in (now, edges)), most))
    return calls.join(places, at(calls)).select(
        *calls.columns, F.when(F.col("loose"), F.col("turn")).otherwise(F.col("place.at_turn")).alias("at_turn"), F.when(F.col("loose"), F.lit(-1)).otherwise(F.col("place.level")).alias("level")
    )


def _gathered(now: DataFrame, edges: DataFrame) -> DataFrame:
    """(_conv, _id, place, loose) of each call, conversation by conversation in arrays of at most GATHERED calls."""
    each = now.groupBy(F.col("conv").alias("_conv")).agg(F.sort_array(F.collect_list(F.struct("call_id", "turn"))).alias("calls"))
    needed = edges.groupBy("conv").agg(F.collect_list(F.struct("call_id", "needs")).alias("edges"))
    both = each.join(needed, F.col("_conv").eqNullSafe(F.col("conv")), "left").drop("conv")
    ids = F.col("calls.call_id")
    under = F.transform(
        "calls", lambda c: F.transform(F.filter(F.coalesce("edges", F.array().cast("array<struct<call_id:string,needs:string>>")), lambda e: e["call_id"] == c["call_id"]), lambda e: F.array_position(ids, e["needs"]).cast("int"))
    )
    start = F.transform("calls", lambda c: F.struct(F.struct(c["turn"].cast("long").alias("at_turn"), F.lit(0).alias("level")).alias("place"), F.lit(0).alias("depth")))

    def risen(known: Column) -> Column:
        after = lambda j: F.struct(F.element_at(known, j)["place"]["at_turn"].alias("at_turn"), (F.element_at(known, j)["place"]["level"] + 1).alias("level"))
        deeper = lambda j: F.element_at(known, j)["depth"] + 1
        most = lambda js, of, own: F.greatest(own, F.coalesce(F.array_max(F.transform(js, of)), own))
        return F.zip_with(known, "under", lambda p, js: F.struct(most(js, after, p["place"]).alias("place"), most(js, deeper, p["depth"]).alias("depth")))

    settled = both.withColumn("under", under).withColumn("known", F.aggregate(F.sequence(F.lit(1), F.size("calls")), start, lambda s, _: risen(s)))
    rows = settled.select("_conv", F.size("calls").alias("n"), F.explode(F.arrays_zip("calls", "known")).alias("r"))
    return rows.select("_conv", F.col("r.calls.call_id").alias("_id"), F.col("r.known.place").alias("place"), (F.col("r.known.depth") >= F.col("n")).alias("loose"))


def _keyed(df: DataFrame, conv: str, call: str, **more: str) -> DataFrame:
    """df under the names _conv and _id, with further columns renamed: the side of a join that is looked up."""
    return df.select(F.col(conv).alias("_conv"), F.col(call).alias("_id"), *(F.col(old).alias(new) for new, old in more.items()))


def _place() -> Column:
    return F.struct(F.col("turn").cast("long").alias("at_turn"), F.lit(0).alias("level")).alias("place")


def _by_doubling(now: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """(_conv, _id, place, loose) where no call needs more than one other.

    Each call knows the best place over a stretch of the calls before it and the call at the end of the stretch; a round
    puts the stretch of that call behind its own. After as many rounds as double to `most`, a call whose stretch does
    not end is in a cycle or behind one.
    """
    ahead = _keyed(edges, "conv", "call_id", next="needs")
    walk = now.join(ahead, now["conv"].eqNullSafe(F.col("_conv")) & (now["call_id"] == F.col("_id")), "left")
    walk = materialise(walk.select("conv", "call_id", _place(), "next", F.lit(1).alias("length")))
    for _ in range(most.bit_length()):
        there = _keyed(walk, "conv", "call_id", under="place", after="next", further="length")
        step = walk.join(there, walk["conv"].eqNullSafe(F.col("_conv")) & (walk["next"] == F.col("_id")), "left")
        moved = F.struct(F.col("under.at_turn").alias("at_turn"), (F.col("under.level") + F.col("length")).alias("level"))
        met = F.col("_id").isNotNull()
        old, walk = walk, materialise(
            step.select(
                "conv", "call_id", F.when(met, F.greatest("place", moved)).otherwise(F.col("place")).alias("place"), F.col("after").alias("next"),
                F.when(met, F.col("length") + F.col("further")).otherwise(F.col("length")).alias("length"),
            )
        )
        discard(old)
        if not walk.where("next is not null").limit(1).count():
            break
    return walk.select(F.col("conv").alias("_conv"), F.col("call_id").alias("_id"), "place", F.col("next").isNotNull().alias("loose"))


def _by_rounds(now: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """(_conv, _id, place, loose): calls are placed once all that they need are; those never placed are loose."""
    wanted = _keyed(edges, "conv", "call_id").groupBy("_conv", "_id").agg(F.count("*").alias("missing"))
    open_ = now.join(wanted, now["conv"].eqNullSafe(F.col("_conv")) & (now["call_id"] == F.col("_id")), "left")
    open_ = materialise(open_.select("conv", "call_id", _place(), F.coalesce("missing", F.lit(0).cast("long")).alias("missing")))
    done = []
    while open_.where("missing = 0").limit(1).count():
        ready, rest = open_.where("missing = 0"), open_.where("missing > 0")
        done.append(ready.select(F.col("conv").alias("_conv"), F.col("call_id").alias("_id"), "place", F.lit(False).alias("loose")))
        above = _keyed(ready, "conv", "call_id", under="place")
        met = edges.join(above, edges["conv"].eqNullSafe(F.col("_conv")) & (edges["needs"] == F.col("_id"))).groupBy(F.col("conv").alias("_conv"), F.col("call_id").alias("_id"))
        met = met.agg(F.count("*").alias("found"), F.max("under").alias("under"))
        after = F.struct(F.col("under.at_turn").alias("at_turn"), (F.col("under.level") + 1).alias("level"))
        step = rest.join(met, rest["conv"].eqNullSafe(F.col("_conv")) & (rest["call_id"] == F.col("_id")), "left")
        open_ = materialise(
            step.select(
                "conv", "call_id", F.when(F.col("found").isNull(), F.col("place")).otherwise(F.greatest("place", after)).alias("place"),
                (F.col("missing") - F.coalesce("found", F.lit(0))).alias("missing"),
            )
        )
        if len(done) == 32:  # a union of few tables, however many rounds
            done = [materialise(reduce(DataFrame.union, done))]
    done.append(open_.select(F.col("conv").alias("_conv"), F.col("call_id").alias("_id"), "place", F.lit(True).alias("loose")))
    return reduce(DataFrame.union, done)


def _problem(params: Column) -> tuple[Column, Column]:
    """The types of the arguments by name (to be called _kinds), and from them the first violation among a tool's
    parameters, by name: one missing, or one whose value has another type."""
    kinds = F.transform_values(F.from_json("arguments", "map<string,variant>"), lambda _, v: F.schema_of_variant(v))

    def wrong(p: Column) -> Column:
        kind = F.element_at("_kinds", p["parameter"])
        fits = F.lit(True)
        for name, pattern in TYPES.items():
            fits = F.when(p["type"] == name, kind.rlike(pattern)).otherwise(fits)
        missing = kind.isNull() | (kind == "VOID")
        return F.when(missing & p["required"], F.concat(F.lit("missing "), p["parameter"])).when(~missing & ~fits, F.concat(F.lit("type of "), p["parameter"]))

    return kinds, F.try_element_at(F.array_compact(F.transform(params, wrong)), F.lit(1))


def _checked(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """calls with `problem`: why they do not fit their tool's declaration, or null."""
    declared = tools.select(F.col("name").alias("tool"), "parameter", F.lower("type").alias("type"), F.coalesce("required", F.lit(False)).alias("required"))
    # one declaration a tool, not data: gathering its parameters is bounded by the declaration
    shapes = declared.groupBy("tool").agg(F.array_sort(F.collect_set(F.struct("parameter", "type", "required"))).alias("params"))
    kinds, wrong = _problem(F.filter("params", lambda p: p["parameter"].isNotNull()))
    parsed = F.try_parse_json("arguments")
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    both = calls.join(shapes, F.col("name") == F.col("tool"), "left").withColumn("_kinds", F.when(is_object, kinds))
    return both.withColumn(
        "problem",
        F.when(F.col("call_id").isNull(), "no identifier")
        .when(~is_object, "arguments are no object")
        .when(F.col("tool").isNull(), "unknown tool")
        .otherwise(wrong),
    ).select(*calls.columns, "problem")


def _first(items: DataFrame) -> DataFrame:
    """items with `again`: whether an earlier one of the same conversation has the same identifier."""
    first = items.groupBy(F.col("conv").alias("_c"), F.col("call_id").alias("_i")).agg(F.min(F.struct("turn", "item")).alias("first"))
    marked = items.join(first, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("call_id") == F.col("_i")), "left").drop("_c", "_i")
    return marked.withColumn("again", F.col("call_id").isNotNull() & (F.struct("turn", "item") > F.col("first"))).drop("first")


def link(
    chats: DataFrame, tools: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per message, call and result, in topological order within each conversation.

    Returns conv_col, turn_col, item (its place in the turn), kind (message, call, result), call_id, linked (a call has
    a result, a result has a call; null for messages), problem (null if there is none), at_turn and level (rows are
    sorted by conversation, at_turn, level, turn of the call, item, and a call before its result), and json.
    `tools` is (name, parameter, type, required); a row with a null parameter declares a tool without parameters.
    A call without an identifier, a repeated identifier, a result without a call, a cycle of calls and arguments that
    do not fit are kept and named in `problem`. A null text is a message with null content; repeated rows are kept; a
    null conversation links like any other; other columns are ignored; an empty table gives no rows.
    """
    text = F.col(text_col)
    call = F.when((F.col(role_col) == "assistant") & text.startswith("{"), F.from_json(text, CALLS))
    result = F.when((F.col(role_col) == "tool") & text.startswith("{"), F.from_json(text, RESULT))
    base = chats.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), text.alias("text"), call.alias("c"), result.alias("r"))

    def item(kind: str, at: Column, **fields: Column) -> Column:
        kinds = {"call_id": "string", "name": "string", "arguments": "string", "content": "string", "depends_on": "array<string>"}
        return F.struct(F.lit(kind).alias("kind"), at.cast("int").alias("item"), *(fields.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()))

    # arguments come as an object or as JSON in a string: read and written once, equal numbers are equal text in both
    written = lambda a: F.coalesce(F.to_json(F.try_parse_json(a)), a)
    calls = F.transform(
        F.col("c.tool_calls"), lambda c, i: item("call", i + 1, call_id=c["id"], name=c["name"], arguments=written(c["arguments"]), depends_on=c["depends_on"])
    )
    said = F.when(F.col("c.content").isNotNull(), F.array(item("message", F.lit(0), content=F.col("c.content"))))
    result_item = F.array(item("result", F.lit(0), call_id=F.col("r.tool_call_id"), content=F.coalesce(F.to_json("r.content"), F.lit("null"))))
    items = (
        F.when(F.col("c.tool_calls").isNotNull(), F.concat(F.coalesce(said, F.slice(calls, 1, 0)), calls))
        .when(F.col("r.tool_call_id").isNotNull(), result_item)
        .otherwise(F.array(item("message", F.lit(0), content=F.col("text"))))
    )
    every = base.select("conv", "turn", "role", F.inline(items))
    messages = every.where("kind = 'message'")
    tooling = materialise(every.where("kind <> 'message'"))
    called = _first(_checked(tooling.where("kind = 'call'"), tools if tools is not None else no_tools(chats)))
    called = called.withColumn("problem", F.when(F.col("again"), "repeated identifier").otherwise(F.col("problem")))
    sound = called.where("call_id is not null and not again").withColumn("depends_on", F.coalesce("depends_on", F.array().cast("array<string>")))
    sound = _level(materialise(sound)).withColumn("problem", F.when(F.col("level") < 0, "cycle").otherwise(F.col("problem"))).withColumn("level", F.greatest("level", F.lit(0)) + 1)
    odd = called.where("call_id is null or again").withColumn("at_turn", F.col("turn")).withColumn("level", F.lit(1))
    returned = _first(tooling.where("kind = 'result'"))
    # rows of a table may repeat: one end and one head for each identifier
    ends = returned.where("not again").select(F.col("conv").alias("_conv"), F.col("call_id").alias("_id")).distinct().hint("shuffle_hash")
    sound = sound.join(ends, sound["conv"].eqNullSafe(F.col("_conv")) & (sound["call_id"] == F.col("_id")), "left").withColumn("linked", F.col("_id").isNotNull())
    heads = sound.select(
        F.col("conv").alias("_conv"), F.col("call_id").alias("_id"), F.col("at_turn"), F.col("level"), F.col("turn").alias("of_turn"), F.col("item").alias("of_item")
    ).distinct().hint("shuffle_hash")
    back = returned.join(heads, returned["conv"].eqNullSafe(F.col("_conv")) & (returned["call_id"] == F.col("_id")), "left")
    back = back.withColumn("linked", F.col("_id").isNotNull() & ~F.col("again")).withColumn(
        "problem", F.when(F.col("again"), "repeated identifier").when(F.col("_id").isNull(), "no call")
    )

    def out(df: DataFrame, linked: Column, problem: Column, at_turn: Column, level: Column, of_turn: Column, of_item: Column, step: int, json: Column) -> DataFrame:
        return df.select(
            "conv", "turn", "item", "kind", "call_id", linked.cast("boolean").alias("linked"), problem.cast("string").alias("problem"), at_turn.alias("at_turn"),
            level.cast("int").alias("level"), of_turn.alias("of_turn"), of_item.cast("int").alias("of_item"), F.lit(step).alias("step"), json.alias("json"),
        )

    def canonical(**fields: Column) -> Column:
        return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})

    none = F.lit(None)
    call_json = canonical(arguments=F.coalesce(F.try_parse_json("arguments"), F.to_variant_object(F.struct(F.col("arguments").alias("text")))), id=F.col("call_id"), name=F.col("name"), role=F.lit("assistant"), type=F.lit("call"))
    result_json = canonical(content=F.try_parse_json("content"), id=F.col("call_id"), role=F.lit("tool"), type=F.lit("result"))
    parts = [
        out(messages, none, none, F.col("turn"), F.lit(0), F.col("turn"), F.col("item"), 0, canonical(content=F.col("content"), role=F.col("role"))),
        out(sound, F.col("linked"), F.col("problem"), F.col("at_turn"), F.col("level"), F.col("turn"), F.col("item"), 1, call_json),
        out(odd, F.lit(False), F.col("problem"), F.col("at_turn"), F.col("level"), F.col("turn"), F.col("item"), 1, call_json),
        out(back, F.col("linked"), F.col("problem"), F.coalesce("at_turn", "turn"), F.coalesce("level", F.lit(1)), F.coalesce("of_turn", "turn"), F.coalesce("of_item", "item"), 2, result_json),
    ]
    whole = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    order = ["conv", "at_turn", "level", "of_turn", "of_item", "step", "turn", "item"]
    return whole.repartitionByRange(*order).sortWithinPartitions(*order).select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), "item", "kind", "call_id", "linked", "problem", "at_turn", "level", "json"
    )
