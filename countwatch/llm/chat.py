"""Chat formatting with tool-call linking (operator 5).

Calls and results meet by a hash join on (conversation, call id). A call may name calls whose results it needs;
messages are then put in a topological order: a call stands at its own turn unless one that it needs stands
later, and then directly after that one, its result behind it. Arguments are checked against the tool's
schema, and each message is written as canonical JSON: keys sorted, no spaces, absent values left out.

The output has one row per message with its order, not one row per conversation, so a conversation that holds
a third of all messages is no group anywhere: joins may be split, aggregates combine before the shuffle.

Only calls that need a later one can be out of order. They, and the calls that lie in the turns such a need
spans, are peeled from both ends; what cannot be peeled lies on or between cycles, is marked so and stays at
its turn. The others' orders are then raised from need to need until nothing changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from countwatch.llm.common import stage, table

KEY = ["conv_id", "call_id"]


def canonical(fields: dict[str, Column]) -> Column:
    """One JSON object with sorted keys and no spaces; null fields are left out."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))))


def canonical_value(text: Column) -> Column:
    """Text as a JSON value with its own types, the keys of all its objects sorted; other text as a string."""
    quoted = F.variant_get(F.parse_json(F.to_json(F.array(text))), "$[0]", "variant")
    return F.when(text.isNotNull(), F.coalesce(F.try_parse_json(text), quoted))


def problems(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """(conv_id, call_id, problems): why a call's arguments do not fit, as a sorted array.

    ``schemas`` has name, param, kind (string, integer, number, boolean) and required. A call of an unknown tool,
    a missing or unknown parameter, and a value whose JSON type is not that of its kind are problems (null is of no
    kind); so are arguments that are no JSON object. Of several schema rows for one parameter the required one counts, then
    the first kind by name; a row without a parameter tells only that the tool exists.
    """
    rule = F.min(F.struct((~F.coalesce("required", F.lit(False))).alias("free"), "kind"))
    each = schemas.groupBy("name", "param").agg(rule.alias("r")).select("name", "param", F.struct(F.col("r.kind").alias("kind"), (~F.col("r.free")).alias("required")).alias("rule"))
    entries = F.filter(F.collect_list(F.struct("param", "rule")), lambda e: e["param"].isNotNull())
    tools = each.groupBy("name").agg(F.map_from_entries(entries).alias("params"))
    typed = F.try_variant_get(F.try_parse_json("arguments"), "$", "map<string,variant>")
    spelled = F.from_json("arguments", "map<string,string>")
    rows = calls.join(tools, "name", "left").withColumns({"typed": typed, "spelled": spelled})
    given = F.transform_values("typed", lambda k, v: F.struct(F.schema_of_variant(v).alias("type"), F.col("spelled")[k].alias("text")))
    rows = rows.withColumn("given", given)
    known = F.coalesce("params", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<kind: string, required: boolean>>")))
    given = F.coalesce("given", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<type: string, text: string>>")))

    def fits(kind: Column, value: Column) -> Column:
        is_number, text = value["type"].rlike("^(BIGINT|DOUBLE|DECIMAL.*)$"), value["text"]
        return (
            F.when(kind == "integer", is_number & text.rlike("^-?[0-9]+$"))
            .when(kind == "number", is_number & text.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"))
            .when(kind == "boolean", value["type"] == "BOOLEAN").when(kind == "string", value["type"] == "STRING")
        )

    missing = F.transform(F.filter(F.map_keys(known), lambda k: known[k]["required"] & ~F.map_contains_key(given, k)), lambda k: F.concat(F.lit("missing:"), k))
    unknown = F.transform(F.filter(F.map_keys(given), lambda k: ~F.map_contains_key(known, k)), lambda k: F.concat(F.lit("unknown:"), k))
    wrong = F.transform(
        F.filter(F.map_keys(given), lambda k: F.map_contains_key(known, k) & ~F.coalesce(fits(known[k]["kind"], given[k]), F.lit(False))), lambda k: F.concat(F.lit("kind:"), k)
    )
    no_tool = F.when(F.col("params").isNull(), F.array(F.lit("tool"))).when(F.col("given").isNull(), F.array(F.lit("json")))
    return rows.select(*KEY, "turn", F.array_sort(F.coalesce(no_tool, F.concat(missing, unknown, wrong))).alias("problems"))


def aligned_blocks(low: Column, high: Column) -> Column:
    """The span from ``low`` to ``high`` as aligned blocks of 2**level turns: an array of (level, block), two a level at most.

    From the smallest blocks up, an odd left end and an even right end are blocks of their own; what is between halves.
    """
    block, none = "array<struct<level:int,block:bigint>>", F.array()
    start = F.struct(none.cast(block).alias("out"), low.cast("long").alias("l"), high.cast("long").alias("h"), F.lit(False).alias("done"))

    def one(level: Column, at: Column) -> Column:
        return F.array(F.struct(level.alias("level"), at.alias("block")))

    def step(s: Column, level: Column) -> Column:
        nothing = none.cast(block)
        alone = s["l"] == s["h"]
        odd, even = (s["l"] % 2 != 0), (s["h"] % 2 == 0)
        out = F.when(alone, one(level, s["l"])).otherwise(F.concat(F.when(odd, one(level, s["l"])).otherwise(nothing), F.when(even, one(level, s["h"])).otherwise(nothing)))
        l = F.when(~alone & odd, s["l"] + 1).otherwise(s["l"])
        h = F.when(~alone & even, s["h"] - 1).otherwise(s["h"])
        done = alone | (l > h)
        after = F.struct(F.concat(s["out"], out).alias("out"), F.shiftright(l, 1).alias("l"), F.shiftright(h, 1).alias("h"), done.alias("done"))
        return F.when(s["done"], s).otherwise(after)

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), start, step, lambda s: s["out"])


def spanned(turns: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows (conv_id, turn) that lie in a span (conv_id, low, high).

    A span is some aligned blocks, two a level at most, and a turn lies in one block of each level, so they meet by equality
    and nothing is made per turn of a span, however far it reaches.
    """
    blocks = stage(spans.select("conv_id", F.explode(aligned_blocks(F.col("low"), F.col("high"))).alias("b")).select("conv_id", "b.level", "b.block").distinct(), "blocks")
    top = blocks.agg(F.max("level")).first()[0] or 0
    above = turns.select("conv_id", "turn", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(top)), lambda k: F.call_function("shiftright", F.col("turn"), k))).alias("level", "block"))
    return above.join(blocks, ["conv_id", "level", "block"], "left_semi").select("conv_id", "turn").distinct()


def ordered(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, at, depth, cyclic): where each call stands; (at, depth) is above those of all it needs.

    ``calls`` has one row per (conv_id, call_id) with turn and needs (array of call ids, null as none). Needs that
    name no call of the conversation, or the call itself, are ignored here.
    """
    nodes = stage(calls.select(*KEY, "turn", F.coalesce("needs", F.array().cast("array<string>")).alias("needs")), "calls")
    edges = nodes.select("conv_id", "call_id", "turn", F.explode(F.array_distinct("needs")).alias("need"))
    edges = stage(edges.where("need != call_id").join(nodes.select("conv_id", F.col("call_id").alias("need"), F.col("turn").alias("need_turn")), ["conv_id", "need"]), "needs")
    start = nodes.select(*KEY, "turn", F.col("turn").alias("at"), F.lit(0).alias("depth"))
    late = edges.where("need_turn >= turn")
    if late.isEmpty():
        return start.select(*KEY, "at", "depth", F.lit(False).alias("cyclic"))
    # Turns that a late need spans, by conversation; only calls inside can lie on a cycle.
    spans = late.groupBy("conv_id", F.col("turn").alias("low")).agg(F.max("need_turn").alias("high"))
    ends = edges.select("conv_id", "turn").union(edges.select("conv_id", "need_turn")).distinct()
    tangled = stage(spanned(ends, spans), "spanned")
    left = stage(edges.join(tangled, ["conv_id", "turn"], "left_semi").join(tangled.withColumnRenamed("turn", "need_turn"), ["conv_id", "need_turn"], "left_semi").select("conv_id", "call_id", "need"), "tangled")
    n = left.count()
    while n:
        sources, targets = left.select("conv_id", F.col("call_id").alias("need")).distinct(), left.select("conv_id", F.col("need").alias("call_id")).distinct()
        left = stage(left.join(sources, ["conv_id", "need"], "left_semi").join(targets, KEY, "left_semi").select("conv_id", "call_id", "need"), "tangled")
        before, n = n, left.count()
        if n == before:
            break
    cyclic = stage(left.select(*KEY).union(left.select("conv_id", "need")).distinct(), "cyclic")
    free = stage(edges.join(cyclic, KEY, "left_anti"), "free_needs")
    now = stage(start, "order")
    moved = now
    while not moved.isEmpty():
        by_need = moved.select("conv_id", F.col("call_id").alias("need"), "at", "depth")
        raised = free.join(by_need, ["conv_id", "need"]).groupBy(*KEY).agg(F.max(F.struct("at", (F.col("depth") + 1).alias("deeper"))).alias("least"))
        after = now.join(raised, KEY, "left")
        up = F.col("least").isNotNull() & ((F.col("least.at") > F.col("at")) | ((F.col("least.at") == F.col("at")) & (F.col("least.deeper") > F.col("depth"))))
        after = stage(after.select(*KEY, "turn", F.when(up, F.col("least.at")).otherwise(F.col("at")).alias("at"), F.when(up, F.col("least.deeper")).otherwise(F.col("depth")).alias("depth"), F.coalesce(up, F.lit(False)).alias("up")), "order")
        now, moved = after.drop("up"), after.where("up")
    return now.join(cyclic.withColumn("cyclic", F.lit(True)), KEY, "left").select(*KEY, "at", "depth", F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


def link(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """(conv_id, at, depth, rank, turn, kind, call_id, status, problems, json): one row per message, call and result.

    Sort a conversation by at, depth, rank, turn, call_id to read it. ``messages`` has conv_id, turn, role, text; ``calls``
    conv_id, call_id, turn, name, arguments (JSON), needs; ``results`` conv_id, call_id, turn, content. Of
    several calls or results with one identifier the earliest turn counts, of equal turns the smaller name or
    content; the others have status duplicate. A call without result is unanswered, one with argument problems
    invalid, one on or between cycles cyclic (in the order cyclic, invalid, unanswered); a result without call is an
    orphan and stands at its own turn. Null texts are left out of the JSON; rows without conversation,
    identifier or turn keep their rows but link with nothing. Empty tables give what the others have.
    """
    linkable = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull() & F.col("turn").isNotNull()

    def counted(df: DataFrame, last: list[str]) -> tuple[DataFrame, DataFrame]:
        """The row of each identifier that counts, and the others."""
        order = F.struct("turn", *last)
        alike = df.where(linkable).groupBy(*KEY, "turn", *last).agg(F.count("*").alias("times"))
        least = alike.groupBy(*KEY).agg(F.min(order).alias("first"), F.sum("times").alias("n"))
        more = alike.join(least.where("n > 1").select(*KEY, "first"), KEY)
        spare = F.col("times") - F.when(order.eqNullSafe(F.col("first")), 1).otherwise(0)
        more = more.withColumn("spare", spare).where("spare > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("spare"))))
        return least.select(*KEY, F.col("first.turn").alias("turn"), *(F.col(f"first.{c}").alias(c) for c in last)), more

    first_calls, more_calls = counted(calls.select(*KEY, "turn", "name", "arguments", "needs"), ["name", "arguments", "needs"])
    first_results, more_results = counted(results.select(*KEY, "turn", "content"), ["content"])
    first_calls = stage(first_calls, "first_calls")
    places = stage(ordered(first_calls), "places")
    answered = first_results.select(*KEY, F.lit(True).alias("answered"))
    own = first_calls.join(places, KEY).join(problems(first_calls, schemas).drop("turn"), KEY).join(answered, KEY, "left")
    status = F.when(F.col("cyclic"), "cyclic").when(F.size("problems") > 0, "invalid").when(F.col("answered").isNull(), "unanswered").otherwise("ok")
    none = F.array().cast("array<string>")

    def call_json() -> Column:
        return canonical({"arguments": canonical_value(F.col("arguments")), "id": F.col("call_id"), "name": F.col("name"), "type": F.lit("call")})

    def result_json() -> Column:
        return canonical({"content": F.col("content"), "id": F.col("call_id"), "type": F.lit("result")})

    def out(df: DataFrame, at: Column, depth: Column, rank: int, kind: str, status: Column, problems: Column, json: Column) -> DataFrame:
        call_id = F.col("call_id") if kind != "message" else F.lit(None).cast("string")
        return df.select(
            "conv_id", at.cast("long").alias("at"), depth.cast("int").alias("depth"), F.lit(rank).alias("rank"), F.col("turn").cast("long").alias("turn"),
            F.lit(kind).alias("kind"), call_id.alias("call_id"), status.alias("status"), problems.alias("problems"), json.alias("json"),
        )

    turn, zero = F.col("turn"), F.lit(0)
    tied = first_results.join(places, KEY, "left")
    loose_calls, loose_results = calls.where(~linkable), results.where(~linkable)
    said = canonical({"content": F.col("text"), "role": F.col("role"), "type": F.lit("message")})
    parts = [
        out(messages, turn, zero, 0, "message", F.lit("ok"), none, said),
        out(own, F.col("at"), F.col("depth"), 1, "call", status, F.col("problems"), call_json()),
        out(more_calls, turn, zero, 1, "call", F.lit("duplicate"), none, call_json()),
        out(loose_calls, turn, zero, 1, "call", F.lit("unlinked"), none, call_json()),
        out(tied, F.coalesce("at", "turn"), F.coalesce("depth", zero), 2, "result", F.when(F.col("at").isNull(), "orphan").otherwise("ok"), none, result_json()),
        out(more_results, turn, zero, 2, "result", F.lit("duplicate"), none, result_json()),
        out(loose_results, turn, zero, 2, "result", F.lit("unlinked"), none, result_json()),
    ]
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    return total


# The tools that the query's calls use.
SCHEMAS = (
    ("search", "query", "string", True), ("search", "limit", "integer", False),
    ("measure", "words", "integer", True), ("measure", "ratio", "number", True),
    ("flag", "urgent", "boolean", True), ("flag", "note", "string", False),
)


def calls_of(conversations: DataFrame) -> DataFrame:
    """A call for every assistant turn, its arguments taken from the whole text.

    The number of words picks the tool, the JSON types of a few values (so that some calls are invalid) and what a call
    needs: the assistant turn before it, or sometimes the one after.
    """
    words = F.size(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+"))
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    rows = conversations.where("role = 'assistant'").withColumns({"w": words, "lines": lines})
    first = F.substring_index(F.coalesce("text", F.lit("")), " ", 1)
    ratio, urgent = F.round(F.col("w") / F.col("lines"), 3).cast("decimal(20,3)"), F.col("w") > 50

    def value(column: Column, else_: Column, wrong: Column) -> Column:
        """The value with its own JSON type; where ``wrong`` holds, another one."""
        return F.when(wrong, else_.cast("variant")).otherwise(column.cast("variant"))

    odd, quoted = F.col("w") % 2 == 1, F.col("w") % 7 == 0
    arguments = (
        F.when(F.col("w") % 3 == 0, F.to_json(F.create_map(F.lit("query"), value(first, F.col("w"), quoted), F.lit("limit"), value(F.col("lines"), first, odd))))
        .when(F.col("w") % 3 == 1, F.to_json(F.create_map(F.lit("words"), value(F.col("w"), F.col("w").cast("string"), quoted), F.lit("ratio"), ratio.cast("variant"))))
        .otherwise(F.to_json(F.create_map(F.when(F.col("w") % 5 == 0, "urgency").otherwise("urgent"), value(urgent, urgent.cast("string"), quoted))))
    )
    need = F.when(F.col("w") % 11 == 5, F.col("turn") + 2).when(F.col("w") % 4 < 3, F.col("turn") - 2)
    return rows.select(
        "conv_id", F.concat(F.lit("c"), F.col("turn")).alias("call_id"), "turn",
        F.when(F.col("w") % 3 == 0, "search").when(F.col("w") % 3 == 1, "measure").otherwise("flag").alias("name"), arguments.alias("arguments"),
        F.when(need.isNotNull(), F.array(F.concat(F.lit("c"), need))).alias("needs"),
    )


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages, calls and results of all conversations, linked, ordered and serialised.

    A user's turn is the result of the call of the turn before; where that was no assistant's turn it is an orphan.
    """
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    schemas = spark.createDataFrame(list(SCHEMAS), "name string, param string, kind string, required boolean")
    results = conversations.where("role = 'user' and turn > 0").select("conv_id", F.concat(F.lit("c"), F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return link(conversations, calls_of(conversations), results, schemas)
