"""Chat formatting: tool calls linked with their results, ordered, validated and written as canonical JSON.

Calls and results are tables keyed by conversation and call identifier and meet in one hash join on both, so a
conversation of any length is spread by its identifiers. A call may depend on others; its stage is the longest chain of
dependencies below it. In every round, calls whose dependencies all have levels get theirs, and a dependency on a call
that has just one itself jumps over it, so that a chain of n calls takes log n rounds.
Arguments are checked against schemas with the variant type, whose objects also print with sorted keys: that is the
canonical JSON. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import small, written


def canonical(json: Column) -> Column:
    """JSON with sorted keys and no spaces, at every depth; null for what isn't JSON."""
    return F.to_json(F.try_parse_json(json))


def tool_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results in messages (conv_id, turn, role, text) whose texts are the usual JSON.

    An assistant's {"tool_calls": [{"id", "name", "arguments", "depends_on": [ids]}]} makes calls, a tool's
    {"tool_call_id", "content"} a result. Other texts make neither.
    """
    body = messages.select("conv_id", "turn", "role", F.when(F.startswith(F.ltrim("text"), F.lit("{")), F.try_parse_json("text")).alias("v"))
    listed = body.where("role = 'assistant'").select("conv_id", "turn", F.posexplode(F.try_variant_get("v", "$.tool_calls", "array<variant>")).alias("idx", "c"))
    calls = listed.select(
        "conv_id",
        F.try_variant_get("c", "$.id", "string").alias("call_id"),
        "turn",
        "idx",
        F.try_variant_get("c", "$.name", "string").alias("name"),
        F.coalesce(F.try_variant_get("c", "$.arguments", "string"), F.to_json(F.try_variant_get("c", "$.arguments", "variant"))).alias("arguments"),
        F.coalesce(F.try_variant_get("c", "$.depends_on", "array<string>"), F.array().cast("array<string>")).alias("depends_on"),
    )
    results = body.where("role = 'tool'").select("conv_id", F.try_variant_get("v", "$.tool_call_id", "string").alias("call_id"), "turn", F.coalesce(F.try_variant_get("v", "$.content", "string"), F.to_json(F.try_variant_get("v", "$.content", "variant"))).alias("content"))
    return calls, results.where("call_id is not null")


def turns_as_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each user turn as a call of the tool ``reply`` that the next turn answers, depending on the user turn before it."""
    key = lambda turn: F.concat_ws("-", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), turn.cast("string"))
    turn = F.coalesce("turn", F.lit(-1)).cast("long")
    m = messages.select("conv_id", turn.alias("turn"), "role", "text")
    text = F.coalesce("text", F.lit(""))
    calls = m.where("role = 'user'").select(
        "conv_id", key(F.col("turn")).alias("call_id"), "turn", F.lit(0).alias("idx"), F.lit("reply").alias("name"),
        F.to_json(F.struct(F.col("turn").alias("turn"), text.alias("prompt"))).alias("arguments"),
        F.when(F.col("turn") >= 2, F.array(key(F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )
    results = m.where("role = 'assistant'").select("conv_id", key(F.col("turn") - 1).alias("call_id"), "turn", text.alias("content"))
    return calls, results


def schema_table(spark: SparkSession, tools: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """(name, params): {tool: {parameter: (type, required)}}; types are string, integer, number, boolean, array or object."""
    rows = [(name, {p: {"type": t, "required": r} for p, (t, r) in params.items()}) for name, params in tools.items()]
    return spark.createDataFrame(rows, "name string, params map<string,struct<type:string,required:boolean>>")


def _fits(value: Column, wanted: Column) -> Column:
    kind = F.schema_of_variant(value)
    whole, number = kind == "BIGINT", kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return (
        F.when(wanted == "string", kind == "STRING").when(wanted == "integer", whole).when(wanted == "number", number)
        .when(wanted == "boolean", kind == "BOOLEAN").when(wanted == "array", kind.startswith("ARRAY")).when(wanted == "object", kind.startswith("OBJECT"))
        .otherwise(F.lit(False))
    )


def problem(arguments: Column, params: Column) -> Column:
    """What is wrong with JSON arguments under a tool's parameters; null if nothing is."""
    given = F.from_json(arguments, "map<string,variant>")
    names = F.map_keys(params)
    missing = F.filter(names, lambda p: F.element_at(params, p)["required"] & ~F.map_contains_key(given, p))
    unknown = F.filter(F.map_keys(given), lambda p: ~F.map_contains_key(params, p))
    wrong = F.filter(F.map_keys(given), lambda p: F.map_contains_key(params, p) & ~F.coalesce(_fits(F.element_at(given, p), F.element_at(params, p)["type"]), F.lit(False)))
    text = lambda what, which: F.concat(F.lit(f"{what}: "), F.array_join(F.array_sort(which), ", "))
    return (
        F.when(params.isNull(), F.lit("unknown tool"))
        .when(F.try_parse_json(arguments).isNull() | given.isNull(), F.lit("not a JSON object"))
        .when(F.size(missing) > 0, text("missing", missing)).when(F.size(unknown) > 0, text("unknown", unknown)).when(F.size(wrong) > 0, text("wrong type", wrong))
    )


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): the longest chain of dependencies below each call; calls on a cycle, or behind one, get none.

    ``edges`` has conv_id, call_id and needs, both of them calls.
    """
    key = ["conv_id", "call_id"]
    found = None
    # base: what the level is at least; weight: how many levels a dependency, which may have jumped, stands for
    left = written(calls.select(*key, F.lit(0).alias("base")).distinct(), "open")
    edges = written(edges.select(*key, "needs", F.lit(1).alias("weight")).distinct(), "edges")
    while True:
        bound = written(edges.select(*key).distinct(), "bound")
        free = written(left.join(bound, key, "left_anti").withColumnRenamed("base", "level"), "free")
        if free.isEmpty():
            return free if found is None else found
        found = free if found is None else written(found.unionByName(free), "levels")
        below = free.select("conv_id", F.col("call_id").alias("needs"), "level")
        with_level = written(edges.join(below, ["conv_id", "needs"], "left"), "edges-levels")
        still = with_level.where("level is null").drop("level")
        single = still.groupBy(*key).agg(F.count("*").alias("n"), F.min("needs").alias("next"), F.min("weight").alias("more")).where("n = 1")
        raised = with_level.where("level is not null").groupBy(*key).agg(F.max(F.col("level") + F.col("weight")).alias("raised"))
        left = written(left.join(bound, key, "left_semi").join(raised, key, "left").select(*key, F.greatest("base", F.coalesce("raised", F.lit(0))).alias("base")), "open")
        hop = written(single.join(left, key).select("conv_id", F.col("call_id").alias("needs"), "next", "more", F.col("base").alias("over")), "hops")
        jumped = written(still.join(hop, ["conv_id", "needs"], "left"), "jumped")
        passed = jumped.where("next is not null").groupBy(*key).agg(F.max(F.col("over") + F.col("weight")).alias("raised"))
        left = written(left.join(passed, key, "left").select(*key, F.greatest("base", F.coalesce("raised", F.lit(0))).alias("base")), "open")
        ahead = jumped.select(*key, F.coalesce("next", "needs").alias("needs"), (F.col("weight") + F.coalesce("more", F.lit(0))).alias("weight"))
        edges = written(ahead.groupBy(*key, "needs").agg(F.max("weight").alias("weight")), "edges")


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row for each call identifier of a conversation, its result linked to it.

    ``calls``: conv_id, call_id, turn, idx, name, arguments (JSON), depends_on (ids of the same conversation);
    ``results``: conv_id, call_id, turn, content; ``schemas``: see ``schema_table``. Columns beyond those are not read.

    Returns conv_id, call_id, turn, stage (the longest chain of dependencies below the call, those aside that the
    conversation lacks; null on a cycle, behind one and for orphans; calls sorted by conv_id, stage, turn, idx are in
    topological order), idx, name, status, problem (what the schema finds wrong, null if nothing), n_results and json. Status is linked;
    unanswered (no result); orphan (a result without a call; turn, idx and name are null); early (its result stands before
    it); unresolved (it depends on an id that the conversation lacks) or cycle, the last two before the others. Of calls
    or results that repeat an id the first by turn counts, of equal ones the one with the smaller text. A null id is an id
    of its own, '' ; a null conv_id is a conversation of its own, -1. Without calls and results the result is empty.
    """
    conv, call = F.coalesce(F.col("conv_id").cast("long"), F.lit(-1)).alias("conv_id"), F.coalesce("call_id", F.lit("")).alias("call_id")
    turn = F.coalesce("turn", F.lit(-1)).cast("long").alias("turn")
    first = calls.select(conv, call, F.struct(turn, F.col("idx").cast("long").alias("idx"), "arguments", "name", "depends_on").alias("c")).groupBy("conv_id", "call_id").agg(F.min("c").alias("c"))
    answers = results.select(conv, call, F.struct(turn, "content").alias("r")).groupBy("conv_id", "call_id").agg(F.min("r").alias("r"), F.count("*").alias("n_results"))
    flat = written(first.select("conv_id", "call_id", "c.*"), "calls")

    needs = flat.select("conv_id", "call_id", F.explode(F.array_distinct("depends_on")).alias("needs"))
    there = flat.select("conv_id", F.col("call_id").alias("needs"), F.lit(True).alias("there"))
    edges = written(needs.join(there, ["conv_id", "needs"], "left"), "needs")
    unresolved = edges.where("there is null").select("conv_id", "call_id").distinct().withColumn("unresolved", F.lit(True))
    found = levels(flat, edges.where("there").select("conv_id", "call_id", "needs"))
    ordered = flat.join(unresolved, ["conv_id", "call_id"], "left").join(found.withColumn("stage", F.col("level").cast("long")).drop("level"), ["conv_id", "call_id"], "left")

    tools = small(written(schemas, "schemas"))
    checked = ordered.join(tools, "name", "left").withColumn("problem", problem(F.col("arguments"), F.col("params"))).drop("params")
    both = checked.join(answers.hint("shuffle_hash"), ["conv_id", "call_id"], "full")
    status = (
        F.when(F.col("idx").isNull(), "orphan").when(F.col("unresolved"), "unresolved").when(F.col("stage").isNull(), "cycle")
        .when(F.col("r").isNull(), "unanswered").when(F.col("r.turn") < F.col("turn"), "early").otherwise("linked")
    )
    shown = F.struct(
        F.coalesce(F.try_parse_json("arguments"), F.try_parse_json(F.to_json(F.struct(F.col("arguments").alias("text"))))).alias("arguments"),
        F.col("conv_id").alias("conversation"), F.col("call_id").alias("id"), F.col("name").alias("name"),
        F.col("r.content").alias("result"), status.alias("status"),
    )
    return both.select("conv_id", "call_id", F.coalesce("turn", "r.turn").alias("turn"), "stage", "idx", "name", status.alias("status"), "problem", F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), F.to_json(shown).alias("json"))
