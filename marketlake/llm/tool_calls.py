"""Tool-call linking and canonical JSON, with DataFrame functions only.

Calls and results meet in a hash join on (conversation, call id). Arguments are
parsed as variants, whose objects keep their keys in order, so that `to_json` of
a variant is canonical: keys sorted at every depth, no white space. They are
checked against the schema of the tool: required names, types, unknown names.
Calls are ordered topologically by what they depend on: a call's level is one
more than the highest level of its parents. Where every parent stands before
its child (the rule in logs), positions are such an order and no iteration is
needed; the other conversations are peeled level by level, each round joining
only the calls that became free: as many rounds as the longest chain of such a
conversation has calls. Ranks are counted in runs of positions and parents that
many calls name are met where they are read, so that a conversation of any
length is spread over tasks.

Defined results: calls without id link with nothing; of calls that repeat an id
in a conversation the first by position stands, of one position the first by
name and arguments, and the others are "duplicate"; of several results the first
by position counts, of one position the least content; a call does not wait for
itself or for a parent that does not exist; calls on a cycle and all behind them
have no level and come last; null or malformed arguments are invalid and stand
as null; other columns are not read; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT, frozen, join_hot, text_or_empty

#: tool -> argument -> (type, required); types as `schema_of_variant` names them.
Schemas = dict[str, dict[str, tuple[str, bool]]]
_KINDS = {"string": r"^STRING$", "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$", "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$",
    "boolean": r"^BOOLEAN$", "array": r"^ARRAY<.*$", "object": r"^OBJECT<.*$"}


def argument_errors(tool: Column, args: Column, schemas: Schemas) -> Column:
    """Sorted names of what is wrong, empty where the arguments satisfy the tool's schema."""
    keys = F.map_keys(args.cast("map<string,variant>"))
    is_object = F.schema_of_variant(args).startswith("OBJECT<")
    out = F.array(F.lit("tool:unknown"))
    for name, fields in schemas.items():
        checks = []
        for field, (kind, required) in sorted(fields.items()):
            value = F.try_variant_get(args, f"$.{field}", "variant")
            missing = value.isNull() | F.is_variant_null(value)
            wrong = ~F.schema_of_variant(value).rlike(_KINDS[kind])
            checks.append(F.when(missing, F.lit(f"{field}:missing") if required else None).when(wrong, F.lit(f"{field}:type")))
        extra = F.transform(F.array_except(keys, F.array(*map(F.lit, fields))), lambda k: F.concat(k, F.lit(":unknown")))
        found = F.sort_array(F.concat(F.array_compact(F.array(*checks)), F.coalesce(extra, F.array().cast("array<string>"))))
        out = F.when(tool == name, found).otherwise(out)
    return F.when(args.isNull(), F.array(F.lit("arguments:malformed"))).when(~is_object,
        F.array(F.lit("arguments:not an object"))).otherwise(out)


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of conversations where a parent stands after its child, level -1 where a cycle is in the way; peeled round by round."""
    parent = ["conv_id", "parent_id"]
    odd = frozen(edges.filter("parent_position >= position").select("conv_id").distinct())
    if odd.isEmpty():
        return odd.select("conv_id", F.lit("").alias("call_id"), F.lit(0).alias("level")).limit(0)
    edges = frozen(join_hot(edges, odd, "conv_id").select("conv_id", "call_id", "parent_id").distinct())
    nodes = frozen(join_hot(calls, odd, "conv_id").select("conv_id", "call_id"))
    hubs = F.broadcast(frozen(edges.groupBy(*parent).agg(F.count("*").alias("n")).filter(F.col("n") > max(1,
        edges.count() // HOT)).select(*parent)))  # fewer than HOT rows
    at_hubs, rest = edges.join(hubs, parent, "left_semi"), edges.join(hubs, parent, "left_anti")
    waits = edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("need"))
    free = frozen(nodes.join(waits, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0)))
    waiting = frozen(waits.withColumn("have", F.lit(0).cast("long")))
    done, level = free, 0
    while not free.isEmpty():
        level += 1
        named = free.select("conv_id", F.col("call_id").alias("parent_id"))
        met = at_hubs.join(F.broadcast(named.join(hubs, parent, "left_semi")),
            parent).unionByName(rest.join(named, parent)).groupBy("conv_id", "call_id").agg(F.count("*").alias("more"))
        waiting = frozen(waiting.join(met, ["conv_id", "call_id"], "left").select("conv_id", "call_id", "need",
            (F.col("have") + F.coalesce("more", F.lit(0))).alias("have")))
        free = waiting.filter("have = need").select("conv_id", "call_id", F.lit(level).alias("level"))
        waiting = waiting.filter("have < need")
        done = frozen(done.union(free))
        free = done.filter(F.col("level") == level)
    return nodes.join(done, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.coalesce("level", F.lit(-1)).alias("level"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Schemas, run_length: int = 512) -> DataFrame:
    """One row per call, with its place in the topological order, its result, argument errors and canonical JSON.

    calls: conv_id, call_id, name, arguments (JSON text), position, depends_on (array of call ids).
    results: conv_id, call_id, content, position.
    """
    key = ["conv_id", "call_id"]
    ranked = frozen(calls.select("conv_id", "call_id", "name", "arguments", F.col("position").cast("long").alias("position"), "depends_on",
        F.monotonically_increasing_id().alias("__row")))
    named = ranked.filter("call_id IS NOT NULL")
    order = F.struct(F.col("position").isNull().alias("none"), "position", "name", "arguments", "__row")
    first = named.groupBy(*key).agg(F.min(order).alias("f")).select(*key, F.col("f.position").alias("first_position"),
        F.col("f.__row").alias("first_row"))
    answers = results.filter("call_id IS NOT NULL").groupBy(*key).agg(F.min(F.struct(F.col("position").isNull(), "position",
        "content")).alias("r"), F.count("*").alias("n_results"))
    answers = answers.select(*key, F.col("r.content").alias("content"), F.col("r.position").alias("result_position"), "n_results")
    edges = frozen(named.select("conv_id", "call_id", "position",
        F.explode(F.array_distinct("depends_on")).alias("parent_id")).filter("parent_id <> call_id").withColumn("__parent",
        F.struct("conv_id", "parent_id")))
    edges = frozen(join_hot(edges,
        first.select(F.struct("conv_id", F.col("call_id").alias("parent_id")).alias("__parent"),
        F.col("first_position").alias("parent_position")), "__parent").drop("__parent"))
    parents = edges.groupBy(*key).agg(F.countDistinct("parent_id").alias("n_parents"))
    level = levels(frozen(named.select(*key).distinct()), edges)
    rows = named.join(first, key, "left").join(answers, key, "left").join(parents, key, "left").join(level, key, "left")
    rows = rows.unionByName(ranked.filter("call_id IS NULL"), allowMissingColumns=True)  # calls without id meet nothing
    stuck = F.coalesce(F.col("level") == -1, F.lit(False))
    rows = rows.withColumn("__level", F.when(stuck, 2**31 - 1).otherwise(F.coalesce("level", F.lit(0))))
    # rank = calls in earlier runs + rank inside the run; calls without position come first, in runs by row
    rows = rows.withColumn("__run", F.coalesce(F.floor(F.col("position") / run_length), -1 - F.pmod(F.xxhash64("__row"), F.lit(64))))
    runs = rows.groupBy("conv_id", "__level", "__run").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("conv_id").orderBy("__level", "__run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("conv_id").alias("r_conv"), F.col("__level").alias("r_level"), F.col("__run").alias("r_run"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("conv_id", "__level", "__run").orderBy("position", "call_id", "name", "arguments", "__row")
    rows = rows.withColumn("__rank", F.row_number().over(inside)).join(runs,
        F.col("conv_id").eqNullSafe(F.col("r_conv")) & (F.col("__level") == F.col("r_level")) & F.col("__run").eqNullSafe(F.col("r_run")))
    args = F.try_parse_json("arguments")
    rows = rows.withColumn("__args", args)
    errors = argument_errors(F.col("name"), F.col("__args"), schemas)
    status = F.when(F.col("call_id").isNull(), "no id").when(F.col("__row") != F.col("first_row"), "duplicate").when(stuck,
        "cycle").when(F.col("n_results").isNull(), "unanswered").when(F.col("result_position") < F.col("position"),
        "answered before call").otherwise("answered")
    canonical = F.to_json(F.struct(F.col("__args").alias("arguments"), F.col("call_id").alias("id"), F.col("name"),
        F.col("content").alias("result")), {"ignoreNullFields": "false"})
    return rows.select(
        "conv_id", "call_id", "name", "position", (F.col("__before") + F.col("__rank") - 1).cast("long").alias("topo_order"),
        F.coalesce("n_parents", F.lit(0)).cast("long").alias("n_parents"), status.alias("status"),
            F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        errors.alias("errors"), canonical.alias("canonical_json"),
    )


#: The tools that `turns_as_calls` speaks of.
TURN_TOOLS: Schemas = {
    "answer": {"query": ("string", True), "turn": ("integer", True)},
    "system_prompt": {"query": ("string", True), "turn": ("integer", True), "pinned": ("boolean", False)},
}


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversation turns in the form of calls and results, with the faults that logs have.

    A turn that is not an assistant's is a call, to `system_prompt` for the system and `answer` for others, with its text
    and number as arguments; the assistant's turn after it is its result. System prompts are pinned. A text of several
    lines brings an argument that the schema does not know, a short one (below 60 characters) its number as text, an
    empty one no query. A short turn repeats the id of the call two turns before. A call depends on those of turns 0
    and half its own, where there are such, and in turns 4 and 5 of every eight on the call that follows.
    """
    call = lambda turn: F.concat_ws("-", F.lit("call"), F.col("conv_id"), turn)
    turn, role = F.col("turn").cast("long"), F.coalesce("role", F.lit("user"))
    rows = conversations.select("conv_id", turn.alias("turn"), role.alias("role"), text_or_empty("text").alias("text"))
    short = F.length("text") < 60
    known = F.when(F.col("turn").isNotNull(), call(F.col("turn") - F.when(short & (F.col("turn") >= 2), 2).otherwise(0)))
    asked = rows.filter("role <> 'assistant'").withColumn("call_id", known)
    system = F.col("role") == "system"
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    fields = {
        "lines": F.when(lines > 1, lines.cast("string")), "pinned": F.when(system, "true"),
        "query": F.when(F.col("text") != "",
            F.to_json(F.struct(F.col("text").alias("t"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("text").alias("t")))) - 6)),
        "turn": F.when(short, F.concat(F.lit('"'), F.col("turn"), F.lit('"'))).otherwise(F.col("turn").cast("string")),
    }
    args = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in fields.items()]), F.lit("}"))
    half = F.floor(F.col("turn") / 2)
    later = F.when((F.col("turn") % 8).isin(4, 5), call(F.col("turn") + 2))
    depends = F.array_compact(F.array(call(F.lit(0)), call(half), later))
    calls = asked.select("conv_id", "call_id", F.when(system, "system_prompt").otherwise("answer").alias("name"), args.alias("arguments"),
        F.col("turn").alias("position"), depends.alias("depends_on"))
    replies = rows.filter("role = 'assistant'").select(F.col("conv_id").alias("r_conv"), F.col("turn").alias("r_turn"),
        F.col("text").alias("content"))
    results = replies.join(asked.select("conv_id", "turn", "call_id"),
        (F.col("r_conv") == F.col("conv_id")) & (F.col("r_turn") == F.col("turn") + 1))
    return calls, results.select("conv_id", "call_id", "content", F.col("r_turn").alias("position"))
