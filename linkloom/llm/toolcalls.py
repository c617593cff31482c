"""Tool-call linking for chat data (DataFrame functions only).

Messages are (conv_id, turn, role, text).  An assistant message that calls tools
holds ``{"tool_calls": [{"id", "name", "arguments", "after"}]}``: arguments is an
object or a string with one, ``after`` names the call whose result it consumes.
A tool message holds ``{"tool_call_id", "content"}``.  Calls and results meet in
a hash join on (conversation, call id); calls are levelled along ``after`` by
pointer doubling, so a chain of n calls takes log2(n) joins and no conversation
is ever gathered in one task; arguments are checked against the schema of their
tool; every event is serialised as canonical JSON (keys sorted, no white space).

Defined results: text that is null, empty or no JSON object makes no event; a
call without id is an event that nothing links to; repeated call ids link to the
first call (smallest turn, then place in its list), later ones are marked
``duplicate``; a result whose call is missing is an ``orphan``; a call without a
result is ``unanswered``; calls on a cycle, or behind one, have level null;
unknown tools and bad arguments are errors, never dropped rows.  Repeated rows
are repeated events.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import stage

#: JSON type name -> pattern of the variant types that satisfy it
JSON_TYPES = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DECIMAL.*|DOUBLE|FLOAT)",
              "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*"}


def canonical_json(c):
    """Variant -> JSON text with sorted keys and no white space."""
    return F.to_json(c)


def argument_errors(name, args, schemas: dict):
    """Array of error strings of one call.

    schemas: {tool: {field: (json type, required)}}; a few dozen tools, so they
    are literals of the plan."""
    known = F.when(args.isNull(), F.array(F.lit("arguments: not an object")))
    for tool, fields in sorted(schemas.items()):
        checks = []
        for field, (kind, required) in sorted(fields.items()):
            got = F.schema_of_variant(F.try_variant_get(args, f"$.{field}", "variant"))
            present = F.array_contains(F.json_object_keys(F.to_json(args)), field)
            bad = F.when(present & ~F.coalesce(got.rlike(f"^{JSON_TYPES[kind]}$"), F.lit(False)),
                         F.lit(f"{field}: not {kind}"))
            if required:
                bad = F.when(~present, F.lit(f"{field}: missing")).otherwise(bad)
            checks.append(bad)
        extra = F.transform(F.array_sort(F.array_except(F.json_object_keys(F.to_json(args)),
                                                        F.array(*[F.lit(f) for f in sorted(fields)]))),
                            lambda k: F.concat(k, F.lit(": unknown")))
        errors = F.concat(F.array_compact(F.array(*checks)), extra)
        known = known.when(name == tool, errors)
    return known.otherwise(F.array(F.lit("unknown tool")))


def call_events(messages: DataFrame, schemas: dict) -> DataFrame:
    """One row a call: conv_id, turn, place, call_id, name, after, arguments, errors."""
    v = (messages.where((F.col("role") == "assistant") & F.col("text").contains("tool_calls"))
         .select("conv_id", "turn", F.try_parse_json("text").alias("v"))
         .select("conv_id", "turn", F.posexplode(F.try_variant_get("v", "$.tool_calls", "array<variant>"))
                 .alias("place", "c")))
    raw = F.try_variant_get("c", "$.arguments", "variant")
    args = F.when(F.schema_of_variant(raw) == "STRING",
                  F.try_parse_json(F.try_variant_get("c", "$.arguments", "string"))).otherwise(raw)
    x = v.select("conv_id", "turn", "place", F.try_variant_get("c", "$.id", "string").alias("call_id"),
                 F.try_variant_get("c", "$.name", "string").alias("name"),
                 F.try_variant_get("c", "$.after", "string").alias("after"), args.alias("a"))
    obj = F.when(F.schema_of_variant("a").startswith("OBJECT"), F.col("a"))
    x = x.withColumn("a", obj)
    return x.select("conv_id", "turn", "place", "call_id", "name", "after", canonical_json("a").alias("arguments"),
                    argument_errors(F.col("name"), F.col("a"), schemas).alias("errors"))


def result_events(messages: DataFrame) -> DataFrame:
    """One row a result: conv_id, turn, call_id, content (canonical JSON)."""
    return (messages.where((F.col("role") == "tool") & F.col("text").contains("tool_call_id"))
            .select("conv_id", "turn", F.try_parse_json("text").alias("v")).where("v is not null")
            .select("conv_id", "turn", F.try_variant_get("v", "$.tool_call_id", "string").alias("call_id"),
                    canonical_json(F.try_variant_get("v", "$.content", "variant")).alias("content")))


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): calls on the way back along ``after``; null on a cycle.

    ``calls`` has one row a (conv_id, call_id).  Pointer doubling: each round
    halves the way that is left and is a written table."""
    ids = calls.select("conv_id", F.col("call_id").alias("p")).withColumn("there", F.lit(True))
    cur = (calls.select("conv_id", "call_id", F.col("after").alias("p")).join(ids, ["conv_id", "p"], "left")
           .select("conv_id", "call_id", F.when(F.col("there"), F.col("p")).alias("p"),
                   F.when(F.col("there"), 1).otherwise(0).cast("long").alias("level")))
    cur = stage(cur, "levels")
    open_, n = cur.select(F.count("p"), F.count(F.lit(1))).first()
    rounds = 0
    while open_ and 2 ** rounds <= 2 * n:
        up = cur.select("conv_id", F.col("call_id").alias("p"), F.col("p").alias("pp"), F.col("level").alias("pl"))
        cur = stage(cur.join(up, ["conv_id", "p"], "left")
                    .select("conv_id", "call_id", F.col("pp").alias("p"),
                            (F.col("level") + F.coalesce("pl", F.lit(0))).alias("level")), "levels")
        open_ = cur.select(F.count("p")).first()[0]
        rounds += 1
    return cur.select("conv_id", "call_id", F.when(F.col("p").isNull(), F.col("level")).alias("level"))


def link_tool_calls(messages: DataFrame, schemas: dict) -> DataFrame:
    """One row an event: conv_id, turn, place, kind (call or result), call_id,
    name, status, topo_level, errors, valid, other_turn, canonical.

    topo_level orders the events of a conversation: a call comes before its
    result, a result before the calls that consume it; ties follow turn and place."""
    messages = messages.select("conv_id", "turn", "role", "text")
    calls = call_events(messages, schemas)
    results = result_events(messages)
    first = calls.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(
        F.min(F.struct("turn", "place", "name", "after")).alias("f"))
    first = first.select("conv_id", "call_id", F.col("f.turn").alias("call_turn"), F.col("f.place").alias("call_place"),
                         F.col("f.name").alias("call_name"), F.col("f.after").alias("after"))
    first = stage(first, "first-calls")
    first = first.join(levels(first), ["conv_id", "call_id"])
    answered = results.groupBy("conv_id", "call_id").agg(F.min("turn").alias("answer_turn"))
    key = ["conv_id", "call_id"]
    out_calls = calls.join(first.join(answered, key, "left").select(
        *key, "call_turn", "call_place", "level", "answer_turn"), key, "left")
    is_first = (F.col("turn").eqNullSafe(F.col("call_turn"))) & (F.col("place") == F.col("call_place"))
    out_calls = out_calls.select(
        "conv_id", "turn", "place", F.lit("call").alias("kind"), "call_id", "name",
        F.when(F.col("call_id").isNull(), "unnamed").when(~F.coalesce(is_first, F.lit(False)), "duplicate")
        .when(F.col("answer_turn").isNull(), "unanswered").otherwise("linked").alias("status"),
        (2 * F.col("level")).alias("topo_level"), "errors", (F.size("errors") == 0).alias("valid"),
        F.col("answer_turn").alias("other_turn"),
        F.concat(F.lit('{"arguments":'), F.coalesce("arguments", F.lit("null")), F.lit(',"id":'),
                 _json_string(F.col("call_id")), F.lit(',"name":'), _json_string(F.col("name")),
                 F.lit(',"type":"call"}')).alias("canonical"))
    out_results = results.join(first.select(*key, "call_turn", "call_name", "level"), key, "left").select(
        "conv_id", "turn", F.lit(0).alias("place"), F.lit("result").alias("kind"), "call_id",
        F.col("call_name").alias("name"),
        F.when(F.col("call_turn").isNull(), "orphan").when(F.col("turn") < F.col("call_turn"), "early")
        .otherwise("linked").alias("status"),
        (2 * F.col("level") + 1).alias("topo_level"), F.array().cast("array<string>").alias("errors"),
        F.col("call_turn").isNotNull().alias("valid"), F.col("call_turn").alias("other_turn"),
        F.concat(F.lit('{"content":'), F.coalesce("content", F.lit("null")), F.lit(',"id":'),
                 _json_string(F.col("call_id")), F.lit(',"type":"result"}')).alias("canonical"))
    return out_calls.unionByName(out_results)


def _json_string(c):
    """JSON text of a string column (null: null)."""
    return F.when(c.isNull(), "null").otherwise(
        F.regexp_replace(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":|\}$', ""))
