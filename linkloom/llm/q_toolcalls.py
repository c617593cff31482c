"""op8: tool traffic derived from the whole of `conversations`, linked and serialised.

The table has no tool messages, so each assistant turn becomes a call (arguments:
its text and size, chained to the conversation's previous assistant turn) and the
result of that call one half-turn later.  Some rows carry the faults the operator
must report: sizes as strings, results of calls that nobody made.
"""

from pyspark.sql import functions as F

from linkloom.llm.common import table
from linkloom.llm.registry import register
from linkloom.llm.toolcalls import link_tool_calls

SCHEMAS = {"reply": {"text": ("string", True), "size": ("integer", True)},
           "lookup": {"text": ("string", True), "size": ("integer", False), "note": ("string", False)}}

SQL = r"""
WITH RECURSIVE a AS (SELECT conv_id, turn, text, length(text) AS n, 'c' || conv_id || '-' || turn AS id,
                  CASE WHEN turn % 4 = 1 THEN 'reply' WHEN turn % 4 = 3 THEN 'lookup' ELSE 'draw' END AS name
           FROM conversations WHERE role = 'assistant'),
chain AS (SELECT conv_id, turn, 0 AS d FROM a x WHERE NOT EXISTS
            (SELECT 1 FROM a y WHERE y.conv_id = x.conv_id AND y.turn = x.turn - 2)
          UNION ALL SELECT x.conv_id, x.turn, c.d + 1 FROM chain c JOIN a x ON x.conv_id = c.conv_id AND x.turn = c.turn + 2),
lv AS (SELECT a.*, d, (conv_id + turn) % 7 <> 0 AS ok, turn % 5 = 3 AS bad_size FROM a JOIN chain USING (conv_id, turn)),
calls AS (SELECT conv_id, 2 * turn AS turn, 'call' AS kind, id AS call_id, name,
                 CASE WHEN ok THEN 'linked' ELSE 'unanswered' END AS status, 2 * d AS topo_level,
                 CASE WHEN name = 'draw' THEN 'unknown tool' WHEN bad_size THEN 'size: not integer' ELSE '' END AS errors,
                 CASE WHEN ok THEN 2 * turn + 1 END AS other_turn,
                 '{"arguments":{"size":' || CASE WHEN bad_size THEN '"' || n || '"' ELSE n::VARCHAR END || ',"text":'
                 || to_json(text) || '},"id":"' || id || '","name":"' || name || '","type":"call"}' AS canonical FROM lv),
results AS (SELECT conv_id, 2 * turn + 1 AS turn, 'result' AS kind, id || CASE WHEN ok THEN '' ELSE '?' END AS call_id,
                   CASE WHEN ok THEN name END AS name, CASE WHEN ok THEN 'linked' ELSE 'orphan' END AS status,
                   CASE WHEN ok THEN 2 * d + 1 END AS topo_level, '' AS errors, CASE WHEN ok THEN 2 * turn END AS other_turn,
                   '{"content":' || to_json(text) || ',"id":"' || id || CASE WHEN ok THEN '' ELSE '?' END
                   || '","type":"result"}' AS canonical FROM lv)
SELECT conv_id, turn, kind, call_id, name, status, topo_level, errors, other_turn, md5(canonical) AS canonical_md5
FROM (SELECT * FROM calls UNION ALL SELECT * FROM results)
"""


def tool_messages(conversations):
    """Tool messages of the assistant turns, as JSON texts."""
    c = conversations.where("role = 'assistant' and conv_id is not null and turn is not null")
    call_id = F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn"))
    before = F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn") - 2)
    name = F.when(F.col("turn") % 4 == 1, "reply").when(F.col("turn") % 4 == 3, "lookup").otherwise("draw")
    size = F.length(F.coalesce("text", F.lit("")))
    quoted = F.col("turn") % 5 == 3
    body = F.coalesce("text", F.lit(""))
    args = F.when(quoted, F.to_json(F.struct(body.alias("text"), size.cast("string").alias("size")))).otherwise(
        F.to_json(F.struct(body.alias("text"), size.alias("size"))))
    call = F.to_json(F.struct(F.array(F.struct(call_id.alias("id"), name.alias("name"), args.alias("arguments"),
                                               before.alias("after"))).alias("tool_calls")))
    kept = (F.col("conv_id") + F.col("turn")) % 7 != 0
    result = F.to_json(F.struct(F.when(kept, call_id).otherwise(F.concat(call_id, F.lit("?"))).alias("tool_call_id"),
                                body.alias("content")))
    return c.select("conv_id", "turn", F.explode(F.array(
        F.struct((2 * F.col("turn")).alias("t"), F.lit("assistant").alias("role"), call.alias("text")),
        F.struct((2 * F.col("turn") + 1).alias("t"), F.lit("tool").alias("role"), result.alias("text")))).alias("m")) \
        .select("conv_id", F.col("m.t").alias("turn"), "m.role", "m.text")


@register("op8_tool_calls", SQL)
def op8_tool_calls(spark, sf_dir):
    out = link_tool_calls(tool_messages(table(spark, sf_dir, "conversations")), SCHEMAS)
    return out.select("conv_id", "turn", "kind", "call_id", "name", "status", "topo_level",
                      F.array_join("errors", "; ").alias("errors"), "other_turn",
                      F.md5(F.col("canonical")).alias("canonical_md5"))
