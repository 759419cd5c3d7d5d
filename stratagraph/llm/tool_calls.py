"""Chat formatting: tool calls linked to their results, ordered, validated and serialised; DataFrame functions only.

Calls and results meet in a hash join on the call's identifier. A call may need the results of other calls; its level is
one more than the highest level it needs, found in rounds that each join the calls still open to the levels known (as
many rounds as the longest chain). Ordering a conversation by (level, turn, call_id), with each result after its call,
is then topological. Arguments are parsed as variants and held against the tool's schema, and both arguments and records
are written as canonical JSON: keys sorted, no white space, whole numbers plain.

Edge cases: of several results for one call the earliest counts, then the smallest text; calls with one identifier share
its results, and each keeps its row; a call without a result is unlinked and has no result in its record; a call that
needs itself, a cycle or an unknown call has no level and comes last; null identifiers never link; null or malformed
arguments, missing required, unknown or wrongly typed fields are invalid; empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Tool -> field -> (type as schema_of_variant names it, required).
Schemas = dict[str, dict[str, tuple[str, bool]]]
REPLY: Schemas = {"reply": {"conv": ("BIGINT", True), "text": ("STRING", True), "turn": ("BIGINT", True)}}


def valid(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Whether the arguments fit the schema of the named tool; never null."""
    parsed = F.try_parse_json(arguments)
    out = F.lit(False)
    for tool, fields in schemas.items():
        fits = F.schema_of_variant(parsed).startswith("OBJECT") & F.forall(F.json_object_keys(arguments), lambda k: k.isin(*fields))
        for field, (kind, required) in fields.items():
            got = F.schema_of_variant(F.try_variant_get(parsed, f"$.{field}", "variant"))
            fits = fits & ((got == kind) if required else F.coalesce((got == kind) | (got == "VOID"), F.lit(True)))
        out = F.when(name == tool, fits).otherwise(out)
    return F.coalesce(out, F.lit(False))


def canonical(arguments: Column) -> Column:
    """A JSON text with sorted keys and no white space; null if it doesn't parse."""
    return F.to_json(F.try_parse_json(arguments))


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, level) of the distinct calls (call_id, needs) that can be ordered; 1 needs nothing.

    An identifier that several rows carry needs what any of them needs."""
    calls = calls.where("call_id is not null")
    needs = cut(calls.select("call_id", F.explode("needs").alias("need")).where("need is not null").distinct())
    done = calls.select("call_id").distinct().join(needs, "call_id", "left_anti").withColumn("level", F.lit(1))
    done = cut(done)
    open_ = needs
    for level in itertools.count(2):
        if not open_.take(1):
            break
        # A call is ready once none of its needs is outside of what is done.
        waiting = open_.join(done.select(F.col("call_id").alias("need")), "need", "left_anti").select("call_id").distinct()
        ready = cut(open_.select("call_id").distinct().join(waiting, "call_id", "left_anti").withColumn("level", F.lit(level)))
        if not ready.take(1):
            break
        done = done.union(ready)
        if level % 16 == 0:
            done = cut(done)
        open_ = cut(open_.join(ready, "call_id", "left_anti"))
    return done


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row for each call: conv_id, turn, call_id, level, linked, valid, record.

    calls: conv_id, turn, call_id, name, arguments (JSON), needs (array of call_ids); results: turn, call_id, content."""
    calls = calls.select("conv_id", "turn", "call_id", "name", "arguments", "needs")
    first = results.where("call_id is not null").groupBy("call_id").agg(F.min(F.struct("turn", "content")).alias("result"))
    out = calls.join(first.hint("shuffle_hash"), "call_id", "left").join(levels(calls), "call_id", "left")
    content = F.to_json(F.struct(F.col("result.content").alias("v")))
    quoted = F.expr("substring(content, 6, length(content) - 6)")  # the text as a JSON string
    parts = [
        F.concat(F.lit('"arguments":'), canonical(F.col("arguments"))),
        F.concat(F.lit('"call_id":'), F.expr("""substring(to_json(struct(call_id as v)), 6, length(to_json(struct(call_id as v))) - 6)""")),
        F.concat(F.lit('"name":'), F.expr("""substring(to_json(struct(name as v)), 6, length(to_json(struct(name as v))) - 6)""")),
        F.concat(F.lit('"result":'), F.when(F.col("result.content").isNotNull(), quoted)),
    ]
    out = out.withColumn("content", content).withColumn("record", F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))
    return out.select("conv_id", "turn", "call_id", "level", F.col("result").isNotNull().alias("linked"), valid(F.col("name"), F.col("arguments"), schemas).alias("valid"), "record")


def conversation_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a conversation table: each user turn calls `reply`, the assistant's next turn is its result,
    and a call needs its conversation's first call, whose text sets the subject."""
    name = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.expr(turn).cast("string"))
    user = messages.where("role = 'user'")
    arguments = F.to_json(F.struct(F.col("turn"), F.col("text"), F.col("conv_id").alias("conv")))
    calls = user.select("conv_id", "turn", name("turn").alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"))
    opening = user.groupBy("conv_id").agg(F.min("turn").alias("opening"))
    needs = F.when(F.col("turn") > F.col("opening"), F.array(name("opening"))).otherwise(F.array().cast("array<string>"))
    calls = calls.join(opening, "conv_id", "left").withColumn("needs", needs)
    results = messages.where("role = 'assistant'").select("turn", name("turn - 1").alias("call_id"), F.col("text").alias("content"))
    return calls, results


def linked_conversations(messages: DataFrame) -> DataFrame:
    """The calls of a conversation table, linked to their results."""
    return link(*conversation_calls(messages.select("conv_id", "turn", "role", "text")), REPLY)


#: DuckDB SQL of `linked_conversations`.
ORACLE = """
WITH opening AS (SELECT conv_id, min(turn) AS opening FROM conversations WHERE role = 'user' GROUP BY conv_id),
results AS (
  SELECT conv_id, turn - 1 AS turn, min(text) AS content, count(*) AS n
  FROM conversations WHERE role = 'assistant' GROUP BY conv_id, turn
)
SELECT m.conv_id, m.turn, 'c' || m.conv_id || '-' || m.turn AS call_id, CAST(CASE WHEN m.conv_id IS NULL OR m.turn IS NULL THEN NULL WHEN m.turn > o.opening THEN 2 ELSE 1 END AS INTEGER) AS level,
       r.n IS NOT NULL AS linked,
       m.conv_id IS NOT NULL AND m.turn IS NOT NULL AND m.text IS NOT NULL AS valid,
       '{' || concat_ws(',',
         '"arguments":{' || concat_ws(',', '"conv":' || m.conv_id, '"text":' || CAST(to_json(m.text) AS VARCHAR), '"turn":' || m.turn) || '}',
         '"call_id":"' || 'c' || m.conv_id || '-' || m.turn || '"',
         '"name":"reply"',
         '"result":' || CASE WHEN r.content IS NOT NULL THEN CAST(to_json(r.content) AS VARCHAR) END) || '}' AS record
FROM conversations m
LEFT JOIN opening o USING (conv_id)
LEFT JOIN results r USING (conv_id, turn)
WHERE m.role = 'user'
"""
