"""Chat formatting by tool-call linking, in DataFrame expressions alone.

Calls and results meet in a hash join on (conversation, identifier). A result
is placed after its call even where the log has them the other way round: the
edges of the graph run from a message's calls to their results, and a result may
call in turn. With anchor = the latest turn along that chain of calls and depth
= the links on it, (anchor, depth, turn) is a topological order, which a sort or
a range-partitioned write can use without gathering a conversation in one task.
Arguments are parsed as variants, checked
against a schema, and written as canonical JSON: keys sorted at every level, no
white space, nulls left out.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

CALL = "struct<id:string,name:string,arguments:string>"
#: Prefixes of the types that schema_of_variant names.
_KINDS = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DECIMAL|DOUBLE|FLOAT", "boolean": "BOOLEAN", "array": "ARRAY", "object": "OBJECT"}


def _errors(call: Column, schemas: Mapping[str, Mapping[str, Any]]) -> Column:
    """What is wrong with a call's arguments, as sorted strings."""
    parsed = F.try_parse_json(call["arguments"])
    wrong = [F.when(parsed.isNull(), F.lit("not JSON"))]
    known = reduce(lambda a, b: a | b, [call["name"] == n for n in schemas], F.lit(False))
    wrong.append(F.when(~F.coalesce(known, F.lit(False)), F.lit("unknown tool")))
    for name, schema in schemas.items():
        for field, rule in schema.get("properties", {}).items():
            value = F.try_variant_get(parsed, f"$.{field}", "variant")
            kind = F.schema_of_variant(value)
            here = (call["name"] == name) & parsed.isNotNull()
            if field in schema.get("required", ()):
                wrong.append(F.when(here & value.isNull(), F.lit(f"{field}: missing")))
            if "type" in rule:
                wrong.append(F.when(here & value.isNotNull() & ~kind.rlike(f"^(?:{_KINDS[rule['type']]})"), F.lit(f"{field}: not {rule['type']}")))
            if "minimum" in rule:
                wrong.append(F.when(here & (F.try_variant_get(parsed, f"$.{field}", "double") < rule["minimum"]), F.lit(f"{field}: under {rule['minimum']}")))
            if "enum" in rule:
                wrong.append(F.when(here & value.isNotNull() & ~F.coalesce(F.try_variant_get(parsed, f"$.{field}", "string").isin(*rule["enum"]), F.lit(False)), F.lit(f"{field}: not listed")))
    return F.array_sort(F.array_compact(F.array(*wrong)))


def _chains(calls: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """calls (conv_id, call_id, call_turn, by: the call that the caller answers) with top, the latest turn along the chain, and links, its length; and the callers on circles.

    Pointers are doubled, so a chain takes a logarithmic number of joins and a
    log without chains none. Calls on a circle count as the start of a chain.
    """
    if calls.where("by is not null").isEmpty():
        return calls.select("conv_id", "call_id", "call_turn", F.col("call_turn").alias("top"), F.lit(1).alias("links")), None
    known = calls.where("call_turn is not null").select("conv_id", F.col("call_id").alias("by"), F.lit(True).alias("known"))
    start = stage(calls.join(known, ["conv_id", "by"], "left").select("conv_id", "call_id", "call_turn", F.when(F.col("known"), F.col("by")).alias("up")), "links")
    most = start.where("up is not null").groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0

    def walk(at: DataFrame) -> tuple[DataFrame, bool]:
        at = at.select("conv_id", "call_id", "call_turn", F.col("call_turn").alias("top"), F.lit(1).alias("links"), "up")
        for _ in range(most.bit_length()):
            ahead = at.select("conv_id", F.col("call_id").alias("up"), F.col("top").alias("top2"), F.col("links").alias("links2"), F.col("up").alias("up2"))
            at = stage(at.join(ahead, ["conv_id", "up"], "left").select("conv_id", "call_id", "call_turn", F.greatest("top", "top2").alias("top"), (F.col("links") + F.coalesce("links2", F.lit(0))).alias("links"), F.col("up2").alias("up")), "chains")
            if at.where("up is not null").isEmpty():
                return at, True
        return at, most == 0

    made, done = walk(start)
    callers = None
    if not done:  # by now what pointers lead to is on a circle, and all of each circle
        circle = made.where("up is not null").select("conv_id", F.col("up").alias("call_id"), F.lit(True).alias("circle")).distinct()
        start = stage(start.join(circle, ["conv_id", "call_id"], "left"), "circles")
        callers = start.where("circle").select("conv_id", F.col("up").alias("call_id"), F.col("call_turn").alias("turn"), "circle").distinct()
        made, _ = walk(start.withColumn("up", F.when(F.col("circle").isNull(), F.col("up"))))
    return made.select("conv_id", "call_id", "call_turn", "top", "links"), callers


def format_chats(messages: DataFrame, schemas: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """One row per message: conv_id, turn, role, call_id, call_turn, orphan, anchor, depth, errors, json.

    messages: conv_id, turn, role, text, calls (array of CALL, or null) and
    call_id (of the call that this message answers, or null); other columns are
    ignored. schemas: for each tool name, `properties` (type, minimum, enum)
    and `required`, as in JSON Schema.

    call_turn: the turn of the call answered; of several calls with one
    identifier the lowest turn counts, of equal turns the lowest call answered.
    orphan: a result without a call. errors: of the message's calls, as "id:
    what". (anchor, depth, turn) orders a conversation, each result after its
    call along chains of any length; messages on a circle of calls have no such
    order and are placed as if they answered nothing. json: the message in canonical JSON; arguments that are no
    JSON stand there as a string. Null texts, roles and turns are left out of
    the JSON; a null conversation or identifier links with nothing. Repeated
    messages give repeated rows, an empty table an empty result.
    """
    m = messages.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", F.col("calls").cast(f"array<{CALL}>").alias("calls"), F.col("call_id").cast("string").alias("call_id"))
    made = m.select("conv_id", "turn", F.col("call_id").alias("by"), F.explode("calls").alias("c")).where("c.id is not null and conv_id is not null")
    first = made.groupBy("conv_id", F.col("c.id").alias("call_id")).agg(F.min(F.when(F.col("turn").isNotNull(), F.struct("turn", "by"))).alias("f"))
    chains, circles = _chains(stage(first.select("conv_id", "call_id", F.col("f.turn").alias("call_turn"), F.col("f.by").alias("by")), "calls"))
    linked = m.join(chains, ["conv_id", "call_id"], "left")
    if circles is not None:
        off = F.col("circle").isNull()
        linked = linked.join(circles, ["conv_id", "call_id", "turn"], "left").withColumns({"top": F.when(off, F.col("top")), "links": F.when(off, F.col("links")).otherwise(0)})
    result = F.col("call_id").isNotNull()
    as_variant = lambda c: F.coalesce(F.try_parse_json(c["arguments"]), c["arguments"].cast("variant"))
    calls = F.when(F.size("calls") > 0, F.transform("calls", lambda c: F.struct(as_variant(c).alias("arguments"), c["id"].alias("id"), c["name"].alias("name"))))
    errors = F.flatten(F.transform(F.coalesce("calls", F.array().cast(f"array<{CALL}>")), lambda c: F.transform(_errors(c, schemas), lambda e: F.concat(F.coalesce(c["id"], F.lit("?")), F.lit(": "), e))))
    return linked.select(
        "conv_id", "turn", "role", "call_id", "call_turn",
        (result & F.col("call_turn").isNull()).alias("orphan"),
        F.greatest("turn", "top").alias("anchor"),
        F.when(result & F.col("call_turn").isNotNull(), F.col("links")).otherwise(0).alias("depth"),
        F.array_join(errors, "; ").alias("errors"),
        F.to_json(F.struct(F.col("text").alias("content"), "role", F.col("call_id").alias("tool_call_id"), calls.alias("tool_calls"), "turn")).alias("json"),
    )


#: What a request must hold in the query below.
REPLY = {"reply": {"properties": {"n_chars": {"type": "integer", "minimum": 1}, "style": {"type": "string", "enum": ["plain", "terse"]}, "turn": {"type": "integer", "minimum": 0}}, "required": ["n_chars", "turn"]}}


def turns_as_calls(conversations: DataFrame) -> DataFrame:
    """Plain turns as a tool log, in which every turn of a user or an assistant calls a tool and most answer one.

    An assistant's turn answers its neighbour's call, and so does every other
    turn of a user, which makes chains of up to four links. The neighbour is the
    turn before or, in odd conversations, the one after, so that results stand
    before their calls there. By the text's length some calls name no known
    tool, and some arguments are no JSON, lack a field, or have one of another
    type, out of range or not listed.
    """
    n, turn, role = F.length("text"), F.col("turn"), F.col("role")
    spoken = role.isin("user", "assistant")
    answers = (role == "assistant") | (role == "user") & (turn % 4).isin(2, 3)
    size, at = F.concat(F.lit('{"n_chars":'), n.cast("string")), F.concat(F.lit(',"turn":'), turn.cast("string"), F.lit("}"))
    styled = lambda style: F.concat(size, F.lit(f',"style":"{style}"'), at)
    arguments = (
        F.when(n % 11 == 0, F.lit('{"n_chars":'))
        .when(n % 11 == 1, F.concat(F.lit('{"turn":'), turn.cast("string"), F.lit("}")))
        .when(n % 11 == 2, F.concat(F.lit('{ "n_chars": "many"'), at))
        .when(n % 11 == 3, styled("loud"))
        .when(n % 11 == 4, F.concat(F.lit('{"n_chars":-'), n.cast("string"), at))
        .otherwise(styled("plain"))
    )
    call = F.struct(turn.cast("string").alias("id"), F.when(n % 7 == 0, "erase").otherwise("reply").alias("name"), arguments.alias("arguments"))
    neighbour = F.when(F.col("conv_id") % 2 == 0, turn - 1).otherwise(turn + 1)
    return conversations.select("conv_id", "turn", "role", "text", F.when(spoken, F.array(call)).alias("calls"), F.when(answers, neighbour.cast("string")).alias("call_id"))
