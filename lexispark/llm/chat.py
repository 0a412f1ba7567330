"""Tool calls in chats: linking to their results, topological order, validation, canonical JSON.

A message's text is plain, or a JSON object with `content`, `tool_calls` (a list of objects with `id`, `name`,
`arguments`, an object or its JSON as a string, and perhaps `depends_on`, ids of calls whose results it needs), or
`tool_call_id`, which makes it the result of that call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables

#: name -> (required arguments, argument -> type). Types: string, integer, number, boolean, array, object.
SCHEMAS = {
    "search": (("query",), {"query": "string", "limit": "integer"}),
    "fetch": (("url",), {"url": "string", "timeout": "number"}),
    "calculate": (("expression",), {"expression": "string"}),
    "run_code": (("language", "code"), {"language": "string", "code": "string", "args": "array", "env": "object"}),
}
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|DECIMAL.*|FLOAT)", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}


def of_type(value: Column, kind: str) -> Column:
    return F.schema_of_variant(value).rlike(f"^{TYPES[kind]}$")


def verdict(name: Column, arguments: Column, schemas=SCHEMAS) -> Column:
    """valid, unknown_tool, not_an_object, missing:<argument> or wrong_type:<argument>, the first that holds."""
    out = F.lit("unknown_tool")
    for tool, (required, kinds) in schemas.items():
        at = lambda key: F.try_variant_get(arguments, f"$['{key}']", "variant")
        found = [F.when(at(key).isNull(), f"missing:{key}") for key in required]
        found += [F.when(at(key).isNotNull() & ~of_type(at(key), kind), f"wrong_type:{key}") for key, kind in kinds.items()]
        out = F.when(name == tool, F.coalesce(*found, F.lit("valid"))).otherwise(out)
    is_object = F.coalesce(of_type(arguments, "object"), F.lit(False))
    return F.when(~is_object, "not_an_object").otherwise(out)


def parts(chats: DataFrame, schemas=SCHEMAS) -> DataFrame:
    """One row per plain message, call and result, with `kind`, `part` (its place in the message) and `depends`."""
    looks = F.ltrim(F.col("text")).startswith("{")
    v = F.when(looks, F.try_parse_json("text"))
    rows = chats.select("conv_id", "turn", "role", "text", v.alias("v"))
    get = lambda path, kind, v="v": F.try_variant_get(F.col(v), path, kind)
    calls, result = get("$.tool_calls", "array<variant>"), get("$.tool_call_id", "string")
    rows = rows.withColumn("calls", calls).withColumn("result", F.when(F.col("calls").isNull(), result))
    has_calls = F.coalesce(F.size("calls") > 0, F.lit(False))
    content = F.when(has_calls | F.col("result").isNotNull(), get("$.content", "string")).otherwise(F.col("text"))
    none, no_deps = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    text = rows.filter(F.col("result").isNull()).withColumn("body", content).filter(F.col("body").isNotNull() | ~has_calls)
    messages = text.select("conv_id", "turn", F.lit(0).alias("part"), "role", F.lit("message").alias("kind"), none.alias("call_id"), none.alias("name"), none.alias("arguments"), F.lit("plain").alias("status"), no_deps.alias("depends"), F.to_json(F.struct(F.col("body").alias("content"), "role"), {"ignoreNullFields": "false"}).alias("json"))
    results = rows.filter("result is not null").select("conv_id", "turn", F.lit(0).alias("part"), "role", F.lit("result").alias("kind"), F.col("result").alias("call_id"), none.alias("name"), none.alias("arguments"), F.lit("plain").alias("status"), no_deps.alias("depends"), F.to_json(F.struct(get("$.content", "variant").alias("content"), "role", F.col("result").alias("tool_call_id")), {"ignoreNullFields": "false"}).alias("json"))
    each = rows.filter(has_calls).select("conv_id", "turn", "role", F.posexplode("calls").alias("part", "c"))
    raw = get("$.arguments", "variant", "c")
    each = each.withColumn("name", get("$.name", "string", "c")).withColumn("call_id", get("$.id", "string", "c")).withColumn("raw", raw)
    each = each.withColumn("a", F.when(of_type(F.col("raw"), "string"), F.try_parse_json(F.try_variant_get("raw", "$", "string"))).otherwise(F.col("raw")))
    called = F.struct(F.struct(F.col("a").alias("arguments"), F.col("call_id").alias("id"), F.col("name")).alias("call"), "role")
    calls = each.select("conv_id", "turn", (F.col("part") + 1).alias("part"), "role", F.lit("call").alias("kind"), "call_id", "name", F.to_json("a").alias("arguments"), verdict(F.col("name"), F.col("a"), schemas).alias("status"), get("$.depends_on", "array<string>", "c").alias("depends"), F.to_json(called, {"ignoreNullFields": "false"}).alias("json"))
    return messages.unionByName(calls).unionByName(results)


def link(chats: DataFrame, schemas=SCHEMAS) -> DataFrame:
    """(conv_id, turn, part, role, kind, call_id, name, status, link, order_turn, level, json) of every message,
    call and result.

    chats: (conv_id, turn, role, text). status: of a call the verdict on its arguments, else plain. link: of a call answered,
    unanswered, duplicate (the id stands earlier in the chat) or cycle; of a result linked, orphan (no such call) or
    duplicate (not the first result of its call); else none. Sorted by order_turn, level, turn, part, a chat
    is in topological order: results come after their calls, calls after the results they depend on; all keep their turn but where that
    would come too early. A dependency on an unknown or unanswered call counts for nothing; calls on a cycle, and what hangs on them,
    keep their turn. json: keys sorted, no blanks, null for what is missing.

    Null and empty texts are plain messages with that content; text that only looks like JSON is plain. Null conversations are one
    conversation, null turns come first. Of repeated rows the first call counts, the others are duplicates. An empty table gives no rows;
    other columns are not read.
    """
    tables = Tables(chats.sparkSession)
    rows = tables.keep(parts(chats, schemas).withColumn("conv", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))).withColumn("uid", F.monotonically_increasing_id()))
    place = F.struct("turn", "part", "uid")
    tools = rows.filter("kind <> 'message' and call_id is not null")
    first = lambda kind: tools.filter(F.col("kind") == kind).groupBy("conv", "call_id").agg(F.min(place).alias(f"first_{kind}"))
    known = tables.keep(first("call").join(first("result").hint("shuffle_hash"), ["conv", "call_id"], "full"))
    joined = rows.join(known, ["conv", "call_id"], "left")
    own = {k: F.col(f"first_{k}.uid") == F.col("uid") for k in ("call", "result")}
    call_link = F.when(F.col("call_id").isNull(), "unanswered").when(~own["call"], "duplicate").when(F.col("first_result").isNull(), "unanswered").otherwise("answered")
    result_link = F.when(F.col("first_call").isNull(), "orphan").when(~own["result"], "duplicate").otherwise("linked")
    linked = tables.keep(joined.withColumn("link", F.when(F.col("kind") == "call", call_link).when(F.col("kind") == "result", result_link).otherwise("none")))

    # What has to wait: a result for its call, a call for the results of others.
    waits = linked.filter("link in ('linked') or (kind = 'result' and link = 'duplicate')").select("uid", F.col("first_call.uid").alias("needs"))
    wanted = linked.filter("kind = 'call' and link <> 'duplicate'").select("uid", "conv", F.explode("depends").alias("call_id"))
    waits = waits.union(wanted.join(known.filter("first_call is not null and first_result is not null"), ["conv", "call_id"]).select("uid", F.col("first_result.uid").alias("needs")))
    waits = tables.keep(waits.distinct())
    turn = linked.select("uid", F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"))
    begin = waits.select(F.col("needs").alias("uid")).distinct().join(waits.select("uid").distinct(), "uid", "left_anti").join(turn, "uid")
    ready = tables.keep_part("placed", begin.select("uid", F.struct(F.col("turn").alias("t"), F.lit(0).alias("level")).alias("o")))
    # Each round joins what was placed last with what still waits; `late` is the latest place known of what a row's uid needs.
    turns = Tables(tables.spark)
    left = turns.keep(waits.withColumn("late", F.lit(None).cast("struct<t:bigint,level:int>")))
    while not (left.isEmpty() or ready.isEmpty()):
        seen = left.join(ready.select(F.col("uid").alias("needs"), "o"), "needs", "left")
        known = seen.groupBy("uid").agg(F.count_if(F.col("o").isNull()).alias("open"), F.greatest(F.max("o"), F.max("late")).alias("late"))
        known = turns.keep(known.join(turn, "uid"))
        after = F.when(F.col("late.t") >= F.col("turn"), F.struct(F.col("late.t").alias("t"), (F.col("late.level") + 1).alias("level"))).otherwise(F.struct(F.col("turn").alias("t"), F.lit(0).alias("level")))
        left = turns.keep(seen.filter("o is null").drop("late", "o").join(known.select("uid", "late"), "uid"))
        ready = tables.keep_part("placed", known.filter("open = 0").select("uid", after.alias("o")))
        turns.only(left)
    placed = tables.parts("placed", ready.schema)
    stuck = left.select("uid").distinct().withColumn("stuck", F.lit(True))
    out = linked.join(placed, "uid", "left").join(stuck, "uid", "left")
    is_stuck = F.col("stuck").isNotNull() & (F.col("kind") == "call")
    return out.select("conv_id", "turn", "part", "role", "kind", "call_id", "name", "status", F.when(is_stuck, "cycle").otherwise(F.col("link")).alias("link"), F.when(F.coalesce(F.col("o.t"), F.lit(0)) > -(1 << 62), F.coalesce("o.t", "turn")).alias("order_turn"), F.coalesce("o.level", F.lit(0)).alias("level"), "json")


#: For a table of plain messages, as `conversations` is: one row each, in its place, as canonical JSON. Tests hold calls and results
#: against brute force.
ORACLE = """
SELECT conv_id, turn, 0 AS part, role, 'message' AS kind, NULL::VARCHAR AS call_id, NULL::VARCHAR AS name, 'plain' AS status, 'none' AS link,
    turn AS order_turn, 0 AS level, '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || '}' AS json
FROM conversations
"""
