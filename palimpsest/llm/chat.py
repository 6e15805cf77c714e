"""Chat formatting: tool calls linked to their results, ordered, validated, and written as canonical JSON.

A call stands in an assistant's message as <tool_call>{"id": ..., "name": ..., "arguments": {...}}</tool_call>; a
message of role `tool` is a result, {"tool_call_id": ..., "content": ...}. Calls and results meet in a hash join by
conversation and identifier. Only results depend on something, namely on the message of their call, so the stable
topological order is that of the turns, with each result that stood before its call placed right after it. A call's arguments are checked against the schema of its tool: required ones
present, none unknown, each of its type. Every message becomes one line of canonical JSON: keys in order, no
white space, arguments in a normal form.

Each message is a row of its own, so a conversation is as long as it likes: positions are counted in blocks of
turns, and a block's offset is the sum of those before.

Defined results: calls that are no JSON object, or lack an id or a name, are `malformed`; of calls with one
identifier the first counts, and of results for one call; the others are `duplicate`; a result without a call is an
`orphan`, and stays in its place; calls without a result are `unanswered`; a null text is empty, a null role is
written as null; null turns come last; messages of one turn are told apart by role and text and ordered by role and
their text's hash, and rows that repeat stay repeated, at positions of their own, as one message with one status; a null conv_id is a conversation; an empty table gives no rows; other
columns are left out whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CALL = r"(?s)<tool_call>(.*?)</tool_call>"
#: Tools, their parameters, and for each its type and whether it is required.
Schemas = dict[str, dict[str, tuple[str, bool]]]
#: What a JSON type is called in the schema of a variant.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|DECIMAL.*)", "boolean": "BOOLEAN", "array": "ARRAY<.*>", "object": "OBJECT<.*>"}
BLOCK_TURNS = 1024


def call_texts(role: str = "role", text: str = "text") -> Column:
    return F.when(F.col(role) == "assistant", F.regexp_extract_all(text, F.lit(CALL), F.lit(1))).otherwise(F.array().cast("array<string>"))


#: What tells a message from the others of its conversation, in their order.
MESSAGE = ("turn", "role", "hash", "digest")


def with_key(messages: DataFrame) -> DataFrame:
    """messages with hash and digest of the text: turns may be shared."""
    return messages.withColumns({"hash": F.xxhash64("text"), "digest": F.md5(F.encode("text", "UTF-8"))})


def calls_of(messages: DataFrame) -> DataFrame:
    """conv_id, what tells the message, at, call_id, name, arguments (a variant), form: `ok` or `malformed`; one row a call, repeated messages once."""
    each = messages.select("conv_id", *MESSAGE, F.posexplode(call_texts()).alias("at", "_raw")).distinct()
    each = each.withColumn("_call", F.try_parse_json("_raw"))
    part = lambda p: F.try_variant_get("_call", f"$.{p}", "string")
    each = each.select("conv_id", *MESSAGE, "at", part("id").alias("call_id"), part("name").alias("name"), F.try_variant_get("_call", "$.arguments", "variant").alias("arguments"))
    return each.withColumn("form", F.when(F.col("call_id").isNotNull() & F.col("name").isNotNull(), "ok").otherwise("malformed"))


def results_of(messages: DataFrame) -> DataFrame:
    """conv_id, what tells the message, call_id of each result; one row a result, repeated messages once."""
    own = messages.where("role = 'tool'").select("conv_id", *MESSAGE, F.try_parse_json("text").alias("_r"))
    return own.select("conv_id", *MESSAGE, F.try_variant_get("_r", "$.tool_call_id", "string").alias("call_id")).distinct()


def place_of(*order: str) -> Column:
    """Columns as one that can be compared, nulls last."""
    return F.struct(*[F.struct(F.col(c).isNull().alias("none"), F.col(c).alias("value")).alias(f"by{i}") for i, c in enumerate(order)])


def first_of(rows: DataFrame, *order: str) -> DataFrame:
    """For each (conv_id, call_id) the first row's order, as the struct _first."""
    return rows.groupBy("conv_id", "call_id").agg(F.min(place_of(*order)).alias("_first"))


def all_equal(pairs: dict[str, str]) -> Column:
    out = F.lit(True)
    for a, b in pairs.items():
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def linked(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results, each with a status; a result also with its call's turn. messages: conv_id, turn, role, text."""
    if "digest" not in messages.columns:
        messages = with_key(messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")))
    calls, results = calls_of(messages), results_of(messages)
    head = first_of(calls.where("form = 'ok'"), *MESSAGE, "at").select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_i"), F.col("_first").alias("_call"))
    answer = first_of(results.where("call_id is not null"), *MESSAGE).select(F.col("conv_id").alias("_rc"), F.col("call_id").alias("_ri"), F.col("_first").alias("_result"))
    same = lambda c, i: F.col("conv_id").eqNullSafe(F.col(c)) & (F.col("call_id") == F.col(i))
    calls = calls.join(head.hint("shuffle_hash"), same("_c", "_i"), "left").join(answer.hint("shuffle_hash"), same("_rc", "_ri"), "left")
    status = F.when(F.col("form") == "malformed", "malformed").when(place_of(*MESSAGE, "at") != F.col("_call"), "duplicate").when(F.col("_result").isNull(), "unanswered").otherwise("linked")
    calls = calls.select("conv_id", *MESSAGE, "at", "call_id", "name", "arguments", status.alias("status"))
    results = results.join(head.hint("shuffle_hash"), same("_c", "_i"), "left").join(answer.hint("shuffle_hash"), same("_rc", "_ri"), "left")
    status = F.when(F.col("_call").isNull(), "orphan").when(place_of(*MESSAGE) != F.col("_result"), "duplicate").otherwise("linked")
    results = results.select("conv_id", *MESSAGE, "call_id", status.alias("status"), F.col("_call").getField("by0").getField("value").alias("call_turn"))
    return calls, results


def validated(calls: DataFrame, schemas: Schemas) -> DataFrame:
    """calls with errors: an array of what is wrong with the arguments, in order."""
    spark = calls.sparkSession
    rows = [(t, p, TYPES[kind], need) for t, params in schemas.items() for p, (kind, need) in params.items()]
    known = spark.createDataFrame(rows, "_tool string, _param string, _type string, _need boolean")
    tools = spark.createDataFrame([(t, [p for p, (_, need) in params.items() if need]) for t, params in schemas.items()], "_tool string, _required array<string>")
    key = ["conv_id", *MESSAGE, "at"]
    own = calls.where("status != 'malformed'").select(*key, "name", F.when(F.schema_of_variant("arguments").startswith("OBJECT"), F.col("arguments")).alias("arguments"))
    given = own.lateralJoin(spark.tvf.variant_explode_outer(F.col("arguments").outer())).select(*key, "name", F.col("key").alias("param"), F.schema_of_variant("value").alias("type"))
    given = given.join(F.broadcast(known), (F.col("name") == F.col("_tool")) & (F.col("param") == F.col("_param")), "left")
    wrong = F.when(F.col("param").isNull(), F.lit(None)).when(F.col("_param").isNull(), F.concat(F.lit("unknown:"), "param")).when(~F.expr("type rlike concat('^', _type, '$')"), F.concat(F.lit("type:"), "param"))
    found = given.groupBy(*key, "name").agg(F.collect_set("param").alias("_given"), F.collect_set(wrong).alias("_wrong"))
    found = found.join(F.broadcast(tools), F.col("name") == F.col("_tool"), "left")
    missing = F.transform(F.array_except("_required", "_given"), lambda p: F.concat(F.lit("missing:"), p))
    errors = F.when(F.col("_tool").isNull(), F.array(F.concat(F.lit("tool:"), F.coalesce("name", F.lit(""))))).otherwise(F.sort_array(F.concat("_wrong", missing)))
    found = found.select(*[F.col(c).alias(f"_{c}") for c in key], errors.alias("errors"))
    calls = calls.join(found, all_equal({c: f"_{c}" for c in key}), "left").drop(*[f"_{c}" for c in key])
    return calls.withColumn("errors", F.coalesce("errors", F.array().cast("array<string>")))


def canonical(role: Column, text: Column, calls: Column) -> Column:
    """A message as JSON: keys in order, no white space; a result's own JSON and the calls' in their normal form."""
    said = F.when(F.size(calls) > 0, F.trim(F.regexp_replace(text, CALL, ""))).otherwise(text)
    normal = F.transform(calls, lambda c: F.coalesce(F.to_json(F.try_parse_json(c)), F.to_json(F.struct(c.alias("malformed")))))
    quoted = lambda c: F.when(c.isNull(), "null").otherwise(F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1))
    content = F.when(role == "tool", F.coalesce(F.to_json(F.try_parse_json(text)), quoted(said))).otherwise(quoted(said))
    listed = F.when(F.size(calls) > 0, F.concat(F.lit('"calls":['), F.array_join(normal, ","), F.lit("],"))).otherwise(F.lit(""))
    return F.concat(F.lit("{"), listed, F.lit('"content":'), content, F.lit(',"role":'), quoted(role), F.lit("}"))


def formatted(messages: DataFrame, schemas: Schemas | None = None, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """conv_id, position, turn, role, n_calls, n_bad (calls that are malformed, duplicate, unanswered or have wrong arguments), link (of a result), json."""
    m = with_key(messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")))
    calls, results = linked(m)
    key = ["conv_id", *MESSAGE]
    bad = (F.col("status") != "linked") | (F.size("errors") > 0)
    of_message = validated(calls, schemas or {}).groupBy(*key).agg(F.count_if(bad).alias("_bad")).select(*[F.col(c).alias(f"_c_{c}") for c in key], "_bad")
    results = results.select(*[F.col(c).alias(f"_r_{c}") for c in key], "status", "call_turn")
    # a null conversation is one, so its key is two columns that are never null
    m = m.withColumns({"_calls": call_texts(), "_none": F.col("conv_id").isNull(), "_conv": F.coalesce("conv_id", F.lit(0))})
    # only messages with calls, and results, meet the links; all others are not moved for them
    linked_ = (F.size("_calls") > 0) | F.coalesce(F.col("role") == "tool", F.lit(False))
    some = m.where(linked_).join(of_message, all_equal({c: f"_c_{c}" for c in key}), "left")
    some = some.join(results, all_equal({c: f"_r_{c}" for c in key}), "left").drop(*[f"_{x}_{c}" for x in "cr" for c in key])
    m = some.unionByName(m.where(~linked_), allowMissingColumns=True)
    late = (F.col("status") == "linked") & (F.col("call_turn") > F.col("turn"))
    m = m.withColumns({"_turn": F.when(late, F.col("call_turn")).otherwise(F.col("turn")), "_step": F.when(late, 1).otherwise(0)})
    m = m.withColumn("_block", F.coalesce(F.floor(F.col("_turn") / block_turns), F.lit(1 << 52)))
    # a position: the rows of the conversation's blocks before, and then the row's place in its block
    of = ["_none", "_conv", "_block"]
    blocks = m.groupBy(*of).agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy("_none", "_conv").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(*of, before.alias("_before"))
    place = F.row_number().over(Window.partitionBy(*of).orderBy(F.asc_nulls_last("_turn"), "_step", F.asc_nulls_last("turn"), F.asc_nulls_last("role"), "hash", "digest"))
    m = m.withColumn("_place", place).join(blocks, of)
    return m.select(
        "conv_id",
        (F.col("_before") + F.col("_place")).cast("long").alias("position"),
        "turn",
        "role",
        F.size("_calls").cast("long").alias("n_calls"),
        F.when(F.size("_calls") > 0, F.coalesce("_bad", F.lit(0))).otherwise(0).cast("long").alias("n_bad"),
        F.when(F.col("role") == "tool", F.coalesce("status", F.lit("orphan"))).alias("link"),
        canonical(F.col("role"), F.col("text"), F.col("_calls")).alias("json"),
    )
