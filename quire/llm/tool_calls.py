"""Tool-call linking for chat transcripts, in DataFrame operations only.

Calls and results are linked by a hash join on call_id, put in topological order, their arguments validated against
the schemas of the called tools, and written as canonical JSON (keys in code point order, no blanks, minimal escapes).

``documents -> calls``: transcripts hold plain turns, so the adapter ``exchange_calls`` reads each user or system turn as a
call and the turn that follows it as the result, if an assistant speaks there; the exchange before it in the same conversation is what a call
depends on. The call's identifier is a digest of the conversation and the turn.

Topological order: a call comes one level after the latest of the calls that it depends on (``topological_levels``). Chains of calls that
each need one other are followed by doubling, in as many rounds as the logarithm of their length; calls that need several
are settled round by round above them. Calls on a cycle (or depending on one) get a null level.

A call's predecessor in a conversation is found by ranks: conversations are cut into blocks of turn numbers, counted per block and
then per conversation, so that no task orders an unbounded conversation.

Of several results with one identifier, the first by text answers every call that has it; the others are rows of their own, marked:
calls and results of one identifier are never paired each with each.

Defined results: null or unknown roles make no call, and rows without a turn have no place and make none; a null text is an argument that is missing;
turns of equal number in a conversation share their identifier and level; wholly repeated rows
count once; calls without a result, and results without a call, are kept and marked; each row with a null conv_id is a conversation of
its own; empty tables give empty results; very long texts are arguments too long; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import Staging, partitions

#: Turn numbers in a block of one conversation.
BLOCK = 64
#: name -> fields: (type, required, largest length). A tool's arguments are valid if every field holds.
SCHEMAS = {
    "respond": {"text": ("string", True, 1_000_000), "turn": ("integer", True, None)},
    "configure": {"text": ("string", True, 100_000), "turn": ("integer", True, None)},
}
#: Spark types that hold a schema's types.
TYPES = {"string": ("string",), "integer": ("tinyint", "smallint", "int", "bigint")}
TOOLS = {"user": "respond", "system": "configure"}


def json_string(x: Column) -> Column:
    """A JSON string literal: quote, backslash and control characters escaped, all else as it is."""
    x = F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {8: "b", 9: "t", 10: "n", 12: "f", 13: "r"}
    codes = [*short, *(c for c in range(32) if c not in short)]
    escaped = reduce(lambda y, c: F.replace(y, F.lit(chr(c)), F.lit("\\" + short[c] if c in short else f"\\u{c:04x}")), codes, x)
    # Most texts hold no control character but the line feed; the other 31 replacements are skipped for them.
    simple = F.replace(x, F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit('"'), F.when(F.regexp_like(x, F.lit(r"[\x00-\x09\x0B-\x1F]")), escaped).otherwise(simple), F.lit('"'))


def canonical_object(fields: dict[str, Column]) -> Column:
    """JSON text of an object with the given fields; values are JSON texts, null values are left out."""
    pairs = [F.when(v.isNotNull(), F.concat(json_string(F.lit(k)), F.lit(":"), v)) for k, v in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))


def valid_arguments(name: Column, fields: dict[str, Column], types: dict[str, str], schemas: dict = SCHEMAS) -> Column:
    """The first error of a call's arguments against its tool's schema; null if they are valid.

    fields: argument columns, types: their Spark types; a null is a missing argument.
    """
    errors = F.when(name.isNull() | ~name.isin(list(schemas)), F.lit("unknown tool"))
    for tool, schema in sorted(schemas.items()):
        for field, (kind, required, most) in sorted(schema.items()):
            value = fields.get(field, F.lit(None))
            if field in types and types[field] not in TYPES[kind]:
                errors = errors.when((name == tool) & value.isNotNull(), F.lit(f"{field}: not {kind}"))
            if required:
                errors = errors.when((name == tool) & value.isNull(), F.lit(f"{field}: missing"))
            if kind == "string" and most is not None:
                errors = errors.when((name == tool) & (F.length(value) > most), F.lit(f"{field}: too long"))
            if kind == "integer":
                errors = errors.when((name == tool) & (value < 0), F.lit(f"{field}: negative"))
        for extra in sorted(set(fields) - set(schema)):
            errors = errors.when((name == tool) & fields[extra].isNotNull(), F.lit(f"{extra}: not in schema"))
    return errors


def link(calls: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls with the first result of their identifier, the results that no call took). Both sides have call_id and own columns.

    The first results are one row per identifier, aggregated before they are joined, so a repeated identifier costs its own rows only.
    """
    own = [c for c in results.columns if c != "call_id"]
    text = F.struct(F.col("result").isNull().alias("none"), *own)
    first = results.groupBy("call_id").agg(F.min(text).alias("r"))
    linked = calls.join(first.hint("shuffle_hash"), "call_id", "left")
    asked = calls.select("call_id").distinct().withColumn("asked", F.lit(True))
    rest = results.join(first, "call_id").join(asked, "call_id", "left").where(F.col("asked").isNull() | (text != F.col("r")))
    return linked, rest.select("call_id", *own, F.coalesce("asked", F.lit(False)).alias("asked"))


def topological_levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """(call_id, level): level 0 for calls that need none, else one more than the largest level among what they need.

    needs: (call_id, needs_id). Needed identifiers that are no calls don't count. Calls on a cycle or above one get null.
    """
    stage = Staging(calls.sparkSession, "levels")
    ids = calls.select("call_id").distinct()
    known = needs.join(ids.select(F.col("call_id").alias("needs_id")), "needs_id", "left_semi").join(ids, "call_id", "left_semi").distinct()
    known = stage.table(known.select("call_id", "needs_id"), "needs")
    many = known.groupBy("call_id").agg(F.count("*").alias("n"), F.min("needs_id").alias("to"))
    # Calls that need one other: each points at what it needs, then as far again in every round.
    jump = stage.table(many.where("n = 1").select("call_id", "to", F.lit(1).cast("bigint").alias("far"), F.lit(True).alias("moved")), "jump")
    rounds = 2 + int(jump.count()).bit_length()  # longer than any chain; what still moves is on a cycle
    while rounds and not jump.where("moved").isEmpty():
        rounds -= 1
        on = jump.select(F.col("call_id").alias("to"), F.col("to").alias("to2"), F.col("far").alias("far2"))
        jump = jump.join(on, "to", "left").select("call_id", F.coalesce("to2", "to").alias("to"), (F.col("far") + F.coalesce("far2", F.lit(0))).alias("far"), F.col("to2").isNotNull().alias("moved"))
        jump = stage.table(jump, "jump")
    ends = jump.where("not moved").select("call_id", "to", "far")
    # What is left: calls that need several, over the ends of the chains below them.
    several = known.join(many.where("n > 1").select("call_id"), "call_id", "left_semi")
    below = several.join(jump.select(F.col("call_id").alias("needs_id"), "to", "far"), "needs_id", "left")
    open_ = stage.table(below.select("call_id", F.coalesce("to", "needs_id").alias("needs_id"), (F.coalesce("far", F.lit(0)) + 1).alias("far")), "open")
    done = ids.join(many, "call_id", "left_anti").withColumn("level", F.lit(0).cast("bigint"))
    settled = stage.table(done, "settled")
    while not open_.isEmpty():
        met = stage.table(open_.join(settled.select(F.col("call_id").alias("needs_id"), "level"), "needs_id", "left"), "met")
        ready = met.groupBy("call_id").agg(F.max(F.col("level") + F.col("far")).alias("level"), F.count(F.when(F.col("level").isNull(), 1)).alias("missing")).where("missing = 0")
        ready = stage.table(ready.select("call_id", "level"), "ready")
        if ready.isEmpty():
            break
        settled = stage.table(settled.unionByName(ready), "settled")
        open_ = stage.table(open_.join(ready, "call_id", "left_anti"), "open")
    of_chains = ends.join(settled.withColumnRenamed("call_id", "to"), "to").select("call_id", (F.col("level") + F.col("far")).alias("level"))
    return ids.join(stage.table(settled.unionByName(of_chains), "levels"), "call_id", "left")


def conversation(conv_id: Column, turn: Column, role: Column, text: Column) -> Column:
    """The name of a row's conversation: a row without one is its own."""
    alone = F.md5(F.to_json(F.struct(turn.alias("t"), role.alias("r"), text.alias("x"))))
    return F.coalesce(conv_id.cast("string"), F.concat(F.lit("-"), alone))


def exchange_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of a transcript table (conv_id, turn, role, text), each dealt by call_id once for all that follows."""
    t = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    t = t.where("turn is not null")
    t = t.withColumn("conv", conversation(F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text")))
    identifier = lambda turn: F.md5(F.concat_ws(":", "conv", turn.cast("string")))
    name = F.element_at(F.create_map(*[F.lit(x) for kv in TOOLS.items() for x in kv]), F.col("role"))
    n = partitions(turns.sparkSession)
    calls = t.where(F.col("role").isin(list(TOOLS))).select("conv_id", "conv", identifier(F.col("turn")).alias("call_id"), "turn", name.alias("name"), "text")
    results = t.where("role = 'assistant'").select("conv_id", identifier(F.col("turn") - 1).alias("call_id"), F.col("turn").alias("result_turn"), F.col("text").alias("result"))
    return calls.repartition(n, "call_id").distinct(), results.repartition(n, "call_id").distinct()


def predecessors(keys: DataFrame, stage: Staging) -> DataFrame:
    """(call_id, needs_id): the call before each in its conversation. Conversations are ranked block by block.

    keys: (conv, turn, call_id), texts left out.
    """
    keys = stage.table(keys.distinct().withColumn("block", F.floor(F.col("turn") / BLOCK)), "keys")
    blocks = keys.groupBy("conv", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = stage.table(blocks.withColumn("before", F.coalesce(before, F.lit(0))).drop("n"), "blocks")
    inside = F.row_number().over(Window.partitionBy("conv", "block").orderBy("turn"))
    ranks = keys.withColumn("inside", inside).join(blocks, ["conv", "block"]).select("conv", "call_id", (F.col("inside") + F.col("before")).alias("rank"))
    ranks = stage.table(ranks, "ranks")
    last = ranks.select("conv", (F.col("rank") + 1).alias("rank"), F.col("call_id").alias("needs_id"))
    return ranks.join(last, ["conv", "rank"]).select("call_id", "needs_id")


def linked_tool_calls(turns: DataFrame) -> DataFrame:
    """One row per call, and per result that no call took, of a transcript table.

    conv_id, call_id, turn, level (topological), name, linked (a result was found), error (null: arguments valid), json: the
    call with its result as canonical JSON.
    """
    stage = Staging(turns.sparkSession, "tools")
    calls, results = exchange_calls(turns)
    keys = stage.table(calls.select("conv", "turn", "call_id"), "calls")
    levels = topological_levels(keys, predecessors(keys, stage))
    linked, rest = link(calls, results)
    linked = linked.join(levels.hint("shuffle_hash"), "call_id", "left")
    fields = {"text": F.col("text"), "turn": F.col("turn")}
    error = valid_arguments(F.col("name"), fields, dict(calls.dtypes))
    arguments = canonical_object({"text": json_string(F.col("text")), "turn": F.col("turn").cast("string")})
    found = F.col("r").isNotNull()
    answer = lambda x: F.coalesce(json_string(x), F.lit("null"))
    text = canonical_object({"arguments": arguments, "id": json_string(F.col("call_id")), "name": json_string(F.col("name")), "result": F.when(found, answer(F.col("r.result"))), "valid": error.isNull().cast("string")})
    out = linked.select("conv_id", "call_id", "turn", "level", "name", found.alias("linked"), error.alias("error"), text.alias("json"))
    text = canonical_object({"id": json_string(F.col("call_id")), "result": answer(F.col("result"))})
    error = F.when(F.col("asked"), F.lit("another result of a call")).otherwise(F.lit("result without a call"))
    rest = rest.select("conv_id", "call_id", F.col("result_turn").alias("turn"), F.lit(None).cast("bigint").alias("level"), F.lit(None).cast("string").alias("name"), F.lit(True).alias("linked"), error.alias("error"), text.alias("json"))
    return out.unionByName(rest.toDF(*out.columns))
