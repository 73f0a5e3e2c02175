"""Chat formatting: tool calls linked with their results.

``calls`` has ``conv_id, turn, call_id, name, arguments, after`` (``after``: the id of one earlier call
whose result this one needs, or null), ``results`` has ``conv_id, turn, call_id, content``. Calls and
results are joined by conversation and identifier, since identifiers start again in every conversation;
of several calls with one identifier the earliest (turn, name, arguments) counts and the others are
``duplicate``, the same for results.

Topological order: a call without a known predecessor has level 0, a result comes one level after its
call, a call one level after the result it needs. Levels come from pointer doubling, so a chain of n calls
takes about log2(n) joins; what still has a predecessor when the doubled distance exceeds the number of
calls lies on or behind a cycle, and gets the level null and the problem ``cycle``.

Arguments are checked against the schema of their tool, and every event is written as canonical JSON
(sorted keys, no blanks, UTF-8, numbers as JavaScript would print integers). Each event is a row of its
own, ordered by (level, turn, kind, call_id) within its conversation, so a very long conversation is
never gathered in one task. Messages (turns of any role with their whole text) have no level and take
their place by turn.

Defined results: null arguments are malformed; a null identifier links with nothing; rows with a null
``conv_id`` are one conversation; a null content is an empty string; texts of any length stay whole; repeated rows are duplicates; orphan results have level null; empty tables give empty
results; only the named columns are read.
"""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanlytics.functions.core import stable_hash
from spanlytics.llm.common import query, read, written

#: tool -> argument -> (type, required)
SCHEMAS = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "convert": {"value": ("number", True), "unit": ("string", True), "exact": ("boolean", False)},
    "lookup": {"keys": ("array", True), "options": ("object", False)},
}
_IS = {
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "boolean": lambda v: isinstance(v, bool),
    "array": lambda v: isinstance(v, list),
    "object": lambda v: isinstance(v, dict),
}


def _plain(value):
    """Whole floats as integers, everywhere; numbers beyond JSON are refused."""
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("not a JSON number")
        return int(value) if value.is_integer() and abs(value) < 2**53 else value
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return value


def canonical(value) -> str:
    return json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def checked_arguments(name: str | None, arguments: str | None, schemas: dict) -> tuple[str | None, list[str]]:
    """Canonical arguments (null if malformed) and the problems, sorted."""
    try:
        value = json.loads(arguments)
        text = canonical(value)
    except (TypeError, ValueError, RecursionError):
        return None, ["malformed"]
    if not isinstance(value, dict):
        return text, ["not an object"]
    schema = schemas.get(name)
    if schema is None:
        return text, ["unknown tool"]
    problems = [f"missing {k}" for k, (_, required) in schema.items() if required and k not in value]
    problems += [f"unknown {k}" for k in value if k not in schema]
    problems += [f"type {k}" for k, v in value.items() if k in schema and not _IS[schema[k][0]](v)]
    return text, sorted(problems)


def event_json(kind: str, call_id: str | None, name: str | None, arguments: str | None, content: str | None) -> str:
    """A message has its role as ``name``."""
    if kind == "message":
        return canonical({"role": name, "content": content or ""})
    if kind == "call":
        held = json.loads(arguments) if arguments is not None else None
        return canonical({"role": "assistant", "tool_call": {"id": call_id, "name": name, "arguments": held}})
    return canonical({"role": "tool", "tool_call_id": call_id, "content": content or ""})


def _arguments_udf(schemas: dict):
    kind = pa.struct([("text", pa.string()), ("problems", pa.list_(pa.string()))])

    @F.arrow_udf("struct<text: string, problems: array<string>>")
    def run(name: pa.Array, arguments: pa.Array) -> pa.Array:
        got = [checked_arguments(n, a, schemas) for n, a in zip(name.to_pylist(), arguments.to_pylist())]
        return pa.array([{"text": t, "problems": p} for t, p in got], kind)

    return run


def _json_udf():
    @F.arrow_udf("string")
    def run(kind: pa.Array, call_id: pa.Array, name: pa.Array, arguments: pa.Array, content: pa.Array) -> pa.Array:
        return pa.array([event_json(*x) for x in zip(*(c.to_pylist() for c in (kind, call_id, name, arguments, content)))], pa.string())

    return run


def _first(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``extra``: whether an earlier row has the same ``key``.

    The smallest row of each identifier is found by a minimum, which combines before the shuffle; rows
    equal in every ordered column are told apart by a number that counts them.
    """
    key = F.struct(*order)
    numbered = written(rows.withColumn("row_no", F.monotonically_increasing_id()), "events")
    low = numbered.filter("key is not null").groupBy("key").agg(F.min(F.struct(key.alias("k"), "row_no")).alias("low"))
    low = low.select(F.col("key").alias("low_id"), F.col("low.row_no").alias("low_no"))
    joined = numbered.join(low, numbered["key"] == F.col("low_id"), "left")
    return joined.withColumn("extra", F.coalesce(F.col("row_no") != F.col("low_no"), F.lit(False))).drop("low_id", "low_no")


def _key(call_id: str) -> Column:
    """An identifier within its conversation; null for a null identifier."""
    return F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.lit(":"), F.col(call_id))


def levels(links: DataFrame) -> DataFrame:
    """``node, depth`` for rows ``node, parent`` with unique nodes; depth null on or behind a cycle.

    A parent that is no node counts as none.
    """
    known = links.select(F.col("node").alias("parent"))
    state = links.join(known, "parent", "left_semi").select("node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("steps"))
    roots = links.join(known, "parent", "left_anti").select("node", F.lit(0).cast("long").alias("depth"))
    done = roots
    state, total, reach = written(state, "chain"), links.count(), 1
    while reach <= 2 * total and not state.isEmpty():
        ended = done.select(F.col("node").alias("e"), "depth")
        here = state.join(ended, state["up"] == F.col("e"), "left")
        here = written(here.select("node", "up", "steps", F.col("depth").alias("end_depth")), "chain")
        found = here.filter("end_depth is not null").select("node", (F.col("steps") + F.col("end_depth")).alias("depth"))
        open_ = here.filter("end_depth is null").select("node", "up", "steps")
        over = open_.select(F.col("node").alias("n2"), F.col("up").alias("up2"), F.col("steps").alias("s2"))
        done = written(done.union(found), "depths")
        # whoever stands on a node found just now is found in the next round; others jump twice as far
        jump = open_.join(over, open_["up"] == F.col("n2"), "left")
        state = written(jump.select("node", F.coalesce("up2", "up").alias("up"), (F.col("steps") + F.coalesce("s2", F.lit(0))).alias("steps")), "chain")
        reach *= 2
    return done.union(state.select("node", F.lit(None).cast("long")))


def linked_events(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """``conv_id, kind, turn, call_id, level, status, problems, json`` of every call and result."""
    calls = calls.select("conv_id", "turn", _key("call_id").alias("key"), "call_id", "name", "arguments", _key("after").alias("after"))
    calls = _first(calls, ["turn", "name", "arguments"])
    results = _first(results.select("conv_id", "turn", _key("call_id").alias("key"), "call_id", "content"), ["turn", "content"])
    own = written(calls.filter("not extra and key is not null").select(F.col("key").alias("node"), F.col("after").alias("parent")), "calls")
    # a parent needs a result, so each step down is a call and a result
    answered = results.filter("not extra and key is not null").select(F.col("key").alias("answered_id"))
    depth = written(levels(own.select("node", F.coalesce("parent", F.lit("")).alias("parent"))), "levels").select(F.col("node").alias("id"), (2 * F.col("depth")).alias("level"))
    depth = depth.join(answered, depth["id"] == F.col("answered_id"), "left").select("id", "level", F.col("answered_id").isNotNull().alias("has_result"))
    parents = own.select(F.col("node").alias("parent_id"))

    c = calls.join(depth, (calls["key"] == F.col("id")) & ~F.col("extra"), "left").join(parents, calls["after"] == F.col("parent_id"), "left")
    c = c.withColumn("checked", _arguments_udf(schemas)("name", "arguments"))
    cycle = F.col("id").isNotNull() & F.col("level").isNull()
    more = F.array_compact(F.array(F.when(cycle, F.lit("cycle")), F.when(F.col("after").isNotNull() & F.col("parent_id").isNull(), F.lit("unknown predecessor"))))
    status = F.when(F.col("extra"), "duplicate").when(F.coalesce("has_result", F.lit(False)), "linked").otherwise("unanswered")
    none = F.lit(None).cast("string")
    c = c.select("conv_id", F.lit("call").alias("kind"), "turn", "call_id", "level", status.alias("status"), F.sort_array(F.concat("checked.problems", more)).alias("problems"), "name", F.col("checked.text").alias("arguments"), none.alias("content"))

    r = results.join(depth.select("id", "level"), results["key"] == F.col("id"), "left")
    status = F.when(F.col("extra"), "duplicate").when(F.col("id").isNull(), "orphan").otherwise("linked")
    r = r.select("conv_id", F.lit("result").alias("kind"), "turn", "call_id", F.when(~F.col("extra"), F.col("level") + 1).alias("level"), status.alias("status"), F.array().cast("array<string>").alias("problems"), none.alias("name"), none.alias("arguments"), "content")
    rows = c.union(r).withColumn("json", _json_udf()("kind", "call_id", "name", "arguments", "content"))
    return rows.select("conv_id", "kind", "turn", "call_id", "level", "status", "problems", "json")


def message_events(turns: DataFrame) -> DataFrame:
    """Every row of ``conv_id, turn, role, text`` as an event like those of ``linked_events``, with its whole text."""
    none = F.lit(None).cast("string")
    json = _json_udf()(F.lit("message"), none, F.col("role"), none, F.col("text"))
    return turns.select("conv_id", F.lit("message").alias("kind"), "turn", none.alias("call_id"), F.lit(None).cast("long").alias("level"), F.lit("message").alias("status"), F.array().cast("array<string>").alias("problems"), json.alias("json"))


# ------------------------------------------------------------------ calls and results in plain turns


def _call_id(conv: Column, turn: Column) -> Column:
    return F.concat_ws(":", conv.cast("string"), turn.cast("string"))


def derived_calls(turns: DataFrame) -> DataFrame:
    """Assistant turns read as calls: the whole text of a turn is in the arguments; some have faults."""
    t = turns.filter("role = 'assistant'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    h = stable_hash(F.lit("tool"), "conv_id", "turn")
    words = F.filter(F.split("text", r"\s+"), lambda x: F.length(x) > 0)
    t = t.select("conv_id", "turn", h.alias("h"), words.alias("w"), "text")
    search = F.to_json(F.struct((F.col("h") % 20).alias("limit"), F.col("text").alias("query")))
    convert = F.to_json(F.struct(F.size("w").cast("double").alias("value"), F.col("text").alias("unit"), (F.col("h") % 2 == 0).alias("exact")))
    lookup = F.to_json(F.struct(F.split("text", " ").alias("keys"), F.struct((F.col("h") % 7).alias("depth")).alias("options")))
    k, fault = F.col("h") % 3, F.col("h") % 31
    arguments = F.when(k == 0, search).when(k == 1, convert).otherwise(lookup)
    arguments = F.when(fault == 1, F.substring(arguments, 1, 9)).when(fault == 2, F.lit('{"query":7,"more":null}')).when(fault == 3, F.lit(None)).otherwise(arguments)
    name = F.when(fault == 4, "unlisted").when(k == 0, "search").when(k == 1, "convert").otherwise("lookup")
    # a few turns repeat the identifier of an earlier one, and a few wait for a later one
    own = F.when(fault == 5, F.col("turn") - 2).otherwise(F.col("turn"))
    before = F.when(F.col("h") % 5 == 0, F.lit(None)).when(fault == 6, F.col("turn") + 2).when(F.col("turn") > 1, F.col("turn") - 2)
    return t.select("conv_id", "turn", _call_id(F.col("conv_id"), own).alias("call_id"), name.alias("name"), arguments.alias("arguments"), F.when(before.isNotNull(), _call_id(F.col("conv_id"), before)).alias("after"))


def derived_results(turns: DataFrame) -> DataFrame:
    """User turns after the first read as results of the turn before them."""
    t = turns.filter("role = 'user' and turn > 0")
    shift = F.when(stable_hash(F.lit("result"), "conv_id", "turn") % 29 == 0, 101).otherwise(1)
    return t.select("conv_id", "turn", _call_id(F.col("conv_id"), F.col("turn") - shift).alias("call_id"), F.col("text").alias("content"))


@query("op6_chat_tool_links")
def op6_chat_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of the conversations, and every call and result linked, ordered, checked and serialised."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = message_events(turns).unionByName(linked_events(derived_calls(turns), derived_results(turns)))
    return out.withColumn("problems", F.array_join("problems", ";"))
