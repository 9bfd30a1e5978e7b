"""Chat formatting with tool calls: link, order, validate, serialise.

A message whose text is a JSON object with "tool_calls" makes calls, each with id, name, arguments and,
optionally, after: identifiers of calls of the same conversation that it depends on. A message of role
"tool" whose text is a JSON object with "tool_call_id" is a result. Everything else is a plain message.

Calls and results are hash-joined by (conversation, identifier). Calls get a level: 0, or one more than the
highest level among those they depend on. Conversations of usual size are ordered each in one task; those
with more calls than LOCAL in rounds over the whole table, so that no group is ever held at once. A round lets every
call that waits for one other alone wait for what that one waits for: chains of any length halve in each round.
Arguments are validated against the tool's schema. Each row is serialised as canonical JSON: keys sorted, no
blanks, whole floats as integers. The rows of a conversation, by level and then turn and place, are its linked form.

Nulls and odd cases: a null text is an empty message; text that is no such JSON, or JSON nested deeper than DEEP, is a plain message, never
an error; arguments in a string that is no JSON, or is nested deeper, stay that string; `after` that is no list of strings is void as far as it
isn't; a lone surrogate is written as U+FFFD; a schema's unknown type is matched by no value, and a broken pattern by no text; a null conversation
is a conversation of its own; an identifier that is called twice goes to the earliest call, and the later are "duplicate"; so with
results; a result without a call is an "orphan"; a call without result is "unanswered"; calls in a cycle, or behind one,
have level -1 and are "cyclic"; dependencies on unknown calls are void; repeated rows are duplicates; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store

#: Calls of a conversation that one task orders.
LOCAL = 10_000

Schemas = dict[str, dict[str, Any]]


#: Levels of nesting that a message's JSON may have.
DEEP = 200
_SURROGATE = re.compile("[\ud800-\udfff]")


def parsed(text: str) -> Any:
    """The JSON value of text; ValueError if it is none or nested deeper than DEEP."""
    try:
        value = json.loads(text)
    except RecursionError:
        raise ValueError("nested too deeply") from None
    level, depth = [value], 0
    while level := [v for x in level if isinstance(x, (dict, list)) for v in (x.values() if isinstance(x, dict) else x)]:
        depth += 1
        if depth > DEEP:
            raise ValueError("nested too deeply")
    return value


def canonical(value: Any) -> str:
    """JSON with sorted keys, no blanks, and one way to write each number."""

    def plain(x: Any) -> Any:
        if isinstance(x, dict):
            return {plain(str(k)): plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        if isinstance(x, str):
            return _SURROGATE.sub("\ufffd", x)
        if isinstance(x, float):
            if x != x or x in (float("inf"), float("-inf")):
                return None
            return int(x) if x.is_integer() and abs(x) < 1e21 else x
        return x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


_TYPES: dict[str, Callable[[Any], bool]] = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
}


def faults(value: Any, schema: dict[str, Any], where: str = "$") -> list[str]:
    """Where the value breaks the schema: type, enum, required, properties, additionalProperties, items and bounds."""
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        if not any(k in _TYPES and _TYPES[k](value) for k in kinds):
            return [f"{where}: not {'|'.join(kinds)}"]
    out = []
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        out.append(f"{where}: not in enum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{where}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += faults(value[k], known[k], f"{where}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{where}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += faults(v, schema["items"], f"{where}[{i}]")
    sized = len(value) if isinstance(value, (str, list)) else None
    low, high = ("minLength", "maxLength") if isinstance(value, str) else ("minItems", "maxItems")
    if sized is not None:
        out += [f"{where}: too short"] * (sized < schema.get(low, 0)) + [f"{where}: too long"] * (sized > schema.get(high, sized))
    if _TYPES["number"](value):
        out += [f"{where}: too small"] * (value < schema.get("minimum", value)) + [f"{where}: too large"] * (value > schema.get("maximum", value))
    if isinstance(value, str) and "pattern" in schema and not _matches(schema["pattern"], value):
        out.append(f"{where}: no match")
    return out


def _matches(pattern: str, value: str) -> bool:
    try:
        return re.search(pattern, value) is not None
    except re.error:
        return False


_EVENT = "conv_id long, turn long, part int, kind string, role string, call_id string, name string, body string, after array<string>"
_SCHEMA = pa.schema(
    [("conv_id", pa.int64()), ("turn", pa.int64()), ("part", pa.int32()), ("kind", pa.string()), ("role", pa.string()), ("call_id", pa.string()), ("name", pa.string()), ("body", pa.string()), ("after", pa.list_(pa.string()))]
)


def _events(conv: int | None, turn: int | None, role: str | None, text: str | None) -> Iterator[tuple]:
    """The message's calls, its result, or itself."""
    text = text or ""
    clean = lambda x: _SURROGATE.sub("\ufffd", x)
    found: Any = None
    if text.lstrip()[:1] == "{" and ('"tool_calls"' in text or '"tool_call_id"' in text):
        try:
            found = parsed(text)
        except ValueError:
            found = None
    if isinstance(found, dict) and role == "tool" and isinstance(found.get("tool_call_id"), str):
        yield conv, turn, 0, "result", role, clean(found["tool_call_id"]), None, canonical(found.get("content")), None
        return
    calls = found.get("tool_calls") if isinstance(found, dict) and role != "tool" else None
    if isinstance(calls, list) and calls and all(isinstance(c, dict) and isinstance(c.get("id"), str) for c in calls):
        for part, c in enumerate(calls):
            arguments = c.get("arguments", {})
            if isinstance(arguments, str):  # arguments may be JSON within JSON
                try:
                    arguments = parsed(arguments)
                except ValueError:
                    pass
            after = c.get("after")
            after = [clean(a) for a in after if isinstance(a, str)] if isinstance(after, list) else []
            yield conv, turn, part, "call", role, clean(c["id"]), clean(str(c.get("name"))), canonical(arguments), after
        return
    yield conv, turn, 0, "message", role, None, None, canonical(text), None


def _event_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [e for row in zip(*(c.to_pylist() for c in batch.columns)) for e in _events(*row)]
        columns = list(zip(*rows)) if rows else [[]] * len(_SCHEMA)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def events(messages: DataFrame) -> DataFrame:
    """Calls, results and plain messages of messages(conv_id, turn, role, text)."""
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_event_kernel, _EVENT)


def turns_as_calls(conversations: DataFrame, name: str = "answer") -> DataFrame:
    """A plain conversation as calls: a user's turn asks the tool, the next turn, if the assistant's, is the result.

    Each call comes after the one two turns before. Other turns stay as they are.
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    # The turn before, by a join on conversation and turn: a conversation of any length is spread over tasks.
    before = turns.groupBy("conv_id", (F.col("turn") + 1).alias("next")).agg(F.min("role").alias("prior"))
    before = before.select(F.col("conv_id").alias("its_conv"), "next", "prior")
    rows = turns.join(before, F.col("conv_id").eqNullSafe(F.col("its_conv")) & (F.col("turn") == F.col("next")), "left")
    key = F.concat(F.lit("c"), F.col("turn"))
    call = F.to_json(F.struct(F.array(F.struct(key.alias("id"), F.lit(name).alias("name"), F.struct(F.col("text").alias("prompt"), F.col("turn").alias("turn")).alias("arguments"), F.array(F.concat(F.lit("c"), F.col("turn") - 2)).alias("after"))).alias("tool_calls")))
    result = F.to_json(F.struct(F.concat(F.lit("c"), F.col("turn") - 1).alias("tool_call_id"), F.col("text").alias("content")))
    asked = (F.col("role") == "user") & F.col("turn").isNotNull()
    answered = (F.col("role") == "assistant") & (F.col("prior") == "user")
    return rows.select("conv_id", "turn", F.when(asked, "assistant").when(answered, "tool").otherwise(F.col("role")).alias("role"), F.when(asked, call).when(answered, result).otherwise(F.col("text")).alias("text"))


def _level_task(calls: pa.Table) -> pa.Table:
    """Levels of one conversation's calls; -1 in or behind a cycle."""
    ids = calls["call_id"].to_pylist()
    needs = {c: {a for a in after or []} for c, after in zip(ids, calls["after"].to_pylist())}
    waits = {c: len(n := needs[c] & needs.keys()) for c in ids}
    back: dict[str, list[str]] = {}
    for c in ids:
        for a in needs[c] & needs.keys():
            back.setdefault(a, []).append(c)
    level = dict.fromkeys(ids, -1)
    front, k = [c for c in ids if not waits[c]], 0
    while front:
        following = []
        for c in front:
            level[c] = k
            for d in back.get(c, []):
                waits[d] -= 1
                if not waits[d]:
                    following.append(d)
        front, k = following, k + 1
    return pa.table({"conv": calls["conv"], "call_id": calls["call_id"], "level": pa.array([level[c] for c in ids], pa.int32())})


def _levels_in_rounds(calls: DataFrame) -> DataFrame:
    """As _level_task, in rounds over the whole table.

    An edge (call, needs, steps) says that the call comes `steps` levels after what it needs, at least; needs is null where that is the
    beginning. A round passes every edge on: one to a call that itself has a single edge goes on to where that leads. So chains halve, and
    a call whose needs all have their level gets its own, for then all its edges lead to the beginning. What walks further than there are calls is in
    or behind a cycle. Rounds: the logarithm of the longest chain, for each time that chains meet again one behind the other.
    """
    need = calls.select("conv", "call_id", F.explode("after").alias("needs")).distinct()
    known = calls.select("conv", F.col("call_id").alias("needs"))
    need = need.join(known, ["conv", "needs"]).select("conv", "call_id", "needs", F.lit(1).cast("long").alias("steps"))
    first = calls.select("conv", "call_id").join(need, ["conv", "call_id"], "left_anti")
    edges = store(need.unionByName(first.select("conv", "call_id", F.lit(None).cast("string").alias("needs"), F.lit(0).cast("long").alias("steps"))), "edges")
    sizes = store(calls.groupBy("conv").agg(F.count("*").alias("size")), "sizes")
    while True:
        one = edges.groupBy("conv", "call_id").agg(F.count("*").alias("n"), F.first("needs").alias("to"), F.first("steps").alias("more")).where("n = 1")
        one = one.join(sizes, "conv").where(F.col("more") <= F.col("size")).select("conv", F.col("call_id").alias("needs"), "to", "more", F.lit(True).alias("single"))
        joined = edges.join(one, ["conv", "needs"], "left").withColumn("moved", F.coalesce("single", F.lit(False)))
        passed = joined.select("conv", "call_id", F.when(F.col("moved"), F.col("to")).otherwise(F.col("needs")).alias("needs"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), "moved")
        edges = store(passed.groupBy("conv", "call_id", "needs").agg(F.max("steps").alias("steps"), F.max("moved").alias("moved")), "edges")
        if edges.where("moved").limit(1).count() == 0:
            break
        edges = edges.drop("moved")
    # Of calls that are settled, all edges lead to the beginning, which makes them one.
    level = F.when(F.max(F.col("needs").isNotNull()), -1).otherwise(F.max("steps")).cast("int")
    return edges.groupBy("conv", "call_id").agg(level.alias("level"))


def levels(calls: DataFrame, local: int = LOCAL) -> DataFrame:
    """(conv, call_id, level) of calls(conv, call_id, after), of which identifiers are unique in a conversation."""
    large = store(calls.groupBy("conv").count().where(F.col("count") > local).select("conv"), "large")
    usual = calls.join(large, "conv", "left_anti").groupBy("conv").applyInArrow(_level_task, "conv string, call_id string, level int")
    if large.limit(1).count() == 0:
        return usual
    return usual.unionByName(_levels_in_rounds(store(calls.join(large, "conv", "left_semi"), "large-calls")))


def _write_kernel(schemas: Schemas) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def line(row: dict[str, Any]) -> tuple[str, str]:
        status = row["status"]
        if row["kind"] == "message":
            return "ok", canonical({"role": row["role"], "content": json.loads(row["body"])})
        if row["kind"] == "result":
            return status, canonical({"role": row["role"], "tool_call_id": row["call_id"], "content": json.loads(row["body"])})
        arguments = json.loads(row["body"])
        wrong = faults(arguments, schemas[row["name"]]) if row["name"] in schemas else ["unknown tool"]
        call = {"id": row["call_id"], "name": row["name"], "arguments": arguments, "after": sorted(set(row["after"] or [])), "faults": wrong}
        if row["answer"] is not None:
            call["result"] = json.loads(row["answer"])
        return ("invalid" if wrong and status == "ok" else status), canonical(call)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [line(r) for r in batch.to_pylist()]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("conv_id", "turn", "part", "kind", "call_id", "level")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([s for s, _ in lines], pa.string()), pa.array([j for _, j in lines], pa.string())], ["conv_id", "turn", "part", "kind", "call_id", "level", "status", "json"])

    return kernel


def link(messages: DataFrame, schemas: Schemas, local: int = LOCAL) -> DataFrame:
    """One row per plain message, call and result: conv_id, turn, part, kind, call_id, level, status, json."""
    every = store(events(messages), "events").withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("none")))
    nth = Window.partitionBy("conv", "kind", "call_id").orderBy("turn", "part", "body")
    named = every.where("kind <> 'message'").withColumn("nth", F.row_number().over(nth))
    calls, results = named.where("kind = 'call'"), named.where("kind = 'result'")
    first = calls.where("nth = 1")
    level = store(levels(first.select("conv", "call_id", "after"), local), "levels").withColumn("nth", F.lit(1))
    answers = results.where("nth = 1").select("conv", "call_id", F.col("body").alias("answer"), F.lit(1).alias("nth"))
    linked = calls.join(level, ["conv", "call_id", "nth"], "left").join(answers, ["conv", "call_id", "nth"], "left")
    linked = linked.withColumn("status", F.when(F.col("nth") > 1, "duplicate").when(F.col("level") < 0, "cyclic").when(F.col("answer").isNull(), "unanswered").otherwise("ok"))
    asked = first.select("conv", "call_id", F.lit(True).alias("asked"))
    taken = results.join(asked, ["conv", "call_id"], "left").withColumn("status", F.when(F.col("asked").isNull(), "orphan").when(F.col("nth") > 1, "duplicate").otherwise("ok"))
    plain = every.where("kind = 'message'").withColumn("status", F.lit("ok"))
    columns = ["conv_id", "turn", "part", "kind", "role", "call_id", "name", "body", "after", "level", "answer", "status"]
    whole = linked.unionByName(taken, allowMissingColumns=True).unionByName(plain, allowMissingColumns=True).select(*columns)
    return whole.mapInArrow(_write_kernel(schemas), "conv_id long, turn long, part int, kind string, call_id string, level int, status string, json string")
