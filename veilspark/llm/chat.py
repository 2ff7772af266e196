"""Chat formatting: tool calls and their results linked, ordered, checked and serialised.

Messages are rows (conversation, turn, role, content, tool_calls, tool_call_id), as chat
interfaces exchange them. Calls and results meet in a hash join on conversation and
identifier. Arguments are checked against the tool's schema, and each event becomes one line
of canonical JSON: keys sorted, no white space, plain UTF-8.

The order is topological: an event stands at its own turn, or at the turn of what it needs
if that comes later, one ``step`` further. A result needs its call; a call needs the results
of the calls that its arguments name as ``"$identifier"``. Events that already follow what
they need cost nothing; the others are moved in rounds until none changes. Order is given by
the columns (``at``, ``step``, ``turn``, ``part``), so a conversation with a third of all rows is never
gathered in one task.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import store

MESSAGES = "conv_id long, turn long, role string, content string, tool_calls array<struct<id:string,name:string,arguments:string>>, tool_call_id string"
_TYPES: dict[str, Any] = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _is(value: Any, kind: str) -> bool:
    if kind == "integer":
        return not isinstance(value, bool) and (isinstance(value, int) or (isinstance(value, float) and value.is_integer()))
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, _TYPES.get(kind, object))


def violations(value: Any, schema: dict[str, Any], path: str = "$") -> list[str]:
    """What in the value breaks the schema: type, enum, bounds, lengths, items, properties."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{path}: not {' or '.join(kinds)}"]
    out = [f"{path}: not in enum"] if "enum" in schema and value not in schema["enum"] else []
    if _is(value, "number"):
        out += [f"{path}: below minimum"] if value < schema.get("minimum", value) else []
        out += [f"{path}: above maximum"] if value > schema.get("maximum", value) else []
    if isinstance(value, str):
        out += [f"{path}: too short"] if len(value) < schema.get("minLength", 0) else []
        out += [f"{path}: too long"] if len(value) > schema.get("maxLength", len(value)) else []
    if isinstance(value, list) and "items" in schema:
        out += [x for k, v in enumerate(value) for x in violations(v, schema["items"], f"{path}[{k}]")]
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{path}.{k}: unknown" for k in sorted(value) if k not in known]
        out += [x for k in sorted(value) if k in known for x in violations(value[k], known[k], f"{path}.{k}")]
    return out


def references(value: Any) -> list[str]:
    """Identifiers that the arguments name as "$identifier"."""
    if isinstance(value, str):
        return [value[1:]] if len(value) > 1 and value[0] == "$" and value[1:].replace("_", "").replace("-", "").isalnum() else []
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else []
    return [x for v in inner for x in references(v)]


#: Errors of arguments that stay a string.
UNREAD = ("$: not JSON", "$: nested too deep")


def _read(text: str | None) -> tuple[Any, list[str]]:
    try:
        return json.loads(text or ""), []
    except ValueError:
        return None, ["$: not JSON"]
    except RecursionError:
        return None, ["$: nested too deep"]


def _escaped(text: str) -> str:
    """Half characters, which JSON may name but no text can hold, as JSON escapes."""
    return re.sub("[\ud800-\udfff]", lambda half: f"\\u{ord(half[0]):04x}", text)


def _checked(value: Any, schema: Any) -> tuple[list[str], list[str]]:
    """Violations of a schema (None: not JSON) and identifiers needed; arguments nested too deep for a check are an error."""
    try:
        return (["$: schema is not JSON"] if schema is None else violations(value, schema)), sorted(set(references(value)))
    except RecursionError:
        return ["$: nested too deep"], []


def events(messages: DataFrame) -> DataFrame:
    """A row for each message without calls, each call and each result; ``part`` numbers the calls of a message."""
    has = F.coalesce(F.size("tool_calls"), F.lit(0)) > 0
    base = ["conv_id", "turn", "role"]
    none = F.lit(None).cast("string")
    calls = messages.where(has).select(*base, F.posexplode("tool_calls").alias("part", "c")).select(
        *base, F.col("part").cast("long"), F.lit("call").alias("kind"), F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("content"))
    said = messages.where(~has | (F.coalesce("content", F.lit("")) != ""))
    kind = F.when(F.col("tool_call_id").isNotNull(), "result").otherwise("message")
    rest = said.select(*base, F.lit(-1).cast("long").alias("part"), kind.alias("kind"), F.col("tool_call_id").alias("call_id"), none.alias("name"), "content")
    return calls.unionByName(rest)


def format_chats(messages: DataFrame, tools: DataFrame) -> DataFrame:
    """One row per event: conv_id, turn, part, kind, call_id, status, at, step, cyclic, valid, errors, json.

    ``tools`` holds (name, schema as JSON). Status of a call: ``linked``, ``unanswered`` or
    ``duplicate`` (its identifier was used by an earlier call of the conversation, which keeps
    it); of a result: ``linked`` or ``orphan``; of a message: ``plain``. A null identifier
    links with nothing. Several results of one call are all linked. ``valid`` is null except
    for calls; a call of an unknown tool, or whose arguments are not JSON, is not valid, and
    its arguments stay a string; so does one nested too deep to be read. Lone halves of characters
    are written as escapes. Against a schema that is not JSON no call is valid. Null contents are null in JSON. Events that need each other
    in a circle are ``cyclic`` and stay at their own turn. Repeated rows stay repeated.
    """
    every = store(_parsed(events(messages.select("conv_id", "turn", "role", "content", "tool_calls", "tool_call_id")), tools), "events")
    named = every.where(F.col("call_id").isNotNull())
    first = named.where("kind = 'call'").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "part")).alias("first"))
    answers = named.where("kind = 'result'").groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("answers"), F.max("turn").alias("answered"))
    calls = first.join(answers, ["conv_id", "call_id"], "left")
    rows = every.join(calls, ["conv_id", "call_id"], "left")
    own = F.struct("turn", "part") == F.col("first")
    status = (
        F.when(F.col("kind") == "message", "plain")
        .when(F.col("kind") == "result", F.when(F.col("first").isNotNull(), "linked").otherwise("orphan"))
        .when(~F.coalesce(own, F.lit(True)), "duplicate")
        .when(F.col("answers") > 0, "linked").otherwise("unanswered"))
    rows = rows.withColumn("status", status)
    late = (F.col("kind") == "result") & (F.col("first.turn") >= F.col("turn"))
    rows = rows.withColumn("at", F.when(late, F.col("first.turn")).otherwise(F.col("turn"))).withColumn("step", F.when(late, 1).otherwise(0))
    rows = _moved(rows)
    return rows.select("conv_id", "turn", "part", "kind", "call_id", "status", "at", "step", "cyclic", "valid", "errors", "json")


def _parsed(rows: DataFrame, tools: DataFrame) -> DataFrame:
    """Adds the check of arguments, the references and the canonical line."""
    schemas = tools.groupBy("name").agg(F.min("schema").alias("schema"))
    rows = rows.join(schemas, "name", "left").select("conv_id", "turn", "part", "role", "kind", "call_id", "name", "content", "schema")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Any] = {}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                line: dict[str, Any] = {"role": r["role"], "content": r["content"]}
                errors: list[str] | None = None
                needs: list[str] = []
                if r["kind"] == "call":
                    value, errors = _read(r["content"])
                    if r["schema"] is None:
                        errors = [*errors, "$: unknown tool"]
                    elif not errors:
                        if r["schema"] not in known:
                            known[r["schema"]] = _read(r["schema"])[0]
                        errors, needs = _checked(value, known[r["schema"]])
                    if not needs and r["schema"] is None:
                        needs = _checked(value, {})[1]
                    given = r["content"] if errors and errors[0] in UNREAD else value
                    line = {"role": r["role"], "tool_call": {"id": r["call_id"], "name": r["name"], "arguments": given}}
                elif r["kind"] == "result":
                    line["tool_call_id"] = r["call_id"]
                try:
                    text = canonical(line)
                except (ValueError, RecursionError) as wrong:  # NaN or infinity among the arguments, or too deep
                    errors = [*(errors or []), "$: not a JSON number" if isinstance(wrong, ValueError) else "$: nested too deep"]
                    line["tool_call"]["arguments"] = r["content"]
                    text = canonical(line)
                text, errors = _escaped(text), errors and [_escaped(e) for e in errors]
                out.append({k: r[k] for k in ("conv_id", "turn", "part", "kind", "call_id")} | {"needs": needs, "valid": None if errors is None else not errors, "errors": errors or [], "json": text})
            yield pa.RecordBatch.from_pylist(out, pa.schema([
                ("conv_id", batch.schema.field("conv_id").type), ("turn", pa.int64()), ("part", pa.int64()), ("kind", pa.string()), ("call_id", pa.string()),
                ("needs", pa.list_(pa.string())), ("valid", pa.bool_()), ("errors", pa.list_(pa.string())), ("json", pa.string())]))

    kind = rows.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"conv_id {kind}, turn long, part long, kind string, call_id string, needs array<string>, valid boolean, errors array<string>, json string")


def _moved(rows: DataFrame) -> DataFrame:
    """Moves calls behind the results they need, and results behind moved calls; marks circles."""
    nodes = ["conv_id", "call_id"]
    own = F.col("kind").eqNullSafe("call") & (F.col("status") != "duplicate")
    edges = rows.where(own & (F.size("needs") > 0)).select("conv_id", F.col("call_id").alias("to"), F.explode("needs").alias("from")).distinct()
    edges = store(edges, "edges")
    plain = rows.withColumn("cyclic", F.lit(False))
    if edges.isEmpty():
        return plain
    # A call's own position, the last turn of its results, and its latest position so far.
    calls = rows.where(own & F.col("call_id").isNotNull()).select(*nodes, F.col("turn").alias("own"), F.col("answered"), F.struct("turn", F.lit(0).alias("step")).alias("key"))
    state, busy = store(calls, "order"), edges.groupBy("conv_id").agg((F.count(F.lit(1)) + 1).alias("most"))
    while True:
        ready = F.when(F.col("answered") > F.col("key.turn"), F.struct(F.col("answered").alias("turn"), F.lit(0).alias("step"))).otherwise(
            F.struct(F.col("key.turn").alias("turn"), (F.col("key.step") + F.when(F.col("answered").isNull(), 0).otherwise(1)).alias("step")))
        given = state.select("conv_id", F.col("call_id").alias("from"), ready.alias("ready"))
        asked = edges.join(given, ["conv_id", "from"]).groupBy("conv_id", F.col("to").alias("call_id")).agg(F.max(F.struct("ready.turn", (F.col("ready.step") + 1).alias("step"))).alias("need"))
        moved = state.join(asked, nodes, "left").join(busy, "conv_id", "left")
        ahead = F.col("need.turn").isNotNull() & (F.col("need.turn") >= F.col("own")) & (F.col("need") > F.col("key")) & (F.col("key.step") <= 2 * F.col("most"))
        after = store(moved.select(*nodes, "own", "answered", F.when(ahead, F.col("need")).otherwise(F.col("key")).alias("key"), ahead.alias("ahead"), (F.col("key.step") > 2 * F.col("most")).alias("cyclic")), "order")
        if after.where("ahead").isEmpty():
            break
        state = after.drop("ahead", "cyclic")
    order = after.select(*nodes, "key", F.coalesce("cyclic", F.lit(False)).alias("circle"))
    joined = rows.join(order, nodes, "left")
    follows = (F.col("kind") == "result") & (F.col("key.turn") >= F.col("turn"))
    moves = (F.col("kind") == "call") & (F.col("status") != "duplicate") & F.col("key").isNotNull() & ~F.col("circle")
    return joined.withColumn("at", F.when(moves, F.col("key.turn")).when(follows & ~F.col("circle"), F.col("key.turn")).otherwise(F.col("at"))).withColumn(
        "step", F.when(moves, F.col("key.step")).when(follows & ~F.col("circle"), F.col("key.step") + 1).otherwise(F.col("step")).cast("int")).withColumn("cyclic", F.coalesce("circle", F.lit(False)) & (F.col("kind") != "message"))
