"""Operator 5, chat formatting: links tool calls to their results and writes canonical JSON.

Messages are parsed to parts: plain messages, calls, results, and the tools that a system message declares. Results
are hash-joined to calls by conversation and identifier, and calls to their tools' schemas by conversation and
name, against which their arguments are validated; calls that refer to other calls' results ({"$ref": id} in their arguments) wait
for them. Places are found by rounds of joins over tool parts only, so neither a long conversation nor one that
holds most rows meets in a task. Output is a row for each part, in an order given by its columns.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagstream.llm.common import Stages, read_table

_TOOLS = re.compile(r"<tools>(.*?)</tools>", re.S)
_CALL = re.compile(r"<tool_call>(.*?)</tool_call>", re.S)
_RESULT = re.compile(r"<tool_response>(.*?)</tool_response>", re.S)


def canonical(value) -> str:
    """JSON with sorted keys, no white space, and one form for each number."""

    def plain(v):
        if isinstance(v, float):
            if not math.isfinite(v):
                raise ValueError("not a JSON number")
            return int(v) if v == int(v) and abs(v) < 1 << 53 else v
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def violation(value, schema: Mapping | bool, at: str = "$") -> str | None:
    """The first breach of a JSON schema (type, enum, const, bounds, lengths, pattern, properties, required,
    additionalProperties, items, anyOf), or None."""
    if isinstance(schema, bool):
        return None if schema else f"{at}: nothing is allowed"
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
    if (types := schema.get("type")) is not None:
        names = types if isinstance(types, list) else [types]

        def fits(name: str) -> bool:
            if name in ("integer", "number"):
                return isinstance(value, (int, float)) and not isinstance(value, bool) and (name == "number" or float(value).is_integer())
            return isinstance(value, kinds.get(name, ()))

        if not any(fits(n) for n in names):
            return f"{at}: not {'|'.join(names)}"
    if "enum" in schema and not any(canonical(value) == canonical(x) for x in schema["enum"]):
        return f"{at}: not in enum"
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        return f"{at}: not the constant"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        for name, bad in (("minimum", lambda a, b: a < b), ("maximum", lambda a, b: a > b), ("exclusiveMinimum", lambda a, b: a <= b), ("exclusiveMaximum", lambda a, b: a >= b)):
            if name in schema and bad(value, schema[name]):
                return f"{at}: {name}"
    if isinstance(value, (str, list)):
        low, high = ("minLength", "maxLength") if isinstance(value, str) else ("minItems", "maxItems")
        if len(value) < schema.get(low, 0) or len(value) > schema.get(high, math.inf):
            return f"{at}: length"
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        return f"{at}: pattern"
    if isinstance(value, dict):
        for name in schema.get("required", []):
            if name not in value:
                return f"{at}.{name}: missing"
        known = schema.get("properties", {})
        for name in sorted(value):
            inner = known.get(name, schema.get("additionalProperties", True))
            if (found := violation(value[name], inner, f"{at}.{name}")) is not None:
                return found
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            if (found := violation(x, schema["items"], f"{at}[{i}]")) is not None:
                return found
    if "anyOf" in schema and all(violation(value, s, at) for s in schema["anyOf"]):
        return f"{at}: anyOf"
    return None


def _refs(value) -> set[str]:
    if isinstance(value, dict):
        own = {str(value["$ref"])} if set(value) == {"$ref"} else set()
        return own.union(*map(_refs, value.values()))
    return set().union(*map(_refs, value)) if isinstance(value, list) else set()


def _loads(text: str):
    try:
        return json.loads(text, parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)))
    except (ValueError, RecursionError):
        return None


def parse(role: str | None, text: str | None) -> list[dict]:
    """Parts of a message. Calls: a JSON text {"tool_calls": [...]} or <tool_call> blocks of an assistant; results:
    a JSON text with tool_call_id, or <tool_response> blocks, of a tool. All else is one plain message, followed
    by a part for each tool that a <tools> list in a system message declares (json: its schema of arguments)."""
    role, text = role or "", text or ""
    out: list[dict] = []

    def call(item) -> None:
        spec = item.get("function", item) if isinstance(item, dict) else {}
        arguments = spec.get("arguments", {}) if isinstance(spec, dict) else {}
        if isinstance(arguments, str):
            arguments = _loads(arguments)
        name = spec.get("name") if isinstance(spec, dict) else None
        error = None
        if not isinstance(name, str):
            error = "no name"
        elif not isinstance(arguments, dict):
            error, arguments = "arguments are no object", {}
        key = item.get("id") if isinstance(item, dict) else None
        arguments = arguments if isinstance(arguments, dict) else {}
        out.append({"kind": "call", "call_id": None if key is None else str(key), "name": name if isinstance(name, str) else None, "error": error, "refs": sorted(_refs(arguments)),
                    "json": {"arguments": arguments, "id": key, "name": name, "role": role, "type": "tool_call"}})

    def result(item) -> None:
        key = item.get("tool_call_id", item.get("id"))
        out.append({"kind": "result", "call_id": None if key is None else str(key), "name": None, "error": None, "refs": [],
                    "json": {"content": item.get("content"), "role": role, "tool_call_id": key, "type": "tool_result"}})

    def message(content: str) -> None:
        out.append({"kind": "message", "call_id": None, "name": None, "error": None, "refs": [], "json": {"content": content, "role": role, "type": "message"}})

    whole = _loads(text) if text.lstrip()[:1] == "{" and "tool_call" in text else None
    if isinstance(whole, dict) and role == "assistant" and isinstance(whole.get("tool_calls"), list):
        if whole.get("content"):
            message(str(whole["content"]))
        for item in whole["tool_calls"]:
            call(item)
    elif isinstance(whole, dict) and role == "tool" and "tool_call_id" in whole:
        result(whole)
    elif (role == "assistant" and "<tool_call>" in text) or (role == "tool" and "<tool_response>" in text):
        pattern, take = (_CALL, call) if role == "assistant" else (_RESULT, result)
        at = 0
        for found in pattern.finditer(text):
            if text[at:found.start()].strip():
                message(text[at:found.start()].strip())
            item = _loads(found[1])
            take(item if isinstance(item, dict) else {})
            at = found.end()
        if text[at:].strip():
            message(text[at:].strip())
    if not out:
        message(text)
    for found in _TOOLS.finditer(text) if role == "system" else ():
        listed = _loads(found[1])
        for item in listed if isinstance(listed, list) else [listed]:
            spec = item.get("function", item) if isinstance(item, dict) else {}
            if isinstance(spec, dict) and isinstance(spec.get("name"), str):
                out.append({"kind": "tool", "call_id": None, "name": spec["name"], "error": None, "refs": [], "json": spec.get("parameters", {})})
    return out


def parts(turns: DataFrame) -> DataFrame:
    """A row for each part: conv_id, turn, part, kind, call_id, name, error, refs, json."""
    fields = [("conv_id", pa.int64()), ("turn", pa.int64()), ("part", pa.int32()), ("kind", pa.string()), ("call_id", pa.string()), ("name", pa.string()), ("error", pa.string()), ("refs", pa.list_(pa.string())), ("json", pa.string())]
    schema = pa.schema(fields)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                for i, p in enumerate(parse(role, text)):
                    try:
                        body = canonical(p["json"])
                    except (ValueError, RecursionError):
                        body, p["error"] = canonical({"role": role or "", "type": p["kind"]}), p["error"] or "no JSON"
                    rows.append((conv, turn, i, p["kind"], p["call_id"], p["name"], p["error"], p["refs"], body.encode("utf-8", "replace").decode()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], schema=schema)

    kind = "conv_id long, turn long, part int, kind string, call_id string, name string, error string, refs array<string>, json string"
    return turns.mapInArrow(scan, kind)


def validated(calls: DataFrame, declared: DataFrame, schemas: Mapping[str, Mapping]) -> DataFrame:
    """calls with error: the first breach of the schema that their conversation declares (declared: conv_id, name, schema)
    for their tool, or of schemas where it declares no tool at all; a tool of neither is unknown, and without schemas any is allowed."""
    own = declared.select(F.col("conv_id").alias("dc"), F.col("name").alias("dn"), "schema")
    some = declared.select(F.col("conv_id").alias("sc")).distinct().withColumn("declares", F.lit(True))
    joined = (calls.join(own, (F.col("conv_id") == F.col("dc")) & (F.col("name") == F.col("dn")), "left").join(some, F.col("conv_id") == F.col("sc"), "left")
              .select(*calls.columns, "schema", F.coalesce("declares", F.lit(False)).alias("declares")))
    names = calls.columns
    at, body = names.index("error"), names.index("json")

    def breach(arguments: str, name: str, schema: str | None, declares: bool) -> str | None:
        found = _loads(schema) if schema is not None else None if declares else schemas.get(name)
        if found is None:
            return "unknown tool" if declares or schemas else None
        try:
            return violation(_loads(arguments)["arguments"], found) if isinstance(found, (Mapping, bool)) else "unusable schema"
        except (TypeError, ValueError, AttributeError, KeyError, RecursionError, re.error):
            return "unusable schema"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, schema, declares = batch.columns
            name = batch.column("name").to_pylist()
            errors = [e if e is not None else breach(*x) for e, *x in zip(columns[at].to_pylist(), columns[body].to_pylist(), name, schema.to_pylist(), declares.to_pylist())]
            columns[at] = pa.array(errors, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(scan, calls.schema)


def link(turns: DataFrame, schemas: Mapping[str, Mapping] | None = None) -> DataFrame:
    """Formatted parts of conversations (conv_id, turn, role, text): conv_id, slot, level, turn, part, kind, call_id,
    linked_turn, status, json. Sorting by (conv_id, slot, level, turn, part) is a topological order.

    A result is linked to the first call (by turn and part) of its conversation and identifier, and has that
    call's turn as linked_turn; a call has its first result's. status is ok; for calls a breach of their tool's schema
    (see validated; of two declarations in a conversation the first counts), no id, or unanswered; for results no call; for parts that wait for
    each other, or for such parts, cycle (in their own turn, level 0). There is a round for each part of the longest
    chain. slot is the turn a part can stand in: its own, or that of what it waits for, if later;
    level its place among parts of that slot. Null roles and texts are empty; null conv_id or turn never link
    and keep null. Repeated rows each return, and link alike. An empty table gives no rows; other columns are
    ignored.
    """
    spark = turns.sparkSession
    stages = Stages(spark, "toolcalls")
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    every = parts(rows)
    plain = every.where("kind = 'message'").select("conv_id", F.col("turn").alias("slot"), F.lit(0).alias("level"), "turn", "part", "kind", "call_id", F.lit(None).cast("long").alias("linked_turn"), F.lit("ok").alias("status"), "json")
    tools = stages.put(every.where("kind <> 'message'"), "parts")
    declared = tools.where("kind = 'tool' and conv_id is not null").groupBy("conv_id", "name").agg(F.min(F.struct("turn", "part", "json")).alias("first")).select("conv_id", "name", F.col("first.json").alias("schema"))
    tools = stages.put(validated(tools.where("kind = 'call'"), declared, dict(schemas or {})).unionByName(tools.where("kind = 'result'")), "tools")
    where = F.struct("turn", "part")
    keyed = tools.where("call_id is not null and conv_id is not null and turn is not null")
    first = keyed.groupBy("conv_id", "call_id").agg(F.min(F.when(F.col("kind") == "call", where)).alias("c"), F.min(F.when(F.col("kind") == "result", where)).alias("r"))
    first = stages.put(first.select(F.col("conv_id").alias("fc"), F.col("call_id").alias("fi"), "c", "r"), "first")
    key = lambda a, b: F.xxhash64(a, b)
    # nodes are (conversation, id, kind); an edge says what a node waits for
    waits = keyed.where("kind = 'call'").select("conv_id", "call_id", F.explode("refs").alias("ref")).distinct()
    calls = first.where("c is not null").select("fc", "fi", F.lit("call").alias("kind"), F.col("c.turn").alias("own"))
    results = first.where("r is not null").select("fc", "fi", F.lit("result").alias("kind"), F.col("r.turn").alias("own"))
    nodes = stages.put(calls.unionByName(results).select("*", F.col("own").alias("slot"), F.lit(0).alias("level"), F.lit(-1).alias("last")), "nodes")  # last: the round a place was found in
    edges = (first.where("c is not null and r is not null").select(F.col("fc").alias("ec"), F.col("fi").alias("ei"), F.lit("result").alias("ek"), F.col("fi").alias("bi"), F.lit("call").alias("bk"))
             .unionByName(waits.select(F.col("conv_id").alias("ec"), F.col("call_id").alias("ei"), F.lit("call").alias("ek"), F.col("ref").alias("bi"), F.lit("result").alias("bk"))))
    edges = stages.put(edges, "edges")
    # a round places what waits for nothing, or for placed nodes only; what no round places waits for a cycle
    turn = 0
    while True:
        before = nodes.select(F.col("fc").alias("c2"), F.col("fi").alias("i2"), F.col("kind").alias("k2"), F.col("slot").alias("s2"), F.col("level").alias("l2"), (F.col("last") < 0).alias("o2"))
        need = (edges.join(before, (F.col("ec") == F.col("c2")) & (F.col("bi") == F.col("i2")) & (F.col("bk") == F.col("k2")))
                .groupBy("ec", "ei", "ek").agg(F.max(F.struct(F.col("s2").alias("s"), (F.col("l2") + 1).alias("l"))).alias("need"), F.max("o2").alias("open")))
        own = F.struct(F.col("own").alias("s"), F.lit(0).alias("l"))
        after = (nodes.join(need, (F.col("fc") == F.col("ec")) & (F.col("fi") == F.col("ei")) & (F.col("kind") == F.col("ek")), "left")
                 .withColumn("at", F.greatest(own, F.coalesce("need", own))))
        now = (F.col("last") < 0) & ~F.coalesce("open", F.lit(False))
        after = stages.put(after.select("fc", "fi", "kind", "own", F.when(now, F.col("at.s")).otherwise(F.col("slot")).alias("slot"), F.when(now, F.col("at.l")).otherwise(F.col("level")).alias("level"),
                                        F.when(now, turn).otherwise(F.col("last")).alias("last")), "nodes")
        stages.drop(nodes)
        nodes = after
        left = nodes.agg(F.sum((F.col("last") == turn).cast("long")), F.sum((F.col("last") < 0).cast("long"))).first()
        if not left[0] or not left[1]:
            break
        turn += 1
    cycle = F.col("last") < 0
    at = stages.put(nodes.select(F.col("fc").alias("nc"), F.col("fi").alias("ni"), F.col("kind").alias("nk"), "slot", "level", cycle.alias("cycle")), "places")
    linked = (tools.join(first, (key(tools["conv_id"], tools["call_id"]) == key(first["fc"], first["fi"])) & (F.col("conv_id") == F.col("fc")) & (F.col("call_id") == F.col("fi")), "left")
              .join(at, (F.col("conv_id") == F.col("nc")) & (F.col("call_id") == F.col("ni")) & (F.col("kind") == F.col("nk")), "left"))
    is_call = F.col("kind") == "call"
    status = (F.when(is_call & F.col("error").isNotNull(), F.col("error")).when(F.col("call_id").isNull(), F.lit("no id")).when(F.coalesce("cycle", F.lit(False)), F.lit("cycle"))
              .when(is_call & F.col("r").isNull(), F.lit("unanswered")).when(~is_call & F.col("c").isNull(), F.lit("no call")).otherwise(F.coalesce("error", F.lit("ok"))))
    linked = linked.select("conv_id", F.greatest(F.coalesce("slot", "turn"), "turn").alias("slot"), F.coalesce(F.when(F.coalesce("slot", "turn") >= F.col("turn"), F.col("level")), F.lit(0)).alias("level"), "turn", "part", "kind", "call_id",
                           F.when(is_call, F.col("r.turn")).otherwise(F.col("c.turn")).alias("linked_turn"), status.alias("status"), "json")
    return stages.finish(plain.unionByName(linked))


def op5_tool_calls(spark, sf_dir: str) -> DataFrame:
    """Whole `conversations`, in topological order: conv_id, slot, level, turn, part, kind, call_id, linked_turn, status, json."""
    return link(read_table(spark, sf_dir, "conversations")).orderBy("conv_id", "slot", "level", "turn", "part")


def derived_calls(conversations: DataFrame) -> DataFrame:
    """Conversations with tool calls, made of plain ones by a rule, to hold link() against SQL.

    An assistant's turn becomes a call of `reply`, with id c<turn>, the length of its text, and a reference to the
    call before; a user's turn right after it becomes its result. A system turn declares `reply`, with at most 900
    characters. Where the text of the first turn has an even length, the first call refers to the last one."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    whole = Window.partitionBy("conv_id")
    call = F.col("role") == "assistant"
    name = lambda turn: F.concat(F.lit("c"), turn.cast("string"))
    before = F.max(F.when(call, F.col("turn"))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    even = F.first(F.length("text") % 2 == 0).over(by)
    c = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    c = c.select("*", F.coalesce(before, F.when(even, F.max(F.when(call, F.col("turn"))).over(whole))).alias("ref"), F.lag("role").over(by).alias("role0"), F.lag("turn").over(by).alias("turn0"))
    arguments = F.struct(F.length("text").alias("chars"), F.when(F.col("ref").isNotNull(), F.struct(name(F.col("ref")).alias("$ref"))).alias("after"))
    made = F.to_json(F.struct(F.array(F.struct(name(F.col("turn")).alias("id"), F.struct(F.lit("reply").alias("name"), arguments.alias("arguments")).alias("function"))).alias("tool_calls")))
    answer = (F.col("role") == "user") & (F.col("role0") == "assistant")
    tools = '<tools>[{"name": "reply", "parameters": {"type": "object", "properties": {"chars": {"type": "integer", "maximum": 900}}, "required": ["chars"]}}]</tools>'
    text = (F.when(call, made).when(answer, F.to_json(F.struct(name(F.col("turn0")).alias("tool_call_id"), F.col("text").alias("content"))))
            .when(F.col("role") == "system", F.lit(tools)).otherwise(F.col("text")))
    return c.select("conv_id", "turn", F.when(answer, "tool").otherwise(F.col("role")).alias("role"), text.alias("text"))


def tool_calls_derived(spark, sf_dir: str) -> DataFrame:
    """Calls and results that link() finds in derived_calls of whole `conversations`."""
    linked = link(derived_calls(read_table(spark, sf_dir, "conversations"))).where("kind <> 'message'")
    return linked.select("conv_id", "turn", "kind", "call_id", "linked_turn", "status", "slot")


TOOL_CALLS_DERIVED_SQL = """
WITH RECURSIVE t AS (
  SELECT conv_id, turn, role, length(coalesce(text, '')) n, lag(role) OVER w role0, lag(turn) OVER w turn0, first_value(length(coalesce(text, ''))) OVER w % 2 = 0 even
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT DISTINCT conv_id FROM t WHERE role = 'system'),
a AS (SELECT conv_id, turn, n, coalesce(lag(turn) OVER (PARTITION BY conv_id ORDER BY turn), CASE WHEN even THEN max(turn) OVER (PARTITION BY conv_id) END) ref FROM t WHERE role = 'assistant'),
r AS (SELECT conv_id, turn, turn0 call FROM t WHERE role = 'user' AND role0 = 'assistant'),
e AS (SELECT conv_id, turn x, call y FROM r UNION ALL SELECT a.conv_id, a.turn, r.turn FROM a JOIN r ON r.conv_id = a.conv_id AND r.call = a.ref),
w(conv_id, x, y) AS (SELECT * FROM e UNION SELECT w.conv_id, w.x, e.y FROM w JOIN e ON e.conv_id = w.conv_id AND e.x = w.y),
loops AS (SELECT conv_id, x FROM w WHERE x = y),
stuck AS (SELECT conv_id, x FROM loops UNION SELECT w.conv_id, w.x FROM w JOIN loops l ON l.conv_id = w.conv_id AND l.x = w.y),
late AS (SELECT conv_id, x, max(y) y FROM w GROUP BY conv_id, x),
p AS (
  SELECT a.conv_id, a.turn, 'call' kind, 'c' || a.turn call_id, r.turn linked_turn, n > 900 AND a.conv_id IN (SELECT conv_id FROM s) broken FROM a LEFT JOIN r ON r.conv_id = a.conv_id AND r.call = a.turn
  UNION ALL SELECT conv_id, turn, 'result', 'c' || call, call, false FROM r)
SELECT p.conv_id, p.turn, kind, call_id, linked_turn,
  CASE WHEN broken THEN '$.chars: maximum' WHEN stuck.x IS NOT NULL THEN 'cycle' WHEN kind = 'call' AND linked_turn IS NULL THEN 'unanswered' ELSE 'ok' END status,
  CASE WHEN stuck.x IS NOT NULL THEN p.turn ELSE greatest(p.turn, coalesce(late.y, p.turn)) END slot
FROM p LEFT JOIN stuck ON stuck.conv_id = p.conv_id AND stuck.x = p.turn LEFT JOIN late ON late.conv_id = p.conv_id AND late.x = p.turn
"""
