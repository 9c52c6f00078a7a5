"""Chat formatting with linked tool calls.

Assistant messages carry calls, either as ``<tool_call>{"id", "name", "arguments"}</tool_call>``
blocks or as one JSON object with ``tool_calls``; messages of role ``tool`` carry results,
as a JSON object with ``tool_call_id``. Calls and results are hash-joined by conversation and
identifier. Messages are ordered topologically: a result after its call, and a call whose
arguments refer to another call's result (a string ``$id``) after that result; without
such a reason the order of turns stays. Arguments are validated against JSON schemas:
those that the conversation's system messages declare (``<tools>[{"name", "parameters"}]
</tools>``, or one JSON object with ``tools``), joined to its calls, else those that the
caller gives. Every message becomes one line of canonical JSON.

A conversation is never gathered in one task: the result has one row for each message and
the columns seq_turn, seq_level, turn, seq_tie order it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, picked

_BLOCK = re.compile(r"<tool_call>(.*?)</tool_call>", re.S)
_TOOLS = re.compile(r"<tools>(.*?)</tools>", re.S)
_LONE = re.compile("[\ud800-\udfff]")
#: JSON nested deeper than this counts as text that is no JSON.
MAX_DEPTH = 100
#: Edges of a conversation that is ordered in one task; larger ones are ordered in rounds.
MAX_EDGES = 20_000
#: Most characters of all schemas together; they are broadcast.
MAX_SCHEMA_CHARS = 4_000_000
_TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def canonical(value: object) -> str:
    """Sorted keys, no blanks, no escapes beyond the needed; whole floats as integers."""

    def plain(v: object) -> object:
        if isinstance(v, float) and v == v and abs(v) < 2**53 and v == int(v):
            return int(v)
        if isinstance(v, float) and (v != v or abs(v) == float("inf")):
            return None
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v

    return _utf8(json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def _utf8(text: str) -> str:
    """Lone surrogates, which UTF-8 cannot hold, as their escapes."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def schema_errors(value: object, schema: dict, at: str = "$") -> list[str]:
    """Violations of type, enum, const, required, properties, additionalProperties, items,
    minimum, maximum, minLength, maxLength and pattern, in order."""
    kind = schema.get("type")
    kinds = kind if isinstance(kind, list) else [kind] if kind else []

    def is_a(k: str) -> bool:
        if k in ("number", "integer"):
            return not isinstance(value, bool) and (isinstance(value, int) or isinstance(value, float) and (k == "number" or value.is_integer()))
        return isinstance(value, _TYPES.get(k, object))

    if kinds and not any(is_a(k) for k in kinds):
        return [f"{at}: not {'|'.join(kinds)}"]
    out = []
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        out.append(f"{at}: not in enum")
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        out.append(f"{at}: not the constant")
    if isinstance(value, dict):
        properties = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in properties:
                out += schema_errors(value[k], properties[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
            elif isinstance(schema.get("additionalProperties"), dict):
                out += schema_errors(value[k], schema["additionalProperties"], f"{at}.{k}")
    if isinstance(value, list) and isinstance(schema.get("items"), dict):
        for i, x in enumerate(value):
            out += schema_errors(x, schema["items"], f"{at}[{i}]")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if "minimum" in schema and value < schema["minimum"]:
            out.append(f"{at}: below minimum")
        if "maximum" in schema and value > schema["maximum"]:
            out.append(f"{at}: above maximum")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{at}: too short")
        if len(value) > schema.get("maxLength", len(value)):
            out.append(f"{at}: too long")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at}: no match")
    return out


def _json(text: str) -> object:
    """The value of a JSON text; None if it is none, or nested deeper than MAX_DEPTH."""
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return None
    level, depth = [value], 0
    while level:
        depth += 1
        if depth > MAX_DEPTH:
            return None
        level = [x for v in level if isinstance(v, (dict, list)) for x in (v.values() if isinstance(v, dict) else v)]
    return value


def _references(value: object) -> Iterator[str]:
    if isinstance(value, str) and len(value) > 1 and value[0] == "$":
        yield value[1:]
    elif isinstance(value, dict):
        for v in value.values():
            yield from _references(v)
    elif isinstance(value, list):
        for v in value:
            yield from _references(v)


def _checked(arguments: object, schema: dict) -> list[str]:
    """schema_errors, or one error for a schema that cannot be applied."""
    try:
        return schema_errors(arguments, schema)
    except (re.error, TypeError, AttributeError, RecursionError):
        return ["bad schema"]


def _one_call(raw: object, schemas: dict[str, dict]) -> dict:
    """id, name, arguments, errors of a call in either form."""
    if not isinstance(raw, dict):
        return {"id": None, "name": None, "arguments": None, "errors": ["not a JSON object"]}
    inner = raw.get("function") if isinstance(raw.get("function"), dict) else raw
    name, arguments = inner.get("name"), inner.get("arguments", {})
    if isinstance(arguments, str):
        parsed = _json(arguments)
        arguments = arguments if parsed is None else parsed
    errors = []
    if not isinstance(raw.get("id"), (str, int)):
        errors.append("no id")
    if not isinstance(name, str):
        errors.append("no name")
    elif name not in schemas and schemas:
        errors.append("unknown tool")
    else:
        errors += _checked(arguments, schemas.get(name, {"type": "object"}))
    return {"id": None if raw.get("id") is None else _utf8(str(raw["id"])), "name": _utf8(name) if isinstance(name, str) else None, "arguments": arguments, "errors": [_utf8(e) for e in errors]}


def declared_tools(text: str) -> list[tuple[str, str]]:
    """(name, schema as JSON) of the tools that a system message declares."""
    lists = [_json(m) for m in _TOOLS.findall(text)] if "<tools>" in text else []
    if text.lstrip()[:1] == "{" and '"tools"' in text and isinstance(whole := _json(text), dict):
        lists.append(whole.get("tools"))
    out = []
    for tool in (t for tools in lists if isinstance(tools, list) for t in tools if isinstance(t, dict)):
        tool = tool["function"] if isinstance(tool.get("function"), dict) else tool
        if isinstance(tool.get("name"), str) and isinstance(tool.get("parameters", {}), dict):
            out.append((_utf8(tool["name"]), canonical(tool.get("parameters", {}))))
    return out


def parse_message(role: str | None, text: str | None, schemas: dict[str, dict]) -> tuple[str, list[dict], str | None]:
    """(canonical JSON, calls, id that this message is the result of)."""
    body: dict[str, object] = {"role": role or "", "content": text or ""}
    calls: list[dict] = []
    result_of = None
    if role == "assistant" and text:
        if "<tool_call>" in text:
            calls = [_one_call(_json(m), schemas) for m in _BLOCK.findall(text)]
            body["content"] = _BLOCK.sub("", text).strip()
        elif text.lstrip()[:1] == "{" and '"tool_calls"' in text and isinstance(whole := _json(text), dict) and isinstance(whole.get("tool_calls"), list):
            calls = [_one_call(c, schemas) for c in whole["tool_calls"]]
            body["content"] = whole.get("content") or ""
        if calls:
            body["tool_calls"] = [{"arguments": c["arguments"], "id": c["id"], "name": c["name"]} for c in calls]
    elif role == "tool" and text and isinstance(whole := _json(text), dict) and isinstance(whole.get("tool_call_id"), (str, int)):
        result_of = _utf8(str(whole["tool_call_id"]))
        body = {"role": "tool", "content": whole.get("content"), "tool_call_id": result_of}
    return canonical(body), calls, result_of


_CALL = pa.struct([("id", pa.string()), ("name", pa.string()), ("arguments", pa.string()), ("errors", pa.list_(pa.string())), ("refs", pa.list_(pa.string()))])
_PARSED = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("tie", pa.int64()), ("message", pa.string()), ("calls", pa.list_(_CALL)), ("result_of", pa.string()), ("tools", pa.list_(pa.struct([("name", pa.string()), ("schema", pa.string())])))])
_PARSED_DDL = "conv_id long, turn long, role string, tie long, message string, calls array<struct<id:string,name:string,arguments:string,errors:array<string>,refs:array<string>>>, result_of string, tools array<struct<name:string,schema:string>>"


def parse(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row for every message; null roles and texts count as empty."""
    if len(json.dumps(schemas)) > MAX_SCHEMA_CHARS:
        raise ValueError("the schemas are too large to broadcast")
    shared = messages.sparkSession.sparkContext.broadcast(schemas)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {f: [] for f in ("message", "calls", "result_of", "tools")}
            for role, text in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist()):
                message, calls, result_of = parse_message(role, text, shared.value)
                out["message"].append(message)
                out["calls"].append([{"id": c["id"], "name": c["name"], "arguments": canonical(c["arguments"]), "errors": c["errors"], "refs": sorted(set(map(_utf8, _references(c["arguments"]))))} for c in calls])
                out["result_of"].append(result_of)
                out["tools"].append([{"name": n, "schema": j} for n, j in declared_tools(text)] if role == "system" and text else [])
            yield pa.RecordBatch.from_arrays([*(batch.column(i).cast(_PARSED.field(i).type) for i in range(4)), *(pa.array(v, _PARSED.field(k).type) for k, v in out.items())], schema=_PARSED)

    base = picked(messages, conv_id="conv_id", turn="turn", role="role", text="text").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.xxhash64("role", "text").alias("tie"), "text")
    return base.mapInArrow(run, _PARSED_DDL)


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """calls: conv_id, call_id, ...; results: conv_id, call_id, ...; full outer hash join."""
    return calls.hint("shuffle_hash").join(results.hint("shuffle_hash"), ["conv_id", "call_id"], "full_outer")


_ORDER_DDL = "node struct<conv_id:bigint,turn:bigint,tie:bigint>, seq_turn long, seq_level int, cyclic boolean"


def kahn(nodes: list[tuple], edges: list[tuple[tuple, tuple]]) -> dict[tuple, tuple[int, int, bool]]:
    """nodes: (conv, turn, tie); edges: (node, what it needs). For each node (seq_turn,
    seq_level, cyclic): the latest turn of it and all that it needs, its place among those,
    and whether it is in or behind a cycle."""
    needs: dict[tuple, int] = dict.fromkeys(nodes, 0)
    opens: dict[tuple, list[tuple]] = {}
    for node, need in edges:
        needs[node] += 1
        opens.setdefault(need, []).append(node)
    out = {n: (n[1], 0, False) for n in nodes if not needs[n]}
    at: dict[tuple, tuple[int, int]] = {}
    ready = list(out)
    while ready:
        done = ready.pop()
        for node in opens.get(done, ()):
            at[node] = max(at.get(node, out[done][:2]), out[done][:2])
            needs[node] -= 1
            if not needs[node]:
                turn, level = at[node]
                out[node] = (node[1], 0, False) if node[1] > turn else (turn, level + 1, False)
                ready.append(node)
    return out | {n: (n[1], 0, True) for n in nodes if n not in out}


def _small_orders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The order of conversations of at most MAX_EDGES edges: one group each."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["node", "needs"]).to_pylist()
        key = lambda s: (s["conv_id"], s["turn"], s["tie"])
        own = list(dict.fromkeys(key(r["node"]) for r in rows if r["needs"] is None))
        order = kahn(own, [(key(r["node"]), key(r["needs"])) for r in rows if r["needs"] is not None])
        struct = pa.array([dict(zip(("conv_id", "turn", "tie"), n)) for n in order], table.schema.field("node").type)
        turn, level, cyclic = zip(*order.values()) if order else ((), (), ())
        return pa.table({"node": struct, "seq_turn": pa.array(turn, pa.int64()), "seq_level": pa.array(level, pa.int32()), "cyclic": pa.array(cyclic, pa.bool_())})

    both = nodes.select("node", F.lit(None).cast("struct<conv_id:bigint,turn:bigint,tie:bigint>").alias("needs")).unionByName(edges.select("node", "needs"))
    return both.withColumn("conv_id", F.col("node.conv_id")).groupBy("conv_id").applyInArrow(run, _ORDER_DDL)


def _large_orders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The same in rounds of joins, each of which settles the nodes whose needs are settled."""
    needed = edges.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    waiting = cut(nodes.join(needed, "node"))
    settled = cut(nodes.join(needed, "node", "left_anti").select("node", F.col("node.turn").alias("seq_turn"), F.lit(0).alias("seq_level")))
    while not waiting.isEmpty():
        met = edges.join(settled.select(F.col("node").alias("needs"), F.struct("seq_turn", "seq_level").alias("at")), "needs")
        ready = waiting.join(met.groupBy("node").agg(F.count(F.lit(1)).alias("met"), F.max("at").alias("at")), "node").where("met = n")
        late = F.col("node.turn") > F.col("at.seq_turn")
        new = cut(ready.select("node", F.when(late, F.col("node.turn")).otherwise(F.col("at.seq_turn")).alias("seq_turn"), F.when(late, F.lit(0)).otherwise(F.col("at.seq_level") + 1).alias("seq_level")))
        if new.isEmpty():
            break
        settled = cut(settled.unionByName(new))
        waiting = cut(waiting.join(new.select("node"), "node", "left_anti"))
    cyclic = waiting.select("node", F.col("node.turn").alias("seq_turn"), F.lit(0).alias("seq_level"), F.lit(True).alias("cyclic"))
    return settled.withColumn("cyclic", F.lit(False)).unionByName(cyclic).select("node", "seq_turn", "seq_level", "cyclic")


def _levels(nodes: DataFrame, edges: DataFrame, max_edges: int) -> DataFrame:
    """nodes: node (conv_id, turn, tie); edges: node, needs. node, seq_turn, seq_level, cyclic,
    as kahn() gives them. Nodes without edges need no order."""
    held = edges.select("node").unionByName(edges.select(F.col("needs").alias("node"))).distinct()
    alone = nodes.join(held, "node", "left_anti").select("node", F.col("node.turn").alias("seq_turn"), F.lit(0).alias("seq_level"), F.lit(False).alias("cyclic"))
    large = cut(edges.groupBy(F.col("node.conv_id").alias("conv_id")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_edges).select("conv_id"))
    of = lambda df, how: df.withColumn("conv_id", F.col("node.conv_id")).join(large, "conv_id", how).drop("conv_id")
    out = alone.unionByName(_small_orders(of(held, "left_anti"), of(edges, "left_anti")))
    if not large.isEmpty():
        out = out.unionByName(_large_orders(of(held, "left_semi"), of(edges, "left_semi")))
    return out


def _invalid(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """calls: node, conv_id, call; tools: conv_id, name, schema. node, n_invalid: calls with
    errors of form, or of fit to the conversation's own tools if it declares any, else to
    those that the caller gave."""
    own = tools.groupBy("conv_id").agg(F.lit(True).alias("declares"))
    joined = calls.select("node", "conv_id", F.col("call.name").alias("name"), "call").join(tools, ["conv_id", "name"], "left").join(own, "conv_id", "left")
    shown = joined.select("node", F.col("call.arguments").alias("arguments"), "call.id", "name", "schema", F.coalesce("declares", F.lit(False)).alias("declares"), (F.size("call.errors") > 0).alias("given"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = []
            for arguments, key, name, schema, declares, given in zip(*(batch.column(i).to_pylist() for i in range(1, 7))):
                bad.append(given if not declares else key is None or name is None or schema is None or bool(_checked(_json(arguments), json.loads(schema))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bad, pa.bool_())], names=["node", "bad"])

    checked = shown.mapInArrow(run, "node struct<conv_id:bigint,turn:bigint,tie:bigint>, bad boolean")
    return checked.groupBy("node").agg(F.count_if("bad").alias("n_invalid"))


_OUT = ["conv_id", "turn", "role", "seq_turn", "seq_level", "seq_tie", "n_calls", "n_linked", "n_invalid", "result_of", "orphan", "message"]


def format_chats(messages: DataFrame, schemas: dict[str, dict] | None = None, max_edges: int = MAX_EDGES) -> DataFrame:
    """One row for every row of messages (conv_id, turn, role, text; other columns have no
    influence): conv_id, turn, role, seq_turn, seq_level, seq_tie, n_calls, n_linked,
    n_invalid, result_of, orphan, message.

    n_linked: calls that a result answers (for a result: 1 if its call exists); n_invalid:
    calls with errors; orphan: a result without its call; message: canonical JSON. Of
    calls (or results, or declared tools) that share an identifier in a conversation, the
    first by turn counts. Rows that repeat stay, with equal results. Messages in or behind a
    cycle of references keep the order of turns. Null roles and texts count as empty; rows
    without conv_id are in no conversation, so their calls have no results. JSON nested
    deeper than MAX_DEPTH, and text that is no JSON, is content like any other; lone
    surrogates become their escapes. An empty table gives an empty frame. Runs jobs only
    for messages with calls or results.
    """
    parsed = parse(messages, schemas or {})
    special = parsed.where("size(calls) > 0 OR result_of IS NOT NULL OR size(tools) > 0")
    special = cut(special.withColumn("node", F.struct("conv_id", "turn", "tie")))
    zero = F.lit(0).cast("long")
    plain = parsed.where("size(calls) = 0 AND result_of IS NULL AND size(tools) = 0").select("conv_id", "turn", "role", F.col("turn").alias("seq_turn"), F.lit(0).alias("seq_level"), F.col("tie").alias("seq_tie"), zero.alias("n_calls"), zero.alias("n_linked"), zero.alias("n_invalid"), "result_of", F.lit(False).alias("orphan"), "message")
    if special.isEmpty():
        return plain.select(_OUT)
    distinct = special.dropDuplicates(["node"])
    every = distinct.select("conv_id", "node", F.explode("calls").alias("call"))
    refs = every.select("conv_id", "node", F.explode("call.refs").alias("call_id"))
    first = lambda df: df.where("call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min_by("node", F.struct("node.turn", "node")).alias("node"))
    calls = first(every.select("conv_id", "node", F.col("call.id").alias("call_id"))).withColumnRenamed("node", "call_node")
    results = first(distinct.select("conv_id", "node", F.col("result_of").alias("call_id"))).withColumnRenamed("node", "result_node")
    linked = cut(link(calls, results))
    pairs = linked.where("call_node IS NOT NULL AND result_node IS NOT NULL")
    needs = refs.join(pairs, ["conv_id", "call_id"]).select("node", F.col("result_node").alias("needs"))
    edges = cut(pairs.select(F.col("result_node").alias("node"), F.col("call_node").alias("needs")).unionByName(needs).where("node <> needs").distinct())
    order = _levels(distinct.select("node"), edges, max_edges)
    answered = pairs.select(F.col("call_node").alias("node")).unionByName(pairs.select(F.col("result_node").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("answered"))
    declared = distinct.select("conv_id", "turn", F.explode("tools").alias("t")).where("conv_id IS NOT NULL").groupBy("conv_id", F.col("t.name").alias("name")).agg(F.min_by("t.schema", F.struct("turn", "t.schema")).alias("schema"))
    rows = special.join(order, "node").join(answered, "node", "left").join(_invalid(every, declared), "node", "left")
    found = F.coalesce("answered", zero)
    rows = rows.select("conv_id", "turn", "role", "seq_turn", "seq_level", F.col("tie").alias("seq_tie"), F.size("calls").cast("long").alias("n_calls"), found.alias("n_linked"), F.coalesce("n_invalid", zero).alias("n_invalid"), "result_of", (F.col("result_of").isNotNull() & (found == 0)).alias("orphan"), "message")
    return plain.unionByName(rows).select(_OUT)
