"""Tool calls in conversations: linked to their results, ordered, validated, written as canonical JSON."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.batches import use_shared_folder

#: A string argument of this form stands for the result of another call of the conversation.
_REFERENCE = re.compile(r"\$([A-Za-z0-9_.:-]+)")
#: Levels of nesting that arguments and contents may have.
MAX_DEPTH = 100
_TYPES = {
    "object": dict,
    "array": list,
    "string": str,
    "boolean": bool,
    "null": type(None),
    "integer": int,
    "number": (int, float),
}


def canonical(value) -> str:
    """JSON with sorted keys, no spaces, and characters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _same(a, b) -> bool:
    """Equality of JSON values: 1 and 1.0 are the same number, and neither is true."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    return a == b


def cleaned(value, faults: set[str], depth: int = 0):
    """A parsed value that JSON and UTF-8 can hold: numbers beyond doubles and what is nested deeper than ``MAX_DEPTH``
    become null, halves of surrogate pairs the replacement character; ``faults`` gets what was found."""
    if depth > MAX_DEPTH:
        faults.add(f"nested deeper than {MAX_DEPTH}")
        return None
    if isinstance(value, float) and not math.isfinite(value):
        faults.add("number out of range")
        return None
    if isinstance(value, str):
        if any("\ud800" <= c <= "\udfff" for c in value):
            faults.add("half of a surrogate pair")
            return value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        return value
    if isinstance(value, list):
        return [cleaned(item, faults, depth + 1) for item in value]
    if isinstance(value, dict):
        return {cleaned(k, faults, depth): cleaned(item, faults, depth + 1) for k, item in value.items()}
    return value


def schema_errors(value, schema: dict, at: str = "arguments") -> list[str]:
    """What a value breaks of a JSON schema: type, enum, bounds, lengths, pattern, items, properties, required."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds or []
    fits = [k for k in kinds if isinstance(value, _TYPES[k]) and (k == "boolean" or not isinstance(value, bool))]
    if kinds and not fits:
        return [f"{at}: not {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and not any(_same(value, known) for known in schema["enum"]):
        out.append(f"{at}: not in enum")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            out.append(f"{at}: below {schema['minimum']}")
        if value > schema.get("maximum", value):
            out.append(f"{at}: above {schema['maximum']}")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{at}: shorter than {schema['minLength']}")
        if len(value) > schema.get("maxLength", len(value)):
            out.append(f"{at}: longer than {schema['maxLength']}")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at}: pattern")
    if isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            out += schema_errors(item, schema["items"], f"{at}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += schema_errors(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    return out


def _references(value) -> Iterator[str]:
    if isinstance(value, str):
        if m := _REFERENCE.fullmatch(value):
            yield m[1]
    elif isinstance(value, (list, dict)):
        for item in value.values() if isinstance(value, dict) else value:
            yield from _references(item)


def _strict(text: str):
    def refuse(constant):
        raise ValueError(constant)

    return json.loads(text, parse_constant=refuse)


def parse_message(role: str | None, text: str | None, schemas: dict[str, dict]) -> list[tuple]:
    """Items of a message: (kind, call_id, name, references, errors, body).

    An assistant's text may be {"content": ..., "tool_calls": [{"id", "name", "arguments"}, ...]}, arguments as an
    object or as its JSON; a tool's {"tool_call_id": ..., "content": ...}. All other texts are messages as they are. What
    no JSON line can hold is replaced (see ``cleaned``) and, in a call, an error of it.
    """
    plain = [("message", None, None, [], [], canonical({"role": role, "content": text}))]
    if role not in ("assistant", "tool") or not text or not text.lstrip().startswith("{"):
        return plain
    try:
        value = _strict(text)
    except (ValueError, RecursionError):
        return plain
    calls = value.get("tool_calls")
    value = cleaned({k: v for k, v in value.items() if k != "tool_calls"}, set())
    if role == "tool" and isinstance(value.get("tool_call_id"), str):
        return [("result", value["tool_call_id"], None, [], [], canonical(value.get("content")))]
    if role == "tool" or not isinstance(calls, list):
        return plain
    out = []
    if value.get("content"):
        out.append(("message", None, None, [], [], canonical({"role": role, "content": value["content"]})))
    for call in calls:
        faults: set[str] = set()
        call = cleaned(call, faults) if isinstance(call, dict) else {}
        errors = []
        call_id, name, arguments = call.get("id"), call.get("name"), call.get("arguments", {})
        if not isinstance(call_id, str):
            errors.append("id: not string")
            call_id = None
        if isinstance(arguments, str):
            try:
                arguments = cleaned(_strict(arguments), faults)
            except (ValueError, RecursionError):
                errors.append("arguments: not JSON")
        if not isinstance(name, str) or name not in schemas:
            errors.append("name: unknown")
        elif "arguments: not JSON" not in errors:
            errors += schema_errors(arguments, schemas[name])
        errors += [f"call: {fault}" for fault in sorted(faults)]
        name = name if isinstance(name, str) else None
        out.append(("call", call_id, name, sorted(set(_references(arguments))), errors, canonical({"name": name, "arguments": arguments})))
    return out


_ITEMS = "conv_id long, turn long, item int, kind string, call_id string, name string, refs array<string>, errors array<string>, body string"


def _items(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(conv, turn, i, *item) for i, item in enumerate(parse_message(role, text, schemas))]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), *[pa.string()] * 3, *[pa.list_(pa.string())] * 2, pa.string())
                names = ["conv_id", "turn", "item", "kind", "call_id", "name", "refs", "errors", "body"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return messages.mapInArrow(scan, _ITEMS)


def _heads(single: DataFrame) -> DataFrame:
    """(key, head, distance) of calls that wait for one other, given as (key, to): where their chain ends, by pointers that
    reach twice as far each round. Chains that end nowhere, being cycles, are left out."""
    pointers = single.select("key", "to", F.lit(1).cast("long").alias("distance")).checkpoint()
    rounds = pointers.count().bit_length()
    for _ in range(rounds):
        onward = pointers.select(F.col("key").alias("to"), F.col("to").alias("beyond"), F.col("distance").alias("more"))
        step = pointers.join(onward.hint("shuffle_hash"), "to", "left")
        pointers = step.select(
            "key",
            F.coalesce("beyond", "to").alias("to"),
            (F.col("distance") + F.coalesce("more", F.lit(0))).alias("distance"),
            F.col("beyond").isNotNull().alias("moved"),
        ).checkpoint()
        if pointers.filter("moved").isEmpty():
            break
    ended = pointers.join(single.select(F.col("key").alias("to")), "to", "left_anti")
    return ended.select("key", F.col("to").alias("head"), "distance")


def topological_levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, level): 0 for calls that wait for none, else one more than the highest level waited for; -1 on a cycle
    or behind one.

    ``edges`` has (child, parent) of known calls. Calls that wait for one other form trees, whose depths take a number of
    rounds that is the logarithm of the longest chain. What is left are calls that wait for several; of
    these each round settles all whose own are settled.
    """
    keys = calls.select("key").distinct().checkpoint()
    edges = edges.distinct().checkpoint()
    counted = edges.groupBy("child").agg(F.count("*").alias("n"), F.min("parent").alias("to"))
    counted = counted.select(F.col("child").alias("key"), "n", "to").checkpoint()
    single = counted.filter("n = 1").select("key", "to")
    trees = _heads(single).checkpoint()
    fresh = keys.join(counted, "key", "left_anti").withColumn("level", F.lit(0).cast("long"))
    done = [fresh]
    several = counted.filter("n > 1").select("key")
    # edges of these calls, each drawn to the head of what it waits for
    drawn = edges.join(several.select(F.col("key").alias("child")), "child", "left_semi")
    drawn = drawn.join(trees.withColumnRenamed("key", "parent"), "parent", "left")
    drawn = drawn.select(
        "child", F.coalesce("head", "parent").alias("head"), (F.coalesce("distance", F.lit(0)) + 1).alias("distance")
    ).checkpoint()
    reached = None
    while not drawn.isEmpty():
        arrived = drawn.join(fresh.withColumnRenamed("key", "head"), "head").select("child", (F.col("level") + F.col("distance")).alias("level"))
        reached = arrived if reached is None else reached.unionAll(arrived)
        reached = reached.groupBy("child").agg(F.max("level").alias("level")).checkpoint()
        drawn = drawn.join(fresh.select(F.col("key").alias("head")), "head", "left_anti").select("child", "head", "distance").checkpoint()
        fresh = reached.join(drawn.select("child").distinct(), "child", "left_anti").withColumnRenamed("child", "key").checkpoint()
        reached = reached.join(fresh.select(F.col("key").alias("child")), "child", "left_anti")
        if fresh.isEmpty():
            break
        done.append(fresh)
    settled = reduce(DataFrame.unionAll, done).checkpoint()
    behind = trees.join(settled.withColumnRenamed("key", "head"), "head").select("key", (F.col("level") + F.col("distance")).alias("level"))
    settled = settled.unionAll(behind)
    rest = keys.join(settled.select("key"), "key", "left_anti").withColumn("level", F.lit(-1).cast("long"))
    return settled.unionAll(rest)


def link_tool_calls(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per item of ``messages`` (conv_id, turn, role, text): conv_id, turn, item, kind, call_id, level, n_results,
    valid, errors, line.

    Kinds are message, call, and orphan: a result without a call. A call and its results are joined by conversation and
    identifier; the line of a call holds its first result by turn. ``level`` is the place in a topological order:
    calls sorted by conversation, level, turn and item follow all calls they refer to; messages and orphans have
    level null. Errors of a call: its schema, ``id: repeated``, ``reference: <id> unknown``, ``reference: cycle``,
    ``result: missing``, ``result: repeated``, ``result: before the call``. ``line`` is canonical JSON.

    Nulls and empty texts are messages with that content; conversations without id are one; numbers beyond doubles, deep nesting and
    halves of surrogate pairs are replaced, and in a call ``call: ...`` errors; a row that is repeated is repeated in the result, and makes
    its calls ``id: repeated``; an empty table gives no rows; further columns are not read. No conversation is
    gathered in one place: joins and combined counts by identifier do all.
    """
    use_shared_folder(messages.sparkSession)
    columns = [F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))]
    items = _items(messages.select(*columns), schemas)
    key = F.struct(F.coalesce("conv_id", F.lit(0)).alias("c"), F.col("conv_id").isNull().alias("none"), "call_id")
    items = items.withColumn("key", key).checkpoint()
    calls = items.filter("kind = 'call'")
    results = items.filter("kind = 'result'")
    known = calls.filter("call_id IS NOT NULL").groupBy("key").agg(F.count("*").alias("same"))
    answers = results.groupBy("key").agg(
        F.count("*").alias("n_results"),
        F.min(F.struct("turn", "item", "body")).alias("first"),
    )
    refs = calls.filter("call_id IS NOT NULL").select("key", F.explode("refs").alias("ref")).distinct()
    refs = refs.select(F.col("key").alias("child"), F.struct(F.col("key.c").alias("c"), F.col("key.none").alias("none"), F.col("ref").alias("call_id")).alias("parent"))
    edges = refs.join(known.select(F.col("key").alias("parent")), "parent", "left_semi").select("child", "parent")
    missing = refs.join(known.select(F.col("key").alias("parent")), "parent", "left_anti")
    missing = missing.groupBy(F.col("child").alias("key")).agg(F.array_sort(F.collect_set("parent.call_id")).alias("missing"))
    levels = topological_levels(known, edges)
    joined = calls
    for side in (known, answers, missing, levels):  # one row for each identifier
        joined = joined.join(side.hint("shuffle_hash"), "key", "left")
    note = lambda condition, text: F.when(condition, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    errors = F.concat(
        "errors",
        note(F.col("same") > 1, "id: repeated"),
        F.transform(F.coalesce("missing", F.array().cast("array<string>")), lambda m: F.concat(F.lit("reference: "), m, F.lit(" unknown"))),
        note(F.col("level") < 0, "reference: cycle"),
        note(F.col("n_results").isNull(), "result: missing"),
        note(F.col("n_results") > 1, "result: repeated"),
        note(F.col("first.turn") < F.col("turn"), "result: before the call"),
    )
    # the parts are canonical already and their keys in order
    line = F.concat(
        F.lit('{"call":'), "body", F.lit(',"id":'), F.coalesce(_quoted("call_id"), F.lit("null")),
        F.lit(',"result":'), F.coalesce("first.body", F.lit("null")), F.lit(',"turn":'), F.coalesce(F.col("turn").cast("string"), F.lit("null")), F.lit("}"),
    )
    answered = joined.select(
        "conv_id",
        "turn",
        "item",
        "kind",
        "call_id",
        F.coalesce("level", F.lit(0)).cast("int").alias("level"),
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        (F.size(errors) == 0).alias("valid"),
        F.array_join(errors, "; ").alias("errors"),
        line.alias("line"),
    )
    rest = [F.lit(None).cast("int").alias("level"), F.lit(0).cast("long").alias("n_results")]
    orphans = results.join(known.select("key"), "key", "left_anti").select(
        "conv_id",
        "turn",
        "item",
        F.lit("orphan").alias("kind"),
        "call_id",
        *rest,
        F.lit(False).alias("valid"),
        F.lit("call: missing").alias("errors"),
        F.concat(F.lit('{"content":'), "body", F.lit(',"id":'), _quoted("call_id"), F.lit(',"role":"tool"}')).alias("line"),
    )
    plain = items.filter("kind = 'message'").select(
        "conv_id", "turn", "item", "kind", "call_id", *rest, F.lit(True).alias("valid"), F.lit("").alias("errors"), F.col("body").alias("line")
    )
    return answered.unionByName(orphans).unionByName(plain)


def _quoted(column: str):
    """A string as JSON: the value of a one-field object, without the braces and the field's name."""
    written = F.to_json(F.struct(F.col(column).alias("v")))
    return F.when(F.col(column).isNotNull(), F.substring(written, F.lit(6), F.length(written) - 6))


#: The tool that ``exchanges`` makes calls of.
EXCHANGE_SCHEMAS = {
    "answer": {
        "type": "object",
        "properties": {
            "question": {"type": "string", "minLength": 1, "maxLength": 1500},
            "words": {"type": "integer", "minimum": 1, "maximum": 120},
            "context": {"type": "string", "pattern": r"^\$call_"},
        },
        "required": ["question", "words"],
        "additionalProperties": False,
    }
}


def exchanges(conversations: DataFrame) -> DataFrame:
    """The exchanges of a conversation as tool messages: (conv_id, turn, role, text).

    Every user turn is a call of ``answer``, every assistant turn the result of the call one turn before; other turns
    stay messages. A call after the first exchange refers to the call of half its exchange number.
    """
    half = F.floor(F.col("turn") / 2)
    call_id = lambda turn: F.concat(F.lit("call_"), F.col("conv_id"), F.lit("_"), turn)
    words = F.size(F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda w: w != ""))
    context = F.when(half > 0, F.concat(F.lit("$"), call_id(2 * F.floor(half / 2) + F.col("turn") % 2)))
    arguments = F.struct(context.alias("context"), F.col("text").alias("question"), words.alias("words"))
    call = F.to_json(F.struct(F.array(F.struct(call_id(F.col("turn")).alias("id"), F.lit("answer").alias("name"), arguments.alias("arguments"))).alias("tool_calls")))
    result = F.to_json(F.struct(call_id(F.col("turn") - 1).alias("tool_call_id"), F.col("text").alias("content")))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(F.col("role") == "user", "assistant").when(F.col("role") == "assistant", "tool").otherwise(F.col("role")).alias("role"),
        F.when(F.col("role") == "user", call).when(F.col("role") == "assistant", result).otherwise(F.col("text")).alias("text"),
    )
