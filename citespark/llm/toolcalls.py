"""Chat formatting: tool calls linked to their results.

Calls and results are joined by (conversation, identifier). A call may name the call it waits for; the levels of the
resulting forest come from pointer doubling: in each round every call looks up the ancestor of its ancestor, so a chain
of n calls takes log2(n) joins and no conversation is ever gathered in one task. Sorted by (level, turn) a conversation
is in topological order. Arguments are checked against the schema of their tool and written as canonical JSON: sorted
keys, no white space, plain UTF-8, whole numbers without fraction.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citespark.llm.common import bounded_batches, query, table
from citespark.session import cut_lineage

TYPES = {"string": str, "boolean": bool, "array": list, "object": dict, "null": type(None)}


def canonical(value) -> str:
    def plain(x):
        if isinstance(x, float) and math.isfinite(x) and x == int(x) and abs(x) < 2**53:
            return int(x)
        if isinstance(x, float) and not math.isfinite(x):
            return None
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def finite(text: str) -> float:
    number = float(text)
    if not math.isfinite(number):
        raise ValueError("no finite number")
    return number


def parsed(text: str):
    """The value of a JSON text; ValueError if it is none, has no finite number, or has text that UTF-8 cannot hold."""
    try:
        value = json.loads(text, parse_float=finite, parse_constant=finite)
        canonical(value).encode("utf-8")
    except RecursionError as deep:
        raise ValueError("nested too deeply") from deep
    return value


def errors(value, schema: dict, at: str = "$") -> list[str]:
    """What in ``value`` breaks a schema of type, properties, required, additionalProperties, items, enum, bounds."""
    found, kinds = [], schema.get("type")
    if kinds is not None:
        def fits(kind):
            if kind in ("number", "integer"):
                number = isinstance(value, (int, float)) and not isinstance(value, bool)
                return number and (kind == "number" or math.isfinite(value) and value == int(value))
            return isinstance(value, TYPES.get(kind, ()))  # no value is of a type that is not known

        if not any(map(fits, [kinds] if isinstance(kinds, str) else kinds)):
            return [f"{at}: not of type {kinds}"]
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        found.append(f"{at}: not one of the values")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                found += errors(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                found.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for k, x in enumerate(value):
            found += errors(x, schema["items"], f"{at}[{k}]")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if "minimum" in schema and value < schema["minimum"]:
            found.append(f"{at}: below the minimum")
        if "maximum" in schema and value > schema["maximum"]:
            found.append(f"{at}: above the maximum")
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        found.append(f"{at}: too short")
    return found


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls (conv_id, call_id, after); null for calls on a cycle or behind one.

    A call whose ``after`` is null or names no call of the conversation has level 0. Ids are unique in a conversation.
    """
    known = calls.select("conv_id", F.col("call_id").alias("after"), F.lit(0).alias("hit"))
    now = cut_lineage(calls.select("conv_id", "call_id", "after").join(known, ["conv_id", "after"], "left").select(
        "conv_id", "call_id", F.when(F.col("hit").isNotNull(), F.col("after")).alias("up"),
        F.when(F.col("hit").isNotNull(), 1).otherwise(0).cast("long").alias("level")))
    # After r rounds a pointer has gone up 2**r calls; one that is still on its way after all calls are used is on a cycle.
    most, gone = now.count(), 1
    while gone <= most:
        open_rows = now.where("up IS NOT NULL")
        if not open_rows.take(1):
            break
        next_up = now.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("upper"),
                             F.col("level").alias("more"))
        now = cut_lineage(now.where("up IS NULL").union(open_rows.join(next_up, ["conv_id", "up"]).select(
            "conv_id", "call_id", F.col("upper").alias("up"), (F.col("level") + F.col("more")).alias("level"))))
        gone *= 2
    return now.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("level")).alias("level"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """(conv_id, level, turn, call_id, status, errors, n_results, json) per call, and per result without a call.

    ``calls``: conv_id, turn, call_id, name, arguments (JSON text), after (call_id or null). ``results``: conv_id, turn,
    call_id, content. Of calls with one id in a conversation the first by turn counts, the others come back with status
    ``repeated``; of several results the first by turn is linked, ``n_results`` counts all, and the others come back as
    ``repeated result``. Arguments that are no JSON, nested too deeply, or with numbers or characters that JSON in UTF-8
    cannot hold are ``invalid`` and kept as text. Status is ``ok``, or the
    first that applies of ``repeated``, ``cycle``, ``unknown tool``, ``invalid`` (arguments), ``no result``; results
    without a call are ``orphan``. ``json`` is the canonical line of call and result. Null conversations or ids link to
    nothing: such calls are ``no result``, such results ``orphan``. Ties go to the least content. Empty tables give no
    rows; further columns are ignored.
    """
    calls = cut_lineage(calls.select("conv_id", F.col("turn").cast("long").alias("turn"), "call_id", "name", "arguments",
                                     "after"))
    results = results.select("conv_id", F.col("turn").cast("long").alias("turn"), "call_id", "content")
    row = F.struct("turn", "name", "arguments", "after")
    named = calls.where("conv_id IS NOT NULL AND call_id IS NOT NULL")
    first = named.groupBy("conv_id", "call_id").agg(F.min(row).alias("row"), F.count("*").alias("times"))
    first = cut_lineage(first.select("conv_id", "call_id", "row.*", "times"))
    # All but the first row of an id, counted per distinct row so that exact repeats stay.
    again = named.groupBy("conv_id", "call_id", "turn", "name", "arguments", "after").agg(F.count("*").alias("n"))
    again = again.join(first.where("times > 1").select("conv_id", "call_id", row.alias("kept")), ["conv_id", "call_id"])
    again = again.withColumn("n", F.col("n") - F.when(row.eqNullSafe(F.col("kept")), 1).otherwise(0)).where("n > 0")
    again = again.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    answer = results.where("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(
        F.min(F.struct("turn", "content")).alias("answer"), F.count("*").alias("n_results"))
    level = levels(first)
    whole = first.join(level, ["conv_id", "call_id"]).join(answer, ["conv_id", "call_id"], "left").select(
        "conv_id", "level", "turn", "call_id", "name", "arguments", "after", "answer.content",
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        F.when(F.col("level").isNull(), "cycle").otherwise("call").alias("kind"))
    nothing = [F.lit(None).cast("string").alias("content"), F.lit(0).cast("long").alias("n_results")]
    more = again.select("conv_id", F.lit(None).cast("long").alias("level"), "turn", "call_id", "name", "arguments", "after",
                        *nothing, F.lit("repeated").alias("kind"))
    loose = calls.where("conv_id IS NULL OR call_id IS NULL").select(
        "conv_id", F.lit(0).cast("long").alias("level"), "turn", "call_id", "name", "arguments", "after", *nothing,
        F.lit("call").alias("kind"))
    ids = first.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"))
    text = F.lit(None).cast("string")
    orphans = results.join(ids, (results["conv_id"] == ids["c"]) & (results["call_id"] == ids["i"]), "left_anti").select(
        "conv_id", F.lit(None).cast("long").alias("level"), "turn", "call_id", text.alias("name"), text.alias("arguments"),
        text.alias("after"), "content", F.lit(1).cast("long").alias("n_results"), F.lit("orphan").alias("kind"))
    # All results of a call but the linked one, exact repeats included.
    further = results.groupBy("conv_id", "call_id", "turn", "content").agg(F.count("*").alias("n"))
    further = further.join(answer.where("n_results > 1"), ["conv_id", "call_id"]).join(
        ids, (F.col("conv_id") == ids["c"]) & (F.col("call_id") == ids["i"]), "left_semi")
    linked = F.struct("turn", "content").eqNullSafe(F.col("answer"))
    further = further.withColumn("n", F.col("n") - F.when(linked, 1).otherwise(0)).where("n > 0").withColumn(
        "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    further = further.select("conv_id", F.lit(None).cast("long").alias("level"), "turn", "call_id", text.alias("name"),
                             text.alias("arguments"), text.alias("after"), "content", F.lit(1).cast("long").alias("n_results"),
                             F.lit("repeated result").alias("kind"))
    return formatted(whole.union(more).union(loose).union(orphans).union(further), schemas)


def formatted(rows: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    kind = rows.schema["conv_id"].dataType.simpleString()

    def line(turn, call_id, name, arguments, after, content, n_results, kind):
        if kind in ("orphan", "repeated result"):
            return kind, "", canonical({"result": content, "tool_call_id": call_id})
        try:
            value = parsed(arguments if arguments is not None else "null")
            found = errors(value, schemas[name]) if name in schemas else []
        except (ValueError, RecursionError):
            value, found = arguments, ["$: not JSON"]
        status = kind if kind != "call" else "unknown tool" if name not in schemas else (
            "invalid" if found else "ok" if n_results else "no result")
        return status, "; ".join(found), canonical(
            {"after": after, "arguments": value, "id": call_id, "name": name, "result": content})

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = [line(*r) for r in zip(*(c.to_pylist() for c in batch.columns[2:]))]
            columns = list(zip(*made)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], *(pa.array(c, pa.string()) for c in columns[:2]), batch.column(8),
                 pa.array(columns[2], pa.string())],
                ["conv_id", "level", "turn", "call_id", "status", "errors", "n_results", "json"])

    return bounded_batches(rows).mapInArrow(run, (
        f"conv_id {kind}, level long, turn long, call_id string, status string, errors string, n_results long, "
        "json string"))


# The tools of the query.
SCHEMAS = {
    "search": {"type": "object", "required": ["query", "limit"], "additionalProperties": False, "properties": {
        "query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 40}}},
    "lookup": {"type": "object", "required": ["query"], "properties": {
        "query": {"type": "string"}, "limit": {"type": "number"}}},
}


def made_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that stand in for the plain turns of ``conversations``.

    Each assistant turn calls a tool with its first words and a number, in half of the cases after the call two turns
    before, in a tenth after the one two turns later. Each user turn is the result of the assistant turn before it.
    """
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text",
                                F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("r"))
    words = F.substring_index(F.coalesce("text", F.lit("")), " ", 3)
    limit = F.when(F.col("r") % 11 == 0, F.col("r").cast("string")).otherwise((F.col("r") % 43).cast("string"))
    other = F.when(F.col("r") % 10 == 9, F.col("turn") + 2).when(F.col("r") % 10 < 5, F.col("turn") - 2)
    # {"x":"..."} without its first five characters and its last
    quoted = F.regexp_extract(F.to_json(F.struct(words.alias("x"))), r'(?s)^.{5}(.*)}$', 1)
    arguments = F.concat(F.lit('{"query": '), quoted, F.lit(', "limit": '), limit,
                         F.when(F.col("r") % 13 == 0, ', "extra": 1.0}').otherwise("}"))
    name = F.when(F.col("r") % 17 == 0, "forget").when(F.col("r") % 3 == 0, "lookup").otherwise("search")
    identify = F.concat_ws("_", F.lit("call"), F.col("turn"))
    calls = rows.where("role = 'assistant'").select(
        "conv_id", "turn", identify.alias("call_id"), name.alias("name"), arguments.alias("arguments"),
        F.concat_ws("_", F.lit("call"), other).alias("after"))
    calls = calls.withColumn("after", F.when(F.col("after") != "call", F.col("after")))
    results = rows.where("role = 'user'").select(
        "conv_id", "turn", F.concat_ws("_", F.lit("call"), F.col("turn") - 1).alias("call_id"),
        F.col("text").alias("content"))
    return calls, results


@query("op9_tool_calls")
def op9(spark, sf_dir):
    """Checked against a plain Python form in ``tests/llm/test_toolcalls.py``."""
    return link_tool_calls(*made_of(table(spark, sf_dir, "conversations")), SCHEMAS)
