"""Tool calls and their results as canonical JSON, linked, ordered and validated.

Calls and results meet in a hash join on their identifier. A call may need other calls; rounds place the calls
whose needs are all placed, so that (level, turn, call_id) is a topological order of a conversation's
calls. Arguments are checked against the tool's schema, and each call is written with its result as one line of JSON
with sorted keys, no white space and no escapes but those JSON asks for. No step gathers a conversation.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.llm.store import drop, written

_TYPES = {
    "object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "integer": int, "number": (int, float),
}


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _refuse(name: str):
    raise ValueError(f"{name} is not JSON")


def schema_error(value, schema: dict, at: str = "$") -> str | None:
    """What is wrong with ``value``, first fault in key order; None if nothing. Knows type, enum, required, properties,
    additionalProperties false, items, minLength, maxLength, minimum and maximum."""
    kinds = schema.get("type")
    if kinds is not None:
        kinds = kinds if isinstance(kinds, list) else [kinds]
        if unknown := [k for k in kinds if k not in _TYPES]:
            return f"{at}: the schema's type {unknown[0]} is not known"
        fits = [isinstance(value, _TYPES[k]) and (k == "boolean" or not isinstance(value, bool) or k == "null") for k in kinds]
        if not any(fits):
            return f"{at}: not {' or '.join(kinds)}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at}: not one of the values"
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            return f"{at}: too short"
        if len(value) > schema.get("maxLength", len(value)):
            return f"{at}: too long"
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            return f"{at}: too small"
        if value > schema.get("maximum", value):
            return f"{at}: too large"
    elif isinstance(value, dict):
        own = schema.get("properties", {})
        for key in schema.get("required", []):
            if key not in value:
                return f"{at}.{key}: missing"
        for key in sorted(value):
            if key in own:
                if found := schema_error(value[key], own[key], f"{at}.{key}"):
                    return found
            elif schema.get("additionalProperties", True) is False:
                return f"{at}.{key}: unknown"
    elif isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            if found := schema_error(item, schema["items"], f"{at}[{i}]"):
                return found
    return None


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, level) of distinct ids: 0 without needs among the calls, else one more than the highest of them; null on or behind a cycle.

    ``calls`` has call_id and needs (array of ids; ids that no call has don't count). A round places a level; the
    rounds are as many as the longest chain of needs.
    """
    ids = calls.filter("call_id is not null").groupBy("call_id").agg(F.flatten(F.collect_set(F.coalesce("needs", F.array()))).alias("needs"))
    edges = ids.select("call_id", F.explode(F.array_distinct("needs")).alias("need"))
    edges = edges.join(ids.select(F.col("call_id").alias("need")), "need", "left_semi")
    open_ = written(edges, "needs")
    level = 0
    placed = written(ids.join(open_, "call_id", "left_anti").select("call_id", F.lit(0).alias("level")), "level")
    done = placed
    while not open_.isEmpty():
        unmet = open_.join(placed.select(F.col("call_id").alias("need")), "need", "left_anti")
        rest = written(unmet, "needs")
        level += 1
        placed = written(open_.select("call_id").distinct().join(rest.select("call_id"), "call_id", "left_anti").select("call_id", F.lit(level).alias("level")), "level")
        drop(open_)
        open_ = rest
        if placed.isEmpty():
            break
        done = done.unionByName(placed)
    return ids.select("call_id").join(done, "call_id", "left")


LINES = "valid boolean, error string, json string"


def linked_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """(conv_id, turn, call_id, name, level, linked, n_results, valid, error, json) of every call, and of every result without a call.

    ``calls``: conv_id, turn, call_id, name, arguments (JSON text), needs (array of call ids); ``results``: conv_id, turn, call_id,
    content. Ids are those of one conversation: the same id in another one is another call. Of several results of an id the one of the smallest (turn, content) is linked, n_results counts them; of
    several calls of an id each is linked to it. A call without id has no result. valid: the arguments are JSON (numbers too large for a double and
    halves of surrogate pairs are not) and fit the tool's schema (an unknown tool has none and is not valid); error says why not, and json then holds the arguments as they came. A result
    without a call has null name and level, valid false. Nulls are JSON nulls; empty tables give no rows; other columns are not read.
    """
    # The id of a call is that of its conversation and its own. A conversation without id counts as one.
    own = lambda c: F.struct(F.col("conv_id").cast("long").alias("conv"), c.alias("id"))
    answer = results.filter("call_id is not null").select(own(F.col("call_id")).alias("link"), "turn", "content").groupBy("link").agg(
        F.min(F.struct("turn", "content")).alias("answer"), F.count("*").alias("n"))
    needs = F.transform(F.coalesce("needs", F.array()), own)
    order = levels(calls.filter("call_id is not null").select(own(F.col("call_id")).alias("call_id"), needs.alias("needs"))).withColumnRenamed("call_id", "link")
    linked = F.when(F.col("call_id").isNotNull(), own(F.col("call_id")))
    joined = calls.select("conv_id", "turn", "call_id", "name", "arguments", F.lit(True).alias("called"), linked.alias("link")).join(answer, "link", "full").join(order, "link", "left")
    nameless = results.filter("call_id is null").select(
        "conv_id", "turn", F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"),
        F.lit(None).cast("int").alias("level"), F.lit(False).alias("linked"), F.lit(1).cast("long").alias("n_results"), "content", F.lit(False).alias("called"))
    called = F.coalesce("called", F.lit(False))
    rows = joined.select(
        F.coalesce("conv_id", "link.conv").alias("conv_id"), F.coalesce("turn", "answer.turn").alias("turn"), F.coalesce("call_id", "link.id").alias("call_id"), "name", "arguments", "level",
        (called & F.col("answer").isNotNull()).alias("linked"), F.coalesce("n", F.lit(0)).alias("n_results"), F.col("answer.content").alias("content"), called.alias("called"))
    rows = rows.unionByName(nameless)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid, errors, lines = [], [], []
            for row in batch.select(["call_id", "name", "arguments", "linked", "content", "called"]).to_pylist():
                line, error = {"id": row["call_id"], "result": row["content"]}, None
                if not row["called"]:
                    error, text = "result without a call", canonical(line)
                else:
                    try:
                        value = json.loads(row["arguments"] or "", parse_constant=_refuse)
                        text = canonical(line | {"name": row["name"], "arguments": value})
                        text.encode()  # half of a surrogate pair is no text
                        error = schema_error(value, schemas[row["name"]]) if row["name"] in schemas else "unknown tool"
                    except (ValueError, RecursionError):
                        error, text = "arguments are not JSON", canonical(line | {"name": row["name"], "arguments": row["arguments"]})
                valid.append(error is None)
                errors.append(error)
                lines.append(text)
            names = ["conv_id", "turn", "call_id", "name", "level", "linked", "n_results"]
            columns = [batch.column(c) for c in names] + [pa.array(valid, pa.bool_()), pa.array(errors, pa.string()), pa.array(lines, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "valid", "error", "json"])

    schema = "conv_id long, turn long, call_id string, name string, level int, linked boolean, n_results long, " + LINES
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "call_id", "name", "level", "linked", F.col("n_results").cast("long"), "arguments", "content", "called").mapInArrow(write, schema)
