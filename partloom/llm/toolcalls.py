"""Chat formatting: tool calls linked to their results, ordered, checked and written as canonical JSON.

Calls and results meet in a hash join on conversation, identifier and the number of times that the identifier has come
before, so an identifier that is used again is linked in order. Calls of a conversation depend on calls whose identifiers
stand as ``{"$ref": id}`` in their arguments. The order by turn is a topological order already where every call comes after
those it depends on; only calls that don't are raised behind them, by ways of doubled length. Arguments are checked against the JSON
schema of their tool, as far as type (one or several), enum, required, properties, additionalProperties, items, minimum and
maximum go; other keywords don't count. Numbers beyond a double's range are no JSON here, as they could not be written again;
halves of surrogate pairs are written as escapes.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partloom.llm.shared import stored, white_space_words

_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value) -> str:
    """Keys sorted by code point, no white space, whole numbers without a fraction."""

    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        return int(x) if isinstance(x, float) and x.is_integer() and abs(x) < 1 << 53 else x

    return _writable(json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def _writable(text: str) -> str:
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def _strict(text: str):
    """JSON without NaN, infinities and repeated keys."""

    def once(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    def no(x):
        raise ValueError(x)

    def finite(x):
        return float(x) if math.isfinite(float(x)) else no(x)

    return json.loads(text, object_pairs_hook=once, parse_constant=no, parse_float=finite)


def _is_of(value, kind: str) -> bool:
    if kind in ("integer", "number"):
        return isinstance(value, int | float) and not isinstance(value, bool) and (kind == "number" or value == int(value))
    return kind in _KINDS and isinstance(value, _KINDS[kind])


def faults(value, schema: dict, at: str = "$") -> list[str]:
    """What a value breaks of a schema, by place."""
    if isinstance(value, dict) and set(value) == {"$ref"}:
        return []  # stands for another call's result
    kinds, out = schema.get("type", []), []
    kinds = [kinds] if isinstance(kinds, str) else kinds
    number = _is_of(value, "number")
    if kinds and not any(_is_of(value, k) for k in kinds):
        return [f"{at}: no {' or '.join(kinds)}"]
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        out.append(f"{at}: not in enum")
    if number and value < schema.get("minimum", -math.inf):
        out.append(f"{at}: under minimum")
    if number and value > schema.get("maximum", math.inf):
        out.append(f"{at}: over maximum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += faults(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += faults(x, schema["items"], f"{at}[{i}]")
    return out


def _refs(value) -> list[str]:
    if isinstance(value, dict):
        if set(value) == {"$ref"} and isinstance(value["$ref"], str):
            return [value["$ref"]]
        return [r for v in value.values() for r in _refs(v)]
    return [r for v in value for r in _refs(v)] if isinstance(value, list) else []


def checked_calls(calls: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """calls with canonical (arguments; null if they are no JSON), errors and refs. schemas: one for each tool's name; they
    are configuration and go to all tasks."""
    sent = calls.sparkSession.sparkContext.broadcast(schemas)
    names = calls.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors, refs = [], [], []
            for name, raw in zip(batch.column("name").to_pylist(), batch.column("arguments").to_pylist(), strict=True):
                try:
                    value = _strict(raw if raw is not None else "{}")
                except (ValueError, RecursionError):
                    texts.append(None), errors.append(["$: no JSON"]), refs.append([])
                    continue
                texts.append(canonical(value))
                errors.append([*map(_writable, faults(value, sent.value[name]))] if name in sent.value else ["$: unknown tool"])
                refs.append(sorted({*map(_writable, _refs(value))}))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array(errors, pa.list_(pa.string())), pa.array(refs, pa.list_(pa.string()))], [*names, "canonical", "errors", "refs"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in calls.schema.fields)
    return calls.mapInArrow(run, f"{kinds}, canonical string, errors array<string>, refs array<string>")


def _stretches(edges: DataFrame) -> DataFrame:
    """conv_id, low and high of the turns that references to the same or a later turn span, where spans overlap as one."""
    spans = edges.where("ref_turn >= turn").groupBy("conv_id", F.col("turn").alias("low")).agg(F.max("ref_turn").alias("high"))
    by = Window.partitionBy("conv_id").orderBy("low")
    reached = F.max("high").over(by.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(F.col("low") <= reached, 0).otherwise(1)
    numbered = spans.withColumn("begins", begins).withColumn("stretch", F.sum("begins").over(by))
    return numbered.groupBy("conv_id", "stretch").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def _places(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, place and depth of calls that have to stand behind their own turn, and whether they are in a cycle
    or behind one.

    A call's place is the latest turn that it waits for; depth, the longest way to a call of that turn, orders calls of one
    place. Only calls in a stretch of turns that a reference forwards spans can be raised, so ways are followed within
    stretches, where each round doubles their length: as many rounds as the logarithm of a stretch's calls. The ways of a
    stretch grow with the square of the calls in it that depend on each other, not with the conversation.
    """
    first = calls.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min("turn").alias("turn"))
    edges = calls.select("conv_id", "call_id", F.explode("refs").alias("ref")).distinct().join(first, ["conv_id", "call_id"])
    edges = stored(edges.join(first.select("conv_id", F.col("call_id").alias("ref"), F.col("turn").alias("ref_turn")), ["conv_id", "ref"]), "edges")
    stretches = stored(_stretches(edges), "stretches")
    within = edges.join(stretches, "conv_id").where(F.col("turn").between(F.col("low"), F.col("high")) & F.col("ref_turn").between(F.col("low"), F.col("high")))
    ways = stored(within.select("conv_id", "stretch", "call_id", "turn", F.col("ref").alias("to"), F.col("ref_turn").alias("to_turn"), F.lit(1).alias("length")), "ways")
    largest = ways.groupBy("conv_id", "stretch").agg(F.countDistinct("call_id").alias("n")).agg(F.max("n")).first()[0] or 0
    on = ["conv_id", "stretch", "middle"]
    for _ in range(largest.bit_length()):
        ahead = ways.withColumnRenamed("to", "middle").select(*on, "call_id", "turn", "length")
        behind = ways.withColumnRenamed("call_id", "middle").select(*on, "to", "to_turn", F.col("length").alias("more"))
        longer = ahead.join(behind, on).select("conv_id", "stretch", "call_id", "turn", "to", "to_turn", F.least(F.col("length") + F.col("more"), F.lit(largest + 1)).alias("length"))
        ways = stored(ways.unionByName(longer).groupBy("conv_id", "stretch", "call_id", "turn", "to", "to_turn").agg(F.max("length").alias("length")), "ways")
    in_cycle = ways.where("call_id = to").select("conv_id", F.col("to"), F.lit(True).alias("round"))
    places = ways.join(in_cycle, ["conv_id", "to"], "left").groupBy("conv_id", "call_id", "turn").agg(F.max(F.struct(F.col("to_turn").alias("place"), F.col("length").alias("depth"))).alias("at"), F.coalesce(F.max("round"), F.lit(False)).alias("cyclic"))
    return places.where("at.place >= turn").select("conv_id", "call_id", F.col("at.place").alias("place"), F.when(F.col("cyclic"), 0).otherwise(F.col("at.depth")).alias("depth"), "cyclic")


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """calls (conv_id, turn, nth, call_id, name, arguments) and results (conv_id, turn, call_id, content) to one row for each
    call, and for each result without one.

    status: linked, unanswered (a call without result), orphan (a result without call), early (a result before its call).
    place and depth, then turn and nth, order the calls of a conversation; cyclic calls can't be ordered and have depth 0. A
    call of a later stretch of turns that names a cyclic one keeps its own turn. record is the canonical JSON of a call with
    its result. Calls that share an identifier have the references of all of them and the turn of the first. Null identifiers
    and null conversations are linked with nothing; null arguments are ``{}``, null names an unknown tool, null contents
    null. Texts of any length are whole. Empty tables give no rows; extra columns are ignored.
    """
    by = Window.partitionBy("conv_id", "call_id")
    calls = stored(checked_calls(calls.select("conv_id", "turn", "nth", "call_id", "name", "arguments"), schemas).withColumn("use", F.row_number().over(by.orderBy("turn", "nth", "name", "arguments"))), "calls")
    answers = results.select("conv_id", F.col("turn").alias("result_turn"), "call_id", "content").withColumn("use", F.row_number().over(by.orderBy("result_turn", "content")))
    joined = calls.join(answers, ["conv_id", "call_id", "use"], "full")
    status = F.when(F.col("turn").isNull(), "orphan").when(F.col("result_turn").isNull(), "unanswered").when(F.col("result_turn") < F.col("turn"), "early").otherwise("linked")
    joined = joined.withColumn("status", status).join(_places(calls), ["conv_id", "call_id"], "left")
    record_text = lambda c: F.when(F.col(c).isNull(), "null").otherwise(F.expr(f"substring(to_json(struct({c} as x)), 6, length(to_json(struct({c} as x))) - 6)"))
    record = F.when(F.col("turn").isNotNull(), F.concat(F.lit('{"arguments":'), F.coalesce("canonical", F.lit("null")), F.lit(',"id":'), record_text("call_id"), F.lit(',"name":'), record_text("name"), F.lit(',"result":'), record_text("content"), F.lit("}")))
    return joined.select("conv_id", "call_id", "use", "status", "turn", "nth", "result_turn", F.coalesce("place", "turn").alias("place"), F.coalesce("depth", F.lit(0)).cast("int").alias("depth"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"), F.coalesce("errors", F.array().cast("array<string>")).alias("errors"), record.alias("record"))


#: The tools of op7.
TOOLS = {
    "reply": {"type": "object", "required": ["length", "opening"], "additionalProperties": False, "properties": {"length": {"type": "integer", "minimum": 1, "maximum": 120}, "opening": {"type": "string"}, "after": {"type": "string"}}},
    "lines": {"type": "object", "required": ["lines"], "properties": {"lines": {"type": "array", "items": {"type": "string"}}, "after": {"type": "string"}}},
}


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as tool calls: what an assistant says is a call, that names the call two turns before in its
    arguments; what a user says is the result of the turn before. A null text is a call without opening, or a null result;
    repeated turns are calls and results of the same identifier, linked in order; without a turn there is no identifier."""
    said = turns.where("role = 'assistant'")
    many = F.col("text").contains("\n")
    after = F.struct(F.concat(F.lit("c"), (F.col("turn") - 2).cast("string")).alias("$ref"))
    after = F.when(F.col("turn") > 2, after)
    short = F.to_json(F.struct(F.col("text").alias("opening"), white_space_words(F.col("text")).alias("length"), after.alias("after")))
    long = F.to_json(F.struct(after.alias("after"), F.split("text", "\n").alias("lines")))
    named: Column = F.concat(F.lit("c"), F.col("turn").cast("string"))
    calls = said.select("conv_id", "turn", F.lit(0).alias("nth"), named.alias("call_id"), F.when(many, "lines").otherwise("reply").alias("name"), F.when(many, long).otherwise(short).alias("arguments"))
    results = turns.where("role = 'user' and turn > 0").select("conv_id", "turn", F.concat(F.lit("c"), (F.col("turn") - 1).cast("string")).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def other_turns(turns: DataFrame) -> DataFrame:
    """Turns that are neither a call nor a result, with the status ``turn`` and their role and text, null or not, as record;
    repeated turns stay."""
    taken = F.coalesce((F.col("role") == "assistant") | ((F.col("role") == "user") & (F.col("turn") > 0)), F.lit(False))
    text = lambda c: F.when(F.col(c).isNull(), "null").otherwise(F.expr(f"substring(to_json(struct({c} as x)), 6, length(to_json(struct({c} as x))) - 6)"))
    record = F.concat(F.lit('{"content":'), text("text"), F.lit(',"role":'), text("role"), F.lit("}"))
    return turns.where(~taken).select("conv_id", F.lit("turn").alias("status"), "turn", F.col("turn").alias("place"), F.lit(0).alias("depth"), F.lit(False).alias("cyclic"), F.array().cast("array<string>").alias("errors"), record.alias("record"))


def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    linked = link_calls(*conversation_calls(turns), TOOLS)
    return linked.unionByName(other_turns(turns), allowMissingColumns=True)
