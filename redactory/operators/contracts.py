"""What requests of each protocol may hold, as JSON Schemas, and answers of each protocol restored in all their texts."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactory.functions.checks import first_reason
from redactory.functions.schemas import bound, valid
from redactory.operators.exchange import CHAT, MESSAGES, PATH, at, fault_of, meeting, put_in, tokens_of
from redactory.operators.spans import reserved
from redactory.operators.toolcalls import MOST_BYTES, MOST_TOTAL, allowed, compact, keys_of, replaced, unfit, walk
from redactory.sources.tables import slices, stored

TEXT, NAME, ANY = {"type": "string"}, {"type": "string", "minLength": 1}, {"type": "object"}
FLAG, WHOLE = {"type": "boolean"}, {"type": "integer"}


def maybe(schema: dict) -> dict:
    """schema, or null."""
    return {"anyOf": [schema, {"type": "null"}]}


def record(required: dict, **optional: dict) -> dict:
    """An object with these members and no others; optional ones may be null."""
    return {"type": "object", "properties": required | {k: maybe(v) for k, v in optional.items()}, "required": list(required), "additionalProperties": False}


def one_of(*values: str) -> dict:
    return {"enum": list(values)}


def several(schema: dict, least: int = 1, most: int | None = None) -> dict:
    return {"type": "array", "items": schema, "minItems": least} | ({} if most is None else {"maxItems": most})


# The members of requests, by protocol, and their bounds.
_CALL = record({"id": NAME, "type": one_of("function"), "function": record({"name": NAME, "arguments": TEXT})})
_LEDGER = {"startsNewUserRequest": FLAG, "agent": TEXT, "conversationRequestId": TEXT, "messageId": TEXT, "stepSeq": WHOLE, "model": TEXT, "requestModelId": TEXT, "requestModelName": TEXT, "traceId": TEXT, "rawUsage": ANY, "usage": ANY}
_CONTENT = {"anyOf": [TEXT, several(record({"type": one_of("text"), "text": TEXT}, annotations={"type": "array"}))]}
_CHAT_MESSAGE = {
    "anyOf": [
        record({"role": one_of("system", "user"), "content": _CONTENT}, **_LEDGER),
        record({"role": one_of("assistant"), "content": _CONTENT}, tool_calls={"type": "array", "items": _CALL}, reasoning_content=TEXT, reasoning=TEXT, **_LEDGER),
        record({"role": one_of("assistant"), "tool_calls": several(_CALL)}, content={"type": "null"}, reasoning_content=TEXT, reasoning=TEXT, **_LEDGER),
        record({"role": one_of("tool"), "content": _CONTENT, "tool_call_id": NAME}, **_LEDGER),
    ]
}
CHAT_REQUEST = record(
    {"model": {"type": "string", "pattern": "\\S"}, "messages": several(_CHAT_MESSAGE)},
    temperature={"type": "number", "minimum": 0, "maximum": 2}, top_p={"type": "number", "exclusiveMinimum": 0, "maximum": 1}, stop={"anyOf": [TEXT, several(TEXT, 0, 16)]}, response_format=record({}, type=one_of("text", "json_object")),
    stream=FLAG, stream_options=record({}, include_usage=FLAG), thinking=record({"type": one_of("enabled", "disabled")}), reasoning_effort=one_of("none", "minimal", "low", "medium", "high", "xhigh", "max"),
    tools={"type": "array", "items": record({"type": one_of("function"), "function": record({"name": NAME, "parameters": ANY}, description=TEXT, strict=FLAG)})},
    tool_choice={"anyOf": [one_of("auto", "none", "required"), record({"type": one_of("function"), "function": record({"name": TEXT})})]},
)
_BLOCK = {
    "anyOf": [
        record({"type": one_of("text"), "text": TEXT}), record({"type": one_of("tool_use"), "id": NAME, "name": NAME, "input": ANY}), record({"type": one_of("tool_result"), "tool_use_id": NAME, "content": TEXT}, is_error=FLAG),
        record({"type": one_of("thinking"), "thinking": TEXT, "signature": TEXT, "metadata": {"type": "object", "additionalProperties": TEXT}}),
    ]
}
MESSAGES_REQUEST = record(
    {"model": {"type": "string", "pattern": "\\S"}, "max_tokens": {"type": "integer", "minimum": 1}, "messages": several(record({"role": one_of("user", "assistant"), "content": {"anyOf": [TEXT, several(_BLOCK)]}}))},
    system=TEXT, stop_sequences={"type": "array", "items": TEXT}, temperature={"type": "number", "minimum": 0, "maximum": 1}, top_p={"type": "number", "exclusiveMinimum": 0, "maximum": 1}, top_k=WHOLE, stream=FLAG,
    tools={"type": "array", "items": record({"name": NAME, "input_schema": ANY}, description=TEXT)},
    tool_choice={"anyOf": [record({"type": one_of("auto", "any", "none")}, disable_parallel_tool_use=FLAG), record({"type": one_of("tool"), "name": TEXT}, disable_parallel_tool_use=FLAG)]},
)
#: Texts of an answer in which no placeholder may stand: alone, and of each of its parts.
FIXED = {
    CHAT: ("$.id", "$.object", "$.model", "$.system_fingerprint", "$.service_tier", "$.base_resp.status_msg", "$.usage.usage_semantic", "$.usage.usage_source", "$.usage.billing_usage.source", "$.usage.billing_usage.semantic"),
    MESSAGES: ("$.id", "$.type", "$.role", "$.model", "$.stop_reason", "$.stop_sequence", "$.service_tier", "$.base_resp.status_msg", "$.usage.service_tier", "$.usage.inference_geo"),
}
FIXED_OF_PART = {CHAT: ("$.message.role", "$.finish_reason", "$.message.name", "$.message.audio_content"), MESSAGES: ("$.type", "$.signature", "$.id", "$.name")}
FIXED_OF_DETAIL = ("$.type", "$.id", "$.format")
# End of fixed values.
REQUESTS = {CHAT: CHAT_REQUEST, MESSAGES: MESSAGES_REQUEST}


def contracted(requests: DataFrame, body: str, protocol: str, models: tuple[str, ...]) -> DataFrame:
    """requests with code: the first of UNSUPPORTED_PROTOCOL, MALFORMED_JSON, CONTRACT_VIOLATION (a member that the protocol does not know, lacks, or has with another value), MODEL_NOT_ALLOWED; or null."""
    rows = requests.withColumn("request_v", F.when(F.is_valid_utf8(body), F.try_parse_json(body)))
    out = None
    for name, schema in REQUESTS.items():  # each protocol's plan has one contract
        code = first_reason(("MALFORMED_JSON", F.col("request_v").isNull()), ("CONTRACT_VIOLATION", ~valid(F.col("request_v"), schema)), ("MODEL_NOT_ALLOWED", ~F.coalesce(at(F.col("request_v"), "$.model", "string").isin(*models), F.lit(False))))
        own = rows.where(F.col(protocol) == name).withColumn("code", code)
        out = own if out is None else out.unionByName(own)
    others = rows.where(~F.coalesce(F.col(protocol).isin(*REQUESTS), F.lit(False))).withColumn("code", F.lit("UNSUPPORTED_PROTOCOL"))
    return out.unionByName(others).drop("request_v")


def texts_of(part: Column, paths: tuple[str, ...]) -> Column:
    return F.array(*[at(part, p, "string") for p in paths])


def marked(texts: Column) -> Column:
    """Whether one of an array's texts holds something like a placeholder."""
    return F.coalesce(F.exists(texts, lambda s: F.coalesce(reserved(s), F.lit(False))), F.lit(False))


def unnested(lists: pa.Array) -> tuple[pa.Array, list[int]]:
    """The values of all lists of a column, and where those of each begin and the last ends; a null list is empty."""
    return lists.flatten(), [0, *accumulate(pc.fill_null(pc.list_value_length(lists), 0).to_pylist())]


def objects(values: pa.Array) -> list:
    return values.to_numpy(zero_copy_only=False).tolist()


def split_calls(rows: DataFrame) -> DataFrame:
    """rows with leaves and members, for each of its calls the texts of its arguments and the names of their members; none where the call has a fault."""
    names = [*rows.columns, "leaves", "members"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            calls, ends = unnested(batch.column("calls"))
            roots = [None if fault else json.loads(text) for text, fault in zip(*(objects(calls.field(n)) for n in ("text", "fault")), strict=True)]
            found = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([list(part(r)) for r in roots], pa.list_(pa.string()))) for part in (walk, keys_of)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(split, f"{schema}, leaves array<array<string>>, members array<array<string>>")


@lru_cache(4096)
def steps(path: str) -> tuple[str | int, ...]:
    return tuple(name or int(number) for name, number in PATH.findall(path))


def set_at(root: object, path: str, value: object) -> None:
    *way, last = steps(path)
    for step in way:
        root = root[step]
    root[last] = value


def put_texts(rows: DataFrame, request: str) -> DataFrame:
    """request, fault, faults, names, arguments, done: of each call its restored arguments, none where it has a fault; the body with all its texts and calls put back, none where it or a call has a fault."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            (paths, ends), (values, _), (calls, ends_of_calls), (faults, _), (leaves, _) = (unnested(batch.column(n)) for n in ("paths", "values", "calls", "faults", "put"))
            paths, values, faults, ways, texts = map(objects, (paths, values, faults, calls.field("path"), calls.field("text")))
            leaves, ends_of_leaves = unnested(leaves)
            leaves = objects(leaves)
            new = [None if f else replaced(json.loads(t), iter(leaves[ends_of_leaves[i] : ends_of_leaves[i + 1]])) for i, (t, f) in enumerate(zip(texts, faults, strict=True))]
            arguments, done = [None if n is None else compact(n) for n in new], []
            for i, (raw, fault) in enumerate(zip(objects(batch.column("body")), objects(batch.column("fault")), strict=True)):
                own, own_calls = range(ends[i], ends[i + 1]), range(ends_of_calls[i], ends_of_calls[i + 1])
                if fault or any(faults[j] for j in own_calls):
                    done.append(None)
                    continue
                root = json.loads(raw)
                for j in own:
                    set_at(root, paths[j], values[j])
                for j in own_calls:
                    set_at(root, ways[j], new[j] if ways[j].endswith(".input") else arguments[j])
                done.append(compact(root))
            lists = pa.ListArray.from_arrays(pa.array(ends_of_calls, pa.int32()), pa.array(arguments, pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in (request, "fault", "faults", "names")), lists, pa.array(done, pa.string())], names=[request, "fault", "faults", "names", "arguments", "done"])

    return rows.mapInArrow(put, f"`{request}` {rows.schema[request].dataType.simpleString()}, fault string, faults array<string>, names array<string>, arguments array<string>, done string")


def answers(responses: DataFrame, mapping: DataFrame, request: str, body: str, protocol: str, models: tuple[str, ...], tools: dict[str, dict]) -> DataFrame:
    """request, body, code: answers of both protocols with their texts and the arguments of their tool calls restored, all else as it was. request names one answer.

    Texts are contents, reasoning and its details, text and thinking blocks; arguments
    are restored and held against the schema of their tool (see released()). The first
    fault counts, and then there is no body: MALFORMED_JSON; CONTRACT_VIOLATION (no
    choices or blocks, a model that is not allowed, another protocol, a placeholder
    where none may stand); the least code of a text; the least code of a call. An
    answer stays one row, with its texts and calls in arrays, and meets the mapping once.
    """
    v, none = F.col("v"), F.array().cast("array<variant>")
    chat, messages = F.col("protocol") == CHAT, F.col("protocol") == MESSAGES
    inner = lambda p, path: F.coalesce(F.when(chat, at(p, path, "array<variant>")), none)
    rows = responses.select(request, F.col(protocol).alias("protocol"), F.col(body).alias("body")).withColumn("v", F.when(F.is_valid_utf8("body"), F.try_parse_json("body")))
    rows = rows.withColumn("parts", F.coalesce(F.when(chat, at(v, "$.choices", "array<variant>")).when(messages, at(v, "$.content", "array<variant>")), none))
    rows = rows.withColumn("parts", F.transform("parts", lambda p, i: F.struct(i.cast("string").alias("i"), p.alias("v"), inner(p, "$.message.reasoning_details").alias("details"), inner(p, "$.message.tool_calls").alias("calls"))))

    fixed_chat = lambda p: F.concat(texts_of(p["v"], FIXED_OF_PART[CHAT]), F.flatten(F.transform(p["details"], lambda d: texts_of(d, FIXED_OF_DETAIL))), F.flatten(F.transform(p["calls"], lambda c: texts_of(c, ("$.id", "$.function.name")))))
    odd = lambda name, of_part: marked(texts_of(v, FIXED[name])) | F.exists("parts", lambda p: marked(of_part(p)))
    fits = F.when(chat, ~odd(CHAT, fixed_chat)).when(messages, ~odd(MESSAGES, lambda p: texts_of(p["v"], FIXED_OF_PART[MESSAGES]))).otherwise(False)
    broken = (F.size("parts") == 0) | ~F.coalesce(at(v, "$.model", "string").isin(*models), F.lit(False)) | ~fits
    judged = rows.withColumn("fault", first_reason(("MALFORMED_JSON", v.isNull()), ("CONTRACT_VIOLATION", broken)))

    text = lambda part, where, *path: F.struct(F.concat(*path).alias("path"), at(part, where, "string").alias("text"))
    choice, block = lambda p: F.concat(F.lit("choices["), p["i"], F.lit("].message.")), lambda p: F.concat(F.lit("content["), p["i"], F.lit("]."))
    of_choice = lambda p: F.concat(
        F.array(*[text(p["v"], f"$.message.{f}", choice(p), F.lit(f)) for f in ("content", "reasoning_content")]),
        F.transform(p["details"], lambda d, j: text(d, "$.text", choice(p), F.lit("reasoning_details["), j.cast("string"), F.lit("].text"))),
    )
    of_block = lambda p: F.array(*[text(p["v"], f"$.{f}", block(p), F.lit(f)) for f in ("text", "thinking")])
    call = lambda path, name, arguments: F.struct(path.alias("path"), name.alias("name"), arguments.alias("text"))
    asked = lambda p: F.transform(p["calls"], lambda c, j: call(F.concat(choice(p), F.lit("tool_calls["), j.cast("string"), F.lit("].function.arguments")), at(c, "$.function.name", "string"), at(c, "$.function.arguments", "string")))
    used = F.transform(F.filter("parts", lambda p: at(p["v"], "$.type", "string") == "tool_use"), lambda p: call(F.concat(block(p), F.lit("input")), at(p["v"], "$.name", "string"), F.to_json(at(p["v"], "$.input", "variant"))))
    texts = F.filter(F.when(chat, F.flatten(F.transform("parts", of_choice))).otherwise(F.flatten(F.transform("parts", of_block))), lambda x: x["text"].isNotNull())
    calls = F.when(chat, F.flatten(F.transform("parts", asked))).otherwise(used)
    found = judged.select(request, "body", "fault", F.when(F.col("fault").isNull(), texts).alias("x"), F.when(F.col("fault").isNull(), calls).alias("calls"))
    early = F.transform("calls", lambda c: F.struct(c["path"], c["name"], c["text"], bound(F.try_parse_json(c["text"]), lambda a: unfit(c["name"], a, tools)).alias("fault")))
    split = split_calls(found.select(request, "body", "fault", F.col("x.path").alias("paths"), F.col("x.text").alias("texts"), early.alias("calls")))
    tokens = F.array_distinct(F.flatten(F.transform(F.concat("texts", F.flatten("leaves")), tokens_of)))
    units = stored(split.withColumn("tokens", F.when(F.col("fault").isNull(), tokens)))  # once, as both what is asked of the mapping and the texts are read

    back = meeting(units.where("fault IS NULL").drop("fault"), mapping, request, "tokens")
    code = lambda t: fault_of(t, F.col("known"), F.coalesce("kinds", F.array().cast("array<string>")))
    fault_of_call = lambda c, i: F.coalesce(c["fault"], F.when(F.exists(F.get("members", i), reserved), "TOKEN_IN_KEY"), F.array_min(F.transform(F.get("leaves", i), code)))
    coded = back.withColumn("fault", F.array_min(F.transform("texts", code))).withColumn("faults", F.transform("calls", lambda c, i: F.coalesce("fault", fault_of_call(c, i))))
    values = F.transform("texts", lambda t: F.when(F.col("fault").isNull(), put_in(t, F.col("known"))))
    arguments = F.transform("leaves", lambda own, i: F.when(F.get("faults", i).isNull(), F.transform(own, lambda t: put_in(t, F.col("known")))))
    whole = put_texts(coded.select(request, "body", "paths", values.alias("values"), "calls", arguments.alias("put"), "fault", "faults", F.col("calls.name").alias("names")), request)
    size = F.coalesce(F.aggregate("arguments", F.lit(0), lambda n, a: n + F.coalesce(F.octet_length(a), F.lit(0))), F.lit(0))
    late = lambda f, i: F.coalesce(f, bound(F.get("arguments", i), lambda a: first_reason(("RESTORED_TOO_LARGE", (F.octet_length(a) > MOST_BYTES) | (size > MOST_TOTAL)), ("SCHEMA", ~allowed(F.get("names", i), a, tools)))))
    ended = whole.withColumn("code", F.coalesce("fault", F.array_min(F.transform("faults", late))))
    done = ended.select(request, F.when(F.col("code").isNull(), F.col("done")).alias("body"), "code")
    return done.unionByName(units.where("fault IS NOT NULL").select(request, F.lit(None).cast("string").alias("body"), F.col("fault").alias("code")))
