"""Calls of tools that come in fragments: assembled within byte budgets, restored, and released only if they fit the tool's schema."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactory.functions.checks import first_reason
from redactory.functions.schemas import kind_of, valid
from redactory.operators.exchange import restored_lists
from redactory.operators.spans import reserved
from redactory.sources.tables import slices, stored

#: Most bytes of one call's arguments and of all of a request's, and most calls of a request.
MOST_BYTES, MOST_TOTAL, MOST_CALLS = 65_536, 262_144, 128


def assembled(fragments: DataFrame, request: str, call: str, order: str, delta: str, most: int = MOST_BYTES, total: int = MOST_TOTAL, calls: int = MOST_CALLS) -> DataFrame:
    """request, call, text, code: the fragments (request, call, order, delta) of each call joined in order.

    A call whose own bytes pass most has CALL_TOO_LARGE, one with which its request
    passes total, counted over all fragments in order, REQUEST_TOO_LARGE, and one that
    begins after calls others TOO_MANY_CALLS. Fragments are moved once; those past a
    budget, and empty ones, are not gathered, so what is gathered is bounded. A
    request's fragments pass one task in order. Null fragments are empty.
    """
    size = F.coalesce(F.octet_length(delta), F.lit(0))
    of_request = Window.partitionBy(request).orderBy(order, call).rowsBetween(Window.unboundedPreceding, 0)
    of_call = Window.partitionBy(request, call).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    passed = fragments.select(request, call, order, delta, size.alias("bytes")).withColumn("upto", F.sum("bytes").over(of_request)).withColumn("own", F.sum("bytes").over(of_call))
    kept = F.when((F.col("bytes") > 0) & (F.col("own") <= most) & (F.col("upto") <= total), F.struct(order, F.col(delta).alias("delta")))
    sums = passed.groupBy(request, call).agg(F.sum("bytes").alias("bytes"), F.max("upto").alias("upto"), F.min(order).alias("begins"), F.collect_list(kept).alias("parts"))
    place = F.row_number().over(Window.partitionBy(request).orderBy("begins", call))
    judged = sums.withColumn("code", first_reason(("TOO_MANY_CALLS", place > calls), ("CALL_TOO_LARGE", F.col("bytes") > most), ("REQUEST_TOO_LARGE", F.col("upto") > total)))
    text = F.array_join(F.transform(F.array_sort("parts"), lambda p: p["delta"]), "")
    return judged.select(request, call, F.when(F.col("code").isNull(), text).alias("text"), "code")


def walk(value: object) -> Iterator[str]:
    """The texts of a JSON value, in their order."""
    if isinstance(value, str):
        yield value
    else:
        for v in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
            yield from walk(v)


def replaced(value: object, texts: Iterator[str]) -> object:
    if isinstance(value, str):
        return next(texts)
    if isinstance(value, dict):
        return {k: replaced(v, texts) for k, v in value.items()}
    return [replaced(v, texts) for v in value] if isinstance(value, list) else value


compact = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode


def keys_of(value: object) -> Iterator[str]:
    for k, v in value.items() if isinstance(value, dict) else ((None, v) for v in value) if isinstance(value, list) else ():
        if k is not None:
            yield k
        yield from keys_of(v)


def leaves(calls: DataFrame, text: str) -> DataFrame:
    """calls with leaves, the texts of a JSON value in their order, and members, the names of its members. Each value is bounded by its budget."""
    names = [*calls.columns, "leaves", "members"]
    place = calls.columns.index(text)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            roots = [json.loads(t) for t in batch.column(place).to_pylist()]
            found = [pa.array([list(part(r)) for r in roots], pa.list_(pa.string())) for part in (walk, keys_of)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in calls.schema)
    return calls.mapInArrow(split, f"{schema}, leaves array<string>, members array<string>")


def put_back(calls: DataFrame, text: str, values: str, fault: str) -> DataFrame:
    """calls with arguments: JSON values with their texts replaced by values, compact; none where there is a fault."""
    names = [c for c in calls.columns if c != values]
    places = [calls.columns.index(c) for c in (text, values, fault)]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            rows = zip(*(batch.column(i).to_pylist() for i in places), strict=True)
            out = [None if f else compact(replaced(json.loads(t), iter(v or ()))) for t, v, f in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.string())], names=[*names, "arguments"])

    schema = ", ".join(f"`{c}` {calls.schema[c].dataType.simpleString()}" for c in names)
    return calls.mapInArrow(join, f"{schema}, arguments string")


def unfit(name: Column, v: Column, schemas: dict[str, dict]) -> Column:
    """What keeps a call from being restored: the name of its tool, or its arguments as a variant; or null."""
    return first_reason(("UNKNOWN_TOOL", ~F.coalesce(name.isin(*schemas), F.lit(False))), ("MALFORMED_JSON", v.isNull()), ("NOT_AN_OBJECT", ~F.coalesce(kind_of(v) == "object", F.lit(False))))


def allowed(name: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    """Whether arguments, as JSON, fit the schema of their tool."""
    fits = F.lit(False)
    for tool, schema in schemas.items():
        fits = fits | ((name == tool) & valid(F.try_parse_json(arguments), schema))
    return fits


def released(calls: DataFrame, names: DataFrame, mapping: DataFrame, schemas: dict[str, dict], request: str, call: str, most: int = MOST_BYTES, total: int = MOST_TOTAL) -> DataFrame:
    """request, call, arguments, code: assembled() calls whose arguments may be released, restored; else no arguments and the first fault.

    names: request, call, name. mapping: request, token, original. schemas: by name of
    the tool its JSON Schema; a tool that has none is not released. The faults, in
    order: those of assembled(); UNKNOWN_TOOL; MALFORMED_JSON (a member twice as well);
    NOT_AN_OBJECT; TOKEN_IN_KEY; MALFORMED_TOKEN and UNKNOWN_TOKEN of a text;
    RESTORED_TOO_LARGE, by a call's own bytes, or by those of all released calls of its
    request; SCHEMA. Nothing of a call is released with a fault.
    """
    rows = calls.join(names.select(request, call, "name"), [request, call], "left").withColumn("call_key", F.struct(request, call)).withColumn("v", F.try_parse_json("text"))
    odd = unfit(F.col("name"), F.col("v"), schemas)
    judged = stored(rows.select(request, call, "call_key", "name", "text", F.coalesce("code", odd).alias("code")))
    units = stored(leaves(judged.where("code IS NULL").select(request, "call_key", "name", "text"), "text"))
    back = restored_lists(units, mapping, request, "call_key", "leaves")
    fault = F.when(F.exists("members", reserved), "TOKEN_IN_KEY").otherwise(F.array_min("codes"))
    whole = put_back(back.select(request, "call_key", "name", "text", "restored", fault.alias("fault")), "text", "restored", "fault")
    size = F.octet_length("arguments")
    sized = whole.withColumn("size", size).withColumn("upto", F.sum("size").over(Window.partitionBy(request).orderBy(f"call_key.{call}").rowsBetween(Window.unboundedPreceding, 0)))
    late = first_reason(("RESTORED_TOO_LARGE", (F.col("size") > most) | (F.col("upto") > total)), ("SCHEMA", ~allowed(F.col("name"), F.col("arguments"), schemas)))
    coded = sized.select(request, F.col(f"call_key.{call}").alias(call), "arguments", F.coalesce("fault", late).alias("code"))
    done = coded.select(request, call, F.when(F.col("code").isNull(), F.col("arguments")).alias("arguments"), "code")
    return done.unionByName(judged.where("code IS NOT NULL").select(request, call, F.lit(None).cast("string").alias("arguments"), "code"))
