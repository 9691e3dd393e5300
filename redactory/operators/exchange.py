"""Requests and responses as JSON: scanning by protocol, text leaves, replacing by path, restoring with error codes."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactory.functions.checks import first_reason
from redactory.operators.fragments import DETECTED
from redactory.operators.spans import TOKEN, reserved
from redactory.sources.tables import slices, stored

CHAT, MESSAGES = "chat", "messages"


def at(variant: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(variant, path, kind)


def scanned(requests: DataFrame, key: str, body: str, protocol: str, models: tuple[str, ...]) -> DataFrame:
    """key, protocol, body, v (the parsed body), code: null, or the first of: no known protocol; no strict JSON (bad UTF-8, duplicate keys); no list of messages; a message without a known role or with neither text nor blocks; a model that is not allowed."""
    rows = requests.select(key, F.col(protocol).alias("protocol"), F.col(body).alias("body")).withColumn("v", F.when(F.is_valid_utf8("body"), F.try_parse_json("body")))
    messages = at(F.col("v"), "$.messages", "array<variant>")
    roles = F.when(F.col("protocol") == CHAT, F.array(*map(F.lit, ("system", *DETECTED)))).otherwise(F.array(F.lit("user"), F.lit("assistant")))
    odd = F.exists(messages, lambda m: ~F.coalesce(F.array_contains(roles, at(m, "$.role", "string")), F.lit(False)) | ~F.coalesce(is_text(m) | at(m, "$.content", "array<variant>").isNotNull(), F.lit(False)))
    code = first_reason(
        ("UNSUPPORTED_PROTOCOL", ~F.coalesce(F.col("protocol").isin(CHAT, MESSAGES), F.lit(False))),
        ("MALFORMED_JSON", F.col("v").isNull()),
        ("CONTRACT_VIOLATION", (F.size(F.coalesce(messages, F.array().cast("array<variant>"))) == 0) | F.coalesce(odd, F.lit(False))),
        ("MODEL_NOT_ALLOWED", ~F.coalesce(at(F.col("v"), "$.model", "string").isin(*models), F.lit(False))),
    )
    return rows.withColumn("code", code)


def is_text(message: Column) -> Column:
    """Whether the content is one text; null without content."""
    return F.schema_of_variant(at(message, "$.content", "variant")) == "STRING"


def leaves(requests: DataFrame, key: str, exempt_tools: tuple[str, ...] = ("Skill",)) -> DataFrame:
    """key, json_path, role, content: the texts of scanned requests without a code that are searched: those of users, assistants and tool results, whether a message is one text or blocks; results of exempt tools are left out."""
    good = requests.where("code IS NULL")
    messages = good.select(key, "protocol", F.posexplode(at(F.col("v"), "$.messages", "array<variant>")).alias("i", "m")).withColumn("role", at(F.col("m"), "$.role", "string"))
    path = F.concat(F.lit("messages["), F.col("i").cast("string"), F.lit("].content"))
    texts = messages.where(is_text(F.col("m"))).select(key, path.alias("json_path"), "role", at(F.col("m"), "$.content", "string").alias("content"), at(F.col("m"), "$.tool_call_id", "string").alias("call_id"))
    blocks = messages.where(~is_text(F.col("m"))).select(key, "protocol", "role", path.alias("path"), at(F.col("m"), "$.tool_call_id", "string").alias("message_call"), F.posexplode(at(F.col("m"), "$.content", "array<variant>")).alias("j", "b"))
    kind, place = at(F.col("b"), "$.type", "string"), F.concat("path", F.lit("["), F.col("j").cast("string"), F.lit("]"))
    of_blocks = blocks.where(kind.isin("text", "tool_result")).select(
        key, F.concat(place, F.when(kind == "text", ".text").otherwise(".content")).alias("json_path"), "role", F.when(kind == "text", at(F.col("b"), "$.text", "string")).otherwise(at(F.col("b"), "$.content", "string")).alias("content"),
        F.coalesce(at(F.col("b"), "$.tool_use_id", "string"), "message_call").alias("call_id"),
    )
    asked = messages.select(key, F.explode(at(F.col("m"), "$.tool_calls", "array<variant>")).alias("c")).select(key, at(F.col("c"), "$.id", "string").alias("call_id"), at(F.col("c"), "$.function.name", "string").alias("name"))
    used = blocks.where(kind == "tool_use").select(key, at(F.col("b"), "$.id", "string").alias("call_id"), at(F.col("b"), "$.name", "string").alias("name"))
    spared = asked.unionByName(used).where(F.col("name").isin(*exempt_tools) & F.col("call_id").isNotNull()).select(key, "call_id").distinct()
    found = texts.unionByName(of_blocks).where(F.col("role").isin(*DETECTED) & F.col("content").isNotNull())
    return found.join(spared, [key, "call_id"], "left_anti").select(key, "json_path", "role", "content")


PATH = re.compile(r"([^.\[\]]+)|\[(\d+)\]")


def put(root: object, path: str, value: str) -> bool:
    """Replaces the text at a path; False if there is none."""
    *way, last = [name or int(number) for name, number in PATH.findall(path)]
    try:
        for step in way:
            root = root[step]
        if not isinstance(root[last], str):
            return False
        root[last] = value
    except (KeyError, IndexError, TypeError):
        return False
    return True


def put_back(bodies: DataFrame, edits: DataFrame, key: str, body: str) -> DataFrame:
    """key, body, code: JSON bodies with the texts of edits (key, json_path, value; as many per body as it has texts) in their places. One path that leads to no text spoils the body: it is null, with UNSAFE_REPLACEMENT. Bodies without edits stay as they are."""
    wanted = edits.groupBy(key).agg(F.collect_list(F.struct("json_path", "value")).alias("edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            out, codes = [], []
            for raw, changes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                root = json.loads(raw) if changes else None
                good = all(put(root, c["json_path"], c["value"]) for c in changes or ())
                out.append((json.dumps(root, ensure_ascii=False) if changes else raw) if good else None)
                codes.append(None if good else "UNSAFE_REPLACEMENT")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(codes, pa.string())], names=[key, "body", "code"])

    kind = bodies.schema[key].dataType.simpleString()
    return bodies.select(key, F.col(body).alias("body")).join(wanted, key, "left").select(key, "body", "edits").mapInArrow(run, f"{key} {kind}, body string, code string")


def replaced(requests: DataFrame, texts: DataFrame, redacted: DataFrame, key: str) -> DataFrame:
    """key, body, code: scanned requests with redacted texts. texts: leaves(); redacted: key, json_path, value. A request of which a text has no redacted form is not sent: DETECTION_INCOMPLETE."""
    open_ = texts.join(redacted, [key, "json_path"], "left_anti").select(key).distinct().withColumn("missing", F.lit(True))
    done = put_back(requests.where("code IS NULL"), redacted, key, "body").join(open_, key, "left")
    code = F.when(F.col("missing"), "DETECTION_INCOMPLETE").otherwise(F.col("code"))
    return done.select(key, F.when(code.isNull(), F.col("body")).alias("body"), code.alias("code"))


# What looks like a placeholder without its brackets, and the beginning of one at a text's end.
BARE = r"(?:^|[^<\p{L}\p{N}_])([A-Z][A-Z0-9_]{0,31})_[0-9]{3,}(?=$|[^>\p{L}\p{N}_])"
TAIL = r"<([A-Z][A-Z0-9_]*)$"
# End of fixed values.


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))


def kinds_of(mapping: DataFrame, request: str) -> DataFrame:
    """request, kinds: the few types of a request's placeholders."""
    return mapping.groupBy(request).agg(F.collect_set(F.regexp_extract("token", "^<(.*)_[0-9]+>$", 1)).alias("kinds"))


def malformed(text: Column, kinds: Column) -> Column:
    """Whether a text holds something like a placeholder that is none. kinds: the types of its request."""
    bare = F.arrays_overlap(F.regexp_extract_all(text, F.lit(BARE), F.lit(1)), kinds)
    begun = F.regexp_extract(text, TAIL, 1)
    cut = (begun != "") & F.exists(kinds, lambda k: F.startswith(F.concat(k, F.lit("_")), begun))
    return (text.contains("<") & (reserved(F.regexp_replace(text, TOKEN, "\0")) | cut)) | (text.contains("_") & bare)


def put_in(text: Column, known: Column) -> Column:
    """text with the originals of its placeholders, in one pass."""
    parts = F.zip_with(F.split(text, TOKEN, -1), tokens_of(text), lambda between, t: F.concat(F.coalesce(between, F.lit("")), F.coalesce(F.try_element_at(known, t), F.lit(""))))
    return F.array_join(parts, "")


def dealt(rows: DataFrame) -> DataFrame:
    """rows for a join with others that grow like them: both sides are dealt out by key, none is broadcast. Spark judges a stored table by its compressed file, of which a few columns may be a hundred times as large in memory."""
    return rows.hint("merge")


def restored(texts: DataFrame, mapping: DataFrame, request: str, key: str, text: str) -> DataFrame:
    """texts with restored and code: every placeholder replaced in one pass, so that originals are never read again; or no text and MALFORMED_TOKEN (something like a placeholder that is none, a placeholder's name without brackets, or the beginning of one at the end) or UNKNOWN_TOKEN.

    mapping: request, token, original. A text's own placeholders are joined with it one
    by one, so a request's mapping is never gathered; only the few types that it has are.
    """
    asked = texts.select(key, request, F.explode(F.array_distinct(tokens_of(F.col(text)))).alias("token"))
    known = asked.join(mapping.select(request, "token", "original"), [request, "token"], "left").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("token", "original"))).alias("known"), F.bool_or(F.col("original").isNull()).alias("unknown"))
    rows = texts.join(known, key, "left").join(kinds_of(mapping, request), request, "left")
    code = first_reason(("MALFORMED_TOKEN", malformed(F.col(text), F.coalesce("kinds", F.array().cast("array<string>")))), ("UNKNOWN_TOKEN", F.coalesce("unknown", F.lit(False))))
    return rows.withColumn("code", code).withColumn("restored", F.when(F.col("code").isNull(), put_in(F.col(text), F.col("known")))).select(*texts.columns, "restored", "code")


def fault_of(text: Column, known: Column, kinds: Column) -> Column:
    """The code that restored() gives a text, or null. known: token to original; kinds: the types of its request."""
    unknown = F.exists(tokens_of(text), lambda k: F.try_element_at(known, k).isNull())
    return first_reason(("MALFORMED_TOKEN", malformed(text, kinds)), ("UNKNOWN_TOKEN", F.coalesce(unknown, F.lit(False))))


def meeting(units: DataFrame, mapping: DataFrame, request: str, tokens: str) -> DataFrame:
    """units, one for each request, with known (their tokens and originals) and kinds (the types of the request's placeholders); null without a mapping. The mapping is moved once, streams past what is asked of it, and only that and the few types are gathered."""
    met = dealt(units.select(request, tokens)).join(mapping.select(request, "token", "original"), request)
    pair = F.when(F.array_contains(tokens, F.col("token")), F.struct("token", "original"))
    known = met.groupBy(request).agg(F.map_from_entries(F.collect_list(pair)).alias("known"), F.collect_set(F.regexp_extract("token", "^<(.*)_[0-9]+>$", 1)).alias("kinds"))
    return units.join(dealt(known), request, "left")


def restored_lists(units: DataFrame, mapping: DataFrame, request: str, key: str, texts: str) -> DataFrame:
    """units with restored and codes, arrays: restored() of each of an array of texts. A unit's placeholders meet the mapping together, so its texts are neither rows nor gathered again."""
    asked = units.select(key, request, F.explode(F.array_distinct(F.flatten(F.transform(texts, tokens_of)))).alias("token"))
    known = dealt(asked).join(mapping.select(request, "token", "original"), [request, "token"], "left").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("token", "original"))).alias("known"))
    rows = units.join(dealt(known), key, "left").join(dealt(kinds_of(mapping, request)), request, "left")
    has = F.coalesce("kinds", F.array().cast("array<string>"))
    judged = rows.withColumn("codes", F.transform(texts, lambda t: fault_of(t, F.col("known"), has)))
    return judged.withColumn("restored", F.zip_with(texts, "codes", lambda t, c: F.when(c.isNull(), put_in(t, F.col("known"))))).select(*units.columns, "restored", "codes")


#: Leaves of a response, outside the answer's text, in which no placeholder may stand.
FIXED = ("$.id", "$.object", "$.model", "$.system_fingerprint", "$.service_tier")
FIXED_OF_CHOICE = ("$.message.role", "$.finish_reason", "$.message.name")


def restored_responses(responses: DataFrame, mapping: DataFrame, request: str, body: str, models: tuple[str, ...]) -> DataFrame:
    """request, body, code: answers with their contents and reasoning restored, all else as it was. request names one response. The first fault counts: no strict JSON; no choices, a model that is not allowed, or a placeholder outside the texts (CONTRACT_VIOLATION); a fault of a text."""
    rows = responses.select(request, F.col(body).alias("body")).withColumn("v", F.when(F.is_valid_utf8("body"), F.try_parse_json("body")))
    choices = at(F.col("v"), "$.choices", "array<variant>")
    fixed = F.array(*[at(F.col("v"), p, "string") for p in FIXED])
    of_choices = F.flatten(F.transform(choices, lambda c: F.array(*[at(c, p, "string") for p in FIXED_OF_CHOICE])))
    marked = F.exists(F.concat(fixed, F.coalesce(of_choices, F.array().cast("array<string>"))), lambda s: F.coalesce(reserved(s), F.lit(False)))
    broken = (F.size(F.coalesce(choices, F.array().cast("array<variant>"))) == 0) | ~F.coalesce(at(F.col("v"), "$.model", "string").isin(*models), F.lit(False)) | marked
    field = lambda c, i, f: F.struct(F.concat(F.lit("choices["), i.cast("string"), F.lit(f"].message.{f}")).alias("json_path"), at(c, f"$.message.{f}", "string").alias("text"))
    fields = F.filter(F.flatten(F.transform(choices, lambda c, i: F.array(*[field(c, i, f) for f in ("content", "reasoning_content")]))), lambda x: x["text"].isNotNull())
    judged = rows.withColumn("fault", first_reason(("MALFORMED_JSON", F.col("v").isNull()), ("CONTRACT_VIOLATION", broken))).withColumn("x", F.when(F.col("fault").isNull(), fields))
    judged = stored(judged.select(request, "body", "fault", F.col("x.json_path").alias("paths"), F.col("x.text").alias("texts")))  # once, as Catalyst would copy the parsing into each use
    back = restored_lists(judged.where("fault IS NULL"), mapping, request, request, "texts")
    whole = put_lists(back.select(request, "body", "paths", "restored", F.array_min("codes").alias("code")), request)
    return whole.unionByName(judged.where("fault IS NOT NULL").select(request, F.lit(None).cast("string").alias("body"), F.col("fault").alias("code")))


def put_lists(rows: DataFrame, key: str) -> DataFrame:
    """key, body, code: JSON bodies with the texts of restored at their paths; null with a code, or where a path leads to no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            out = []
            for raw, paths, values, code in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                root = json.loads(raw) if paths and code is None else None
                good = code is None and all(put(root, *edit) for edit in zip(paths or (), values or (), strict=True))
                out.append((json.dumps(root, ensure_ascii=False) if paths else raw) if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), batch.column(4)], names=[key, "body", "code"])

    return rows.select(key, "body", "paths", "restored", "code").mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, body string, code string")


def candidates(spans: DataFrame, length: Column) -> DataFrame:
    """spans with priority (3 where there is none) and valid: a range inside a text of this length, a type's name, a priority from 0 to 9."""
    priority = F.coalesce("priority", F.lit(3))
    good = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= length) & F.col("entity_type").rlike("^[A-Z][A-Z0-9_]{0,31}$") & priority.between(0, 9)
    return spans.withColumns({"priority": priority, "valid": F.coalesce(good, F.lit(False))})


def orchestrated(fragments: DataFrame, paths: dict[str, DataFrame], failed: DataFrame, key: str, text: str, required: tuple[str, ...] = ("rules", "dictionary")) -> tuple[DataFrame, DataFrame]:
    """The candidates of all detectors as one, and key, code: a code per fragment that has to be held back.

    paths: by detector its candidates (key, start, end, entity_type, priority, source);
    failed: key, detector. The first of these counts: a detector that is missing or has
    failed there (DETECTION_INCOMPLETE), a candidate out of form (INVALID_SPAN), a
    secret (SECRET_DETECTED). Candidates of fragments with the first two don't go on.
    """
    # Fragments, failures and candidates are dealt out together, by key, and judged there: one sort instead of those of six joins.
    every = fragments.select(key, F.lit("fragment").alias("what"), F.length(text).alias("own_length"))
    every = every.unionByName(failed.where(F.col("detector").isin(*required) & F.col(key).isNotNull()).select(key, F.lit("failure").alias("what")), allowMissingColumns=True)
    for rows in paths.values():
        own = rows.where(F.col(key).isNotNull()).select(key, F.lit("candidate").alias("what"), "start", "end", "entity_type", "priority", "source")
        every = every.unionByName(own, allowMissingColumns=True)
    of_key, candidate = Window.partitionBy(key), F.col("what") == "candidate"
    known = every.select("*", F.max("own_length").over(of_key).alias("length"), F.bool_or(F.col("what") == "fragment").over(of_key).alias("asked"), F.bool_or(F.col("what") == "failure").over(of_key).alias("broken"))
    judged = candidates(known, F.col("length"))
    told = judged.select("*", F.bool_or(candidate & ~F.col("valid")).over(of_key).alias("bad"), F.bool_or(candidate & (F.col("priority") == 0)).over(of_key).alias("secret"))
    missing = F.lit(any(d not in paths for d in required))
    coded = told.withColumn("code", first_reason(("DETECTION_INCOMPLETE", missing | F.col("broken")), ("INVALID_SPAN", F.col("bad")), ("SECRET_DETECTED", F.col("secret"))))
    good = coded.where(candidate & F.col("asked") & (F.col("code").isNull() | (F.col("code") == "SECRET_DETECTED")))
    return good.select(key, "start", "end", "entity_type", "priority", "source"), coded.where("what = 'fragment' AND code IS NOT NULL").select(key, "code")
