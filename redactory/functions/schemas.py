"""JSON Schema as column expressions over variants: a schema is known when the plan is made, so that its checks stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: References are followed so far; a schema that needs more is refused, as one that contains itself.
DEPTH = 12
#: What has no influence on validity here.
NOTES = {"$schema", "$id", "$defs", "definitions", "$comment", "title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly", "format"}
KNOWN = {"$ref", "type", "enum", "const", "properties", "required", "additionalProperties", "minProperties", "maxProperties", "items", "minItems", "maxItems", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "pattern", "anyOf", "allOf", "oneOf", "not"}
#: Words on an object's members.
OF_MEMBERS = {"properties", "required", "additionalProperties", "minProperties", "maxProperties"}


def member(v: Column, name: str) -> Column:
    return F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), F.lit(name))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use() names it."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def kind_of(v: Column) -> Column:
    """object, array, string, number, boolean or null."""
    return bound(F.schema_of_variant(v), lambda s: (
        F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s == "VOID", "null").when(s.rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"), "number")
    ))


def valid(v: Column, schema: dict | bool, root: dict | None = None, depth: int = 0) -> Column:
    """Whether a variant fits a schema; never null. Raises ValueError for words that it does not know, references outside the schema, and schemas that contain themselves."""
    if isinstance(schema, bool):
        return F.lit(schema)
    root = schema if root is None else root
    if unknown := schema.keys() - KNOWN - NOTES:
        raise ValueError(f"schema words not known: {sorted(unknown)}")
    if depth > DEPTH:
        raise ValueError("a schema that contains itself")
    members = F.try_variant_get(v, "$", "map<string,variant>")
    parts = F.struct(v.alias("v"), kind_of(v).alias("kind"), (members if schema.keys() & OF_MEMBERS else F.lit(None).cast("map<string,variant>")).alias("members"))
    return bound(parts, lambda p: fits(p["v"], p["kind"], p["members"], schema, root, depth))


def fits(v: Column, kind: Column, members: Column, schema: dict, root: dict, depth: int) -> Column:
    """valid() of a variant of which the kind is known, and the members if the schema names any."""
    inner = lambda x, s: valid(x, s, root, depth + 1)
    number, text, items = F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "array<variant>")
    checks: list[Column] = []
    only = lambda what, check: checks.append((kind != what) | check)
    if "$ref" in schema:
        checks.append(inner(v, target(root, schema["$ref"])))
    if "type" in schema:
        wanted = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        checks.append(any_of([(kind == "number") & (number == F.floor(number)) if t == "integer" else kind == t for t in wanted]))
    for values in ([schema["const"]] if "const" in schema else None, schema.get("enum")):
        if values is not None:
            checks.append(any_of([equals(v, kind, x) for x in values]))
    bounds = {"minimum": lambda n: number >= n, "maximum": lambda n: number <= n, "exclusiveMinimum": lambda n: number > n, "exclusiveMaximum": lambda n: number < n, "multipleOf": lambda n: F.abs(number / n - F.round(number / n)) < 1e-9}
    for word, check in bounds.items():
        if word in schema:
            only("number", check(float(schema[word])))
    sizes = {"minLength": ("string", F.length(text), 1), "maxLength": ("string", F.length(text), -1), "minItems": ("array", F.size(items), 1), "maxItems": ("array", F.size(items), -1), "minProperties": ("object", F.size(members), 1), "maxProperties": ("object", F.size(members), -1)}
    for word, (what, size, sign) in sizes.items():
        if word in schema:
            only(what, size >= schema[word] if sign > 0 else size <= schema[word])
    if "pattern" in schema:
        only("string", text.rlike(schema["pattern"]))
    if "items" in schema:
        only("array", F.forall(items, lambda x: inner(x, schema["items"])))
    properties = schema.get("properties", {})
    for name in schema.get("required", ()):
        only("object", F.map_contains_key(members, name))
    for name, own in properties.items():
        only("object", ~F.map_contains_key(members, name) | inner(F.try_element_at(members, F.lit(name)), own))
    if "additionalProperties" in schema:
        known = F.array(*map(F.lit, properties)) if properties else F.array().cast("array<string>")
        others = F.map_filter(members, lambda k, _: ~F.array_contains(known, k))
        only("object", F.forall(F.map_values(others), lambda x: inner(x, schema["additionalProperties"])))
    for word, join in (("allOf", all_of), ("anyOf", any_of)):
        if word in schema:
            checks.append(join([inner(v, s) for s in schema[word]]))
    if "oneOf" in schema:
        checks.append(sum((inner(v, s).cast("int") for s in schema["oneOf"]), F.lit(0)) == 1)
    if "not" in schema:
        checks.append(~inner(v, schema["not"]))
    return F.coalesce(all_of(checks), F.lit(False))


def all_of(checks: list[Column]) -> Column:
    out = F.lit(True)
    for c in checks:
        out = out & F.coalesce(c, F.lit(False))
    return out


def any_of(checks: list[Column]) -> Column:
    out = F.lit(False)
    for c in checks:
        out = out | F.coalesce(c, F.lit(False))
    return out


def equals(v: Column, kind: Column, value: object) -> Column:
    """Equality as JSON Schema has it: by kind and value; of arrays and objects all parts."""
    if value is None:
        return kind == "null"
    if isinstance(value, bool):
        return (kind == "boolean") & (F.try_variant_get(v, "$", "boolean") == value)
    if isinstance(value, int | float):
        return (kind == "number") & (F.try_variant_get(v, "$", "double") == float(value))
    if isinstance(value, str):
        return (kind == "string") & (F.try_variant_get(v, "$", "string") == value)
    if isinstance(value, list):
        own = F.try_variant_get(v, "$", "array<variant>")
        return (kind == "array") & (F.size(own) == len(value)) & all_of([equals(F.get(own, F.lit(i)), kind_of(F.get(own, F.lit(i))), x) for i, x in enumerate(value)])
    own = F.try_variant_get(v, "$", "map<string,variant>")
    return (kind == "object") & (F.size(own) == len(value)) & all_of([F.map_contains_key(own, k) & equals(member(v, k), kind_of(member(v, k)), x) for k, x in value.items()])


def target(root: dict, ref: str) -> dict:
    """The part of a schema that a reference within it names."""
    if not ref.startswith("#"):
        raise ValueError("a reference outside the schema")
    found = root
    for step in filter(None, ref[1:].split("/")):
        found = found[step.replace("~1", "/").replace("~0", "~")]
    return found
