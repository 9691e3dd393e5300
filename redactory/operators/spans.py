"""Spans: merging, envelopes, coverage, windows, numbering, replacement, all in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_groups(spans: DataFrame, *by: str) -> DataFrame:
    """Adds island: equal for spans of a group that overlap, directly or over others. Spans that only touch stay apart."""
    order = Window.partitionBy(*by).orderBy("start", "end", "entity_type")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("fresh", F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh")


def merge_spans(spans: DataFrame, *by: str) -> DataFrame:
    """Overlapping spans become one: the range of all, their type or MIXED, the least priority, the sorted sources."""
    return (
        overlap_groups(spans, *by)
        .groupBy(*by, "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("entity_type").alias("low"), F.max("entity_type").alias("high"), F.min("priority").alias("priority"), F.array_sort(F.collect_set("source")).alias("sources"))
        .select(*by, "start", "end", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("MIXED").alias("entity_type"), "priority", "sources")
    )


def envelopes(spans: DataFrame, *by: str) -> DataFrame:
    """Per entity type the union of overlapping spans, with clash: whether it overlaps an envelope of another type. The last span of a union, in their order, gives it, so unions are not grouped: no task holds more than it sorts."""
    of_type = Window.partitionBy(*by, "entity_type").orderBy("start", "end")
    upto = of_type.rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max("end").over(of_type.rowsBetween(Window.unboundedPreceding, -1))
    fresh = reach.isNull() | (F.col("start") >= reach)
    rows = spans.select(*by, "entity_type", "start", "end").withColumn("fresh", fresh)
    ends = rows.select(*by, "entity_type", F.max(F.when(F.col("fresh"), F.col("start"))).over(upto).alias("start"), F.max("end").over(upto).alias("end"), F.coalesce(F.lead("fresh").over(of_type), F.lit(True)).alias("last"))
    merged = ends.where("last").drop("last")
    order = Window.partitionBy(*by).orderBy("start", "end", "entity_type")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)) > F.col("start")
    return merged.withColumn("clash", F.coalesce(before, F.lit(False)) | F.coalesce(F.lead("start").over(order) < F.col("end"), F.lit(False)))


def coverage(gold: DataFrame, predicted: DataFrame, *by: str) -> DataFrame:
    """For each gold span the number of its code points inside predicted spans, by intervals, without a row per code point."""
    order = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    union = predicted.select(*by, "start", "end").withColumn("fresh", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    union = union.groupBy(*by, "island").agg(F.min("start").alias("u_start"), F.max("end").alias("u_end"))
    both = gold.join(union, list(by), "left").withColumn("shared", F.when(F.col("u_start").isNotNull(), F.greatest(F.lit(0), F.least("end", "u_end") - F.greatest("start", "u_start"))))
    return both.groupBy(*by, "start", "end").agg(F.coalesce(F.sum("shared"), F.lit(0)).cast("long").alias("covered"))


def plan_windows(lengths: DataFrame, length: str, capacity: int, stride: int) -> DataFrame:
    """A row per window of capacity units: starts at multiples of stride, the last one moved back to end with the text."""
    n = F.col(length)
    last = F.greatest(n - capacity, F.lit(0)).cast("int")
    starts = F.array_distinct(F.concat(F.filter(F.sequence(F.lit(0), last, F.lit(stride)), lambda s: s < last), F.array(last)))
    return lengths.where(n > 0).select("*", F.posexplode(starts).alias("window_no", "window_start")).withColumn("window_end", F.least(F.col("window_start") + capacity, n.cast("int")))


def number_tokens(spans: DataFrame, request: str, *order: str, roles: DataFrame | None = None) -> DataFrame:
    """<PREFIX_001>: each distinct (type, original) of a request gets the next number of its prefix at its first appearance. spans: request, entity_type, original and the order columns. roles: request, entity_type, original, role; the prefix is the role where there is one, and else the type, so a role and a type of one name share their numbers."""
    first = spans.groupBy(request, "entity_type", "original").agg(F.min(F.struct(*order)).alias("first"))
    named = first.withColumn("prefix", F.col("entity_type")) if roles is None else first.join(roles, [request, "entity_type", "original"], "left").withColumn("prefix", F.coalesce("role", "entity_type"))
    number = F.row_number().over(Window.partitionBy(request, "prefix").orderBy("first", "entity_type", "original"))
    return named.select(request, "entity_type", "original", F.format_string("<%s_%03d>", F.col("prefix"), number).alias("token"))


def replaced(text: Column, spans: Column) -> Column:
    """text with each of spans (array of structs start, end, token; sorted, disjoint) replaced by its token."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    folded = F.aggregate(spans, start, lambda a, s: F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), s["token"]).alias("out"), s["end"].alias("at")))
    return F.concat(folded["out"], F.substring(text, folded["at"] + 1, F.length(text)))


# The form of a placeholder, and of text that might be taken for one.
TOKEN = "<[A-Z][A-Z0-9_]{0,31}_[0-9]{3,}>"
RESERVED = "<\\s*(?:[A-Z][A-Z0-9_]{0,31}_|[A-Za-z][A-Za-z0-9_]{0,31}[-_]\\s*(?=[0-9])|[A-Z][A-Z_]{0,31}(?=[0-9]))|<[A-Za-z][A-Za-z0-9_]*_\\s*[0-9]*$"
# End of fixed values.


def reserved(text: Column) -> Column:
    """Whether a text holds, or ends in the beginning of, something like a placeholder."""
    return text.contains("<") & (text.rlike(RESERVED) | text.contains("<<ENT") | text.endswith("<<E") | text.endswith("<<EN"))


def restored(text: Column, mapping: Column) -> Column:
    """text with every known placeholder replaced by its original, in one pass, so that originals are never read again. mapping: map of token to original; unknown tokens stay."""
    tokens = F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))
    between = F.split(text, TOKEN, -1)
    parts = F.zip_with(between, tokens, lambda b, t: F.concat(F.coalesce(b, F.lit("")), F.when(t.isNotNull(), F.coalesce(F.try_element_at(mapping, t), t)).otherwise(F.lit(""))))
    return F.array_join(parts, "")
