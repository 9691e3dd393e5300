"""Audit and quality: detection metrics, contamination, latencies, catalogs, reconciliation, policies."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactory.sources.tables import stored


def label_counts(gold: DataFrame, predicted: DataFrame, key: str, label: str) -> DataFrame:
    """label, tp, fp, fn over distinct (key, label) pairs."""
    g, p = gold.select(key, label).distinct().withColumn("g", F.lit(1)), predicted.select(key, label).distinct().withColumn("p", F.lit(1))
    both = g.join(p, [key, label], "full")
    return both.groupBy(label).agg(F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))


def rates(counts: DataFrame, empty: str) -> DataFrame:
    """Adds precision, recall, f1 and leakage, rounded to 4 places. empty tells what a rate without cases is: "agree" (1 if there was nothing to get wrong, else 0), "zero" or "null"."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    none = {"agree": lambda other: F.when(other == 0, 1.0).otherwise(0.0), "zero": lambda other: F.lit(0.0), "null": lambda other: F.lit(None).cast("double")}[empty]
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(none(fn))
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(none(fp))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.when(p.isNull() | r.isNull(), F.lit(None).cast("double")).otherwise(0.0) if empty == "null" else F.lit(0.0))
    leak = F.when(tp + fn > 0, fn / (tp + fn)).otherwise(0.0)
    return counts.withColumns({"precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(f1, 4), "leakage": F.round(leak, 4)})


def verdict(metrics: DataFrame, thresholds: DataFrame, label: str, samples: Column) -> DataFrame:
    """One row: n_samples, upper_bound (three over n), n_failed (labels below a threshold or without cases), status. A missed secret fails everything."""
    joined = metrics.join(thresholds, label, "full")
    failed = F.col("least_f1").isNotNull() & (F.col("f1").isNull() | (F.col("precision") < F.col("least_precision")) | (F.col("recall") < F.col("least_recall")) | (F.col("f1") < F.col("least_f1")) | (F.col("leakage") > F.col("most_leakage")))
    out = joined.agg(F.count_if(failed).alias("n_failed"), F.coalesce(F.sum(F.when(F.upper(F.trim(label)).startswith("SECRET"), F.col("fn"))), F.lit(0)).alias("secret_misses"))
    status = F.when(F.col("secret_misses") > 0, "HARD_FAILURE_SECRET_LEAKED").when(F.col("n_failed") > 0, "FAIL_THRESHOLDS").otherwise("PASS")
    return out.select(samples.alias("n_samples"), F.round(F.lit(3.0) / samples, 4).alias("upper_bound"), "n_failed", status.alias("status"))


def shared_between(splits: DataFrame, split: str, *keys: str) -> DataFrame:
    """key, a, b, n: how many distinct values of each key two splits share, for each pair of splits that do. Splits of a value are gathered, never its rows."""
    out = None
    for key in keys:
        held = splits.groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("s")).where(F.size("s") > 1)
        pairs = held.select(F.explode(F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("x"))  # noqa: B023
        part = pairs.groupBy("x.a", "x.b").agg(F.count("*").alias("n")).select(F.lit(key).alias("key"), "a", "b", "n")
        out = part if out is None else out.unionByName(part)
    return out


def order_statistics(counts: DataFrame, value: str, points: tuple[float, ...], *by: str) -> DataFrame:
    """by, p (array): the linearly interpolated quantiles of each group at points. counts: by, value (a double), n (how often); each once.

    Values are dealt out by range, so that a group's may lie in many partitions; n is
    summed up within a partition, and per group over the partitions before. Only the two
    neighbours of each quantile are read off; no task holds a group's values.
    """
    laid = stored(counts.repartitionByRange(*by, value).sortWithinPartitions(*by, value).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    own = [*[F.col(b) for b in by], part]
    totals = laid.groupBy(*by, part.alias("part")).agg(F.sum("n").alias("z"))
    of_group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # a row per group and partition
    placed = totals.withColumn("before", F.sum("z").over(of_group.orderBy("part")) - F.col("z")).withColumn("total", F.sum("z").over(of_group))
    inner = laid.withColumn("part", part).withColumn("upto", F.sum("n").over(Window.partitionBy(*own).orderBy("at")))
    same = [inner[b].eqNullSafe(placed[b]) for b in by] + [inner["part"] == placed["part"]]
    found = inner.join(placed, functools.reduce(lambda a, c: a & c, same)).select(*[inner[b] for b in by], value, (F.col("before") + F.col("upto")).alias("upto"), "n", "total")
    wanted = [(F.lit(p) * (F.col("total") - 1)) for p in points]
    holds = lambda rank: (rank < F.col("upto")) & (rank >= F.col("upto") - F.col("n"))
    near = functools.reduce(lambda a, c: a | c, [holds(f(w)) for w in wanted for f in (F.floor, F.ceil)])
    read = [F.max(F.when(holds(f(w)), F.col(value))) for w in wanted for f in (F.floor, F.ceil)]
    got = found.where(near).groupBy(*by).agg(F.first("total").alias("total"), F.array(*read).alias("v"))
    ends = [(F.lit(p) * (F.col("total") - 1), F.col("v")[2 * i], F.col("v")[2 * i + 1]) for i, p in enumerate(points)]
    return got.select(*by, F.array(*[F.when(F.floor(w) == F.ceil(w), low).otherwise((F.ceil(w) - w) * low + (w - F.floor(w)) * high) for w, low, high in ends]).alias("p"))


def latencies(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Per group and over all (null group): count, mean, linearly interpolated p50, p95, p99, max. Null values count as rows only; a group without values has no quantiles."""
    points = (0.5, 0.95, 0.99)
    v = F.col(value).cast("double").alias(value)
    counts = stored(rows.where(F.col(value).isNotNull()).select(*by, v).groupBy(*by, value).agg(F.count("*").alias("n")))
    of_groups = order_statistics(counts, value, points, *by)
    of_all = order_statistics(counts.groupBy(value).agg(F.sum("n").alias("n")), value, points)
    sums = [F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("top")]
    groups = rows.groupBy(*by).agg(*sums)
    same = functools.reduce(lambda a, c: a & c, [groups[b].eqNullSafe(of_groups[b]) for b in by])
    each = groups.join(of_groups, same, "left").select(*[groups[b] for b in by], "n", "mean", "p", "top")
    none = [F.lit(None).cast(rows.schema[b].dataType).alias(b) for b in by]
    total = rows.agg(*sums).join(of_all, F.lit(True), "left").select(*none, "n", "mean", "p", "top")  # one row each
    both = each.unionByName(total)
    return both.select(*by, "n", F.round("mean", 4).alias("mean"), *[F.round(F.get("p", F.lit(i)), 4).alias(n) for i, n in enumerate(("p50", "p95", "p99"))], "top")


def catalog(intents: DataFrame, evidence: DataFrame, now: Column) -> DataFrame:
    """record_id, status: intents with evidence of the same record, domain and version and a retention; expired or retained."""
    both = intents.alias("i").join(evidence.alias("e"), (F.col("i.record_id") == F.col("e.record_id")) & (F.col("i.domain") == F.col("e.domain")) & (F.col("i.version") == F.col("e.version")))
    return both.where(F.col("e.retention_until").isNotNull()).select("i.record_id", F.when(F.col("e.retention_until") <= now, "expired").otherwise("retained").alias("status"))


def reconciled(intents: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """key, adjudication: confirmed with a result, unknown without, orphan for a result without an intent."""
    i, r = intents.select(key, F.lit(True).alias("i")), results.select(key, F.lit(True).alias("r")).distinct()
    return i.join(r, key, "full").select(key, F.when(F.col("i").isNull(), "orphan").when(F.col("r").isNull(), "unknown").otherwise("confirmed").alias("adjudication"))


def egress(requests: DataFrame, policy: DataFrame, detectors: DataFrame, required: tuple[str, ...] = ("rules", "dictionary", "ner")) -> DataFrame:
    """request_id, code: null if the request may leave; else the first of missing or unknown or not approved category, wrong set of detectors, a detector that didn't pass."""
    ran = detectors.groupBy("request_id").agg(F.collect_set("detector").alias("ran"), F.bool_and(F.col("status") == "passed").alias("passed"))
    rows = requests.join(F.broadcast(policy), "category", "left").join(ran, "request_id", "left")
    needed = F.array(*map(F.lit, required))
    none = F.array().cast("array<string>")
    differs = (F.size(F.array_except(needed, F.coalesce("ran", none))) > 0) | (F.size(F.array_except(F.coalesce("ran", none), needed)) > 0)
    code = (
        F.when(F.col("category").isNull(), "CATEGORY_MISSING").when(F.col("label").isNull(), "CATEGORY_UNKNOWN").when(F.col("label") != "approved_external", "NOT_APPROVED").when(differs, "DETECTORS_INCOMPLETE").when(~F.coalesce("passed", F.lit(False)), "DETECTOR_FAILED")
    )
    return rows.select("request_id", code.alias("code"))


def unfit_fields(records: DataFrame, key: str, fields: str, validators: DataFrame) -> DataFrame:
    """key, n_unknown, n_invalid: fields (a map) outside the allowed ones, and values that their pattern refuses. validators: field, pattern; a table of fixed size."""
    each = records.select(key, F.explode_outer(fields).alias("field", "value")).join(F.broadcast(validators), "field", "left")
    return each.groupBy(key).agg(F.count_if(F.col("field").isNotNull() & F.col("pattern").isNull()).alias("n_unknown"), F.count_if(F.col("pattern").isNotNull() & ~F.coalesce(F.regexp_like("value", F.col("pattern")), F.lit(False))).alias("n_invalid"))


def dictionary_hash(entries: DataFrame, by: str) -> DataFrame:
    """by, n_entries, digest: SHA-256 of the entries' canonical JSON, in code point order of text and type."""
    ordered = F.array_sort(F.collect_list(F.struct("text", "entity_type")))
    json = F.to_json(F.transform(ordered, lambda e: F.struct(e["entity_type"].alias("entity_type"), e["text"].alias("text"))))
    return entries.groupBy(by).agg(F.count("*").alias("n_entries"), F.sha2(json, 256).alias("digest"))
