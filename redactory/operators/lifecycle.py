"""Lifecycle of governed knowledge as functions of tables and commands: confirming, revising, withdrawing, expiry, projection, dictionary revisions, retention.

A command table gives a result per command and the rows that it adds. Commands on
one object are taken to come one at a time; two of a batch that meet get CONFLICT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactory.functions.checks import first_reason
from redactory.operators.governance import SOURCE, active_publications, current_governance


def alone(commands: DataFrame, command: str, *what: str) -> DataFrame:
    """Adds first: whether no other command of the batch that comes before (by id) is about the same object."""
    return commands.withColumn("first", F.row_number().over(Window.partitionBy(*what).orderBy(command)) == 1)


def confirmations(commands: DataFrame, sources: DataFrame, governance: DataFrame, now: Column) -> DataFrame:
    """command_id, code (null if it is done), superseded (the version that the new one replaces): new governance for source versions.

    commands: command_id, SOURCE, expected (the version that the asker saw in force, or
    null), valid_until. The first of these refuses: validity that is over; no such
    source; a withdrawn one; an expired one; validity beyond the source's retention;
    another version in force than expected, or another command on the source.
    """
    facts = sources.select(*SOURCE, F.col("withdrawn"), F.col("retention_until"), F.lit(True).alias("known"))
    current = current_governance(governance, now).select(*SOURCE, F.col("governance_id").alias("in_force"))
    rows = alone(commands, "command_id", *SOURCE).join(facts, SOURCE, "left").join(current, SOURCE, "left")
    code = first_reason(
        ("VALIDITY_OVER", F.col("valid_until") <= now),
        ("SOURCE_NOT_FOUND", F.col("known").isNull()),
        ("SOURCE_WITHDRAWN", F.col("withdrawn")),
        ("SOURCE_EXPIRED", F.col("retention_until") <= now),
        ("VALIDITY_EXCEEDS_SOURCE", F.col("valid_until") > F.col("retention_until")),
        ("VERSION_CONFLICT", ~F.col("in_force").eqNullSafe(F.col("expected")) | ~F.col("first")),
    )
    return rows.withColumn("code", code).select("command_id", "code", F.when(F.col("code").isNull(), F.col("in_force")).alias("superseded"))


def superseded_publications(done: DataFrame, bindings: DataFrame, publications: DataFrame, tombstones: DataFrame) -> DataFrame:
    """publication_id, governance_id: live publications that are bound to a superseded governance version. done: confirmations(). bindings: publication_id, SOURCE, governance_id."""
    old = done.where("superseded IS NOT NULL").select(F.col("superseded").alias("governance_id")).distinct()
    hit = bindings.join(old, "governance_id").select("publication_id", "governance_id").distinct()
    return hit.join(publications, "publication_id", "left_semi").join(tombstones, "publication_id", "left_anti")


def revisions(commands: DataFrame, candidates: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """command_id, code, candidate_id, candidate_version, acl, purpose: new proposed versions of candidates.

    commands: command_id, candidate_id, acl, purpose (null: as before). The new version
    must have both, its purpose must be that of every evidence source, and its list
    within each of theirs. The old row stays.
    """
    reach = evidence.select("candidate_id", *SOURCE).distinct().join(sources.select(*SOURCE, F.col("acl").alias("source_acl"), F.col("purpose").alias("source_purpose")), SOURCE)
    asked = commands.join(candidates.select("candidate_id", F.col("acl").alias("old_acl"), F.col("purpose").alias("old_purpose"), "candidate_version"), "candidate_id", "left")
    new = asked.select("command_id", "candidate_id", "candidate_version", F.coalesce("acl", "old_acl").alias("acl"), F.coalesce("purpose", "old_purpose").alias("purpose"))
    beyond = (F.size(F.array_except("acl", "source_acl")) > 0) | (F.col("purpose") != F.col("source_purpose"))
    outside = new.join(reach, "candidate_id").groupBy("command_id").agg(F.bool_or(beyond).alias("outside"))
    blank = (F.size("acl") == 0) | F.exists("acl", lambda a: F.coalesce(F.btrim(a), F.lit("")) == "") | (F.btrim("purpose") == "")
    code = first_reason(("CANDIDATE_NOT_FOUND", F.col("candidate_version").isNull()), ("EMPTY", F.coalesce(blank, F.lit(True))), ("EXCEEDS_SOURCES", F.coalesce("outside", F.lit(False))))
    return new.join(outside, "command_id", "left").select("command_id", code.alias("code"), "candidate_id", (F.col("candidate_version") + 1).alias("candidate_version"), "acl", "purpose")


def invalidations(hit: DataFrame, publications: DataFrame, tombstones: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What taking publications down adds and changes. hit: publication_id, reason (rows may repeat; the least reason counts).

    Returns the new tombstones (of those without one), the revoked events (for each of
    them), and the assets, with active false where a publication is hit.
    """
    reasons = hit.groupBy("publication_id").agg(F.min("reason").alias("reason"))
    live = publications.join(reasons, "publication_id").join(tombstones, "publication_id", "left_anti")
    dead = live.select("publication_id", "candidate_id", "tenant_id", "domain", "reason")
    events = dead.select("publication_id", "tenant_id", "domain", F.lit("revoked").alias("event_type"), "reason")
    off = assets.join(reasons.select("publication_id", F.lit(True).alias("hit")), "publication_id", "left")
    return dead, events, off.withColumn("active", F.col("active") & F.col("hit").isNull()).drop("hit")


def resting_on(gone: DataFrame, evidence: DataFrame, publications: DataFrame) -> DataFrame:
    """publication_id, candidate_id, reason: publications of candidates with evidence from source versions. gone: SOURCE, reason."""
    candidates = gone.select(*SOURCE, "reason").join(evidence.select("candidate_id", *SOURCE).distinct(), SOURCE).groupBy("candidate_id").agg(F.min("reason").alias("reason"))
    return publications.select("publication_id", "candidate_id").join(candidates, "candidate_id")


def withdrawals(commands: DataFrame, sources: DataFrame) -> DataFrame:
    """command_id, SOURCE, code: whether a source version can be withdrawn. commands: command_id, SOURCE."""
    rows = alone(commands, "command_id", *SOURCE).join(sources.select(*SOURCE, "withdrawn"), SOURCE, "left")
    code = first_reason(("SOURCE_NOT_FOUND", F.col("withdrawn").isNull()), ("SOURCE_WITHDRAWN", F.col("withdrawn") | ~F.col("first")))
    return rows.select("command_id", *SOURCE, code.alias("code"))


def due(sources: DataFrame, now: Column) -> DataFrame:
    """SOURCE, reason: source versions whose retention is over and that nobody withdrew."""
    return sources.where((F.col("retention_until") <= now) & ~F.col("withdrawn")).select(*SOURCE, F.lit("retention_expired").alias("reason"))


def time_windows(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """candidate_id, window_start, window_end: from the first observation to the last retention of a candidate's evidence. The last row of a candidate gives them, without grouping: no task holds more than it sorts."""
    rows = evidence.select("candidate_id", *SOURCE).join(sources.select(*SOURCE, "observed_at", "retention_until"), SOURCE).select("candidate_id", "observed_at", "retention_until")
    order = Window.partitionBy("candidate_id").orderBy("observed_at")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    last = F.lead(F.lit(False), 1, True).over(order)
    return rows.select("candidate_id", F.min("observed_at").over(upto).alias("window_start"), F.max("retention_until").over(upto).alias("window_end"), last.alias("last")).where("last").drop("last")


def evidence_payload(evidence: DataFrame, *fields: str) -> DataFrame:
    """candidate_id, payload: JSON of a candidate's evidence, by source and place."""
    rows = F.array_sort(F.collect_list(F.struct("source_id", "char_start", *[f for f in fields if f not in ("source_id", "char_start")])))
    return evidence.groupBy("candidate_id").agg(F.to_json(rows).alias("payload"))


def consumable(assets: DataFrame, publications: DataFrame, tombstones: DataFrame, consumer: str, now: Column) -> DataFrame:
    """The live publications of which a consumer holds an active asset, in its scope."""
    own = assets.where((F.col("consumer_id") == consumer) & F.col("active")).select("tenant_id", "domain", "publication_id")
    return active_publications(publications, tombstones, now).join(own, ["tenant_id", "domain", "publication_id"], "left_semi")


def published_edges(publications: DataFrame, claims: DataFrame, entities: DataFrame, tombstones: DataFrame, now: Column) -> DataFrame:
    """The graph rebuilt: an edge per live publication, between both its entities. What the graph held before is not looked at."""
    side = lambda role: entities.select(F.col("entity_id").alias(f"{role}_id"), F.col("name").alias(f"{role}_name"), F.col("entity_type").alias(f"{role}_type"))
    facts = claims.select(F.col("claim_id").alias("candidate_id"), "subject_id", "object_id", "predicate")
    live = active_publications(publications, tombstones, now).select("publication_id", "candidate_id", "tenant_id", "domain", "valid_until")
    return live.join(facts, "candidate_id").join(side("subject"), "subject_id").join(side("object"), "object_id").withColumnRenamed("publication_id", "edge_id").drop("candidate_id")


def projected(edges: DataFrame, events: DataFrame) -> DataFrame:
    """edges after publish and revoke events: edge_id, is_active. events: publication_id, event_type, order; the last event of a publication decides, and an edge without events stays. A revoked edge is kept, inactive."""
    last = events.groupBy(F.col("publication_id").alias("edge_id")).agg(F.max_by("event_type", "order").alias("last"))
    both = edges.join(last, "edge_id", "full")
    return both.select("edge_id", F.when(F.col("last").isNull(), F.col("is_active")).otherwise(F.col("last") == "published").alias("is_active"))


def disputed(candidates: DataFrame, conflicts: DataFrame) -> DataFrame:
    """candidates (candidate_id, state) with state disputed and a reason where conflicts (claim_id, conflicting_id) names them."""
    named = conflicts.select(F.col("claim_id").alias("candidate_id"), "conflicting_id")
    rows = candidates.join(named, "candidate_id", "left")
    return rows.withColumns({"state": F.when(F.col("conflicting_id").isNotNull(), "disputed").otherwise(F.col("state")), "reason": F.concat(F.lit("DISPUTED: "), F.col("conflicting_id").cast("string"))}).drop("conflicting_id")


def edited(edits: DataFrame) -> DataFrame:
    """scope, entry_id, revision, text, entity_type, enabled: the entries of a dictionary after all edits. edits: scope, revision (rising by one), action (create, update, delete), entry_id, text, entity_type, enabled. The last edit of an entry decides; a deleted one is gone."""
    last = F.row_number().over(Window.partitionBy("scope", "entry_id").orderBy(F.col("revision").desc()))
    return edits.withColumn("n", last).where("n = 1 AND action <> 'delete'").drop("n", "action")


def snapshots(edits: DataFrame, published: DataFrame) -> DataFrame:
    """scope, revision, n_entries, sha256: an immutable version for each published revision: the enabled entries as they stood, by text. published: scope, revision."""
    life = edits.withColumn("until", F.lead("revision").over(Window.partitionBy("scope", "entry_id").orderBy("revision")))
    stood = life.where("action <> 'delete' AND enabled").join(published.withColumnRenamed("revision", "at"), "scope").where((F.col("revision") <= F.col("at")) & (F.col("until").isNull() | (F.col("until") > F.col("at"))))
    rows = stood.groupBy("scope", F.col("at").alias("revision")).agg(F.count("*").alias("n_entries"), F.array_sort(F.collect_list(F.struct("text", "entity_type"))).alias("entries"))
    return rows.select("scope", "revision", "n_entries", F.sha2(F.to_json("entries"), 256).alias("sha256"))


def newest(rows: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """The most last rows of each group, as a list page shows them."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.col(order).desc()))).where(F.col("place") <= most)


def backlog(intents: DataFrame, evidence: DataFrame, cataloged: DataFrame) -> DataFrame:
    """The intents with evidence of the same record, domain and version that the catalog does not hold."""
    return intents.join(evidence, ["record_id", "domain", "version"], "left_semi").join(cataloged, "record_id", "left_anti")


def spool_usage(files: DataFrame) -> DataFrame:
    """One row: total_bytes, n_events, n_gaps of a folder's files (name, length); whatever is no gap record counts as an event."""
    gap = F.col("name").endswith(".gap.json")
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"), F.count_if(~gap).alias("n_events"), F.count_if(gap).alias("n_gaps"))


#: Faults of the store that an optional collection may record as a gap; others fail it.
GAPS = ("SPOOL_FULL", "SPOOL_WRITE_FAILED", "KMS_UNAVAILABLE")


def collected(events: DataFrame) -> DataFrame:
    """events (event_id, mode, fault) with outcome: stored, gap or failed. A required event fails with any fault."""
    gap = (F.col("mode") != "required") & F.col("fault").isin(*GAPS)
    return events.withColumn("outcome", F.when(F.col("fault").isNull(), "stored").when(gap, "gap").otherwise("failed"))


def policy_faults(rules: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """policy, code: the first fault of each policy, or null. rules: policy, category, label. A category may be there once, and have a known label."""
    each = rules.groupBy("policy", "category").agg(F.count("*").alias("n"), F.bool_and(F.coalesce(F.col("label").isin(*labels), F.lit(False))).alias("known"))
    judged = each.groupBy("policy").agg(F.bool_or(F.coalesce(F.trim("category"), F.lit("")) == "").alias("empty"), F.bool_or(F.col("n") > 1).alias("twice"), F.bool_and("known").alias("known"))
    return judged.select("policy", first_reason(("CATEGORY_EMPTY", F.col("empty")), ("CATEGORY_REPEATED", F.col("twice")), ("LABEL_UNKNOWN", ~F.col("known"))).alias("code"))


# What a caller is told about an upstream status.
ERRORS = {
    400: "UPSTREAM_BAD_REQUEST", 401: "UPSTREAM_AUTH_FAILURE", 403: "UPSTREAM_ACCESS_DENIED", 404: "UPSTREAM_NOT_FOUND", 408: "UPSTREAM_TIMEOUT", 413: "UPSTREAM_PAYLOAD_TOO_LARGE",
    429: "UPSTREAM_RATE_LIMITED", 500: "UPSTREAM_INTERNAL_ERROR", 502: "UPSTREAM_BAD_GATEWAY", 503: "UPSTREAM_SERVICE_UNAVAILABLE", 504: "UPSTREAM_GATEWAY_TIMEOUT",
}
FALLBACK = "UPSTREAM_FAILURE"
# End of fixed values.


def sanitized(status: Column) -> Column:
    """The status and code that go to the caller, in a struct; a status outside 400 to 599 is a bad gateway."""
    shown = F.when((status >= 400) & (status < 600), status).otherwise(502)
    code = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in ERRORS.items() for x in p]), shown), F.lit(FALLBACK))
    return F.struct(shown.cast("int").alias("status"), code.alias("code"))


def routed(requests: DataFrame, pipelines: DataFrame) -> DataFrame:
    """requests with pipeline and code: MODEL_NOT_ADMITTED where no pipeline has the model. pipelines: model (once), pipeline; a table of fixed size."""
    return requests.join(F.broadcast(pipelines), "model", "left").withColumn("code", F.when(F.col("pipeline").isNull(), "MODEL_NOT_ADMITTED"))


# The stages of a request's history, in their order, and the state of one that was never written.
STAGES = ("input", "redacted", "upstream", "restored")
MISSING = "not_produced"
# End of fixed values.


def staged(requests: DataFrame, stages: DataFrame) -> DataFrame:
    """A row per request and stage, with place, state (MISSING where none was written) and the other columns of stages. stages: request_id, stage, state, ..."""
    every = requests.select("request_id", F.posexplode(F.array(*map(F.lit, STAGES))).alias("place", "stage"))
    return every.join(stages, ["request_id", "stage"], "left").withColumn("state", F.coalesce("state", F.lit(MISSING)))


def finished(ends: DataFrame) -> DataFrame:
    """request_id, status: the terminal status of each request. ends: request_id, status, moment; the first counts, later ones change nothing."""
    return ends.where(F.col("status").isin("completed", "failed", "blocked")).groupBy("request_id").agg(F.min_by("status", F.struct("moment", "status")).alias("status"))


def unexpired(rows: DataFrame, now: Column) -> DataFrame:
    """What a purge keeps. Written over the old table's partitions, it deletes the rest."""
    return rows.where(F.col("expires_at") > now)
