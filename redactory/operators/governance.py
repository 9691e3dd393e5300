"""Governed knowledge: liveness, current governance, admission, availability, delivery, listings. All set-based."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactory.functions.checks import first_reason

#: The order in which reasons are shown; others follow.
REASONS = ("source_withdrawn", "source_expired", "governance_missing", "governance_superseded", "evidence_unavailable", "publication_revoked", "audience_denied", "purpose_denied", "fact_disputed", "schema_violation")


#: What names one version of a source; every join of sources with what rests on them compares it all.
SOURCE = ["tenant_id", "domain", "source_id", "version"]


def in_order(reasons: Column) -> Column:
    """Distinct reasons in canonical order, then the others."""
    canonical = F.array(*map(F.lit, REASONS))
    return F.concat(F.filter(canonical, lambda r: F.array_contains(reasons, r)), F.array_sort(F.array_except(reasons, canonical)))


def live(now: Column) -> Column:
    return ~F.col("withdrawn") & (F.col("observed_at") <= now) & (F.col("retention_until") > now)


def current_governance(versions: DataFrame, now: Column) -> DataFrame:
    """Of each source the newest version in force that none supersedes."""
    replaced = versions.select(F.col("supersedes_id").alias("governance_id")).where("governance_id IS NOT NULL").distinct()
    valid = versions.join(replaced, "governance_id", "left_anti").where((F.col("valid_from") <= now) & (F.col("valid_until") > now) & (F.col("state") == "approved"))
    newest = F.row_number().over(Window.partitionBy(*SOURCE).orderBy(F.col("valid_from").desc(), F.col("governance_id")))
    return valid.withColumn("n", newest).where("n = 1").drop("n")


def shared_members(rows: DataFrame, key: str, members: str) -> DataFrame:
    """Per key the members that all its rows have; an empty array if none. Members are counted, so no array of arrays is gathered."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("n_rows"))
    counts = rows.select(key, F.explode(F.array_distinct(members)).alias("member")).groupBy(key, "member").agg(F.count("*").alias("n"))
    common = counts.join(sizes, key).where("n = n_rows").groupBy(key).agg(F.array_sort(F.collect_list("member")).alias("shared"))
    return sizes.join(common, key, "left").select(key, F.coalesce("shared", F.array().cast("array<string>")).alias("shared"))


def linked(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """A row per candidate and source of its evidence."""
    return evidence.select("candidate_id", *SOURCE).distinct().join(sources, SOURCE)


def admission(candidates: DataFrame, evidence: DataFrame, sources: DataFrame, governance: DataFrame, use_audience: str, now: Column) -> DataFrame:
    """candidate_id, n_sources, reasons (in canonical order), first_code, admitted, bound: what keeps each candidate from being published to the audience, for all at once."""
    current = current_governance(governance, now).select(*SOURCE, "audiences", F.col("valid_until").alias("g_until"))
    known = governance.groupBy(*SOURCE).agg(F.bool_or(F.col("supersedes_id").isNotNull()).alias("chained"))
    per_source = sources.join(current, SOURCE, "left").join(known, SOURCE, "left")
    reason = first_reason(
        ("source_withdrawn", F.col("withdrawn")),
        ("source_expired", F.col("retention_until") <= now),
        ("governance_superseded", F.col("audiences").isNull() & F.coalesce("chained", F.lit(False))),
        ("governance_missing", F.col("audiences").isNull()),
        ("audience_denied", ~F.array_contains("audiences", use_audience)),
    )
    judged_sources = per_source.select(*SOURCE, reason.alias("reason"), (F.col("source_kind") == "model_output").alias("by_model"), F.least("g_until", "retention_until").alias("until"))
    judged = linked(evidence, judged_sources).groupBy("candidate_id").agg(F.count("*").alias("n_sources"), F.collect_set("reason").alias("found"), F.bool_and("by_model").alias("model_only"), F.min("until").alias("bound"))
    all_ = candidates.select("candidate_id").join(judged, "candidate_id", "left")
    found = F.when(F.col("n_sources").isNull() | F.col("model_only"), F.array(F.lit("evidence_unavailable"))).otherwise(F.col("found"))
    out = all_.withColumn("reasons", in_order(found))
    return out.select("candidate_id", F.coalesce("n_sources", F.lit(0)).alias("n_sources"), "reasons", F.get("reasons", F.lit(0)).alias("first_code"), (F.size("reasons") == 0).alias("admitted"), F.when(F.size("reasons") == 0, F.col("bound")).alias("bound"))


def active_publications(publications: DataFrame, tombstones: DataFrame, now: Column) -> DataFrame:
    return publications.where(F.col("valid_until") > now).join(tombstones, "publication_id", "left_anti")


def evidence_status(candidates: DataFrame, evidence: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """candidate_id, n_links, status: unknown without evidence or with evidence of unknown sources, expired if any source is, else available."""
    links = evidence.join(sources.select(*SOURCE, F.lit(True).alias("known"), (F.col("retention_until") <= now).alias("expired")), SOURCE, "left")
    counts = links.groupBy("candidate_id").agg(F.count("*").alias("n_links"), F.count("known").alias("n_known"), F.bool_or("expired").alias("expired"))
    out = candidates.select("candidate_id").join(counts, "candidate_id", "left")
    status = F.when(F.col("n_links").isNull() | (F.col("n_known") < F.col("n_links")), "unknown").when(F.col("expired"), "expired").otherwise("available")
    return out.select("candidate_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), status.alias("status"))


def delivery(publications: DataFrame, outbox: DataFrame, receipts: DataFrame, tombstones: DataFrame) -> DataFrame:
    """publication_id, pending (events without any receipt), last_error (of the latest receipt with one), delivery (state of the publication)."""
    got = receipts.join(outbox.select("outbox_id", "publication_id", "event_type"), "outbox_id")
    told = got.groupBy("publication_id").agg(
        F.count("*").alias("n_receipts"), F.max_by("error", F.when(F.col("error").isNotNull(), F.struct("received_at", "outbox_id", "consumer_id"))).alias("last_error"),
        F.array_sort(F.collect_set("consumer_id")).alias("assets"), F.array_sort(F.collect_set(F.when(F.col("event_type") == "revoked", F.col("consumer_id")))).alias("revoked"),
    )
    open_ = outbox.join(receipts.select("outbox_id").distinct(), "outbox_id", "left_anti").groupBy("publication_id").agg(F.count("*").alias("pending"))
    sent = outbox.groupBy("publication_id").agg(F.count("*").alias("n_events"))
    dead = tombstones.select("publication_id", F.lit(True).alias("dead"))
    rows = publications.select("publication_id").join(sent, "publication_id", "left").join(told, "publication_id", "left").join(open_, "publication_id", "left").join(dead, "publication_id", "left")
    confirmed = (F.size(F.coalesce("assets", F.array())) > 0) & (F.size(F.array_except("assets", "revoked")) == 0)
    state = (
        F.when(F.col("dead"), F.when(confirmed, "applied").otherwise("invalidation_pending"))
        .when(F.col("last_error").isNotNull(), "failed").when(F.col("n_events").isNull(), "not_dispatched").when(F.col("pending") > 0, "pending").when(F.col("n_receipts") > 0, "applied").otherwise("pending")
    )
    return rows.select("publication_id", F.coalesce("pending", F.lit(0)).alias("pending"), "last_error", state.alias("delivery"))


def availability(candidates: DataFrame, publications: DataFrame, tombstones: DataFrame, evidence: DataFrame, sources: DataFrame, governance: DataFrame, outbox: DataFrame, receipts: DataFrame, audience: str, now: Column) -> DataFrame:
    """The availability report of all candidates: governance state, reasons, eligibility, evidence and delivery, by their latest publication."""
    latest = publications.groupBy("candidate_id").agg(F.max_by(F.struct("publication_id", "valid_until"), F.struct("published_at", "publication_id")).alias("p")).select("candidate_id", "p.*")
    dead = tombstones.select("publication_id", F.lit(True).alias("dead"))
    blocks = admission(candidates, evidence, sources, governance, audience, now).select("candidate_id", "reasons")
    # What is known of a publication is joined before the candidates, as most of these may have none: their nulls would be one key.
    told = latest.join(dead, "publication_id", "left").join(delivery(publications, outbox, receipts, tombstones), "publication_id", "left")
    rows = (
        candidates.select("candidate_id").join(told, "candidate_id", "left").join(blocks, "candidate_id")
        .join(evidence_status(candidates, evidence, sources, now).withColumnRenamed("status", "evidence_status"), "candidate_id")
    )
    published, is_dead = F.col("publication_id").isNotNull(), F.coalesce("dead", F.lit(False))
    state = F.when(published & ~is_dead, "publishable").when(is_dead, "superseded").otherwise("unconfirmed")
    reasons = F.when(is_dead, in_order(F.array_append("reasons", "publication_revoked"))).otherwise(F.col("reasons"))
    eligible = F.when(F.col("evidence_status") == "unknown", "unknown").when((F.size(reasons) > 0) | F.col("valid_until").isNull() | (F.col("valid_until") <= now), "ineligible").otherwise("eligible")
    return rows.select("candidate_id", state.alias("governance_state"), reasons.alias("reasons"), eligible.alias("eligibility"), "evidence_status", F.coalesce("delivery", F.lit("not_dispatched")).alias("delivery"))


def invalidated(withdrawn: DataFrame, evidence: DataFrame, publications: DataFrame, claims: DataFrame, tombstones: DataFrame) -> DataFrame:
    """What withdrawing sources takes down: per source the candidates, live publications and entities that rest on it."""
    hit = withdrawn.select(*SOURCE).join(evidence.select(*SOURCE, "candidate_id").distinct(), SOURCE)
    pubs = publications.join(tombstones, "publication_id", "left_anti").select("candidate_id", "publication_id")
    about = claims.select(F.col("claim_id").alias("candidate_id"), F.explode(F.array_distinct(F.array("subject_id", "object_id"))).alias("entity_id"))
    a = hit.groupBy("source_id").agg(F.count("*").alias("n_candidates"))
    b = hit.join(pubs, "candidate_id").groupBy("source_id").agg(F.count("*").alias("n_publications"))
    c = hit.join(about, "candidate_id").groupBy("source_id").agg(F.count_distinct("entity_id").alias("n_entities"))
    zero = F.lit(0)
    return a.join(b, "source_id", "left").join(c, "source_id", "left").select("source_id", "n_candidates", F.coalesce("n_publications", zero).alias("n_publications"), F.coalesce("n_entities", zero).alias("n_entities"))


def unreceipted(outbox: DataFrame, consumers: DataFrame, receipts: DataFrame) -> DataFrame:
    """Events that a consumer has no receipt for: each event is owed to each of the registered consumers. Receipts are gathered per event first, so only events that lack one become rows."""
    got = receipts.groupBy("outbox_id").agg(F.collect_set("consumer_id").alias("got"))
    everyone = consumers.agg(F.collect_set("consumer_id").alias("everyone"))  # one row
    missing = F.array_except("everyone", F.coalesce("got", F.array().cast("array<string>")))
    return outbox.join(got, "outbox_id", "left").join(F.broadcast(everyone)).withColumn("consumer_id", F.explode(missing)).drop("got", "everyone")


def page(rows: DataFrame, size: int, after: tuple | None, *keys: str) -> DataFrame:
    """Keyset page: the size rows next below after, by falling keys, and one more if there are more."""
    below = F.struct(*[F.col(k).alias(k) for k in keys]) < F.struct(*[F.lit(v).cast(rows.schema[k].dataType).alias(k) for k, v in zip(keys, after, strict=True)]) if after else F.lit(True)
    return rows.where(below).orderBy(*[F.col(k).desc() for k in keys]).limit(size + 1)


def throttled(attempts: DataFrame, by: str, at: str, seconds: int, limit: int) -> DataFrame:
    """Adds recent (attempts of the source in the last seconds, an attempt exactly so old excluded) and permitted (fewer than limit before this one)."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    frame = Window.partitionBy(by).orderBy("micros").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return attempts.withColumn("micros", micros).withColumn("recent", F.count("*").over(frame)).withColumn("permitted", F.col("recent") <= limit).drop("micros")
