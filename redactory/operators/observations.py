"""Observations: events built from requests' material, checked, with a stable identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactory.functions.checks import first_reason

#: Texts that may not be blank.
LABELS = ("tenant", "domain", "purpose", "retention_policy")
# Source kinds, the scope of material without one, and days that it is kept.
KINDS = ("master_data", "document", "trusted_tool", "user_assertion", "model_output")
RESTRICTED = ":restricted-candidate"
DAYS = 30
# End of fixed values.


def blank(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")) == ""


def canonical(*columns: Column) -> Column:
    """Columns as a JSON array of texts."""
    return F.to_json(F.array(*columns))


def observed(material: DataFrame) -> DataFrame:
    """material with code (null if it makes an event), source_id, acl, retention_until, event (canonical JSON) and event_id (its SHA-256).

    material: tenant, domain, source_kind, verified, request_id, context_id (null if
    the source has no context), text, digest (that its sender gave), place, observed_at,
    retention_until (null: DAYS later), purpose, retention_policy, acl (array). The codes:
    BLANK and the label; SOURCE_KIND; BLANK_ACL; DIGEST_MISMATCH; OFFSET; RETENTION
    (over when observed). Without an acl the domain's restricted scope holds. A source
    that nobody verified is named by the digest of its scope and text: equal content in
    different scopes is not one source, replays within one are.
    """
    members = F.when(F.size(F.coalesce("acl", F.array().cast("array<string>"))) == 0, F.array(F.concat("domain", F.lit(RESTRICTED)))).otherwise(F.array_sort(F.array_distinct("acl")))
    until = F.coalesce("retention_until", F.col("observed_at") + F.expr(f"INTERVAL {DAYS} DAYS"))
    real = F.sha2("text", 256)
    code = first_reason(
        *[(f"BLANK_{name.upper()}", blank(F.col(name))) for name in LABELS],
        ("SOURCE_KIND", ~F.coalesce(F.col("source_kind").isin(*KINDS), F.lit(False))),
        ("BLANK_ACL", F.coalesce(F.exists("acl", lambda m: blank(m)), F.lit(False))),
        ("DIGEST_MISMATCH", ~F.coalesce(F.col("digest") == real, F.lit(False))),
        ("OFFSET", F.coalesce(F.col("place") < 0, F.lit(True))),
        ("RETENTION", F.coalesce(until <= F.col("observed_at"), F.lit(True))),
    )
    rows = material.withColumn("code", code).withColumn("acl", F.when(F.col("code").isNull(), members)).withColumn("retention_until", until)
    scope = F.sha2(canonical(F.col("tenant"), F.col("domain"), F.col("source_kind"), F.col("digest"), F.col("context_id"), F.col("purpose"), F.col("retention_policy"), F.array_join("acl", "\n")), 256)
    source = F.when(F.col("verified"), F.concat(F.lit("req:"), F.col("request_id"))).otherwise(F.concat(F.lit("unverified:"), F.col("source_kind"), F.lit(":"), scope))
    rows = rows.withColumn("source_id", F.when(F.col("code").isNull(), source))
    when = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c)
    event = F.to_json(F.struct("acl", F.col("place").alias("evidence_offset"), F.col("text").alias("evidence_text"), F.col("digest").alias("evidence_digest"), "domain", when("observed_at"), "purpose", "retention_policy", when("retention_until"), "source_id", "source_kind", "tenant"))
    rows = rows.withColumn("event", F.when(F.col("code").isNull(), event))
    return rows.withColumn("event_id", F.sha2("event", 256))
