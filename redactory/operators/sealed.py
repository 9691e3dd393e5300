"""Records sealed by AES-GCM, bound to where they belong, and the history of requests that is kept so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactory.operators.lifecycle import staged, unexpired

# Fixed value: the version of the sealed format.
FORMAT = 1
# End of fixed value.


def bound_to(domain: Column, record_id: Column, purpose: Column, version: int = FORMAT) -> Column:
    """Canonical JSON, members by name: what a sealed body is bound to. A change of any of them makes it unreadable."""
    return F.to_json(F.struct(domain.alias("domain"), F.lit(version).alias("format_version"), purpose.alias("purpose"), record_id.alias("record_id")))


def sealed(body: Column, key: Column, nonce: Column, bound: Column) -> Column:
    """body (text) as AES-256-GCM: nonce, code and tag in one binary value. key: 32 bytes, nonce: 12 bytes that no two bodies of a key share. Null bodies stay null."""
    return F.aes_encrypt(F.encode(body, "utf-8"), key, F.lit("GCM"), F.lit("DEFAULT"), nonce, F.encode(bound, "utf-8"))


def opened(envelope: Column, key: Column, bound: Column) -> Column:
    """The text of sealed(); null if the key, the envelope or anything that it is bound to differs."""
    return F.decode(F.try_aes_decrypt(envelope, key, F.lit("GCM"), F.lit("DEFAULT"), F.encode(bound, "utf-8")), "utf-8")


def nonce_of(*columns: str) -> Column:
    """12 bytes from the columns that name a record, for stores that write each record once."""
    return F.unhex(F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 24))


def history(requests: DataFrame, stages: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """request_id, place, stage, state, body, code: all stages of each unexpired request, opened; those never written have neither body nor code.

    requests: request_id, domain, expires_at. stages: request_id, stage, state,
    envelope, bound to the request's domain, its id and stage, and the purpose history.
    keys: domain, key. If one stage of a request can't be opened, all its written ones
    have HISTORY_UNREADABLE and no body.
    """
    open_ = unexpired(requests, now).join(keys, "domain", "left")
    rows = staged(open_.select("request_id"), stages).join(open_.select("request_id", "domain", "key"), "request_id")
    record = F.concat_ws("/", F.col("request_id").cast("string"), "stage")
    read = rows.withColumn("body", opened(F.col("envelope"), F.col("key"), bound_to(F.col("domain"), record, F.lit("history"))))
    broken = read.where("envelope IS NOT NULL AND body IS NULL").select("request_id").distinct().withColumn("broken", F.lit(True))
    written = F.col("envelope").isNotNull()
    shown = read.join(broken, "request_id", "left").withColumn("code", F.when(written & F.col("broken"), "HISTORY_UNREADABLE"))
    return shown.select("request_id", "place", "stage", "state", F.when(F.col("code").isNull(), F.col("body")).alias("body"), "code")
