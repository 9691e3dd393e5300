"""Intake: measured bodies, keyed digests, import batches, renamed entities, protected answers."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactory.sources.tables import slices


def measured(bodies: DataFrame, key: str, body: str, most: int, needle: bytes = b'"role"') -> DataFrame:
    """key, body_bytes, plain_bytes, n_needles, fault: what a body is when unpacked. gzip bodies are unpacked piece by piece, all members, and given up beyond most bytes; the needle is counted over piece borders too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces(raw: bytes) -> Iterator[bytes]:
            if raw[:2] != b"\x1f\x8b":
                yield raw
                return
            while raw:  # member after member
                z = zlib.decompressobj(31)
                while raw and not z.eof:
                    yield z.decompress(raw, 1 << 16)
                    raw = z.unconsumed_tail
                if not z.eof:
                    raise zlib.error("truncated")
                raw = z.unused_data

        for batch in slices(batches, 200):
            out = []
            for raw in batch.column(1).to_pylist():
                raw = raw or b""
                size = n = 0
                fault, tail = None, b""
                try:
                    for p in pieces(raw):
                        size += len(p)
                        if size > most:
                            fault = "TOO_LARGE"
                            break
                        seen = tail + p
                        n += seen.count(needle)
                        at = seen.rfind(needle)
                        tail = seen[max(at + len(needle) if at >= 0 else 0, len(seen) - len(needle) + 1) :]
                except zlib.error:
                    fault = "BAD_GZIP"
                out.append((len(raw), size, n, fault))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=[key, "body_bytes", "plain_bytes", "n_needles", "fault"])

    return bodies.select(key, body).mapInArrow(run, f"{key} {bodies.schema[key].dataType.simpleString()}, body_bytes long, plain_bytes long, n_needles long, fault string")


def keyed_digest(rows: DataFrame, value: str, secret: bytes, out: str = "digest") -> DataFrame:
    """Adds the HMAC-SHA-256 of value (a text), in hex: the hash of the secret's outer pad and the hash of its inner pad and the text. Null stays null."""
    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(k ^ pad for k in key)) for pad in (0x36, 0x5C))
    return rows.withColumn(out, F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(value, "utf-8")), 256))), 256))


#: What each importer takes, and what it needs.
IMPORTERS = {"master": "master_data", "document": "document", "tool": "trusted_tool"}


def import_faults(batches: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """batch_id, code, field_path: a row per fault. batches: batch_id, importer, source_kind; relations: batch_id, ix, evidence_text, evidence_start."""
    kinds = F.create_map(*[F.lit(x) for p in IMPORTERS.items() for x in p])
    wrong = batches.where(~F.col("source_kind").eqNullSafe(F.try_element_at(kinds, "importer"))).select("batch_id", F.lit("INVALID_SOURCE_KIND").alias("code"), F.lit("meta.source_kind").alias("field_path"))
    empty = batches.where("importer = 'master'").join(entities, "batch_id", "left_anti").select("batch_id", F.lit("EMPTY_ENTITIES").alias("code"), F.lit("entities").alias("field_path"))
    bare = relations.where("evidence_text IS NULL OR evidence_start IS NULL").join(batches.where("importer = 'document'"), "batch_id", "left_semi")
    return wrong.unionByName(empty).unionByName(bare.select("batch_id", F.lit("MISSING_EVIDENCE_SPAN").alias("code"), F.concat(F.lit("relations["), "ix", F.lit("].evidence")).alias("field_path")))


def renamed(aliases: DataFrame, renames: DataFrame) -> DataFrame:
    """aliases (alias, canonical) after renames (old, new): aliases of an old name point to the new one, and the old name becomes an alias of it."""
    turned = aliases.join(renames, aliases["canonical"] == renames["old"], "left").select("alias", F.coalesce("new", "canonical").alias("canonical"))
    own = renames.select(F.col("old").alias("alias"), F.col("new").alias("canonical"))
    return turned.join(own.select("alias"), "alias", "left_anti").unionByName(own).where("alias <> canonical")


def protected(chunks: DataFrame, stream: str, order: str, data: str, done: str, most: int) -> DataFrame:
    """stream, text, fault: a stream's chunks as one text once its last chunk is the terminal mark; else why nothing may be sent. A stream is held whole, so most bounds its size."""
    total = F.sum(F.octet_length(data))
    got = chunks.groupBy(stream).agg(total.alias("size"), F.max_by(data, order).alias("last"), F.count_if(F.col(data) == done).alias("marks"))
    fit = got.withColumn("fault", F.when(F.col("size") > most, "TOO_LARGE").when(F.col("marks") == 0, "TRUNCATED").when((F.col("last") != done) | (F.col("marks") > 1), "AFTER_END"))
    good = chunks.join(fit.where("fault IS NULL").select(stream), stream, "left_semi").where(F.col(data) != done)
    texts = good.groupBy(stream).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, data))), lambda c: c[data]), "").alias("text"))
    return fit.join(texts, stream, "left").select(stream, F.when(F.col("fault").isNull(), F.coalesce("text", F.lit(""))).alias("text"), "fault")


def scenario_summary(requests: DataFrame, by: str) -> DataFrame:
    """Per scenario and over all (null): requests, seconds, requests a second, wrong hits, skipped, failed, and how many inputs gave different outputs on repeats."""
    unstable = requests.groupBy(by, "input").agg((F.count_distinct("output") > 1).cast("long").alias("u")).rollup(by).agg(F.sum("u").alias("n_unstable"), F.grouping(by).alias("g"))
    got = requests.rollup(by).agg(F.count("*").alias("n"), F.sum("seconds").alias("seconds"), F.count_if("wrong").alias("n_wrong"), F.count_if("skipped").alias("n_skipped"), F.count_if("failed").alias("n_failed"), F.grouping(by).alias("g"))
    a, b = got.alias("a"), unstable.alias("b")
    both = a.join(b, (F.col(f"a.{by}").eqNullSafe(F.col(f"b.{by}"))) & (F.col("a.g") == F.col("b.g")))
    return both.select(f"a.{by}", "n", F.round("seconds", 3).alias("seconds"), F.round(F.try_divide("n", "seconds"), 4).alias("throughput"), "n_wrong", "n_skipped", "n_failed", "n_unstable")
