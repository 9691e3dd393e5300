"""Files redacted from end to end: read as blocks, searched, numbered over the whole file, written as Markdown."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactory.functions.recognizers import detect_once
from redactory.operators.fragments import mask
from redactory.sources.documents import extract, markdown
from redactory.sources.tables import stored


@dataclass
class Redacted:
    """documents: path, format, markdown, n_blocks, n_entities, n_replaced, code; types: path, entity_type, n; mapping: path, entity_type, original, token."""

    documents: DataFrame
    types: DataFrame
    mapping: DataFrame


def redact_files(files: DataFrame, **how) -> Redacted:
    """files: path, content. Each file becomes one text in Markdown with placeholders that are numbered over all its blocks.

    A file that can't be read keeps its code, one with a secret has SECRET_DETECTED;
    neither has a text. how: as for detect(). Equal texts are searched once. An empty
    file has an empty text. Repeated paths are one file and must not occur.
    """
    found = stored(extract(files))
    good = found.where("error IS NULL")
    parts = good.select("path", F.col("n").alias("block"), F.posexplode("texts").alias("i", "text")).withColumn("place", F.struct("path", "block", "i"))
    parts = stored(parts)
    spans = stored(detect_once(parts, "place", **how))
    masked = mask(parts, spans, "path", "place")
    redacted = stored(masked.redacted)
    mapping, uses = stored(masked.mapping), stored(masked.uses)
    texts = redacted.select("path", F.col("place.block").alias("n"), F.struct(F.col("place.i").alias("i"), F.col("redacted").alias("t")).alias("p")).groupBy("path", "n").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["t"]).alias("texts"))
    blocks = good.drop("texts").join(texts, ["path", "n"])
    secret = parts.select("path").distinct().join(redacted.select("path").distinct(), "path", "left_anti").withColumn("secret", F.lit(True))
    counts = good.groupBy("path").agg(F.count("*").alias("n_blocks"))
    kinds = uses.groupBy("path", "entity_type").agg(F.count("*").alias("n"))
    whole = uses.groupBy("path").agg(F.count("*").alias("n_replaced")).join(mapping.groupBy("path").agg(F.count("*").alias("n_entities")), "path")
    state = files.select("path").join(found.where("error IS NOT NULL").select("path", "error"), "path", "left").join(secret, "path", "left").join(counts, "path", "left").join(whole, "path", "left").join(markdown(blocks), "path", "left")
    code = F.coalesce("error", F.when(F.col("secret"), "SECRET_DETECTED"))
    zero = lambda c: F.when(F.col("code").isNull(), F.coalesce(c, F.lit(0))).alias(c)
    shown = state.withColumn("code", code)
    documents = shown.select("path", F.lower(F.regexp_extract("path", "[.]([^./]*)$", 1)).alias("format"), F.when(F.col("code").isNull(), F.coalesce("markdown", F.lit("\n"))).alias("markdown"), zero("n_blocks"), zero("n_entities"), zero("n_replaced"), "code")
    return Redacted(documents, kinds, mapping)
