"""From raw documents to token files: quality, near-duplicates, benchmark, mixture, tokens.

Each stage is a function of (spark, docs, sf_dir). run() stores what a stage
returns as Parquet and hands it, read again, to the next.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.llm.common import discard, id_key, kept, scratch, stored, table, text_hash
from redactory.llm.decontamination import judged
from redactory.llm.huffman import token_files
from redactory.llm.mixing import mixed
from redactory.llm.quality_classifier import fold, keep_good
from redactory.llm.simhash import component_firsts


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels outside the held-out fold, predicts to be good. Null and empty texts are judged as texts without terms; equal texts, under whatever ids, alike; without labels all stay. An empty table gives none."""
    return keep_good(docs, table(spark, sf_dir, "labels").where(fold() != 1))


KEYS = ["k", "th"]


def keyed(docs: DataFrame) -> DataFrame:
    """k and th, which name a row by its doc_id, null too, and its text, and row: all columns of docs, apart from the keys whatever their names are."""
    return docs.select(id_key().alias("k"), text_hash().alias("th"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def unkeyed(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in columns])


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates one row: that with the smallest doc_id (null is smaller than any), then text hash. Of its exact repeats the one with the smallest other columns stays; columns without an order, as maps, count by their JSON."""
    firsts = stored(component_firsts(docs).toDF(*KEYS))
    by = [F.to_json(F.struct(f"row.`{f.name}`")) if re.search("map<|variant|interval", f.dataType.simpleString()) else F.col(f"row.`{f.name}`") for f in docs.schema if f.name != "text"]
    rows = keyed(docs).groupBy(*KEYS).agg(F.min_by("row", F.struct(*by)).alias("row"))  # reduced before the shuffle, so that no row's repeats make a large group
    return unkeyed(rows.join(firsts, KEYS, "left_semi"), docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a window of a benchmark item, each judged by its own text: null and repeated ids don't bind rows together, null texts hold nothing, repeated rows go or stay together. Without items all stay; an empty table gives none."""
    hit = stored(judged(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0").select(*KEYS).distinct())
    return unkeyed(keyed(docs).join(hit, KEYS, "left_anti"), docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them. Null is a source of its own; rows without words weigh nothing and stay or go as their hash says; of repeated rows as many are taken as come nearest to the target. An empty table gives none."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back: doc_id, start, n_tokens, ids_crc32 for each row, null ids first. Null and empty texts have the end id alone; rows of one doc_id follow each other by their texts' hash. An empty table gives none."""
    return token_files(docs, stays=True)


STAGES = [("quality", quality), ("near_duplicate", near_duplicate), ("benchmark", benchmark), ("mixture", mixture), ("tokens", tokens)]

#: The quality and token stages have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage stores goes once its result is stored, and a result once the next one is; the token files stay."""
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with scratch():
            docs = kept(stage(spark, docs, sf_dir))
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
