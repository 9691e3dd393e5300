"""Queries of the model interface and its windows. The model stands in for a trained one: it is deterministic, and SQL can say what it finds."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.functions.extraction import Bounds, extract
from redactory.operators.records import sentence_plan
from redactory.sources.tables import slices, table

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


class Capitals:
    """Tokens are words; those with a first letter from A to Z are of type CAP. Ids tell whether they are. Every ninth document has broken offsets, by its own words."""

    def tokens(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        found = [m.span() for m in WORDS.finditer(text)]
        ids = [1 if "A" <= text[a] <= "Z" else 0 for a, _ in found]
        if text.startswith("The "):
            found = [(b, a) for a, b in found]
        return ids, found

    def labels(self, rows: list[list[int]]) -> list[list[str]]:
        return [["I-CAP" if i else "O" for i in ids] for ids in rows]


def words_within(texts: DataFrame, spans: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_spans, n_words of the texts with spans: each text meets all its spans at once, and its words are looked for from a span's start to its end only."""
    lists = spans.groupBy(key).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    rows = texts.join(lists, key).select(key, text, F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            found = [(len(a), sum(len(WORDS.findall(t, *at)) for at in zip(a, b, strict=True))) for t, a, b in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*found, strict=True))], names=[key, "n_spans", "n_words"])

    return rows.mapInArrow(count, f"{key} {texts.schema[key].dataType.simpleString()}, n_spans long, n_words long")


def model_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of all documents by windows of 64 words: per document their number and that of their words, or why there are none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans, held = extract(docs, "doc_id", "text", Capitals, Bounds(capacity=64, stride=48))
    counts = words_within(docs, spans, "doc_id", "text")
    return counts.join(held, "doc_id", "full").select("doc_id", "n_spans", "n_words", "code")


MODEL_SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, starts_with(text, 'The ') AS broken FROM documents), u AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM d WHERE NOT broken),
c AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM u WHERE x[1] BETWEEN 'A' AND 'Z' AND ascii(x) < 128)
SELECT doc_id, count(DISTINCT island)::BIGINT AS n_spans, count(*)::BIGINT AS n_words, NULL AS code FROM c GROUP BY doc_id UNION ALL SELECT doc_id, NULL, NULL, 'OFFSET_INVERTED' FROM d WHERE broken"""


def sentence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of all documents, in code points."""
    return sentence_plan(table(spark, sf_dir, "documents").where("text IS NOT NULL"), "doc_id", "text", 382, 318)


QUERIES = {"model_spans": (model_spans, MODEL_SQL), "sentence_windows": (sentence_windows, None)}
