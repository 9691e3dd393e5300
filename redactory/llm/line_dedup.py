"""Line deduplication over range-partitioned hashes.

A row per long line key of a document holds the key's 128-bit hash, the document
and the line's places. These rows are range-partitioned by hash and document and
sorted, largest document first, so that one pass over a partition streams each
key's documents: the first keeps its lines, the others lose theirs once enough
documents are seen. A range ends between documents, not between keys, so a very
frequent key spreads over many partitions; for the first and last key of each, and
for keys with very many rows of few documents, only their counts are brought together. The result is a compressed bitmap of kept
lines for each document that loses some; texts are not moved until it is applied.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.llm.common import WHITE, discard, id_back, id_key, slices, stored, table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DECISION = "kind int, hi long, lo long, k long, th long, n long, n_lines int, places binary"
FIELDS = pa.schema([("kind", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64()), ("k", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("n_lines", pa.int32()), ("places", pa.binary())])
#: Kinds of decisions: lines to drop; lines of a key that the partition can't decide, as it is its first or last one or has too many rows; that key's count here, with its largest document.
DROP, OPEN, COUNT = 0, 1, 2
#: Rows of a key that are held while it has too few documents.
HELD = 1000


def line_keys(docs: DataFrame, least: int) -> DataFrame:
    """hi, lo (hash of a key of at least least code points), k, th (document and text), n_lines (of the text), places (of the key's lines, as 32-bit integers): a row per key and text."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            his, los, rows, places, lines = [], [], [], [], []
            for row, text in enumerate(batch.column(2).to_pylist()):
                if text is None or len(text) < least:
                    continue
                own: dict[str, list[int]] = {}
                for place, line in enumerate(split := text.split("\n")):
                    if len(line) >= least and len(key := line.strip(WHITE)) >= least:
                        own.setdefault(key.translate(LOWER), []).append(place)
                for key, at in own.items():
                    h = xxhash.xxh3_128_intdigest(key.encode())
                    his.append((h >> 64) - (1 << 63))
                    los.append((h & 0xFFFFFFFFFFFFFFFF) - (1 << 63))
                    rows.append(row)
                    lines.append(len(split))
                    places.append(np.array(at, "<u4").tobytes())
            taken = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(his, pa.int64()), pa.array(los, pa.int64()), batch.column(0).take(taken), batch.column(1).take(taken), pa.array(lines, pa.int32()), pa.array(places, pa.binary())], names=["hi", "lo", "k", "th", "n_lines", "places"])

    return docs.select("k", "th", "text").mapInArrow(keys, "hi long, lo long, k long, th long, n_lines int, places binary")


def stream(batches: Iterator[pa.RecordBatch], least_docs: int) -> Iterator[pa.RecordBatch]:
    """Decisions of one sorted partition. Holds up to HELD rows of a key until least_docs documents are seen; more of them, as rows with one doc_id can be, stay open."""
    out: list[tuple] = []
    held: list[tuple] = []  # rows of this key, while it has too few documents
    key: tuple[int, int] | None = None
    first, counted, n, last, top = True, False, 0, None, None

    def close(edge: bool) -> None:
        if key is not None and (edge or counted):
            out.extend((OPEN, *key, k, th, 0, n_lines, places) for k, th, n_lines, places in held)
            out.append((COUNT, *key, top, 0, n, 0, b""))

    for batch in slices(batches, 10_000):
        for hi, lo, k, th, n_lines, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (hi, lo) != key:
                close(first)
                first = key is None
                key, held, counted, n, last, top = (hi, lo), [], False, 0, None, k
            if k != last:
                n, last = n + 1, k
            if first or n < least_docs:
                if len(held) >= HELD:
                    out.extend((OPEN, *key, a, b, 0, *c) for a, b, *c in held)
                    held, counted = [], True
                held.append((k, th, n_lines, places))
            else:
                out.extend((DROP, *key, a, b, 0, *c) for a, b, *c in held if a != top)
                held = []
                out.append((DROP, hi, lo, k, th, 0, n_lines, places))
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), FIELDS.types, strict=True)], schema=FIELDS)
                out = []
    close(True)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), FIELDS.types, strict=True)], schema=FIELDS)


def line_bitmaps(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """k (doc_id, or NO_ID for null), th (XXH64 of the text), n_lines, keep: for each text that loses lines, a zlib-compressed bitmap of its lines, the first in the highest bit, 1 for those that stay. Texts without a row keep all lines.

    docs: doc_id, text; other columns are left alone. A line loses its place if its
    key (stripped of white space, A-Z lower-cased) has at least least_chars code
    points and stands in at least least_docs documents, of which this is not the one
    with the largest doc_id. Rows with equal doc_id count as one document and null
    as the smallest doc_id. Null, empty and short texts lose nothing. A very long text
    is split into lines by one task. An empty table gives no bitmaps.
    """
    rows = docs.select(id_key().alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    keys = stored(line_keys(rows, least_chars))
    order = ("hi", "lo", F.col("k").desc())
    decided = stored(keys.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda batches: stream(batches, least_docs), DECISION))
    discard(keys)
    totals = decided.where(F.col("kind") == COUNT).groupBy("hi", "lo").agg(F.sum("n").alias("docs"), F.max("k").alias("top"))  # few keys: two per partition, and those with over HELD rows of few documents
    late = decided.where(F.col("kind") == OPEN).join(totals, ["hi", "lo"]).where((F.col("docs") >= least_docs) & (F.col("k") != F.col("top")))
    fields = ("k", "th", "n_lines", "places")
    drops = decided.where(F.col("kind") == DROP).select(*fields).unionByName(late.select(*fields))
    return drops.groupBy("k", "th", "n_lines").agg(F.collect_list("places").alias("places")).mapInArrow(bitmaps, "k long, th long, n_lines int, keep binary")


def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1000):
        keep = []
        for n, places in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            bits = np.ones(n, np.uint8)
            bits[np.frombuffer(b"".join(places), "<u4")] = 0
            keep.append(zlib.compress(np.packbits(bits).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(keep, pa.binary())], names=["k", "th", "n_lines", "keep"])


def without_lines(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """doc_id, n_lines (before), n_dropped, kept (the text that stays) for each row of docs, under the bitmaps of line_bitmaps(docs)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            n_lines, n_dropped, kept = [], [], []
            for text, packed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = text or ""
                n = text.count("\n") + 1
                dropped = 0
                if packed is not None:
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), count=n)
                    dropped = n - int(bits.sum())
                    text = "\n".join(itertools.compress(text.split("\n"), bits))
                n_lines.append(n)
                n_dropped.append(dropped)
                kept.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"])

    rows = docs.select(id_key().alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    return rows.join(keep, ["k", "th"], "left").select(id_back("k").alias("doc_id"), "text", "keep").mapInArrow(apply, "doc_id long, n_lines long, n_dropped long, kept string")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return without_lines(docs, line_bitmaps(docs)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(coalesce(doc_id, -9223372036854775808)) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT coalesce(doc_id, -9223372036854775808)) >= 5),
m AS (SELECT k.*, g.key IS NOT NULL AND coalesce(k.doc_id, -9223372036854775808) <> g.top AS gone FROM k LEFT JOIN g USING (key))
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""
