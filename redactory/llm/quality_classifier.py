"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text's terms are hashed trigrams of its bytes and of their shapes (letters of one
case are alike, punctuation is itself). Terms are weighted by TF-IDF and projected on
the leading singular vectors of the labelled sample. That sample is bounded, so its
vectors and the projection are broadcast; every document is compared with all of them
by blocked cosine products, and its score is the mean label of its nearest, weighted
by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.llm.common import slices, table, text_runs

#: Cells of the hashed trigrams of shapes, and of those of bytes.
HASHED = 1024
TERMS = 2 * HASHED
#: Bytes whose trigrams are counted at a time.
PART = 1 << 20
#: Rows that are compared with the sample at a time.
ROWS = 256
#: Bits of a weighted count and of a number of the projection (with 11 for the sum over TERMS, 51 of 53); of a number of a vector (with 6 for the sum over the rank, 50).
TERM_BITS, VECTOR_BITS = 20, 22


@dataclass(frozen=True)
class Settings:
    """sample: the most labelled rows that are learnt from, those with the lowest hash of doc_id among those that have a document. rank: dimensions of the vectors. neighbours: how many vote. sharpness: power of the similarity in a vote's weight."""

    sample: int = 6000
    rank: int = 64
    neighbours: int = 24
    sharpness: float = 8.0
    seed: int = 20


DEFAULT = Settings()


def shapes() -> np.ndarray:
    """A class for each byte: lower case, upper case, digit, lead or other byte of a longer character, else itself."""
    kind = np.arange(256, dtype=np.uint32)
    for first, last, to in (("a", "z", "a"), ("A", "Z", "A"), ("0", "9", "0")):
        kind[ord(first) : ord(last) + 1] = ord(to)
    kind[0x80:0xC0], kind[0xC0:] = 0x80, 0xC0
    return kind


SHAPES = shapes()


def terms(texts: list[str]) -> np.ndarray:
    """A row of TERMS counts per text."""
    raws = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raws), np.uint8)
    lengths = np.array([len(r) for r in raws])
    out = np.zeros((len(raws), TERMS), np.float32)
    ends = np.cumsum(lengths)
    for at in range(0, len(data), PART):
        part = data[at : at + PART + 2]
        place = np.arange(at, at + max(len(part) - 2, 0))
        doc = np.searchsorted(ends, place, side="right")
        whole = place + 2 < ends[doc]
        for base, codes in ((0, SHAPES[part]), (HASHED, part.astype(np.uint32))):
            h = codes[:-2] * np.uint32(0x9E3779B1) ^ codes[1:-1] * np.uint32(0x85EBCA77) ^ codes[2:] * np.uint32(0xC2B2AE3D)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x27D4EB2F)
            cell = (h >> np.uint32(22)).astype(np.int64)
            first = int(doc[0]) if len(doc) else 0
            n = int(doc[-1]) - first + 1 if len(doc) else 0
            out[first : first + n, base : base + HASHED] += np.bincount(((doc - first) * HASHED + cell)[whole], minlength=n * HASHED).reshape(n, HASHED)
    return out


#: Where each family of terms begins, and its weight; each is scaled to length 1 first, as a long family would drown the others.
FAMILIES = ((0, HASHED, 1.0), (HASHED, TERMS, 0.4))


def weighted(counts: np.ndarray, idf: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """TF-IDF vectors, in out if given, which may be counts."""
    x = np.log1p(counts, out=out)
    x *= idf
    for a, b, weight in FAMILIES:
        x[:, a:b] *= weight / np.maximum(np.linalg.norm(x[:, a:b], axis=1, keepdims=True), 1e-9)
    return x


def grid(x: np.ndarray, bits: int) -> np.ndarray:
    """x, rounded to multiples of 2**-bits. Products of such numbers and their sums are exact in float64, in whatever order the library adds, so equal texts have equal scores wherever they stand in a batch."""
    return np.ldexp(np.rint(np.ldexp(x.astype(np.float64), bits)), -bits)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fit(counts: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inverse document frequencies, projection, and the sample's vectors. counts is used up, so that there is one table of its size."""
    idf = (np.log((1 + len(counts)) / (1 + np.count_nonzero(counts, axis=0))) + 1).astype(np.float32)
    x = weighted(counts, idf, counts)
    basis = np.random.default_rng(settings.seed).standard_normal((TERMS, min(settings.rank + 16, len(x)))).astype(np.float32)
    for _ in range(4):  # subspace iteration towards the leading singular vectors
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    _, _, turn = np.linalg.svd(x @ basis, full_matrices=False)
    projection = np.ascontiguousarray(grid((basis @ turn.T)[:, : settings.rank], TERM_BITS))
    return idf, projection, placed(x, projection)


def placed(x: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Unit vectors of weighted counts, some rows at a time, as the grid takes several times the room."""
    out = np.empty((len(x), projection.shape[1]))
    for at in range(0, len(x), ROWS):
        out[at : at + ROWS] = grid(unit(grid(x[at : at + ROWS], TERM_BITS) @ projection), VECTOR_BITS)
    return out


@dataclass(frozen=True)
class Model:
    """What fit() gives of a sample, its labels, and bare: the score of texts without a term, the mean label of the sample's such texts, or else of all."""

    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    bare: float


def vote(z: np.ndarray, vectors: np.ndarray, labels: np.ndarray, settings: Settings) -> np.ndarray:
    """Scores of unit vectors z. Of vectors equally near, those of the smaller labels' ids come first."""
    k = min(settings.neighbours, len(vectors))
    out = np.empty(len(z))
    for at in range(0, len(z), ROWS):
        near = z[at : at + ROWS] @ vectors.T
        least = np.partition(near, -k, axis=1)[:, -k]
        above, equal = near > least[:, None], near == least[:, None]
        free = k - np.count_nonzero(above, axis=1)
        if (np.count_nonzero(equal, axis=1) > free).any():
            equal &= np.cumsum(equal, axis=1) <= free[:, None]
        row, top = np.nonzero(above | equal)  # k a row
        weight = np.clip(near[row, top].reshape(-1, k), 1e-6, 1) ** settings.sharpness
        out[at : at + ROWS] = (weight * labels[top].reshape(-1, k)).sum(axis=1) / weight.sum(axis=1)
    return np.clip(out, 0, 1)


def scored(texts: list[str], model: Model, settings: Settings) -> np.ndarray:
    counts = terms(texts)
    some = counts.any(axis=1)
    found = np.full(len(texts), model.bare)
    if some.any():
        found[some] = vote(placed(weighted(counts[some], model.idf), model.projection), model.vectors, model.labels, settings)
    return found


def labelled(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, y, text: the sample. Of several texts of a doc_id the smallest is taken; a doc_id with both labels is there with each."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("y")).distinct()
    sample = known.join(docs.select(F.col("doc_id").alias("label_id")), "label_id", "left_semi").orderBy(F.xxhash64("label_id"), "label_id", "y").limit(settings.sample)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))  # settings.sample bounds what is broadcast
    return rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def learnt(docs: DataFrame, labels: DataFrame, settings: Settings) -> Model | None:
    """None without labelled rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(2).to_pylist()
            for group in text_runs(texts):
                rows = terms([texts[k] for k in group]).astype("<f4")
                packed = [zstandard.ZstdCompressor().compress(r.tobytes()) for r in rows]  # mostly zeros
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(group.start, len(group)) for c in (0, 1)), pa.array(packed, pa.binary())], names=["id", "y", "x"])

    found = sorted(labelled(docs, labels, settings).mapInArrow(count, "id long, y int, x binary").collect(), key=lambda r: (r.id, r.y))  # bounded by settings.sample
    if not found:
        return None
    counts, some, unpack, n = np.empty((len(found), TERMS), np.float32), np.zeros(len(found), bool), zstandard.ZstdDecompressor(), 0
    for k, r in enumerate(found):  # those with terms, one after the other, in the only table of this size
        counts[n] = np.frombuffer(unpack.decompress(r.x), "<f4")
        some[k] = counts[n].any()
        n += int(some[k])
    y = np.array([r.y for r in found], np.float64)
    bare = float(y[~some].mean() if not some.all() else y.mean())
    return Model(*fit(counts[:n], settings), y[some], bare) if n else Model(*[np.zeros((0, 0))] * 4, bare)


def judged(docs: DataFrame, labels: DataFrame, settings: Settings):
    """A function that gives the scores of texts, for the executors."""
    shared = docs.sparkSession.sparkContext.broadcast(learnt(docs, labels, settings))

    def scores(texts: list[str | None]) -> np.ndarray:
        model, whole = shared.value, [t or "" for t in texts]
        if model is None or not len(model.vectors):
            return np.full(len(whole), 0.5 if model is None else model.bare)
        return np.concatenate([scored([whole[k] for k in group], model, settings) for group in text_runs(whole)])

    return scores


def score(docs: DataFrame, labels: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier) and predicted (1 from 0.5 on) for each row of docs (doc_id, text; other columns are left alone).

    labels: doc_id, quality (0 or 1; other values and null ids are left out). At most
    settings.sample of its rows are learnt from. Null and empty texts, and others of
    under three bytes, have no terms: their score is the mean label of the sample's
    texts without terms, or else of the whole sample. Without usable labels every score
    is 0.5. Equal texts have equal scores, whatever their ids; of repeated ids the
    smallest text is learnt from. A very long text is counted piece by piece by one
    task. An empty table gives an empty result.
    """
    scores = judged(docs, labels, settings)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(judge, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The rows of docs, with all their columns, that score() predicts 1 for, under its rules for nulls, ties and empty tables."""
    scores, at = judged(docs, labels, settings), docs.columns.index("text")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(scores(batch.column(at).to_pylist()) >= 0.5))

    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # names may hold dots
    return plain.mapInArrow(sift, plain.schema).toDF(*docs.columns)


def fold(column: str = "doc_id"):
    """crc32 of the id as text, modulo 3."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = score(docs, table(spark, sf_dir, "labels").where(fold() != 1))
    return scores.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score", "predicted")
