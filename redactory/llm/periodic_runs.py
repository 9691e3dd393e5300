"""Runs of repeated words within a document: stretches in which the words come round with a period.

A run of period q and length L >= max(m, 2q) holds each of its stretches of L - q
words twice, and L - q >= k = ceil(m / 2) whatever q is. So each word of a run stands
in a stretch of k words that its document repeats. Words outside such stretches are
masked; what is left falls into segments, and a run lies within one of them. Main and
Lorentz's search then looks at the segments alone: around each centre of a halving it
compares the words to both sides at each distance p, and where they agree over p words
or more there is a run of period p. The halvings of all segments of a batch go level by
level in numpy, and common extensions are read off ranks of stretches of 1, 2, 4, ... words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.llm.common import WHITE, slices, table, text_runs

#: A run has so many words at least.
LEAST = 12


def grams(words: np.ndarray, docs: np.ndarray, width: int) -> np.ndarray:
    """Which words stand in a stretch of width words that is found twice or more in its document. words and docs: numbers of each word and of its document. Stretches are told apart by 64-bit hashes; a collision only leaves words unmasked."""
    covered = np.zeros(len(words), bool)
    n = len(words) - width + 1
    if n < 2:
        return covered
    with np.errstate(over="ignore"):
        mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        h = np.zeros(n, np.uint64)
        for j in range(width):
            h = h * np.uint64(0x94D049BB133111EB) + mixed[j : j + n]
        h ^= (docs[:n].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    at = np.flatnonzero(docs[:n] == docs[width - 1 :])
    order = at[np.argsort(h[at], kind="stable")]
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, order[twice], 1)
    np.add.at(steps, order[twice] + width, -1)
    return np.cumsum(steps[:-1]) > 0


def ranks(x: np.ndarray, longest: int) -> list[np.ndarray]:
    """For each k with 2^k <= longest: numbers of the places, equal where the next 2^k words are. x ends with a word that stands nowhere else. Stops where no two places are equal."""
    names, back = np.unique(x, return_inverse=True)
    found = [back]
    while len(names) < len(x) and 2 << (len(found) - 1) <= longest:
        half = 1 << (len(found) - 1)
        after = np.zeros(len(x), np.int64)
        after[:-half] = found[-1][half:] + 1
        names, back = np.unique(found[-1].astype(np.int64) * (len(x) + 1) + after, return_inverse=True)
        found.append(back.astype(np.int32))
    return found


def extensions(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For places a < b: how many words from a on equal those from b on, and how many before a equal those before b."""
    ahead, i, j = np.zeros(len(a), np.int64), a.copy(), b.copy()
    for k in reversed(range(len(levels))):
        step = (levels[k][i] == levels[k][j]).astype(np.int64) << k
        ahead, i, j = ahead + step, i + step, j + step
    behind, i, j = np.zeros(len(a), np.int64), a.copy(), b.copy()
    for k in reversed(range(len(levels))):
        size = 1 << k
        step = ((i >= size) & (levels[k][i - size] == levels[k][j - size])).astype(np.int64) << k
        behind, i, j = behind + step, i - step, j - step
    return ahead, behind


def runs_of(x: np.ndarray, least: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of each run of least words or more in x. x: numbers of words, with a number that stands nowhere else before, between and after the segments, none of which is longer than longest.

    A run crosses one centre of the highest level that it crosses any of, and from
    there has a period's words to one side. It is found there, by each multiple of its
    period as well; the smallest is kept. Extensions are not bound by the halving, so
    each find is maximal.
    """
    none = np.zeros(0, np.int64)
    levels = ranks(x, longest)
    floor = ((least + 1) // 2 + 1) // 2  # one of the two extensions has so many words
    sieve = max(floor, 1).bit_length() - 1
    if sieve >= len(levels):
        return none, none, none
    quick = levels[sieve]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    half = 1
    while half < len(x):
        centres = np.arange(half, len(x), 2 * half)
        periods = np.arange(1, min(half, longest // 2) + 1)
        c, p = np.repeat(centres, len(periods)), np.tile(periods, len(centres))
        for a, b in ((c, c + p), (c - p, c)):
            inside = b < len(x)
            near = inside & (a >= 0)
            low, high = a[near], b[near]
            back = 1 << sieve
            maybe = (quick[low] == quick[high]) | ((low >= back) & (quick[low - back] == quick[high - back]))
            low, high, q = low[maybe], high[maybe], p[near][maybe]
            ahead, behind = extensions(levels, low, high)
            ok = (ahead + behind >= q) & (ahead + behind + q >= least)
            found.append(((low - behind)[ok], (high + ahead)[ok], q[ok]))
        half *= 2
    start, end, period = (np.concatenate(v) for v in zip(*found, strict=True))
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[first], end[first], period[first]


def segments(covered: np.ndarray, docs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of unmasked words of one document, of least words or more."""
    inside = covered.copy()
    joined = inside[1:] & inside[:-1] & (docs[1:] == docs[:-1])
    starts = np.flatnonzero(inside & ~np.concatenate([[False], joined]))
    ends = np.flatnonzero(inside & ~np.concatenate([joined, [False]])) + 1
    long = ends - starts >= least
    return starts[long], ends[long]


def found_in(words: np.ndarray, docs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs, by places in words, sorted."""
    covered = grams(words, docs, (least + 1) // 2)
    begin, end = segments(covered, docs, least)
    none = np.zeros(0, np.int64)
    if not len(begin):
        return none, none, none
    sizes = end - begin
    at = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) + 1  # of each segment in x
    x = np.arange(int((sizes + 1).sum()) + 1, dtype=np.int64) + (int(words.max()) + 1)
    place = np.repeat(begin - at, sizes) + (inner := np.repeat(at - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum())))
    x[inner] = words[place]
    s, e, q = runs_of(x, least, int(sizes.max()))
    shift = (begin - at)[np.searchsorted(at, s, "right") - 1]
    return s + shift, e + shift, q


def batch_runs(texts: list[str | None], least: int) -> dict[str, list]:
    """For each text: its number of words, its runs, and its text without what runs repeat."""
    names: dict[bytes, int] = {}
    split = [(t or "").encode().split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    words = np.fromiter((names.setdefault(w, len(names)) for ws in split for w in ws), np.int64, int(sizes.sum()))
    docs = np.repeat(np.arange(len(split)), sizes)
    first = np.cumsum(sizes) - sizes
    start, end, period = found_in(words, docs, least)
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, start + period, 1)
    np.add.at(steps, end, -1)
    dropped = np.cumsum(steps[:-1]) > 0
    owner = docs[start] if len(start) else np.zeros(0, np.int64)
    cut = np.searchsorted(owner, np.arange(len(split) + 1))
    out: dict[str, list] = {c: [] for c in ("n_words", "starts", "lengths", "periods", "collapsed")}
    for d, ws in enumerate(split):
        a, b = cut[d], cut[d + 1]
        out["n_words"].append(len(ws))
        out["starts"].append((start[a:b] - first[d]).tolist())
        out["lengths"].append((end[a:b] - start[a:b]).tolist())
        out["periods"].append(period[a:b].tolist())
        if a < b:
            drop = dropped[first[d] : first[d] + len(ws)]
            ws = [w for w, gone in zip(ws, drop.tolist(), strict=True) if not gone]
        out["collapsed"].append(b" ".join(ws).decode())
    return out


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period; by start, then period), collapsed, for each row of docs (doc_id, text; other columns are left alone).

    Words are runs of characters other than space and U+0009 to U+000D, numbered from 0.
    A run is a stretch of least words or more and of two periods or more, with its
    smallest period, that no neighbouring word extends. collapsed has the words that no
    run holds after its first period, joined by one blank. Null and empty texts have no
    words. A null doc_id is kept; repeated rows are judged each on its own. A text is one
    task's: some hundred bytes for each of its words, and 4 more for each of its unmasked
    words and each doubling. An empty table gives an empty result.
    """
    if least < 2:
        raise ValueError("a run has two words at least")
    kind = pa.list_(pa.int64())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            for run in text_runs([t or "" for t in texts]):
                got = batch_runs([texts[i] for i in run], least)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(run.start, len(run)), pa.array(got["n_words"], pa.int64()), *(pa.array(got[c], kind) for c in ("starts", "lengths", "periods")), pa.array(got["collapsed"], pa.string())],
                    names=["doc_id", "n_words", "starts", "lengths", "periods", "collapsed"],
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(build, f"doc_id {id_type}, n_words long, starts array<long>, lengths array<long>, periods array<long>, collapsed string")
    runs = F.transform(F.arrays_zip("starts", "lengths", "periods"), lambda r: F.struct(r.starts.alias("start"), r.lengths.alias("length"), r.periods.alias("period")))
    return found.select("doc_id", "n_words", runs.alias("runs"), "collapsed")


def with_cycles(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with known runs in a tenth of the texts: h is the CRC-32 of the decimal doc_id and g = h div 10; where h ends in 0, each word i from a = g mod n on becomes word a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8). A null doc_id leaves its text alone."""
    words: Column = F.split(F.btrim(F.col("text"), F.lit(WHITE)), "[\\x20\\x09-\\x0D]+")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    has = (h % 10 == 0) & (F.coalesce(F.btrim(F.col("text"), F.lit(WHITE)), F.lit("")) != "")
    plain = docs.select("doc_id", "text").where(~F.coalesce(has, F.lit(False)))
    cut = docs.select("doc_id", "text").where(has).select("doc_id", F.floor(h / 10).cast("long").alias("g"), F.explode(F.array(words)).alias("w"))
    cut = cut.withColumn("a", F.col("g") % F.size("w")).withColumn("p", F.lit(1) + F.floor((F.size("w") - F.col("a")) / (3 + F.col("g") % 8)).cast("long"))
    cycle = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.element_at("w", (F.lit(1) + F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return plain.unionByName(cut.select("doc_id", F.array_join(cycle, " ").alias("text")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_cycles(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("back"), (-r.period).alias("less"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))), "")
    top = found.withColumn("best", best)
    return top.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.back")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.less")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.less")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
