"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are laid out in cells by the population counts of their four
quarters and cut into tiles. Two fingerprints within the radius differ by at most
the radius in the sum of their quarters' count differences, so a tile meets the
tiles of near cells only; such a pair of tiles is compared in full by exclusive-or
and bit counts. From each pair of tiles a forest of links goes on, which connects
what all links would; the components follow from these.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.llm.common import discard, id_back, id_key, slices, spread_join, stored, table, text_hash
from redactory.llm.components import connected

TILE = 1024
#: Tiles of a cell, and tiles that are compared with them, that meet under one key.
PART = 32
#: Members of a linked group hang below each other in a tree with so many branches, so that no fingerprint gets many links.
BRANCHES = 16
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED = 42


def shingle_hashes(text: str, width: int) -> list[int]:
    """XXH64 of each run of width words, joined by blanks; of all words if there are fewer; nothing without words."""
    words = text.encode().translate(LOWER).split()
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    joined = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends[: len(words) - width])]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :], strict=True)]


def fingerprints(docs: DataFrame, width: int = 3, hashed: bool = False) -> DataFrame:
    """k (doc_id, or NO_ID for null), fp, and th (the text's hash) if hashed: a bit is 1 if it is 1 in over half of the text's shingle hashes. Null texts count as empty, with fingerprint 0."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = np.zeros(len(batch), np.uint64)
            for row, text in enumerate(batch.column(1).to_pylist()):
                if hashes := shingle_hashes(text or "", width):
                    raw = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)
                    n = np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
                    out[row] = np.packbits(2 * n > len(hashes)).view(">u8")[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64)), *batch.columns[2:]], names=["k", "fp", *more])

    more = ["th"] if hashed else []
    return docs.select(id_key().alias("k"), "text", *[text_hash().alias(c) for c in more]).mapInArrow(build, ", ".join(f"{c} long" for c in ["k", "fp", *more]))


def near_cells(cell: int, radius: int) -> list[int]:
    """cell and the cells with greater numbers whose counts differ from its by radius in sum at most. A cell's number holds the four counts, five bits each."""
    counts = [cell >> 5 * q & 31 for q in range(4)]
    steps = range(-radius, radius + 1)
    found = []
    for d in itertools.product(steps, repeat=4):
        moved = [c + x for c, x in zip(counts, d, strict=True)]
        if sum(map(abs, d)) <= radius and all(0 <= m <= 16 for m in moved) and (other := sum(m << 5 * q for q, m in enumerate(moved))) >= cell:
            found.append(other)
    return found


def tiles(distinct: DataFrame, radius: int) -> DataFrame:
    """fp (distinct) -> cell, tile, fps (packed), near (the cells to compare with). A cell with many fingerprints has many tiles, over several partitions."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        cell, held = None, []
        done: list[tuple] = []

        def close() -> None:
            nonlocal n, held
            if held:
                done.append((cell, (part << 32) + n, np.array(held, np.int64).tobytes(), near_cells(cell, radius)))
                n, held = n + 1, []

        for batch in batches:
            for c, fp in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if c != cell or len(held) >= TILE:
                    close()
                    cell = c
                held.append(fp)
            if done:
                yield pa.RecordBatch.from_pydict(dict(zip(TILES.names, zip(*done, strict=True), strict=True)), TILES)
                done = []
        close()
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(TILES.names, zip(*done, strict=True), strict=True)), TILES)

    quarter = lambda q: F.shiftleft(F.bit_count(F.shiftrightunsigned("fp", 16 * q).bitwiseAND(F.lit(0xFFFF))), 5 * q)
    cells = distinct.select((quarter(0) + quarter(1) + quarter(2) + quarter(3)).alias("cell"), "fp")
    return cells.repartitionByRange("cell", "fp").sortWithinPartitions("cell", "fp").mapInArrow(cut, "cell int, tile long, fps binary, near array<int>")


TILES = pa.schema([("cell", pa.int32()), ("tile", pa.int64()), ("fps", pa.binary()), ("near", pa.list_(pa.int32()))])


def forest(i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect just what the links (i, j) between fingerprints connect."""
    names, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    x, y = at[: len(i)], at[len(i) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            break
    order = np.argsort(label, kind="stable")
    first = np.flatnonzero(np.diff(label[order], prepend=-1))
    begin = np.repeat(first, np.diff(first, append=len(order)))
    rank = np.arange(len(order)) - begin
    child = np.flatnonzero(rank)
    parent = begin[child] + (rank[child] - 1) // BRANCHES
    members = names[order]
    return list(zip(members[parent].tolist(), members[child].tolist(), strict=True))


def compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1000):
        a, b = [], []
        for own, other in zip(batch.column(0), batch.column(1), strict=True):
            x, y = np.frombuffer(own.as_buffer(), np.int64), np.frombuffer(other.as_buffer(), np.int64)
            close = np.bitwise_count(x.view(np.uint64)[:, None] ^ y.view(np.uint64)[None, :]) <= radius
            i, j = np.nonzero(close)
            i, j = x[i], y[j]
            real = i != j
            if real.any():
                for p, q in forest(i[real], j[real]):
                    a.append(p)
                    b.append(q)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """fp (distinct) -> a, b: links whose components are those of all pairs within the radius."""
    laid = stored(tiles(distinct, radius))
    left = laid.select(F.explode("near").alias("cell"), F.col("cell").alias("home"), F.col("tile").alias("t"), F.col("fps").alias("own"))
    n = left.groupBy("cell").agg(F.count("*").alias("n_left")).join(laid.groupBy("cell").agg(F.count("*").alias("n_own")), "cell")
    parts = n.select("cell", F.ceil(F.col("n_own") / PART).cast("int").alias("rights"), F.ceil(F.col("n_left") / PART).cast("int").alias("lefts"))
    parts = F.broadcast(parts)  # a row per cell, of which there are 17^4 at most
    every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    dealt = lambda tile, m: F.pmod(F.xxhash64(tile), F.col(m)).cast("int")
    asking = left.join(parts, "cell").withColumn("x", dealt("t", "lefts")).withColumn("y", every("rights")).select("cell", "x", "y", "home", "t", "own")
    asked = laid.join(parts, "cell").withColumn("y", dealt("tile", "rights")).withColumn("x", every("lefts")).select("cell", "x", "y", "tile", F.col("fps").alias("other"))
    pairs = asking.join(asked, ["cell", "x", "y"]).where((F.col("home") != F.col("cell")) | (F.col("t") <= F.col("tile")))
    return pairs.select("own", "other").mapInArrow(lambda batches: compare(batches, radius), "a long, b long")


def linked_fingerprints(rows: DataFrame, least: Column, radius: int) -> tuple[DataFrame, DataFrame]:
    """The distinct fingerprints of rows, each with its smallest least and its number of rows, n; and node, label: those that have links, with their component."""
    distinct = stored(rows.groupBy("fp").agg(F.min(least).alias("least"), F.count("*").alias("n")))
    found = stored(links(distinct.select("fp"), radius))
    labels = connected(found)
    discard(found)
    return distinct, labels


def component_firsts(docs: DataFrame, radius: int = 2, width: int = 3) -> DataFrame:
    """k, th: for each component of near-duplicates, of null doc_ids as well, its row with the smallest doc_id and then text hash; null is smaller than any."""
    distinct, labels = linked_fingerprints(stored(fingerprints(docs, width, hashed=True)), F.struct("k", "th"), radius)
    of_fp = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
    return of_fp.groupBy(F.coalesce("label", "fp").alias("root")).agg(F.min("least").alias("first")).select("first.k", "first.th")


def near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3) -> DataFrame:
    """doc_id, fp, component_id for each row of docs (doc_id, text; other columns are left alone).

    Documents whose fingerprints differ in radius bits or fewer are linked, and
    component_id is the smallest doc_id that a document reaches; null is smaller
    than any. Null and empty texts have fingerprint 0 and are linked like others.
    Rows with the same doc_id are linked by their fingerprints only. A very long text
    is one task's. An empty table gives an empty result.
    """
    rows = stored(fingerprints(docs, width))
    distinct, labels = linked_fingerprints(rows, F.col("k"), radius)
    linked = stored(labels.join(distinct.select(F.col("fp").alias("node"), "least"), "node").select("node", "label", "least"))
    least = stored(linked.groupBy("label").agg(F.min("least").alias("component"), F.count("*").alias("size")))
    component = spread_join(linked.select("node", "label"), least, ["label"], "size", linked.count()).select(F.col("node").alias("fp"), "component")
    of_fp = stored(distinct.join(component, "fp", "left").select("fp", "n", F.coalesce("component", "least").alias("component")))
    return spread_join(rows, of_fp, ["fp"], "n", rows.count()).select(id_back("k").alias("doc_id"), "fp", id_back("component").alias("component_id"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
