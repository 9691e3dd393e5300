"""Near-duplicate vectors by an inverted multi-index.

Equal vectors of a label are first made one, with their number. Codebooks for the two
halves of a vector are fitted on a bounded sample; the pairs of their centroids are the
cells of the index, and each vector lies in its nearest. A vector visits the cells in the
order of their distance, as far as the target recall asks, which is measured on the
sample. Of two vectors the one in the cell with the greater number visits the other, so
no pair is met twice. In a visited cell all vectors are compared in double precision.
Cells with many vectors or visits are cut into parts, and each part of the one meets each
part of the other. What goes on is numbers of links and a forest of them, never all pairs.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from redactory.llm.common import discard, id_back, id_key, if_small, slices, spread_join, stored, table
from redactory.llm.components import connected
from redactory.llm.simhash import forest


@dataclass(frozen=True)
class Settings:
    """sample: different vectors that the codebooks are fitted on, at most. members: vectors that a cell of a label should have. part: vectors or visits of a cell that one group compares at most. recall: of neighbours at just the threshold, the share whose cell is visited."""

    threshold: float = 0.93
    sample: int = 16_384
    members: int = 64
    part: int = 2048
    rounds: int = 12
    recall: float = 0.999
    seed: int = 7


@dataclass(frozen=True)
class Index:
    """Centroids of both halves, and how much farther than the nearest a visited cell may be, in squared distance. split: length of the first half; width: of whole vectors, shorter ones end in zeros."""

    first: np.ndarray
    second: np.ndarray
    reach: float
    split: int
    width: int


def units(raw: list[bytes], kind: type, width: int) -> np.ndarray:
    """Vectors of length 1, one a row, in double precision, filled up with zeros. Scaled by their greatest component first, as squares could overflow or vanish."""
    out = np.zeros((len(raw), width))
    for i, r in enumerate(raw):
        v = np.frombuffer(r, kind)
        out[i, : len(v)] = v
    out /= np.abs(out).max(axis=1, keepdims=True, initial=0)
    return out / np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]


def named(vectors: DataFrame, column: str, kind: type) -> DataFrame:
    """k, label, dim, name (MD5 of the vector), raw (its bytes; -0 is 0): the last three are null for vectors that link with nothing."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            col, labels = batch.column(2), batch.column(1)
            flat = np.asarray(col.values.to_numpy(zero_copy_only=False), kind) + kind(0)
            ends, there = col.offsets.to_numpy(), pa.compute.and_(col.is_valid(), labels.is_valid()).to_numpy(zero_copy_only=False)
            good = np.isfinite(flat)
            dims, names, raws = [], [], []
            for a, b, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), there.tolist(), strict=True):
                v = flat[a:b]
                if ok and b > a and good[a:b].all() and v.any():
                    raw = v.tobytes()
                    dims.append(b - a)
                    names.append(hashlib.md5(raw, usedforsecurity=False).digest())
                    raws.append(raw)
                else:
                    dims.append(None)
                    names.append(None)
                    raws.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), labels, pa.array(dims, pa.int32()), pa.array(names, pa.binary()), pa.array(raws, pa.binary())], names=["k", "label", "dim", "name", "raw"])

    label = vectors.schema["label"].dataType.simpleString()
    return vectors.select(id_key("vec_id").alias("k"), "label", F.col(column).cast("array<float>" if kind is np.float32 else "array<double>")).mapInArrow(build, f"k long, label {label}, dim int, name binary, raw binary")


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared, of rows of x to rows of centroids."""
    d = (x * x).sum(axis=1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(axis=1)
    return np.maximum(d, 0)


def codebook(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """k centroids by Lloyd's rounds from the first k rows."""
    centroids = x[:k].copy()
    for _ in range(rounds):
        near = distances(x, centroids).argmin(axis=1)
        n = np.bincount(near, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def excesses(index: Index, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For unit vectors: squared distances of both halves to the centroids beyond the nearest's, and the number of the cell that each lies in."""
    d1, d2 = distances(x[:, : index.split], index.first), distances(x[:, index.split :], index.second)
    home = d1.argmin(axis=1) * len(index.second) + d2.argmin(axis=1)
    return d1 - d1.min(axis=1, keepdims=True), d2 - d2.min(axis=1, keepdims=True), home


def multi_sequence(first: np.ndarray, second: np.ndarray, reach: float) -> list[int]:
    """Numbers of the cells in ascending order of first[i] + second[j], up to reach. Both sequences are sorted once, and a heap holds the border of the cells passed."""
    a, b = np.flatnonzero(first <= reach), np.flatnonzero(second <= reach)
    a, b = a[np.argsort(first[a], kind="stable")], b[np.argsort(second[b], kind="stable")]
    x, y, width = first[a].tolist(), second[b].tolist(), len(second)
    heap, found = [(x[0] + y[0], 0, 0)], []
    while heap:
        d, i, j = heapq.heappop(heap)
        if d > reach:
            break
        found.append(int(a[i]) * width + int(b[j]))
        if j + 1 < len(y):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
    return found


def needed(index: Index, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For pairs of rows of x and y: how far the one in the cell with the greater number must reach to visit the other's cell."""
    (x1, x2, xh), (y1, y2, yh) = excesses(index, x), excesses(index, y)
    r, w = np.arange(len(x)), len(index.second)
    return np.where(xh >= yh, x1[r, yh // w] + x2[r, yh % w], y1[r, xh // w] + y2[r, xh % w])


def fitted(raw: list[bytes], labels: list, kind: type, width: int, cells: float, cfg: Settings) -> Index:
    """The index of a sample: about cells cells. The reach covers the share cfg.recall of neighbours at just the threshold in random directions, and of the sample's own pairs within it."""
    split = (width + 1) // 2
    x = units(raw, kind, width)
    k = max(1, min(round(math.sqrt(cells)), len(x) // 32))
    index = Index(codebook(x[:, :split], k, cfg.rounds), codebook(x[:, split:], k, cfg.rounds), 0.0, split, width)
    rng = np.random.default_rng(cfg.seed)
    aside = rng.normal(size=x.shape) * (x != 0)
    aside -= (aside * x).sum(axis=1, keepdims=True) * x
    norm = np.sqrt((aside * aside).sum(axis=1, keepdims=True))
    t = cfg.threshold
    moved = t * x + math.sqrt(max(0.0, 1 - t * t)) * np.divide(aside, norm, out=np.zeros_like(aside), where=norm > 1e-9)
    moved /= np.maximum(np.sqrt((moved * moved).sum(axis=1, keepdims=True)), 1e-300)
    reach = float(np.quantile(needed(index, x, moved), cfg.recall))
    key = np.unique(np.array([f"{label}:{len(r)}" for label, r in zip(labels, raw, strict=True)]), return_inverse=True)[1]
    real = []
    for at in range(0, len(x), 512):
        i, j = np.nonzero((x[at : at + 512] @ x.T >= t) & (key[at : at + 512, None] == key))
        i, j = i[i + at < j] + at, j[i + at < j]
        if len(i):
            real.append(needed(index, x[i], x[j]))
    if real:
        reach = max(reach, float(np.quantile(np.concatenate(real), cfg.recall)))
    return Index(index.first, index.second, reach, split, width)


def placed(distinct: DataFrame, index: Index, kind: type) -> DataFrame:
    """distinct with cell, and visits: the cells up to its own number that it visits."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            x = units(batch.column("raw").to_pylist(), kind, index.width)
            first, second, home = excesses(index, x)
            visits = [[c for c in multi_sequence(a, b, index.reach) if c < h] + [h] for a, b, h in zip(first, second, home.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.int64()), pa.array(visits, pa.list_(pa.int64()))], names=[*batch.schema.names, "cell", "visits"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in distinct.schema)
    return distinct.mapInArrow(build, f"{kinds}, cell long, visits array<long>")


CELL = ["label", "dim", "cell"]
GROUP = [*CELL, "mpart", "ppart"]


def groups(laid: DataFrame, part: int) -> DataFrame:
    """The rows that are compared: those of one GROUP together, first the cell's members (probe 0), then its visitors (probe 1). home is the cell that a row lies in. A cell with more than part of either is cut into parts."""
    members = laid.select(*CELL, F.lit(0).alias("probe"), "node", F.col("cell").alias("home"), "n", "raw")
    probes = laid.select("label", "dim", F.explode("visits").alias("to"), F.lit(1).alias("probe"), "node", F.col("cell").alias("home"), "n", "raw").withColumnRenamed("to", "cell")
    sizes = members.select(*CELL, "probe").unionByName(probes.select(*CELL, "probe")).groupBy(*CELL).agg(F.sum("probe").alias("p"), F.sum(1 - F.col("probe")).alias("m"))
    large = stored(sizes.where((F.col("p") > part) | (F.col("m") > part)).select(*CELL, F.ceil(F.col("m") / part).cast("int").alias("mparts"), F.ceil(F.col("p") / part).cast("int").alias("pparts")))
    both = members.unionByName(probes).join(if_small(large, large.count()), CELL, "left").fillna(1, ["mparts", "pparts"])
    own = lambda parts: F.pmod(F.xxhash64("node"), F.col(parts)).cast("int")
    every = lambda parts: F.sequence(F.lit(0), F.col(parts) - 1)
    mpart = F.when(F.col("probe") == 0, F.array(own("mparts"))).otherwise(every("mparts"))
    ppart = F.when(F.col("probe") == 1, F.array(own("pparts"))).otherwise(every("pparts"))
    cut = both.withColumn("mpart", F.explode(mpart)).withColumn("ppart", F.explode(ppart))
    return cut.select(*GROUP, "probe", "node", "home", "n", "raw").repartition(*GROUP).sortWithinPartitions(*GROUP, "probe", "node")


def compared(rows: DataFrame, threshold: float, kind: type, width: int) -> DataFrame:
    """groups() -> a, b, links: with b null, a has so many links more; else a and b are a link of a forest."""
    names = rows.columns

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, waiting = None, [], []
        members: tuple[np.ndarray, ...] | None = None
        gained = np.zeros(0, np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            """The visitors that wait, against the members."""
            nonlocal members, gained, waiting
            if not waiting:
                return
            if members is None:
                members = (units([r[3] for r in held], kind, width), *(np.array([r[c] for r in held], np.int64) for c in range(3)))
                gained = np.zeros(len(held), np.int64)
            x, node, home, n = members
            y, pnode, phome, pn = (units([r[3] for r in waiting], kind, width), *(np.array([r[c] for r in waiting], np.int64) for c in range(3)))
            waiting = []
            near = (y @ x.T >= threshold) & ((phome[:, None] != home) | (pnode[:, None] > node))
            i, j = np.nonzero(near)
            if not len(i):
                return
            gained += near.T @ pn
            mine = near @ n
            some = np.flatnonzero(mine)
            tree = forest(pnode[i], node[j])
            yield pa.RecordBatch.from_arrays([pa.array(pnode[some]), pa.nulls(len(some), pa.int64()), pa.array(mine[some])], names=["a", "b", "links"])
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in tree], pa.int64()), pa.array([b for _, b in tree], pa.int64()), pa.array([0] * len(tree), pa.int64())], names=["a", "b", "links"])

        def end() -> Iterator[pa.RecordBatch]:
            nonlocal members, held
            yield from flush()
            if members is not None and (some := np.flatnonzero(gained)).size:
                yield pa.RecordBatch.from_arrays([pa.array(members[1][some]), pa.nulls(len(some), pa.int64()), pa.array(gained[some])], names=["a", "b", "links"])
            members, held = None, []

        for batch in slices(batches, 1024):
            columns = [batch.column(c).to_pylist() for c in names]
            for *at, probe, node, home, n, raw in zip(*columns, strict=True):
                if at != key:
                    yield from end()
                    key = at
                if probe:
                    waiting.append((node, home, n, raw))
                    if len(waiting) >= 512:
                        yield from flush()
                else:
                    held.append((node, home, n, raw))
        yield from end()

    return rows.mapInArrow(compare, "a long, b long, links long")


def near_vectors(vectors: DataFrame, cfg: Settings = Settings(), column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id for each row of vectors (vec_id, label, column; others are left alone).

    Two vectors of one label and length are linked if their cosine is at least
    cfg.threshold and the index finds them; component_id is the smallest vec_id that a
    vector reaches, null smaller than any. Vectors that are null, empty, all zero or hold
    null or non-finite components, and those with a null label, have no links and are
    components of their own. Repeated rows are vectors of their own and linked like
    others. Vectors of different lengths are never linked. An empty table gives an
    empty result.
    """
    kind = np.float32 if isinstance(vectors.schema[column].dataType.elementType, FloatType) else np.float64
    rows = stored(named(vectors, column, kind))
    good = rows.where(F.col("name").isNotNull())
    distinct = stored(good.groupBy("label", "dim", "name").agg(F.first("raw").alias("raw"), F.count("*").alias("n"), F.min("k").alias("least")).withColumn("node", F.monotonically_increasing_id()))
    alone = rows.where(F.col("name").isNull()).select("k", F.lit(0).cast("long").alias("n_links"), F.col("k").alias("component"))
    n, total, width, classes = distinct.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("dim"), F.lit(0)), F.count_distinct("label", "dim")).first()
    if n:
        sample = distinct.select("name", "label", "raw").orderBy("name", "label").limit(cfg.sample).collect()
        index = fitted([bytes(r["raw"]) for r in sample], [r["label"] for r in sample], kind, width, n / (classes * cfg.members), cfg)
        laid = stored(placed(distinct.select("label", "dim", "node", "n", "raw"), index, kind))
        found = stored(compared(groups(laid, cfg.part), cfg.threshold, kind, width))
        labels = connected(found.where(F.col("b").isNotNull()).select("a", "b"))
        links = found.where(F.col("b").isNull()).groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
        linked = stored(distinct.select("node", "least").join(labels, "node"))
        roots = stored(linked.groupBy("label").agg(F.min("least").alias("component"), F.count("*").alias("size")))
        of_node = spread_join(linked.select("node", "label"), roots, ["label"], "size", n).select("node", "component")
        facts = distinct.select("label", "dim", "name", "n", "node", "least").join(of_node, "node", "left").join(links, "node", "left")
        facts = stored(facts.select("label", "dim", "name", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "least").alias("component")))
        discard(labels)
        alone = spread_join(good.select("k", "label", "dim", "name"), facts, ["label", "dim", "name"], "n", total).select("k", "n_links", "component").unionByName(alone)
    return alone.select(id_back("k").alias("vec_id"), "n_links", id_back("component").alias("component_id"), (F.col("k") == F.col("component")).alias("kept"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
