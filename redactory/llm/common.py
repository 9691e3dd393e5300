"""What the operators of this subpackage share: input tables and stored intermediate results."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: space and U+0009 to U+000D.
WHITE = " \t\n\u000b\f\r"

#: Stands for a null doc_id in keys. It sorts before every other id, as a null does.
NO_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, stays: bool = False) -> str:
    """A new path below spark.checkpoint.dir, which all executors see, deleted when the application ends unless it stays. Where that is unset, the session's own spark.local.dir serves one that runs on this machine alone; on a cluster, and without either, that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        base = spark.sparkContext.getConf().get("spark.local.dir")
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/redactory-{uuid.uuid4().hex}")
    if not stays:
        files = top.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(top)
        files.deleteOnExit(top)
    return f"{top.toString()}/rows"


_scopes: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes, at its end, what stored() has written inside it. What is read later must be stored outside, or with kept()."""
    _scopes.append([])
    try:
        yield
    finally:
        for spark, path in _scopes.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def kept(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """df, written once and read back: later steps neither repeat its work nor depend on the executors that did it."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """kept(), and deleted at the end of the scratch() that it stands in, if any."""
    back = kept(df, compression)
    if _scopes:
        _scopes[-1].append((df.sparkSession, back._stored_at))
    return back


def discard(*tables: DataFrame) -> None:
    """Deletes what stored() wrote, once nothing reads it any more."""
    for df in tables:
        delete(df.sparkSession, df._stored_at)


def id_key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def text_hash(column: str = "text") -> Column:
    """With id_key it names a row; null texts count as empty. Two texts of one doc_id share it in about n^2 / 2^65 cases for n rows of that id."""
    return F.xxhash64(F.coalesce(column, F.lit("")))


def id_back(column: str) -> Column:
    return F.when(F.col(column) != F.lit(NO_ID), F.col(column))


#: Bytes of what is broadcast.
MOST_BYTES = 64 << 20


def if_small(df: DataFrame, rows: int, limit: int = 10_000, size: int = 0) -> DataFrame:
    """df with a broadcast hint if its known number of rows, and the bytes of its long columns, are within the limits; beyond them Spark shuffles both sides."""
    return F.broadcast(df) if rows <= limit and size <= MOST_BYTES else df


def spread_join(rows: DataFrame, facts: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """rows joined with facts, which has one row for each key and, as weight, the key's number of rows; total is their sum at most. Keys with over a thousandth of it, a thousand at most, are broadcast, so that none makes a large partition; the rest is shuffled."""
    heavy = facts.where(F.col(weight) * 1000 > total)
    light = facts.where(F.col(weight) * 1000 <= total)
    return rows.join(F.broadcast(heavy), keys).unionByName(rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of at most rows rows: texts can be long, and Python objects take more room than Arrow. Empty batches are left out."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Characters of text that a Python worker takes up together.
TEXTS = 1 << 22


def size_runs(sizes: Iterable[int], most: int = TEXTS) -> Iterator[range]:
    """Consecutive texts, by their sizes, of about most characters together, one at least."""
    start, held, k = 0, 0, -1
    for k, n in enumerate(sizes):
        if k > start and held + n > most:
            yield range(start, k)
            start, held = k, 0
        held += n
    if k >= start:
        yield range(start, k + 1)


def text_runs(texts: list[str]) -> Iterator[range]:
    return size_runs(map(len, texts))
