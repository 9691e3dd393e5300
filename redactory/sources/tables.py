"""Loading of tables with declared columns, and the scope that every read passes through."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files_of(spark: SparkSession, path: str) -> tuple:
    """The Hadoop path and its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, which all executors see, deleted when the application ends. Where that is unset, the session's own spark.local.dir serves one that runs on this machine alone; on a cluster, and without either, that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        base = spark.sparkContext.getConf().get("spark.local.dir")
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
    top, files = files_of(spark, f"{base}/redactory-{uuid.uuid4().hex}")
    files.mkdirs(top)
    files.deleteOnExit(top)
    return f"{top.toString()}/rows"


def delete(spark: SparkSession, path: str) -> None:
    where, files = files_of(spark, path)
    files.delete(where, True)


def stored(df: DataFrame) -> DataFrame:
    """df, written once and read back, for results of Python work that several joins use, and for rounds."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def discard(*tables: DataFrame) -> None:
    """Deletes what stored() wrote, once nothing reads it any more."""
    for df in tables:
        delete(df.sparkSession, df._stored_at)


def state_of(spark: SparkSession, folder: str) -> int:
    """A number that changes when a file below folder is added, changed or deleted."""
    where, files = files_of(spark, folder)
    found, each = [], files.listFiles(where, True)
    while each.hasNext():
        f = each.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hash(tuple(sorted(found)))


_made: dict[tuple, tuple[int, str, StructType]] = {}


def once(spark: SparkSession, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that make() gives for the key, stored for this application. key[0] is the folder that make() reads; when its files have changed, the table is made anew and the old one deleted. forget() drops all."""
    key, state = (spark.sparkContext.applicationId, *key), state_of(spark, key[0])
    if key in _made and _made[key][0] != state:
        delete(spark, _made.pop(key)[1])
    if key not in _made:
        df, path = make(), shared_folder(spark)
        df.write.parquet(path)
        _made[key] = state, path, df.schema
    _, path, schema = _made[key]
    return spark.read.schema(schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Deletes the tables of once() of this application."""
    for key in [k for k in _made if k[0] == spark.sparkContext.applicationId]:
        delete(spark, _made.pop(key)[1])


def over(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """A query over tables, named in braces; other braces stand for themselves."""
    text = text.replace("{", "{{").replace("}", "}}")
    for name in tables:
        text = text.replace("{{" + name + "}}", "{" + name + "}")
    return spark.sql(text, **tables)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of at most rows rows, as Python objects of long texts take more room than Arrow. Empty batches are left out."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def fingerprint(df: DataFrame) -> str:
    """SHA-256 of the schema; a load can insist on the one it was written for."""
    import hashlib

    return hashlib.sha256(df.schema.json().encode()).hexdigest()


@dataclass(frozen=True)
class Actor:
    """Who asks: one tenant and domain, with subjects (groups) and purposes."""

    tenant_id: str
    domain: str
    subjects: tuple[str, ...]
    purposes: tuple[str, ...]


def permits(actor: Actor, acl: str = "acl", purpose: str = "purpose") -> Column:
    """Whether a row may be read: the actor's tenant and domain, one of its subjects in the row's list, one of its purposes."""
    return (
        (F.col("tenant_id") == actor.tenant_id)
        & (F.col("domain") == actor.domain)
        & F.arrays_overlap(acl, F.array(*map(F.lit, actor.subjects)))
        & F.col(purpose).isin(*actor.purposes)
    )


def scoped(df: DataFrame, actor: Actor, acl: str = "acl", purpose: str = "purpose") -> DataFrame:
    """The only way by which operators read governed rows for an actor. The filter reaches the scan."""
    return df.where(permits(actor, acl, purpose))
