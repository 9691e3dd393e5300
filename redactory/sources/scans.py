"""Folders of small records: each file a row, whatever is in it, as a batch or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Bytes of one file.
MOST_BYTES = 1 << 20


def parsed(files: DataFrame, schema: StructType, most_bytes: int = MOST_BYTES) -> DataFrame:
    """path, length, code, record: files (path, length, content) as JSON records. code: TOO_LARGE, such a file is not read; ENCODING, no UTF-8; MALFORMED, no JSON object, or with fields of other types than the schema's; else null. Fields that the schema does not name are left out, those that the file lacks are null."""
    marked = StructType([*schema.fields, StructField("_corrupt", StringType())])
    small = F.col("length") <= most_bytes
    text = F.when(small & F.is_valid_utf8(F.col("content")), F.decode("content", "utf-8"))
    rows = files.select("path", "length", small.alias("small"), text.alias("text"))
    read = rows.withColumn("r", F.from_json("text", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.coalesce(F.col("r._corrupt").isNotNull() | F.col("r").isNull() | ~F.ltrim("text").startswith("{"), F.lit(True))
    code = F.when(~F.col("small"), "TOO_LARGE").when(F.col("text").isNull(), "ENCODING").when(bad, "MALFORMED")
    fields = F.struct(*[F.col(f"r.`{f.name}`") for f in schema.fields])
    return read.withColumn("code", code).select("path", "length", "code", F.when(F.col("code").isNull(), fields).alias("record"))


def binary(reader, path: str, glob: str) -> DataFrame:
    return reader.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def scan(spark: SparkSession, path: str, schema: StructType, glob: str = "*.json", most_bytes: int = MOST_BYTES, most_files: int | None = None) -> DataFrame:
    """parsed() files below path, all of them unless most_files is given: then of more files the first by path are read, the rest have rows with TOO_MANY_FILES; files that are not read cost their names only. Files without a byte have no row, as Spark passes them over."""
    if most_files is None:
        return parsed(binary(spark.read, path, glob), schema, most_bytes)
    names = binary(spark.read, path, glob).select("path", "length")
    first = names.orderBy("path").limit(most_files).select("path")
    late = names.join(first, "path", "left_anti")
    found = binary(spark.read, path, glob).join(F.broadcast(first), "path", "left_semi")  # most_files bounds what is broadcast
    rows = parsed(found, schema, most_bytes)
    return rows.unionByName(late.select("path", "length", F.lit("TOO_MANY_FILES").alias("code"), F.lit(None).cast(rows.schema["record"].dataType).alias("record")))


def scan_stream(spark: SparkSession, path: str, schema: StructType, glob: str = "*.json", most_bytes: int = MOST_BYTES, per_batch: int = 1000) -> DataFrame:
    """parsed() files as they come, at most per_batch in a batch."""
    reader = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", per_batch)
    return parsed(binary(reader, path, glob), schema, most_bytes)


def unfinished(intents: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """key, status of each intent: confirmed with a result, unknown without; and of results without an intent, orphan. Both as scanned records: rows with a code come as they are, with status unreadable and their path as key."""
    good = lambda df: df.where("code IS NULL").select(F.col(f"record.{key}").cast("string").alias("key")).where("key IS NOT NULL").distinct()
    i, r = good(intents).withColumn("i", F.lit(True)), good(results).withColumn("r", F.lit(True))
    status = F.when(F.col("i").isNull(), "orphan").when(F.col("r").isNull(), "unknown").otherwise("confirmed")
    broken = intents.select("path", "code").unionByName(results.select("path", "code")).where("code IS NOT NULL")
    return i.join(r, "key", "full").select("key", status.alias("status")).unionByName(broken.select(F.col("path").alias("key"), F.lit("unreadable").alias("status")))
