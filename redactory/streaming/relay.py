"""At-least-once relays into tables: deduplicated events, and assets folded from their events."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from redactory.sources.tables import delete, discard, files_of, shared_folder, stored, table
from redactory.streaming.segments import Segments


def run_once(stream: DataFrame, batch, folder: str) -> None:
    """Feeds all that there is to batch(df, batch_id), from the last committed offset on."""
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start().awaitTermination()


def judge_by(valid: Column | None) -> Callable[[DataFrame], DataFrame]:
    """Rows with verdict: accepted if valid, else rejected; unknown counts as not valid."""
    good = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    return lambda rows: rows.withColumn("verdict", F.when(good, "accepted").otherwise("rejected"))


def relay(stream: DataFrame, key: tuple[str, ...], folder: str, judge: Callable[[DataFrame], DataFrame] | Column | None = None, attempts: int = 3) -> DataFrame:
    """Each distinct key of the stream once, in the table rows at folder. A run after a failure goes on from the last committed batch.

    judge adds verdict to the rows of a batch: accepted, retry or rejected; null counts
    as rejected. It is asked anew for rows to be retried with each next batch, attempts
    times in all. Rejected rows, and those whose attempts are
    used up, go to quarantine(). Keys that were relayed are kept in segments, exact for
    ever; a batch writes its new keys only, and nothing is held in memory. Null keys are
    keys. Of one key's rows in a batch any may be the one that is relayed.
    """
    spark, schema = stream.sparkSession, stream.schema
    decide = judge if callable(judge) else judge_by(judge)
    keys = StructType([schema[k] for k in key])
    waiting_schema = StructType([*schema.fields, StructField("attempt", LongType())])
    sent, waiting = Segments(spark, f"{folder}/keys", keys), Segments(spark, f"{folder}/waiting", waiting_schema)

    def write(df: DataFrame, batch_id: int) -> None:
        sent.settle(batch_id)
        earlier = [s for s in waiting.listed() if s[1] < batch_id]
        again = spark.read.schema(waiting_schema).parquet(f"{folder}/waiting/{earlier[-1][0]}-{earlier[-1][1]}") if earlier else spark.createDataFrame([], waiting_schema)  # the newest has all that wait
        asked = df.select(*schema.names, F.lit(0).cast("long").alias("attempt")).unionByName(again)
        verdict = F.when((F.col("verdict") == "retry") & (F.col("attempt") + 1 < attempts), "retry").when(F.col("verdict") == "accepted", "accepted").otherwise("rejected")
        judged = stored(decide(asked).withColumn("verdict", verdict))
        known = sent.read(batch_id)
        same = functools.reduce(lambda a, b: a & b, [judged[k].eqNullSafe(known[k]) for k in key])
        fresh = judged.join(known, same, "left_anti").dropDuplicates(["verdict", *key])
        accepted = stored(fresh.where("verdict = 'accepted'").select(*schema.names))
        accepted.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")
        sent.write(accepted.select(*key), batch_id)
        waiting.write(fresh.where("verdict = 'retry'").withColumn("attempt", F.col("attempt") + 1), batch_id)
        judged.where("verdict = 'rejected'").select(*schema.names).write.mode("overwrite").parquet(f"{folder}/quarantine/batch={batch_id}")
        for old in earlier[:-1]:
            delete(spark, f"{folder}/waiting/{old[0]}-{old[1]}")
        discard(judged, accepted)

    run_once(stream, write, folder)
    return relayed(spark, schema, f"{folder}/rows")


def relayed(spark: SparkSession, schema: StructType, path: str) -> DataFrame:
    top, files = files_of(spark, path)
    return spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(path).select(*schema.names) if files.exists(top) else spark.createDataFrame([], schema)


def quarantine(spark: SparkSession, schema: StructType, folder: str) -> DataFrame:
    return relayed(spark, schema, f"{folder}/quarantine")


def relay_stats(seen: DataFrame, key: tuple[str, ...], valid: Column) -> DataFrame:
    """One row: submitted (distinct valid keys), skipped (repeats of them), quarantined."""
    good = F.coalesce(valid, F.lit(False))
    counts = seen.select(F.struct(*key).alias("relay_key"), good.alias("relay_good")).groupBy("relay_good", "relay_key").agg(F.count("*").alias("relay_n"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return counts.agg(F.count_if("relay_good").alias("submitted"), zero(F.when(F.col("relay_good"), F.col("relay_n") - 1)).alias("skipped"), zero(F.when(~F.col("relay_good"), F.col("relay_n"))).alias("quarantined"))


def consume(stream: DataFrame, key: str, event: tuple[str, ...], order: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """Each key's row with the greatest order over all batches, and the receipts (the columns of event, which name one). An event that has a receipt is not applied again.

    A batch writes the rows of the keys that it touches, and its own receipts; the state
    is what the segments of both give when merged. A repeated batch gives the same.
    """
    spark, schema = stream.sparkSession, stream.schema
    rest = [c for c in schema.names if c != key]

    def latest(rows: DataFrame) -> DataFrame:
        return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*").select(*schema.names)

    state = Segments(spark, f"{folder}/state", schema, latest)
    receipts = Segments(spark, f"{folder}/receipts", StructType([schema[e] for e in event]))

    def write(df: DataFrame, batch_id: int) -> None:
        for held in (state, receipts):
            held.settle(batch_id)
        fresh = stored(df.dropDuplicates(list(event)).join(receipts.read(batch_id), list(event), "left_anti"))
        state.write(latest(fresh), batch_id)
        receipts.write(fresh, batch_id)
        discard(fresh)

    run_once(stream, write, folder)
    return state.read(), receipts.read()


def fold_latest(stream: DataFrame, key: str, order: str, folder: str) -> DataFrame:
    """The state of consume(), where key and order name an event."""
    return consume(stream, key, (key, order), order, folder)[0]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/event[s].parquet")  # a pattern, as the table may be one file


def spooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))


VALID = "user_id % 10 <> 3"


def relay_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relay(spooled(spark, sf_dir), ("user_id", "event_type", "k"), shared_folder(spark))


def relay_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was relayed and what was held back, by event type."""
    folder, rows = shared_folder(spark), spooled(spark, sf_dir)
    good = relay(rows, ("user_id", "event_type", "k"), folder, F.expr(VALID))
    both = good.withColumn("state", F.lit("relayed")).unionByName(quarantine(spark, rows.schema, folder).withColumn("state", F.lit("quarantined")))
    return both.groupBy("state", "event_type").agg(F.count("*").alias("n"), F.sum("user_id").alias("id_sum"))


def relay_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return relay_stats(rows, ("user_id", "event_type", "k"), F.expr(VALID))


def consume_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select((F.col("user_id") % 40).alias("asset"), "event_id", "event_type")
    return fold_latest(rows, "asset", "event_id", shared_folder(spark)).select("asset", F.col("event_id").alias("last_event"), (F.col("event_type") != "error").alias("active"))


def consumer_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select((F.col("user_id") % 40).alias("asset"), "event_id", "event_type")
    state, receipts = consume(rows, "asset", ("event_id",), "event_id", shared_folder(spark))
    return state.agg(F.count("*").alias("n_assets"), F.sum("event_id").alias("last_sum")).join(receipts.agg(F.count("*").alias("n_receipts"), F.count_distinct("event_id").alias("n_events")))
