"""Restoring of placeholders in streams of text chunks, with faults.

A branch is one text of a stream, sent in chunks at any places. Its state is what can't
be judged yet: an open placeholder, or a word that may be the bare name of one. Whole
pieces leave the state and are joined with the mapping, so no stream's mapping is held by
a task. The first fault ends a branch: MALFORMED_TOKEN and UNKNOWN_TOKEN as for whole
texts, and TRUNCATED when event time has passed an unfinished branch by the idle time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from redactory.operators.exchange import restored
from redactory.sources.tables import discard, files_of, slices, stored
from redactory.streaming.relay import run_once
from redactory.streaming.segments import Segments

#: The most characters that an open placeholder, or a word that may be a bare name, can have.
HOLD = 96
# How a placeholder may begin.
OPEN = re.compile(r"<<?\s*(?:[A-Za-z][A-Za-z0-9_-]*(?:\s*[_-]\s*\d*)?)?")
# End of fixed values.
WORD = re.compile(r"\w+\Z")


def cut(text: str) -> int:
    """The place up to which text can be judged whatever follows: before an open placeholder, or else before a trailing word, unless that is too long to be a bare name."""
    at = text.rfind("<")
    if at > 0 and text[at - 1] == "<":
        at -= 1
    if at >= 0 and ">" not in text[at:] and OPEN.fullmatch(text, at) and (len(text) - at <= HOLD or not text[at:].strip("<").isspace()):
        return at
    word = WORD.search(text, max(0, len(text) - HOLD - 1))
    return word.start() if word and len(word[0]) <= HOLD else len(text)


#: What is known of a branch: tail (not yet judged), the last character before it, the number of the next piece, whether it has ended, the event time (ms) from which it counts as idle, and whether it is forgotten since.
STATE = "stream_id {kind}, branch string, tail string, before string, n long, ended boolean, due long, gone boolean, batch long"
BRANCH = ["stream_id", "branch"]
PIECE = pa.struct([("n", pa.int64()), ("before", pa.string()), ("text", pa.string()), ("last", pa.bool_()), ("fault", pa.string())])


def newest(rows: DataFrame) -> DataFrame:
    """The last state of each branch."""
    rest = [c for c in rows.columns if c not in BRANCH]
    return rows.groupBy(*BRANCH).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*BRANCH, "r.*")


def step(chunks: list[dict], tail: str, before: str, n: int, ended: bool) -> tuple[list[tuple], str, str, int, bool]:
    """The pieces (n, before, text, last, fault) that a branch's chunks (chunk, last) in their order complete, and its state after them."""
    out = []
    for c in chunks:
        if ended:
            break
        whole, ended = tail + (c["chunk"] or ""), bool(c["last"])
        at = len(whole) if ended else cut(whole)
        tail = whole[at:]
        fault = "MALFORMED_TOKEN" if len(tail) > HOLD else None
        if at or ended or fault:
            out.append((n, before, whole[:at], ended, fault))
            n, before = n + 1, whole[at - 1 : at] if at else before
        ended = ended or fault is not None
    return out, tail, before, n, ended


def stepped(rows: DataFrame) -> DataFrame:
    """stream_id, branch, due, pieces, tail, before, n, ended. rows: stream_id, branch, due, chunks (in order), and tail, before, n, ended as they were, null for a new branch. A batch's chunks of a branch are one row's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [step(chunks, tail or "", before or "", n or 0, bool(ended)) for chunks, tail, before, n, ended in zip(*(c.to_pylist() for c in batch.columns[3:]), strict=True)]
            kinds = (pa.list_(PIECE), pa.string(), pa.string(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True))], names=[*BRANCH, "due", "pieces", "tail", "before", "n", "ended"])

    kind = rows.schema["stream_id"].dataType.simpleString()
    fields = "pieces array<struct<n: long, before: string, text: string, last: boolean, fault: string>>, tail string, before string, n long, ended boolean"
    return rows.select(*BRANCH, "due", "chunks", "tail", "before", "n", "ended").mapInArrow(run, f"stream_id {kind}, branch string, due long, {fields}")


def judged(found: DataFrame, mapping: DataFrame, ended: DataFrame) -> DataFrame:
    """The pieces of a batch that may be sent, restored, and one row with the code for each branch that a fault ends. ended: stream_id, branch of those that ended before. mapping: stream_id, token, original."""
    open_ = found.join(ended, ["stream_id", "branch"], "left_anti").withColumn("piece", F.struct("stream_id", "branch", "n")).withColumn("context", F.concat("before", "text"))
    back = restored(open_, mapping, "stream_id", "piece", "context")
    code = F.coalesce("code", "fault")
    rows = back.withColumn("code", code).withColumn("restored", F.when(code.isNull(), F.substring("restored", F.length("before") + 1, F.length("restored"))))
    first = rows.where("code IS NOT NULL").groupBy("stream_id", "branch").agg(F.min("n").alias("stop"))
    return rows.join(first, ["stream_id", "branch"], "left").where(F.col("stop").isNull() | (F.col("n") <= F.col("stop"))).select("stream_id", "branch", "n", "restored", "last", "code")


def restore_branches(chunks: DataFrame, mapping: DataFrame, folder: str, delay: str = "10 minutes", idle_ms: int = 600_000) -> None:
    """Runs all chunks that there are (a streaming frame stream_id, branch, seq, chunk, last, at) through step() and judged() into the table sent at folder, from the last committed batch on. A batch's rows stand in a folder of its own, so that a repeated batch gives the same.

    States of branches are segments, which a batch joins with its chunks; it writes those
    that it touches. The watermark is the latest event time of earlier batches less the
    delay. Chunks at or before it are late and dropped, and a branch that is idle at it
    is forgotten, with TRUNCATED if it had not ended: an ended one is remembered for the
    idle time, so that what comes late is not taken for a new one. A run ends with such a
    round without chunks; its number is odd, those of batches are even. Chunks come in
    the order of seq, late ones within a batch. Null chunks are empty.
    """
    spark = chunks.sparkSession
    kind = chunks.schema["stream_id"].dataType.simpleString()
    ends = f"stream_id {kind}, branch string, batch long"
    states = Segments(spark, f"{folder}/state", StructType.fromDDL(STATE.format(kind=kind)), newest)
    clock = Segments(spark, f"{folder}/clock", StructType.fromDDL("ms long"), lambda rows: rows.agg(F.max("ms").alias("ms")))

    def advance(rows: DataFrame | None, number: int) -> None:
        for held in (states, clock):
            held.settle(number)
        mark = clock.read(number).agg(F.coalesce(F.max("ms"), F.lit(0))).first()[0]
        known = states.read(number).where("NOT gone").drop("gone", "batch")
        used, overdue = [], known.where(F.col("due") < mark)
        found = moved = None
        if rows is not None:
            timely = F.coalesce(F.col("at") > F.timestamp_millis(F.lit(mark)), F.lit(True))
            news = stored(rows.groupBy(*BRANCH).agg(F.array_sort(F.collect_list(F.when(timely, F.struct("seq", "chunk", "last")))).alias("chunks"), F.max(F.when(timely, F.unix_millis("at"))).alias("latest"), F.max("at").alias("at")))
            due = F.greatest(F.col("latest") + idle_ms, F.lit(mark + 1))
            touched = news.where(F.size("chunks") > 0).withColumn("due", due)
            after = stored(stepped(touched.join(known.drop("due"), BRANCH, "left")))
            clock.write(news.agg(F.unix_millis(F.max("at") - F.expr(f"INTERVAL {delay}")).alias("ms")), number)
            used = [news, after]
            overdue = overdue.join(touched.select(*BRANCH), BRANCH, "left_anti")
            found, moved = after.select(*BRANCH, F.inline("pieces")), after.drop("pieces").withColumn("gone", F.lit(False))
        cut_off = overdue.where("NOT ended").select(*BRANCH, "n", "before", F.lit("").alias("text"), F.lit(True).alias("last"), F.lit("TRUNCATED").alias("fault"))
        forgotten = overdue.withColumn("gone", F.lit(True))
        kept = stored(found.unionByName(cut_off) if found else cut_off)
        if not kept.isEmpty():
            where, files = files_of(spark, f"{folder}/ended")
            before = spark.read.schema(ends).parquet(f"{folder}/ended").where(F.col("batch") < number) if files.exists(where) else spark.createDataFrame([], ends)
            judged(kept, mapping, before.select(*BRANCH)).write.mode("overwrite").parquet(f"{folder}/sent/batch={number}")
            faults = spark.read.parquet(f"{folder}/sent/batch={number}").where("code IS NOT NULL").select(*BRANCH)
            faults.write.mode("overwrite").parquet(f"{folder}/ended/batch={number}")
        states.write((moved.unionByName(forgotten) if moved else forgotten).withColumn("batch", F.lit(number).cast("long")), number)
        discard(kept, *used)

    run_once(chunks, lambda rows, batch_id: advance(rows, 2 * batch_id), folder)
    if (done := states.listed()) and done[-1][1] % 2 == 0:
        advance(None, done[-1][1] + 1)


def sent(spark: SparkSession, folder: str, kind: str = "long") -> DataFrame:
    """stream_id, branch, restored (what was sent, in order), last (whether it came to its end), code (of the fault that ended it)."""
    rows = spark.read.schema(f"stream_id {kind}, branch string, n long, restored string, last boolean, code string, batch long").parquet(f"{folder}/sent")
    texts = F.transform(F.array_sort(F.collect_list(F.when(F.col("restored").isNotNull(), F.struct("n", "restored")))), lambda p: p["restored"])
    return rows.groupBy("stream_id", "branch").agg(F.array_join(texts, "").alias("restored"), (F.bool_or("last") & (F.count("code") == 0)).alias("last"), F.min("code").alias("code"))
