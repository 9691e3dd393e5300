"""Queries over streams, with their SQL. Each stream comes in several runs, so that all but the first go on from what the one before has committed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from redactory.plans.exchange import BACK, FAULT, MAPPING, MASKED
from redactory.sources.tables import shared_folder, stored, table
from redactory.streaming.restore import restore_branches, sent

#: A text for each order, cut at two places that its key sets, so that chunks end anywhere in it. Of each fifth stream the last chunk never says that it is the last.
CHUNKS = f"""WITH t AS (SELECT o_orderkey AS stream_id, {MASKED} AS text FROM {{orders}}), c AS (SELECT *, CAST(stream_id % (length(text) + 1) AS INT) AS x, CAST(stream_id * 7 % (length(text) + 1) AS INT) AS y FROM t),
p AS (SELECT stream_id, text, least(x, y) AS a, greatest(x, y) AS b FROM c)
SELECT stream_id, 'b' AS branch, {{seq}} AS seq, CASE {{seq}} WHEN 0 THEN left(text, a) WHEN 1 THEN substring(text, a + 1, b - a) ELSE substring(text, b + 1) END AS chunk, {{seq}} = 2 AND stream_id % 5 <> 0 AS last, TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, {{seq}}) AS at FROM p"""
#: Event time goes on, in a stream of its own.
LATER = "SELECT -1L AS stream_id, 'b' AS branch, 0 AS seq, '' AS chunk, true AS last, TIMESTAMP '2024-01-01 06:00:00' AS at"


def branch_restore_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each branch if it came to its end without a fault, and else the fault."""
    orders, folder = table(spark, sf_dir, "orders"), shared_folder(spark)
    mapping = stored(spark.sql(MAPPING.format(key="o_orderkey"), orders=orders).withColumnRenamed("request_id", "stream_id"))
    chunks = [spark.sql(CHUNKS.format(orders="{orders}", seq=seq), orders=orders) for seq in range(3)]
    schema = chunks[0].schema
    for part in (*chunks, spark.sql(LATER)):
        part.to(schema).write.mode("append").parquet(f"{folder}/chunks")
        restore_branches(spark.readStream.schema(schema).parquet(f"{folder}/chunks"), mapping, folder)
    return sent(spark, folder).where("stream_id >= 0").selectExpr("stream_id", "CASE WHEN code IS NULL THEN restored END AS restored", "code")


BRANCH_SQL = f"""SELECT o_orderkey AS stream_id, CASE WHEN o_orderkey % 5 <> 0 THEN {BACK.format(key="o_orderkey")} END AS restored,
    CASE WHEN o_orderkey % 5 <> 0 OR o_orderkey % 9 IN (1, 3, 8) THEN {FAULT} ELSE 'TRUNCATED' END AS code FROM orders"""

QUERIES = {"branch_restore_stream": (branch_restore_stream, BRANCH_SQL)}
