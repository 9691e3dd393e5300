"""Queries of the intake family, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.operators import intake
from redactory.sources.tables import table


def body_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    bodies = c.select("conv_id", F.to_json(F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))).cast("binary").alias("body"))
    return intake.measured(bodies, "conv_id", "body", 6000).select("conv_id", F.when(F.col("fault").isNull(), F.col("n_needles")).alias("n_messages"), "fault")


MEASURE_SQL = r"""WITH c AS (SELECT conv_id, count(*) AS n, 2 + count(*) - 1 + sum(length('{"role":"","content":""}') + strlen(role) + strlen(text) + len(regexp_extract_all(text, '[\n"\\\t]'))) AS bytes FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN bytes <= 6000 THEN n END::BIGINT AS n_messages, CASE WHEN bytes > 6000 THEN 'TOO_LARGE' END AS fault FROM c"""


def import_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    kinds = F.array(*map(F.lit, ("master", "document", "tool")))
    batches = o.select(F.col("o_orderkey").alias("batch_id"), F.element_at(kinds, (F.col("o_orderkey") % 3 + 1).cast("int")).alias("importer"), F.when(F.col("o_orderkey") % 7 == 0, "conversation").otherwise(F.element_at(F.array(*map(F.lit, ("master_data", "document", "trusted_tool"))), (F.col("o_orderkey") % 3 + 1).cast("int"))).alias("source_kind"))
    entities = li.where("l_linenumber = 1").select(F.col("l_orderkey").alias("batch_id")).distinct()
    rels = li.select(F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("ix"), F.when(F.col("l_returnflag") != "R", F.col("l_linestatus")).alias("evidence_text"), F.when(F.col("l_suppkey") % 9 != 0, F.col("l_suppkey")).alias("evidence_start"))
    return intake.import_faults(batches, entities, rels).groupBy("code", "field_path").agg(F.count("*").alias("n"), F.sum("batch_id").alias("id_sum"))


IMPORT_SQL = """SELECT 'INVALID_SOURCE_KIND' AS code, 'meta.source_kind' AS field_path, count(*)::BIGINT AS n, sum(o_orderkey)::BIGINT AS id_sum FROM orders WHERE o_orderkey % 7 = 0
UNION ALL SELECT 'EMPTY_ENTITIES', 'entities', count(*)::BIGINT, sum(o_orderkey)::BIGINT FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)
UNION ALL SELECT 'MISSING_EVIDENCE_SPAN', concat('relations[', l_linenumber, '].evidence'), count(*)::BIGINT, sum(l_orderkey)::BIGINT FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey % 3 = 1 AND (l_returnflag = 'R' OR l_suppkey % 9 = 0) GROUP BY l_linenumber"""

NAMES = "SELECT concat('a', CAST(p_partkey AS STRING)) AS alias, concat('c', CAST(p_partkey % 40 AS STRING)) AS canonical FROM {part}"


def alias_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = spark.sql(NAMES, part=table(spark, sf_dir, "part"))
    renames = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("c"), "n_nationkey").alias("old"), F.concat(F.lit("n"), "n_nationkey").alias("new"))
    return intake.renamed(aliases, renames).groupBy("canonical").agg(F.count("*").alias("n"), F.min("alias").alias("first_alias"))


RENAME_SQL = f"""WITH a AS ({NAMES.replace("{part}", "part")}), r AS (SELECT concat('c', n_nationkey) AS o, concat('n', n_nationkey) AS w FROM nation WHERE n_nationkey % 2 = 0), x AS (SELECT alias, coalesce(w, canonical) AS canonical FROM a LEFT JOIN r ON canonical = o UNION ALL SELECT o, w FROM r)
SELECT canonical, count(*)::BIGINT AS n, min(alias) AS first_alias FROM x GROUP BY 1"""


#: A stream is an eighth of the users in a run of 40 events, so its size doesn't grow with the table; its last event is the mark in two streams of three.
STREAMS = """SELECT stream, event_id, CASE WHEN event_id % 37 = 0 OR event_id = max(event_id) OVER (PARTITION BY stream) AND stream % 3 <> 0 THEN '[DONE]' ELSE concat(event_type, ' ') END AS data
    FROM (SELECT CAST(floor(event_id / 40) AS BIGINT) * 8 + user_id % 8 AS stream, event_id, event_type FROM {events})"""


def protected_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = intake.protected(spark.sql(STREAMS, events=table(spark, sf_dir, "events")), "stream", "event_id", "data", "[DONE]", 40)
    return out.select("stream", F.sha2("text", 256).alias("digest"), "fault")


PROTECTED_SQL = f"""WITH c AS ({STREAMS.replace("{events}", "events")}), g AS (SELECT stream, sum(strlen(data)) AS size, arg_max(data, event_id) AS last, count(*) FILTER (data = '[DONE]') AS marks, string_agg(data, '' ORDER BY event_id) FILTER (data <> '[DONE]') AS text FROM c GROUP BY 1),
f AS (SELECT *, CASE WHEN size > 40 THEN 'TOO_LARGE' WHEN marks = 0 THEN 'TRUNCATED' WHEN last <> '[DONE]' OR marks > 1 THEN 'AFTER_END' END AS fault FROM g)
SELECT stream, CASE WHEN fault IS NULL THEN sha256(coalesce(text, '')) END AS digest, fault FROM f"""


def scenario_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 20).alias("input"), F.when(F.col("event_type") == "view", F.lit(1).cast("long")).otherwise(F.col("event_id") % 3).alias("output"), F.round(F.col("value"), 0).alias("seconds"), (F.col("event_id") % 11 == 0).alias("wrong"), (F.col("event_id") % 13 == 0).alias("skipped"), (F.col("event_id") % 17 == 0).alias("failed"))
    return intake.scenario_summary(e, "event_type")


SCENARIO_SQL = """WITH e AS (SELECT event_type, user_id % 20 AS input, CASE WHEN event_type = 'view' THEN 1 ELSE event_id % 3 END AS output, round(value, 0) AS s, event_id FROM events),
u AS (SELECT event_type, sum(u) AS n_unstable, grouping(event_type) AS g FROM (SELECT event_type, input, (count(DISTINCT output) > 1)::INT AS u FROM e GROUP BY 1, 2) GROUP BY ROLLUP (event_type)),
t AS (SELECT event_type, count(*) AS n, sum(s) AS s, count(*) FILTER (event_id % 11 = 0) AS w, count(*) FILTER (event_id % 13 = 0) AS k, count(*) FILTER (event_id % 17 = 0) AS f, grouping(event_type) AS g FROM e GROUP BY ROLLUP (event_type))
SELECT t.event_type, n::BIGINT AS n, round(s, 3) AS seconds, round(n / s, 4) AS throughput, w::BIGINT AS n_wrong, k::BIGINT AS n_skipped, f::BIGINT AS n_failed, n_unstable::BIGINT AS n_unstable FROM t JOIN u ON t.event_type IS NOT DISTINCT FROM u.event_type AND t.g = u.g"""

SECRET = b"a secret of the sample"


def name_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that can be compared but not read, under a secret."""
    return intake.keyed_digest(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", SECRET).select("c_custkey", "digest")


_INNER, _OUTER = (bytes(k ^ pad for k in SECRET.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))
DIGEST_SQL = f"SELECT c_custkey, sha256(from_hex('{_OUTER}') || from_hex(sha256(from_hex('{_INNER}') || encode(c_name)))) AS digest FROM customer"

QUERIES = {"name_digests": (name_digests, DIGEST_SQL), "body_measure": (body_measure, MEASURE_SQL), "import_check": (import_check, IMPORT_SQL), "alias_rename": (alias_rename, RENAME_SQL), "protected_stream": (protected_stream, PROTECTED_SQL), "scenario_summary": (scenario_summary, SCENARIO_SQL)}
