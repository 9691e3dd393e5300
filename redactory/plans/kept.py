"""Queries of sealed histories, dictionary commands and observations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.operators import dictionary, observations, sealed
from redactory.operators.lifecycle import STAGES
from redactory.sources.tables import table

MOMENT = "TIMESTAMP '2024-06-01 00:00:00'"


def history_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of all unexpired orders, opened. Of some orders one stage was sealed for another purpose."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.concat(F.lit("d"), (F.col("o_custkey") % 3).cast("string")).alias("domain"), F.when(F.col("o_orderkey") % 7 == 0, F.expr(f"{MOMENT} - INTERVAL 1 DAY")).otherwise(F.expr(f"{MOMENT} + INTERVAL 1 DAY")).alias("expires_at"))
    keys = o.select("domain").distinct().withColumn("key", F.unhex(F.sha2(F.concat(F.lit("key of "), "domain"), 256)))
    written = o.select("request_id", "domain", F.posexplode(F.array(*map(F.lit, STAGES))).alias("i", "stage")).where("request_id % 5 > i").join(keys, "domain")
    purpose = F.when((F.col("request_id") % 11 == 4) & (F.col("i") == 1), "export").otherwise("history")
    bound = sealed.bound_to(F.col("domain"), F.concat_ws("/", F.col("request_id").cast("string"), "stage"), purpose)
    body = F.concat(F.lit("body é of "), F.col("request_id").cast("string"), F.lit("/"), "stage")
    stages = written.select("request_id", "stage", F.lit("stored").alias("state"), sealed.sealed(body, F.col("key"), sealed.nonce_of("request_id", "stage"), bound).alias("envelope"))
    return sealed.history(o, stages, keys, F.expr(MOMENT))


HISTORY_SQL = """WITH s AS (SELECT o_orderkey AS r, unnest(range(0, 4))::INT AS place FROM orders WHERE o_orderkey % 7 <> 0), t AS (SELECT *, ['input', 'redacted', 'upstream', 'restored'][place + 1] AS stage, r % 5 > place AS w, r % 11 = 4 AND r % 5 > 1 AS broken FROM s)
SELECT r AS request_id, place, stage, CASE WHEN w THEN 'stored' ELSE 'not_produced' END AS state, CASE WHEN w AND NOT broken THEN concat('body é of ', r, '/', stage) END AS body, CASE WHEN w AND broken THEN 'HISTORY_UNREADABLE' END AS code FROM t"""

#: Senders saw the revision that holds, but for each eleventh, who saw none.
COMMANDS = """WITH e AS (SELECT event_id AS n, user_id % 20 AS scope, concat('e', CAST(event_id % 37 AS STRING)) AS entry_id, CASE event_id % 5 WHEN 0 THEN 'create' WHEN 1 THEN 'create' WHEN 2 THEN 'update' WHEN 3 THEN 'delete' ELSE 'update' END AS action, event_id % 11 = 0 AS stale FROM {events}),
p AS (SELECT *, count(CASE WHEN NOT stale AND action <> 'update' THEN 1 END) OVER w AS moves, max(CASE WHEN NOT stale AND action <> 'update' THEN n END) OVER w AS last FROM e WINDOW w AS (PARTITION BY scope, entry_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT p.*, coalesce(last % 5 < 2, false) AS present FROM p), g AS (SELECT *, NOT stale AND (CASE WHEN action = 'create' THEN NOT present ELSE present END) AS good FROM s),
r AS (SELECT *, coalesce(sum(CASE WHEN good THEN 1 ELSE 0 END) OVER (PARTITION BY scope ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    coalesce(sum(CASE WHEN good AND action = 'create' THEN 1 WHEN good AND action = 'delete' THEN -1 ELSE 0 END) OVER (PARTITION BY scope ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS held FROM g)"""


def dictionary_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = f"{COMMANDS} SELECT scope, n, action, entry_id, concat('text of ', entry_id) AS text, true AS enabled, CASE WHEN stale THEN -1L ELSE CAST(before AS BIGINT) END AS expected FROM r"
    return dictionary.commanded(spark.sql(sent, events=table(spark, sf_dir, "events"))).drop("published")


COMMANDS_SQL = f"""{COMMANDS.replace("{events}", "events")} SELECT scope, n, CASE WHEN stale THEN 'REVISION_CONFLICT' WHEN good THEN NULL WHEN action = 'create' THEN 'ENTRY_CONFLICT' ELSE 'ENTRY_NOT_FOUND' END AS code,
    (before + CASE WHEN good THEN 1 ELSE 0 END)::BIGINT AS revision, held::BIGINT AS n_entries FROM r"""

MATERIAL = """SELECT conv_id, turn, concat('t', CAST(conv_id % 3 AS STRING)) AS tenant, CASE WHEN turn % 13 = 7 THEN ' ' ELSE concat('d', CAST(conv_id % 2 AS STRING)) END AS domain, CASE WHEN conv_id % 17 = 3 THEN 'rumour' WHEN role = 'tool' THEN 'trusted_tool' ELSE 'user_assertion' END AS source_kind,
    conv_id % 5 = 0 AS verified, concat('r', CAST(conv_id AS STRING)) AS request_id, CASE WHEN conv_id % 4 = 0 THEN NULL ELSE concat('c', CAST(conv_id % 7 AS STRING)) END AS context_id, md5(text) AS text, CASE WHEN conv_id % 19 = 6 THEN 'x' ELSE sha2(md5(text), 256) END AS digest, turn - CASE WHEN conv_id % 23 = 9 THEN 100 ELSE 0 END AS place,
    TIMESTAMP '2024-03-01 10:00:00' AS observed_at, CASE conv_id % 6 WHEN 0 THEN TIMESTAMP '2024-05-01 00:00:00' WHEN 1 THEN TIMESTAMP '2024-02-01 00:00:00' END AS retention_until, 'accumulate' AS purpose, 'standard' AS retention_policy, {acl} AS acl FROM {conversations}"""


def observation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    acl = "CASE conv_id % 4 WHEN 0 THEN CAST(NULL AS ARRAY<STRING>) WHEN 1 THEN array('b', 'a', 'b') WHEN 2 THEN array('c', ' ') ELSE CAST(array() AS ARRAY<STRING>) END"
    rows = observations.observed(spark.sql(MATERIAL.format(acl=acl, conversations="{conversations}"), conversations=table(spark, sf_dir, "conversations")))
    return rows.select("conv_id", "turn", "code", "source_id", "event_id")


_MATERIAL_SQL = MATERIAL.format(acl="CASE conv_id % 4 WHEN 1 THEN ['a', 'b'] WHEN 2 THEN ['c', ' '] END", conversations="conversations").replace("sha2(md5(text), 256)", "sha256(md5(text))")
OBSERVATION_SQL = f"""WITH m AS ({_MATERIAL_SQL}), c AS (SELECT *, coalesce(retention_until, observed_at + INTERVAL 30 DAYS) AS until, CASE WHEN conv_id % 4 = 1 THEN ['a', 'b'] ELSE [concat(domain, ':restricted-candidate')] END AS members,
    CASE WHEN trim(domain) = '' THEN 'BLANK_DOMAIN' WHEN source_kind = 'rumour' THEN 'SOURCE_KIND' WHEN conv_id % 4 = 2 THEN 'BLANK_ACL' WHEN digest = 'x' THEN 'DIGEST_MISMATCH' WHEN place < 0 THEN 'OFFSET' WHEN conv_id % 6 = 1 THEN 'RETENTION' END AS code FROM m),
s AS (SELECT *, CASE WHEN verified THEN concat('req:', request_id) ELSE concat('unverified:', source_kind, ':', sha256(concat('["', tenant, '","', domain, '","', source_kind, '","', digest, '",', CASE WHEN context_id IS NULL THEN 'null' ELSE concat('"', context_id, '"') END, ',"', purpose, '","', retention_policy, '","', array_to_string(members, '\\n'), '"]'))) END AS source_id FROM c),
e AS (SELECT *, concat('{{"acl":["', array_to_string(members, '","'), '"],"evidence_offset":', place, ',"evidence_text":"', text, '","evidence_digest":"', digest, '","domain":"', domain, '","observed_at":"2024-03-01T10:00:00Z","purpose":"', purpose, '","retention_policy":"', retention_policy, '","retention_until":"', strftime(until, '%Y-%m-%dT%H:%M:%SZ'), '","source_id":"', source_id, '","source_kind":"', source_kind, '","tenant":"', tenant, '"}}') AS event FROM s)
SELECT conv_id, turn, code, CASE WHEN code IS NULL THEN source_id END AS source_id, CASE WHEN code IS NULL THEN sha256(event) END AS event_id FROM e"""

QUERIES = {"history_open": (history_open, HISTORY_SQL), "dictionary_commands": (dictionary_commands, COMMANDS_SQL), "observation_events": (observation_events, OBSERVATION_SQL)}
