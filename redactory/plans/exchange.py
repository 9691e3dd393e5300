"""Queries of requests and responses as JSON, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.operators import exchange as ex
from redactory.plans.detection import HITS_SQL, found
from redactory.sources.tables import once, stored, table

MODELS = ("m-1", "m-2")

#: Each third conversation has blocks, the others plain texts; every second one ends in a call of a tool and its result. Some have a model that is not allowed, a member twice, no messages, or a protocol that nobody knows.
BODIES = """WITH c AS (SELECT conv_id, array_sort(collect_list(struct(turn, role, text))) AS m, CASE WHEN conv_id % 4 = 0 THEN 'Skill' ELSE 'Read' END AS tool FROM {conversations} GROUP BY conv_id),
t AS (SELECT *, transform(m, t -> named_struct('role', t.role, 'content', CASE WHEN conv_id % 3 = 0 THEN to_variant_object(array(named_struct('type', 'text', 'text', t.text))) ELSE CAST(t.text AS VARIANT) END, 'tool_calls', CAST(NULL AS VARIANT), 'tool_call_id', CAST(NULL AS STRING))) AS turns,
    CASE WHEN conv_id % 3 = 0 THEN array(named_struct('role', 'assistant', 'content', to_variant_object(array(named_struct('type', 'tool_use', 'id', 'c1', 'name', tool))), 'tool_calls', CAST(NULL AS VARIANT), 'tool_call_id', CAST(NULL AS STRING)),
        named_struct('role', 'user', 'content', to_variant_object(array(named_struct('type', 'tool_result', 'tool_use_id', 'c1', 'content', concat('result ', conv_id)))), 'tool_calls', CAST(NULL AS VARIANT), 'tool_call_id', CAST(NULL AS STRING)))
    ELSE array(named_struct('role', 'assistant', 'content', CAST('calling' AS VARIANT), 'tool_calls', to_variant_object(array(named_struct('id', 'c1', 'function', named_struct('name', tool)))), 'tool_call_id', CAST(NULL AS STRING)),
        named_struct('role', 'tool', 'content', CAST(concat('result ', conv_id) AS VARIANT), 'tool_calls', CAST(NULL AS VARIANT), 'tool_call_id', 'c1')) END AS calls FROM c),
j AS (SELECT conv_id, to_json(named_struct('model', CASE WHEN conv_id % 11 = 5 THEN 'm-9' ELSE 'm-1' END, 'messages', CASE WHEN conv_id % 2 = 0 THEN concat(turns, calls) ELSE turns END)) AS body FROM t)
SELECT conv_id, CASE WHEN conv_id % 17 = 3 THEN 'xml' WHEN conv_id % 3 = 0 THEN 'messages' ELSE 'chat' END AS protocol, CASE WHEN conv_id % 13 = 4 THEN concat('{{"model":"m-1",', substr(body, 2)) WHEN conv_id % 13 = 7 THEN '{{"model":"m-1","messages":[]}}' ELSE body END AS body FROM j"""


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, (sf_dir, "scanned requests"), lambda: ex.scanned(spark.sql(BODIES, conversations=table(spark, sf_dir, "conversations")), "conv_id", "body", "protocol", MODELS))


def request_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(spark, sf_dir).select("conv_id", "code")


SCANNED = """s AS (SELECT conv_id, CASE WHEN conv_id % 17 = 3 THEN 'UNSUPPORTED_PROTOCOL' WHEN conv_id % 13 = 4 THEN 'MALFORMED_JSON' WHEN conv_id % 13 = 7 OR (conv_id % 3 = 0 AND bool_or(role NOT IN ('user', 'assistant'))) THEN 'CONTRACT_VIOLATION' WHEN conv_id % 11 = 5 THEN 'MODEL_NOT_ALLOWED' END AS code, count(*) AS n FROM conversations GROUP BY conv_id)"""
SCAN_SQL = f"WITH {SCANNED} SELECT conv_id, code FROM s"


def request_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.leaves(scanned(spark, sf_dir), "conv_id")


LEAVES = f"""{SCANNED}, p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, role, text FROM conversations),
l AS (SELECT conv_id, concat('messages[', i, '].content', CASE WHEN conv_id % 3 = 0 THEN '[0].text' ELSE '' END) AS json_path, role, text AS content FROM p WHERE role <> 'system'
    UNION ALL SELECT conv_id, concat('messages[', n, '].content'), 'assistant', 'calling' FROM s WHERE conv_id % 2 = 0 AND conv_id % 3 <> 0
    UNION ALL SELECT conv_id, concat('messages[', n + 1, '].content', CASE WHEN conv_id % 3 = 0 THEN '[0].content' ELSE '' END), CASE WHEN conv_id % 3 = 0 THEN 'user' ELSE 'tool' END, concat('result ', conv_id) FROM s WHERE conv_id % 4 = 2),
g AS (SELECT l.* FROM l JOIN s USING (conv_id) WHERE code IS NULL)"""
LEAVES_SQL = f"WITH {LEAVES} SELECT conv_id, json_path, role, content FROM g"


def request_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of the requests that may be sent, read from their new bodies, and the codes of those that may not: of some, the first message was never judged."""
    asked = scanned(spark, sf_dir)
    texts = ex.leaves(asked, "conv_id")
    redacted = texts.where("NOT (conv_id % 7 = 2 AND json_path LIKE 'messages[0]%')").select("conv_id", "json_path", F.concat(F.lit('<"R_1">\n'), F.md5("content")).alias("value"))
    done = stored(ex.replaced(asked, texts, redacted, "conv_id"))
    sent = stored(ex.scanned(done.where("code IS NULL").join(asked.select("conv_id", "protocol"), "conv_id"), "conv_id", "body", "protocol", MODELS))
    held = done.where("code IS NOT NULL").select("conv_id", "code", F.lit(None).cast("string").alias("json_path"), F.lit(None).cast("string").alias("content"))
    return ex.leaves(sent, "conv_id").select("conv_id", F.lit(None).cast("string").alias("code"), "json_path", "content").unionByName(held)


REPLACE_SQL = f"""WITH {LEAVES}, m AS (SELECT DISTINCT conv_id FROM g WHERE conv_id % 7 = 2 AND json_path LIKE 'messages[0]%')
SELECT conv_id, NULL AS code, json_path, concat('<"R_1">', chr(10), md5(content)) AS content FROM g WHERE conv_id NOT IN (SELECT conv_id FROM m) UNION ALL SELECT conv_id, 'DETECTION_INCOMPLETE', NULL, NULL FROM m"""

#: An original may look like a placeholder.
MAPPING = "SELECT DISTINCT {key} AS request_id, token, CASE token WHEN '<ORG_001>' THEN concat('Acme ', {key}) WHEN '<ORG_002>' THEN 'x <ORG_001> y' ELSE 'Ann' END AS original FROM {{orders}} LATERAL VIEW explode(array('<ORG_001>', '<ORG_002>', '<PERSON_001>')) AS token"
MASKED = "CASE CAST(o_orderkey % 9 AS INT) WHEN 0 THEN 'hello <ORG_001>!' WHEN 1 THEN '<ORG_009> x' WHEN 2 THEN 'see <ORG_00' WHEN 3 THEN 'ORG_001 bare' WHEN 4 THEN 'plain' WHEN 5 THEN '<ORG_002><PERSON_001>' WHEN 6 THEN 'see <OR' WHEN 7 THEN 'see <ZZ' ELSE '<org-7> and <ORG_001>' END"
BACK = "CASE o_orderkey % 9 WHEN 0 THEN concat('hello Acme ', {key}, '!') WHEN 4 THEN 'plain' WHEN 5 THEN 'x <ORG_001> yAnn' WHEN 7 THEN 'see <ZZ' END"
FAULT = "CASE WHEN o_orderkey % 9 IN (2, 3, 6, 8) THEN 'MALFORMED_TOKEN' WHEN o_orderkey % 9 = 1 THEN 'UNKNOWN_TOKEN' END"


def restore_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    texts = spark.sql(f"SELECT o_orderkey AS text_id, o_custkey % 300 AS request_id, {MASKED} AS text FROM {{orders}}", orders=orders)
    back = ex.restored(texts, spark.sql(MAPPING.format(key="o_custkey % 300"), orders=orders), "request_id", "text_id", "text")
    return back.select("text_id", "restored", "code")


RESTORE_SQL = f"SELECT o_orderkey AS text_id, {BACK.format(key='o_custkey % 300')} AS restored, {FAULT} AS code FROM orders"

#: A response for each order. Some are cut off, have another model, no choices, or a placeholder in their id.
RESPONSES = f"""WITH j AS (SELECT o_orderkey AS request_id, to_json(named_struct('id', CASE WHEN o_orderkey % 19 = 2 THEN '<ORG_001>' ELSE concat('r-', o_orderkey) END, 'model', CASE WHEN o_orderkey % 7 = 3 THEN 'm-9' ELSE 'm-1' END,
    'choices', CASE WHEN o_orderkey % 29 = 3 THEN array() ELSE array(named_struct('index', 0, 'message', named_struct('role', 'assistant', 'content', {MASKED}, 'reasoning_content', CASE WHEN o_orderkey % 2 = 0 THEN 'of <PERSON_001>' END), 'finish_reason', 'stop')) END)) AS body FROM {{orders}})
SELECT request_id, CASE WHEN request_id % 23 = 1 THEN left(body, length(body) - 1) ELSE body END AS body FROM j"""


def response_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    back = ex.restored_responses(spark.sql(RESPONSES, orders=orders), spark.sql(MAPPING.format(key="o_orderkey"), orders=orders), "request_id", "body", MODELS)
    of = lambda name: F.get_json_object("body", f"$.choices[0].message.{name}").alias(name)
    return back.select("request_id", "code", of("content"), of("reasoning_content"), F.get_json_object("body", "$.id").alias("response_id"))


RESPONSE_SQL = f"""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 23 = 1 THEN 'MALFORMED_JSON' WHEN o_orderkey % 29 = 3 OR o_orderkey % 7 = 3 OR o_orderkey % 19 = 2 THEN 'CONTRACT_VIOLATION' ELSE {FAULT} END AS code, {BACK.format(key="o_orderkey")} AS content FROM orders)
SELECT o_orderkey AS request_id, code, CASE WHEN code IS NULL THEN content END AS content, CASE WHEN code IS NULL AND o_orderkey % 2 = 0 THEN 'of Ann' END AS reasoning_content, CASE WHEN code IS NULL THEN concat('r-', o_orderkey) END AS response_id FROM r"""


def detectors_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per fragment its code and the number of its candidates. The rules fail on some fragments; the dictionary gives some ranges that are none."""
    f, rules = found(spark, sf_dir)
    at = (F.instr("text", "note") - 1).cast("int")
    words = f.where(at >= 0).select("frag_id", at.alias("start"), F.when(F.col("frag_id") % 19 == 0, 9999).otherwise(at + 4).alias("end"), F.lit("WORD").alias("entity_type"), F.lit(None).cast("int").alias("priority"), F.lit("dict").alias("source"))
    failed = f.where("frag_id % 17 = 0").select("frag_id", F.lit("rules").alias("detector"))
    rows, codes = ex.orchestrated(f, {"rules": rules, "dictionary": words}, failed, "frag_id", "text")
    return codes.join(rows.groupBy("frag_id").agg(F.count("*").alias("n")), "frag_id", "full")


DETECTORS_SQL = f"""WITH {HITS_SQL}, w AS (SELECT frag_id, bool_or(frag_id % 19 = 0) AS bad FROM f WHERE contains(text, 'note') GROUP BY 1), a AS (SELECT frag_id, count(*) AS n, bool_or(priority = 0) AS secret FROM c GROUP BY 1),
x AS (SELECT f.frag_id, CASE WHEN f.frag_id % 17 = 0 THEN 'DETECTION_INCOMPLETE' WHEN bad THEN 'INVALID_SPAN' WHEN secret THEN 'SECRET_DETECTED' END AS code, coalesce(a.n, 0) + CASE WHEN w.frag_id IS NULL THEN 0 ELSE 1 END AS n FROM f LEFT JOIN w USING (frag_id) LEFT JOIN a USING (frag_id))
SELECT frag_id, code, CASE WHEN n > 0 AND (code IS NULL OR code = 'SECRET_DETECTED') THEN n END::BIGINT AS n FROM x WHERE code IS NOT NULL OR n > 0"""

QUERIES = {
    "request_scan": (request_scan, SCAN_SQL), "request_leaves": (request_leaves, LEAVES_SQL), "request_replace": (request_replace, REPLACE_SQL), "restore_codes": (restore_codes, RESTORE_SQL), "response_restore": (response_restore, RESPONSE_SQL), "detectors_joined": (detectors_joined, DETECTORS_SQL),
}
