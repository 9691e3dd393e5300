"""Queries of tool calls and of request-local placeholders by role, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.operators import contracts as ct
from redactory.operators import fragments as fr
from redactory.operators import relations as rel
from redactory.operators import toolcalls as tc
from redactory.sources.tables import over, table

#: Bounds that some calls and requests of the sample pass.
MOST, TOTAL = 150, 620

ARGUMENTS = """CASE WHEN o_orderkey % 13 = 1 THEN '{"to":"<ORG_001>","to":1}' WHEN o_orderkey % 13 = 2 THEN '["<ORG_001>"]' WHEN o_orderkey % 13 = 3 THEN '{"<ORG_001>":1}' WHEN o_orderkey % 13 = 4 THEN '{"to":"<ORG_007>","n":1}' WHEN o_orderkey % 13 = 5 THEN '{"to":"ORG_001 <ORG_0","n":1}'
    WHEN o_orderkey % 13 = 6 THEN concat('{"to":"', repeat('x', 200), '","n":1}') WHEN o_orderkey % 13 = 7 THEN '{"to":"a","n":9}' WHEN o_orderkey % 13 = 8 THEN '{"to":"a","n":1,"more":true}' ELSE concat('{"to":"hi <ORG_001>","n":', CAST(o_custkey % 5 AS STRING), ',"tags":["<PER_001>","é"]}') END"""
#: The arguments of a call for each order, in three fragments; a customer's calls are a request's.
FRAGMENTS = f"""WITH a AS (SELECT o_custkey AS request_id, o_orderkey AS call_id, {ARGUMENTS} AS args FROM {{orders}})
SELECT request_id, call_id, call_id * 3 AS seq, substring(args, 1, 5) AS delta FROM a UNION ALL SELECT request_id, call_id, call_id * 3 + 1, substring(args, 6, CAST(call_id % 20 AS INT)) FROM a UNION ALL SELECT request_id, call_id, call_id * 3 + 2, substring(args, CAST(6 + call_id % 20 AS INT)) FROM a"""
SCHEMA = {"type": "object", "properties": {"to": {"type": "string", "minLength": 1}, "n": {"$ref": "#/$defs/small"}, "tags": {"type": "array", "items": {"type": "string"}, "maxItems": 2}}, "required": ["to", "n"], "additionalProperties": False, "$defs": {"small": {"type": "integer", "minimum": 0, "maximum": 3}}}


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arguments of each call that may be released, or why they may not."""
    orders = table(spark, sf_dir, "orders")
    calls = tc.assembled(over(spark, FRAGMENTS, orders=orders), "request_id", "call_id", "seq", "delta", MOST, TOTAL)
    names = orders.select(F.col("o_custkey").alias("request_id"), F.col("o_orderkey").alias("call_id"), F.when(F.col("o_orderkey") % 17 == 5, "erase").otherwise("send").alias("name"))
    requests = orders.select(F.col("o_custkey").alias("request_id")).distinct()
    mapping = requests.select("request_id", F.explode(F.create_map(F.lit("<ORG_001>"), F.concat(F.lit('Ac"me '), F.col("request_id").cast("string")), F.lit("<PER_001>"), F.lit("<ORG_001>"))).alias("token", "original"))
    return tc.released(calls, names, mapping, {"send": SCHEMA}, "request_id", "call_id", MOST, 1 << 30)


TOOL_SQL = f"""WITH f AS ({FRAGMENTS.replace("{orders}", "orders")}), s AS (SELECT *, sum(strlen(delta)) OVER (PARTITION BY request_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS upto FROM f),
c AS (SELECT request_id, call_id, sum(strlen(delta)) AS b, max(upto) AS u, call_id % 13 AS k FROM s GROUP BY 1, 2),
x AS (SELECT *, CASE WHEN b > {MOST} THEN 'CALL_TOO_LARGE' WHEN u > {TOTAL} THEN 'REQUEST_TOO_LARGE' WHEN call_id % 17 = 5 THEN 'UNKNOWN_TOOL' WHEN k = 1 THEN 'MALFORMED_JSON' WHEN k = 2 THEN 'NOT_AN_OBJECT' WHEN k = 3 THEN 'TOKEN_IN_KEY' WHEN k = 4 THEN 'UNKNOWN_TOKEN' WHEN k = 5 THEN 'MALFORMED_TOKEN'
    WHEN k IN (7, 8) OR request_id % 5 = 4 THEN 'SCHEMA' END AS code FROM c)
SELECT request_id, call_id, CASE WHEN code IS NULL THEN concat('{{"to":"hi Ac\\"me ', request_id, '","n":', request_id % 5, ',"tags":["<ORG_001>","é"]}}') END AS arguments, code FROM x"""

#: Names with a cue of their role before them, with several, or with none.
NAMED = """SELECT o_orderkey AS frag_id, o_custkey % 300 AS request_id, concat('宏远', CAST(o_orderkey % 5 AS STRING), '公司') AS name,
    concat(CASE (o_orderkey + o_custkey) % 9 WHEN 0 THEN '合同 甲方：' WHEN 1 THEN '甲方与乙方: ' WHEN 2 THEN '担保人（' WHEN 3 THEN '甲方在很久以前已经另行通知' ELSE '联系 ' END, '宏远', CAST(o_orderkey % 5 AS STRING), '公司', ' 电话') AS text FROM {orders}"""


def role_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of all orders with names replaced by placeholders of their role, where a request shows one role only."""
    texts = spark.sql(NAMED, orders=table(spark, sf_dir, "orders"))
    start = (F.instr("text", "宏远") - 1).cast("int")
    spans = texts.select("frag_id", start.alias("start"), (start + F.length("name")).alias("end"), F.lit("ORG").alias("entity_type"), F.lit(3).alias("priority"), F.lit("given").alias("source"))
    return fr.mask(texts.drop("name"), spans, "request_id", "frag_id").redacted.select("frag_id", "redacted")


ROLE_SQL = f"""WITH t AS ({NAMED.replace("{orders}", "orders")}), r AS (SELECT *, CASE WHEN text LIKE '合同%' THEN 'PARTYA' WHEN text LIKE '甲方与%' THEN 'PARTYB' WHEN text LIKE '担保人%' THEN 'GUARANTOR' END AS role FROM t),
o AS (SELECT request_id, name, min(frag_id) AS first, CASE WHEN count(DISTINCT role) = 1 THEN max(role) ELSE 'ORG' END AS prefix FROM r GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY request_id, prefix ORDER BY first) AS i FROM o)
SELECT frag_id, replace(text, name, format('<{{}}_{{:03d}}>', prefix, i)) AS redacted FROM t JOIN n USING (request_id, name)"""

DATES = """SELECT o_orderkey AS id, concat(CASE o_orderkey % 9 WHEN 0 THEN '甲公司在2023-05-01向乙集团采购零件' WHEN 1 THEN '甲公司在 2023-05-01 向乙集团采购零件' WHEN 2 THEN '甲公司 2023-13-01 向乙集团采购零件' WHEN 3 THEN '甲公司2023年向乙集团采购零件' WHEN 4 THEN '2023-12-31，甲公司向乙集团采购零件'
    WHEN 5 THEN '甲公司 1823-05-01 向乙集团采购零件' WHEN 6 THEN '甲公司 2023-05-012 向乙集团采购零件' WHEN 7 THEN '甲公司 2099-01-31' ELSE '甲公司向乙集团采购零件' END, CASE WHEN o_orderkey % 4 = 0 THEN '吗' ELSE '' END, '。') AS sentence FROM {orders}"""


def modality_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(DATES, orders=table(spark, sf_dir, "orders")).withColumn("between", F.lit(""))
    return rows.select("id", rel.modality(F.lit("document")).alias("modality"))


DATES_SQL = f"""WITH t AS ({DATES.replace("{orders}", "orders")})
SELECT id, CASE WHEN contains(sentence, '吗') THEN 'question' WHEN regexp_matches(sentence, '[0-9]{{4}}年|(^|[^\\p{{L}}\\p{{N}}_])(19|20)[0-9][0-9]-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])($|[^\\p{{L}}\\p{{N}}_])') THEN 'hypothetical' ELSE 'asserted' END AS modality FROM t"""

#: A request for each order, by both protocols and a third, with options that are in bounds or not.
REQUESTS = """SELECT o_orderkey AS request_id, CASE o_orderkey % 5 WHEN 0 THEN 'messages' WHEN 1 THEN 'other' ELSE 'chat' END AS protocol, concat('{"model":"', CASE WHEN o_orderkey % 31 = 2 THEN 'm-9' ELSE 'm-1' END, '","messages":[{"role":"user","content":"hi"}', CASE o_orderkey % 7 WHEN 1 THEN ',{"role":"system","content":"be"}' WHEN 2 THEN ',{"role":"assistant","content":[{"type":"text","text":"x"}]}'
    WHEN 3 THEN ',{"role":"user","content":"hi","mood":1}' WHEN 4 THEN ',{"role":"user"}' ELSE '' END, ']', CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 10 <> 5 OR o_orderkey % 29 = 4 THEN ',"max_tokens":5' ELSE '' END, CASE o_orderkey % 11 WHEN 1 THEN ',"temperature":1.5' WHEN 2 THEN ',"temperature":"hot"' WHEN 3 THEN ',"top_p":0' WHEN 4 THEN ',"stream":true,"top_p":null' WHEN 5 THEN ',"stream":"yes"' WHEN 6 THEN ',"best":1' ELSE '' END,
    CASE o_orderkey % 13 WHEN 1 THEN ',"stop":["a","b"]' WHEN 2 THEN ',"top_k":3' WHEN 3 THEN ',"tool_choice":"auto"' WHEN 4 THEN ',"model":"m-1"' ELSE '' END, '}') AS body FROM {orders}"""


def request_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.contracted(over(spark, REQUESTS, orders=table(spark, sf_dir, "orders")), "body", "protocol", ("m-1",)).select("request_id", "code")


CONTRACT_SQL = """SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 5 = 1 THEN 'UNSUPPORTED_PROTOCOL' WHEN o_orderkey % 13 = 4 THEN 'MALFORMED_JSON' WHEN o_orderkey % 7 IN (3, 4) OR o_orderkey % 11 IN (2, 3, 5, 6) THEN 'CONTRACT_VIOLATION'
    WHEN o_orderkey % 5 = 0 AND ((o_orderkey % 10 = 5 AND o_orderkey % 29 <> 4) OR o_orderkey % 7 = 1 OR o_orderkey % 11 = 1 OR o_orderkey % 13 IN (1, 3)) THEN 'CONTRACT_VIOLATION' WHEN o_orderkey % 5 > 1 AND (o_orderkey % 29 = 4 OR o_orderkey % 13 = 2) THEN 'CONTRACT_VIOLATION'
    WHEN o_orderkey % 31 = 2 THEN 'MODEL_NOT_ALLOWED' END AS code FROM orders"""

#: An answer for each order; a call of a tool in every third.
ANSWERS = f"""SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 2 = 0 THEN 'chat' ELSE 'messages' END AS protocol, CASE WHEN o_orderkey % 2 = 0 THEN concat('{{"id":"', CASE WHEN o_orderkey % 19 = 2 THEN '<ORG_001>' ELSE 'r' END, '","model":"m-1","usage":{{"usage_source":"', CASE WHEN o_orderkey % 23 = 4 THEN '<ORG_001>' ELSE 's' END, '","n":1}},"choices":[{{"message":{{"role":"assistant","content":"hi <ORG_001>","reasoning_details":[{{"type":"t","text":"', CASE WHEN o_orderkey % 17 = 6 THEN '<ORG_009>' ELSE '<PER_001>' END, '"}}]',
    CASE WHEN o_orderkey % 3 = 0 THEN concat(',"tool_calls":[{{"id":"c","type":"function","function":{{"name":"send","arguments":"', replace(concat('{{~"to~":~"<ORG_001>~",~"n~":', CAST(o_orderkey % 5 AS STRING), '}}'), '~', chr(92)), '"}}}}]') ELSE '' END, '}}}}]}}')
    ELSE concat('{{"id":"r","model":"m-1","stop_sequence":"', CASE WHEN o_orderkey % 19 = 3 THEN '<ORG_001>' ELSE 's' END, '","content":[{{"type":"text","text":"', CASE WHEN o_orderkey % 17 = 5 THEN 'ORG_001' ELSE 'hi <ORG_001>' END, '"}},{{"type":"thinking","thinking":"<PER_001>","signature":""}}', CASE WHEN o_orderkey % 3 = 0 THEN concat(',{{"type":"tool_use","id":"c","name":"', CASE WHEN o_orderkey % 9 = 0 THEN 'erase' ELSE 'send' END, '","input":{{"n":', CAST(o_orderkey % 5 AS STRING), ',"to":"<ORG_001>"}}}}') ELSE '' END, ']}}') END AS body FROM {{orders}}"""


def answer_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of both protocols, all their texts and calls restored, or why not."""
    orders = table(spark, sf_dir, "orders")
    mapping = orders.select(F.col("o_orderkey").alias("request_id"), F.explode(F.create_map(F.lit("<ORG_001>"), F.concat(F.lit("Acme "), F.col("o_orderkey").cast("string")), F.lit("<PER_001>"), F.lit("Ann"))).alias("token", "original"))
    return ct.answers(over(spark, ANSWERS, orders=orders), mapping, "request_id", "body", "protocol", ("m-1",), {"send": SCHEMA})


ANSWER_SQL = f"""WITH a AS ({ANSWERS.replace("{orders}", "orders")}), c AS (SELECT request_id, body, CASE WHEN request_id % 2 = 0 AND (request_id % 19 = 2 OR request_id % 23 = 4) OR request_id % 2 = 1 AND request_id % 19 = 3 THEN 'CONTRACT_VIOLATION' WHEN request_id % 2 = 0 AND request_id % 17 = 6 THEN 'UNKNOWN_TOKEN' WHEN request_id % 2 = 1 AND request_id % 17 = 5 THEN 'MALFORMED_TOKEN'
    WHEN request_id % 2 = 1 AND request_id % 9 = 0 THEN 'UNKNOWN_TOOL' WHEN request_id % 3 = 0 AND request_id % 5 = 4 THEN 'SCHEMA' END AS code FROM a)
SELECT request_id, CASE WHEN code IS NULL THEN replace(replace(body, '<ORG_001>', concat('Acme ', request_id)), '<PER_001>', 'Ann') END AS body, code FROM c"""

QUERIES = {"request_contract": (request_contract, CONTRACT_SQL), "answer_restore": (answer_restore, ANSWER_SQL), "tool_calls": (tool_calls, TOOL_SQL), "role_placeholders": (role_placeholders, ROLE_SQL), "modality_dates": (modality_dates, DATES_SQL)}
