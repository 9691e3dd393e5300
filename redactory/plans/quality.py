"""Queries of the audit, quality and streaming families, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.functions import checks
from redactory.operators import fragments as fr
from redactory.operators import governance as gov
from redactory.operators import quality as qa
from redactory.sources import documents
from redactory.sources.tables import table
from redactory.streaming import relay, sse

#: Gold labels and a rule's predictions.
GOLD = "SELECT doc_id, 'LOW' AS label FROM {labels} WHERE quality = 0 UNION ALL SELECT doc_id, 'TOXIC' FROM {labels} WHERE toxic = 1 UNION ALL SELECT doc_id, 'SECRET_KEY' FROM {labels} WHERE doc_id % 50 = 0"
GUESS = "SELECT l.doc_id, 'LOW' AS label FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id WHERE d.n_chars % 3 = 0 UNION ALL SELECT doc_id, 'TOXIC' FROM {labels} WHERE doc_id % 4 = 1 UNION ALL SELECT doc_id, 'SPARE' FROM {labels} WHERE doc_id % 9 = 2 UNION ALL SELECT doc_id, 'SECRET_KEY' FROM {labels} WHERE doc_id % 100 = 0"


def marks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    return spark.sql(GOLD, labels=labels), spark.sql(GUESS, labels=labels, documents=docs)


COUNTS = f"""g AS (SELECT DISTINCT * FROM ({GOLD})), p AS (SELECT DISTINCT * FROM ({GUESS})), n AS (SELECT coalesce(g.label, p.label) AS label, count(*) FILTER (g.doc_id IS NOT NULL AND p.doc_id IS NOT NULL) AS tp,
    count(*) FILTER (g.doc_id IS NULL) AS fp, count(*) FILTER (p.doc_id IS NULL) AS fn FROM g FULL JOIN p ON g.doc_id = p.doc_id AND g.label = p.label GROUP BY 1)""".replace("{labels}", "labels").replace("{documents}", "documents")


def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.rates(qa.label_counts(*marks(spark, sf_dir), "doc_id", "label"), "agree")


METRICS = """m AS (SELECT label, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) WHEN fn = 0 THEN 1.0 ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) WHEN fp = 0 THEN 1.0 ELSE 0.0 END AS r FROM n),
mm AS (SELECT label, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1, round(CASE WHEN tp + fn > 0 THEN fn / (tp + fn) ELSE 0 END, 4) AS leakage FROM m)"""
METRICS_SQL = f"WITH {COUNTS}, {METRICS} SELECT * FROM mm"


def ner_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = qa.label_counts(*marks(spark, sf_dir), "doc_id", "label")
    return qa.rates(counts.rollup("label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")), "null").drop("leakage")


NER_SQL = f"""WITH {COUNTS}, s AS (SELECT label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM n GROUP BY GROUPING SETS ((label), ())), r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS q FROM s)
SELECT label, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(p, 4) AS precision, round(q, 4) AS recall, round(CASE WHEN p IS NULL OR q IS NULL THEN NULL WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 4) AS f1 FROM r"""



def rates_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates in which what has no cases counts as nothing; a label that nobody gave or guessed is there too."""
    counts = qa.label_counts(*marks(spark, sf_dir), "doc_id", "label")
    none = spark.createDataFrame([("NEVER", 0, 0, 0)], "label string, tp long, fp long, fn long")
    return qa.rates(counts.unionByName(none), "zero").drop("leakage")


ZERO_SQL = f"""WITH {COUNTS}, a AS (SELECT label, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn FROM n UNION ALL SELECT 'NEVER', 0, 0, 0), m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM a)
SELECT label, tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1 FROM m"""

THRESHOLDS = [("LOW", 0.1, 0.3, 0.1, 0.9), ("TOXIC", 0.1, 0.2, 0.1, 0.9), ("ABSENT", 0.5, 0.5, 0.5, 0.5)]


def quality_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, guess = marks(spark, sf_dir)
    metrics = qa.rates(qa.label_counts(gold, guess, "doc_id", "label"), "agree")
    n = gold.select("doc_id").union(guess.select("doc_id")).distinct().count()
    limits = spark.createDataFrame(THRESHOLDS, "label string, least_precision double, least_recall double, least_f1 double, most_leakage double")
    return qa.verdict(metrics, limits, "label", F.lit(n).cast("long"))


VERDICT_SQL = f"""WITH {COUNTS}, {METRICS}, t AS (SELECT * FROM (VALUES ('LOW', 0.1, 0.3, 0.1, 0.9), ('TOXIC', 0.1, 0.2, 0.1, 0.9), ('ABSENT', 0.5, 0.5, 0.5, 0.5)) v(label, a, b, c, d)), k AS (SELECT count(*) AS n FROM (SELECT doc_id FROM g UNION SELECT doc_id FROM p)),
f AS (SELECT count(*) FILTER (mm.label IS NULL OR precision < a OR recall < b OR f1 < c OR leakage > d) AS n_failed FROM t LEFT JOIN mm USING (label)), x AS (SELECT sum(fn) AS miss FROM mm WHERE label LIKE 'SECRET%')
SELECT n::BIGINT AS n_samples, round(3.0 / n, 4)::DOUBLE AS upper_bound, n_failed::BIGINT AS n_failed, CASE WHEN miss > 0 THEN 'HARD_FAILURE_SECRET_LEAKED' WHEN n_failed > 0 THEN 'FAIL_THRESHOLDS' ELSE 'PASS' END AS status FROM k, f, x"""

SPLITS = "SELECT doc_id % 400 AS sample_id, text, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'dev' ELSE 'test' END AS split FROM {documents}"


def split_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(SPLITS, documents=table(spark, sf_dir, "documents")).select("sample_id", "split", F.sha2("text", 256).alias("digest"))
    return qa.shared_between(rows, "split", "sample_id", "digest")


SPLIT_SQL = f"""WITH s AS ({SPLITS.replace("{documents}", "documents")}), i AS (SELECT DISTINCT sample_id::VARCHAR AS v, split FROM s), t AS (SELECT DISTINCT text AS v, split FROM s)
SELECT 'sample_id' AS key, a.split AS a, b.split AS b, count(*)::BIGINT AS n FROM i a JOIN i b ON a.v = b.v AND a.split < b.split GROUP BY ALL UNION ALL SELECT 'digest', a.split, b.split, count(*)::BIGINT FROM t a JOIN t b ON a.v = b.v AND a.split < b.split GROUP BY ALL"""


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.latencies(table(spark, sf_dir, "events"), "value", "event_type")


LATENCY_SQL = """SELECT event_type, count(*)::BIGINT AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99, max(value) AS top FROM events GROUP BY GROUPING SETS ((event_type), ())"""


def throttle_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gov.throttled(table(spark, sf_dir, "events"), "user_id", "ts", 3600 * 24, 3)
    return rows.groupBy("recent", "permitted").agg(F.count("*").alias("n"))


THROTTLE_SQL = """WITH x AS (SELECT count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86399999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS recent FROM events) SELECT recent::BIGINT AS recent, recent <= 3 AS permitted, count(*)::BIGINT AS n FROM x GROUP BY ALL"""


def catalog_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    intents = o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("record_id"), (F.col("o_custkey") % 3).alias("domain"), F.lit(1).alias("version"))
    evidence = o.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("record_id"), F.when(F.col("o_orderkey") % 11 == 0, 9).otherwise(F.col("o_custkey") % 3).alias("domain"), F.lit(1).alias("version"), F.when(F.col("o_orderkey") % 13 != 0, F.expr("o_orderdate + INTERVAL 700 DAYS")).alias("retention_until"))
    return qa.catalog(intents, evidence, F.expr("TIMESTAMP '1999-06-01 00:00:00'")).groupBy("status").agg(F.count("*").alias("n"), F.sum("record_id").alias("id_sum"))


CATALOG_SQL = "SELECT CASE WHEN o_orderdate + INTERVAL 700 DAYS <= TIMESTAMP '1999-06-01' THEN 'expired' ELSE 'retained' END AS status, count(*)::BIGINT AS n, sum(o_orderkey)::BIGINT AS id_sum FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 GROUP BY 1"


def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return qa.reconciled(o.where("id % 4 <> 0"), o.where("id % 3 <> 0"), "id").groupBy("adjudication").agg(F.count("*").alias("n"))


RECONCILE_SQL = "SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'orphan' WHEN o_orderkey % 3 = 0 THEN 'unknown' ELSE 'confirmed' END AS adjudication, count(*)::BIGINT AS n FROM orders WHERE o_orderkey % 4 <> 0 OR o_orderkey % 3 <> 0 GROUP BY 1"


def egress_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    requests = o.select(F.col("o_orderkey").alias("request_id"), F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderpriority")).alias("category"))
    policy = spark.createDataFrame([("1-URGENT", "approved_external"), ("2-HIGH", "internal_only"), ("3-MEDIUM", "approved_external"), ("5-LOW", "forbidden")], "category string, label string")
    names = F.array(*map(F.lit, ("rules", "dictionary", "ner", "extra")))
    ran = o.select(F.col("o_orderkey").alias("request_id"), F.posexplode(names).alias("i", "detector")).where("(i < 3 AND NOT (i = 2 AND request_id % 6 = 0)) OR (i = 3 AND request_id % 25 = 0)")
    ran = ran.withColumn("status", F.when((F.col("request_id") % 10 == 3) & (F.col("i") == 1), "failed").otherwise("passed"))
    return qa.egress(requests, policy, ran).groupBy("code").agg(F.count("*").alias("n"))


EGRESS_SQL = """SELECT CASE WHEN o_orderkey % 17 = 0 THEN 'CATEGORY_MISSING' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'CATEGORY_UNKNOWN' WHEN o_orderpriority IN ('2-HIGH', '5-LOW') THEN 'NOT_APPROVED' WHEN o_orderkey % 6 = 0 OR o_orderkey % 25 = 0 THEN 'DETECTORS_INCOMPLETE' WHEN o_orderkey % 10 = 3 THEN 'DETECTOR_FAILED' END AS code, count(*)::BIGINT AS n FROM orders GROUP BY 1"""

LIMITS = {"body": 2000, "decompressed": 3500, "ratio": 2, "messages": 6, "chars": 2500}


def admission_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("messages"), F.sum(F.length("text")).alias("chars"))
    code = checks.admission_code(F.col("bytes") - F.col("conv_id") % 7 * 300, F.col("bytes"), F.col("messages"), F.col("chars"), LIMITS)
    return c.select("conv_id", code.alias("code"))


ADMISSION_DIMS_SQL = """WITH c AS (SELECT conv_id, sum(strlen(text)) AS d, sum(strlen(text)) - conv_id % 7 * 300 AS b, count(*) AS m, sum(length(text)) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN b > 2000 THEN 'BODY_TOO_LARGE' WHEN d > 3500 THEN 'DECOMPRESSED_TOO_LARGE' WHEN d > b * 2 THEN 'RATIO_TOO_HIGH' WHEN m > 6 THEN 'TOO_MANY_MESSAGES' WHEN n > 2500 THEN 'TOO_MANY_CHARS' END AS code FROM c"""


def observability_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    fields = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("request_id"), F.concat(F.lit("r-"), F.col("o_orderkey")), F.when(F.col("o_orderkey") % 9 == 0, "body").otherwise("latency_ms"), F.when(F.col("o_orderkey") % 4 == 0, "fast").otherwise(F.col("o_custkey").cast("string")))
    rules = spark.createDataFrame([("status", "^[OF]$"), ("request_id", "^r-[0-9]{1,12}$"), ("latency_ms", "^[0-9]{1,9}$")], "field string, pattern string")
    return qa.unfit_fields(o.select("o_orderkey", fields.alias("fields")), "o_orderkey", "fields", rules)


OBSERVE_SQL = "SELECT o_orderkey, (o_orderkey % 9 = 0)::BIGINT AS n_unknown, ((o_orderstatus NOT IN ('O', 'F'))::INT + (o_orderkey % 9 <> 0 AND o_orderkey % 4 = 0)::INT)::BIGINT AS n_invalid FROM orders"


def capacity_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", checks.capacity_level(F.col("c_acctbal"), F.lit(10_000.0), 500).alias("level"))


CAPACITY_SQL = "SELECT c_custkey, CASE WHEN c_acctbal < 500 OR 1 - c_acctbal / 10000.0 >= 0.90 THEN 'BLOCKED' WHEN 1 - c_acctbal / 10000.0 >= 0.80 THEN 'WARNING' ELSE 'OK' END AS level FROM customer"


def dictionary_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_brand", F.concat("p_name", F.lit(' "'), "p_partkey").alias("text"), F.col("p_type").alias("entity_type"))
    return qa.dictionary_hash(p, "p_brand")


DICT_HASH_SQL = """WITH p AS (SELECT p_brand, concat(p_name, ' "', p_partkey) AS text, p_type AS t FROM part) SELECT p_brand, count(*)::BIGINT AS n_entries, sha256(concat('[', string_agg(concat('{"entity_type":"', t, '","text":"', replace(text, '"', '\\"'), '"}'), ',' ORDER BY text, t), ']')) AS digest FROM p GROUP BY p_brand"""


def strict_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.when(F.col("event_id") % 5 == 0, '{"k":1,"k":2}').when(F.col("event_id") % 5 == 1, '{"k":NaN}').when(F.col("event_id") % 5 == 2, '{"k":').otherwise(F.col("props"))
    return table(spark, sf_dir, "events").groupBy(fr.strict_json(bad).alias("is_strict")).agg(F.count("*").alias("n"))


STRICT_SQL = "SELECT event_id % 5 > 2 AS is_strict, count(*)::BIGINT AS n FROM events GROUP BY 1"


def doc_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    files = pages.select(F.concat(F.lit("p"), "page_id", F.when(F.col("page_id") % 3 == 0, ".csv").otherwise(".md")).alias("path"), F.concat(F.when(F.col("page_id") % 4 == 1, F.lit("﻿")).otherwise(F.lit("")), F.when(F.col("page_id") % 3 == 0, F.lit("a,b\n1,2\n")).otherwise(F.col("html")), F.when(F.col("page_id") % 10 == 7, F.lit("\0")).otherwise(F.lit(""))).cast("binary").alias("content"))
    blocks = documents.extract(files)
    return blocks.groupBy("format", "kind", "error").agg(F.count("*").alias("n"), F.sum(F.aggregate("texts", F.lit(0), lambda a, t: a + F.length(t))).cast("long").alias("n_chars"))


BLOCKS_SQL = """WITH f AS (SELECT page_id, page_id % 3 = 0 AS csv, page_id % 10 = 7 AS nul, html FROM pages)
SELECT CASE WHEN csv THEN 'csv' ELSE 'md' END AS format, CASE WHEN nul THEN NULL WHEN csv THEN 'row' ELSE 'literal' END AS kind, CASE WHEN nul THEN 'NUL' END AS error, sum(CASE WHEN csv AND NOT nul THEN 2 ELSE 1 END)::BIGINT AS n, sum(CASE WHEN nul THEN NULL WHEN csv THEN 4 ELSE length(html) END)::BIGINT AS n_chars FROM f GROUP BY ALL"""


def doc_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' notes as CSV files with quoted, barred and uneven rows, as Markdown."""
    c = table(spark, sf_dir, "customer")
    rows = F.concat(F.lit("name|x,no\n"), "c_name", F.lit(','), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 3 == 0, F.lit("\nalone")).otherwise(F.lit('\n"a\nb",\\')), F.lit("\n"))
    files = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".csv")).alias("path"), rows.cast("binary").alias("content"))
    return documents.markdown(documents.extract(files.repartition("path")))


MARKDOWN_SQL = r"""SELECT concat('c', c_custkey, '.csv') AS path, concat('| 列1 | 列2 |', chr(10), '| --- | --- |', chr(10), '| name\|x | no |', chr(10), '| ', c_name, ' | ', c_custkey, ' |', chr(10),
    CASE WHEN c_custkey % 3 = 0 THEN concat(chr(10), '| 列1 |', chr(10), '| --- |', chr(10), '| alone |') ELSE '| a<br>b | \\ |' END, chr(10)) AS markdown FROM customer"""


def relay_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relay.relay_quarantine(spark, sf_dir)


QUARANTINE_SQL = """WITH e AS (SELECT user_id, event_type, (props->>'$.k')::BIGINT AS k FROM events), u AS (SELECT DISTINCT 'relayed' AS state, * FROM e WHERE user_id % 10 <> 3), b AS (SELECT * FROM u UNION ALL SELECT 'quarantined', * FROM e WHERE user_id % 10 = 3)
SELECT state, event_type, count(*)::BIGINT AS n, sum(user_id)::BIGINT AS id_sum FROM b GROUP BY ALL"""


def relay_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relay.relay_summary(spark, sf_dir)


SUMMARY_SQL = """WITH e AS (SELECT user_id, event_type, (props->>'$.k')::BIGINT AS k FROM events), d AS (SELECT DISTINCT * FROM e WHERE user_id % 10 <> 3)
SELECT (SELECT count(*) FROM d)::BIGINT AS submitted, (SELECT count(*) FROM e WHERE user_id % 10 <> 3)::BIGINT - (SELECT count(*) FROM d)::BIGINT AS skipped, (SELECT count(*) FROM e WHERE user_id % 10 = 3)::BIGINT AS quarantined"""


def consumer_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relay.consumer_receipts(spark, sf_dir)


RECEIPTS_SQL = "SELECT count(*)::BIGINT AS n_assets, sum(e)::BIGINT AS last_sum, (SELECT count(*) FROM events)::BIGINT AS n_receipts, (SELECT count(DISTINCT event_id) FROM events)::BIGINT AS n_events FROM (SELECT user_id % 40 AS asset, max(event_id) AS e FROM events GROUP BY 1)"


def sse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of which some end too early or have a broken byte: what is read of them, and why no more."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'").withColumn("s", F.col("conv_id") * 100 + F.col("turn"))
    whole = F.concat(F.lit("id: 5\ndata: "), F.md5("text"), F.lit("\n\nretry: 20\ndata: "), F.md5(F.concat("text", F.lit("x"))))
    end = F.when(F.col("s") % 3 == 0, F.lit("").cast("binary")).when(F.col("s") % 3 == 1, F.unhex(F.lit("ff0a0a"))).otherwise(F.unhex(F.lit("0a0a")))
    chunks = turns.select(F.col("s").alias("stream_id"), F.lit(0).alias("seq"), whole.cast("binary").alias("chunk")).unionByName(turns.select(F.col("s").alias("stream_id"), F.lit(1).alias("seq"), end.alias("chunk")))
    return sse.parse(chunks)


SSE_ERRORS_SQL = """WITH t AS (SELECT conv_id * 100 + turn AS stream_id, text FROM conversations WHERE role = 'assistant')
SELECT stream_id, 0::BIGINT AS n, NULL::VARCHAR AS event, md5(text) AS data, '5' AS id, NULL::BIGINT AS retry, NULL::VARCHAR AS error FROM t
UNION ALL SELECT stream_id, 1, NULL, CASE WHEN stream_id % 3 = 2 THEN md5(concat(text, 'x')) END, CASE WHEN stream_id % 3 = 2 THEN '5' END, CASE WHEN stream_id % 3 = 2 THEN 20 END, CASE stream_id % 3 WHEN 0 THEN 'TRUNCATED' WHEN 1 THEN 'ENCODING' END FROM t"""


def relay_dedup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relay.relay_events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.max("k").alias("top"))


RELAY_SQL = """WITH d AS (SELECT DISTINCT user_id, event_type, (props->>'$.k')::BIGINT AS k FROM events) SELECT event_type, count(*)::BIGINT AS n, max(k) AS top FROM d GROUP BY 1"""


def outbox_consumer_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relay.consume_events(spark, sf_dir).groupBy("active").agg(F.count("*").alias("n"), F.sum("last_event").alias("id_sum"))


CONSUMER_SQL = """WITH l AS (SELECT user_id % 40 AS asset, arg_max(event_type, event_id) AS t, max(event_id) AS e FROM events GROUP BY 1) SELECT t <> 'error' AS active, count(*)::BIGINT AS n, sum(e)::BIGINT AS id_sum FROM l GROUP BY 1"""


def sse_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    body = F.concat(F.lit("event: delta\r\ndata: "), F.regexp_replace("text", "\n", "\ndata: "), F.lit("\n\n: ping\n\ndata: [DONE]\n\n"))
    chunks = turns.select((F.col("conv_id") * 100 + F.col("turn")).alias("stream_id"), F.posexplode(F.split(body, "(?<=\\G(?s:.{7}))")).alias("seq", "chunk")).withColumn("chunk", F.col("chunk").cast("binary"))
    return sse.parse(chunks).select("stream_id", "n", "event", F.length("data").alias("n_chars"), F.sha2("data", 256).alias("digest"))


SSE_SQL = """SELECT conv_id * 100 + turn AS stream_id, 0::BIGINT AS n, 'delta' AS event, length(text)::INT AS n_chars, sha256(text) AS digest FROM conversations WHERE role = 'assistant' UNION ALL SELECT conv_id * 100 + turn, 1, NULL, 6, sha256('[DONE]') FROM conversations WHERE role = 'assistant'"""

QUERIES = {
    "quality_metrics": (quality_metrics, METRICS_SQL), "ner_metrics": (ner_metrics, NER_SQL), "rates_zero": (rates_zero, ZERO_SQL), "quality_verdict": (quality_verdict, VERDICT_SQL), "split_contamination": (split_contamination, SPLIT_SQL), "latency_percentiles": (latency_percentiles, LATENCY_SQL),
    "throttle_window": (throttle_window, THROTTLE_SQL), "catalog_join": (catalog_join, CATALOG_SQL), "reconcile": (reconcile, RECONCILE_SQL), "egress_decision": (egress_decision, EGRESS_SQL), "admission_dims": (admission_dims, ADMISSION_DIMS_SQL),
    "observability_scan": (observability_scan, OBSERVE_SQL), "capacity_watermark": (capacity_watermark, CAPACITY_SQL), "dictionary_hash": (dictionary_hash, DICT_HASH_SQL), "strict_json": (strict_json, STRICT_SQL), "doc_blocks": (doc_blocks, BLOCKS_SQL),
    "relay_dedup_stream": (relay_dedup_stream, RELAY_SQL), "outbox_consumer_stream": (outbox_consumer_stream, CONSUMER_SQL), "sse_parse": (sse_parse, SSE_SQL), "sse_errors": (sse_errors, SSE_ERRORS_SQL),
    "doc_markdown": (doc_markdown, MARKDOWN_SQL), "relay_quarantine": (relay_quarantine, QUARANTINE_SQL), "relay_summary": (relay_summary, SUMMARY_SQL), "consumer_receipts": (consumer_receipts, RECEIPTS_SQL),
}
