"""Queries of the extraction family and of state folds, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.operators import ledger, relations
from redactory.sources.tables import table

NEWS = """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'document' WHEN 1 THEN 'model_output' ELSE 'trusted_tool' END AS source_kind, concat('甲', CAST(o_custkey AS STRING), '公司') AS a, concat('乙', CAST(o_orderkey % 50 AS STRING), '集团') AS b,
    concat(CASE o_orderkey % 5 WHEN 0 THEN '据称' WHEN 1 THEN '计划中，' WHEN 2 THEN '2023年，' ELSE '昨日，' END, '甲', CAST(o_custkey AS STRING), '公司', CASE WHEN o_orderkey % 4 = 0 THEN '并未' ELSE '' END, CASE WHEN o_orderkey % 2 = 0 THEN ' 向 ' ELSE '从' END, '乙', CAST(o_orderkey % 50 AS STRING), '集团', CASE WHEN o_orderkey % 8 = 5 THEN '共' ELSE '' END,
    CASE o_orderkey % 7 WHEN 0 THEN '采购' WHEN 1 THEN '购买' WHEN 2 THEN '订购' WHEN 3 THEN '购入' WHEN 4 THEN '出售' ELSE '采购' END, '零件', CAST(o_orderkey % 7 AS STRING), CASE WHEN o_orderkey % 9 < 4 THEN '型设备' ELSE '' END, CASE WHEN o_orderkey % 6 = 0 THEN '吗？' ELSE '。' END, '合同', CAST(o_orderkey % 90 + 1 AS STRING), CASE WHEN o_orderkey % 11 = 0 THEN '斤' ELSE '万元' END, '。') AS text FROM {orders}"""


def relation_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    news = spark.sql(NEWS, orders=table(spark, sf_dir, "orders"))
    entities = news.select("id", F.explode(F.array("a", "b")).alias("name"))
    found = relations.supplies(news, entities, "id").join(news.select("id", "source_kind"), "id")
    return relations.claims(found, F.col("source_kind")).select("id", F.col("start").alias("s"), F.col("end").alias("e"), "buyer", "supplier", "goods", "predicate", "polarity", "modality", "confidence", "amount", "product")


NEWS_SQL = NEWS.replace("{orders}", "orders")
RELATION_SQL = f"""WITH n AS ({NEWS_SQL}), x AS (SELECT *, concat('零件', id % 7, CASE WHEN id % 9 < 4 THEN '型设备' ELSE '' END) AS item FROM n WHERE id % 7 <> 4),
y AS (SELECT *, concat(item, CASE WHEN id % 6 = 0 THEN '吗' ELSE '' END) AS goods FROM x)
SELECT id, (instr(text, a) - 1)::INT AS s, (instr(text, goods) - 1 + length(goods))::INT AS e, a AS buyer, b AS supplier, goods, 'supplies' AS predicate, CASE WHEN id % 4 = 0 THEN 'negative' ELSE 'positive' END AS polarity,
    CASE WHEN source_kind = 'model_output' THEN 'hypothetical' WHEN id % 6 = 0 THEN 'question' WHEN id % 5 <= 2 THEN 'hypothetical' ELSE 'asserted' END AS modality, CASE source_kind WHEN 'document' THEN 0.95 WHEN 'model_output' THEN 0.65 ELSE 0.85 END::DOUBLE AS confidence,
    CASE WHEN id % 11 <> 0 THEN concat(id % 90 + 1, '万元') END AS amount, CASE WHEN id % 9 < 4 THEN item END AS product FROM y"""


def mention_recognition(spark: SparkSession, sf_dir: str) -> DataFrame:
    news = spark.sql(NEWS, orders=table(spark, sf_dir, "orders"))
    return relations.mentions(news, "id").select("id", F.col("start").alias("s"), F.col("end").alias("e"), "name", "entity_type")


#: The words before a name stay with it unless they are of the list that leads up to one, or a mark or blank ends them.
MENTION_SQL = f"""WITH n AS ({NEWS_SQL}), m AS (SELECT id, text, CASE WHEN id % 5 = 0 THEN concat('据称', a) ELSE a END AS name FROM n
    UNION ALL SELECT id, text, CASE WHEN id % 2 = 0 THEN b WHEN id % 4 = 0 THEN concat('并未从', b) ELSE b END FROM n)
SELECT id, (instr(text, name) - 1)::INT AS s, (instr(text, name) - 1 + length(name))::INT AS e, name, 'ORG' AS entity_type FROM m"""


def entity_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of half of the texts, of which some are known and some are aliases."""
    news = spark.sql(NEWS, orders=table(spark, sf_dir, "orders"))
    names = news.select(F.explode(F.array("a", "b")).alias("name"), F.lit("ORG").alias("entity_type"))
    known = news.select(F.col("b").alias("name")).distinct().where("name LIKE '%1%'").select(F.concat(F.lit("known-"), "name").alias("entity_id"), "name", F.lit("ORG").alias("entity_type"))
    aliases = news.select(F.col("a").alias("alias")).distinct().where("alias LIKE '%7%'").withColumn("canonical", F.lit("乙1集团"))
    return relations.aligned(names, known, aliases, "t1", "d1")


ALIGN_SQL = f"""WITH n AS ({NEWS_SQL}), m AS (SELECT DISTINCT CASE WHEN x LIKE '甲%7%' THEN '乙1集团' ELSE x END AS name FROM (SELECT a AS x FROM n UNION SELECT b FROM n)), k AS (SELECT DISTINCT b AS name FROM n WHERE b LIKE '%1%'),
h AS (SELECT name, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(concat('t1:d1:ORG:', name))) AS h FROM m WHERE name NOT IN (SELECT name FROM k))
SELECT concat('known-', name) AS entity_id, name, 'ORG' AS entity_type FROM k UNION ALL SELECT concat_ws('-', h[1:8], h[9:12], concat('5', h[14:16]), concat(translate(h[17], '0123456789abcdef', '89ab89ab89ab89ab'), h[18:20]), h[21:32]), name, 'ORG' FROM h"""


def event_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    news = spark.sql(NEWS, orders=table(spark, sf_dir, "orders"))
    found = relations.supplies(news, news.select("id", F.explode(F.array("a", "b")).alias("name")), "id").join(news.select("id", F.sha2("text", 256).alias("digest")), "id")
    told = relations.event_candidates(found.withColumns({"source": F.concat(F.lit("src-"), F.col("id").cast("string")), "offset": (F.col("id") % 1000).cast("int")}), "source", "digest", "offset")
    return told.select("id", "candidate_id", F.col("start").alias("s"), F.col("end").alias("e"))


EVENT_SQL = f"""{RELATION_SQL[: RELATION_SQL.rindex("SELECT id, (instr")]}, p AS (SELECT id, a, b, sha256(text) AS digest, (instr(text, a) - 1 + id % 1000)::INT AS s, (instr(text, goods) - 1 + length(goods) + id % 1000)::INT AS e FROM y),
h AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(concat_ws('/', concat('src-', id), digest, a, b, s, e))) AS h FROM p)
SELECT id, concat_ws('-', h[1:8], h[9:12], concat('5', h[14:16]), concat(translate(h[17], '0123456789abcdef', '89ab89ab89ab89ab'), h[18:20]), h[21:32]) AS candidate_id, s, e FROM h"""

COMMANDS = "SELECT user_id % 60 AS candidate, event_id, CASE event_type WHEN 'view' THEN 'publish' WHEN 'click' THEN 'reject' WHEN 'error' THEN 'revise' WHEN 'signup' THEN 'withdraw' ELSE 'dispute' END AS command FROM {events}"


def state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.fold_states(spark.sql(COMMANDS, events=table(spark, sf_dir, "events")), "candidate", "event_id", "command")


FOLD_SQL = f"""WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY event_id) AS i FROM ({COMMANDS.replace("{events}", "events")})),
f AS (SELECT candidate, 0::BIGINT AS i, 'proposed' AS state, 1 AS version, 0 AS n_applied FROM c GROUP BY 1 UNION ALL
    SELECT x.candidate, x.i, coalesce(x.nxt, x.state), x.version + CASE WHEN x.nxt IS NOT NULL AND x.command = 'revise' THEN 1 ELSE 0 END, x.n_applied + CASE WHEN x.nxt IS NOT NULL THEN 1 ELSE 0 END
    FROM (SELECT f.candidate, c.i, f.state, f.version, f.n_applied, c.command, CASE concat(f.state, ' ', c.command) WHEN 'proposed publish' THEN 'published' WHEN 'proposed reject' THEN 'rejected' WHEN 'proposed dispute' THEN 'disputed' WHEN 'disputed reject' THEN 'rejected' WHEN 'published withdraw' THEN 'withdrawn'
        WHEN 'proposed withdraw' THEN 'withdrawn' WHEN 'rejected revise' THEN 'proposed' WHEN 'withdrawn revise' THEN 'proposed' END AS nxt FROM f JOIN c ON c.candidate = f.candidate AND c.i = f.i + 1) x)
SELECT candidate, arg_max(state, i) AS state, arg_max(version, i)::BIGINT AS version, arg_max(n_applied, i)::BIGINT AS n_applied FROM f GROUP BY 1"""

REQUESTS = "SELECT o_orderkey AS record_id, CASE WHEN o_custkey % 2 = 0 THEN 'm-1' ELSE 'm-2' END AS model, 'chat' AS protocol, o_orderstatus AS status, o_orderdate AS created_at, o_orderdate + INTERVAL 365 DAYS AS expires_at FROM {orders}"


def history_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger.history(spark.sql(REQUESTS, orders=table(spark, sf_dir, "orders")), F.expr("TIMESTAMP '1999-06-01'"), model="m-1", status="O", since="1998-09-01", until="1999-03-01")
    return rows.orderBy(F.col("created_at").desc(), F.col("record_id").desc()).limit(100).select("record_id", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


HISTORY_SQL = f"SELECT record_id, strftime(created_at, '%Y-%m-%d') AS day FROM ({REQUESTS.replace('{orders}', 'orders')}) WHERE expires_at > TIMESTAMP '1999-06-01' AND model = 'm-1' AND status = 'O' AND created_at >= TIMESTAMP '1998-09-01' AND created_at < TIMESTAMP '1999-03-01' ORDER BY created_at DESC, record_id DESC LIMIT 100"

TOKENS = "SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i, CASE l_suppkey % 5 WHEN 0 THEN 'O' WHEN 1 THEN 'B-ORG' WHEN 2 THEN 'I-ORG' WHEN 3 THEN 'I-PER' ELSE 'B-PER' END AS label FROM {lineitem}"


def label_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.sql(TOKENS, lineitem=table(spark, sf_dir, "lineitem")).withColumns({"start": (F.col("i") * 4).cast("int"), "end": (F.col("i") * 4 + 3).cast("int")})
    return ledger.decode_labels(t, "doc", "i").select("doc", "entity_type", F.col("start").alias("s"), F.col("end").alias("e"))


DECODE_SQL = f"""WITH t AS ({TOKENS.replace("{lineitem}", "lineitem")}), k AS (SELECT *, CASE WHEN label <> 'O' THEN substr(label, 3) END AS kind FROM t), b AS (SELECT *, CASE WHEN kind IS NOT NULL AND (label[1] = 'B' OR lag(kind) OVER w IS NULL OR lag(kind) OVER w <> kind) THEN 1 ELSE 0 END AS b FROM k WINDOW w AS (PARTITION BY doc ORDER BY i)),
g AS (SELECT *, sum(b) OVER (PARTITION BY doc ORDER BY i) AS n FROM b) SELECT doc, kind AS entity_type, (min(i) * 4)::INT AS s, (max(i) * 4 + 3)::INT AS e FROM g WHERE kind IS NOT NULL GROUP BY doc, n, kind"""


def upsert_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("k"), "event_id", "event_type")
    last = ledger.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "k", "event_id", False).withColumn("rule", F.lit("last"))
    return last.unionByName(ledger.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "k", "event_id", True).withColumn("rule", F.lit("first")))


UPSERT_SQL = "SELECT user_id % 50 AS k, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, 'last' AS rule FROM events GROUP BY 1 UNION ALL SELECT user_id % 50, min(event_id), arg_min(event_type, event_id), 'first' FROM events GROUP BY 1"

QUERIES = {"relation_extract": (relation_extract, RELATION_SQL), "mention_recognition": (mention_recognition, MENTION_SQL), "entity_alignment": (entity_alignment, ALIGN_SQL), "event_candidates": (event_candidates, EVENT_SQL), "state_fold": (state_fold, FOLD_SQL), "history_list": (history_list, HISTORY_SQL), "label_decode": (label_decode, DECODE_SQL), "upsert_last": (upsert_last, UPSERT_SQL)}
