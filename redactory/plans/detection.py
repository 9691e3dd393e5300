"""Queries of the detection and masking families, with their SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.functions import checks
from redactory.functions.recognizers import detect, detect_once
from redactory.operators import fragments as fr
from redactory.operators import spans as sp
from redactory.sources.tables import once, table

TODAY = datetime.date(2024, 1, 1)

#: Fragments that make every rule hit in some rows and miss in others.
FRAGMENTS = """SELECT o_orderkey AS frag_id, o_custkey % 300 AS request_id, o_orderkey % 4 AS kind, CASE o_orderkey % 4
    WHEN 0 THEN concat('合同编号：HT-2024-', lpad(CAST(o_orderkey % 100000 AS STRING), CASE WHEN o_orderkey % 8 = 0 THEN 5 ELSE 7 END, '0'), ' 金额: ', CAST(o_orderkey * 37 % 90000 + 1 AS STRING), '元')
    WHEN 1 THEN concat('联系电话 13', lpad(CAST(o_custkey % 7 AS STRING), CASE WHEN o_orderkey % 8 = 1 THEN 9 ELSE 10 END, '4'), ' 甲方：', CAST(o_orderkey % 9 AS STRING))
    WHEN 2 THEN concat('收款账号: ', lpad(CAST(o_custkey AS STRING), CASE WHEN o_orderkey % 8 = 2 THEN 12 ELSE 7 END, '6'), ' note ', CAST(o_orderkey % 5 AS STRING))
    ELSE concat('config ', CASE WHEN o_orderkey % 8 = 3 THEN 'sk-' ELSE 'sx-' END, lpad(CAST(o_orderkey AS STRING), 20, 'a'), ' end') END AS text FROM {orders}"""


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FRAGMENTS, orders=table(spark, sf_dir, "orders"))


FRAGMENTS_SQL = FRAGMENTS.replace("{orders}", "orders")
#: What the rules find there, by SQL: the value's place from its known context.
HITS_SQL = f"""f AS ({FRAGMENTS_SQL}),
h AS (SELECT frag_id, request_id, text, 'rule:contract' AS source, 'CONTRACT_NUMBER' AS entity_type, 3 AS priority, regexp_extract(text, '合同编号：(HT-[0-9]{{4}}-[0-9]{{3,6}})([^A-Z0-9-]|$)', 1) AS v FROM f
    UNION ALL SELECT frag_id, request_id, text, 'rule:money', 'MONEY_AMOUNT', 3, regexp_extract(text, '金额: ([0-9]+元)', 1) FROM f
    UNION ALL SELECT frag_id, request_id, text, 'rule:phone', 'PHONE_NUMBER', 3, regexp_extract(text, '电话 (13[0-9]{{9}})([^0-9]|$)', 1) FROM f
    UNION ALL SELECT frag_id, request_id, text, 'rule:account', 'ACCOUNT_NUMBER', 3, regexp_extract(text, '账号: ([0-9]{{8,30}})([^0-9]|$)', 1) FROM f
    UNION ALL SELECT frag_id, request_id, text, 'rule:api_key', 'SECRET', 0, regexp_extract(text, '(sk-[A-Za-z0-9]{{16,}})( |$)', 1) FROM f),
c AS (SELECT frag_id, request_id, text, source, entity_type, priority, v, (instr(text, v) - 1)::INT AS s, (instr(text, v) - 1 + length(v))::INT AS e FROM h WHERE v <> '')"""


def found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = fragments(spark, sf_dir)
    return f, once(spark, (sf_dir, "fragment spans"), lambda: detect_once(f, "frag_id", today=TODAY))


def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, spans = found(spark, sf_dir)
    return spans.withColumnRenamed("start", "s").withColumnRenamed("end", "e")


RULE_HITS_SQL = f"WITH {HITS_SQL} SELECT frag_id, s, e, entity_type, priority, source FROM c"


def secret_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, spans = found(spark, sf_dir)
    return fr.blocked_requests(f, spans, "request_id", "frag_id")


SECRET_BLOCK_SQL = f"WITH {HITS_SQL} SELECT f.request_id, count(DISTINCT f.frag_id)::BIGINT AS n_fragments, coalesce(bool_or(c.priority = 0), false) AS blocked FROM f LEFT JOIN c USING (frag_id) GROUP BY f.request_id"


def redact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: detection, merging, blocking of whole requests, numbering and counts by type."""
    f, spans = found(spark, sf_dir)
    masked = fr.mask(f, spans, "request_id", "frag_id")
    return masked.mapping.join(masked.uses, ["request_id", "entity_type", "original"]).groupBy("entity_type").agg(F.count_distinct("request_id", "token").alias("n_tokens"), F.count("*").alias("n_uses"), F.max("token").alias("last_token"))


REDACT_COUNTS_SQL = f"""WITH {HITS_SQL}, b AS (SELECT DISTINCT request_id FROM c WHERE priority = 0),
k AS (SELECT * FROM c WHERE request_id NOT IN (SELECT request_id FROM b)),
t AS (SELECT request_id, entity_type, v, row_number() OVER (PARTITION BY request_id, entity_type ORDER BY min((frag_id, s))) AS n FROM k GROUP BY request_id, entity_type, v)
SELECT k.entity_type, count(DISTINCT (k.request_id, t.n))::BIGINT AS n_tokens, count(*)::BIGINT AS n_uses, max(format('<{{}}_{{:03d}}>', k.entity_type, t.n)) AS last_token FROM k JOIN t USING (request_id, entity_type, v) GROUP BY k.entity_type"""


def placeholder_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, spans = found(spark, sf_dir)
    return fr.mask(f, spans, "request_id", "frag_id").mapping.select("request_id", "entity_type", "original", "token")


PLACEHOLDER_SQL = REDACT_COUNTS_SQL[: REDACT_COUNTS_SQL.rindex("SELECT k.entity_type")] + "SELECT request_id, entity_type, v AS original, format('<{}_{:03d}>', entity_type, n) AS token FROM t"


def redacted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, spans = found(spark, sf_dir)
    return fr.mask(f, spans, "request_id", "frag_id").redacted.select("frag_id", "redacted")


REDACTED_SQL = REDACT_COUNTS_SQL[: REDACT_COUNTS_SQL.rindex("SELECT k.entity_type")].rstrip() + """,
u AS (SELECT frag_id, s, e, format('<{}_{:03d}>', entity_type, n) AS token FROM k JOIN t USING (request_id, entity_type, v)),
g AS (SELECT f.frag_id, f.text, u1.s AS s1, u1.e AS e1, u1.token AS t1, u2.s AS s2, u2.e AS e2, u2.token AS t2 FROM f
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY frag_id ORDER BY s) AS i FROM u) u1 ON f.frag_id = u1.frag_id AND u1.i = 1
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY frag_id ORDER BY s) AS i FROM u) u2 ON f.frag_id = u2.frag_id AND u2.i = 2
    WHERE f.request_id NOT IN (SELECT request_id FROM b))
SELECT frag_id, CASE WHEN t1 IS NULL THEN text WHEN t2 IS NULL THEN concat(substr(text, 1, s1), t1, substr(text, e1 + 1)) ELSE concat(substr(text, 1, s1), t1, substr(text, e1 + 1, s2 - e1), t2, substr(text, e2 + 1)) END AS redacted FROM g"""


def restore_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, spans = found(spark, sf_dir)
    masked = fr.mask(f, spans, "request_id", "frag_id")
    back = fr.restore(masked.redacted, masked.mapping, "request_id", "redacted")
    return back.join(f.select("frag_id", "text"), "frag_id").agg(F.count("*").alias("n"), F.count_if(F.col("restored") == F.col("text")).alias("n_equal"), F.count_if(F.col("redacted") != F.col("text")).alias("n_changed"))


ROUNDTRIP_SQL = f"WITH {HITS_SQL} SELECT count(*)::BIGINT AS n, count(*)::BIGINT AS n_equal, count(*) FILTER (frag_id IN (SELECT frag_id FROM c))::BIGINT AS n_changed FROM f WHERE request_id NOT IN (SELECT request_id FROM c WHERE priority = 0)"

NUMBERS = """SELECT o_orderkey AS n_id, concat('11010119', lpad(CAST(o_orderkey % 100 AS STRING), 2, '0'), lpad(CAST(o_custkey % 13 AS STRING), 2, '0'), lpad(CAST(o_orderkey % 32 AS STRING), 2, '0'), lpad(CAST(o_custkey % 1000 AS STRING), 3, '0'), substr('0123456789X', CAST(o_orderkey % 11 AS INT) + 1, 1)) AS number,
    concat('9135', lpad(CAST(o_custkey AS STRING), 6, '0'), lpad(CAST(o_orderkey AS STRING), 7, '0'), substr('0123456789ABCDEFGHJKLMNPQRTUWXY', CAST(o_custkey % 31 AS INT) + 1, 1)) AS code FROM {orders}"""


def number_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.sql(NUMBERS, orders=table(spark, sf_dir, "orders"))
    return n.select("n_id", checks.id_number_check(F.col("number")).alias("id_ok"), checks.id_number_born(F.col("number"), F.lit("2024-01-01").cast("date")).alias("born_ok"), checks.credit_code_check(F.col("code")).alias("code_ok"))


NUMBER_CHECKS_SQL = f"""WITH n AS ({NUMBERS.replace("{orders}", "orders")})
SELECT n_id, substr('10X98765432', (list_sum(list_transform(range(1, 18), lambda i: substr(number, i, 1)::INT * [7,9,10,5,8,4,2,1,6,3,7,9,10,5,8,4,2][i]))::INT % 11) + 1, 1) = substr(number, 18, 1) AS id_ok,
    coalesce(try_strptime(substr(number, 7, 8), '%Y%m%d')::DATE BETWEEN DATE '1900-01-01' AND DATE '2024-01-01', false) AS born_ok,
    substr('0123456789ABCDEFGHJKLMNPQRTUWXY', (31 - list_sum(list_transform(range(1, 18), lambda i: (instr('0123456789ABCDEFGHJKLMNPQRTUWXY', substr(code, i, 1)) - 1) * [1,3,9,27,19,26,16,17,20,29,25,13,8,24,10,30,28][i]))::INT % 31) % 31 + 1, 1) = substr(code, 18, 1) AS code_ok FROM n"""

WORDS = {"red": "COLOR", "blue": "COLOR", "red widget": "ITEM", "widget": "THING", "ring": "ITEM", "small ring": "ITEM"}
PART_TEXT = "SELECT p_partkey AS frag_id, concat(p_name, ', ', p_type, '; ', p_name, ' red') AS text FROM {part}"


def dict_longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = spark.sql(PART_TEXT, part=table(spark, sf_dir, "part"))
    hits = detect(text, "frag_id", entries=WORDS, today=TODAY).where("source = 'dict'").join(text, "frag_id")
    return hits.groupBy(F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("word"), "entity_type").agg(F.count("*").alias("n"), F.count_distinct("frag_id").alias("n_texts"))


DICT_SQL = f"""WITH t AS ({PART_TEXT.replace("{part}", "part")}), m AS (SELECT frag_id, unnest(regexp_extract_all(text, 'red widget|small ring|widget|blue|ring|red')) AS word FROM t)
SELECT word, CASE WHEN word IN ('red', 'blue') THEN 'COLOR' WHEN word = 'widget' THEN 'THING' ELSE 'ITEM' END AS entity_type, count(*)::BIGINT AS n, count(DISTINCT frag_id)::BIGINT AS n_texts FROM m GROUP BY ALL"""


#: Texts that turn on the rules for places and surnames, and near misses.
SMALL_TEXTS = "SELECT CASE CAST(o_orderkey % 9 AS INT) WHEN 0 THEN '某某街' WHEN 1 THEN '张三' WHEN 2 THEN '他叫欧阳明' WHEN 3 THEN '路x' WHEN 4 THEN '好的张' WHEN 5 THEN '路，远' WHEN 6 THEN '见于张三' WHEN 7 THEN 'xAnna' ELSE 'Привет' END AS text FROM {orders}"


def quick_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = spark.sql(SMALL_TEXTS, orders=table(spark, sf_dir, "orders"))
    texts = table(spark, sf_dir, "documents").select("text").unionByName(fragments(spark, sf_dir).select("text")).unionByName(small)
    return texts.select(checks.risk(F.col("text")).alias("score")).groupBy("score").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 0.35).alias("n_detect"))


QUICK_SQL = rf"""WITH t AS (SELECT text FROM documents UNION ALL SELECT text FROM ({FRAGMENTS_SQL}) UNION ALL SELECT text FROM ({SMALL_TEXTS.replace("{orders}", "orders")})), s AS (SELECT CASE
    WHEN regexp_matches(text, '(?i)[0-9@]|https?://|sk-|ak-|-----begin|password|passwd|api[_ -]?key|secret|token|姓名|联系人|身份证|手机号|电话|地址|住址|账号|账户|合同|金额|密码|口令|密钥|公司|科技|集团|有限|银行|医院|大学|学校|研究院|事务所|先生|女士')
        OR regexp_matches(text, '[省市县区镇村街路号室]($|[^\pL\pN_]|[\x{{3400}}-\x{{9FFF}}])') THEN 1.0
    WHEN regexp_matches(text, '(^|[^\pL\pN_])[A-Z][a-z]{{1,30}}($|[^\pL\pN_])|[\x{{C0}}-\x{{24F}}\x{{400}}-\x{{4FF}}\x{{3040}}-\x{{30FF}}\x{{AC00}}-\x{{D7AF}}]')
        OR regexp_matches(text, '(^|[\s，。！？、:：=的叫是为与和])[{checks.SURNAMES}][\x{{3400}}-\x{{9FFF}}]') THEN 0.75 ELSE 0.02 END::DOUBLE AS score FROM t)
SELECT score, count(*)::BIGINT AS n, count(*) FILTER (score >= 0.35)::BIGINT AS n_detect FROM s GROUP BY score"""

SPANS = "SELECT l_orderkey AS doc, CAST(l_partkey % 60 AS INT) AS s, CAST(l_partkey % 60 + 1 + l_suppkey % 12 AS INT) AS e, CASE l_returnflag WHEN 'A' THEN 'ORG' WHEN 'N' THEN 'PERSON' ELSE 'PHONE' END AS entity_type, CAST(1 + l_linenumber % 3 AS INT) AS priority, concat('rule:', l_linestatus) AS source FROM {lineitem}"


def sample_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SPANS, lineitem=table(spark, sf_dir, "lineitem")).withColumnRenamed("s", "start").withColumnRenamed("e", "end")


SPANS_SQL = SPANS.replace("{lineitem}", "lineitem")


def span_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = sp.merge_spans(sample_spans(spark, sf_dir), "doc")
    return m.select("doc", F.col("start").alias("s"), F.col("end").alias("e"), "entity_type", "priority", F.array_join("sources", ",").alias("sources"))


SPAN_MERGE_SQL = f"""WITH x AS (SELECT DISTINCT * FROM ({SPANS_SQL})), o AS (SELECT *, CASE WHEN s < max(e) OVER w THEN 0 ELSE 1 END AS fresh FROM x WINDOW w AS (PARTITION BY doc ORDER BY s, e, entity_type, priority, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc ORDER BY s, e, entity_type, priority, source ROWS UNBOUNDED PRECEDING) AS i FROM o)
SELECT doc, min(s) AS s, max(e) AS e, CASE WHEN count(DISTINCT entity_type) = 1 THEN min(entity_type) ELSE 'MIXED' END AS entity_type, min(priority) AS priority, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM g GROUP BY doc, i"""


def union_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.envelopes(sample_spans(spark, sf_dir), "doc").select("doc", "entity_type", F.col("start").alias("s"), F.col("end").alias("e"), "clash")


ENVELOPES_SQL = f"""WITH x AS (SELECT DISTINCT doc, entity_type, s, e FROM ({SPANS_SQL})), o AS (SELECT *, CASE WHEN s < max(e) OVER w THEN 0 ELSE 1 END AS fresh FROM x WINDOW w AS (PARTITION BY doc, entity_type ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc, entity_type ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM o),
m AS (SELECT doc, entity_type, min(s) AS s, max(e) AS e FROM g GROUP BY doc, entity_type, i)
SELECT a.doc, a.entity_type, a.s, a.e, count(b.doc) > 0 AS clash FROM m a LEFT JOIN m b ON a.doc = b.doc AND a.entity_type <> b.entity_type AND a.s < b.e AND b.s < a.e GROUP BY ALL"""


def codepoint_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = sample_spans(spark, sf_dir)
    c = sp.coverage(spans.where("entity_type = 'ORG'").select("doc", "start", "end").distinct(), spans.where("entity_type <> 'ORG'"), "doc")
    return c.agg(F.count("*").alias("n_spans"), F.sum(F.col("end") - F.col("start")).alias("n_points"), F.sum("covered").alias("n_covered"), F.count_if(F.col("covered") == F.col("end") - F.col("start")).alias("n_full"))


COVERAGE_SQL = f"""WITH x AS ({SPANS_SQL}), g AS (SELECT DISTINCT doc, s, e FROM x WHERE entity_type = 'ORG'), p AS (SELECT DISTINCT doc, unnest(range(s, e)) AS i FROM x WHERE entity_type <> 'ORG'),
q AS (SELECT doc, s, e, unnest(range(s, e)) AS i FROM g), r AS (SELECT q.doc, s, e, count(*) AS n, count(p.i) AS c FROM q LEFT JOIN p USING (doc, i) GROUP BY ALL)
SELECT count(*)::BIGINT AS n_spans, sum(n)::BIGINT AS n_points, sum(c)::BIGINT AS n_covered, count(*) FILTER (n = c)::BIGINT AS n_full FROM r"""


def window_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.plan_windows(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", 382, 318)


WINDOW_PLAN_SQL = """WITH d AS (SELECT doc_id, n_chars, greatest(n_chars - 382, 0) AS last FROM documents WHERE n_chars > 0),
w AS (SELECT doc_id, n_chars, list_distinct(list_concat(list_filter(range(0, last + 1, 318), lambda s: s < last), [last])) AS s FROM d),
u AS (SELECT doc_id, n_chars, unnest(list_sort(s)) AS window_start, unnest(range(0, len(s)))::INT AS window_no FROM w)
SELECT doc_id, n_chars, window_no, window_start::INT AS window_start, least(window_start + 382, n_chars)::INT AS window_end FROM u"""


def reserved_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.element_at(F.array(*map(F.lit, ("plain ", "<ORG_00", "a <<ENT", "x < ITEM-", "ends <<E", "<b> bold"))), (F.col("o_orderkey") % 6 + 1).cast("int")), F.when(F.col("o_orderkey") % 5 == 0, F.lit("")).otherwise(F.lit("7>"))).alias("text"))
    return texts.select("id", sp.reserved(F.col("text")).alias("is_reserved"))


RESERVED_SQL = r"""WITH t AS (SELECT o_orderkey AS id, concat(['plain ', '<ORG_00', 'a <<ENT', 'x < ITEM-', 'ends <<E', '<b> bold'][o_orderkey % 6 + 1], CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '7>' END) AS text FROM orders)
SELECT id, regexp_matches(text, '<\s*([A-Z][A-Z0-9_]{0,31}_|[A-Za-z][A-Za-z0-9_]{0,31}[-_]\s*[0-9]|[A-Z][A-Z_]{0,31}[0-9])|<[A-Za-z][A-Za-z0-9_]*_\s*[0-9]*$') OR contains(text, '<<ENT') OR text LIKE '%<<E' OR text LIKE '%<<EN' AS is_reserved FROM t"""


def roles_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = spark.sql(ROLE_TEXT, supplier=table(spark, sf_dir, "supplier"), orders=table(spark, sf_dir, "orders"))
    return fr.roles(f, "request_id")


#: In a third of the rows the cue hangs on the customer, so an original of a request may have two roles.
ROLE_TEXT = """SELECT o_orderkey % 50 AS request_id, o_orderkey AS frag_id, 'ORG' AS entity_type, s_name AS original, CASE (CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE o_orderkey END) % 5 WHEN 0 THEN '甲方：' WHEN 1 THEN '乙方名称 ' WHEN 2 THEN '致 乙方 的信 ' WHEN 3 THEN '甲方为' ELSE '无关内容 ' END AS before
    FROM {orders} JOIN {supplier} ON s_suppkey = o_custkey % 40"""
ROLES_SQL = f"""WITH t AS ({ROLE_TEXT.replace("{orders}", "orders").replace("{supplier}", "supplier")}), r AS (SELECT DISTINCT request_id, entity_type, original, CASE before WHEN '甲方：' THEN 'PARTYA' WHEN '甲方为' THEN 'PARTYA' WHEN '乙方名称 ' THEN 'PARTYB' END AS role FROM t)
SELECT request_id, entity_type, original, min(role) AS role FROM r WHERE role IS NOT NULL GROUP BY ALL HAVING count(*) = 1"""


def fragments_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    body = F.to_json(F.struct(F.lit("m-1").alias("model"), F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages")))
    return fr.chat_fragments(raw.select("conv_id", body.alias("body")), "conv_id", "body", ("m-1",)).select("conv_id", "json_path", "role", F.length("content").alias("n_chars"), "requires_detection")


EXPLODE_SQL = """SELECT conv_id, concat('messages[', row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1, '].content') AS json_path, role, length(text)::INT AS n_chars, role IN ('user', 'assistant', 'tool') AS requires_detection FROM conversations"""


def multi_turn_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.history_savings(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


MULTI_SQL = """WITH h AS (SELECT a.conv_id, a.turn, b.text FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn <= a.turn)
SELECT conv_id, count(*)::BIGINT AS without_cache, count(DISTINCT text)::BIGINT AS with_cache FROM h GROUP BY conv_id"""


def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.cache_hits(table(spark, sf_dir, "documents"), "source", "doc_id", "text")


CACHE_SQL = """WITH r AS (SELECT source, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents)
SELECT source, count(*) FILTER (n > 1)::BIGINT AS hits, count(*) FILTER (n = 1)::BIGINT AS misses, coalesce(sum(length(text)) FILTER (n > 1), 0)::BIGINT AS avoided_chars, round(count(*) FILTER (n > 1) / count(*), 4) AS hit_rate FROM r GROUP BY source"""


def static_exemption(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("domain"), "text")
    registry = docs.where("doc_id % 10 = 0").select("domain", F.col("doc_id").alias("template_id"), "text", F.when(F.col("doc_id") % 30 != 0, F.sha2("text", 256)).otherwise("stale").alias("sha256"))
    return fr.exempt(docs, registry).select("doc_id", "exempt")


EXEMPT_SQL = """WITH r AS (SELECT DISTINCT lang, text FROM documents WHERE doc_id % 10 = 0 AND doc_id % 30 <> 0)
SELECT doc_id, r.text IS NOT NULL AS exempt FROM documents d LEFT JOIN r ON d.lang = r.lang AND d.text = r.text"""


#: Every third fragment's text is a registered template of its domain; of some the digest is wrong, of others the id is there twice.
TEMPLATES = "SELECT concat('d', CAST(o_orderkey % 2 AS STRING)) AS domain, concat('t', CAST(CASE WHEN o_orderkey % 35 = 15 THEN o_orderkey - 3 ELSE o_orderkey END AS STRING)) AS template_id, text, CASE WHEN o_orderkey % 21 = 6 THEN 'x' ELSE sha2(text, 256) END AS sha256 FROM (SELECT frag_id AS o_orderkey, text FROM {fragments}) WHERE o_orderkey % 3 = 0"


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TEMPLATES, fragments=fragments(spark, sf_dir))


def registry_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.registry_faults(registry(spark, sf_dir))


_TEMPLATES_SQL = TEMPLATES.replace("{fragments}", "f").replace("sha2(text, 256)", "sha256(text)")
REGISTRY_SQL = f"""WITH f AS ({FRAGMENTS_SQL}), t AS ({_TEMPLATES_SQL}) SELECT domain, template_id, CASE WHEN count(*) > 1 THEN 'DUPLICATE_TEMPLATE' WHEN bool_or(sha256 = 'x') THEN 'DIGEST_MISMATCH' END AS code FROM t GROUP BY 1, 2"""


def exempt_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per fragment whether it is exempt, and its number of spans: exempt ones have none."""
    texts = fragments(spark, sf_dir).withColumn("domain", F.concat(F.lit("d"), (F.col("frag_id") % 2).cast("string")))
    marked, spans = fr.detect_but_exempt(texts, registry(spark, sf_dir), "frag_id", today=TODAY)
    return marked.select("frag_id", "exempt").join(spans.groupBy("frag_id").agg(F.count("*").alias("n")), "frag_id", "left").select("frag_id", "exempt", F.coalesce("n", F.lit(0)).alias("n"))


EXEMPT_DETECT_SQL = f"""WITH {HITS_SQL}, t AS ({_TEMPLATES_SQL}), x AS (SELECT DISTINCT domain, text FROM t WHERE sha256 <> 'x'), n AS (SELECT frag_id, count(*) AS n FROM c GROUP BY 1)
SELECT frag_id, x.text IS NOT NULL AS exempt, CASE WHEN x.text IS NULL THEN coalesce(n, 0) ELSE 0 END::BIGINT AS n FROM f LEFT JOIN x ON x.text = f.text AND x.domain = concat('d', frag_id % 2) LEFT JOIN n USING (frag_id)"""


def skill_result_exempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").select(F.col("event_id").alias("call_id"), F.when(F.col("event_type") == "signup", "Skill").otherwise(F.col("event_type")).alias("name"))
    results = table(spark, sf_dir, "events").select((F.col("event_id") * 2 % 12000).alias("call_id"), "event_id")
    kept = fr.without_skill_results(results, calls)
    return kept.groupBy(F.col("event_id") % 10).agg(F.count("*").alias("n")).select(F.col("(event_id % 10)").alias("bucket"), "n")


SKILL_SQL = """SELECT event_id % 10 AS bucket, count(*)::BIGINT AS n FROM events e WHERE NOT EXISTS (SELECT 1 FROM events c WHERE c.event_id = e.event_id * 2 % 12000 AND c.event_type = 'signup') GROUP BY 1"""

QUERIES = {
    "rule_hits": (rule_hits, RULE_HITS_SQL), "secret_block": (secret_block, SECRET_BLOCK_SQL), "redact_counts": (redact_counts, REDACT_COUNTS_SQL), "placeholder_numbering": (placeholder_numbering, PLACEHOLDER_SQL),
    "redacted_text": (redacted_text, REDACTED_SQL), "restore_roundtrip": (restore_roundtrip, ROUNDTRIP_SQL), "number_checks": (number_checks, NUMBER_CHECKS_SQL), "dict_longest_match": (dict_longest_match, DICT_SQL),
    "quick_screen": (quick_screen, QUICK_SQL), "span_merge": (span_merge, SPAN_MERGE_SQL), "union_envelopes": (union_envelopes, ENVELOPES_SQL), "codepoint_coverage": (codepoint_coverage, COVERAGE_SQL), "window_plan": (window_plan, WINDOW_PLAN_SQL),
    "reserved_literals": (reserved_literals, RESERVED_SQL), "roles_assign": (roles_assign, ROLES_SQL), "fragments_explode": (fragments_explode, EXPLODE_SQL), "multi_turn_dedupe": (multi_turn_dedupe, MULTI_SQL),
    "cache_stats": (cache_stats, CACHE_SQL), "static_exemption": (static_exemption, EXEMPT_SQL), "skill_result_exempt": (skill_result_exempt, SKILL_SQL), "registry_check": (registry_check, REGISTRY_SQL), "exempt_detect": (exempt_detect, EXEMPT_DETECT_SQL),
}
