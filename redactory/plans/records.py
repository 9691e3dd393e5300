"""Queries of the records family, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.operators import governance as gov
from redactory.operators import records as rec
from redactory.sources.derived import NOW, derived, with_tables
from redactory.sources.tables import table

UNITS = """SELECT s_suppkey AS id, concat('华星', CAST(s_suppkey AS STRING), '公司', CASE WHEN s_suppkey % 3 = 0 THEN '/研发中心' WHEN s_suppkey % 3 = 1 THEN ' - 华东事业部/数据组' ELSE '下属研发中心' END, '，好') AS text, CAST(length(CAST(s_suppkey AS STRING)) + 4 AS INT) AS org_end FROM {supplier}"""


def hierarchy_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.sql(UNITS, supplier=table(spark, sf_dir, "supplier"))
    spans = t.select("id", F.lit(0).alias("start"), F.col("org_end").alias("end"), F.lit("ORG").alias("entity_type"), F.lit(3).alias("priority"))
    return rec.nested_units(t.select("id", "text"), spans, "id").join(t, "id").select("id", F.col("start").alias("s"), F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("unit"))


UNITS_SQL = f"""WITH t AS ({UNITS.replace("{supplier}", "supplier")}), u AS (SELECT id, text, unnest(CASE id % 3 WHEN 0 THEN ['研发中心'] WHEN 1 THEN ['华东事业部', '数据组'] ELSE [] END) AS unit FROM t) SELECT id, (instr(text, unit) - 1)::INT AS s, unit FROM u"""


def dictionary_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return rec.dictionary_faults(p.select("p_brand", F.when(F.col("p_partkey") % 50 == 0, " ").otherwise(F.col("p_name")).alias("text"), F.col("p_type").alias("entity_type")), "p_brand")


DICT_LOAD_SQL = """WITH t AS (SELECT p_brand, CASE WHEN p_partkey % 50 = 0 THEN ' ' ELSE p_name END AS text, count(*) AS n, count(DISTINCT p_type) AS k FROM part GROUP BY 1, 2)
SELECT p_brand, sum(n)::BIGINT AS n_entries, coalesce(sum(n) FILTER (trim(text) = ''), 0)::BIGINT AS n_empty, count(*) FILTER (n > 1)::BIGINT AS n_repeated, count(*) FILTER (k > 1)::BIGINT AS n_ambiguous FROM t GROUP BY 1"""

REQUIRED = ("model", "policy", "rules")
MANIFEST = "SELECT o_custkey % 100 AS manifest_id, concat('c', CAST(o_orderkey % 5 AS STRING)) AS component, min(o_orderkey) AS v FROM {orders} GROUP BY 1, 2"


def manifest_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = spark.sql(MANIFEST, orders=table(spark, sf_dir, "orders")).withColumn("component", F.replace("component", F.lit("c1"), F.lit("model")))
    declared = m.select("manifest_id", "component", F.sha2(F.col("v").cast("string"), 256).alias("sha256"))
    actual = m.where("v % 7 <> 0").select("manifest_id", "component", F.sha2(F.when(F.col("v") % 11 == 0, F.lit("x")).otherwise(F.col("v").cast("string")), 256).alias("sha256"))
    out = rec.manifest_faults(declared, actual, REQUIRED)
    return out.select("manifest_id", F.array_join("missing", ",").alias("missing"), F.array_join("wrong", ",").alias("wrong"), "root")


MANIFEST_SQL = f"""WITH m AS (SELECT manifest_id, replace(component, 'c1', 'model') AS c, v FROM ({MANIFEST.replace("{orders}", "orders")})), d AS (SELECT manifest_id, c, sha256(v::VARCHAR) AS h, v % 7 = 0 OR v % 11 = 0 AS bad FROM m)
SELECT manifest_id, CASE WHEN bool_or(c = 'model') THEN 'policy,rules' ELSE 'model,policy,rules' END AS missing, coalesce(string_agg(c, ',' ORDER BY c) FILTER (bad), '') AS wrong, sha256(string_agg(concat(c, '=', h), ';' ORDER BY c)) AS root FROM d GROUP BY 1"""


def dedup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = derived(spark, sf_dir, "sources").select("source_id", "tenant_id", "domain", "source_kind", "purpose", F.array_sort("acl").alias("acl"))
    return s.select("source_id", rec.dedup_key("tenant_id", "domain", "source_kind", "purpose", "acl").alias("k")).groupBy("k").agg(F.count("*").alias("n"), F.min("source_id").alias("first_id"))


KEYS_SQL = f"""{with_tables("sources")}, k AS (SELECT source_id, sha256(concat('{{"acl":["', array_to_string(list_sort(acl), '","'), '"],"domain":"', domain, '","purpose":"', purpose, '","source_kind":"', source_kind, '","tenant_id":"', tenant_id, '"}}')) AS k FROM sources)
SELECT k, count(*)::BIGINT AS n, min(source_id) AS first_id FROM k GROUP BY 1"""


def candidate_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, e, s, p = (derived(spark, sf_dir, n) for n in ("claims", "evidence", "sources", "publications"))
    rows = rec.readable(c.select(F.col("claim_id").alias("candidate_id")), gov.linked(e, s), F.arrays_overlap("acl", F.array(F.lit("g3"), F.lit("g4"))), p)
    return rows.groupBy("path").agg(F.count("*").alias("n"), F.sum("candidate_id").alias("id_sum"))


READ_SQL = f"""{with_tables("claims", "evidence", "sources", "publications")}, l AS (SELECT DISTINCT candidate_id, tenant_id, domain, source_id, version FROM evidence), n AS (SELECT candidate_id, count(*) AS n, count(*) FILTER (list_has_any(acl, ['g3', 'g4'])) AS ok FROM l JOIN sources USING (tenant_id, domain, source_id, version) GROUP BY 1)
SELECT CASE WHEN n = ok THEN 'evidence' WHEN claim_id IN (SELECT candidate_id FROM publications) THEN 'publication' END AS path, count(*)::BIGINT AS n, sum(claim_id)::BIGINT AS id_sum FROM claims LEFT JOIN n ON n.candidate_id = claim_id GROUP BY 1"""


def cache_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 8).alias("batch"), "text")
    return rec.shadow_hits(d, "batch", "text").groupBy("batch").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


PROBE_SQL = """WITH d AS (SELECT doc_id % 8 AS batch, text FROM documents), f AS (SELECT text, min(batch) AS b FROM d GROUP BY 1) SELECT batch, count(*) FILTER (b < batch)::BIGINT AS hits, count(*) FILTER (b >= batch)::BIGINT AS misses FROM d JOIN f USING (text) GROUP BY 1"""


def retention_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, e, p = (derived(spark, sf_dir, n) for n in ("sources", "evidence", "publications"))
    return rec.expired_sweep(s, e, p, F.expr("TIMESTAMP '1999-05-01'"), F.expr(NOW))


SWEEP_SQL = f"""{with_tables("sources", "evidence", "publications")}, d AS (SELECT source_id, strftime(retention_until, '%Y-%m-%d') AS day FROM sources WHERE retention_until > TIMESTAMP '1999-05-01' AND retention_until <= {NOW})
SELECT day, count(DISTINCT d.source_id)::BIGINT AS n_sources, count(DISTINCT p.publication_id)::BIGINT AS n_publications FROM d LEFT JOIN (SELECT DISTINCT source_id, candidate_id FROM evidence JOIN sources USING (tenant_id, domain, source_id, version)) e ON e.source_id = d.source_id LEFT JOIN publications p ON p.candidate_id = e.candidate_id GROUP BY 1"""


def jsonl_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.jsonl(derived(spark, sf_dir, "publications").withColumn("day", F.date_format("published_at", "yyyy-MM-dd")), "publication_id", "tenant_id", "domain", "day", "source_id")


JSONL_SQL = f"""{with_tables("publications")} SELECT publication_id, concat('{{"tenant_id":"', tenant_id, '","domain":"', domain, '","day":"', strftime(published_at, '%Y-%m-%d'), '","source_id":', source_id, '}}') AS line FROM publications"""


def access_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "signup"))
    return gov.page(e.select("event_id", "user_id", "event_type"), 100, (5000,), "event_id")


ACCESS_SQL = "SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('error', 'signup') AND event_id < 5000 ORDER BY event_id DESC LIMIT 101"


def projection_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = derived(spark, sf_dir, "edges").where("is_active")
    nodes = e.select("tenant_id", F.explode(F.array("subject_id", "object_id")).alias("v")).groupBy("tenant_id").agg(F.count_distinct("v").alias("n_nodes"))
    return e.groupBy("tenant_id").agg(F.count_distinct("edge_id").alias("n_edges")).join(nodes, "tenant_id")


TOTALS_SQL = f"{with_tables('edges')}, e AS (SELECT * FROM edges WHERE is_active) SELECT tenant_id, count(DISTINCT edge_id)::BIGINT AS n_edges, (SELECT count(DISTINCT v) FROM (SELECT tenant_id AS t, subject_id AS v FROM e UNION ALL SELECT tenant_id, object_id FROM e) WHERE t = e.tenant_id)::BIGINT AS n_nodes FROM e GROUP BY tenant_id"

QUERIES = {
    "hierarchy_units": (hierarchy_units, UNITS_SQL), "dictionary_load": (dictionary_load, DICT_LOAD_SQL), "manifest_verify": (manifest_verify, MANIFEST_SQL), "dedup_keys": (dedup_keys, KEYS_SQL), "candidate_read": (candidate_read, READ_SQL),
    "cache_probe": (cache_probe, PROBE_SQL), "retention_sweep": (retention_sweep, SWEEP_SQL), "jsonl_export": (jsonl_export, JSONL_SQL), "access_events": (access_events, ACCESS_SQL), "projection_totals": (projection_totals, TOTALS_SQL),
}
