"""Queries of the lifecycle family, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.operators import knowledge as kn
from redactory.operators import lifecycle as lc
from redactory.plans.governed import CURRENT, load, now
from redactory.sources.derived import NOW, derived, with_tables
from redactory.sources.tables import table

SCOPE = "tenant_id, domain, source_id, version"


def confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.confirmations(*load(spark, sf_dir, "confirms", "sources", "governance"), now())


def governance_confirm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confirmed(spark, sf_dir)


CONFIRMED = f"""{CURRENT}, x AS (SELECT *, row_number() OVER (PARTITION BY {SCOPE} ORDER BY command_id) AS i FROM confirms),
done AS (SELECT x.command_id, c.governance_id AS in_force, CASE WHEN x.valid_until <= {NOW} THEN 'VALIDITY_OVER' WHEN s.source_id IS NULL THEN 'SOURCE_NOT_FOUND' WHEN s.withdrawn THEN 'SOURCE_WITHDRAWN' WHEN s.retention_until <= {NOW} THEN 'SOURCE_EXPIRED'
    WHEN x.valid_until > s.retention_until THEN 'VALIDITY_EXCEEDS_SOURCE' WHEN c.governance_id IS DISTINCT FROM x.expected OR x.i > 1 THEN 'VERSION_CONFLICT' END AS code
    FROM x LEFT JOIN sources s USING ({SCOPE}) LEFT JOIN cur c USING ({SCOPE}))"""
CONFIRM_SQL = f"{with_tables('confirms', 'sources', 'governance')}, {CONFIRMED} SELECT command_id, code, CASE WHEN code IS NULL THEN in_force END AS superseded FROM done"


def governance_superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.superseded_publications(confirmed(spark, sf_dir), *load(spark, sf_dir, "bindings", "publications", "tombstones"))


SUPERSEDED_SQL = f"""{with_tables("confirms", "sources", "governance", "bindings", "publications", "tombstones")}, {CONFIRMED}
SELECT DISTINCT publication_id, governance_id FROM bindings WHERE governance_id IN (SELECT in_force FROM done WHERE code IS NULL) AND publication_id IN (SELECT publication_id FROM publications) AND publication_id NOT IN (SELECT publication_id FROM tombstones)"""


def candidate_revise(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lc.revisions(*load(spark, sf_dir, "revises", "candidates", "evidence", "sources"))
    return r.select("command_id", "code", "candidate_version", F.array_join("acl", ",").alias("acl"), "purpose")


REVISE_SQL = f"""{with_tables("revises", "candidates", "evidence", "sources")}, n AS (SELECT r.command_id, r.candidate_id, c.candidate_version, coalesce(r.acl, c.acl) AS acl, coalesce(r.purpose, c.purpose) AS purpose FROM revises r LEFT JOIN candidates c USING (candidate_id)),
o AS (SELECT command_id, bool_or(NOT list_has_all(s.acl, n.acl) OR s.purpose <> n.purpose) AS outside FROM n JOIN evidence e USING (candidate_id) JOIN sources s USING ({SCOPE}) GROUP BY 1)
SELECT command_id, CASE WHEN candidate_version IS NULL THEN 'CANDIDATE_NOT_FOUND' WHEN coalesce(len(acl), 0) = 0 OR list_contains(list_transform(acl, lambda a: trim(a)), '') OR coalesce(trim(purpose), '') = '' THEN 'EMPTY' WHEN coalesce(outside, false) THEN 'EXCEEDS_SOURCES' END AS code,
    candidate_version + 1 AS candidate_version, array_to_string(acl, ',') AS acl, purpose FROM n LEFT JOIN o USING (command_id)"""


def taken_down(spark: SparkSession, sf_dir: str, gone: DataFrame) -> DataFrame:
    """Per domain: new tombstones, revoked events, and assets that are left active."""
    e, p, t, a = load(spark, sf_dir, "evidence", "publications", "tombstones", "assets")
    dead, events, assets = lc.invalidations(lc.resting_on(gone, e, p).select("publication_id", "reason"), p, t, a)
    n = lambda df, name: df.groupBy("domain").agg(F.count("*").alias(name))
    return n(dead, "n_tombstones").join(n(events, "n_events"), "domain", "full").join(n(assets.where("active"), "n_active"), "domain", "full")


def source_withdraw(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lc.withdrawals(*load(spark, sf_dir, "withdraws", "sources"))
    return taken_down(spark, sf_dir, done.where("code IS NULL").withColumn("reason", F.lit("withdrawn")))


def withdraw_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.withdrawals(*load(spark, sf_dir, "withdraws", "sources")).select("command_id", "code")


WITHDRAWN = f"""w AS (SELECT x.*, CASE WHEN s.source_id IS NULL THEN 'SOURCE_NOT_FOUND' WHEN s.withdrawn OR x.i > 1 THEN 'SOURCE_WITHDRAWN' END AS code FROM (SELECT *, row_number() OVER (PARTITION BY {SCOPE} ORDER BY command_id) AS i FROM withdraws) x LEFT JOIN sources s USING ({SCOPE}))"""
WITHDRAW_CODES_SQL = f"{with_tables('withdraws', 'sources')}, {WITHDRAWN} SELECT command_id, code FROM w"
TAKEN = f"""hit AS (SELECT DISTINCT publication_id FROM publications JOIN evidence USING (candidate_id) JOIN gone ON gone.tenant_id = evidence.tenant_id AND gone.domain = evidence.domain AND gone.source_id = evidence.source_id AND gone.version = evidence.version),
dead AS (SELECT domain, count(*)::BIGINT AS n FROM publications WHERE publication_id IN (SELECT publication_id FROM hit) AND publication_id NOT IN (SELECT publication_id FROM tombstones) GROUP BY 1),
act AS (SELECT domain, count(*)::BIGINT AS n FROM assets WHERE active AND publication_id NOT IN (SELECT publication_id FROM hit) GROUP BY 1)
SELECT domain, dead.n AS n_tombstones, dead.n AS n_events, act.n AS n_active FROM dead FULL JOIN act USING (domain)"""
WITHDRAW_SQL = f"{with_tables('withdraws', 'sources', 'evidence', 'publications', 'tombstones', 'assets')}, {WITHDRAWN}, gone AS (SELECT {SCOPE} FROM w WHERE code IS NULL), {TAKEN}"


def expiry_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_down(spark, sf_dir, lc.due(derived(spark, sf_dir, "sources"), now()))


EXPIRY_SQL = f"{with_tables('sources', 'evidence', 'publications', 'tombstones', 'assets')}, gone AS (SELECT {SCOPE} FROM sources WHERE retention_until <= {NOW} AND NOT withdrawn), {TAKEN}"


def evidence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = lc.time_windows(*load(spark, sf_dir, "evidence", "sources"))
    return w.select("candidate_id", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("window_start", "window_end")])


WINDOWS_SQL = f"{with_tables('evidence', 'sources')} SELECT candidate_id, strftime(min(observed_at), '%Y-%m-%d') AS window_start, strftime(max(retention_until), '%Y-%m-%d') AS window_end FROM evidence JOIN sources USING ({SCOPE}) GROUP BY 1"


def evidence_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.evidence_payload(derived(spark, sf_dir, "evidence"), "char_end", "version")


PAYLOAD_SQL = f"""{with_tables("evidence")} SELECT candidate_id, concat('[', string_agg(concat('{{"source_id":', source_id, ',"char_start":', char_start, ',"char_end":', char_end, ',"version":', version, '}}'), ',' ORDER BY source_id, char_start, char_end, version), ']') AS payload FROM evidence GROUP BY 1"""


def consumer_publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.consumable(*load(spark, sf_dir, "assets", "publications", "tombstones"), "graph", now()).select("publication_id", "domain")


CONSUMABLE_SQL = f"{with_tables('assets', 'publications', 'tombstones')} SELECT p.publication_id, p.domain FROM assets a JOIN publications p USING (tenant_id, domain, publication_id) WHERE consumer_id = 'graph' AND active AND valid_until > {NOW} AND NOT EXISTS (SELECT 1 FROM tombstones t WHERE t.publication_id = p.publication_id)"


def projection_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lc.published_edges(*load(spark, sf_dir, "publications", "claims", "entities", "tombstones"), now())
    return e.select("edge_id", "tenant_id", "domain", "predicate", "subject_name", "subject_type", "object_name", "object_type")


REBUILD_SQL = f"""{with_tables("publications", "claims", "entities", "tombstones")} SELECT p.publication_id AS edge_id, tenant_id, p.domain, predicate, s.name AS subject_name, s.entity_type AS subject_type, o.name AS object_name, o.entity_type AS object_type
FROM publications p JOIN claims c ON c.claim_id = p.candidate_id JOIN entities s ON s.entity_id = subject_id JOIN entities o ON o.entity_id = object_id WHERE valid_until > {NOW} AND p.publication_id NOT IN (SELECT publication_id FROM tombstones)"""


def projection_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph that holds half of the publications, some of them revoked, brought up to date by the outbox."""
    edges, outbox = load(spark, sf_dir, "edges", "outbox")
    held = edges.where("edge_id % 2 = 0").select("edge_id", F.lit(True).alias("is_active"))
    return lc.projected(held, outbox.where("publication_id % 7 <> 0").withColumn("order", F.col("outbox_id")))


SYNC_SQL = f"""{with_tables("edges", "outbox")}, l AS (SELECT publication_id AS edge_id, arg_max(event_type, outbox_id) AS last FROM outbox WHERE publication_id % 7 <> 0 GROUP BY 1), h AS (SELECT edge_id FROM edges WHERE edge_id % 2 = 0)
SELECT edge_id, CASE WHEN last IS NULL THEN true ELSE last = 'published' END AS is_active FROM h FULL JOIN l USING (edge_id)"""


def disputed_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, claims = load(spark, sf_dir, "candidates", "claims")
    found = kn.conflicts(claims.select("claim_id", "subject_id", "object_id", "predicate", "polarity", "window_start", "window_end"), {})
    return lc.disputed(c, found).select("candidate_id", "state", "reason")


DISPUTED_SQL = f"""{with_tables("candidates", "claims")}, x AS (SELECT a.claim_id, min(b.claim_id) AS other FROM claims a JOIN claims b ON a.subject_id = b.subject_id AND a.object_id = b.object_id AND a.predicate = b.predicate AND a.polarity <> b.polarity AND a.window_start <= b.window_end AND b.window_start <= a.window_end GROUP BY 1)
SELECT candidate_id, CASE WHEN other IS NULL THEN state ELSE 'disputed' END AS state, 'DISPUTED: ' || other AS reason FROM candidates LEFT JOIN x ON x.claim_id = candidate_id"""

EDITS = """SELECT o_custkey % 20 AS scope, row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) AS revision, o_orderkey % 97 AS entry_id, CASE WHEN o_orderkey % 13 = 0 THEN 'delete' ELSE 'update' END AS action,
    concat('word', CAST(o_orderkey % 97 AS STRING), '-', CAST(o_orderkey % 4 AS STRING)) AS text, CASE WHEN o_orderkey % 2 = 0 THEN 'ORG' ELSE 'PERSON' END AS entity_type, o_orderkey % 5 <> 0 AS enabled FROM {orders}"""


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EDITS, orders=table(spark, sf_dir, "orders"))


def dictionary_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.edited(edits(spark, sf_dir))


EDITS_SQL = EDITS.replace("{orders}", "orders")
EDIT_SQL = f"SELECT * EXCLUDE (n, action) FROM (SELECT *, row_number() OVER (PARTITION BY scope, entry_id ORDER BY revision DESC) AS n FROM ({EDITS_SQL})) WHERE n = 1 AND action <> 'delete'"


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edits(spark, sf_dir)
    return lc.snapshots(e, e.where("revision % 40 = 0").select("scope", "revision"))


def dictionary_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shots(spark, sf_dir)


SHOTS = f"""e AS (SELECT *, lead(revision) OVER (PARTITION BY scope, entry_id ORDER BY revision) AS until FROM ({EDITS_SQL})),
s AS (SELECT e.scope, p.revision, count(*)::BIGINT AS n_entries, sha256(concat('[', string_agg(concat('{{"text":"', text, '","entity_type":"', entity_type, '"}}'), ',' ORDER BY text, entity_type), ']')) AS sha256 FROM e JOIN (SELECT scope, revision FROM e WHERE revision % 40 = 0) p ON p.scope = e.scope AND e.revision <= p.revision AND (until IS NULL OR until > p.revision)
    WHERE action <> 'delete' AND enabled GROUP BY 1, 2)"""
SHOTS_SQL = f"WITH {SHOTS} SELECT scope, revision, n_entries, sha256 FROM s"


def dictionary_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of the last revisions of each scope."""
    return lc.newest(edits(spark, sf_dir), "scope", "revision", 50).select("scope", "revision", F.col("place").cast("int").alias("place"))


REVISIONS_SQL = f"SELECT scope, revision, place::INT AS place FROM (SELECT scope, revision, row_number() OVER (PARTITION BY scope ORDER BY revision DESC) AS place FROM ({EDITS_SQL})) WHERE place <= 50"


def catalog_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), (F.col("o_custkey") % 3).alias("domain"), F.lit(1).alias("version"))
    evidence = o.where("record_id % 7 <> 0").withColumn("domain", F.when(F.col("record_id") % 11 == 0, 9).otherwise(F.col("domain")))
    return lc.backlog(o, evidence, o.where("record_id % 5 < 3").select("record_id")).groupBy("domain").agg(F.count("*").alias("n"), F.sum("record_id").alias("id_sum"))


BACKLOG_SQL = "SELECT o_custkey % 3 AS domain, count(*)::BIGINT AS n, sum(o_orderkey)::BIGINT AS id_sum FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 5 >= 3 GROUP BY 1"


def spool_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return lc.spool_usage(d.select(F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 9 == 0, ".gap.json").when(F.col("doc_id") % 9 == 1, ".tmp").otherwise(".env.json")).alias("name"), F.octet_length("text").alias("length")))


USAGE_SQL = "SELECT sum(strlen(text))::BIGINT AS total_bytes, count(*) FILTER (doc_id % 9 <> 0)::BIGINT AS n_events, count(*) FILTER (doc_id % 9 = 0)::BIGINT AS n_gaps FROM documents"

COLLECTED = "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'required' ELSE 'optional' END AS mode, CASE event_id % 6 WHEN 1 THEN 'SPOOL_FULL' WHEN 2 THEN 'INVALID' WHEN 4 THEN 'KMS_UNAVAILABLE' END AS fault FROM {events}"


def gap_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.collected(spark.sql(COLLECTED, events=table(spark, sf_dir, "events"))).select("event_id", "outcome")


GAP_SQL = f"SELECT event_id, CASE WHEN fault IS NULL THEN 'stored' WHEN mode = 'optional' AND fault <> 'INVALID' THEN 'gap' ELSE 'failed' END AS outcome FROM ({COLLECTED.replace('{events}', 'events')})"

POLICIES = "SELECT o_custkey AS policy, CASE WHEN o_orderkey % 101 = 0 THEN ' ' ELSE concat('c', CAST(o_orderkey % 37 AS STRING)) END AS category, CASE WHEN o_orderkey % 43 = 0 THEN 'open' WHEN o_orderkey % 2 = 0 THEN 'approved_external' ELSE 'internal_only' END AS label FROM {orders}"


def policy_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.policy_faults(spark.sql(POLICIES, orders=table(spark, sf_dir, "orders")), ("approved_external", "internal_only"))


POLICY_SQL = f"""WITH p AS ({POLICIES.replace("{orders}", "orders")}), c AS (SELECT policy, category, count(*) AS n FROM p GROUP BY ALL)
SELECT policy, CASE WHEN bool_or(trim(category) = '') THEN 'CATEGORY_EMPTY' WHEN (SELECT max(n) FROM c WHERE c.policy = p.policy) > 1 THEN 'CATEGORY_REPEATED' WHEN bool_or(label = 'open') THEN 'LABEL_UNKNOWN' END AS code FROM p GROUP BY policy"""


def error_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", lc.sanitized((F.col("event_id") % 700).cast("int")).alias("s"))
    return e.groupBy("s.status", "s.code").agg(F.count("*").alias("n"), F.sum("event_id").alias("id_sum"))


ERROR_SQL = """WITH e AS (SELECT event_id, CASE WHEN event_id % 700 BETWEEN 400 AND 599 THEN event_id % 700 ELSE 502 END::INT AS status FROM events)
SELECT status, CASE status WHEN 400 THEN 'UPSTREAM_BAD_REQUEST' WHEN 401 THEN 'UPSTREAM_AUTH_FAILURE' WHEN 403 THEN 'UPSTREAM_ACCESS_DENIED' WHEN 404 THEN 'UPSTREAM_NOT_FOUND' WHEN 408 THEN 'UPSTREAM_TIMEOUT' WHEN 413 THEN 'UPSTREAM_PAYLOAD_TOO_LARGE' WHEN 429 THEN 'UPSTREAM_RATE_LIMITED'
    WHEN 500 THEN 'UPSTREAM_INTERNAL_ERROR' WHEN 502 THEN 'UPSTREAM_BAD_GATEWAY' WHEN 503 THEN 'UPSTREAM_SERVICE_UNAVAILABLE' WHEN 504 THEN 'UPSTREAM_GATEWAY_TIMEOUT' ELSE 'UPSTREAM_FAILURE' END AS code, count(*)::BIGINT AS n, sum(event_id)::BIGINT AS id_sum FROM e GROUP BY ALL"""


def model_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.concat(F.lit("m-"), (F.col("o_custkey") % 6).cast("string")).alias("model"))
    pipelines = spark.createDataFrame([("m-0", "chat"), ("m-1", "chat"), ("m-2", "messages"), ("m-4", "messages")], "model string, pipeline string")
    return lc.routed(requests, pipelines).select("request_id", "pipeline", "code")


ROUTE_SQL = "SELECT o_orderkey AS request_id, CASE o_custkey % 6 WHEN 0 THEN 'chat' WHEN 1 THEN 'chat' WHEN 2 THEN 'messages' WHEN 4 THEN 'messages' END AS pipeline, CASE WHEN o_custkey % 6 IN (3, 5) THEN 'MODEL_NOT_ADMITTED' END AS code FROM orders"


def history_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"))
    written = o.select("request_id", F.posexplode(F.array(*map(F.lit, lc.STAGES))).alias("i", "stage")).where("request_id % 5 > i").select("request_id", "stage", F.lit("stored").alias("state"), F.md5(F.concat_ws("/", F.col("request_id").cast("string"), "stage")).alias("digest"))
    return lc.staged(o.select("request_id"), written).groupBy("place", "stage", "state").agg(F.count("*").alias("n"), F.count("digest").alias("n_digests"), F.max("digest").alias("last_digest"))


STAGES_SQL = """WITH s AS (SELECT o_orderkey AS r, unnest(range(0, 4))::INT AS place FROM orders), t AS (SELECT *, ['input', 'redacted', 'upstream', 'restored'][place + 1] AS stage, r % 5 > place AS w FROM s)
SELECT place, stage, CASE WHEN w THEN 'stored' ELSE 'not_produced' END AS state, count(*)::BIGINT AS n, count(*) FILTER (w)::BIGINT AS n_digests, max(CASE WHEN w THEN md5(concat_ws('/', r, stage)) END) AS last_digest FROM t GROUP BY ALL"""

ENDS = "SELECT user_id AS request_id, CASE event_type WHEN 'view' THEN 'completed' WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'blocked' END AS status, event_id AS moment FROM {events}"


def history_finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.finished(spark.sql(ENDS, events=table(spark, sf_dir, "events")))


FINISH_SQL = f"SELECT request_id, arg_min(status, moment) AS status FROM ({ENDS.replace('{events}', 'events')}) WHERE status <> 'running' GROUP BY 1"


def history_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.expr("o_orderdate + INTERVAL 365 DAYS").alias("expires_at"))
    return lc.unexpired(rows, now()).select("request_id")


PURGE_SQL = f"SELECT o_orderkey AS request_id FROM orders WHERE o_orderdate + INTERVAL 365 DAYS > {NOW}"

QUERIES = {
    "governance_confirm": (governance_confirm, CONFIRM_SQL), "governance_superseded": (governance_superseded, SUPERSEDED_SQL), "candidate_revise": (candidate_revise, REVISE_SQL), "source_withdraw": (source_withdraw, WITHDRAW_SQL), "withdraw_codes": (withdraw_codes, WITHDRAW_CODES_SQL),
    "expiry_cascade": (expiry_cascade, EXPIRY_SQL), "evidence_windows": (evidence_windows, WINDOWS_SQL), "evidence_json": (evidence_json, PAYLOAD_SQL), "consumer_publications": (consumer_publications, CONSUMABLE_SQL), "projection_rebuild": (projection_rebuild, REBUILD_SQL),
    "projection_sync": (projection_sync, SYNC_SQL), "disputed_tag": (disputed_tag, DISPUTED_SQL), "dictionary_edit": (dictionary_edit, EDIT_SQL), "dictionary_snapshots": (dictionary_snapshots, SHOTS_SQL), "dictionary_revisions": (dictionary_revisions, REVISIONS_SQL),
    "catalog_backlog": (catalog_backlog, BACKLOG_SQL), "spool_usage": (spool_usage, USAGE_SQL), "gap_records": (gap_records, GAP_SQL), "policy_load": (policy_load, POLICY_SQL), "error_map": (error_map, ERROR_SQL), "model_route": (model_route, ROUTE_SQL),
    "history_stages": (history_stages, STAGES_SQL), "history_finish": (history_finish, FINISH_SQL), "history_purge": (history_purge, PURGE_SQL),
}
