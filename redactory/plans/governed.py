"""Queries of the governed-knowledge and graph families, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.functions import checks
from redactory.operators import chains as ch
from redactory.operators import governance as gov
from redactory.operators import knowledge as kn
from redactory.sources.derived import NOW, derived, with_tables
from redactory.sources.tables import Actor, over, scoped, table

def now():
    return F.expr(NOW)



def load(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [derived(spark, sf_dir, n) for n in names]


ACTOR = Actor("t1", "d1", ("g1", "g4"), ("1-URGENT", "5-LOW"))


def scoped_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoped(derived(spark, sf_dir, "sources"), ACTOR).select("source_id", "source_kind", "purpose")


SCOPED_SQL = f"{with_tables('sources')} SELECT source_id, source_kind, purpose FROM sources WHERE tenant_id = 't1' AND domain = 'd1' AND list_has_any(acl, ['g1', 'g4']) AND purpose IN ('1-URGENT', '5-LOW')"


def source_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = derived(spark, sf_dir, "sources")
    label = checks.status_label(F.col("withdrawn"), F.col("retention_until"), now())
    return s.groupBy(label.alias("status")).agg(F.count("*").alias("n"), F.count_if(gov.live(now())).alias("n_live"))


LIVENESS_SQL = f"{with_tables('sources')} SELECT CASE WHEN withdrawn THEN 'withdrawn' WHEN retention_until <= {NOW} THEN 'expired' ELSE 'active' END AS status, count(*)::BIGINT AS n, count(*) FILTER (NOT withdrawn AND observed_at <= {NOW} AND retention_until > {NOW})::BIGINT AS n_live FROM sources GROUP BY 1"


def governance_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gov.current_governance(derived(spark, sf_dir, "governance"), now()).select("tenant_id", "domain", "source_id", "governance_id", F.array_join("audiences", ",").alias("audiences"))


CURRENT = f"""cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, domain, source_id, version ORDER BY valid_from DESC, governance_id) AS rn FROM governance g
    WHERE NOT EXISTS (SELECT 1 FROM governance h WHERE h.supersedes_id = g.governance_id) AND valid_from <= {NOW} AND valid_until > {NOW} AND state = 'approved') WHERE rn = 1)"""
CURRENT_SQL = f"{with_tables('governance')}, {CURRENT} SELECT tenant_id, domain, source_id, governance_id, array_to_string(audiences, ',') AS audiences FROM cur"


def acl_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources, evidence = load(spark, sf_dir, "sources", "evidence")
    shared = gov.shared_members(gov.linked(evidence, sources), "candidate_id", "acl")
    return shared.select("candidate_id", F.array_join("shared", ",").alias("shared"), (F.size("shared") == 0).alias("is_empty"))


ACL_SQL = f"""{with_tables("sources", "evidence")}, l AS (SELECT DISTINCT candidate_id, tenant_id, domain, source_id, version FROM evidence), j AS (SELECT candidate_id, acl FROM l JOIN sources USING (tenant_id, domain, source_id, version)),
n AS (SELECT candidate_id, count(*) AS n FROM j GROUP BY 1), m AS (SELECT candidate_id, m, count(*) AS c FROM (SELECT candidate_id, unnest(acl) AS m FROM j) GROUP BY 1, 2),
s AS (SELECT candidate_id, string_agg(m, ',' ORDER BY m) AS shared FROM m JOIN n USING (candidate_id) WHERE c = n GROUP BY 1)
SELECT candidate_id, coalesce(shared, '') AS shared, shared IS NULL AS is_empty FROM n LEFT JOIN s USING (candidate_id)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "claims").select(F.col("claim_id").alias("candidate_id"))


def publish_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources, evidence, versions = load(spark, sf_dir, "sources", "evidence", "governance")
    a = gov.admission(candidates(spark, sf_dir), evidence, sources, versions, "chat", now())
    return a.select("candidate_id", "n_sources", F.array_join("reasons", ",").alias("reasons"), "first_code", "admitted", F.date_format("bound", "yyyy-MM-dd").alias("bound"))


JUDGED = f"""{CURRENT}, l AS (SELECT DISTINCT candidate_id, tenant_id, domain, source_id, version FROM evidence), ch AS (SELECT source_id, bool_or(supersedes_id IS NOT NULL) AS chained FROM governance GROUP BY 1),
j AS (SELECT l.candidate_id, s.source_kind, least(c.valid_until, s.retention_until) AS b, CASE WHEN s.withdrawn THEN 'source_withdrawn' WHEN s.retention_until <= {NOW} THEN 'source_expired' WHEN c.audiences IS NULL AND chained THEN 'governance_superseded'
    WHEN c.audiences IS NULL THEN 'governance_missing' WHEN NOT list_contains(c.audiences, 'chat') THEN 'audience_denied' END AS reason
    FROM l JOIN sources s USING (tenant_id, domain, source_id, version) LEFT JOIN cur c ON c.source_id = s.source_id LEFT JOIN ch ON ch.source_id = s.source_id),
a AS (SELECT candidate_id, count(*) AS n_sources, list_distinct(list(reason) FILTER (reason IS NOT NULL)) AS found, bool_and(source_kind = 'model_output') AS model_only, min(b) AS bound FROM j GROUP BY 1),
adm AS (SELECT claim_id AS candidate_id, coalesce(n_sources, 0)::BIGINT AS n_sources, bound, list_filter(['source_withdrawn', 'source_expired', 'governance_missing', 'governance_superseded', 'evidence_unavailable', 'audience_denied'],
    lambda r: list_contains(CASE WHEN n_sources IS NULL OR model_only THEN ['evidence_unavailable'] ELSE coalesce(found, []) END, r)) AS reasons FROM claims LEFT JOIN a ON a.candidate_id = claim_id)"""
ADMISSION_SQL = f"""{with_tables("sources", "evidence", "governance", "claims")}, {JUDGED}
SELECT candidate_id, n_sources, array_to_string(reasons, ',') AS reasons, reasons[1] AS first_code, len(reasons) = 0 AS admitted, CASE WHEN len(reasons) = 0 THEN strftime(bound, '%Y-%m-%d') END AS bound FROM adm"""


def active_publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, t = load(spark, sf_dir, "publications", "tombstones")
    return gov.active_publications(p, t, now()).groupBy("tenant_id", "domain").agg(F.count("*").alias("n"), F.max("publication_id").alias("last_id"))


ACTIVE_SQL = f"{with_tables('publications', 'tombstones')} SELECT tenant_id, domain, count(*)::BIGINT AS n, max(publication_id) AS last_id FROM publications WHERE valid_until > {NOW} AND publication_id NOT IN (SELECT publication_id FROM tombstones) GROUP BY ALL"


def evidence_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources, evidence = load(spark, sf_dir, "sources", "evidence")
    return gov.evidence_status(candidates(spark, sf_dir), evidence, sources, now())


STATUS = f"""es AS (SELECT claim_id AS candidate_id, count(e.source_id) AS n_links, CASE WHEN count(e.source_id) = 0 OR count(s.source_id) < count(e.source_id) THEN 'unknown' WHEN bool_or(s.retention_until <= {NOW}) THEN 'expired' ELSE 'available' END AS status
    FROM claims c LEFT JOIN evidence e ON e.candidate_id = c.claim_id LEFT JOIN sources s ON s.source_id = e.source_id AND s.version = e.version AND s.tenant_id = e.tenant_id AND s.domain = e.domain GROUP BY 1)"""
STATUS_SQL = f"{with_tables('claims', 'evidence', 'sources')}, {STATUS} SELECT candidate_id, n_links::BIGINT AS n_links, status FROM es"


def delivery_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gov.delivery(*load(spark, sf_dir, "publications", "outbox", "receipts", "tombstones"))


DELIVERY = """dl AS (SELECT p.publication_id, coalesce(o.pending, 0) AS pending, g.last_error, CASE WHEN t.publication_id IS NOT NULL THEN CASE WHEN len(g.assets) > 0 AND len(list_filter(g.assets, lambda x: NOT list_contains(coalesce(g.revoked, []), x))) = 0 THEN 'applied' ELSE 'invalidation_pending' END
    WHEN g.last_error IS NOT NULL THEN 'failed' WHEN o.n IS NULL THEN 'not_dispatched' WHEN o.pending > 0 THEN 'pending' WHEN g.n > 0 THEN 'applied' ELSE 'pending' END AS delivery
    FROM publications p LEFT JOIN tombstones t USING (publication_id)
    LEFT JOIN (SELECT publication_id, count(*) AS n, count(*) FILTER (NOT EXISTS (SELECT 1 FROM receipts r WHERE r.outbox_id = x.outbox_id)) AS pending FROM outbox x GROUP BY 1) o USING (publication_id)
    LEFT JOIN (SELECT publication_id, count(*) AS n, arg_max(error, (received_at, outbox_id, consumer_id)) FILTER (error IS NOT NULL) AS last_error, list_distinct(list(consumer_id)) AS assets, list_distinct(list(consumer_id) FILTER (event_type = 'revoked')) AS revoked
        FROM receipts JOIN outbox USING (outbox_id) GROUP BY 1) g USING (publication_id))"""
DELIVERY_SQL = f"{with_tables('publications', 'outbox', 'receipts', 'tombstones')}, {DELIVERY} SELECT publication_id, pending::BIGINT AS pending, last_error, delivery FROM dl"


def availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, t, e, s, g, o, r = load(spark, sf_dir, "publications", "tombstones", "evidence", "sources", "governance", "outbox", "receipts")
    a = gov.availability(candidates(spark, sf_dir), p, t, e, s, g, o, r, "chat", now())
    return a.withColumn("reasons", F.array_join("reasons", ","))


AVAILABILITY_SQL = f"""{with_tables("sources", "evidence", "governance", "claims", "publications", "tombstones", "outbox", "receipts")}, {JUDGED}, {STATUS}, {DELIVERY},
lp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY published_at DESC, publication_id DESC) AS rn FROM publications) WHERE rn = 1),
x AS (SELECT adm.candidate_id, lp.publication_id, lp.valid_until, t.publication_id IS NOT NULL AS dead, es.status, dl.delivery,
    CASE WHEN t.publication_id IS NULL THEN reasons ELSE list_concat(list_filter(reasons, lambda r: r <> 'audience_denied'), ['publication_revoked'], list_filter(reasons, lambda r: r = 'audience_denied')) END AS reasons
    FROM adm LEFT JOIN lp USING (candidate_id) LEFT JOIN tombstones t ON t.publication_id = lp.publication_id JOIN es USING (candidate_id) LEFT JOIN dl ON dl.publication_id = lp.publication_id)
SELECT candidate_id, CASE WHEN publication_id IS NOT NULL AND NOT dead THEN 'publishable' WHEN dead THEN 'superseded' ELSE 'unconfirmed' END AS governance_state, array_to_string(reasons, ',') AS reasons,
    CASE WHEN status = 'unknown' THEN 'unknown' WHEN len(reasons) > 0 OR valid_until IS NULL OR valid_until <= {NOW} THEN 'ineligible' ELSE 'eligible' END AS eligibility, status AS evidence_status, coalesce(delivery, 'not_dispatched') AS delivery FROM x"""


def source_invalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, e, p, c, t = load(spark, sf_dir, "sources", "evidence", "publications", "claims", "tombstones")
    return gov.invalidated(s.where("withdrawn"), e, p, c, t)


INVALIDATION_SQL = f"""{with_tables("sources", "evidence", "publications", "claims", "tombstones")}, h AS (SELECT DISTINCT source_id, candidate_id FROM evidence JOIN sources USING (tenant_id, domain, source_id, version) WHERE withdrawn),
p AS (SELECT * FROM publications WHERE publication_id NOT IN (SELECT publication_id FROM tombstones)), n AS (SELECT claim_id, subject_id AS e FROM claims UNION SELECT claim_id, object_id FROM claims)
SELECT h.source_id, count(DISTINCT h.candidate_id)::BIGINT AS n_candidates, count(DISTINCT p.publication_id)::BIGINT AS n_publications, count(DISTINCT n.e)::BIGINT AS n_entities
FROM h LEFT JOIN p ON p.candidate_id = h.candidate_id LEFT JOIN n ON n.claim_id = h.candidate_id GROUP BY 1"""


def outbox_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gov.unreceipted(*load(spark, sf_dir, "outbox", "consumers", "receipts"))
    return rows.groupBy("consumer_id", "event_type").agg(F.count("*").alias("n"), F.min("outbox_id").alias("first_id"))


PENDING_SQL = f"{with_tables('outbox', 'consumers', 'receipts')} SELECT c.consumer_id, o.event_type, count(*)::BIGINT AS n, min(o.outbox_id) AS first_id FROM outbox o CROSS JOIN consumers c WHERE NOT EXISTS (SELECT 1 FROM receipts r WHERE r.outbox_id = o.outbox_id AND r.consumer_id = c.consumer_id) GROUP BY ALL"


def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, "publications").withColumn("published_day", F.date_format("published_at", "yyyy-MM-dd"))
    return gov.page(rows.select("published_day", "publication_id"), 50, ("1999-06-01", 50_000), "published_day", "publication_id")


PAGE_SQL = f"{with_tables('publications')} SELECT strftime(published_at, '%Y-%m-%d') AS published_day, publication_id FROM publications WHERE (strftime(published_at, '%Y-%m-%d'), publication_id) < ('1999-06-01', 50000) ORDER BY 1 DESC, 2 DESC LIMIT 51"


def dict_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = derived(spark, sf_dir, "entities").where(F.col("name").contains("ed ") & (F.col("entity_type") == "ITEM"))
    return e.orderBy("name", "entity_id").offset(2).limit(30).select("entity_id", "name")


SEARCH_SQL = f"{with_tables('entities')} SELECT entity_id, name FROM entities WHERE contains(name, 'ed ') AND entity_type = 'ITEM' ORDER BY name, entity_id LIMIT 30 OFFSET 2"


def candidates_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, e, s = load(spark, sf_dir, "claims", "evidence", "sources")
    chosen = e.join(s.where(F.array_contains("acl", "g4") & ~F.col("withdrawn")), gov.SOURCE, "left_semi")
    return c.join(chosen, F.col("claim_id") == F.col("candidate_id"), "left_semi").groupBy("predicate", "polarity").agg(F.count("*").alias("n"))


BY_SOURCE_SQL = f"{with_tables('claims', 'evidence', 'sources')} SELECT predicate, polarity, count(*)::BIGINT AS n FROM claims WHERE EXISTS (SELECT 1 FROM evidence e JOIN sources s USING (tenant_id, domain, source_id, version) WHERE e.candidate_id = claim_id AND list_contains(acl, 'g4') AND NOT withdrawn) GROUP BY ALL"


def independent_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, s = load(spark, sf_dir, "evidence", "sources")
    ok = F.col("independence_verified") & (F.col("source_kind") != "model_output")
    counts = gov.linked(e, s).groupBy("candidate_id").agg(F.count_distinct(F.when(ok, F.col("source_id"))).alias("n_independent"))
    return counts.groupBy("n_independent").agg(F.count("*").alias("n"))


INDEPENDENT_SQL = f"{with_tables('evidence', 'sources')}, x AS (SELECT candidate_id, count(DISTINCT source_id) FILTER (independence_verified AND source_kind <> 'model_output')::BIGINT AS n_independent FROM evidence JOIN sources USING (tenant_id, domain, source_id, version) GROUP BY 1) SELECT n_independent, count(*)::BIGINT AS n FROM x GROUP BY 1"

RULES = [("supplies", ["ORG"], ["ITEM", "PRODUCT"]), ("owns", ["ORG", "PERSON"], ["ITEM"]), ("co_occurs_with", ["*"], ["*"])]


#: Claims of which some name an entity that is not there, and with attributes of right and wrong kinds.
ATTRIBUTED = """SELECT claim_id, CASE WHEN claim_id % 17 = 3 THEN 'nobody' ELSE subject_id END AS subject_id, CASE WHEN claim_id % 19 = 4 THEN 'nothing' ELSE object_id END AS object_id, predicate,
    CASE claim_id % 6 WHEN 0 THEN '{"n":1,"name":"a"}' WHEN 1 THEN '{"n":1.5}' WHEN 2 THEN '{"name":1,"other":true}' WHEN 3 THEN '{"n":null}' WHEN 4 THEN '{"share":2}' END AS props FROM {claims}"""


def schema_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, e = load(spark, sf_dir, "claims", "entities")
    rules = spark.createDataFrame(RULES, "predicate string, domain array<string>, range array<string>")
    kinds = spark.createDataFrame([(p, n, k) for p, *_ in RULES for n, k in (("n", "int"), ("name", "string"), ("share", "float"))], "predicate string, name string, kind string")
    return kn.schema_guard(over(spark, ATTRIBUTED, claims=c), e, F.broadcast(rules), kinds, "props").groupBy("predicate", "violation").agg(F.count("*").alias("n"))


GUARD_SQL = f"""{with_tables("claims", "entities")}, a AS ({ATTRIBUTED.replace("{claims}", "claims")}), w AS (SELECT a.*, s.entity_type AS st, o.entity_type AS ot, claim_id % 6 IN (1, 2) AS wrong FROM a LEFT JOIN entities s ON s.entity_id = subject_id LEFT JOIN entities o ON o.entity_id = object_id)
SELECT predicate, CASE WHEN predicate = 'partners_with' THEN 'unknown_predicate' WHEN predicate <> 'co_occurs_with' AND st IS NULL THEN 'unknown_subject' WHEN predicate <> 'co_occurs_with' AND ot IS NULL THEN 'unknown_object'
    WHEN predicate = 'supplies' AND st <> 'ORG' THEN 'domain_mismatch' WHEN predicate = 'owns' AND ot <> 'ITEM' THEN 'range_mismatch' WHEN wrong THEN 'attribute_mismatch' END AS violation, count(*)::BIGINT AS n FROM w GROUP BY ALL"""

FACTS = """SELECT l_orderkey * 10 + l_linenumber AS claim_id, CASE WHEN l_suppkey % 2 = 0 THEN concat('A', CAST(l_suppkey % 20 AS STRING)) ELSE concat('B', CAST(l_partkey % 30 AS STRING)) END AS subject_id, CASE WHEN l_suppkey % 2 = 0 THEN concat('B', CAST(l_partkey % 30 AS STRING)) ELSE concat('A', CAST(l_suppkey % 20 AS STRING)) END AS object_id,
    CASE WHEN l_suppkey % 2 = 0 THEN 'supplies' ELSE 'supplied_by' END AS predicate, CASE WHEN l_orderkey % 9 = 0 THEN 'negative' ELSE 'positive' END AS polarity, l_shipdate AS window_start, CASE WHEN l_linenumber = 5 THEN NULL ELSE l_shipdate + INTERVAL 3 DAYS END AS window_end FROM {lineitem}"""


def mutual_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = spark.sql(FACTS, lineitem=table(spark, sf_dir, "lineitem"))
    return kn.conflicts(facts, {"supplies": "supplied_by", "supplied_by": "supplies"})


EXCLUSION_SQL = f"""WITH f AS ({FACTS.replace("{lineitem}", "lineitem")}), n AS (SELECT claim_id, polarity, window_start AS a, coalesce(window_end, TIMESTAMP '9999-01-01') AS z, CASE WHEN predicate = 'supplies' THEN object_id ELSE subject_id END AS s, CASE WHEN predicate = 'supplies' THEN subject_id ELSE object_id END AS o FROM f)
SELECT x.claim_id, min(y.claim_id) AS conflicting_id FROM n x JOIN n y ON x.s = y.s AND x.o = y.o AND x.polarity <> y.polarity AND x.a <= y.z AND y.a <= x.z GROUP BY 1"""


def claim_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = load(spark, sf_dir, "claims", "sources")
    base = F.when(F.col("predicate") == "supplies", 0.85).otherwise(0.50)
    scored = c.join(s.select("source_id", "source_kind"), "source_id").select("predicate", checks.confidence(base, F.col("source_kind"), F.col("char_start") * 4).alias("score"))
    return scored.groupBy("predicate", "score").agg(F.count("*").alias("n"))


CONFIDENCE_SQL = f"""{with_tables("claims", "sources")}, b AS (SELECT predicate, source_kind, char_start * 4 AS span, CASE WHEN predicate = 'supplies' THEN 0.85 ELSE 0.5 END::DOUBLE AS base FROM claims JOIN sources USING (source_id))
SELECT predicate, round(least(1.0, greatest(0.0, CASE source_kind WHEN 'master_data' THEN least(1.0, base + 0.15) WHEN 'document' THEN least(1.0, base + 0.10) WHEN 'model_output' THEN greatest(0.1, base - 0.20) ELSE base END - CASE WHEN span > 100 THEN 0.15 ELSE 0 END)), 4)::DOUBLE AS score, count(*)::BIGINT AS n FROM b GROUP BY ALL"""

#: In two scopes chains of 1,008 links; in the third, blocks with a way of some names into a loop of 1,001.
ALIASES = """SELECT o_orderkey % 3 AS scope, concat('n', CAST(o_orderkey DIV 3 AS STRING)) AS alias, concat('n', CAST(CASE WHEN o_orderkey % 3 = 2 AND (o_orderkey DIV 3) % 1009 = 1008 THEN (o_orderkey DIV 3) - 1000 ELSE (o_orderkey DIV 3) + 1 END AS STRING)) AS canonical
FROM {orders} WHERE o_orderkey % 3 = 2 OR (o_orderkey DIV 3) % 1009 <> 0"""


def alias_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.resolve_aliases(spark.sql(ALIASES, orders=table(spark, sf_dir, "orders")), ("scope",))


ALIAS_SQL = """WITH a AS (SELECT o_orderkey % 3 AS scope, o_orderkey // 3 AS i FROM orders), x AS (SELECT *, max(i) OVER (PARTITION BY scope) + 1 AS stop, i // 1009 * 1009 + 1009 AS next FROM a),
y AS (SELECT *, scope = 2 AND next <= stop AS looped FROM x WHERE scope = 2 OR i % 1009 <> 0),
z AS (SELECT scope, i, looped, CASE WHEN looped THEN greatest(i, next - 1001) WHEN scope = 2 THEN stop ELSE least(next, stop) END AS e FROM y)
SELECT scope, concat('n', i) AS alias, concat('n', e) AS canonical, e - i AS hops, looped FROM z"""

#: Customers have a role, roles one above them, and the uppermost leads back.
MEMBERS = """SELECT DISTINCT c_nationkey % 2 AS scope, concat('u', CAST(c_custkey AS STRING)) AS member, concat('r', CAST(c_custkey % 64 AS STRING)) AS role FROM {customer}
UNION SELECT c_nationkey % 2, concat('r', CAST(c_custkey % 64 AS STRING)), concat('r', CAST(CASE WHEN c_custkey % 64 = 0 THEN 5 ELSE CAST(floor(c_custkey % 64 / 2) AS BIGINT) END AS STRING)) FROM {customer}"""


def role_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.reachable(spark.sql(MEMBERS, customer=table(spark, sf_dir, "customer")), ("scope",))


CLOSURE_SQL = f"""WITH RECURSIVE m AS ({MEMBERS.replace("{customer}", "customer")}), r AS (SELECT scope, member, role, 1 AS hops FROM m UNION SELECT r.scope, r.member, m.role, r.hops + 1 FROM r JOIN m ON r.scope = m.scope AND r.role = m.member WHERE r.hops < 16)
SELECT scope, member, role, min(hops)::BIGINT AS hops FROM r GROUP BY 1, 2, 3"""


def cooccurrence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("S"), (F.col("l_suppkey") % 25).cast("string")).alias("name"))
    return kn.cooccurrences(mentions, "l_orderkey", "name", "l_orderkey")


PAIRS_SQL = """WITH m AS (SELECT DISTINCT l_orderkey, concat('S', l_suppkey % 25) AS name FROM lineitem) SELECT a.name AS first, b.name AS second, count(*)::BIGINT AS n FROM m a JOIN m b ON a.l_orderkey = b.l_orderkey AND a.name < b.name GROUP BY ALL"""

SENTENCES = """SELECT o_orderkey AS id, concat('Acme ', CASE o_orderkey % 4 WHEN 0 THEN 'supplies' WHEN 1 THEN 'met' WHEN 2 THEN 'supplies parts, and after a very long pause of words ' ELSE 'and' END, ' ', CASE WHEN o_orderkey % 3 = 0 THEN 'Bolt' ELSE 'Core' END) AS text, 'Acme' AS s, 'Bolt' AS o, CASE WHEN o_orderkey % 5 = 0 THEN 'owned_by' ELSE 'supplies' END AS predicate FROM {orders}"""


def cooccurrence_isolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.sql(SENTENCES, orders=table(spark, sf_dir, "orders"))
    return t.select("id", kn.isolated(F.col("text"), F.col("s"), F.col("o"), F.col("predicate"), {"supplies": ("supplies", "delivers")}).alias("predicate"))


ISOLATE_SQL = f"WITH t AS ({SENTENCES.replace('{orders}', 'orders')}) SELECT id, CASE WHEN predicate = 'supplies' AND (instr(text, o) = 0 OR NOT contains(text, 'supplies')) THEN 'co_occurs_with' ELSE predicate END AS predicate FROM t"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "edges")


OPEN = f"e AS (SELECT * FROM edges WHERE tenant_id = 't1' AND domain = 'd1' AND is_active AND valid_until > {NOW}), u AS (SELECT edge_id, subject_id AS a, object_id AS b, predicate FROM e UNION ALL SELECT edge_id, object_id, subject_id, predicate FROM e)"


def graph_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kn.walk(derived(spark, sf_dir, "edges", frozenset({"edges", "publications"})), 1, "t1", "d1", now()).select("e1", "v0", "p1", "v1")


ONE_SQL = f"{with_tables('edges')}, {OPEN} SELECT edge_id AS e1, subject_id AS v0, predicate AS p1, object_id AS v1 FROM e"


def graph_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kn.walk(edges(spark, sf_dir), 2, "t1", "d1", now(), directed=False).where("p1 = 'supplies' AND v0 <> v2").select("v0", "e1", "v1", "e2", "v2")


TWO_SQL = f"{with_tables('edges')}, {OPEN} SELECT x.a AS v0, x.edge_id AS e1, x.b AS v1, y.edge_id AS e2, y.b AS v2 FROM u x JOIN u y ON x.b = y.a AND x.edge_id <> y.edge_id WHERE x.predicate = 'supplies' AND x.a <> y.b"


def graph_count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kn.walk(edges(spark, sf_dir), 2, "t1", "d1", now(), directed=False).groupBy("p1").agg(F.count_distinct("v2").alias("n_targets"), F.count("*").alias("n_walks"))


COUNT_SQL = f"{with_tables('edges')}, {OPEN} SELECT x.predicate AS p1, count(DISTINCT y.b)::BIGINT AS n_targets, count(*)::BIGINT AS n_walks FROM u x JOIN u y ON x.b = y.a AND x.edge_id <> y.edge_id GROUP BY 1"


def graph_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kn.elements(kn.walk(edges(spark, sf_dir), 2, "t1", "d1", now(), directed=False).where("p2 = 'owns'"), 2)


ELEMENTS_SQL = f"{with_tables('edges')}, {OPEN}, w AS (SELECT x.a, x.edge_id AS e1, x.b, y.edge_id AS e2, y.b AS c FROM u x JOIN u y ON x.b = y.a AND x.edge_id <> y.edge_id WHERE y.predicate = 'owns') SELECT 'node' AS kind, a AS id FROM w UNION SELECT 'node', b FROM w UNION SELECT 'node', c FROM w UNION SELECT 'edge', e1::VARCHAR FROM w UNION SELECT 'edge', e2::VARCHAR FROM w"

QUERIES = {
    "scoped_sources": (scoped_sources, SCOPED_SQL), "source_liveness": (source_liveness, LIVENESS_SQL), "governance_current": (governance_current, CURRENT_SQL), "acl_intersection": (acl_intersection, ACL_SQL),
    "publish_admission": (publish_admission, ADMISSION_SQL), "active_publications": (active_publications, ACTIVE_SQL), "evidence_status": (evidence_status, STATUS_SQL), "delivery_snapshot": (delivery_snapshot, DELIVERY_SQL),
    "availability": (availability, AVAILABILITY_SQL), "source_invalidation": (source_invalidation, INVALIDATION_SQL), "outbox_pending": (outbox_pending, PENDING_SQL), "keyset_page": (keyset_page, PAGE_SQL), "dict_search_page": (dict_search_page, SEARCH_SQL),
    "candidates_by_source": (candidates_by_source, BY_SOURCE_SQL), "independent_sources": (independent_sources, INDEPENDENT_SQL), "schema_guard": (schema_guard, GUARD_SQL), "mutual_exclusion": (mutual_exclusion, EXCLUSION_SQL),
    "claim_confidence": (claim_confidence, CONFIDENCE_SQL), "alias_resolve": (alias_resolve, ALIAS_SQL), "role_closure": (role_closure, CLOSURE_SQL), "cooccurrence_pairs": (cooccurrence_pairs, PAIRS_SQL), "cooccurrence_isolate": (cooccurrence_isolate, ISOLATE_SQL),
    "graph_one_hop": (graph_one_hop, ONE_SQL), "graph_two_hop": (graph_two_hop, TWO_SQL), "graph_count_distinct": (graph_count_distinct, COUNT_SQL), "graph_elements": (graph_elements, ELEMENTS_SQL),
}
