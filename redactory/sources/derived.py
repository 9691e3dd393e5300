"""Governed tables made from the sample star schema, in SQL that Spark and the oracle both run.

Each is a SELECT over the sample's tables or earlier entries. {array} stands for
the array constructor, {table} for a sample table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from redactory.sources.tables import once, table

#: The instant at which validity is judged.
NOW = "TIMESTAMP '1999-06-01 00:00:00'"

TABLES: dict[str, str] = {
    "sources": """SELECT concat('t', CAST(o_custkey % 3 AS STRING)) AS tenant_id, concat('d', CAST(o_custkey % 5 AS STRING)) AS domain, o_orderkey AS source_id, 1 AS version,
        CASE o_orderkey % 5 WHEN 0 THEN 'master_data' WHEN 1 THEN 'document' WHEN 2 THEN 'trusted_tool' WHEN 3 THEN 'conversation' ELSE 'model_output' END AS source_kind,
        CASE WHEN o_orderkey % 4 = 0 THEN {array}('g1', 'g2') WHEN o_orderkey % 4 = 1 THEN {array}('g2', 'g3') WHEN o_orderkey % 4 = 2 THEN {array}('g1', 'g2', 'g3') ELSE {array}('g4') END AS acl,
        o_orderpriority AS purpose, o_orderdate AS observed_at,
        CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 400 DAYS ELSE o_orderdate + INTERVAL 1500 DAYS END AS retention_until,
        o_orderkey % 7 <> 0 AS independence_verified, o_orderstatus = 'F' AND o_orderkey % 2 = 0 AS withdrawn FROM {orders}""",
    "entities": """SELECT concat('S', CAST(s_suppkey AS STRING)) AS entity_id, s_name AS name, CASE WHEN s_nationkey % 4 = 0 THEN 'PERSON' ELSE 'ORG' END AS entity_type FROM {supplier}
        UNION ALL SELECT concat('P', CAST(p_partkey AS STRING)), p_name, CASE WHEN p_size % 3 = 0 THEN 'PRODUCT' ELSE 'ITEM' END FROM {part}""",
    "claims": """SELECT l_orderkey * 10 + l_linenumber AS claim_id, l_orderkey AS source_id, concat('S', CAST(l_suppkey AS STRING)) AS subject_id, concat('P', CAST(l_partkey AS STRING)) AS object_id,
        CASE l_returnflag WHEN 'A' THEN 'supplies' WHEN 'N' THEN 'owns' ELSE 'partners_with' END AS predicate,
        CASE WHEN l_linestatus = 'O' THEN 'positive' ELSE 'negative' END AS polarity, l_shipdate AS window_start, l_shipdate + INTERVAL 200 DAYS AS window_end, CAST(l_quantity AS INT) AS char_start
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_shipdate, l_returnflag, l_linestatus) AS rn FROM {lineitem}) AS l WHERE rn = 1""",
    "evidence": """SELECT candidate_id, tenant_id, domain, e.source_id, CASE WHEN candidate_id % 17 = 0 AND e.own = 0 THEN 2 ELSE version END AS version, char_start, char_end
        FROM (SELECT claim_id AS candidate_id, source_id, 1 AS own, char_start, char_start + 10 AS char_end FROM claims UNION ALL SELECT claim_id, source_id + 1, 0, char_start, char_start + 7 FROM claims WHERE claim_id % 3 = 0) AS e
        JOIN sources AS s ON s.source_id = e.source_id""",
    "governance": """SELECT source_id * 10 + 1 AS governance_id, tenant_id, domain, source_id, version, CAST(NULL AS BIGINT) AS supersedes_id, observed_at AS valid_from, observed_at + INTERVAL 900 DAYS AS valid_until,
        CASE WHEN source_id % 5 = 0 THEN {array}('search') ELSE {array}('search', 'chat') END AS audiences, 'approved' AS state FROM sources
        UNION ALL SELECT source_id * 10 + 2, tenant_id, domain, source_id, version, source_id * 10 + 1, observed_at + INTERVAL 100 DAYS, observed_at + INTERVAL 2000 DAYS, {array}('chat', 'graph'), CASE WHEN source_id % 6 = 0 THEN 'rejected' ELSE 'approved' END FROM sources WHERE source_id % 2 = 0""",
    "publications": """SELECT claim_id AS publication_id, claim_id AS candidate_id, tenant_id, domain, c.source_id, window_start AS published_at, window_start + INTERVAL 1200 DAYS AS valid_until
        FROM claims c JOIN sources s ON c.source_id = s.source_id WHERE claim_id % 10 <= 2""",
    "consumers": "SELECT consumer_id FROM (VALUES ('chat'), ('graph'), ('search')) AS v(consumer_id)",
    "bindings": """SELECT p.publication_id, e.tenant_id, e.domain, e.source_id, e.version, e.source_id * 10 + CASE WHEN e.source_id % 2 = 0 AND p.publication_id % 3 = 0 THEN 2 ELSE 1 END AS governance_id
        FROM (SELECT DISTINCT candidate_id, tenant_id, domain, source_id, version FROM evidence) AS e JOIN publications p ON p.candidate_id = e.candidate_id""",
    "assets": "SELECT p.publication_id, tenant_id, domain, consumer_id, (publication_id + length(consumer_id)) % 5 <> 0 AS active FROM publications AS p JOIN consumers ON true",
    "tombstones": "SELECT publication_id, published_at + INTERVAL 30 DAYS AS revoked_at FROM publications WHERE publication_id % 11 = 0",
    "outbox": """SELECT publication_id * 2 AS outbox_id, publication_id, tenant_id, domain, 'published' AS event_type, published_at AS created_at FROM publications
        UNION ALL SELECT p.publication_id * 2 + 1, p.publication_id, tenant_id, domain, 'revoked', revoked_at FROM publications p JOIN tombstones t ON p.publication_id = t.publication_id""",
    "receipts": """SELECT consumer_id, outbox_id, created_at + INTERVAL 1 DAYS AS received_at, CASE WHEN outbox_id % 13 = 0 THEN 'timeout' END AS error
        FROM outbox JOIN consumers ON true WHERE (outbox_id + length(consumer_id)) % 4 <> 0""",
    "candidates": """SELECT claim_id AS candidate_id, c.source_id, acl, purpose, 1 + claim_id % 3 AS candidate_version, CASE WHEN claim_id % 5 = 0 THEN 'rejected' ELSE 'proposed' END AS state FROM claims c JOIN sources s ON c.source_id = s.source_id""",
    "confirms": """SELECT source_id * 10 + 5 AS command_id, tenant_id, domain, CASE WHEN source_id % 31 = 0 THEN -source_id ELSE source_id END AS source_id, version, source_id * 10 + CASE WHEN source_id % 2 = 0 AND source_id % 3 <> 1 THEN 2 ELSE 1 END AS expected,
        CASE source_id % 5 WHEN 0 THEN TIMESTAMP '1999-05-31 00:00:00' WHEN 1 THEN retention_until + INTERVAL 1 DAYS ELSE TIMESTAMP '1999-07-01 00:00:00' END AS valid_until FROM sources
        UNION ALL SELECT source_id * 10 + 6, tenant_id, domain, source_id, version, source_id * 10 + 1, TIMESTAMP '1999-06-20 00:00:00' FROM sources WHERE source_id % 6 = 1""",
    "revises": """SELECT candidate_id * 10 AS command_id, CASE WHEN candidate_id % 23 = 0 THEN -candidate_id ELSE candidate_id END AS candidate_id, CASE candidate_id % 4 WHEN 0 THEN {array}('g1') WHEN 1 THEN {array}('g2') WHEN 2 THEN {array}(' ') END AS acl,
        CASE candidate_id % 7 WHEN 0 THEN '5-LOW' WHEN 1 THEN '' END AS purpose FROM candidates""",
    "withdraws": """SELECT source_id AS command_id, CASE WHEN source_id % 27 = 0 THEN concat(tenant_id, 'x') ELSE tenant_id END AS tenant_id, domain, source_id, version FROM sources WHERE source_id % 3 = 0
        UNION ALL SELECT source_id + 1000000000, tenant_id, domain, source_id, version FROM sources WHERE source_id % 12 = 0""",
    "edges": """SELECT p.publication_id AS edge_id, tenant_id, domain, subject_id, object_id, predicate, p.publication_id % 11 <> 0 AS is_active, valid_until FROM publications p JOIN claims c ON c.claim_id = p.candidate_id""",
}


def _needs(name: str) -> list[str]:
    """name and the entries below it, in order."""
    found: set[str] = set()

    def add(n: str) -> None:
        if n not in found:
            found.add(n)
            for other in TABLES:
                if other != n and re.search(rf"(FROM|JOIN|,) {other}\b", TABLES[n]):
                    add(other)

    add(name)
    return [n for n in TABLES if n in found]


#: Entries that join or number rows; they are made once per application and stored.
STORED = frozenset({"claims", "candidates", "evidence", "bindings", "publications", "tombstones", "outbox", "receipts", "edges"})


def derived(spark: SparkSession, sf_dir: str, name: str, inline: frozenset[str] = frozenset()) -> DataFrame:
    """The entry, over the stored entries below it. inline: entries that are not stored, for a query that reads them once and filters them; its filter then reaches what they are made of."""
    if name in STORED - inline:
        return once(spark, (sf_dir, name), lambda: _made_of(spark, sf_dir, name))
    return _made_of(spark, sf_dir, name, inline)


def _made_of(spark: SparkSession, sf_dir: str, name: str, inline: frozenset[str] = frozenset()) -> DataFrame:
    parts = {n: derived(spark, sf_dir, n, inline) for n in _needs(name) if n != name and re.search(rf"(FROM|JOIN|,) {n}\b", TABLES[name])}
    text = re.sub(rf"(FROM|JOIN|,) ({'|'.join(parts) or '-'})\b", r"\1 {\2}", TABLES[name])
    base = set(re.findall(r"\{(\w+)\}", text)) - {"array"} - parts.keys()
    return spark.sql(text.replace("{array}", "array"), **parts, **{t: table(spark, sf_dir, t) for t in base})


def with_tables(*names: str) -> str:
    """The WITH clause that gives the oracle the same tables."""
    needed = [n for n in TABLES if any(n in _needs(x) for x in names)]
    text = "WITH " + ",\n".join(f"{n} AS ({TABLES[n]})" for n in needed)
    return re.sub(r"\{(\w+)\}", lambda m: "list_value" if m[1] == "array" else m[1], text)
