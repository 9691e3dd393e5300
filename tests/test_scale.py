"""Work that must grow no faster than the input: what is moved, and by how many tasks."""

import random
import re
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from redactory.functions import extraction
from redactory.functions.schemas import valid
from redactory.operators import chains, contracts, exchange, ledger, lifecycle, records, spans, toolcalls
from redactory.operators import governance as gov
from redactory.plans import governed, models, tools
from redactory.sources import documents, tables

NOW = datetime(1999, 6, 1)


class Taken:
    """Gives the function that a table would run on its batches."""

    schema = StructType([StructField("id", LongType())])

    def select(self, *_):
        return self

    def mapInArrow(self, function, _):
        return function


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_of_many_files_come_in_one_batch():
    files = pa.RecordBatch.from_pydict({"path": [f"f{i}.csv" for i in range(500)], "content": [b"a,b\nc,d\n"] * 500})
    got = list(documents.extract(Taken())(iter([files])))
    assert [b.num_rows for b in got] == [1000]
    assert got[0].column(0).to_pylist()[-1] == "f499.csv"
    assert got[0].column(2).to_pylist()[:2] == [0, 1]


def test_rounds_of_aliases_move_numbers_only(spark, monkeypatch):
    written = []
    kept = chains.stored

    def stored(df):
        out = kept(df)
        written.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(chains, "stored", stored)
    rows = [(f"n{i}", f"n{i + 1}") for i in range(64)]
    got = chains.resolve_aliases(spark.createDataFrame(rows, "alias string, canonical string")).collect()
    assert {(r.alias, r.canonical, r.hops, r.looped) for r in got} == {(f"n{i}", "n64", 64 - i, False) for i in range(64)}
    rounds = [n for columns, n in written if columns == ["id", "next", "root", "hops"]]
    assert rounds == [63, 62, 60, 56, 48, 32]
    assert sum("a" in columns for columns, _ in written) == 1


def test_unions_of_spans_are_not_grouped(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(20), a := rng.randrange(60), a + 1 + rng.randrange(9), rng.choice("XY")) for _ in range(200)]
    found = spans.envelopes(spark.createDataFrame(rows, "doc int, start int, end int, entity_type string"), "doc")
    assert "Aggregate" not in plan_of(found)
    want = set()
    for doc in range(20):
        own = []
        for kind in "XY":
            for a, b in sorted((a, b) for d, a, b, k in rows if (d, k) == (doc, kind)):
                if own and own[-1][0] == kind and a < own[-1][2]:
                    own[-1][2] = max(b, own[-1][2])
                else:
                    own.append([kind, a, b])
        want |= {(doc, k, a, b, any(k != l and a < d and c < b for l, c, d in own)) for k, a, b in own}
    assert {(r.doc, r.entity_type, r.start, r.end, r.clash) for r in found.collect()} == want


def test_labels_are_not_grouped(spark):
    labels = ["I-A", "I-A", "O", "I-A", "B-A", "I-B", "I-B", "O"]
    places = [(5, 7), (2, 9), (10, 11), (12, 13), (14, 15), (16, 20), (18, 19), (21, 22)]
    rows = [(1, i, label, *at) for i, (label, at) in enumerate(zip(labels, places, strict=True))]
    found = ledger.decode_labels(spark.createDataFrame(rows, "doc int, i int, label string, start int, end int"), "doc", "i")
    assert "Aggregate" not in plan_of(found)
    assert sorted((r.entity_type, r.start, r.end) for r in found.collect()) == [("A", 2, 9), ("A", 12, 13), ("A", 14, 15), ("B", 16, 20)]


def test_edges_of_one_hop_are_not_stored(spark):
    tables.forget(spark)
    folder = "/root/testdata/sf0.001"
    governed.graph_one_hop(spark, folder)
    assert {key[2] for key in tables._made if key[1] == folder} == {"claims"}


def evidence_of(spark, n):
    sources = spark.createDataFrame([("t", "d", i, 1, NOW + timedelta(days=9), NOW - timedelta(days=9), False, "document") for i in range(n)], "tenant_id string, domain string, source_id int, version int, retention_until timestamp, observed_at timestamp, withdrawn boolean, source_kind string")
    return sources, sources.select(F.col("source_id").alias("candidate_id"), *gov.SOURCE)


def test_swept_evidence_is_not_made_distinct(spark):
    sources, evidence = evidence_of(spark, 3)
    publications = evidence.select("candidate_id", F.col("candidate_id").alias("publication_id"))
    swept = records.expired_sweep(sources, evidence.unionByName(evidence), publications, F.lit(NOW), F.lit(NOW + timedelta(days=20)))
    assert not re.search(r"Aggregate \[tenant_id#\d+, domain#\d+, source_id#\d+, version#\d+, candidate_id", plan_of(swept))
    assert [(r.n_sources, r.n_publications) for r in swept.collect()] == [(3, 3)]


def governance_of(sources):
    return sources.select((F.col("source_id") * 10).alias("governance_id"), *gov.SOURCE, F.lit(None).cast("int").alias("supersedes_id"), F.col("observed_at").alias("valid_from"), F.col("retention_until").alias("valid_until"), F.array(F.lit("chat")).alias("audiences"), F.lit("approved").alias("state"))


def test_sources_are_judged_before_evidence_meets_them(spark, monkeypatch):
    sources, evidence = evidence_of(spark, 3)
    joined, linked = [], gov.linked
    monkeypatch.setattr(gov, "linked", lambda e, s: joined.append(set(s.columns)) or linked(e, s))
    found = gov.admission(evidence, evidence, sources, governance_of(sources), "chat", F.lit(NOW))
    assert [r.admitted for r in found.collect()] == [True] * 3
    assert joined == [{*gov.SOURCE, "reason", "by_model", "until"}]


@pytest.fixture
def plainly(spark):
    """Joins by shuffles only, as on large tables."""
    put = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in put}
    for k, v in put.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_candidates_without_a_publication_are_no_group(spark, plainly):
    sources, evidence = evidence_of(spark, 200)
    p = spark.createDataFrame([], "publication_id int, candidate_id int, published_at timestamp, valid_until timestamp")
    t = spark.createDataFrame([], "publication_id int")
    o = spark.createDataFrame([], "outbox_id int, publication_id int, event_type string")
    r = spark.createDataFrame([], "outbox_id int, consumer_id string, received_at timestamp, error string")
    found = gov.availability(evidence.select("candidate_id"), p, t, evidence, sources, governance_of(sources), o, r, "chat", F.lit(NOW))
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 200
    assert max(sizes) < 100


def test_windows_of_code_points_need_no_offsets(monkeypatch):
    rng = random.Random(4)
    texts = [None, "", *("".join(rng.choice("ab]^ \n\r。；;！!？?") if rng.random() < 0.3 else "é" for _ in range(n)) for n in (5, 40, 300))]
    want = [(i, n, a, b) for i, t in enumerate(texts) for n, (a, b) in enumerate(records.sentence_windows(t or "", [(j, j + 1) for j in range(len(t or ""))], 20, 16))]
    monkeypatch.delattr(records, "sentence_windows")
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["id", "text"])
    got = list(records.sentence_plan(Taken(), "id", "text", 20, 16)(iter([batch])))
    assert [tuple(r.values()) for b in got for r in b.to_pylist()] == want


def test_parts_of_a_batch_are_read_once():
    lists = pa.array([[1, 2], [3], [], [4, 5, 6]], pa.list_(pa.int32()))
    assert [extraction.parted(lists.slice(a, 2)) for a in (0, 1, 2)] == [[[1, 2], [3]], [[3], []], [[], [4, 5, 6]]]


def test_texts_meet_all_their_spans_at_once(spark):
    rng = random.Random(5)
    texts = [(i, "".join(rng.choice("ab \t漢") for _ in range(60))) for i in range(30)]
    found = sorted({(i, a := rng.randrange(50), a + 1 + rng.randrange(10)) for i in range(20) for _ in range(9)})
    frame = spark.createDataFrame(found, "id int, start int, end int")
    got = models.words_within(spark.createDataFrame(texts, "id int, text string"), frame, "id", "text")
    assert "regexp" not in plan_of(got)
    want = {i: (sum(k == i for k, _, _ in found), sum(len(re.findall(r"[^ \t]+", texts[i][1][a:b])) for k, a, b in found if k == i)) for i in range(20)}
    assert {r.id: (r.n_spans, r.n_words) for r in got.collect()} == want


def test_windows_hold_places_as_small_numbers(spark):
    text = "A b. C d\ne F g! h " * 5
    rows = extraction.windows_of(spark.createDataFrame([(1, text), (2, " "), (3, None), (4, "The x")], "id int, text string"), "id", "text", models.Capitals, extraction.Bounds(capacity=8, stride=6))
    assert rows.schema["starts"].dataType.simpleString() == "array<int>"
    ids, offsets = models.Capitals().tokens(text)
    want = [(n, ids[a:b], [tuple(o) for o in offsets[a:b]], b - a) for n, (a, b) in enumerate(records.sentence_windows(text, offsets, 8, 6))]
    kept = rows.collect()
    assert [(r.window_no, r.ids, list(zip(r.starts, r.ends, strict=True)), r.width) for r in kept if r.id == 1] == want
    assert [(r.id, r.ids, r.fault) for r in kept if r.id != 1] == [(4, None, "OFFSET_INVERTED")]


def test_a_schema_asks_once_for_the_kind_of_a_value(spark):
    assert str(valid(F.col("v"), tools.SCHEMA)).count("schema_of_variant") == 6  # the object, to, n by reference and by its target, tags, a tag


def test_fragments_of_calls_are_moved_once(spark):
    rows = [(1, 1, 1, "a" * 9), (1, 1, 2, ""), (1, 1, 3, "b"), (1, 2, 4, None), (2, 3, 5, "c" * 11), (2, 4, 6, "d"), (3, 5, 7, "e" * 9), (3, 6, 8, "f" * 9)]
    found = toolcalls.assembled(spark.createDataFrame(rows, "r int, c int, o int, d string"), "r", "c", "o", "d", 10, 15)
    assert "Join" not in plan_of(found)
    assert {(r.r, r.c): (r.text, r.code) for r in found.collect()} == {(1, 1): ("a" * 9 + "b", None), (1, 2): ("", None), (2, 3): (None, "CALL_TOO_LARGE"), (2, 4): ("d", None), (3, 5): ("e" * 9, None), (3, 6): (None, "REQUEST_TOO_LARGE")}


def test_calls_are_released_without_a_row_for_each_text(spark, monkeypatch):
    written = []
    kept = toolcalls.stored
    monkeypatch.setattr(toolcalls, "stored", lambda df: written.append(kept(df)) or written[-1])
    calls = spark.createDataFrame([("r", k, '{"a":["<ORG_001>","x","y"]}', None) for k in range(5)], "request string, call int, text string, code string")
    mapping = spark.createDataFrame([("r", "<ORG_001>", "A")], "request string, token string, original string")
    found = toolcalls.released(calls, calls.select("request", "call", F.lit("t").alias("name")), mapping, {"t": {}}, "request", "call")
    assert [(r.arguments, r.code) for r in found.collect()] == [('{"a":["A","x","y"]}', None)] * 5
    assert max(df.count() for df in written) == 5


def test_texts_of_a_response_meet_it_together(spark):
    rows = [(k, '{"model":"m","choices":[{"message":{"content":"<ORG_001>","reasoning_content":"%s"}}]}' % t) for k, t in enumerate(("<ORG_001> x", "<ORG_002>", "ORG_001", ""))]
    mapping = spark.createDataFrame([(k, "<ORG_001>", f"A{k}") for k in range(4)], "k int, token string, original string")
    found = exchange.restored_responses(spark.createDataFrame(rows, "k int, body string"), mapping, "k", "body", ("m",))
    assert plan_of(found).count("Join ") == 3
    assert {(r.k, r.code) for r in found.collect()} == {(0, None), (1, "UNKNOWN_TOKEN"), (2, "MALFORMED_TOKEN"), (3, None)}
    assert [r.body for r in found.where("k = 0").collect()] == ['{"model": "m", "choices": [{"message": {"content": "A0", "reasoning_content": "A0 x"}}]}']


def test_an_answer_stays_one_row(spark, monkeypatch):
    written = []
    kept = contracts.stored
    monkeypatch.setattr(contracts, "stored", lambda df: written.append(kept(df)) or written[-1])
    message = '{"content":"<ORG_001>","reasoning_content":"x","reasoning_details":[{"text":"y"},{"text":"z"}],"tool_calls":[{"function":{"name":"t","arguments":"{\\"a\\":[\\"<ORG_001>\\",\\"x\\"]}"}}]}'
    rows = [(k, "chat", '{"model":"m","choices":[{"message":%s},{"message":%s}]}' % (message, message)) for k in range(5)]
    mapping = spark.createDataFrame([(k, "<ORG_001>", "A") for k in range(5)], "k int, token string, original string")
    found = contracts.answers(spark.createDataFrame(rows, "k int, p string, b string"), mapping, "k", "b", "p", ("m",), {"t": {}})
    assert [df.count() for df in written] == [5]
    assert plan_of(found).count("Join ") == 2
    assert {r.body for r in found.collect()} == {rows[0][2].replace("<ORG_001>", "A")}


def test_answers_and_their_tokens_are_not_broadcast(spark):
    chat = '{"model":"m","choices":[{"message":{"content":"<ORG_001>"}}]}'
    rows = spark.createDataFrame([(k, "chat", chat) for k in range(5)], "k int, p string, b string")
    mapping = spark.createDataFrame([(k, "<ORG_001>", f"A{k}") for k in range(4)], "k int, token string, original string")
    calls = rows.select("k", F.lit(1).alias("c"), F.lit('{"a":"<ORG_001>"}').alias("text"), F.lit(None).cast("string").alias("code"))
    lists = rows.select("k", F.array(F.lit("<ORG_001>")).alias("texts"))
    answered = contracts.answers(rows, mapping, "k", "b", "p", ("m",), {"t": {}})
    for found in (answered, exchange.restored_responses(rows, mapping, "k", "b", ("m",)), exchange.restored_lists(lists, mapping, "k", "k", "texts"), toolcalls.released(calls, calls.select("k", "c", F.lit("t").alias("name")), mapping, {"t": {}}, "k", "c")):
        physical = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in physical and "Broadcast" not in physical
    assert {(r.k, r.body, r.code) for r in answered.collect()} == {(k, chat.replace("<ORG_001>", f"A{k}"), None) for k in range(4)} | {(4, None, "UNKNOWN_TOKEN")}


def test_detectors_are_judged_without_joins(spark):
    fragments = spark.createDataFrame([(1, "abc"), (2, "abc"), (3, "abc"), (4, "abc"), (5, None), (6, "x"), (None, "y")], "k int, text string")
    spans = "k int, start int, end int, entity_type string, priority int, source string"
    rules = spark.createDataFrame([(1, 0, 3, "A", None, "r"), (2, 0, 4, "A", 3, "r"), (2, 0, 1, "A", 3, "r"), (3, 0, 1, "A", 0, "r"), (5, 0, 1, "A", 3, "r"), (9, 0, 1, "A", 3, "r"), (None, 0, 1, "A", 0, "r")], spans)
    words = spark.createDataFrame([(4, 0, 1, "B", 3, "d"), (1, 1, 2, "B", 4, "d")], spans)
    rows, codes = exchange.orchestrated(fragments, {"rules": rules, "dictionary": words}, spark.createDataFrame([(4, "rules"), (6, "other"), (None, "rules")], "k int, detector string"), "k", "text")
    assert "Join" not in plan_of(rows) + plan_of(codes)
    assert sorted(tuple(r) for r in rows.collect()) == [(1, 0, 3, "A", 3, "r"), (1, 1, 2, "B", 4, "d"), (3, 0, 1, "A", 0, "r")]
    assert {(r.k, r.code) for r in codes.collect()} == {(2, "INVALID_SPAN"), (3, "SECRET_DETECTED"), (4, "DETECTION_INCOMPLETE"), (5, "INVALID_SPAN")}


def test_windows_of_evidence_are_not_grouped(spark):
    sources, evidence = evidence_of(spark, 3)
    sources = sources.withColumn("retention_until", F.col("retention_until") - F.make_dt_interval("source_id")).withColumn("observed_at", F.col("observed_at") - F.make_dt_interval("source_id"))
    found = lifecycle.time_windows(evidence.withColumn("candidate_id", F.col("candidate_id") % 2).unionByName(evidence.limit(1)), sources)
    assert "Aggregate" not in plan_of(found)
    day = timedelta(days=1)
    assert {(r.candidate_id, r.window_start, r.window_end) for r in found.collect()} == {(0, NOW - 11 * day, NOW + 9 * day), (1, NOW - 10 * day, NOW + 8 * day)}
