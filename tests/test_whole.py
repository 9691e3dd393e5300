"""Queries over whole tables, and operators on groups that hold most rows, against plain Python."""

import datetime
import hashlib
import random

import pytest

from redactory.operators.knowledge import conflicts
from redactory.operators.ledger import STEPS, fold_states
from redactory.plans import catalog
from redactory.sources.tables import table

SF = "/root/testdata/sf0.01"


def folded(commands):
    state, version, applied = "proposed", 1, 0
    for c in commands:
        if to := STEPS.get((state, c)):
            state, version, applied = to, version + (c == "revise"), applied + 1
    return state, version, applied


def test_fold_of_a_hot_key(spark):
    rng = random.Random(3)
    names = ["publish", "reject", "dispute", "withdraw", "revise", "other", None]
    rows = [(rng.choice([1, 1, 1, 2, None, 3 + i % 50]), rng.choice([i, i // 3]), rng.choice(names)) for i in range(20_000)]
    want = {}
    for k, _, c in sorted(rows, key=lambda r: (r[1], r[2] or "")):
        want.setdefault(k, []).append(c)
    got = fold_states(spark.createDataFrame(rows, "k long, at long, c string").repartition(7), "k", "at", "c").collect()
    assert {r.k: (r.state, r.version, r.n_applied) for r in got} == {k: folded(c) for k, c in want.items()}
    assert len(got) == len(want)


def test_state_fold_reads_all_events(spark):
    names = {"view": "publish", "click": "reject", "error": "revise", "signup": "withdraw"}
    want = {}
    for r in table(spark, SF, "events").orderBy("event_id").collect():
        want.setdefault(r.user_id % 60, []).append(names.get(r.event_type, "dispute"))
    got = catalog.queries()["state_fold"](spark, SF).collect()
    assert {r.candidate: (r.state, r.version, r.n_applied) for r in got} == {k: folded(c) for k, c in want.items()}


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_protected_stream_reads_all_events(spark, size):
    sf = f"/root/testdata/{size}"
    sent: dict[int, list] = {}
    for r in table(spark, sf, "events").orderBy("event_id").collect():
        sent.setdefault(r.event_id // 40 * 8 + r.user_id % 8, []).append(r)
    want = {}
    for stream, events in sent.items():
        data = ["[DONE]" if r.event_id % 37 == 0 or r is events[-1] and stream % 3 else r.event_type + " " for r in events]
        marks = data.count("[DONE]")
        fault = "TOO_LARGE" if sum(map(len, data)) > 40 else "TRUNCATED" if not marks else "AFTER_END" if data[-1] != "[DONE]" or marks > 1 else None
        text = "".join(d for d in data if d != "[DONE]")
        want[stream] = (None if fault else hashlib.sha256(text.encode()).hexdigest(), fault)
    got = {r.stream: (r.digest, r.fault) for r in catalog.queries()["protected_stream"](spark, sf).collect()}
    assert got == want
    assert {f for _, f in got.values()} == {None, "TOO_LARGE", "TRUNCATED", "AFTER_END"}


def test_roles_assign_reads_all_orders(spark):
    names = {r.s_suppkey: r.s_name for r in table(spark, SF, "supplier").collect()}
    told: dict[tuple, set] = {}
    for r in table(spark, SF, "orders").collect():
        role = {0: "PARTYA", 1: "PARTYB", 3: "PARTYA"}.get((r.o_custkey if r.o_orderkey % 3 == 0 else r.o_orderkey) % 5)
        if role and r.o_custkey % 40 in names:
            told.setdefault((r.o_orderkey % 50, names[r.o_custkey % 40]), set()).add(role)
    got = {(r.request_id, r.original): {r.role} for r in catalog.queries()["roles_assign"](spark, SF).collect()}
    assert got == {k: v for k, v in told.items() if len(v) == 1}
    assert len(got) < len(told)


def test_conflicts_of_a_hot_fact(spark):
    rng = random.Random(5)
    day = lambda: rng.choice([None, *(datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=7 * rng.randrange(60)) for _ in range(9))])
    rows = []
    for i in range(400):
        s, o = ("A", "B") if rng.random() < 0.7 else (rng.choice("AC"), rng.choice(["B", "D", None]))
        turn = rng.random() < 0.4
        a, z = day(), day()
        if a and z and rng.random() < 0.8:
            a, z = min(a, z), max(a, z)
            z = min(z, a + datetime.timedelta(hours=14))
        rows.append((i * 7 % 401, o if turn else s, s if turn else o, "supplied_by" if turn else "supplies", rng.choice(["positive", "positive", "negative", "unknown"]), a, z))
    turned = lambda r: (r[2], r[1]) if r[3] == "supplies" else (r[1], r[2])
    want = {}
    for x in rows:
        meet = [y[0] for y in rows if {x[4], y[4]} == {"positive", "negative"} and turned(x) == turned(y) and None not in turned(x) and (not x[5] or not y[6] or x[5] <= y[6]) and (not y[5] or not x[6] or y[5] <= x[6])]
        if meet:
            want[x[0]] = min(meet)
    claims = spark.createDataFrame(rows, "claim_id long, subject_id string, object_id string, predicate string, polarity string, window_start timestamp, window_end timestamp")
    inverse = {"supplies": "supplied_by", "supplied_by": "supplies"}
    assert {r.claim_id: r.conflicting_id for r in conflicts(claims, inverse).collect()} == want
    assert len(want) > 100
    assert conflicts(claims.limit(0), inverse).count() == 0


def test_mutual_exclusion_reads_every_line_number(spark):
    got = {r.claim_id % 10 for r in catalog.queries()["mutual_exclusion"](spark, SF).collect()}
    assert {1, 2, 3} < got


def test_conflicts_make_no_pairs(spark):
    n = 2000  # all of one fact, half of each polarity: a million pairs
    claims = spark.range(n).selectExpr("id AS claim_id", "'A' AS subject_id", "'B' AS object_id", "'supplies' AS predicate", "CASE WHEN id % 2 = 0 THEN 'positive' ELSE 'negative' END AS polarity", "timestamp_seconds(id) AS window_start", "CAST(NULL AS timestamp) AS window_end")
    out = conflicts(claims, {})
    assert {r.claim_id: r.conflicting_id for r in out.collect()} == {i: 1 - i % 2 for i in range(n)}
    seen, todo = [], [out._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if "Join" in kind:
                seen.append(node.metrics().apply("numOutputRows").value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
    assert all(rows < 60 * n for rows in seen)
    assert seen


def shuffled(spark):
    """Rows that all stages so far have shuffled."""
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("facts", [5000, 1000])
def test_conflicts_of_small_facts_shuffle_little(spark, facts):
    """Claims of which no one denies any, and facts of five claims, some of them denied."""
    claims = spark.range(5000).selectExpr("id AS claim_id", f"concat('A', id % {facts}) AS subject_id", "'B' AS object_id", "'supplies' AS predicate", "CASE WHEN id < 4000 THEN 'positive' ELSE 'negative' END AS polarity", "timestamp_seconds(id) AS window_start", "CAST(NULL AS timestamp) AS window_end")
    before = shuffled(spark)
    got = {r.claim_id: r.conflicting_id for r in conflicts(claims, {}).collect()}
    assert got == ({i: i % 1000 + (4000 if i < 4000 else 0) for i in range(5000)} if facts == 1000 else {})
    assert shuffled(spark) - before < 15 * 5000
