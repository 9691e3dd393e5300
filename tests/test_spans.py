"""Span operators against small models in Python, over random and permuted inputs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from redactory.operators import spans as sp

KINDS = ("A", "B")


def fold(spans):
    out = []
    for s, e, t, p, src in sorted(spans):
        if out and s < out[-1][1]:
            o = out[-1]
            out[-1] = (o[0], max(o[1], e), o[2] if o[2] == t else "MIXED", min(o[3], p), o[4] | {src})
        else:
            out.append((s, e, t, p, {src}))
    return [(s, e, t, p, sorted(x)) for s, e, t, p, x in out]


def test_merge_equals_fold(spark):
    rng = random.Random(4)
    groups = {g: [(s := rng.randrange(30), s + rng.randint(1, 8), rng.choice(KINDS), rng.randrange(4), rng.choice("xyz")) for _ in range(rng.randint(1, 12))] for g in range(80)}
    rows = [(g, *s) for g, spans in groups.items() for s in spans]
    frame = spark.createDataFrame(rows, "g long, start int, end int, entity_type string, priority int, source string")
    got = {}
    for r in sp.merge_spans(frame, "g").collect():
        got.setdefault(r.g, []).append((r.start, r.end, r.entity_type, r.priority, list(r.sources)))
    assert {g: sorted(v) for g, v in got.items()} == {g: fold(v) for g, v in groups.items()}


def test_merge_ignores_input_order(spark):
    base = [(0, 3, "A", 1, "x"), (2, 5, "B", 2, "y"), (5, 6, "A", 3, "x"), (9, 10, "B", 0, "z")]
    rows = [(g, *s) for g, p in enumerate(itertools.permutations(base)) for s in p]
    frame = spark.createDataFrame(rows, "g long, start int, end int, entity_type string, priority int, source string")
    seen = {tuple(sorted((r.start, r.end, r.entity_type) for r in rows)) for _, rows in itertools.groupby(sorted(sp.merge_spans(frame, "g").collect(), key=lambda r: r.g), key=lambda r: r.g)}
    assert seen == {((0, 5, "MIXED"), (5, 6, "A"), (9, 10, "B"))}


def test_coverage_counts_points(spark):
    rng = random.Random(6)
    gold = [(g, s := rng.randrange(20), s + rng.randint(1, 9)) for g in range(40) for _ in range(2)]
    guess = [(g, s := rng.randrange(20), s + rng.randint(1, 9)) for g in range(30) for _ in range(4)]
    schema = "g long, start int, end int"
    got = {(r.g, r.start, r.end): r.covered for r in sp.coverage(spark.createDataFrame(list(set(gold)), schema), spark.createDataFrame(guess, schema), "g").collect()}
    points = {g: {i for h, s, e in guess if h == g for i in range(s, e)} for g in range(40)}
    assert got == {(g, s, e): len(points[g] & set(range(s, e))) for g, s, e in gold}


@pytest.mark.parametrize("n", [1, 5, 6, 7, 12, 13, 40])
def test_windows_cover_all(spark, n):
    rows = sp.plan_windows(spark.createDataFrame([(1, n)], "id long, n long"), "n", 6, 4).orderBy("window_no").collect()
    assert rows[0].window_start == 0
    assert rows[-1].window_end == n
    assert all(b.window_start <= a.window_end for a, b in itertools.pairwise(rows))
    assert all(r.window_end - r.window_start == min(6, n) for r in rows)


def test_replace_and_restore(spark):
    text = "😀 call 13800001111 or 13900002222 <B_9>"
    edits = [(7, 18, "<P_001>"), (22, 33, "<P_002>")]
    frame = spark.createDataFrame([(text, edits, {"<P_001>": "13800001111", "<P_002>": "<P_001>"})], "t string, e array<struct<start: int, end: int, token: string>>, m map<string,string>")
    r = frame.select(sp.replaced(F.col("t"), F.col("e")).alias("out"), "m").select("out", sp.restored(F.col("out"), F.col("m")).alias("back")).first()
    assert r.out == "😀 call <P_001> or <P_002> <B_9>"
    assert r.back == "😀 call 13800001111 or <P_001> <B_9>"  # an original is not read again


def test_reserved(spark):
    texts = {"<ORG_001>": True, "< ORG_": True, "x <Org-1": True, "<<ENT": True, "a <<E": True, "<b>": False, "1 < 2": False, "<abc_": True}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", sp.reserved(F.col("t")).alias("r")).collect()
    assert {r.t: r.r for r in rows} == texts
