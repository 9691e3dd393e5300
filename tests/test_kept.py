"""Sealed records, dictionary commands, scans of folders, the model interface and exact quantiles, against plain Python."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from redactory.functions.extraction import Bounds, batches_of, extract, offset_fault, spans_of
from redactory.operators.dictionary import commanded
from redactory.operators.quality import latencies
from redactory.operators.sealed import bound_to, nonce_of, opened, sealed
from redactory.plans.models import Capitals
from redactory.sources.scans import scan, scan_stream


def test_one_changed_member_makes_a_record_unreadable(spark):
    rows = spark.createDataFrame([(1, "d", "id", "history", "né\n"), (2, "d", "id", "history", None), (3, "d", "id", "history", "")], "n int, domain string, record string, purpose string, body string")
    key = F.unhex(F.sha2(F.lit("k"), 256))
    bound = lambda d="d", i="id", p="history", v=1: bound_to(F.lit(d), F.lit(i), F.lit(p), v)
    shut = rows.select("n", "body", sealed(F.col("body"), key, nonce_of("n", "record"), bound()).alias("e"))
    ways = {"same": (key, bound()), "domain": (key, bound(d="x")), "record": (key, bound(i="x")), "purpose": (key, bound(p="x")), "version": (key, bound(v=2)), "key": (F.unhex(F.sha2(F.lit("j"), 256)), bound())}
    got = {r.n: r for r in shut.select("n", "body", *[opened(F.col("e"), k, b).alias(name) for name, (k, b) in ways.items()]).collect()}
    assert [got[n].same for n in (1, 2, 3)] == ["né\n", None, ""]
    assert all(got[1][name] is None for name in ways if name != "same")
    assert shut.select(bound()).first()[0] == json.dumps({"domain": "d", "format_version": 1, "purpose": "history", "record_id": "id"}, separators=(",", ":"))


def test_dictionary_commands(spark):
    rng = random.Random(3)
    rows, revision = [], {}
    for n in range(600):
        scope = rng.choice(["a", "b", None])
        action = rng.choice(["create", "create", "update", "delete", "publish", "rename"])
        rows.append([scope, n, action, f"e{rng.randrange(9)}", rng.choice(["t1", "t2", "t3", "t4", "t5", " ", None]), rng.random() < 0.7, None])
    want = {}
    books = {}
    for r in rows:
        b = books.setdefault(r[0], {"entries": {}, "rev": 0, "pub": 0})
        r[6] = b["rev"] if rng.random() < 0.85 else b["rev"] - 1
        scope, n, action, entry, text, on, expected = r
        code = None
        texts = {t: e for e, (t, _) in b["entries"].items()}
        if action == "rename":
            code = "UNKNOWN_ACTION"
        elif expected != b["rev"]:
            code = "REVISION_CONFLICT"
        elif action == "publish":
            if b["rev"] != b["pub"] and not any(x for _, x in b["entries"].values()):
                code = "EMPTY_PUBLICATION"
            else:
                b["pub"] = b["rev"]
        elif action == "delete":
            code = None if entry in b["entries"] else "ENTRY_NOT_FOUND"
            if not code:
                del b["entries"][entry]
        elif not (text or "").strip():
            code = "INVALID_TEXT"
        elif texts.get(text, entry) != entry or (action == "create" and entry in b["entries"]):
            code = "ENTRY_CONFLICT"
        elif action == "create" and len(b["entries"]) >= 4:
            code = "LIMIT_EXCEEDED"
        elif action == "update" and entry not in b["entries"]:
            code = "ENTRY_NOT_FOUND"
        else:
            b["entries"][entry] = (text, on)
        if not code and action != "publish":
            b["rev"] += 1
        want[n] = (code, b["rev"], b["pub"], len(b["entries"]))
    df = spark.createDataFrame(rows, "scope string, n long, action string, entry_id string, text string, enabled boolean, expected long")
    got = {r.n: (r.code, r.revision, r.published, r.n_entries) for r in commanded(df, 4).collect()}
    assert got == want
    assert {c for c, *_ in want.values()} >= {"REVISION_CONFLICT", "ENTRY_CONFLICT", "ENTRY_NOT_FOUND", "LIMIT_EXCEEDED", "INVALID_TEXT"}


FILES = {"a.json": b'{"id": 1, "name": "x"}', "b.json": b'{"id": "no"}', "c.json": b"\xff{}", "d.json": b"[1]", "e.json": b"", "f.json": b'{"id": 2' + b" " * 500 + b"}", "g.json": b' {"id": 3, "more": [1]}', "h.txt": b"no"}
CODES = {"a": None, "b": "MALFORMED", "c": "ENCODING", "d": "MALFORMED", "f": "TOO_LARGE", "g": None}


def test_scans(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name, data in FILES.items():
        (tmp_path / "in" / ("deep" if name > "e" else "") / name).write_bytes(data)
    kind = StructType.fromDDL("id long, name string")
    name = lambda r: r.path.rsplit("/", 1)[1][0]
    rows = scan(spark, str(tmp_path / "in"), kind, most_bytes=300).collect()
    assert {name(r): r.code for r in rows} == CODES
    assert {name(r): tuple(r.record) for r in rows if r.record} == {"a": (1, "x"), "g": (3, None)}
    assert sorted(r.code or "" for r in scan(spark, str(tmp_path / "in"), kind, most_bytes=300, most_files=2).collect()) == ["", "MALFORMED"] + ["TOO_MANY_FILES"] * 4
    out = scan_stream(spark, str(tmp_path / "in"), kind, most_bytes=300, per_batch=3).select("path", "code")
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert {name(r): r.code for r in spark.read.parquet(str(tmp_path / "out")).collect()} == CODES


def test_windows_change_no_spans(spark):
    class Broken(Capitals):  # made here, as workers can't import tests
        def tokens(self, text):
            ids, offsets = Capitals.tokens(self, text)
            return ids, offsets[:-1] if text.startswith("cut") else [(a, b + 99) for a, b in offsets] if text.startswith("far") else offsets

    rng = random.Random(5)
    texts = [(i, " ".join(rng.choice(["Aa", "Bb", "cc", "dd.", "Ee!\n"]) for _ in range(rng.randrange(400)))) for i in range(40)] + [(90, None), (91, " \t"), (92, "A " * 900), (93, "cut A"), (94, "far A")]
    df = spark.createDataFrame(texts, "id int, text string")
    whole, held = extract(df, "id", "text", Broken, Bounds(capacity=1 << 20, stride=1 << 20, tokens=1 << 30))
    cut, also = extract(df, "id", "text", Broken, Bounds(capacity=20, stride=12, windows=5, tokens=90))
    key = lambda d: sorted(tuple(r) for r in d.collect())
    assert key(whole.select("id", "start", "end", "entity_type")) == key(cut.select("id", "start", "end", "entity_type"))
    assert key(held) == key(also) == [(93, "OFFSET_MALFORMED"), (94, "OFFSET_OUT_OF_RANGE")]


def test_batches_and_offsets():
    bounds = Bounds(windows=4, tokens=100, spread=0.25)
    widths = sorted(random.Random(1).choices(range(1, 60), k=200))
    calls = list(batches_of(widths, bounds))
    assert [i for c in calls for i in c] == list(range(200))
    assert all(len(c) <= 4 and (len(c) == 1 or (len(c) * widths[c[-1]] <= 100 and widths[c[0]] >= 0.75 * widths[c[-1]])) for c in calls)
    assert list(batches_of([], bounds)) == []
    faults = [offset_fault("ab c", [1, 1], o) for o in ([(0, 2), (3, 4)], [(0, 2)], [(0, 2), (3, 9)], [(2, 0), (3, 4)], [(3, 4), (0, 2)], [(1, 2), (3, 4)], [(0, 2), (2, 2)], [(0, 0), (0, 0)])]
    assert faults == [None, "OFFSET_MALFORMED", "OFFSET_OUT_OF_RANGE", "OFFSET_INVERTED", "OFFSET_NON_MONOTONIC", "OFFSET_COVERAGE_INCOMPLETE", "OFFSET_COVERAGE_INCOMPLETE", "OFFSET_COVERAGE_INCOMPLETE"]
    assert spans_of(["B-X", "I-X", "I-Y", "O", "I-Y", "B-Y"], [(0, 1), (1, 2), (2, 3), (3, 4), (5, 6), (6, 7)]) == [(0, 2, "X"), (2, 3, "Y"), (5, 6, "Y"), (6, 7, "Y")]


@pytest.mark.parametrize("parts", [1, 5])
def test_quantiles_of_groups_and_of_all(spark, parts):
    rng = np.random.default_rng(6)
    rows = [(g, float(v)) for g, n in (("a", 1), ("b", 2), ("c", 997), (None, 13)) for v in rng.integers(0, 50, n)] + [("d", None), ("c", None), *[("e", 7.0)] * 400]
    got = {r.g if (r.n < len(rows)) else "ALL": r for r in latencies(spark.createDataFrame(rows, "g string, v double").repartition(parts), "v", "g").collect()}
    for g in ("a", "b", "c", None, "e", "ALL"):
        own = [v for k, v in rows if (g == "ALL" or k == g) and v is not None]
        assert [got[g].p50, got[g].p95, got[g].p99] == pytest.approx(np.quantile(own, [0.5, 0.95, 0.99]), abs=1e-4)
    assert (got["d"].n, got["d"].p50) == (1, None)
    assert latencies(spark.createDataFrame([], "g string, v double"), "v", "g").count() == 1


def test_scans_read_every_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(20_010):
        (tmp_path / "in" / f"{i}.json").write_bytes(b'{"id": %d}' % i)
    found = scan(spark, str(tmp_path / "in"), StructType.fromDDL("id long")).selectExpr("code", "record.id")
    assert found.where("code IS NULL").selectExpr("count(*)", "count(DISTINCT id)").first() == (20_010, 20_010)
