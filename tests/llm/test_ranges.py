"""What only large inputs reach: keys over several ranges, many windows."""

import random

import pyarrow as pa
import pytest

from redactory.llm import decontamination
from redactory.llm.common import size_runs
from redactory.llm.line_dedup import COUNT, DROP, OPEN, stream


def resolve(parts, least):
    """The drops that the parts' decisions come to."""
    rows = [r for part in parts for batch in stream(iter(part), least) for r in batch.to_pylist()]
    totals = {}
    for r in rows:
        if r["kind"] == COUNT:
            n, top = totals.get((r["hi"], r["lo"]), (0, r["k"]))
            totals[r["hi"], r["lo"]] = (n + r["n"], max(top, r["k"]))
    out = []
    for r in rows:
        n, top = totals.get((r["hi"], r["lo"]), (0, None))
        if r["kind"] == DROP or (r["kind"] == OPEN and n >= least and r["k"] != top):
            out.append((r["hi"], r["lo"], r["k"], r["th"], r["places"]))
    return sorted(out)


def test_many_rows_of_one_document_are_not_held(monkeypatch):
    monkeypatch.setattr("redactory.llm.line_dedup.HELD", 3)
    names = ["hi", "lo", "k", "th", "n_lines", "places"]
    rows = [(0, key, k, th, 1, b"x") for key, ids in ((1, (9,)), (2, (7, 6)), (3, (9, 8, 7, 6, 5)), (4, (3,))) for k in ids for th in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)
    assert resolve([[batch]], 5) == sorted((0, 3, k, th, b"x") for k in (8, 7, 6, 5) for th in range(20))


@pytest.mark.parametrize("seed", range(30))
def test_ranges_may_end_anywhere(seed):
    rng = random.Random(seed)
    rows = []
    for key in range(rng.randint(1, 12)):
        for k in rng.sample(range(30), rng.choice([1, 3, 4, 5, 6, 25])):
            rows += [(0, key, k, th, 9, bytes([th])) for th in range(rng.choice([1, 1, 2]))]
    rows.sort(key=lambda r: (r[1], -r[2]))
    least = rng.choice([2, 5])
    docs = {}
    for r in rows:
        docs.setdefault(r[1], set()).add(r[2])
    expected = sorted((r[0], r[1], r[2], r[3], r[5]) for r in rows if len(docs[r[1]]) >= least and r[2] != max(docs[r[1]]))
    for pieces in (1, 2, 5, 40):
        ends = sorted(i for i in rng.sample(range(1, len(rows) + 1), min(pieces, len(rows))) if i == len(rows) or rows[i][1:3] != rows[i - 1][1:3])
        cuts = [0, *ends] + ([len(rows)] if not ends or ends[-1] != len(rows) else [])
        names = ["hi", "lo", "k", "th", "n_lines", "places"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        parts = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = rows[a:b]
            step = rng.randint(1, 7)
            parts.append([pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*own[i : i + step], strict=True), types, strict=True)], names=names) for i in range(0, len(own), step)])
        assert resolve(parts, least) == expected


def test_many_windows_take_the_other_way(spark, monkeypatch):
    items = spark.createDataFrame([(1, "the rare words stand here in this very long item of words"), (2, "the the the"), (3, "alone")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "So the rare words stand here in this very long item of words, the the the the."), (2, "the alone the"), (3, None)], "doc_id long, text string")
    rows = lambda: sorted(map(str, decontamination.decontaminate(docs, items).collect()))
    want = rows()
    monkeypatch.setattr(decontamination, "MOST_BROADCAST", 0)
    assert rows() == want
    assert any("'1', '2'" in r for r in want)


@pytest.mark.parametrize(("sizes", "want"), [([], []), ([9], [range(0, 1)]), ([3, 3, 3], [range(0, 1), range(1, 2), range(2, 3)]), ([1, 1, 1, 9, 1], [range(0, 3), range(3, 4), range(4, 5)]), ([2, 2], [range(0, 2)])])
def test_runs(sizes, want):
    assert list(size_runs(sizes, 4)) == want
