"""Bodies, keyed digests, nested units, sentence windows."""

import gzip
import hashlib
import hmac

from redactory.operators.intake import keyed_digest, measured
from redactory.operators.records import nested_units, sentence_windows


def test_measured_bodies(spark):
    body = b'{"role":1,"role":2}' * 9000
    rows = [(1, body), (2, gzip.compress(body)), (3, gzip.compress(body)[:-20]), (4, b""), (5, gzip.compress(b"x" * 1_000_000)), (6, None), (7, gzip.compress(b"x") + gzip.compress(b"y" * 600_000)), (8, gzip.compress(body) + gzip.compress(body)), (9, gzip.compress(b"x") + b"junk")]
    got = {r.id: r for r in measured(spark.createDataFrame(rows, "id long, body binary"), "id", "body", 500_000).collect()}
    assert (got[1].plain_bytes, got[1].n_needles, got[1].fault) == (len(body), 18_000, None)
    assert (got[2].plain_bytes, got[2].n_needles, got[2].fault) == (len(body), 18_000, None)
    assert got[3].fault == "BAD_GZIP"
    assert got[4].fault is got[6].fault is None
    assert got[5].fault == got[7].fault == "TOO_LARGE"
    assert (got[8].plain_bytes, got[8].n_needles, got[8].fault) == (2 * len(body), 36_000, None)
    assert got[9].fault == "BAD_GZIP"


def test_keyed_digest(spark):
    for key in (b"key", b"", b"k" * 64, b"k" * 200):
        rows = keyed_digest(spark.createDataFrame([("a",), (None,), ("é",), ("",)], "v string"), "v", key).collect()
        assert [r.digest for r in rows] == [None if r.v is None else hmac.new(key, r.v.encode(), hashlib.sha256).hexdigest() for r in rows]


def test_nested_units(spark):
    text = "华星公司/研发中心 - 数据组，x > 市场部"
    texts = spark.createDataFrame([(1, text)], "id long, text string")
    spans = spark.createDataFrame([(1, 0, 4, "ORG", 2), (1, 5, 9, "PHONE", 3)], "id long, start int, end int, entity_type string, priority int")
    assert sorted((text[r.start : r.end], r.priority) for r in nested_units(texts, spans, "id").collect()) == [("数据组", 2), ("研发中心", 2)]


def test_sentence_windows():
    text = "ab. cd\nef gh! ij kl mn op qr"
    offsets = [(i, i + 1) for i in range(len(text))]
    windows = sentence_windows(text, offsets, 10, 8)
    assert windows[0] == (0, 7)  # after the line end
    assert windows[-1][1] == len(text)
    assert all(b[0] < a[1] for a, b in zip(windows, windows[1:], strict=False))
    assert sentence_windows(text, offsets[:5], 10, 8) == [(0, 5)]
