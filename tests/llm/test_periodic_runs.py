"""Periodic runs against a search of every period at every place."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from redactory.llm.periodic_runs import batch_runs, op11_periodic_runs, periodic_runs

SF = "/root/testdata/sf0.001"


def brute(words, least=12):
    """(start, length, smallest period) of each run, sorted by start, then period."""
    n, found = len(words), {}
    numbers = {}
    x = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    for q in range(1, n // 2 + 1):
        same = np.concatenate([[0], (x[q:] == x[:-q]).astype(np.int8), [0]])
        turns = np.flatnonzero(np.diff(same))
        for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
            if b - a + q >= max(least, 2 * q):
                found.setdefault((a, b + q), q)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def judged(texts, least):
    got = batch_runs(texts, least)
    return [(list(zip(s, z, q, strict=True)), c) for s, z, q, c in zip(got["starts"], got["lengths"], got["periods"], got["collapsed"], strict=True)]


def check(texts, least=12):
    for text, (runs, kept) in zip(texts, judged(texts, least), strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        assert runs == brute(words, least), text
        assert kept == collapsed(words, runs)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=70).map(" ".join), max_size=5), st.integers(2, 14))
def test_two_words(texts, least):
    check(texts, least)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=7), st.integers(1, 9)), max_size=6), max_size=4))
def test_powers(parts):
    check([" ".join(w for block, n in doc for w in block * n) for doc in parts])


def test_long_texts_and_shapes():
    rng = random.Random(3)
    fib = ["a", "b"]
    while len(fib[-1]) < 900:
        fib.append(fib[-1] + fib[-2])
    thue = "".join("ab"[i.bit_count() & 1] for i in range(1024))
    texts = [" ".join(fib[-1]), " ".join(thue), "x " * 3000, "a b c d e f g " * 200 + "a b", None, "", " \n\t", "one", "a " * 11, "a " * 12, "é  é  " * 6]
    for _ in range(20):
        words = [str(rng.randint(0, 40)) for _ in range(rng.randint(0, 1500))]
        for _ in range(rng.randint(0, 4)):
            if len(words) > 40:
                a = rng.randrange(len(words) - 30)
                block = words[a : a + rng.randint(1, 30)]
                at = rng.randrange(len(words))
                words[at:at] = block * rng.randint(2, 6)
        texts.append("\n".join(words))
    check(texts)
    check(texts[::-1])


def test_rows(spark):
    rows = [(None, "a " * 12, "x"), (None, None, "y"), (1, "", None), (2, "p q " * 7 + "p", "z"), (2, "p q " * 7 + "p", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(docs).collect())
    assert got == sorted([("None", 12, [(0, 12, 1)], "a"), ("None", 0, [], ""), ("1", 0, [], ""), ("2", 15, [(0, 15, 2)], "p q"), ("2", 15, [(0, 15, 2)], "p q")])
    assert periodic_runs(docs.limit(0)).collect() == []


def contract(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
    milli = 1000 * best[1] // best[2] if runs else None
    return str(doc_id), len(runs), *map(str, (*best, milli)), sha("".join(f"{s},{z},{q}\n" for s, z, q in runs)), sha(collapsed(words, runs))


def query_rows(spark, folder):
    return sorted((str(r.doc_id), r.n_runs, *map(str, (r.start, r.length, r.period, r.exponent_milli)), r.runs_sha256, r.collapsed_sha256) for r in op11_periodic_runs(spark, folder).collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")
def test_query_over_the_whole_sample(spark):
    rows = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert query_rows(spark, SF) == sorted(contract(r["doc_id"], r["text"]) for r in rows)


def test_query_over_odd_rows(spark, tmp_path):
    zero = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(i, " ".join(f"w{k}" for k in range(7 * j + 1)), 1) for j, i in enumerate(zero)] + [(zero[0], "", 2), (zero[0], None, 2), (None, "a b " * 9, 3), (5, " \u000b", 0), (-3, "k " * 40, 0)]
    pq.write_table(spark.createDataFrame(rows, "doc_id long, text string, h long").toArrow(), f"{tmp_path}/documents.parquet")
    assert query_rows(spark, str(tmp_path)) == sorted(contract(i, t) for i, t, _ in rows)
