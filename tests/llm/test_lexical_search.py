"""Lexical search: both ways of its joins against a plain scoring of all documents; the SQL stands in test_sql_queries."""

import math
import random
import re
from collections import Counter

import pytest

from redactory.llm.lexical_search import postings, search

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute(docs, items, top):
    counts = [(i, Counter(w), len(w)) for i, t in docs if (w := terms(t))]
    n_docs, n_terms = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc_id, c, n in counts:
            m = 100 - 50 + 50 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scores.append((-score, doc_id is not None, doc_id or 0))
        out += [(str(item), rank, str(i if there else None), -s) for rank, (s, there, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = ["the", "The", "of"] * 30 + ["".join(rng.choice("abéZ9") for _ in range(rng.randint(1, 3))) for _ in range(200)]
    docs = [(i, ", ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    docs += [(None, "the of"), (None, None), (3, "the of"), (3, "the of"), (900, ""), (901, "?!"), (902, "zzz " * 30_000), (903, "Zzz\x00zzz~zzz|ÉE")]
    items = [(1, "THE of zzz"), (2, None), (3, ""), (None, "aé 9a"), (4, "the the THE"), (4, "the the THE"), (5, "nowhere"), (6, "éE zzz")]
    return docs, items


@pytest.mark.parametrize("small", [True, False])
def test_scores(spark, rows, small):
    docs, items = rows
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, term string, n int")
    i = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, rank int")
    limits = {} if small else {"most_terms": 0, "most_weights": 0}
    got = sorted((str(r.item_id), r.rank, str(r.doc_id), r.score) for r in search(d, i, 20, **limits).collect())
    assert got == brute(docs, items, 20)


def test_postings_hold_every_document(spark, rows):
    docs, _ = rows
    d = spark.createDataFrame(docs, "doc_id long, text string")
    vocabulary = spark.createDataFrame([("the", 0), ("of", 70)], "name string, term long")
    want = Counter((t, c[name], len(w)) for _, text in docs if (w := terms(text)) and (c := Counter(w)) for name, t in (("the", 0), ("of", 70)) if c[name])
    for most in (10, 0):
        got = postings(d, vocabulary, most).collect()
        assert Counter((r.term, r.tf, r.n) for r in got if r.bucket >= 0) == want
        assert sorted(r.n for r in got if r.bucket < 0) == sorted(len(w) for _, t in docs if (w := terms(t)))
        assert {(r.term, r.bucket) for r in got if r.bucket >= 0} == {(0, 0), (70, 6)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, item_id long, text string")
    some = spark.createDataFrame([(1, 1, "the")], "doc_id long, item_id long, text string")
    assert search(none, some).collect() == search(some, none).collect() == search(none, none).collect() == []
