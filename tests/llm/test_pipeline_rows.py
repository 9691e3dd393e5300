"""The pipeline with null and repeated ids against plain Python."""

import itertools
import os
import random
import re
from collections import Counter

import pytest
import xxhash

import corpus_pipeline as cp
from redactory.llm.common import table
from redactory.llm.mixing import mix
from redactory.llm.simhash import shingle_hashes

SF = "/root/testdata/sf0.01"


def text_hash(text):
    return (xxhash.xxh64_intdigest((text or "").encode(), 42) + 2**63) % 2**64 - 2**63


def order(row):
    return (row["doc_id"] is not None, row["doc_id"] or 0, text_hash(row["text"]), row["source"])


def firsts(rows):
    def fingerprint(text):
        h = shingle_hashes(text or "", 3)
        return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))

    fps = {t: fingerprint(t) for t in {r["text"] for r in rows}}
    root = {f: f for f in fps.values()}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in itertools.combinations(list(root), 2):
        if (a ^ b).bit_count() <= 2:
            root[find(a)] = find(b)
    best = {}
    for r in sorted(rows, key=order):
        best.setdefault(find(fps[r["text"]]), r)
    return list(best.values())


def words(text):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def clean(rows, items):
    banned = {tuple(w[i : i + 10]) for t in items if (w := words(t)) for i in range(max(len(w) - 9, 1))}
    sizes = {len(b) for b in banned}
    return [r for r in rows if not any(tuple(w[i : i + n]) in banned for w in [words(r["text"])] for n in sizes for i in range(len(w) - n + 1))]


def frame(spark, rows):
    return spark.createDataFrame([(r["doc_id"], r["text"], r["source"], 1) for r in rows], "doc_id long, text string, source string, k int")


def plain(rows):
    return Counter((r["doc_id"], r["text"], r["source"]) for r in rows)


def test_stages_drop_rows_not_ids(spark, tmp_path):
    item = "one two three four five six seven eight nine ten eleven"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rng = random.Random(1)
    fresh = lambda: " ".join(str(rng.random()) for _ in range(40))
    shared = fresh()
    texts = [(None, fresh()), (None, f"so {item} it is"), (None, shared), (None, shared), (5, shared), (5, fresh()), (5, f"x {item}"), (6, fresh()), (6, fresh()), (7, None), (8, "")]
    rows = [{"doc_id": d, "text": t, "source": s} for (d, t), s in zip(texts, itertools.cycle("ab"), strict=False)]
    rows += [dict(rows[0]), dict(rows[7]), rows[7] | {"source": "z"}]
    docs = frame(spark, rows)
    once = cp.near_duplicate(spark, docs, str(tmp_path))
    assert once.columns == docs.columns
    assert plain(r.asDict() for r in once.collect()) == plain(firsts(rows))
    left = cp.benchmark(spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    assert plain(r.asDict() for r in left.collect()) == plain(clean(rows, [item]))
    assert {r.k for r in left.collect()} == {1}


ODD = [(None, None, None), (None, "", "a"), (1, None, "a"), (1, "", None), (2, " \n ", "a"), (3, "Same text of several words here", "b"), (3, "Same text of several words here", "b"), (4, "same text of several words here", "c"), (5, "long " * 30_000, "b"), (6, "é 漢字 😀 words of all kinds", None)]


def odd_tables(spark, folder, rows):
    schema = "doc_id long, text string, source string, k long, th long, label_id long, copies long, row_k string, x binary, fp int"
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, "r", b"x", 5) for r in rows], schema)
    spark.createDataFrame([(3, 1, 0), (5, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "all kinds"), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    return docs


@pytest.mark.parametrize("rows", [ODD, ODD * 3, []], ids=["odd", "repeated", "empty"])
def test_stages_on_odd_tables(spark, tmp_path, rows):
    """Nulls, empty and long texts, ties, repeated rows, no rows, and extra columns with the operators' own names."""
    docs = odd_tables(spark, tmp_path, rows)
    plain = lambda df: Counter((r.doc_id, r.text, r.source) for r in df.collect())
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = plain(out)
        assert got.keys() <= Counter(map(tuple, rows)).keys(), name
        if name == "benchmark":
            assert got == Counter(r for r in rows if "kinds" not in (r[1] or ""))
        if name == "quality":
            assert len({(r[1] or "") in {t or "" for _, t, _ in got} for r in rows if (r[1] or "") == ""}) <= 1  # texts without terms share their fate
    assert cp.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(rows)
    assert sum(r.n_tokens for r in cp.run(spark, str(tmp_path)).collect()) >= 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")
def test_run_with_null_and_repeated_ids(spark, tmp_path):
    docs = [r.asDict() for r in table(spark, SF, "documents").orderBy("doc_id").limit(600).collect()]
    docs = [r | {"doc_id": None if i % 3 == 0 else r["doc_id"] // 2 if i % 3 == 1 else r["doc_id"]} for i, r in enumerate(docs)]
    docs += docs[::9]
    spark.createDataFrame(docs, table(spark, SF, "documents").schema).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, SF, name).write.parquet(f"{tmp_path}/{name}.parquet")
    whole = cp.run(spark, str(tmp_path)).collect()
    left = cp.quality(spark, table(spark, str(tmp_path), "documents"), str(tmp_path)).collect()
    left = clean(firsts([r.asDict() for r in left]), [r.text for r in table(spark, SF, "benchmark").collect()])
    copies = Counter()
    for r in mix(frame(spark, left)).collect():
        copies[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in whole) == +copies
    assert copies[None] > 20


@pytest.mark.parametrize("mapped", [False, True])
def test_columns_of_any_name_come_through(spark, tmp_path, mapped):
    """Names that the operators use themselves, and maps, keep their values in each stage."""
    names = ["row_k", "row_th", "mix_copies", "mix_h", "row", "whole", "each", "k", "th", "h", "nth", "copies", "part", "score", "fp", "a.b"]
    more = ", props map<string,int>" if mapped else ""
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names) + more
    rows = [(i if i % 3 else None, f"text number {i % 11} of some words", "ab"[i % 2], *[f"{n} {i}" for n in names], *([{"x": i}] if mapped else [])) for i in range(40)]
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "number 4")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    given = {repr(r) for r in docs.collect()}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        got = [repr(r) for r in out.collect()]
        assert got, name
        assert set(got) <= given, name
        if name == "benchmark":
            assert len(got) == sum(i % 11 != 4 for i in range(40))
    assert cp.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 40
