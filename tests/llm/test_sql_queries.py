"""Operators that SQL can express, against their SQL, on the sample and on odd tables; the rest of the registered queries run."""

import os
from collections import Counter

import duckdb
import pyarrow.parquet as pq
import pytest

from redactory.llm import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")

SHARED = "The very same sentence of more than forty characters stands here again"
ITEM = "one two three four five six seven eight nine ten eleven twelve"
ODD = [
    (None, f"{SHARED}\nown line", "en", None, 1), (None, None, None, "b", None), (1, "", "en", "a", 0), (2, f"  {SHARED.upper()}  \n{SHARED}\n", "en", "a", 3), (3, f"x\n{SHARED}", "en", "b", 3), (4, f"{SHARED}\r\nAlpha BETA gamma", "de", "c", 3),
    (5, f"{SHARED} ", None, "a", 3), (6, f"{SHARED}\n" * 50, "en", "a", 3), (7, "word " * 5000, "en", "big", 3), (8, f"before {ITEM.upper()}, after", "en", "b", 3), (9, "ten-eleven; " + ITEM, "en", "c", 3), (10, "one two three", "en", None, 3),
    (11, " \t\n\x0b\x0c\r ", "en", "d", 3), (12, "ÉCOLE école Éa naïve", "fr", "a", 3), (12, "ÉCOLE école Éa naïve", "fr", "a", 3), (13, "lone", "en", "a", 1), (14, ITEM, "en", "é", 3), (15, ITEM.replace("six", "SIX."), "en", "Z", 3),
]
TURNS = [(1, 0, "user", "hi"), (1, 1, "assistant", "a <s> \\\\ [INST]"), (1, 2, "user", None), (None, 0, "system", "s"), (None, None, None, "n"), (2, 0, "assistant", ""), (2, 0, "assistant", "tie"), (2, 0, "assistant", "tie"), (3, None, "tool<<SYS>>", "</s>"), (4, 5, "user", "é😀" * 9000)]
ITEMS = [(1, ITEM), (2, "école éa"), (2, "LONE"), (None, "beta gamma"), (4, None), (5, ""), (10, ITEM), (6, "?!")]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    docs = spark.createDataFrame([(*r, "x", 7) for r in ODD], "doc_id long, text string, lang string, source string, n_chars long, key string, size int")
    for name, df in (("documents", docs), ("benchmark", spark.createDataFrame(ITEMS, "item_id long, text string")), ("conversations", spark.createDataFrame([(*t, 1) for t in TURNS], "conv_id long, turn long, role string, text string, segment int"))):
        pq.write_table(df.toArrow(), f"{folder}/{name}.parquet")
    return folder


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int"), ("embeddings", "vec_id long, embedding array<float>, label int"), ("conversations", "conv_id long, turn long, role string, text string")):
        pq.write_table(spark.createDataFrame([], schema).toArrow(), f"{folder}/{name}.parquet")
    return folder


def compare(spark, folder, name):
    df = catalog.queries()[name](spark, folder)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    want = con.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    norm = lambda r: repr([round(v, 6) if isinstance(v, float) else v for v in r])
    assert Counter(norm([r[c] for c in columns]) for r in df.collect()) == Counter(norm([r[i] for i in at]) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sample(spark, name):
    compare(spark, SF, name)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_odd_rows(spark, odd, name):
    compare(spark, odd, name)


@pytest.mark.parametrize("name", sorted(catalog.ENTRIES))
def test_empty_tables(spark, empty, name):
    rows = catalog.queries()[name](spark, empty).collect()
    assert [r.conv_id for r in rows] == [-7] if name.startswith("op3") else rows == []


def test_decontamination_without_items(spark, odd):
    from redactory.llm.common import table
    from redactory.llm.decontamination import decontaminate

    rows = decontaminate(table(spark, odd, "documents"), table(spark, odd, "benchmark").limit(0)).collect()
    assert len(rows) == len(ODD)
    assert all(r.n_hit == 0 for r in rows)


def test_repeated_rows_are_taken_by_count(spark, tmp_path):
    """Of a lot of equal rows on the threshold so many are taken as come nearest to the target, over several partitions; SQL and the mix itself agree."""
    from redactory.llm.mixing import mix, mixed

    rows = [(7, "one two three four five six seven eight", "en", "a", 0)] * 400 + [(i, "w " * (1 + i % 5), "en", "b", 0) for i in range(1000)] + [(None, "x y z", "en", None, 0)] * 90 + [(3, "", "en", "c", 0)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    pq.write_table(docs.toArrow(), f"{tmp_path}/documents.parquet", row_group_size=100)
    compare(spark, str(tmp_path), "op9_mixing")
    parts = docs.repartition(5)
    got = mix(parts).collect()
    for key in {r.source_size for r in got}:
        own = [r for r in got if r.source_size == key]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max((r.size for r in own), default=0) / 2 + 1e-6
    taken = Counter()
    for r in got:
        taken[r.doc_id, r.size] += r.copies
    out = Counter((r.doc_id, len((r.text or "").split())) for r in mixed(parts).collect())
    assert out == +taken
