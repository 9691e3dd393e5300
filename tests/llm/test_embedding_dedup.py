"""Vector near-duplicates against a comparison of all pairs, and the index's recall."""

import os

import numpy as np
import pyarrow.parquet as pq
import pytest

from redactory.llm.embedding_dedup import Index, Settings, excesses, fitted, multi_sequence, near_vectors, op13_embedding_dedup

SF = "/root/testdata/sf0.01"


def brute(rows, t=0.93):
    """rows: vec_id, vector, label -> vec_id, links, component, kept as text; and the number of linked pairs."""
    n = len(rows)
    good = [v is not None and label is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    unit = [np.array(v, np.float64) / np.abs(np.array(v, np.float64)).max() if g else None for (_, v, _), g in zip(rows, good, strict=True)]
    unit = [u / np.sqrt(u @ u) if u is not None else None for u in unit]
    root, links = list(range(n)), [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= t:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    key = lambda k: (k is not None, k or 0)
    least = {}
    for i in range(n):
        r = find(i)
        least[r] = min(least.get(r, (2, 0)), key(rows[i][0]))
    out = []
    for i in range(n):
        c = least[find(i)]
        out.append((str(rows[i][0]), links[i], str(c[1] if c[0] else None), c == key(rows[i][0])))
    return sorted(out), sum(links) // 2


def clustered(rng, n, dim, spread):
    centres = rng.normal(size=(n // 8, dim))
    return [(centres[rng.integers(len(centres))] + spread * rng.normal(size=dim) * rng.choice([0.3, 1, 2])).tolist() for _ in range(n)]


def got(df):
    return sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in df.collect())


@pytest.mark.parametrize(("kind", "cfg"), [("float", Settings(part=16, members=4)), ("double", Settings()), ("float", Settings(sample=40, members=2, part=5))])
def test_links_equal_all_pairs(spark, kind, cfg):
    rng = np.random.default_rng(4)
    rows = [(i, v, int(rng.integers(3))) for i, v in enumerate(clustered(rng, 400, 24, 0.16))]
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(150)] + [(7, rows[7][1], rows[7][2]), (None, rows[9][1], rows[9][2]), (None, rows[9][1], 99)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 24, 1), (2003, [float("nan")] + [1.0] * 23, 1), (2004, [None] + [1.0] * 23, 1), (2005, [float("inf")] + [1.0] * 23, 1), (2006, rows[5][1], None)]
    rows += [(2007, [1.0], 1), (2008, [2.0], 1), (2009, [-1.0], 1), (2010, [1.0, 0.0], 1), (2011, [-0.0, 3.0], 1), (2012, [0.0, 3.0], 1), (2013, [1e30] * 24, 2), (2014, [1e-30] * 24, 2)]
    if kind == "float":
        rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    want, pairs = brute(rows)
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], f"vec_id long, embedding array<{kind}>, label int, name string, n int")
    found = got(near_vectors(df, cfg))
    assert sum(r[1] for r in found) >= 2 * 0.99 * pairs
    assert all(f[1] <= w[1] for f, w in zip(sorted(found, key=lambda r: r[0]), sorted(want, key=lambda r: r[0]), strict=True) if f[0] not in ("None", "7"))
    if sum(r[1] for r in found) == 2 * pairs:
        assert found == want


def test_whole_table_recall(spark):
    if not os.path.isdir(SF):
        pytest.skip("no sample tables")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in pq.read_table(f"{SF}/embeddings.parquet").to_pylist()]
    assert got(op13_embedding_dedup(spark, SF)) == brute(rows)[0]


def test_copies_with_noise_are_found(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(300, 64))
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(base)]
    rows += [(1000 + i, (base[i % 300] + rng.normal(size=64) * rng.uniform(0.1, 0.42)).tolist(), i % 3) for i in range(900)]
    want, pairs = brute(rows)
    found = got(near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), Settings(members=4)))
    assert pairs > 500
    assert 2 * pairs >= sum(r[1] for r in found) >= 2 * 0.99 * pairs


def test_sequence_is_the_sorted_product():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = rng.random(rng.integers(1, 9)), rng.random(rng.integers(1, 9))
        a, b = a - a.min(), b - b.min()
        reach = rng.random()
        sums = {i * len(b) + j: x + y for i, x in enumerate(a) for j, y in enumerate(b) if x + y <= reach}
        cells = multi_sequence(a, b, reach)
        assert set(cells) == set(sums)
        assert [sums[c] for c in cells] == sorted(sums.values())


def test_index_reaches_its_target():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 16))
    index = fitted([v.tobytes() for v in x], [1] * 2000, np.float64, 16, 100, Settings())
    assert isinstance(index, Index)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    first, second, home = excesses(index, unit)
    visited = np.mean([len(multi_sequence(a, b, index.reach)) for a, b in zip(first, second, strict=True)])
    assert visited < len(index.first) * len(index.second)
    assert all(h in multi_sequence(a, b, index.reach) for a, b, h in zip(first, second, home.tolist(), strict=True))


def test_empty_table(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
