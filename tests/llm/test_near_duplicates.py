"""SimHash near-duplicates against a comparison of all pairs."""

import random

import xxhash

from redactory.llm.simhash import forest, near_duplicates


def brute(rows, radius=2):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fps = []
    for _, text in rows:
        words = (text or "").translate(low).encode().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, (2, 0)), (doc_id is not None, doc_id or 0))
    return sorted((str(d), f"{fp:016x}", str(least[find(i)][1] if least[find(i)][0] else None)) for i, ((d, _), fp) in enumerate(zip(rows, fps, strict=True)))


def test_components_equal_all_pairs(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    rows = [(None, "only one"), (3, None), (4, ""), (5, " \n"), (6, "One"), (7, "one"), (8, "one two")]
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(1, 400))]
        for copy in range(rng.choice([1, 1, 2, 6])):
            text = base[:]
            if copy:
                text[rng.randrange(len(text))] = "changed"
            rows.append((100 + 10 * i + copy, " ".join(text)))
    rows.append(rows[-1])
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fp string, k int")
    got = near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), f"{r.fp % 2**64:016x}", str(r.component_id)) for r in got) == brute(rows)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_forest_connects_and_stays_small():
    import numpy as np

    rng = np.random.default_rng(1)
    i, j = rng.integers(0, 300, 500), rng.integers(0, 300, 500)
    edges = forest(i, j)

    def parts(pairs):
        root = {}

        def find(x):
            root.setdefault(x, x)
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        groups = {}
        for x in list(root):
            groups.setdefault(find(x), set()).add(x)
        return sorted(map(sorted, groups.values()))

    assert parts(edges) == parts(zip(i.tolist(), j.tolist(), strict=True))
    assert len(edges) < 300
