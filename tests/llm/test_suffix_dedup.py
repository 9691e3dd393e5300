"""Substring deduplication against a dictionary of all 50-byte strings."""

import random

import numpy as np
import pytest

from redactory.llm import suffix_dedup
from redactory.llm.suffix_dedup import COVER, PERIOD, WIDTH, Block, Runs, names_of, opened, packed, remove_repeats, repeated_in, sample_order


def brute(rows):
    key = lambda d: -(2**63) if d is None else d
    least = {}
    for d, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - 49):
            w = raw[i : i + 50]
            least[w] = min(least.get(w, key(d)), key(d))
    out = []
    for d, text in rows:
        raw = (text or "").encode()
        gone = [False] * (len(raw) + 1)
        for i in range(len(raw) - 49):
            if least[raw[i : i + 50]] < key(d):
                gone[i : i + 50] = [True] * 50
        spans, start = [], None
        for i, g in enumerate(gone):
            if g and start is None:
                start = i
            elif not g and start is not None:
                spans.append((start, i))
                start = None
        out.append((str(d), len(raw), tuple(spans), bytes(b for b, g in zip(raw, gone, strict=False) if not g)))
    return sorted(out)


def sample_rows(seed):
    rng = random.Random(seed)
    rand = lambda n: "".join(rng.choice("abcdefg é") for _ in range(n))
    shared = [rand(n) for n in (40, 49, 50, 51, 70, 200)]
    rows = [(None, shared[4]), (7, None), (8, ""), (9, "short"), (10, "ab" * 100), (11, "ba" * 60), (12, "ab" * 100)]
    for i in range(60):
        rows.append((100 + i, "".join(rng.choice([rand(rng.randint(0, 90)), rng.choice(shared)]) for _ in range(rng.randint(1, 6)))))
    return rows + [(100, rows[20][1]), rows[30], (5000, rows[31][1]), (5001, rows[31][1][:-1] + "x")]


@pytest.mark.parametrize("size", [300, 1 << 22])
def test_equals_all_strings(spark, size):
    rows = sample_rows(9)
    docs = spark.createDataFrame([(*r, "e", 1) for r in rows], "doc_id long, text string, kept string, block int").repartition(3)
    got = sorted((str(r.doc_id), r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in remove_repeats(docs, size).collect())
    assert got == brute(rows)


@pytest.mark.parametrize("most", [40, 1 << 20])
@pytest.mark.parametrize("bits", [0, 12, 64])
def test_exact_whatever_the_hashes(monkeypatch, bits, most):
    """With hashes of 12 bits or none most names collide; the bytes decide."""
    whole = suffix_dedup.rolled
    monkeypatch.setattr(suffix_dedup, "rolled", lambda data, width: whole(data, width) & np.uint64((1 << bits) - 1))
    rows = sorted(((d, t or "") for d, t in sample_rows(4) if d is not None), key=lambda r: r[0])
    cut = [rows[i : i + 9] for i in range(0, len(rows), 9)]
    if cut[2][-1][0] == cut[3][0][0]:  # rows of a doc_id share a block
        cut[2].append(cut[3].pop(0))
    held = [{"raw": suffix_dedup.zstandard.ZstdCompressor().compress("".join(t for _, t in c).encode()), "lengths": [len(t.encode()) for _, t in c], "keys": [d for d, _ in c]} for c in cut]
    names = [names_of(Block(r)) for r in held]
    runs = [Runs(Block(r), lambda own, k=k: np.isin(own, np.concatenate([n for j, n in enumerate(names) if j != k]))) for k, r in enumerate(held)]
    press = suffix_dedup.zstandard.ZstdCompressor()
    messages = [(press.compress(b"".join(r.bytes)), press.compress(np.concatenate([r.sizes() + WIDTH - 1, r.doc[r.leader]]).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())) for r in runs]
    found = repeated_in(messages, most)
    gone = b"".join(bytes(r.marked(f, sum(h["lengths"])).astype(np.uint8)) for r, f, h in zip(runs, found, held, strict=True))
    want, text = [], "".join(t for c in cut for _, t in c).encode()
    for d, t in (r for c in cut for r in c):
        mask = bytearray(len(t.encode()))
        for s, e in next(x[2] for x in brute(rows) if x[0] == str(d) and x[1] == len(mask)):
            mask[s:e] = b"\x01" * (e - s)
        want.append(bytes(mask))
    assert len(gone) == len(text)
    assert gone == b"".join(want)


def test_sample_order_and_shared_lengths():
    rng = random.Random(2)
    raw = bytes(rng.choice(b"ab") for _ in range(400)) + bytes([0, 255] * 30) + bytes(100)
    places = np.arange(460)
    order, shared = sample_order(np.frombuffer(raw, np.uint8), places)
    cut = [raw[p : p + WIDTH] for p in order.tolist()]
    assert cut == sorted(cut)
    for k in range(1, len(cut)):
        assert shared[k] == next((i for i in range(WIDTH) if cut[k][i] != cut[k - 1][i]), WIDTH)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cover_has_every_difference():
    assert sorted((a - b) % PERIOD for a in COVER for b in COVER if a != b) == list(range(1, PERIOD))


def test_packing():
    keys = np.sort(np.random.default_rng(3).integers(0, 2**64, 1000, np.uint64))
    assert (opened(packed(keys)) == keys).all()


@pytest.mark.parametrize("bucket", [None, 2000])
def test_many_rows_of_one_id_fill_many_blocks(spark, bucket):
    """A third of the rows without an id, and runs of equal ids, over blocks and partitions; none of a block's texts may count against its own id."""
    rng = random.Random(8)
    rand = lambda n: "".join(rng.choice("abcdefg é") for _ in range(n))
    shared = [rand(60) for _ in range(12)]
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i // 10, rand(80) + rng.choice(shared) + rand(rng.randint(0, 99)) + rng.choice(shared)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = suffix_dedup.blocks(docs, 2000).collect()
    assert max(sum(r.lengths) for r in held) < 4000
    assert len({r.block for r in held if -(2**63) in r["keys"]}) > 5
    heads = {r.block: r.head for r in suffix_dedup.begun(suffix_dedup.stored(suffix_dedup.blocks(docs, 2000))).collect()}
    assert len(heads) > 5
    assert all(h < b for b, h in heads.items())
    got = sorted((str(r.doc_id), r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in remove_repeats(docs, 2000, bucket).collect())
    assert got == brute(rows)
