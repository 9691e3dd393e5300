"""Token ids, counts and files against the libraries' results for whole texts."""

import os
import random
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest

from redactory.llm.common import shared_folder, table
from redactory.llm.huffman import STRIDE, code_lengths, crc_before, pack, read_tokens, unpack, write_tokens
from redactory.llm.tokens import PieceEncoder, Splicer, count_tokens, open_tokenizer, public_file, sentencepiece_of

SF = "/root/testdata/sf0.001"
PATH = public_file("byte_bpe_50k.json")
BITS = ["\0", "a", "the", " ", "  ", "\n", " \n", "\n\n", "'s", "'re", "’", "é", "1", "23", ".", "!!", "<|endoftext|>", "<|end", "　", "\x1c", "漢", "😀", "\t", " x", "ing", "\x85", "oftext|>"]


def texts(n, most, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, most))) for _ in range(n)]


@lru_cache
def library():
    return open_tokenizer(PATH)


def whole(text):
    return np.array(library().encode(text, add_special_tokens=False).ids, np.uint32)


def test_pieces_equal_library():
    tokenizer = open_tokenizer(PATH)
    encoder = PieceEncoder(PATH, kept=500)  # forgets again and again
    some = texts(2000, 40)
    for at in range(0, len(some), 100):
        for text, ids in zip(some[at : at + 100], encoder.encode(pa.array(some[at : at + 100])), strict=True):
            assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("chunk", "overlap"), [(40, 8), (100, 3), (100, 60)])
def test_spliced_equals_library(chunk, overlap):
    splicer = Splicer(PATH, chunk, overlap)
    some = [*texts(150, 300, 2), "a" * 1000, " " * 500 + "x", "é" * 300, "", "<|endoftext|>" * 90, "word " * 60 + "x" * 900 + " é" * 90, "1'll've " * 99]
    for text, n in zip(some, splicer.counts(some), strict=True):
        ids = whole(text)
        assert n == len(ids)
        assert (splicer.encode(text) == ids).all()
    assert splicer.splices > 500
    assert splicer.widened > 0


def test_words_with_ends_are_encoded_whole(spark):
    """Its pre-tokenizer and normalizer prove no cuts."""
    path = public_file("word_bpe_49k.json")
    some = ["", "Ein Wort", *texts(30, 300, 5)]
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.n_chunks) for r in count_tokens(docs, path, chunk=50, overlap=10).collect()}
    assert got == {i: (len(open_tokenizer(path).encode(t, add_special_tokens=False).ids), 1) for i, t in enumerate(some)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")
def test_sample_texts_are_spliced(spark):
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r for r in count_tokens(docs, PATH, chunk=300, overlap=16).collect()}
    for r in docs.collect():
        assert rows[r.doc_id].n_tokens == len(whole(r.text))
    assert sum(r.n_chunks > 1 for r in rows.values()) > len(rows) / 2


def test_counts(spark):
    some = ["", None, "one", *texts(50, 100, 3), "word " * 3000]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate([*some, "one"])], "doc_id long, text string, n_tokens int")
    rows = {r.doc_id: r for r in count_tokens(docs, PATH, limit=100, chunk=1000, overlap=50).collect()}
    for i, t in enumerate(some):
        n = len(whole(t or ""))
        assert (rows[i].n_bytes, rows[i].n_tokens, rows[i].over_limit) == (len((t or "").encode()), n, n > 100)
    model = public_file("piece_bpe_32k.model")
    got = {r.doc_id: r.n_tokens for r in count_tokens(docs.limit(20), model).collect()}
    assert all(n == len(sentencepiece_of(model).encode(some[i] or "")) for i, n in got.items())
    assert count_tokens(docs.limit(0), PATH).count() == 0


def test_files_hold_the_ids(spark):
    some = [(7, "seven"), (None, "nobody"), (3, None), (4, ""), *((100 + i, t) for i, t in enumerate(texts(60, 80, 4))), (100, "again"), (500, "long " * 2000)]
    docs = spark.createDataFrame([(*r, b"") for r in some], "doc_id long, text string, payload binary").repartition(3)
    folder = shared_folder(spark)
    write_tokens(docs, PATH, folder)
    rows = sorted(read_tokens(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((d for d, _ in some), key=lambda d: (d is not None, d or 0))
    start, left = 0, some[:]
    for r in rows:
        ids = [(d, np.append(whole(t or ""), 0).astype("<u4")) for d, t in left if d == r.doc_id]
        match = next((d, x) for d, x in ids if zlib.crc32(x.tobytes()) == r.ids_crc32)
        assert (r.start, r.n_tokens) == (start, len(match[1]))
        start += len(match[1])


@pytest.mark.parametrize("block_ids", [1, 7, 300])
def test_long_documents_span_blocks(spark, block_ids):
    some = [(1, "a"), (None, "some words here " * 9), (2, "long " * 100), (3, ""), (4, "x y z " * 50), (4, "x y z " * 51), (5, None)]
    folder = shared_folder(spark)
    write_tokens(spark.createDataFrame(some, "doc_id long, text string").repartition(2), PATH, folder, block_ids=block_ids)
    assert spark.read.parquet(f"{folder}/blocks").where("before > 0").count() > 0 or block_ids > 200
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in read_tokens(spark, folder).collect())
    ids = [(d, np.append(whole(t or ""), 0).astype("<u4")) for d, t in some]
    assert got == sorted((d is not None, d or 0, len(x), zlib.crc32(x.tobytes())) for d, x in ids)
    starts = sorted((r.start, r.n_tokens) for r in read_tokens(spark, folder).collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))


def test_crc_of_parts():
    rng = random.Random(3)
    for a, b in ((0, 5), (1, 0), (9, 1000), (300, 70_001)):
        x, y = rng.randbytes(a), rng.randbytes(b)
        assert crc_before(zlib.crc32(x), b) ^ zlib.crc32(y) == zlib.crc32(x + y)


def test_no_documents(spark):
    folder = shared_folder(spark)
    write_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH, folder)
    assert read_tokens(spark, folder).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, STRIDE, STRIDE + 1, 5000])
def test_codes_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.2, n), 50_000) - 1
    lengths = code_lengths(np.bincount(ids, minlength=1) if n else np.zeros(1, int))
    assert sum(0.5 ** lengths[lengths > 0].astype(float)) <= 1
    assert (unpack(n, *pack(ids, lengths.tobytes()), lengths.tobytes()) == ids).all()


def test_lengths_are_optimal_and_limited():
    import heapq

    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144])
    assert code_lengths(counts, 4).max() <= 4
    heap, cost = counts.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert (counts * code_lengths(counts)).sum() == cost


def test_many_rows_without_an_id_are_dealt_out(spark):
    from redactory.llm.huffman import encoded

    docs = spark.createDataFrame([(None, f"text {i} of many") for i in range(2000)], "doc_id long, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        blocks = encoded(docs, public_file("byte_bpe_50k.json"), 0, 500).where("counts IS NULL").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({b.part for b in blocks}) > 1
    assert sum(len(b.doc_ids) for b in blocks) == 2000
