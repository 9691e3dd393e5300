"""Token ids as blocks of canonical, length-limited Huffman codes.

Ids are counted over all documents, the counts give code lengths, and each block is
coded on its own, with the bit offset of every STRIDE-th id as a checkpoint. The
decoder runs all checkpoints of a block side by side through one table that holds,
for the next LIMIT bits, the id and the length of its code.

The format: a table of blocks in a folder per range of documents, and beside it a
table "codes" with one row, the length of each id's code as a byte (0: no code).
A block has first (number of ids before it; the blocks' order), doc_ids and n_tokens
(its documents, ascending by doc_id, null first, and the number of ids that it holds
of each), before and after (ids of its first document in earlier blocks, and of its
last one in later blocks), checkpoints (little-endian unsigned 64-bit) and payload
(the codes, first bit highest). A document of more ids than a block has is cut into
blocks of its own; the others are never split.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redactory.llm.common import discard, id_back, id_key, kept, shared_folder, size_runs, slices, table, text_hash
from redactory.llm.tokens import TOGETHER, pieces_of, public_file

LIMIT, STRIDE = 18, 128
#: A block is closed once it has so many ids.
BLOCK = 1 << 18


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most limit bits for the ids with a count; 0 for the others.

    Package-merge: each level merges the ids with the pairs of the level below; how
    many ids stand among the items taken from a level is how many get one bit more.
    """
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n > 1 << limit:
        raise ValueError(f"{n} ids need codes of more than {limit} bits")
    if n <= 1:
        lengths[used] = 1
        return lengths
    rising = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[rising].astype(np.float64)
    items, is_leaf = leaves, []
    for _ in range(limit - 1):
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        order = np.argsort(both, kind="stable")
        items = both[order]
        is_leaf.append(order < n)
    more, take = np.zeros(n + 1, np.int64), 2 * n - 2
    for leaf in reversed(is_leaf):
        here = int(np.count_nonzero(leaf[:take]))
        more[here] += 1
        take = 2 * (take - here)
    more[take] += 1
    lengths[rising] = np.cumsum(more[::-1])[::-1][1:]
    return lengths


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes by id, and the ids in the order of their codes."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes = np.zeros(len(lengths), np.uint64)
    size = lengths[order].astype(np.uint64)
    room = np.uint64(1) << (np.uint64(LIMIT) - size)  # of each code, in codes of LIMIT bits
    codes[order] = (np.cumsum(room) - room) >> (np.uint64(LIMIT) - size)
    return codes, order


@lru_cache(maxsize=2)
def tables(lengths: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes and lengths by id; by the next LIMIT bits the id, times 32, plus the length."""
    by_id = np.frombuffer(lengths, np.uint8)
    codes, order = canonical(by_id)
    room = 1 << (LIMIT - by_id[order].astype(np.int64))
    next_bits = np.ones(1 << LIMIT, np.uint32)
    next_bits[: room.sum()] = np.repeat(order << 5 | by_id[order], room)
    return codes, by_id.astype(np.int64), next_bits


def pack(ids: np.ndarray, lengths: bytes) -> tuple[bytes, bytes]:
    """Checkpoints and payload."""
    codes, sizes, _ = tables(lengths)
    size = sizes[ids]
    ends = np.cumsum(size)
    at = ends - size
    shifted = codes[ids] << (64 - (at & 31) - size).astype(np.uint64)
    word = at >> 5
    words = np.zeros((int(ends[-1]) + 31 >> 5) + 1 if len(ids) else 1, np.uint64)
    if len(ids):  # codes that begin in one word have bits of their own, so their sum joins them
        first = np.flatnonzero(np.diff(word, prepend=-1))
        into = word[first]
        words[into] = np.add.reduceat(shifted >> np.uint64(32), first)
        words[into + 1] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), first)
    return at[::STRIDE].astype("<u8").tobytes(), words.astype(">u4").tobytes()


def unpack(n: int, checkpoints: bytes, payload: bytes, lengths: bytes) -> np.ndarray:
    """The n ids of a block."""
    _, _, table = tables(lengths)
    words = np.frombuffer(payload, ">u4").astype(np.uint64)
    words = (words << np.uint64(32)) | np.append(words[1:], np.uint64(0))
    at = np.frombuffer(checkpoints, "<u8").astype(np.int64)
    out = np.empty((STRIDE, len(at)), np.uint32)
    last, down = len(words) - 1, np.uint64(64 - LIMIT)
    for k in range(STRIDE):
        bits = (words[np.minimum(at >> 5, last)] << (at & 31).astype(np.uint64)) >> down
        found = table[bits]
        out[k] = found >> np.uint32(5)
        at += found & np.uint32(31)
    return out.T.reshape(-1)[:n]


POLYNOMIAL = 0xEDB88320  # of CRC-32, lowest bit first


def times(a: int, b: int) -> int:
    """The product of two polynomials, lowest bit first, modulo that of CRC-32."""
    product = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            product ^= b
        b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
    return product


def crc_before(crc: int, n_bytes: int) -> int:
    """What a CRC-32 adds, by exclusive-or, to that of a text in which n_bytes more bytes follow: its product with x to the power of their bits."""
    power, square = 1 << 31, times(1 << 27, 1 << 27)  # 1, and x to the 8th
    while n_bytes:
        if n_bytes & 1:
            power = times(power, square)
        square = times(square, square)
        n_bytes >>= 1
    return times(power, crc)


def encoded(docs: DataFrame, path: str, end_id: int, block_ids: int = BLOCK) -> DataFrame:
    """docs -> blocks in ascending doc_id order: part, base (ids of the part before the block), doc_ids, n_tokens, n_ids, before, after, ids (compressed). A last row of each part has counts of its ids instead, so that the blocks need not be read for them."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder, press = TaskContext.get().partitionId(), pieces_of(path), zstandard.ZstdCompressor(level=1)
        end = np.array([end_id], np.uint32)
        wide = encoder.tokenizer.get_vocab_size() > 1 << 16
        total = np.zeros(encoder.tokenizer.get_vocab_size(), np.int64)
        base = waiting = 0
        keys: list[int | None] = []
        parts: list[np.ndarray] = []

        def block(before: int = 0, after: int = 0) -> pa.RecordBatch:
            nonlocal base, keys, parts, waiting
            n = [len(p) for p in parts]
            ids = np.concatenate(parts)
            total[:] += np.bincount(ids, minlength=len(total))
            raw = ids.astype("<u4" if wide else "<u2").tobytes()
            row = {"part": [part], "base": [base], "doc_ids": [keys], "n_tokens": [n], "n_ids": [sum(n)], "before": [before], "after": [after], "wide": [wide], "ids": [press.compress(raw)], "counts": [None]}
            base, keys, parts, waiting = base + sum(n), [], [], 0
            return pa.RecordBatch.from_pydict(row, BLOCKS)

        for batch in slices(batches, 1200):
            texts = pc.fill_null(batch.column(1), "")
            doc_ids = batch.column(0).to_pylist()
            for group in size_runs(pc.utf8_length(texts).to_pylist(), TOGETHER):
                for k, own in zip(group, encoder.encode(texts.slice(group.start, len(group))), strict=True):
                    ids = np.append(own, end)
                    if len(ids) > block_ids:  # blocks of its own
                        if parts:
                            yield block()
                        for at in range(0, len(ids), block_ids):
                            keys, parts = [doc_ids[k]], [ids[at : at + block_ids]]
                            yield block(at, max(0, len(ids) - at - block_ids))
                        continue
                    keys.append(doc_ids[k])
                    parts.append(ids)
                    waiting += len(ids)
                    if waiting >= block_ids:
                        yield block()
        if parts:
            yield block()
        if base:
            yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(BLOCKS.names, (part, base, None, None, 0, 0, 0, wide, None, press.compress(total.tobytes())), strict=True)}, BLOCKS)

    named = docs.select(id_key().alias("k"), text_hash().alias("th"), "text")
    ranged = named.repartitionByRange("k", "th").sortWithinPartitions("k", "th")  # by both, as many rows may have no id
    return ranged.select(id_back("k").alias("doc_id"), "text").mapInArrow(encode, "part int, base long, doc_ids array<long>, n_tokens array<long>, n_ids long, before long, after long, wide boolean, ids binary, counts binary")


BLOCKS = pa.schema([("part", pa.int32()), ("base", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("before", pa.int64()), ("after", pa.int64()), ("wide", pa.bool_()), ("ids", pa.binary()), ("counts", pa.binary())])
#: Columns of a block in the files, but for its codes.
SHAPE = ["part", "first", "doc_ids", "n_tokens", "n_ids", "before", "after"]
FILE_SCHEMA = "first long, doc_ids array<long>, n_tokens array<long>, n_ids long, before long, after long, checkpoints binary, payload binary"


def plain(compressed: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(compressed), "<u4" if wide else "<u2")


def counted(blocks: DataFrame) -> DataFrame:
    """id, n over all parts. Each task sums its parts' counts first, so that it sends a row per id at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for compressed in batch.column(0):
                n = np.frombuffer(zstandard.ZstdDecompressor().decompress(compressed.as_py()), np.int64)
                total = n + total if len(total) else n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    return blocks.where("counts IS NOT NULL").select("counts").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int = 0, block_ids: int = BLOCK) -> None:
    """Encodes docs (doc_id, text; other columns are left alone) with the tokenizer file at path, end_id after each document, and writes the format to folder.

    Null and empty texts have the end id alone. Documents with the same doc_id follow
    each other in an order that depends on their texts only; null comes first. A very
    long text is encoded by one task and written as several blocks. An empty table
    gives a table of no blocks.
    """
    spark = docs.sparkSession
    blocks = kept(encoded(docs, path, end_id, block_ids), compression="none")
    counts = counted(blocks).collect()  # bounded by the vocabulary
    by_id = np.zeros(max([0, *(r.id for r in counts)]) + 1, np.int64)
    for r in counts:
        by_id[r.id] = r.n
    lengths = code_lengths(by_id).tobytes()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8):
            packed = [pack(plain(c.as_py(), w.as_py()), lengths) for c, w in zip(batch.column("ids"), batch.column("wide"), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in SHAPE), pa.array([c for c, _ in packed], pa.binary()), pa.array([p for _, p in packed], pa.binary())], names=[*SHAPE, "checkpoints", "payload"])

    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row per range
    offsets = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))
    placed = blocks.where("counts IS NULL").join(F.broadcast(offsets), "part").withColumn("first", F.col("offset") + F.col("base")).select(*SHAPE, "wide", "ids")
    placed.mapInArrow(code, f"part int, {FILE_SCHEMA}").write.partitionBy("part").option("compression", "none").parquet(f"{folder}/blocks")
    spark.createDataFrame([(bytearray(lengths),)], "lengths binary").coalesce(1).write.parquet(f"{folder}/codes")
    discard(blocks)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as little-endian unsigned 32-bit integers), decoded from the files in folder. Each block is decoded on its own; what the blocks of one document give is joined, as CRC-32 is linear."""
    lengths = bytes(spark.read.parquet(f"{folder}/codes").first()["lengths"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            ids = unpack(row["n_ids"], row["checkpoints"], row["payload"], lengths).astype("<u4")
            ends = np.cumsum(row["n_tokens"])
            starts = ends - row["n_tokens"]
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            crc[-1] = crc_before(crc[-1], 4 * row["after"]) if row["after"] else crc[-1]
            first = row["first"] + starts
            first[0] -= row["before"]
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(first, pa.int64()), pa.array(row["n_tokens"], pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "crc"])

    blocks = spark.read.schema(FILE_SCHEMA).parquet(f"{folder}/blocks")
    found = blocks.mapInArrow(decode, "doc_id long, start long, n_tokens long, crc long")
    return found.groupBy("doc_id", "start").agg(F.sum("n_tokens").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))


def token_files(docs: DataFrame, stays: bool = False) -> DataFrame:
    """read_tokens() of what write_tokens() has written to a new shared folder, which stays after the application if so wanted."""
    folder = shared_folder(docs.sparkSession, stays)
    write_tokens(docs, public_file("byte_bpe_50k.json"), folder)
    return read_tokens(docs.sparkSession, folder)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"))
