"""Substring deduplication by blockwise suffix sorting with a difference-cover sample.

Documents go, in the order of their ids, into blocks of a few megabytes, so that a
string that an earlier block holds is one of a smaller doc_id. A suffix matters by
its first WIDTH bytes only, so the order sought is that of these.

Of equal texts only the one with the smallest doc_id takes part; the others go as a
whole. The rest takes two rounds and a last step:

1. Grams. The least hash of the GRAM bytes long strings in a suffix's first WIDTH
   bytes names the suffix; neighbours mostly share it. A suffix whose name no other
   document has stands nowhere else and is left out. Here a collision of hashes
   costs only work.
2. Buckets. Runs of neighbouring suffixes of one name go, as the bytes that they
   cover, to the name's bucket. Each bucket is sorted on its own, by bytes. Suffixes
   that their first STEP bytes leave tied are told apart by the ranks of a
   difference-cover sample, sorted before: for any two suffixes some shift below
   PERIOD takes both into the sample, and the sample's order, with the lengths of the
   common prefixes of its neighbours, gives ranks for every depth. A suffix's answer
   is whether an equal one stands in a document with a smaller doc_id.
3. Each block marks the bytes of the suffixes that do.

A block sends each name and each run of bytes once, packed, and is answered with one
bit per name and suffix. Neither a frequent string nor a large group of copies makes
one task's share grow with the number of its documents; it grows with that of the
blocks. A bucket with more than PASS suffixes is sorted in passes, so that its bytes
are all that grows with it.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.llm.common import discard, id_back, id_key, slices, stored, table

WIDTH, GRAM = 50, 30
#: A perfect difference set: each remainder by PERIOD but 0 is the difference of just one pair.
PERIOD, COVER = 7, (1, 2, 4)
#: Bytes by which suffixes are sorted first; PERIOD at least, so that a shift into the sample leaves out none.
STEP = 8
#: Bytes of text after which a block is closed, and the most documents of one.
BLOCK, MOST_DOCS = 4 << 20, 60_000
#: Bytes of text for each bucket.
BUCKET = 16 << 20
#: What blocks and buckets grow to.
MOST_BLOCK, MOST_BUCKET = 64 << 20, 128 << 20
#: Suffixes that are sorted together.
PASS = 1 << 20

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= M2
    h ^= h >> np.uint64(29)
    h *= M3
    h ^= h >> np.uint64(32)
    return h


def words(data: np.ndarray, kind: str = "<u8") -> np.ndarray:
    """The eight bytes from each place, as a number."""
    return np.ndarray((max(len(data) - 7, 0),), kind, data, strides=(1,))


def rolled(data: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of the width bytes from each place that has so many."""
    n = max(len(data) - width + 1, 0)
    each = words(data)
    h = np.full(n, M1)
    for k in [*range(0, width - 8, 8), width - 8]:
        h ^= each[k : k + n]
        h *= M1
        h ^= h >> np.uint64(31)
    return mixed(h)


def least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of the width values from each place."""
    n, low, step = len(h) - width + 1, h, 1
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    return np.minimum(low[:n], low[width - step : width - step + n])


def packed(keys: np.ndarray) -> bytes:
    """Rising 64-bit keys: the low halves as they are, the steps of the high halves compressed."""
    high = (keys >> np.uint64(32)).astype("<u4")
    steps = np.diff(high, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    squeezed = zstandard.ZstdCompressor(level=1).compress(steps)
    return len(squeezed).to_bytes(4, "little") + squeezed + keys.astype("<u4").tobytes()


def opened(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    steps = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[4 : 4 + n]), np.uint8).reshape(4, -1).T
    high = np.cumsum(np.ascontiguousarray(steps).view("<u4").reshape(-1), dtype=np.uint32)
    return high.astype(np.uint64) << np.uint64(32) | np.frombuffer(raw, "<u4", offset=4 + n).astype(np.uint64)


def bits(flags: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.packbits(flags).tobytes())


def flags(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8), count=n).view(bool)


class Block:
    """The texts of a block: data (their bytes, one after the other), lengths, ends, and owner (the number of each text's doc_id)."""

    def __init__(self, row: dict):
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["raw"]), np.uint8)
        self.lengths = np.array(row["lengths"], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.owner = np.cumsum(np.diff(np.array(row["keys"], np.int64), prepend=row["keys"][:1]) != 0)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First place, place after the last, and name: neighbouring suffixes of WIDTH bytes, inside one document, that share their name."""
        n = len(self.data) - WIDTH + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        low = least(rolled(self.data, GRAM), WIDTH - GRAM + 1)
        whole = np.ones(n, bool)
        tails = np.minimum(self.lengths, WIDTH - 1)
        upto = np.cumsum(tails)
        short = np.arange(upto[-1]) - np.repeat(upto - tails, tails) + np.repeat(self.ends - tails, tails)
        whole[short[short < n]] = False
        new = np.ones(n, bool)
        new[1:] = (low[1:] != low[:-1]) | (whole[1:] != whole[:-1])
        first = np.flatnonzero(new)
        stop = np.append(first[1:], n)
        taken = whole[first]
        return first[taken], stop[taken], low[first[taken]]

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return self.owner[np.searchsorted(self.ends, places, side="right")]


def grouped(keys: np.ndarray, kind: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts keys; the keys, each once; the number of each sorted one; where each begins."""
    order = np.argsort(keys, kind=kind)
    keys = keys[order]
    new = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    return order, keys[new], np.repeat(np.arange(len(new)), np.diff(new, append=len(keys))), new


def names_of(block: Block) -> np.ndarray:
    names = np.sort(block.runs()[2])
    return names[np.flatnonzero(np.diff(names, prepend=~names[:1]))]


def ranked(keys: np.ndarray) -> np.ndarray:
    """The rank of each key among the different ones."""
    order, _, number, _ = grouped(keys)
    out = np.empty(len(keys), np.int64)
    out[order] = number
    return out


class Runs:
    """The runs of a block whose names other documents have as well, and their distinct bytes in the order of their names."""

    def __init__(self, block: Block, told):
        """told(names): for each name, sorted and each once, whether another block has it."""
        first, stop, name = block.runs()
        order, names, number, new = grouped(name, "stable")
        first, stop, doc = first[order], stop[order], block.doc_of(first[order])
        if len(new):
            several = np.minimum.reduceat(doc, new) != np.maximum.reduceat(doc, new)
            tied = (several | told(names))[number]
            first, stop, doc, name = first[tied], stop[tied], doc[tied], names[number[tied]]
        self.first, self.stop, self.doc = first, stop, doc
        raw = block.data.tobytes()
        known: dict[bytes, int] = {}
        self.number = np.fromiter((known.setdefault(raw[a : b + WIDTH - 1], len(known)) for a, b in zip(first.tolist(), stop.tolist(), strict=True)), np.int64, len(first))  # places of a name rise, so a run's first place is in its smallest document
        self.bytes = list(known)
        self.leader = np.flatnonzero(np.diff(np.maximum.accumulate(self.number), prepend=-1)) if len(first) else np.zeros(0, np.int64)
        self.name = name[self.leader]

    def sizes(self) -> np.ndarray:
        """Suffixes of each distinct run."""
        return self.stop[self.leader] - self.first[self.leader]

    def marked(self, repeats: np.ndarray, n: int) -> np.ndarray:
        """Which of n bytes lie in suffixes that repeat. repeats: a bit per suffix of the distinct runs. A run that a smaller document of the block has repeats as a whole."""
        size = self.sizes()
        begin = np.cumsum(size) - size
        lead = self.doc[self.leader][self.number]
        own = size[self.number]
        places = np.repeat(self.first - np.cumsum(own) + own, own) + np.arange(own.sum())
        hit = repeats[np.repeat(begin[self.number] - np.cumsum(own) + own, own) + np.arange(own.sum())] | np.repeat(self.doc > lead, own)
        edge = np.zeros(n + WIDTH + 1, np.int32)
        np.add.at(edge, places[hit], 1)
        np.add.at(edge, places[hit] + WIDTH, -1)
        return np.cumsum(edge)[:n] > 0


def sample_order(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at places by their first WIDTH bytes, and how many bytes each shares with the one before it. data has WIDTH bytes or more beyond each place."""
    each = words(data, ">u8")
    depths = [*range(0, WIDTH - 8, 8), WIDTH - 8]
    keys = [each[places + k].astype(np.uint64) for k in depths]
    rank = ranked(keys[-1])
    for key in keys[-2::-1]:
        rank = ranked(ranked(key) << 32 | rank)
    order = np.argsort(rank)
    shared = np.full(len(places), WIDTH)
    open_ = np.ones(len(places), bool)
    for k, key in zip(depths, keys, strict=True):
        key = key[order]
        other = np.append(np.uint64(0), key[1:] ^ key[:-1])
        differ = open_ & (other != 0)
        shared[differ] = k + sum((other[differ] < np.uint64(1 << 8 * b)).astype(np.int64) for b in range(1, 8))
        open_ &= ~differ
    shared[:1] = 0
    return order, shared


def repeated(data: np.ndarray, places: np.ndarray, age: np.ndarray) -> np.ndarray:
    """For each suffix whether one of lower age has the same first WIDTH bytes. data has 2 * WIDTH bytes or more beyond each place."""
    out = np.zeros(len(places), bool)
    order, _, number, new = grouped(words(data, ">u8")[places].astype(np.uint64))
    if not len(new):
        return out
    tied = np.minimum.reduceat(age[order], new) != np.maximum.reduceat(age[order], new)
    group = np.empty(len(places), np.int64)
    group[order] = number
    left = np.flatnonzero(tied[group])  # STEP bytes tell the others apart
    if not len(left):
        return out
    at, age, group = places[left], age[left], group[left]
    covered = np.isin(np.arange(2 * PERIOD), (*COVER, *(c + PERIOD for c in COVER)))
    remainder = at % PERIOD
    own = [np.flatnonzero(covered[remainder + d]) for d in range(PERIOD)]
    sampled = np.zeros(len(data), bool)
    for d in range(PERIOD):
        sampled[at[own[d]] + d] = True
    sample = np.flatnonzero(sampled)
    by_bytes, shared = sample_order(data, sample)
    place = np.zeros(len(data), np.int32)  # in the order of bytes, of each place of the sample
    place[sample[by_bytes]] = np.arange(len(sample))
    hit = np.zeros(len(left), bool)
    for d in range(PERIOD):
        if not len(own[d]):
            continue
        rank = np.cumsum(shared < WIDTH - d)  # of the sample, by the bytes that the shift leaves
        order, _, number, new = grouped(group[own[d]] * (len(sample) + 1) + rank[place[at[own[d]] + d]])
        old = age[own[d]][order]
        hit[own[d][order]] |= old > np.minimum.reduceat(old, new)[number]
    out[left] = hit
    return out


def split_keys(keys: np.ndarray, buckets: int) -> list[np.ndarray]:
    """For each bucket, the numbers of its keys, in their order."""
    bucket = (mixed(keys * M2) & np.uint64(buckets - 1)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    return np.split(order, np.cumsum(np.bincount(bucket, minlength=buckets))[:-1])


def copies(rows: DataFrame) -> DataFrame:
    """rows: k, digest (of a text of WIDTH bytes or more). k, digest of those whose text a smaller k has; repeated rows are repeated."""
    first = stored(rows.groupBy("digest").agg(F.min("k").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"))  # a table of its own, so that Spark can split a large group in the join
    return rows.join(first, "digest").where(F.col("k") > F.col("first")).select("k", "digest")


def blocks(docs: DataFrame, block_bytes: int = BLOCK) -> DataFrame:
    """block (rising with doc_id), keys, lengths and raw (compressed bytes) of whole documents; copy_keys and copy_lengths of copies among them. Rows of one doc_id may fill many blocks; begun() tells them apart."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        keys: list[int] = []
        parts: list[bytes] = []
        copied: list[tuple[int, int]] = []
        size, whole = 0, None

        def close() -> pa.RecordBatch:
            nonlocal n, keys, parts, copied, size
            row = ((part << 32) + n, keys, [len(p) for p in parts], zstandard.ZstdCompressor(level=3).compress(b"".join(parts)), [k for k, _ in copied], [c for _, c in copied])
            n, keys, parts, copied, size = n + 1, [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, BLOCK_TYPES, strict=True)], names=BLOCK_NAMES)

        for batch in slices(batches):
            for k, digest, copy, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if copy:
                    whole = (k, digest)
                    continue
                if size >= block_bytes or len(keys) + len(copied) >= MOST_DOCS:
                    yield close()
                raw = (text or "").encode()
                if (k, digest) == whole:
                    copied.append((k, len(raw)))
                else:
                    keys.append(k)
                    parts.append(raw)
                    size += len(raw)
        if keys or copied:
            yield close()

    rows = docs.select(id_key().alias("k"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), "text")
    marks = copies(rows.where(F.octet_length("text") >= WIDTH).select("k", "digest")).select("k", "digest", F.lit(True).alias("copy"), F.lit(None).cast("string").alias("text"))  # a mark comes just before the texts that it is about
    both = rows.select("k", "digest", F.lit(False).alias("copy"), "text").unionByName(marks)
    ranged = both.repartitionByRange("k", "digest").sortWithinPartitions("k", "digest", F.col("copy").desc())
    return ranged.mapInArrow(build, BLOCK_SCHEMA)


BLOCK_SCHEMA = "block long, keys array<long>, lengths array<long>, raw binary, copy_keys array<long>, copy_lengths array<long>"
BLOCK_NAMES = ["block", "keys", "lengths", "raw", "copy_keys", "copy_lengths"]
BLOCK_TYPES = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]


def begun(held: DataFrame) -> DataFrame:
    """block, head, head_doc: for blocks that go on with a doc_id of blocks before, the first block that has it, and its number there."""
    edges = held.where(F.size("keys") > 0).select("block", F.element_at("keys", 1).alias("first"), F.element_at("keys", -1).alias("last"), (F.size(F.array_distinct("keys")) - 1).cast("long").alias("doc"))
    ends = edges.groupBy(F.col("last").alias("first")).agg(F.min(F.struct(F.col("block").alias("head"), F.col("doc").alias("head_doc"))).alias("e"))
    return edges.select("block", "first").join(ends, "first").where(F.col("e.head") < F.col("block")).select("block", "e.head", "e.head_doc")


def whole_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time, as each may hold a block."""
    for batch in slices(batches, 1):
        yield batch.to_pylist()[0]


def messages(bucket_of: list[tuple[int, int]], **columns: list) -> pa.RecordBatch:
    keys = {"bucket": pa.array([b for b, _ in bucket_of], pa.int32()), "block": pa.array([k for _, k in bucket_of], pa.int64())}
    return pa.RecordBatch.from_pydict(keys | {n: pa.array(v, pa.binary()) for n, v in columns.items()})


def sent_names(held: DataFrame, buckets: int) -> DataFrame:
    """bucket, block, keys: the names of each block, each once, sorted and packed."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in whole_rows(batches):
            names = names_of(Block(row))
            parts = [(b, packed(names[own])) for b, own in enumerate(split_keys(names, buckets)) if len(own)]
            yield messages([(b, row["block"]) for b, _ in parts], keys=[p for _, p in parts])

    return held.mapInArrow(send, "bucket int, block long, keys binary")


def seen_elsewhere(names: DataFrame) -> DataFrame:
    """block, answers: for each block and bucket, a bit per name: whether another block has it."""

    def sort_bucket(group: pa.Table) -> pa.Table:
        own = [opened(k.as_py()) for k in group["keys"]]
        every = np.sort(np.concatenate(own))
        shared = np.append(np.unique(every[1:][every[1:] == every[:-1]]), np.uint64(0))
        found = [np.searchsorted(shared[:-1], k) for k in own]
        out = [bits((shared[at] == k) & (at < len(shared) - 1)) for at, k in zip(found, own, strict=True)]
        return pa.table({"bucket": group["bucket"], "block": group["block"], "bits": pa.array(out, pa.binary())})

    return collected(names.groupBy("bucket").applyInArrow(sort_bucket, "bucket int, block long, bits binary"))


def collected(answers: DataFrame) -> DataFrame:
    return answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))


def told_by(answers: list[dict] | None, buckets: int):
    """A function that gives the bits of names, each once and sorted, from the answers of the buckets."""
    got = {a["bucket"]: a["bits"] for a in answers or ()}

    def told(names: np.ndarray) -> np.ndarray:
        out = np.zeros(len(names), bool)
        for b, own in enumerate(split_keys(names, buckets)):
            if len(own):
                out[own] = flags(got[b], len(own))
        return out

    return told


def sent_runs(sifted: DataFrame, buckets: int) -> DataFrame:
    """bucket, block, bytes (of distinct runs, one after the other), shape (length and document of each, as 32-bit integers; both compressed), head, head_doc (as in begun(); else the block itself, and 0)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for row in whole_rows(batches):
            runs = Runs(Block(row), told_by(row["answers"], buckets))
            doc = runs.doc[runs.leader]
            size = runs.sizes() + WIDTH - 1
            parts = []
            for b, own in enumerate(split_keys(runs.name, buckets)):
                if len(own):
                    shape = np.concatenate([size[own], doc[own]]).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
                    parts.append((b, press.compress(b"".join([runs.bytes[k] for k in own.tolist()])), press.compress(shape)))
            sent = messages([(b, row["block"]) for b, *_ in parts], bytes=[x for _, x, _ in parts], shape=[x for *_, x in parts])
            head = (row["block"], 0) if row["head"] is None else (row["head"], row["head_doc"])
            yield pa.RecordBatch.from_arrays([*sent.columns, *(pa.array([h] * len(sent), pa.int64()) for h in head)], names=[*sent.schema.names, "head", "head_doc"])

    return sifted.mapInArrow(send, "bucket int, block long, bytes binary, shape binary, head long, head_doc long")


def repeated_in(rows: list[tuple[bytes, bytes]], most: int = PASS, begins: list[tuple[int, int, int]] | None = None) -> list[np.ndarray]:
    """rows: bytes and shape of a bucket's messages, by rising block. begins: for each a number that rises with the block, that of the block in which its first document began, and the document's number there; each its own without. For each a bit per suffix of its runs: whether a smaller document has its first WIDTH bytes. Of equal runs only the first is looked into, as none is in a smaller document."""
    open_ = zstandard.ZstdDecompressor()
    known: dict[bytes, int] = {}
    ages, messages_of, sizes = [], [], []
    for (raw, shape), (own, head, head_doc) in zip(rows, begins or [(k, k, 0) for k in range(len(rows))], strict=True):
        raw = open_.decompress(raw)
        size, doc = np.frombuffer(open_.decompress(shape), np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(2, -1).astype(np.int64)
        ends, before = np.cumsum(size), len(known)
        number = np.fromiter((known.setdefault(raw[a:b], len(known)) for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True)), np.int64, len(size))
        age = np.where(doc == 0, (head << 32) + head_doc, (own << 32) + doc)
        fresh = number >= before
        sizes.append(size[fresh] - WIDTH + 1)
        ages.append(age[fresh])
        messages_of.append((number, size - WIDTH + 1, age))
    first, n_known = np.concatenate(ages), np.concatenate(sizes)
    found = repeated_suffixes(list(known), first, most)
    begin = np.cumsum(n_known) - n_known
    out = []
    for number, n, age in messages_of:
        upto = np.cumsum(n)
        out.append(found[np.repeat(begin[number] - upto + n, n) + np.arange(n.sum())] | np.repeat(age > first[number], n))
    return out


def repeated_suffixes(runs: list[bytes], age: np.ndarray, most: int) -> np.ndarray:
    """A bit per suffix of different runs, each with its age: whether an older run has its first WIDTH bytes. With over most suffixes, equal ones share a pass."""
    size = np.fromiter(map(len, runs), np.int64, len(runs))
    data = np.frombuffer(b"".join([*runs, bytes(2 * WIDTH)]), np.uint8)
    n = size - WIDTH + 1
    total = int(n.sum())
    out = np.zeros(total, bool)
    passes = -(-total // most)
    if passes > 1:
        turn = np.empty(len(data) - 2 * WIDTH, np.uint32)
        for at in range(0, len(turn), 1 << 20):
            part = rolled(data[at : min(at + (1 << 20), len(turn)) + WIDTH - 1], WIDTH)
            turn[at : at + len(part)] = (part >> np.uint64(20)) % np.uint64(passes)
    ends, begin = np.cumsum(n), np.cumsum(size) - size
    for p in range(passes):
        places, numbers = [], []
        for at in range(0, len(n), 1 << 16):
            part = slice(at, at + (1 << 16))
            number = np.arange(ends[part][0] - n[part][0], ends[part][-1])
            place = np.repeat(begin[part] - (ends[part] - n[part]), n[part]) + number
            if passes > 1:
                mine = turn[place] == p
                place, number = place[mine], number[mine]
            places.append(place)
            numbers.append(number)
        place, number = np.concatenate(places), np.concatenate(numbers)
        out[number] = repeated(data, place, age[np.searchsorted(ends, number, side="right")])
    return out


def sorted_buckets(runs: DataFrame) -> DataFrame:
    """block, answers: for each block and bucket, a bit per suffix of its runs. One bucket is sorted at a time."""

    def sort_bucket(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        block, head = group["block"].to_numpy(), group["head"].to_numpy()
        rank = np.unique(np.concatenate([block, head]), return_inverse=True)[1].astype(np.int64)
        begins = list(zip(rank[: len(block)].tolist(), rank[len(block) :].tolist(), group["head_doc"].to_pylist(), strict=True))
        found = repeated_in(list(zip(group["bytes"].to_pylist(), group["shape"].to_pylist(), strict=True)), begins=begins)
        return pa.table({"bucket": group["bucket"], "block": group["block"], "bits": pa.array([bits(f) for f in found], pa.binary())})

    return collected(runs.groupBy("bucket").applyInArrow(sort_bucket, "bucket int, block long, bits binary"))


def grown(total: int, least: int, most: int) -> int:
    """Bytes that grow with the square root of the total beyond a gigabyte, so that blocks times buckets grow in proportion to it, until a task could not hold them."""
    return min(most, int(least * max(1.0, total / 2**30) ** 0.5))


def remove_repeats(docs: DataFrame, block_bytes: int | None = None, bucket_bytes: int | None = None) -> DataFrame:
    """doc_id, n_bytes, spans (removed byte ranges, half-open, maximal), kept (the remaining bytes) for each row of docs (doc_id, text; other columns are left alone).

    Texts are UTF-8 bytes, null counts as empty. A byte goes if a string of WIDTH
    bytes over it also starts in a document with a smaller doc_id. Rows with equal
    doc_id don't count against each other, and may be many; null is the smallest doc_id. Texts of
    fewer bytes keep all. A very long text is a block of its own, held by one task.
    An empty table gives an empty result.

    block_bytes, bucket_bytes: text for each block and bucket, else by the input's size.
    Messages are blocks times buckets at most: in proportion to the input up to some
    hundred gigabytes, beyond with its square over 2^53 bytes.
    """
    if block_bytes is None or bucket_bytes is None:
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        block_bytes, bucket_bytes = block_bytes or grown(total, BLOCK, MOST_BLOCK), bucket_bytes or grown(total, BUCKET, MOST_BUCKET)
    held = stored(blocks(docs, block_bytes))
    total = held.select(F.sum(F.expr("aggregate(lengths, 0L, (a, b) -> a + b)"))).first()[0] or 0
    buckets = 1 << max(4, (total // bucket_bytes).bit_length())
    named = stored(seen_elsewhere(sent_names(held, buckets)))
    told = named.join(stored(begun(held)), "block", "full")
    sifted = held.join(told, "block", "left")
    order = stored(sorted_buckets(sent_runs(sifted, buckets)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in whole_rows(batches):
            block = Block(row)
            runs = Runs(block, told_by(row["answers"], buckets))
            size = runs.sizes()
            ends = np.cumsum(size)
            repeats = np.zeros(ends[-1] if len(ends) else 0, bool)
            got = {a["bucket"]: a["bits"] for a in row["order"] or ()}
            for b, own in enumerate(split_keys(runs.name, buckets)):
                if len(own):
                    n = size[own]
                    upto = np.cumsum(n)
                    repeats[np.repeat((ends - size)[own] - upto + n, n) + np.arange(upto[-1])] = flags(got[b], int(upto[-1]))
            gone = runs.marked(repeats, len(block.data))
            kept, spans = [], []
            for a, b in itertools.pairwise([0, *block.ends.tolist()]):
                mask = gone[a:b]
                turns = np.flatnonzero(np.diff(mask, prepend=False, append=False)).reshape(-1, 2).tolist()
                kept.append(block.data[a:b][~mask].tobytes() if turns else block.data[a:b].tobytes())
                spans.append([{"start": s, "end": e} for s, e in turns])
            spans += [[{"start": 0, "end": n}] for n in row["copy_lengths"]]
            kept += [b""] * len(row["copy_keys"])
            yield pa.RecordBatch.from_arrays([pa.array(row["keys"] + row["copy_keys"], pa.int64()), pa.array(row["lengths"] + row["copy_lengths"], pa.int64()), pa.array(spans, SPANS), pa.array(kept, pa.binary())], names=["k", "n_bytes", "spans", "kept"])

    answered = sifted.join(order.withColumnRenamed("answers", "order"), "block", "left")
    done = answered.mapInArrow(cut, "k long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
    return done.select(id_back("k").alias("doc_id"), "n_bytes", "spans", "kept")


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
