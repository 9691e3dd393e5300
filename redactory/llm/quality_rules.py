"""Quality rules with compression bands.

Base rules count words, symbols, repeated lines and repeated word windows. The
texts that pass them are judged by zstandard: the ratio of the whole text and of
each of its chunks must lie in a band that depends on the length of what was
compressed, as short texts compress less. A ratio above the band means repetition
or few different words, one below it noise. Every byte is in a chunk: the last one
is as short as the rest of the text, and judged by the band of its own length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from redactory.llm.common import slices, table

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """knots: bytes, least and greatest ratio there, by rising length; between two knots the limits go straight along the logarithm of the length. chunk: bytes of a chunk. At most share_bad of a text's chunks may be outside their bands, and at most run_bad one after the other."""

    knots: tuple[tuple[int, float, float], ...] = (
        (1, 0.0, 0.95), (16, 0.5, 0.95), (32, 0.62, 1.0), (64, 0.75, 1.22), (90, 0.88, 1.45), (128, 1.0, 1.62), (256, 1.18, 1.8), (512, 1.3, 1.92), (1024, 1.45, 2.06), (2048, 1.6, 2.18), (4096, 1.75, 2.3), (8192, 1.9, 2.45), (16384, 2.0, 2.58), (32768, 2.05, 2.72), (65536, 2.1, 2.9), (1 << 20, 2.2, 3.4),
    )
    chunk: int = 2048
    share_bad: float = 0.25
    run_bad: int = 2
    level: int = 3

    def outside(self, sizes: list[int], ratios: list[float]) -> np.ndarray:
        at, least, most = np.array(self.knots).T
        x, r = np.log2(np.maximum(sizes, 1)), np.array(ratios)
        return (r < np.interp(x, np.log2(at), least)) | (r > np.interp(x, np.log2(at), most))


DEFAULT = Bands()

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, n_chunks long, n_bad_chunks long, base_failed boolean, kept boolean"


def repeat_words(words: list[bytes], width: int = 8) -> int:
    """Words inside windows of width words that the text has twice or more. Windows are named exactly by doubling: names of pairs of names."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    names = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(names) == len(words):
        return 0
    ids = np.fromiter(map(names.__getitem__, words), np.int64, len(words))
    step = 1
    while step < width:
        pairs = ids[:-step] * (int(ids.max()) + 1) + ids[step:]
        _, ids = np.unique(pairs, return_inverse=True)
        step *= 2
    again = np.flatnonzero(np.bincount(ids)[ids] > 1)
    if not len(again):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + width, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def duplicate_lines(text: str) -> int:
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif line.strip(" \t\n\x0b\x0c\r"):
            seen.add(line)
    return n


def compression(raw: bytes, bands: Bands, press: zstandard.ZstdCompressor) -> tuple[float, int, int, bool]:
    """Ratio of the whole, number of chunks, of those outside their band, and the verdict. An empty text has no chunks and is inside."""
    if not raw:
        return 0.0, 0, 0, True
    parts = [raw[i : i + bands.chunk] for i in range(0, len(raw), bands.chunk)]
    ratio = len(raw) / len(press.compress(raw))
    bad = bands.outside([len(p) for p in parts], [len(p) / len(press.compress(p)) for p in parts] if len(parts) > 1 else [ratio])
    edges = np.flatnonzero(np.diff(bad, prepend=False, append=False)).reshape(-1, 2)
    n, run = int(bad.sum()), int((edges[:, 1] - edges[:, 0]).max(initial=0))
    whole = bool(bands.outside([len(raw)], [ratio])[0])
    return ratio, len(parts), n, not whole and n <= bands.share_bad * len(parts) and run <= bands.run_bad


def rules(docs: DataFrame, bands: Bands = DEFAULT) -> DataFrame:
    """A row per row of docs (doc_id, text; other columns are left alone), as in SCHEMA.

    Words are runs of characters other than space and U+0009 to U+000D. A null or
    empty text has no words and fails the base rules, as does any text of under 20
    words, or with over 30 % of its words in repeated windows of 8 words. kept: the
    base rules and the compression bands both pass. Repeated rows give repeated
    results. A very long text is judged in one piece and in all its chunks, by the
    task that has its row. An empty table gives an empty result.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=bands.level)
        for batch in slices(batches):
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                raw = text.encode()
                words = raw.split()
                n, again = len(words), repeat_words(words)
                chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
                symbols = sum(map(text.count, SYMBOLS))
                failed = n < 20 or 100 * again > 30 * n
                ratio, chunks, bad, good = compression(raw, bands, press)
                out.append((doc_id, n, chars, symbols, duplicate_lines(text), again, ratio, chunks, bad, failed, not failed and good))
            columns = zip(*out, strict=True) if out else [[]] * 11
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], names=NAMES)

    return docs.select("doc_id", "text").mapInArrow(judge, SCHEMA)


NAMES = [part.split()[0] for part in SCHEMA.split(", ")]
TYPES = [{"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[part.split()[1]] for part in SCHEMA.split(", ")]


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(table(spark, sf_dir, "documents"))
