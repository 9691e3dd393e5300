"""Token ids and counts with public tokenizer files.

Splicer encodes texts beyond a chunk's length in overlapping chunks and splices them.
PieceEncoder, for files of ids, encodes each distinct blank-separated piece that a
Python worker meets once. Both give exactly the ids of the library for the whole text.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from redactory.llm.common import size_runs, slices, table

#: A blank or line end after a character that is no white space. A byte-level pre-tokenizer never joins what stands before it with what follows, and what it does from there on doesn't depend on what stands before.
BREAK = re.compile(r"(?<=\S)(?=[ \n])")
#: What keeps a plain split at blanks and line ends from being one at BREAK: one of them at the start or after white space.
UNSURE = r"^[ \n]|[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}][ \n]|\x00"

#: Names of pieces that don't end where the next blank or line end begins, so that they can't be joined.
ODD = r"(?s)^$|^ |^\x00|.[ \n]|[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]$"

#: Characters of a chunk without its overlap, and of the overlap at first.
CHUNK, OVERLAP = 1 << 10, 1 << 7
#: Characters of text whose pieces are made distinct together.
TOGETHER = 1 << 22


def open_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


class PieceEncoder:
    """Ids of whole texts under a byte-level BPE without prefix blank.

    A piece is what stands between two BREAKs, with its blank or line end; a text's
    first piece has none. The pieces of a batch are made distinct, those not seen yet
    are joined, encoded by the library and cut where an id starts with a blank or a
    line end, and the texts' ids are gathered from the pieces'. kept bounds the
    number of pieces in memory; beyond it they are forgotten.
    """

    def __init__(self, path: str, kept: int = 450_000):
        spec = json.load(open(path, encoding="utf-8"))
        pre = spec["pre_tokenizer"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"] or any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in spec["added_tokens"]):
            raise ValueError("pieces are proven for byte-level BPE without normalizer and prefix blank only")
        self.tokenizer, self.kept = open_tokenizer(path), kept
        self.blank = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.blank[i] = token.startswith(("Ġ", "Ċ"))  # the byte-level alphabet's blank and line end
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[str, int] = {}  # by name, see _name
        self.heads: dict[str, int] = {}  # of a first piece
        self.ids, self.ends, self.n = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0  # ends[k]: where row k of ids ends

    def _add(self, ids: np.ndarray, lengths: np.ndarray) -> range:
        at = int(self.ends[self.n - 1]) if self.n else 0
        while at + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(lengths) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[at : at + len(ids)] = ids
        self.ends[self.n : self.n + len(lengths)] = at + np.cumsum(lengths)
        self.n += len(lengths)
        return range(self.n - len(lengths), self.n)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _name(piece: str) -> str:
        """A piece without its blank; with its line end; other pieces after a NUL."""
        if piece[0] == " " and piece[1:2] not in ("\n", "\0"):
            return piece[1:]
        return piece if piece[0] == "\n" else "\0" + piece

    @staticmethod
    def _piece(name: str) -> str:
        return name[1:] if name[:1] == "\0" else name if name[:1] == "\n" else " " + name

    def _learn(self, names: list[str]) -> None:
        odd = pc.match_substring_regex(pa.array(names, pa.string()), ODD)
        if alone := list(itertools.compress(names, odd.to_pylist())) if pc.any(odd).as_py() else []:
            apart = set(alone)
            names = [n for n in names if n not in apart]
        if names:
            pieces = [n if n[0] == "\n" else " " + n for n in names]
            ids = np.fromiter(itertools.chain.from_iterable(self._encode(["".join(pieces[i : i + 50]) for i in range(0, len(pieces), 50)])), np.uint32)
            starts = np.flatnonzero(self.blank[ids])
            self.rows.update(zip(names, self._add(ids, np.diff(starts, append=len(ids))), strict=True))
        if alone:
            self._learn_alone(alone, self.rows, self._piece)

    def _learn_alone(self, names: list[str], rows: dict[str, int], piece=str) -> None:
        ids = self._encode([piece(n) for n in names])
        rows.update(zip(names, self._add(np.fromiter(itertools.chain.from_iterable(ids), np.uint32), np.array([len(x) for x in ids])), strict=True))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """texts: strings without nulls."""
        if len(self.rows) + len(self.heads) > self.kept:
            self._forget()
        unsure = pc.match_substring_regex(texts, UNSURE)
        split = pc.split_pattern(pc.replace_substring(pc.if_else(unsure, "", texts), "\n", " \n"), " ")
        pieces, edges = split.flatten(), split.offsets.to_numpy()
        edges = edges - edges[0]
        if pc.any(unsure).as_py():
            whole = iter(texts.filter(unsure).to_pylist())
            both = [[x[0], *map(self._name, x[1:])] if u and (x := BREAK.split(next(whole))) else split[i].as_py() for i, u in enumerate(unsure.to_pylist())]
            pieces, edges = pa.array(itertools.chain.from_iterable(both), texts.type), np.cumsum([0, *map(len, both)])
        coded = pieces.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = edges[:-1]
        heads = pieces.take(pa.array(at)).to_pylist()
        found = list(map(self.rows.get, names))
        if new := [n for n, row in zip(names, found, strict=True) if row is None]:
            self._learn(new)
            found = [self.rows[n] if row is None else row for n, row in zip(names, found, strict=True)]
        if new := list({p for p in heads if p not in self.heads}):
            self._learn_alone(new, self.heads)
        rows = np.array(found, np.int64)[coded.indices.to_numpy()]
        rows[at] = np.fromiter(map(self.heads.__getitem__, heads), np.int64, len(heads))
        ends = self.ends[rows]
        lengths = ends - np.where(rows > 0, self.ends[rows - 1], 0)
        upto = np.cumsum(lengths)
        ids = self.ids[np.arange(upto[-1] if len(upto) else 0) + np.repeat(ends - upto, lengths)]
        total = np.concatenate([[0], upto])[edges]
        return [ids[a:b] for a, b in itertools.pairwise(total.tolist())]


class Splicer:
    """Encodes texts chunk by chunk with the tokenizers library and splices the chunks.

    A cut is a place where the pre-tokenizer has begun a new word of a chunk. Where it
    cuts depends on the text from the cut before it up to a few characters beyond, so a
    cut of a chunk that itself begins at one, margin characters or more before its end,
    is a cut of the whole text. Where such a cut is also one of the next chunk, both go
    on alike from there: that is the splice. If an overlap holds no such place, it is
    doubled on both sides, up to the last splice and to the end of the text.

    splices and widened count what was done.
    """

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        if not 0 < overlap <= chunk:
            raise ValueError("an overlap is not longer than a chunk")
        self.tokenizer, self.chunk, self.overlap = open_tokenizer(path), chunk, overlap
        spec = json.load(open(path, encoding="utf-8"))
        pre = spec["pre_tokenizer"]
        #: Cuts are proven for byte-level pre-tokenizers, which neither prefix a blank nor look at a changed text.
        self.sure = pre["type"] == "ByteLevel" and pre["use_regex"] and not pre.get("add_prefix_space") and not spec["normalizer"] and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        self.margin = max([0, *(len(t["content"]) for t in spec["added_tokens"])]) + 8
        self.splices = self.widened = 0

    def _encode(self, text: str, start: int, stop: int):
        return self.tokenizer.encode(text[start:stop], add_special_tokens=False)

    @staticmethod
    def _cut(encoding, place: int) -> int | None:
        """The number of the id that begins a word at place, if one does."""
        k = encoding.char_to_token(place)
        if k is None or encoding.token_to_chars(k)[0] != place:
            return None
        word = encoding.token_to_word(k)
        return k if k == 0 or word is None or word != encoding.token_to_word(k - 1) else None

    def _splice(self, one, start: int, other, begin: int, low: int, high: int) -> tuple[int, int, int] | None:
        """The last place from low to high that is a cut of both chunks, and the number of the id there in each."""
        for place in range(high, low - 1, -1):
            if (k := self._cut(one, place - start)) is not None and (j := self._cut(other, place - begin)) is not None:
                return place, k, j
        return None

    def _parts(self, text: str, known: dict[int, object]) -> Iterator[tuple[object, int, int]]:
        """Encodings, each with the first id that counts and the one after the last. known: encodings of chunks by their start, for overlaps of the usual width."""
        n, start, stop, head, floor = len(text), 0, min(len(text), self.chunk + self.overlap), 0, 0
        one = known.get(0) or self._encode(text, start, stop)
        while stop < n:
            overlap, begin = self.overlap, stop - self.overlap
            end = min(n, begin + self.chunk + self.overlap)
            other = known.get(begin) or self._encode(text, begin, end)
            while not (found := self._splice(one, start, other, begin, max(begin + 1, floor), stop - self.margin)):
                self.widened += 1
                overlap *= 2
                stop = min(n, stop + overlap)
                one = self._encode(text, start, stop)
                if stop == n:
                    break
                begin, end = max(floor, stop - 2 * overlap), min(n, stop + self.chunk)
                other = self._encode(text, begin, end)
            if not found:
                break
            self.splices += 1
            yield one, head, found[1]
            floor, start, stop, one, head = found[0], begin, end, other, found[2]
        yield one, head, len(one)

    def _chunks(self, texts: list[str]) -> Iterator[tuple[str, dict[int, object]]]:
        """Long texts, each with its chunks' encodings, a batch of chunks at a time."""
        spans = [[(a, min(len(t), a + self.chunk + self.overlap)) for a in range(0, max(1, len(t) - self.overlap), self.chunk)] for t in texts]
        for group in size_runs(map(len, texts), TOGETHER):
            both = [(k, a, b) for k in group for a, b in spans[k][: TOGETHER // self.chunk]]  # of a huge text the first ones; the others are encoded one by one
            coded = iter(self.tokenizer.encode_batch([texts[k][a:b] for k, a, b in both], add_special_tokens=False))
            for k in group:
                yield texts[k], {a: next(coded) for a, _ in spans[k][: TOGETHER // self.chunk]}

    def _long(self, text: str) -> bool:
        return self.sure and len(text) > self.chunk + self.overlap

    def counts(self, texts: list[str]) -> list[int]:
        """The number of ids of each text."""
        out = [0] * len(texts)
        long = [k for k, t in enumerate(texts) if self._long(t)]
        apart = set(long)
        short = [k for k in range(len(texts)) if k not in apart]
        for k, e in zip(short, self.tokenizer.encode_batch_fast([texts[k] for k in short], add_special_tokens=False), strict=True):
            out[k] = len(e)
        for k, (text, known) in zip(long, self._chunks([texts[k] for k in long]), strict=True):
            out[k] = sum(b - a for _, a, b in self._parts(text, known))
        return out

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text."""
        if not self._long(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.concatenate([np.array(e.ids[a:b], np.uint32) for e, a, b in self._parts(text, {})])


@lru_cache(maxsize=4)
def pieces_of(path: str) -> PieceEncoder:
    return PieceEncoder(path)


@lru_cache(maxsize=4)
def splicer_of(path: str, chunk: int, overlap: int) -> Splicer:
    return Splicer(path, chunk, overlap)


@lru_cache(maxsize=4)
def sentencepiece_of(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), n_chunks (that the text was encoded in) for each row of docs (doc_id, text; other columns are left alone).

    path: a tokenizers .json or a sentencepiece .model, which every executor has.
    Null counts as empty: no bytes, no tokens. Texts beyond a chunk and its overlap are
    encoded in overlapping chunks and spliced; where no cut is proven for the tokenizer
    (.model files, normalizers, other pre-tokenizers) a text is one chunk. A very long
    text is one task's, which holds the text and some chunks' ids at a time. Repeated
    rows give repeated results, an empty table an empty one.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = sentencepiece_of(path) if path.endswith(".model") else None
        splicer = None if whole else splicer_of(path, chunk, overlap)
        for batch in slices(batches):
            texts = pc.fill_null(batch.column(1), "")
            n, chunks = [], []
            for group in size_runs(pc.utf8_length(texts).to_pylist(), TOGETHER):
                own = texts.slice(group.start, len(group)).to_pylist()
                n += [len(whole.encode(t)) for t in own] if whole else splicer.counts(own)
                chunks += [1 + (len(t) - overlap - 1) // chunk if splicer and splicer._long(t) else 1 for t in own]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pc.binary_length(texts).cast(pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_()), pa.array(chunks, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "n_chunks"],
            )

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chunks long")


def public_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_file("byte_bpe_50k.json"))
