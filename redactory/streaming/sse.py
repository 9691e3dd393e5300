"""Server-sent events and placeholder restoring over byte or text chunks, in batch and as streams."""

from __future__ import annotations

import codecs
import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from redactory.sources.tables import slices

#: Most bytes of one event.
MOST = 1 << 20


class BrokenStream(ValueError):
    """TRUNCATED: the stream ends inside an event; TOO_LARGE: an event is. Its text is the error code."""


@dataclass(frozen=True)
class Event:
    name: str | None
    data: str
    id: str | None = None
    retry: int | None = None


@dataclass
class EventParser:
    """Events from text in any chunks: CR, LF or CRLF line ends, comments, several data lines. An id holds for later events too."""

    rest: str = ""
    name: str | None = None
    data: list[str] = field(default_factory=list)
    size: int = 0
    id: str | None = None
    retry: int | None = None

    def feed(self, text: str) -> Iterator[Event]:
        text = self.rest + text
        held = text.endswith("\r")  # its LF may come next
        lines = re.split(r"\r\n|\r|\n", text[:-1] if held else text)
        self.rest = lines.pop() + ("\r" if held else "")
        for line in lines:
            self.size += len(line.encode())
            if self.size > MOST:
                raise BrokenStream("TOO_LARGE")
            if not line:
                if self.data:
                    yield Event(self.name, "\n".join(self.data), self.id, self.retry)
                self.name, self.data, self.size, self.retry = None, [], 0, None
                continue
            key, _, value = line.partition(":")
            value = value.removeprefix(" ")
            if key == "data":
                self.data.append(value)
            elif key == "event":
                self.name = value
            elif key == "id" and "\0" not in value:
                self.id = value
            elif key == "retry" and value.isascii() and value.isdigit():
                self.retry = int(value)
        if len(self.rest.encode()) > MOST:
            raise BrokenStream("TOO_LARGE")

    def close(self) -> Iterator[Event]:
        if self.rest.endswith("\r"):
            yield from self.feed("\n")
        if self.rest or self.data:
            raise BrokenStream("TRUNCATED")


class StreamReader:
    """Rows of one stream: its events, and a last one with an error if it breaks; what comes after that is not read."""

    def __init__(self, stream: object):
        self.stream, self.n, self.broken = stream, 0, False
        self.parser, self.decoder = EventParser(), codecs.getincrementaldecoder("utf-8")()

    def rows(self, chunk: bytes, last: bool = False) -> Iterator[tuple]:
        if self.broken:
            return
        try:
            events = self.parser.feed(self.decoder.decode(chunk, last))
            for e in itertools.chain(events, self.parser.close()) if last else events:
                yield self.stream, self.n, e.name, e.data, e.id, e.retry, None
                self.n += 1
        except (BrokenStream, UnicodeDecodeError) as e:
            self.broken = True
            yield self.stream, self.n, None, None, None, None, str(e) if isinstance(e, BrokenStream) else "ENCODING"


EVENTS = pa.schema([("stream_id", pa.int64()), ("n", pa.int64()), ("event", pa.string()), ("data", pa.string()), ("id", pa.string()), ("retry", pa.int64()), ("error", pa.string())])


def parse(chunks: DataFrame) -> DataFrame:
    """chunks: stream_id, seq, chunk (binary). Returns stream_id, n (from 0), event, data, id, retry, error. A stream that ends inside an event, has too large a one or is no UTF-8 gives its events up to there and a row with the error (TRUNCATED, TOO_LARGE, ENCODING). One stream is parsed in one task, chunk by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader: StreamReader | None = None
        for batch in slices(batches):
            out: list[tuple] = []
            for stream, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if reader is None or stream != reader.stream:
                    out += reader.rows(b"", True) if reader else ()
                    reader = StreamReader(stream)
                out += reader.rows(chunk or b"")
            if out:
                yield packed(out)
        if reader and (out := list(reader.rows(b"", True))):
            yield packed(out)

    def packed(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), EVENTS.types, strict=True)], schema=EVENTS)

    ordered = chunks.repartition("stream_id").sortWithinPartitions("stream_id", "seq").select("stream_id", "chunk")
    return ordered.mapInArrow(run, "stream_id long, n long, event string, data string, id string, retry long, error string")


#: The most characters that the beginning of a placeholder can have.
HOLD = 96
TOKEN = re.compile(r"<[A-Z][A-Z0-9_]{0,31}_\d{3,}>")
BEGUN = re.compile(r"<(?:[A-Z][A-Z0-9_]{0,64})?\Z")


def restore_piece(text: str, known: dict[str, str], last: bool = False) -> tuple[str, str]:
    """What may be sent of text, with known placeholders put back, and what must wait for more."""
    m = None if last else BEGUN.search(text[-HOLD:])
    cut = len(text) - len(m[0]) if m else len(text)
    return TOKEN.sub(lambda t: known.get(t[0], t[0]), text[:cut]), text[cut:]


def restore_stream(chunks: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """A streaming frame branch, seq, chunk, last -> branch, text. The state of a branch is its unsent tail. mapping is one request's, so bounded."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tail = state.get[0] if state.exists else ""
        rows = pd.concat(list(frames)).sort_values("seq")
        out = ""
        for chunk, last in zip(rows["chunk"], rows["last"], strict=True):
            ready, tail = restore_piece(tail + chunk, mapping, bool(last))
            out += ready
        state.update((tail,))
        yield pd.DataFrame({"branch": [key[0]], "text": [out]})

    return chunks.groupBy("branch").applyInPandasWithState(step, "branch string, text string", "tail string", "append", "NoTimeout")


def events_of(texts: list[str], parser: Callable[[], EventParser] = EventParser) -> list[Event]:
    """All events of chunks, for one stream in memory."""
    p = parser()
    return [e for t in texts for e in p.feed(t)] + list(p.close())
