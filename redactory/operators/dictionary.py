"""Commands on dictionaries under an expected revision: optimistic edits, deletions and publications."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from redactory.sources.tables import slices

#: Entries that a dictionary may have.
MOST_ENTRIES = 10_000


@dataclass
class Book:
    """One scope's dictionary: its entries by id, ids by text, revision and published revision."""

    entries: dict[str, tuple[str, bool]] = field(default_factory=dict)
    ids: dict[str, str] = field(default_factory=dict)
    revision: int = 0
    published: int = 0

    def apply(self, action: str, entry: str | None, text: str | None, enabled: bool | None, expected: int | None, most: int) -> str | None:
        """The code of a command that is refused; else it is applied."""
        if expected != self.revision:
            return "REVISION_CONFLICT"
        if action == "publish":
            if self.revision != self.published and not any(on for _, on in self.entries.values()):
                return "EMPTY_PUBLICATION"
            self.published = self.revision
            return None
        if action == "delete":
            if entry not in self.entries:
                return "ENTRY_NOT_FOUND"
            del self.ids[self.entries.pop(entry)[0]]
        else:
            if not (text or "").strip():
                return "INVALID_TEXT"
            if self.ids.get(text, entry) != entry or (action == "create" and entry in self.entries):
                return "ENTRY_CONFLICT"
            if action == "create" and len(self.entries) >= most:
                return "LIMIT_EXCEEDED"
            if action == "update" and entry not in self.entries:
                return "ENTRY_NOT_FOUND"
            if entry in self.entries:
                del self.ids[self.entries[entry][0]]
            self.entries[entry], self.ids[text] = (text, bool(enabled)), entry
        self.revision += 1
        return None


def commanded(commands: DataFrame, most: int = MOST_ENTRIES) -> DataFrame:
    """scope, n, code, revision, published, n_entries: each command's code, or null if it was applied, and the dictionary after it.

    commands: scope, n (their order), action (create, update, delete, publish),
    entry_id, text, enabled, expected (the revision that the sender saw). The codes:
    REVISION_CONFLICT, UNKNOWN_ACTION, INVALID_TEXT, ENTRY_CONFLICT (an id twice, or a
    text that another entry has), ENTRY_NOT_FOUND, LIMIT_EXCEEDED, EMPTY_PUBLICATION.
    Refused commands change nothing. As each command depends on the one before, a
    scope's stream through one task, in memory bounded by most entries. Commands of one
    n are taken by action, then id. A null scope is a scope.
    """
    kind, order = (commands.schema[c].dataType.simpleString() for c in ("scope", "n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, scope, first = Book(), None, True
        for batch in slices(batches, 5000):
            out = []
            for s, action, entry, text, enabled, expected in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6)), strict=True):
                if first or s != scope:
                    book, scope, first = Book(), s, False
                known = action in ("create", "update", "delete", "publish")
                out.append((book.apply(action, entry, text, enabled, expected, most) if known else "UNKNOWN_ACTION", book.revision, book.published, len(book.entries)))
            columns = zip(zip(*out, strict=True), (pa.string(), *[pa.int64()] * 3), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in columns)], names=["scope", "n", "code", "revision", "published", "n_entries"])

    dealt = commands.select("scope", "n", "action", "entry_id", "text", "enabled", "expected").repartition("scope").sortWithinPartitions("scope", "n", "action", "entry_id")
    return dealt.mapInArrow(run, f"scope {kind}, n {order}, code string, revision long, published long, n_entries long")
