"""Chat formatting by a finite-state machine over roles.

A template declares how each role's turns open and close, which are learnt from,
and which role may follow which. The machine walks through a conversation's turns,
emits the segments of its text with a loss flag each, and marks turns that come out
of order. Control strings inside a turn's text are escaped, so that the segments
can be read back without loss.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.llm.common import shared_folder, slices, table


@dataclass(frozen=True)
class Turn:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """turns: by role; other: for roles not named, its open ends with the escaped role and other_end. follows: the states, each with the roles that may come next; START is the first."""

    turns: dict[str, Turn] = field(default_factory=lambda: {"system": Turn("<<SYS>>\n", "\n<</SYS>>\n"), "user": Turn("[INST] ", " [/INST]"), "assistant": Turn("<s> ", " </s>", loss=True)})
    other: Turn = Turn("<<ROLE>>", "<</ROLE>>\n")
    other_end: str = "<<TEXT>>\n"
    follows: dict[str, frozenset[str]] = field(default_factory=lambda: {"START": frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}), "assistant": frozenset({"user"})})

    def controls(self) -> list[str]:
        """Every control string, bare of white space; the longest first, as one may begin another."""
        found = {s.strip() for t in (*self.turns.values(), self.other) for s in (t.open, t.close)} | {self.other_end.strip()}
        return sorted(found, key=lambda s: (-len(s), s))


DEFAULT = Template()
ESCAPE = "\\"


class Escaper:
    r"""Turns each control string into \a, \b, ... and \ into \; no control string is left, and the way back is unique."""

    def __init__(self, template: Template):
        controls = template.controls()
        if "" in controls:
            raise ValueError("a control string needs a character other than white space")
        if len(controls) > 26 or any(ESCAPE in c for c in controls):
            raise ValueError("at most 26 control strings, without the escape character")
        self.out = {ESCAPE: ESCAPE * 2} | {c: ESCAPE + chr(ord("a") + i) for i, c in enumerate(controls)}
        self.back = {v: k for k, v in self.out.items()}
        self.find = re.compile("|".join(map(re.escape, [*controls, ESCAPE])))
        self.found = re.compile(r"\\.", re.DOTALL)

    def escape(self, text: str) -> str:
        return self.find.sub(lambda m: self.out[m[0]], text)

    def unescape(self, text: str) -> str:
        return self.found.sub(lambda m: self.back[m[0]], text)


SEGMENTS = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("text", pa.string()), ("loss", pa.bool_()), ("in_order", pa.bool_())])


def segments(conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """conv_id, segment (from 0, in the conversation's order), text, loss, in_order: the segments of each conversation.

    conversations: conv_id, turn, role, text; other columns are left alone. Rows are
    taken by turn (null first), ties by role and text; repeated rows are repeated
    turns. A null text or role counts as empty; null conv_id is one conversation.
    in_order tells whether the turn's role may follow the one before it; turns that
    may not are kept and marked. An empty text has an empty segment. A very long text is
    one segment; a conversation is one task's, which holds one turn of it at a time. An
    empty table gives no segments.
    """
    Escaper(template)  # a template that can't be read back fails here

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escaper = Escaper(template)
        current: object = walk  # no conv_id
        state, n = "START", 0
        for batch in slices(batches, 1000):
            out: list[tuple] = []
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != current:
                    current, state, n = conv, "START", 0
                fits = role in template.follows.get(state, ())
                form = template.turns.get(role)
                opening = form.open if form else f"{template.other.open}{escaper.escape(role)}{template.other_end}"
                form = form or template.other
                for piece, loss in ((opening, False), (escaper.escape(text), form.loss), (form.close, False)):
                    out.append((conv, n, piece, loss, fits))
                    n += 1
                state = role
            columns = zip(*out, strict=True) if out else [[]] * len(SEGMENTS)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, SEGMENTS.types, strict=True)], schema=SEGMENTS)

    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(walk, "conv_id long, segment long, text string, loss boolean, in_order boolean")


@dataclass
class Reading:
    """What is read back of one conversation. Nothing but digests and counts is held, however long it is."""

    n_turns: int = 0
    turns: object = field(default_factory=hashlib.sha256)
    loss_chars: int = 0
    loss: object = field(default_factory=hashlib.sha256)
    formatted_chars: int = 0
    n_out_of_order: int = 0


def read_back(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_out_of_order, from segments() alone.

    formatted: conv_id, segment, text, loss, in_order, its rows in any order and place.
    Control strings tell turns and roles; a turn's text is what stands between its
    two, unescaped.
    """
    opens = {t.open: role for role, t in template.turns.items()}
    closes = {t.close for t in (*template.turns.values(), template.other)}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escaper = Escaper(template)
        current: object = read
        r = Reading()
        role = None

        def row() -> tuple:
            return (current, r.n_turns, r.turns.hexdigest(), r.loss_chars, r.loss.hexdigest(), r.formatted_chars, r.n_out_of_order)

        for batch in slices(batches, 1000):
            done = []
            for conv, text, loss, fits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != current:
                    if current is not read:
                        done.append(row())
                    current, r, role = conv, Reading(), None
                r.formatted_chars += len(text)
                if role is None:  # a turn opens
                    role = opens[text] if text in opens else escaper.unescape(text.removeprefix(template.other.open).removesuffix(template.other_end))
                    r.n_turns += 1
                    r.n_out_of_order += not fits
                    r.turns.update(role.encode() + b"\n")
                elif text in closes:
                    r.turns.update(b"\n")
                    role = None
                else:
                    own = escaper.unescape(text)
                    r.turns.update(own.encode())
                    if loss:
                        r.loss_chars += len(own)
                        r.loss.update(own.encode())
            if done:
                yield out(done)
        if current is not read:
            yield out([row()])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_out_of_order"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return ordered.select("conv_id", "text", "loss", "in_order").mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_out_of_order long")


def written(formatted: DataFrame, folder: str) -> DataFrame:
    """Segments as Parquet files in folder, and read from there."""
    formatted.write.parquet(folder)
    return formatted.sparkSession.read.schema(formatted.schema).parquet(folder)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(written(segments(rows), shared_folder(spark)))


OP3_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(text) + coalesce(list_sum(list_transform(regexp_extract_all(text, '<</ROLE>>|<</SYS>>|<<ROLE>>|<<TEXT>>|<<SYS>>|\[/INST\]|\[INST\]|</s>|<s>|\\'), lambda m: 2 - length(m))), 0) AS text_chars,
    length(role) + coalesce(list_sum(list_transform(regexp_extract_all(role, '<</ROLE>>|<</SYS>>|<<ROLE>>|<<TEXT>>|<<SYS>>|\[/INST\]|\[INST\]|</s>|<s>|\\'), lambda m: 2 - length(m))), 0) AS role_chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text), 'START') AS before FROM c),
f AS (SELECT *, text_chars + CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 ELSE 27 + role_chars END AS chars,
    CASE before WHEN 'START' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user' WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role = 'user' ELSE false END AS fits FROM e)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY i)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars, count(*) FILTER (NOT fits)::BIGINT AS n_out_of_order FROM f GROUP BY conv_id
"""
