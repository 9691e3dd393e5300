"""Documents as blocks: plain text, CSV, DOCX and XLSX, read by Spark as binary files and parsed in Arrow batches."""

from __future__ import annotations

import csv
import io
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redactory.sources.tables import slices

MOST_BYTES, MOST_CHARS, MOST_CELLS, MOST_COLUMNS, MOST_BLOCKS = 10 << 20, 200_000, 100_000, 256, 10_000
MOST_MEMBERS, MOST_UNPACKED, MOST_RATIO = 2048, 32 << 20, 200
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
Block = tuple[str, list[str], int | None]  # kind, texts, heading level


class Rejected(ValueError):
    """Its text is the error code."""


def plain(data: bytes) -> str:
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError:
        raise Rejected("ENCODING") from None
    if "\0" in text:
        raise Rejected("NUL")
    return text


def rows_of_csv(data: bytes) -> list[Block]:
    try:
        rows = list(csv.reader(io.StringIO(plain(data), newline=""), strict=True))
    except csv.Error:
        raise Rejected("CSV") from None
    if any(len(r) > MOST_COLUMNS for r in rows):
        raise Rejected("TOO_MANY_COLUMNS")
    return [("row", r, None) for r in rows]


def package(data: bytes) -> zipfile.ZipFile:
    """An archive within its bounds."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        raise Rejected("PACKAGE") from None
    members = z.infolist()
    size = sum(m.file_size for m in members)
    if len(members) > MOST_MEMBERS or size > MOST_UNPACKED or any(m.flag_bits & 1 for m in members) or any(m.file_size > MOST_RATIO * max(m.compress_size, 1) for m in members):
        raise Rejected("PACKAGE_LIMITS")
    return z


def xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    raw = z.read(name)
    if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
        raise Rejected("DTD")
    try:
        return ElementTree.fromstring(raw)
    except ElementTree.ParseError:
        raise Rejected("XML") from None


def word_text(node: ElementTree.Element) -> str:
    kinds = {f"{WORD}t": lambda n: n.text or "", f"{WORD}tab": lambda _: "\t", f"{WORD}br": lambda _: "\n"}
    return "".join(kinds[n.tag](n) for n in node.iter() if n.tag in kinds)


def blocks_of_docx(data: bytes) -> list[Block]:
    z = package(data)
    names = [n for n in ("word/document.xml", *sorted(n for n in z.namelist() if re.fullmatch(r"word/(header\d*|footer\d*|footnotes|endnotes|comments)\.xml", n))) if n in z.namelist()]
    if "word/document.xml" not in names:
        raise Rejected("PACKAGE")  # no main part
    out: list[Block] = []
    for name in names:
        root = xml(z, name)
        if any(n.tag.endswith(("}drawing", "}object")) for n in root.iter()):
            raise Rejected("EMBEDDED_OBJECT")
        inside = {p for t in root.iter(f"{WORD}tbl") for p in t.iter(f"{WORD}p")}
        for node in root.iter():
            if node.tag == f"{WORD}tr":
                out.append(("row", [word_text(c) for c in node.iter(f"{WORD}tc")], None))
            elif node.tag == f"{WORD}p" and node not in inside:
                style = next((s.get(f"{WORD}val") or "" for s in node.iter(f"{WORD}pStyle")), "")
                level = re.fullmatch(r"Heading([1-6])", style)
                if text := word_text(node):
                    out.append(("paragraph", [text], int(level[1]) if level else None))
    return out


def blocks_of_xlsx(data: bytes) -> list[Block]:
    z = package(data)
    strings = ["".join(t.text or "" for t in s.iter(f"{SHEET}t")) for s in xml(z, "xl/sharedStrings.xml").iter(f"{SHEET}si")] if "xl/sharedStrings.xml" in z.namelist() else []
    targets = {r.get("Id"): r.get("Target") or "" for r in xml(z, "xl/_rels/workbook.xml.rels")} if "xl/_rels/workbook.xml.rels" in z.namelist() else {}
    out: list[Block] = []
    for sheet in xml(z, "xl/workbook.xml").iter(f"{SHEET}sheet"):
        title, target = sheet.get("name") or "", targets.get(sheet.get(RELATION), "")
        name = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        if name not in z.namelist():
            raise Rejected("PACKAGE")  # a sheet without its part
        out.append(("paragraph", [title], 2))
        for row in xml(z, name).iter(f"{SHEET}row"):
            cells = []
            for c in row.iter(f"{SHEET}c"):
                formula, value = c.find(f"{SHEET}f"), c.find(f"{SHEET}v")
                if formula is not None:
                    cells.append("=" + (formula.text or ""))
                elif c.get("t") == "inlineStr":
                    cells.append("".join(t.text or "" for t in c.iter(f"{SHEET}t")))
                elif value is not None:
                    cells.append(strings[int(value.text)] if c.get("t") == "s" else value.text or "")
                else:
                    cells.append("")
            out.append(("row", cells, None))
    return out


#: Formats by the name's ending. PDF and XLS need libraries that may be absent; files of other endings get FORMAT.
PARSERS = {e: lambda data: [("literal", [plain(data)], None)] for e in ("txt", "md", "json", "yaml", "yml")} | {"csv": rows_of_csv, "docx": blocks_of_docx, "xlsx": blocks_of_xlsx, "xlsm": blocks_of_xlsx}


def blocks(data: bytes, kind: str) -> list[Block]:
    if kind not in PARSERS:
        raise Rejected("FORMAT")
    if len(data) > MOST_BYTES:
        raise Rejected("TOO_LARGE")
    found = PARSERS[kind](data)
    if len(found) > MOST_BLOCKS:
        raise Rejected("TOO_MANY_BLOCKS")
    if sum(len(t) for _, texts, _ in found for t in texts) > MOST_CHARS:
        raise Rejected("TOO_MANY_CHARS")
    if sum(len(texts) for _, texts, _ in found) > MOST_CELLS:
        raise Rejected("TOO_MANY_CELLS")
    return found


OUT = pa.schema([("path", pa.string()), ("format", pa.string()), ("n", pa.int64()), ("kind", pa.string()), ("texts", pa.list_(pa.string())), ("level", pa.int32()), ("error", pa.string())])


def extract(files: DataFrame) -> DataFrame:
    """files: path, content. A row per block: path, format, n, kind, texts, level; a rejected file has one row with its error code. Blocks of many files make one batch."""

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), OUT.types, strict=True)], schema=OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in slices(batches, 16):
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                kind = os.path.splitext(path or "")[1].removeprefix(".").lower()
                try:
                    rows += [(path, kind, i, *b, None) for i, b in enumerate(blocks(data or b"", kind))]
                except Rejected as e:
                    rows.append((path, kind, None, None, None, None, str(e)))
                size += len(data or b"")
                if len(rows) >= MOST_BLOCKS or size >= MOST_BYTES:
                    yield packed(rows)
                    rows, size = [], 0
        if rows:
            yield packed(rows)

    return files.select("path", "content").mapInArrow(run, "path string, format string, n long, kind string, texts array<string>, level int, error string")


def read_documents(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Blocks of the files below path."""
    return extract(spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path))


def cell(text: Column) -> Column:
    """A text inside a table: backslashes and bars are escaped, line feeds become breaks, carriage returns go."""
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.replace(F.replace(escaped, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("<br>"))


def markdown(found: DataFrame, column: str = "列") -> DataFrame:
    """path, markdown: the blocks of each file (as extract() gives them) as one text. Rows of one width that follow each other make a table, with numbered columns; a change of width begins another. A file with an error has none. A file's blocks are bounded, see MOST_BLOCKS."""
    order = Window.partitionBy("path").orderBy("n")
    width = F.when(F.col("kind") == "row", F.size("texts")).otherwise(0)
    rows = found.where("error IS NULL").withColumn("width", width).withColumn("heads", (F.col("width") > 0) & ~F.col("width").eqNullSafe(F.lag("width").over(order)))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    numbers = F.transform(F.sequence(F.lit(1), F.greatest("width", F.lit(1))), lambda i: F.concat(F.lit(column), i.cast("string")))
    head = F.concat(F.lit("\n"), line(numbers), F.lit("\n"), line(F.array_repeat(F.lit("---"), F.col("width"))), F.lit("\n"))
    text = F.concat(F.lit("\n"), F.when(F.col("level") > 0, F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "))).otherwise(""), F.array_join("texts", "\n"))
    own = F.when(F.col("width") > 0, F.concat(F.when(F.col("heads"), head).otherwise(""), line(F.transform("texts", cell)))).otherwise(text)
    texts = rows.select("path", "n", own.alias("own")).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("n", "own"))).alias("parts"))
    return texts.select("path", F.concat(F.btrim(F.array_join(F.transform("parts", lambda p: p["own"]), "\n"), F.lit(" \t\r\n")), F.lit("\n")).alias("markdown"))
