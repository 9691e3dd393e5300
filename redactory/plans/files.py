"""Queries of whole files: scanned as records, and redacted from end to end."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from redactory.operators.files import redact_files
from redactory.plans.detection import TODAY
from redactory.sources import scans
from redactory.sources.documents import extract
from redactory.sources.tables import shared_folder, slices, stored, table

RECORD = "id long, name string, balance double"
BODY = """CASE s_suppkey % 7 WHEN 0 THEN '{"id":1,"name":' WHEN 1 THEN concat('{"id":', CAST(s_suppkey AS STRING), ',"name":"', repeat('long ', 100), '"}') WHEN 2 THEN '[1]' WHEN 3 THEN concat('{"id":"', s_name, '","name":"n"}')
    ELSE concat('{"id":', CAST(s_suppkey AS STRING), ',"name":"', s_name, '","more":[1]', CASE WHEN s_suppkey % 2 = 0 THEN ',"balance":1.5' ELSE '' END, '}') END"""


def written(spark: SparkSession, sf_dir: str, where: str) -> str:
    """A folder with a file for each supplier."""
    folder = shared_folder(spark)
    table(spark, sf_dir, "supplier").where(where).selectExpr("s_suppkey AS id", f"{BODY} AS value").repartition(32, "id").write.partitionBy("id").text(folder)
    return folder


def record_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of a folder with a file for each supplier; large, broken and wrongly typed ones have their codes."""
    found = scans.scan(spark, written(spark, sf_dir, "true"), StructType.fromDDL(RECORD), "*.txt", 400)
    return found.select(F.regexp_extract("path", "/id=([0-9]+)/", 1).cast("long").alias("file_id"), "code", "record.id", "record.name", "record.balance")


SCAN_SQL = """SELECT s_suppkey AS file_id, code, CASE WHEN code IS NULL THEN s_suppkey END AS id, CASE WHEN code IS NULL THEN s_name END AS name, CASE WHEN code IS NULL AND s_suppkey % 2 = 0 THEN 1.5::DOUBLE END AS balance
FROM (SELECT *, CASE s_suppkey % 7 WHEN 0 THEN 'MALFORMED' WHEN 1 THEN 'TOO_LARGE' WHEN 2 THEN 'MALFORMED' WHEN 3 THEN 'MALFORMED' END AS code FROM supplier)"""


def ledger_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intents and results, each a folder of files: what has both, or one, or can't be read."""
    kind = StructType.fromDDL(RECORD)
    intents, results = (scans.scan(spark, written(spark, sf_dir, where), kind, "*.txt", 400) for where in ("s_suppkey % 3 <> 0", "s_suppkey % 4 <> 0"))
    return scans.unfinished(intents, results, "id").groupBy("status").agg(F.count("*").alias("n"))


LEDGER_SQL = """WITH s AS (SELECT s_suppkey AS k, s_suppkey % 7 < 4 AS bad FROM supplier), x AS (SELECT 'unreadable' AS status FROM s WHERE bad AND k % 3 <> 0 UNION ALL SELECT 'unreadable' FROM s WHERE bad AND k % 4 <> 0
    UNION ALL SELECT CASE WHEN k % 3 = 0 THEN 'orphan' WHEN k % 4 = 0 THEN 'unknown' ELSE 'confirmed' END FROM s WHERE NOT bad AND (k % 3 <> 0 OR k % 4 <> 0)) SELECT status, count(*)::BIGINT AS n FROM x GROUP BY 1"""

#: A file for each customer: texts, tables, and what no one can read. Numbers repeat within and between files.
FILES = """SELECT concat('f', CAST(c_custkey AS STRING), CASE c_custkey % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.csv' WHEN 2 THEN '.md' ELSE '.bin' END) AS path, c_custkey, concat('138', lpad(CAST(c_custkey % 90 AS STRING), 8, '1')) AS p,
    CASE WHEN c_custkey % 10 = 2 THEN concat('sk-', lpad(CAST(c_custkey AS STRING), 20, 'a')) ELSE 'none' END AS k FROM {customer}"""
TEXT = "concat('call ', p, ' or 13900000000 then ', p, ' key ', k)"


def redacted_files(spark: SparkSession, sf_dir: str):
    content = f"CASE c_custkey % 4 WHEN 1 THEN concat('who,what', chr(10), p, ',', k) WHEN 2 THEN concat({TEXT}, chr(10), chr(10), p) ELSE {TEXT} END"
    files = spark.sql(f"SELECT path, encode({content}, 'utf-8') AS content FROM ({FILES})", customer=table(spark, sf_dir, "customer"))
    return redact_files(stored(files.repartition("path")), today=TODAY)


def file_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted_files(spark, sf_dir).documents.select("path", "format", "code", "n_entities", "n_replaced", "markdown")


FILE_SQL = f"""WITH f AS ({FILES.replace("{customer}", "customer")}), c AS (SELECT *, CASE WHEN c_custkey % 4 = 3 THEN 'FORMAT' WHEN k <> 'none' THEN 'SECRET_DETECTED' END AS code FROM f)
SELECT path, regexp_extract(path, '[.]([a-z]+)$', 1) AS format, code, CASE WHEN code IS NULL THEN CASE c_custkey % 4 WHEN 1 THEN 1 ELSE 2 END END::BIGINT AS n_entities, CASE WHEN code IS NULL THEN CASE c_custkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 4 END END::BIGINT AS n_replaced,
    CASE WHEN code IS NULL THEN CASE c_custkey % 4 WHEN 1 THEN concat('| 列1 | 列2 |', chr(10), '| --- | --- |', chr(10), '| who | what |', chr(10), '| <PHONE_NUMBER_001> | none |', chr(10))
    ELSE concat('call <PHONE_NUMBER_001> or <PHONE_NUMBER_002> then <PHONE_NUMBER_001> key none', CASE WHEN c_custkey % 4 = 2 THEN concat(chr(10), chr(10), '<PHONE_NUMBER_001>') ELSE '' END, chr(10)) END END AS markdown FROM c"""


def file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted_files(spark, sf_dir).types.groupBy("entity_type").agg(F.count("*").alias("n_files"), F.sum("n").alias("n"))


TYPES_SQL = f"""WITH f AS ({FILES.replace("{customer}", "customer")}) SELECT 'PHONE_NUMBER' AS entity_type, count(*)::BIGINT AS n_files, sum(CASE c_custkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 4 END)::BIGINT AS n FROM f WHERE c_custkey % 4 <> 3 AND k = 'none'"""

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def packages(suppliers: DataFrame) -> DataFrame:
    """path, content: for each supplier a document with a heading and a table, or a workbook of two sheets; of every fifth a part is not there."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for k, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k % 2:
                    body = f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>{name}</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>key</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>{k}</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
                    out.append((f"f{k}.docx", zipped({"word/other.xml" if k % 5 == 0 else "word/document.xml": body})))
                else:
                    sheets = {f"xl/worksheets/s{i}.xml": f'<worksheet {S}><sheetData><row><c t="inlineStr"><is><t>{name}</t></is></c><c><v>{k + i}</v></c></row></sheetData></worksheet>' for i in ((1,) if k % 5 == 0 else (1, 2))}
                    book = f'<workbook {S} {R}><sheets><sheet name="One" r:id="r1"/><sheet name="Two" r:id="r2"/></sheets></workbook>'
                    names = '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="worksheets/s2.xml"/></Relationships>'
                    out.append((f"f{k}.xlsx", zipped({"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": names} | sheets)))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([c for _, c in out], pa.binary())], names=["path", "content"])

    return suppliers.select("s_suppkey", "s_name").mapInArrow(build, "path string, content binary")


def package_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of documents and workbooks; those without a part have the code only."""
    found = extract(packages(table(spark, sf_dir, "supplier")))
    return found.select("path", "n", "kind", F.array_join("texts", "|").alias("texts"), "level", "error")


PACKAGE_SQL = """WITH s AS (SELECT *, s_suppkey % 5 = 0 AS bad FROM supplier), d AS (SELECT concat('f', s_suppkey, '.docx') AS path, * FROM s WHERE s_suppkey % 2 = 1), x AS (SELECT concat('f', s_suppkey, '.xlsx') AS path, * FROM s WHERE s_suppkey % 2 = 0)
SELECT path, 0::BIGINT AS n, 'paragraph' AS kind, s_name AS texts, 2 AS level, NULL AS error FROM d WHERE NOT bad UNION ALL SELECT path, 1, 'row', concat('key|', s_suppkey), NULL, NULL FROM d WHERE NOT bad
UNION ALL SELECT path, 2 * i, 'paragraph', ['One', 'Two'][(i + 1)::INT], 2, NULL FROM x, range(2) t(i) WHERE NOT bad UNION ALL SELECT path, 2 * i + 1, 'row', concat(s_name, '|', s_suppkey + i + 1), NULL, NULL FROM x, range(2) t(i) WHERE NOT bad
UNION ALL SELECT path, NULL, NULL, NULL, NULL, 'PACKAGE' FROM d WHERE bad UNION ALL SELECT path, NULL, NULL, NULL, NULL, 'PACKAGE' FROM x WHERE bad"""

QUERIES = {"package_blocks": (package_blocks, PACKAGE_SQL), "record_scan": (record_scan, SCAN_SQL), "ledger_scan": (ledger_scan, LEDGER_SQL), "file_redact": (file_redact, FILE_SQL), "file_types": (file_types, TYPES_SQL)}
