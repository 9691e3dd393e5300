"""Streams and documents: any split of the chunks gives the same result."""

import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from redactory.sources.documents import Rejected, blocks, extract, markdown
from redactory.streaming.relay import consume, fold_latest, quarantine, relay, relay_stats
from redactory.streaming.restore import cut, restore_branches, sent
from redactory.streaming.segments import Segments
from redactory.streaming.sse import MOST, BrokenStream, Event, EventParser, events_of, parse, restore_piece, restore_stream

BODY = "event: a\r\ndata: one\r\ndata: two\r\n\r\n: note\n\rdata:three\n\ndata: [DONE]\n\n"
EVENTS = [Event("a", "one\ntwo"), Event(None, "three"), Event(None, "[DONE]")]


def test_every_split_parses_alike():
    assert events_of([BODY]) == events_of(list(BODY)) == EVENTS
    assert all(events_of([BODY[:i], BODY[i:]]) == EVENTS for i in range(len(BODY)))


def test_truncated_stream_is_an_error():
    with pytest.raises(BrokenStream):
        events_of(["data: x"])
    p = EventParser()
    assert list(p.feed("data: x\n\n")) == [Event(None, "x")]


def test_every_split_restores_alike():
    text, known = "to <ORG_001>, <ORG_002> < b <X_0 <ORG_001", {"<ORG_001>": "Acme", "<ORG_002>": "<ORG_001>"}
    for i in range(len(text)):
        for j in range(i, len(text)):
            out = tail = ""
            for part in (text[:i], text[i:j]):
                ready, tail = restore_piece(tail + part, known)
                out += ready
            out += restore_piece(tail + text[j:], known, True)[0]
            assert out == "to Acme, <ORG_001> < b <X_0 <ORG_001"


def test_restore_stream_over_batches(spark, tmp_path):
    schema = "branch string, seq int, chunk string, last boolean"
    for i, chunk in enumerate(("see <OR", "G_00", "1> now")):
        spark.createDataFrame([("b", i, chunk, i == 2)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = restore_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), {"<ORG_001>": "Acme"})
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    assert sorted("".join(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect())) == sorted("see Acme now")


def test_relay_and_fold_over_batches(spark, tmp_path):
    schema = "k long, n long"
    for part in ([(1, 1), (2, 2), (1, 1)], [(2, 2), (3, 3)], [(1, 9), (3, 1)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert sorted((r.k, r.n) for r in relay(read(), ("k", "n"), str(tmp_path / "r")).collect()) == [(1, 1), (1, 9), (2, 2), (3, 1), (3, 3)]
    state = lambda: sorted((r.k, r.n) for r in fold_latest(read(), "k", "n", str(tmp_path / "f")).collect())
    assert state() == [(1, 9), (2, 2), (3, 3)]
    assert state() == [(1, 9), (2, 2), (3, 3)]  # a run without news
    assert relay(read(), ("k", "n"), str(tmp_path / "r")).count() == 5
    spark.createDataFrame([(2, 8), (9, 1)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert state() == [(1, 9), (2, 8), (3, 3), (9, 1)]
    assert relay(read(), ("k", "n"), str(tmp_path / "r")).count() == 7


def test_events_with_receipts_are_not_applied_again(spark, tmp_path):
    schema = "k long, e long, order long"
    for part in ([(1, 10, 1), (2, 11, 1)], [(1, 10, 99), (2, 12, 2)]):  # event 10 comes again, changed
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    state, receipts = consume(stream, "k", ("e",), "order", str(tmp_path / "f"))
    assert sorted(tuple(r) for r in state.select("k", "e", "order").collect()) == [(1, 10, 1), (2, 12, 2)]
    assert sorted(r.e for r in receipts.collect()) == [10, 11, 12]


def test_bad_rows_are_quarantined(spark, tmp_path):
    spark.createDataFrame([(1, 1), (1, 1), (None, 5), (-3, 2)], "k long, n long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, n long").parquet(str(tmp_path / "in"))
    good = relay(stream, ("k", "n"), str(tmp_path / "r"), F.col("k") > 0)
    assert [tuple(r) for r in good.collect()] == [(1, 1)]
    assert quarantine(spark, stream.schema, str(tmp_path / "r")).count() == 2
    assert tuple(relay_stats(spark.read.parquet(str(tmp_path / "in")), ("k", "n"), F.col("k") > 0).first()) == (1, 1, 2)


def test_broken_streams_give_error_rows(spark):
    rows = [(1, 0, b"data: a\n\ndata: b"), (2, 0, b"id: 7\nretry: 50\ndata: x\n\n"), (2, 1, b"data: y\n\n"), (3, 0, b"data: \xff\n\n"), (3, 1, b"data: z\n\n"), (4, 0, "data: é".encode()[:-1]), (5, 0, ("data: " + "é" * (MOST // 2)).encode()), (6, 0, None)]
    got = sorted(tuple(r) for r in parse(spark.createDataFrame(rows, "stream_id long, seq long, chunk binary")).collect())
    assert got == [(1, 0, None, "a", None, None, None), (1, 1, None, None, None, None, "TRUNCATED"), (2, 0, None, "x", "7", 50, None), (2, 1, None, "y", "7", None, None), (3, 0, None, None, None, None, "ENCODING"), (4, 0, None, None, None, None, "ENCODING"), (5, 0, None, None, None, None, "TOO_LARGE")]


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def test_docx():
    body = f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    found = blocks(archive({"word/document.xml": body}), "docx")
    assert found == [("paragraph", ["Title"], 2), ("paragraph", ["a\tb"], None), ("row", ["x", "y"], None)]


def test_xlsx():
    files = {"xl/workbook.xml": f'<workbook {S} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" r:id="r9"/><sheet name="Two" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet2.xml"/><Relationship Id="r9" Target="/xl/worksheets/sheet1.xml"/></Relationships>', "xl/worksheets/sheet2.xml": f"<worksheet {S}/>", "xl/sharedStrings.xml": f"<sst {S}><si><t>hi</t></si></sst>", "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row><c t="s"><v>0</v></c><c><f>A1+1</f><v>2</v></c><c><v>3</v></c></row></sheetData></worksheet>'}
    assert blocks(archive(files), "xlsx") == [("paragraph", ["One"], 2), ("row", ["hi", "=A1+1", "3"], None), ("paragraph", ["Two"], 2)]
    del files["xl/worksheets/sheet2.xml"]
    with pytest.raises(Rejected, match="PACKAGE"):
        blocks(archive(files), "xlsx")


def test_markdown(spark):
    body = f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:body></w:document>'
    files = [("t.docx", archive({"word/document.xml": body})), ("t.csv", b"a|b,c\\\n1,2\n\"x\ny\"\nz\n"), ("bad.txt", b"\xff")]
    got = {r.path: r.markdown for r in markdown(extract(spark.createDataFrame(files, "path string, content binary"))).collect()}
    assert got == {"t.docx": "## Title\n\na|b\n", "t.csv": "| 列1 | 列2 |\n| --- | --- |\n| a\\|b | c\\\\ |\n| 1 | 2 |\n\n| 列1 |\n| --- |\n| x<br>y |\n| z |\n"}


@pytest.mark.parametrize(("data", "kind", "code"), [(b"\xff", "txt", "ENCODING"), (b"a\0", "md", "NUL"), (b'"a', "csv", "CSV"), (b"zz", "docx", "PACKAGE"), (b"", "exe", "FORMAT"), (archive({"word/document.xml": "<!DOCTYPE x><a/>"}), "docx", "DTD"), (archive({"word/document.xml": " " * (1 << 20)}), "docx", "PACKAGE_LIMITS")])
def test_rejections(data, kind, code):
    with pytest.raises(Rejected, match=code):
        blocks(data, kind)


def test_segments_write_what_a_batch_touches(spark, tmp_path):
    """A batch of 1 % of the keys writes 1 % of the rows; merged segments halve in size, and a repeated batch changes nothing."""
    schema = StructType.fromDDL("k long, n long")
    latest = lambda rows: rows.groupBy("k").agg(F.max("n").alias("n"))
    held = Segments(spark, str(tmp_path / "s"), schema, latest)
    want = {}
    for batch in range(9):
        rows = [(k, batch) for k in range(1000)] if batch == 0 else [(k * 37 % 1010, batch) for k in range(10 * batch, 10 * batch + 10)]
        for _ in range(2 if batch in (4, 8) else 1):
            held.settle(batch)
            held.write(spark.createDataFrame(rows, schema), batch)
        want |= dict(rows)
        assert held.rows((batch, batch)) == len(rows)
    sizes = [held.rows(s) for s in held.listed()]
    assert len(sizes) < 6
    assert sizes == sorted(sizes, reverse=True)
    assert {r.k: r.n for r in held.read().collect()} == want
    assert {r.n for r in held.read(before=8).collect()} <= set(range(8))


def test_rows_are_retried_and_then_quarantined(spark, tmp_path):
    schema = "k long, n long"
    allowed = spark.createDataFrame([(1,)], "k long")
    tries = []

    def judge(rows):
        tries.append(1)
        known = allowed if len(tries) < 2 else allowed.unionByName(spark.createDataFrame([(2,)], "k long"))
        return rows.join(known.withColumn("ok", F.lit(True)), "k", "left").withColumn("verdict", F.when(F.col("ok"), "accepted").when(F.col("k") < 0, "rejected").otherwise("retry"))

    for part in ([(1, 1), (2, 2), (3, 3), (-1, 0)], [(1, 1), (4, 4)], [(5, 5)], [(6, 6)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = relay(stream, ("k", "n"), str(tmp_path / "r"), judge)
    assert sorted(r.k for r in got.collect()) == [1, 2]
    assert sorted(r.k for r in quarantine(spark, stream.schema, str(tmp_path / "r")).collect()) == [-1, 3, 4]


TEXTS = ["hello <ORG_001>!", "<ORG_009> x", "see <ORG_00", "ORG_001 bare", "plain", "<ORG_002><PER_001>", "a < b <<ORG_001>", "xORG_001 and ORG_001x", "<  ORG_001>", "<org-7>", "漢字ORG_001漢字 <ORG_001>", "see <OR", "tail ORG_001"]


def test_every_split_of_a_stream_gives_the_code_of_the_whole(spark, tmp_path):
    from redactory.operators.exchange import restored

    known = {"<ORG_001>": "Acme", "<ORG_002>": "x <ORG_001> y", "<PER_001>": "Ann"}
    splits = [(t, i, j) for t in TEXTS for i in range(0, len(t) + 1, 2) for j in (i + 1, i + 4, len(t)) if j <= len(t)]
    ids = {k: (t, [t[:i], t[i:j], t[j:]]) for k, (t, i, j) in enumerate(splits)}
    schema = "stream_id long, branch string, seq int, chunk string, last boolean, at timestamp"
    for seq in range(3):
        rows = [(k, "b", seq, parts[seq], seq == 2 and k % 7 != 0, datetime.datetime(2024, 1, 1, 0, seq)) for k, (_, parts) in ids.items()]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / f"in{seq}"))
    spark.createDataFrame([(-1, "b", 0, "", True, datetime.datetime(2024, 1, 2))], schema).write.parquet(str(tmp_path / "in3"))
    mapping = spark.createDataFrame([(k, t, o) for k in ids for t, o in known.items()], "stream_id long, token string, original string")
    texts = spark.createDataFrame([(k, t) for k, (t, _) in ids.items()], "stream_id long, text string")
    want = {r.stream_id: (r.restored, r.code) for r in restored(texts, mapping, "stream_id", "stream_id", "text").collect()}
    for seq in range(4):  # one run each, which goes on from the one before
        (tmp_path / "in").mkdir(exist_ok=True)
        for f in (tmp_path / f"in{seq}").glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{seq}-{f.name}")
        restore_branches(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), mapping, str(tmp_path / "out"))
    got = {r.stream_id: (None if r.code else r.restored, r.code) for r in sent(spark, str(tmp_path / "out")).where("stream_id >= 0").collect()}
    assert got.keys() == ids.keys()
    for k, (t, parts) in ids.items():
        if k % 7:
            assert got[k] == want[k], (t, parts)
        else:  # the last chunk never came as such
            assert got[k][1] in ("TRUNCATED", want[k][1]), (t, parts)


def test_cut_waits_for_what_may_be_a_placeholder():
    assert [cut(t) for t in ("", "a b", "see <OR", "see <<", "a < b c", "x <ORG_001>", "<  ", "y" * 200, "end.", "< " + " " * 200)] == [0, 2, 4, 4, 6, 11, 0, 200, 4, 202]


def test_a_batch_writes_the_branches_it_touches(spark, tmp_path):
    schema = "stream_id long, branch string, seq int, chunk string, last boolean, at timestamp"
    mapping = spark.createDataFrame([(0, "<ORG_001>", "Acme")], "stream_id long, token string, original string")
    for seq, n in enumerate((300, 3)):
        spark.createDataFrame([(k, "b", seq, ("see <ORG", "_001>")[seq], seq == 1, datetime.datetime(2024, 1, 1)) for k in range(n)], schema).write.mode("append").parquet(str(tmp_path / "in"))
        restore_branches(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), mapping, str(tmp_path / "out"))
    assert sorted(spark.read.parquet(str(f)).count() for f in (tmp_path / "out/state").iterdir())[-2:] == [3, 300]
    assert {r.stream_id: (r.restored, r.code) for r in sent(spark, str(tmp_path / "out")).where("code IS NOT NULL OR last").collect()} == {0: ("see Acme", None), 1: ("see ", "UNKNOWN_TOKEN"), 2: ("see ", "UNKNOWN_TOKEN")}
