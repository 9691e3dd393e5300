"""Records around the core: loads with their checks, digests, read authorization, sweeps, exports, nested organizations, sentence windows."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactory.operators.governance import SOURCE
from redactory.sources.tables import slices

# Endings of parts of an organization.
UNIT_ENDINGS = (
    "业务中心", "技术中心", "研发中心", "数据中心", "创新中心", "运营中心", "营销中心", "服务中心", "信息中心", "计算中心", "网络中心", "管理中心", "调度中心", "支撑中心", "保障中心", "指挥中心", "事业部", "事业群", "业务部", "业务群", "产品线", "业务线",
    "分公司", "子公司", "支公司", "总公司", "母公司", "代表处", "办事处", "分部", "分局", "支局", "工作组", "项目组", "课题组", "班组", "小组", "特设组", "委员会", "理事会", "董事会", "监事会", "党支部", "团支部", "工会", "指挥部", "办公室",
    "实验室", "研究所", "研究院", "研发院", "科学院", "设计院", "学院", "学部", "系", "教研室", "中台", "平台", "分行", "支行", "网点", "门市部", "科室", "大队", "中队", "小队", "中心", "部门", "处", "室", "科", "所", "院", "馆", "站", "厅", "队", "部", "组",
)
# End of fixed values.
DELIMITERS = "/\\—–->"
NAME = "一-龥a-zA-Z0-9·"
LETTER = re.compile(f"[{NAME}]+")
BRACKET = re.compile(rf"\s*[（(][{NAME}]+[）)]")
#: What may stand after a unit, besides white space and the text's end.
AFTER = DELIMITERS + "，。；！？,!?;:：\"'“”‘’"
LONGEST_FIRST = sorted(UNIT_ENDINGS, key=len, reverse=True)
#: Characters of a unit before its ending.
MOST_BEFORE = 30


def bounded(text: str, at: int) -> bool:
    return at == len(text) or text[at] in AFTER or text[at].isspace()


def past_blanks(text: str, at: int) -> int:
    while at < len(text) and text[at].isspace():
        at += 1
    return at


def unit_at(text: str, at: int) -> tuple[int, int] | None:
    """The unit that begins at a place: one with the fewest characters before an ending, which a bracket may follow, up to a boundary."""
    letters = LETTER.match(text, at)
    if not letters:
        return None
    for place in range(at + 1, min(letters.end(), at + MOST_BEFORE + 1)):
        for ending in LONGEST_FIRST:
            if text.startswith(ending, place):
                end = place + len(ending)
                bracket = BRACKET.match(text, end)
                for stop in (bracket.end(), end) if bracket else (end,):
                    if bounded(text, stop):
                        return at, stop
    return None


def next_unit(text: str, at: int) -> tuple[int, int] | None:
    """The unit after one delimiter (or two hyphens) at a place, with blanks around it."""
    at = past_blanks(text, at)
    if at >= len(text) or text[at] not in DELIMITERS:
        return None
    found = unit_at(text, past_blanks(text, at + 1))
    return found if found or not text.startswith("--", at) else unit_at(text, past_blanks(text, at + 2))


def nested_units(texts: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """key, start, end, priority: the parts that follow an ORG span, each after a delimiter and with an ending of the list, down the chain."""
    ends = spans.where("entity_type = 'ORG'").groupBy(key).agg(F.array_sort(F.collect_set(F.struct("end", "priority"))).alias("ends"), F.collect_set(F.struct("start", "end")).alias("known"))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, found = [], []
            for row, (text, starts, known) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
                seen = {(k["start"], k["end"]) for k in known}
                for s in starts:
                    at = s["end"]
                    while (unit := next_unit(text, at)) and unit not in seen:
                        seen.add(unit)
                        rows.append(row)
                        found.append((*unit, s["priority"]))
                        at = unit[1]
            columns = list(zip(*found, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), *(pa.array(c, pa.int32()) for c in columns)], names=[key, "start", "end", "priority"])

    return texts.join(ends, key).select(key, "text", "ends", "known").mapInArrow(follow, f"{key} {texts.schema[key].dataType.simpleString()}, start int, end int, priority int")


# Characters that end a line or a sentence, in the order of preference.
ENDS = ("\n\r", "。；;！!？?")
# End of fixed values.


def sentence_windows(text: str, offsets: list[tuple[int, int]], capacity: int, stride: int) -> list[tuple[int, int]]:
    """Windows of tokens that reach capacity unless a line end, or else a sentence's, stands in their later half; the last such ends them. Neighbours share capacity - stride tokens. offsets: each token's place in the text; a token without characters ends nothing."""
    stops = [[i + 1 for i, (a, b) in enumerate(offsets) if a < b and text[b - 1] in marks] for marks in ENDS]
    return windows_between(stops, len(offsets), capacity, stride)


def windows_between(stops: list[list[int]], n: int, capacity: int, stride: int) -> list[tuple[int, int]]:
    """sentence_windows() of n tokens. stops: for each kind of end, the numbers of tokens up to one, rising."""
    shared = capacity - stride
    shortest = max(capacity // 2, shared + max(1, stride // 2)) + 1  # shorter windows would not get on

    def end_of(start: int) -> int:
        full = start + capacity
        if full >= n:
            return n
        last = (places[k - 1] for places in stops if (k := bisect.bisect_right(places, full)) and places[k - 1] >= start + shortest)
        return next(last, full)

    windows = [(0, end_of(0))] if n else []
    while windows and windows[-1][1] < n:
        start = max(windows[-1][0] + 1, windows[-1][1] - shared)
        windows.append((start, end_of(start)))
    return windows


def sentence_plan(texts: DataFrame, key: str, text: str, capacity: int, stride: int) -> DataFrame:
    """key, window_no, start, end: sentence_windows() over the code points of each text."""
    ends = [re.compile(f"[{re.escape(marks)}]") for marks in ENDS]

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [windows_between([[m.end() for m in e.finditer(t)] for e in ends], len(t), capacity, stride) for t in (t or "" for t in batch.column(1).to_pylist())]
            rows = pa.array([k for k, w in enumerate(found) for _ in w], pa.int32())
            columns = list(zip(*((n, a, b) for w in found for n, (a, b) in enumerate(w)), strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), *(pa.array(c, pa.int32()) for c in columns)], names=[key, "window_no", "start", "end"])

    return texts.select(key, text).mapInArrow(plan, f"{key} {texts.schema[key].dataType.simpleString()}, window_no int, start int, end int")


def dictionary_faults(entries: DataFrame, by: str) -> DataFrame:
    """by, n_entries, n_empty, n_repeated (texts given twice), n_ambiguous (texts of several types)."""
    texts = entries.groupBy(by, "text").agg(F.count("*").alias("n"), F.count_distinct("entity_type").alias("types"))
    return texts.groupBy(by).agg(F.sum("n").alias("n_entries"), F.coalesce(F.sum(F.when(F.trim("text") == "", F.col("n"))), F.lit(0)).alias("n_empty"), F.count_if(F.col("n") > 1).alias("n_repeated"), F.count_if(F.col("types") > 1).alias("n_ambiguous"))


def manifest_faults(declared: DataFrame, actual: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """manifest_id, missing (required components not declared), wrong (components whose payload differs or is absent), root (digest over the declared ones)."""
    both = declared.join(actual.withColumnRenamed("sha256", "found"), ["manifest_id", "component"], "left")
    out = both.groupBy("manifest_id").agg(
        F.array_sort(F.array_except(F.array(*map(F.lit, required)), F.collect_set("component"))).alias("missing"),
        F.array_sort(F.collect_set(F.when(~F.col("sha256").eqNullSafe(F.col("found")), F.col("component")))).alias("wrong"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("component", "sha256"))), lambda c: F.concat_ws("=", c["component"], c["sha256"])), ";"), 256).alias("root"),
    )
    return out


def dedup_key(*fields: str) -> Column:
    """SHA-256 of the canonical JSON of the fields, by name; nulls are kept."""
    return F.sha2(F.to_json(F.struct(*[F.col(f) for f in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def readable(candidates: DataFrame, linked: DataFrame, allowed: Column, published: DataFrame) -> DataFrame:
    """candidate_id, path: "evidence" if all linked sources may be read, else "publication" if it is published, else null."""
    counts = linked.groupBy("candidate_id").agg(F.count("*").alias("n"), F.count_if(allowed).alias("ok"))
    p = published.select("candidate_id", F.lit(True).alias("published")).distinct()
    rows = candidates.join(counts, "candidate_id", "left").join(p, "candidate_id", "left")
    return rows.select("candidate_id", F.when(F.col("n") == F.col("ok"), "evidence").when(F.col("published"), "publication").alias("path"))


def shadow_hits(texts: DataFrame, batch: str, text: str) -> DataFrame:
    """Adds hit: an earlier batch had the text. Repeats inside a batch are misses, as a batch is looked up whole."""
    first = F.min(batch).over(Window.partitionBy(F.sha2(text, 256)))
    return texts.withColumn("hit", first < F.col(batch))


def expired_sweep(sources: DataFrame, evidence: DataFrame, publications: DataFrame, since: Column, until: Column) -> DataFrame:
    """day, n_sources, n_publications: what expires in a span of time, by the day of the source's end. Evidence may repeat, as only different publications are counted."""
    due = sources.where((F.col("retention_until") > since) & (F.col("retention_until") <= until)).select(*SOURCE, F.date_format("retention_until", "yyyy-MM-dd").alias("day"))
    hit = due.join(evidence.select(*SOURCE, "candidate_id"), SOURCE, "left").join(publications.select("candidate_id", "publication_id"), "candidate_id", "left")
    return hit.groupBy("day").agg(F.count_distinct(*SOURCE).alias("n_sources"), F.count_distinct("publication_id").alias("n_publications"))


def jsonl(rows: DataFrame, key: str, *fields: str) -> DataFrame:
    """key, line: a JSON object per row with the fields in the order given."""
    return rows.select(key, F.to_json(F.struct(*fields)).alias("line"))
