"""Requests and their text fragments: extraction, exemption, masking, restoring, reuse of detections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactory.functions.checks import first_reason
from redactory.functions.recognizers import detect_once
from redactory.operators.spans import TOKEN, merge_spans, number_tokens, replaced, restored
from redactory.sources.tables import stored

CHAT = "model string, messages array<struct<role: string, content: string, tool_call_id: string>>"
#: Roles whose text is searched.
DETECTED = ("user", "assistant", "tool")


def strict_json(body: Column) -> Column:
    """Whether a body is JSON without duplicate keys, NaN or bad UTF-8."""
    return F.is_valid_utf8(body) & F.try_parse_json(body).isNotNull()


def chat_fragments(requests: DataFrame, key: str, body: str, models: tuple[str, ...]) -> DataFrame:
    """A row per message text of the requests with strict JSON and an allowed model: key, json_path, role, content, requires_detection."""
    parsed = requests.where(strict_json(F.col(body))).select(key, F.from_json(body, CHAT).alias("r")).where(F.col("r.model").isin(*models))
    rows = parsed.select(key, F.posexplode("r.messages").alias("i", "m")).where(F.col("m.content").isNotNull())
    return rows.select(key, F.concat(F.lit("messages["), "i", F.lit("].content")).alias("json_path"), F.col("m.role").alias("role"), F.col("m.content").alias("content"), F.col("m.role").isin(*DETECTED).alias("requires_detection"))


def exempt(fragments: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds exempt: the text equals a registered template of its domain whose digest is right."""
    valid = registry.where(F.sha2("text", 256) == F.col("sha256")).select("domain", F.sha2("text", 256).alias("digest"), F.col("text").alias("template")).dropDuplicates(["domain", "digest"])
    keyed = fragments.withColumn("digest", F.sha2("text", 256))
    return keyed.join(valid, ["domain", "digest"], "left").withColumn("exempt", F.coalesce(F.col("template") == F.col("text"), F.lit(False))).drop("digest", "template")


def registry_faults(registry: DataFrame) -> DataFrame:
    """domain, template_id, code: of each registered template its first fault: DUPLICATE_TEMPLATE (an id twice in its domain, all of them), DIGEST_MISMATCH, BLANK_ID; or null. A registry with a fault is not loaded as a whole by callers that ask for none."""
    n = registry.groupBy("domain", "template_id").agg(F.count("*").alias("n"), F.bool_and(F.coalesce(F.sha2("text", 256) == F.col("sha256"), F.lit(False))).alias("right"))
    blank = F.coalesce(F.trim("template_id"), F.lit("")) == ""
    return n.select("domain", "template_id", first_reason(("BLANK_ID", blank), ("DUPLICATE_TEMPLATE", F.col("n") > 1), ("DIGEST_MISMATCH", ~F.col("right"))).alias("code"))


def detect_but_exempt(fragments: DataFrame, registry: DataFrame, key: str, **how) -> tuple[DataFrame, DataFrame]:
    """fragments (key, domain, text) with exempt, and the spans of those that are not: exempt texts never reach a detector, and are there with the others, untouched, afterwards. how: as for detect()."""
    marked = stored(exempt(fragments, registry))
    return marked, detect_once(marked.where("NOT exempt"), key, **how)


def without_skill_results(results: DataFrame, calls: DataFrame, names: tuple[str, ...] = ("Skill",)) -> DataFrame:
    """Tool results but those of calls of the named tools."""
    return results.join(calls.where(F.col("name").isin(*names)), "call_id", "left_anti")


def blocked_requests(fragments: DataFrame, spans: DataFrame, request: str, key: str) -> DataFrame:
    """request, n_fragments, blocked: one secret blocks the whole request."""
    secret = spans.groupBy(key).agg(F.min("priority").alias("priority"))
    return fragments.join(secret, key, "left").groupBy(request).agg(F.count("*").alias("n_fragments"), F.coalesce(F.bool_or(F.col("priority") == 0), F.lit(False)).alias("blocked"))


@dataclass
class Masked:
    """redacted: fragments of unblocked requests with redacted text. mapping: request, entity_type, original, token. uses: a row per replaced span."""

    redacted: DataFrame
    mapping: DataFrame
    uses: DataFrame


def mask(fragments: DataFrame, spans: DataFrame, request: str, key: str, text: str = "text") -> Masked:
    """Spans merged, blocked requests left out of everything, originals numbered per request under their role or type, texts replaced. Role evidence is gathered over all of a request before any number is given."""
    blocked = blocked_requests(fragments, spans, request, key).where("blocked").select(request)
    open_ = fragments.join(blocked, request, "left_anti")
    start = F.col("start")
    original, before = F.substring(text, start + 1, F.col("end") - start), F.substring(text, F.greatest(start - 10, F.lit(0)) + 1, F.least(start, F.lit(10)))
    seen = merge_spans(spans, key).join(open_.select(key, request, text), key).select(request, key, "start", "end", "entity_type", original.alias("original"), before.alias("before"))
    uses = seen.drop("before")
    mapping = number_tokens(uses, request, key, "start", roles=roles(seen, request))
    edits = uses.join(mapping, [request, "entity_type", "original"]).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "token"))).alias("edits"))
    none = F.array().cast("array<struct<start: int, end: int, token: string>>")
    redacted = open_.join(edits, key, "left").withColumn("redacted", replaced(F.col(text), F.coalesce("edits", none)))
    return Masked(redacted.select(request, key, "redacted"), mapping, uses)


def restore(redacted: DataFrame, mapping: DataFrame, request: str, text: str) -> DataFrame:
    """Adds restored: text with its request's tokens put back; unknown tokens stay. The tokens of each distinct text are joined with the mapping one by one, so a request's mapping is never gathered."""
    rows = redacted.withColumn("text_digest", F.sha2(text, 256))
    asked = rows.select(request, "text_digest", F.explode(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))).alias("token")).distinct()
    known = asked.join(mapping.select(request, "token", "original"), [request, "token"]).groupBy(request, "text_digest").agg(F.map_from_entries(F.collect_list(F.struct("token", "original"))).alias("text_known"))
    none = F.create_map().cast("map<string,string>")
    return rows.join(known, [request, "text_digest"], "left").withColumn("restored", restored(F.col(text), F.coalesce("text_known", none))).drop("text_digest", "text_known")


# Words before a name that tell its role, and what may stand between.
ROLE_CUES = (
    ("甲方|发包人|发包方", "PARTYA"), ("乙方|承包人|承包方", "PARTYB"), ("总包|总承包(?:方|人)?", "GENCON"), ("分包", "SUBCON"), ("担保人|保证人", "GUARANTOR"), ("监理", "SUPERVISOR"), ("委托方|委托人", "PRINCIPAL"),
    ("牵头方|牵头投资(?:方)?|主投", "LEAD"), ("标的方|标的公司|投资标的|被投方|被投", "TARGET"), ("合作方|合作伙伴|联合体", "PARTNER"), ("投资方|投资人", "INVESTOR"), ("转让方|出让方", "TRANSFEROR"), ("受让方", "TRANSFEREE"),
)
FILLER = "(?:[：:\\s（）()“\"']|名称|单位名称|公司名称|为|是)*"
# End of fixed values.


def role_scores(window: Column) -> Column:
    """For each role, 0, or a number that is greater the nearer its cue ends to the window's end, with only filler after it, and then the longer the cue is. window: at most 16 characters."""
    found = [(F.length(F.regexp_extract(window, f"({cue}){FILLER}$", 0)), F.length(F.regexp_extract(window, f"({cue}){FILLER}$", 1))) for cue, _ in ROLE_CUES]
    return F.array(*[F.when(cue > 0, (16 - whole + cue) * 32 + cue).otherwise(0) for whole, cue in found])


def roles(spans: DataFrame, request: str, before: str = "before", kinds: tuple[str, ...] = ("ORG", "SUPPLIER")) -> DataFrame:
    """request, entity_type, original, role, for originals with evidence of one role only; a span whose best cues tie gives none. before: the text that leads up to a span; its last ten characters count."""
    window = F.when(F.length(before) > 10, F.right(before, F.lit(10))).otherwise(F.col(before))
    scores = spans.where(F.col("entity_type").isin(*kinds)).withColumn("scores", role_scores(window)).withColumn("best", F.array_max("scores"))
    name = F.element_at(F.array(*[F.lit(role) for _, role in ROLE_CUES]), F.array_position("scores", F.col("best")).cast("int"))
    alone = F.size(F.filter("scores", lambda s: s == F.col("best"))) == 1
    told = scores.withColumn("role", F.when((F.col("best") > 0) & alone, name))
    return told.groupBy(request, "entity_type", "original").agg(F.min("role").alias("role"), F.max("role").alias("other")).where(F.col("role") == F.col("other")).drop("other")


def history_savings(turns: DataFrame, conversation: str, turn: str, text: str) -> DataFrame:
    """Detections if each turn's request repeats the whole history, and if a text is detected once, without making those rows: the row of the n-th turn stands in all later requests."""
    later = F.count("*").over(Window.partitionBy(conversation).orderBy(F.col(turn).desc()))
    return turns.withColumn("n", later).groupBy(conversation).agg(F.sum("n").alias("without_cache"), F.count_distinct(text).alias("with_cache"))


def cache_hits(texts: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """Per group, how often a text had been seen before, over all groups and in order. Texts meet by their digest."""
    first = Window.partitionBy("digest").orderBy(order)
    seen = texts.select(by, order, F.length(text).alias("chars"), F.sha2(text, 256).alias("digest")).withColumn("n", F.row_number().over(first))
    hit = F.col("n") > 1
    return seen.groupBy(by).agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), F.coalesce(F.sum(F.when(hit, F.col("chars"))), F.lit(0)).cast("long").alias("avoided_chars"), F.round(F.count_if(hit) / F.count("*"), 4).alias("hit_rate"))
