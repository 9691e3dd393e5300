"""Predicates and checks as column expressions; they stay in the JVM and reach the scan where they can."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from redactory.functions.recognizers import CREDIT_ALPHABET, CREDIT_WEIGHTS, ID_CHECKS, ID_WEIGHTS


def weighted_sum(values: list[Column], weights: tuple[int, ...]) -> Column:
    total = F.lit(0)
    for v, w in zip(values, weights, strict=False):
        total = total + v * w
    return total


def id_number_check(number: Column) -> Column:
    """18 characters: 17 digits and the check character; null for other forms."""
    digits = [F.substring(number, i, 1).try_cast("int") for i in range(1, 18)]
    expected = F.substring(F.lit(ID_CHECKS), weighted_sum(digits, ID_WEIGHTS) % 11 + 1, F.lit(1))
    return F.when(number.rlike("^[0-9]{17}[0-9X]$"), expected == F.substring(number, 18, 1))


def id_number_born(number: Column, today: Column) -> Column:
    """Whether the birth date in the number is one, from 1900 to today."""
    day = F.try_to_timestamp(F.substring(number, 7, 8), F.lit("yyyyMMdd")).cast("date")
    return F.coalesce((day >= F.lit("1900-01-01").cast("date")) & (day <= today), F.lit(False))


def credit_code_check(code: Column) -> Column:
    """18 characters of the alphabet with a weighted check character; null for other forms."""
    places = [F.call_function("locate", F.substring(code, i, 1), F.lit(CREDIT_ALPHABET)) - 1 for i in range(1, 18)]
    left = weighted_sum(places, CREDIT_WEIGHTS) % 31
    return F.when(code.rlike(f"^[{CREDIT_ALPHABET}]{{18}}$"), F.substring(F.lit(CREDIT_ALPHABET), (31 - left) % 31 + 1, F.lit(1)) == F.substring(code, 18, 1))


# What makes a text worth a full detection.
SIGNALS = (
    r"https?://|sk-|ak-|-----begin|password|passwd|api[_ -]?key|secret|token|"
    "姓名|联系人|身份证|手机号|电话|地址|住址|账号|账户|合同|金额|密码|口令|密钥|"
    "公司|科技|集团|有限|银行|医院|大学|学校|研究院|事务所|先生|女士"
)
PLACE_ENDINGS = "省市县区镇村街路号室"
SURNAMES = (
    "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏陶姜"
    "戚谢邹喻柏水窦章云苏潘葛奚范彭郎鲁韦昌马苗凤花方俞任袁柳鲍史唐"
    "费廉岑薛雷贺倪汤滕殷罗毕郝邬安常乐于傅皮卞齐康伍余元顾孟平黄"
    "和穆萧尹姚邵汪毛禹狄米贝明臧计伏成戴宋茅庞熊纪舒屈项祝董梁杜"
    "阮蓝闵席季麻强贾江童颜郭梅盛林钟徐邱骆高夏蔡田樊胡凌霍虞万支"
    "柯管卢莫房裘缪干解应宗丁宣邓郁单杭洪包诸左石崔吉龚程陆翁刘叶"
    "龙司白侯廖谭欧阳上官司马诸葛"
)
BEFORE_SURNAME = "，。！？、:：=的叫是为与和"
# End of fixed values.

#: Characters of a word, in any script, and those of Chinese. Neither \\b nor \\w means one thing to all engines.
IN_WORD, HAN = r"\p{L}\p{N}_", r"\x{3400}-\x{9fff}"
PLACE = f"[{PLACE_ENDINGS}](?:$|[^{IN_WORD}]|[{HAN}])"
SURNAME = rf"(?:^|[\s{BEFORE_SURNAME}])[{SURNAMES}][{HAN}]"
NAMES = rf"(?:^|[^{IN_WORD}])[A-Z][a-z]{{1,30}}(?:$|[^{IN_WORD}])|[\x{{c0}}-\x{{24f}}\x{{400}}-\x{{4ff}}\x{{3040}}-\x{{30ff}}\x{{ac00}}-\x{{d7af}}]"


def risk(text: Column, dictionary: tuple[str, ...] = ()) -> Column:
    """1.0 for a dictionary entry or a signal, 0.75 for what looks like a name, else 0.02. The whole text is looked at, by the cheapest tests first."""
    known = text.rlike("[0-9@]")
    for word in dictionary:
        known = known | text.contains(word)
    return F.when(known | F.lower(text).rlike(SIGNALS) | text.rlike(PLACE), 1.0).when(text.rlike(f"{NAMES}|{SURNAME}"), 0.75).otherwise(0.02)


def first_reason(*rules: tuple[str, Column]) -> Column:
    """The code of the first rule that fails (is true), or null. The order is the contract."""
    out = None
    for code, failed in rules:
        out = F.when(failed, code) if out is None else out.when(failed, code)
    return out


def admission_code(body: Column, decompressed: Column, messages: Column, chars: Column, limits: dict) -> Column:
    """First limit that a request exceeds, in fixed order; at the limit it passes."""
    return first_reason(
        ("BODY_TOO_LARGE", body > limits["body"]),
        ("DECOMPRESSED_TOO_LARGE", decompressed > limits["decompressed"]),
        ("RATIO_TOO_HIGH", decompressed > body * limits["ratio"]),
        ("TOO_MANY_MESSAGES", messages > limits["messages"]),
        ("TOO_MANY_CHARS", chars > limits["chars"]),
    )


def capacity_level(free: Column, total: Column, least_free: int) -> Column:
    used = 1 - free / total
    return F.when((free < least_free) | (used >= 0.90), "BLOCKED").when(used >= 0.80, "WARNING").otherwise("OK")


def status_label(withdrawn: Column, retention_until: Column, now: Column) -> Column:
    return F.when(withdrawn, "withdrawn").when(retention_until <= now, "expired").otherwise("active")


def confidence(base: Column, source_kind: Column, span: Column) -> Column:
    """A relation's base score, raised or lowered by the kind of its source, lowered for a span over 100, within 0 and 1."""
    scored = (
        F.when(source_kind == "master_data", F.least(F.lit(1.0), base + 0.15))
        .when(source_kind == "document", F.least(F.lit(1.0), base + 0.10))
        .when(source_kind == "model_output", F.greatest(F.lit(0.1), base - 0.20))
        .otherwise(base)
    )
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), scored - F.when(span > 100, 0.15).otherwise(0.0))), 4)
