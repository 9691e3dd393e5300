"""Recognizers: hits, misses and boundaries with exact spans."""

import datetime

import pytest

from redactory.functions.recognizers import detect, recognizers
from redactory.functions.recognizers import CREDIT_ALPHABET, CREDIT_WEIGHTS, ID_CHECKS, ID_WEIGHTS

TODAY = datetime.date(2024, 1, 1)
RULES = {r.name: r for r in recognizers(TODAY)}


def number(body):
    return body + ID_CHECKS[sum(int(d) * w for d, w in zip(body, ID_WEIGHTS, strict=True)) % 11]


def code(body):
    return body + CREDIT_ALPHABET[(31 - sum(CREDIT_ALPHABET.index(c) * w for c, w in zip(body, CREDIT_WEIGHTS, strict=True)) % 31) % 31]


KEY = "sk-" + "a1B2" * 5
PEM = "-----BEGIN RSA PRIVATE KEY-----\nQUJD\n-----END RSA PRIVATE KEY-----"
HITS = [
    ("phone", "打 13812345678 给", ["13812345678"]), ("phone", "138 1234-5678", ["138 1234-5678"]), ("phone", "138123456789", []), ("phone", "12812345678", []), ("phone", "a13812345678b", ["13812345678"]),
    ("id_card", number("11010119900307001"), [number("11010119900307001")]), ("id_card", number("11010119901307001"), []), ("id_card", number("11010119900307001")[:-1] + "A", []), ("id_card", "x" + number("11010119900307001"), []), ("id_card", number("11010120250307001"), []),
    ("uscc", code("91350100M000100Y4"), [code("91350100M000100Y4")]), ("uscc", code("91350100M000100Y4")[:-1] + "I", []),
    ("api_key", f"key={KEY}.", [KEY]), ("api_key", "sk-short", []), ("api_key", "sk-" + "example" * 4, []), ("api_key", "x" + KEY, []),
    ("private_key", f"a {PEM} b", [PEM]), ("private_key", PEM.replace("END RSA", "END EC"), []),
    ("password", 'password = "s3cr3t!"', ["s3cr3t!"]), ("password", "密码：abc，x", ["abc"]), ("password", "password: your-pass", []), ("password", "password abc", []), ("password", "password:a password:b", ["a", "b"]),
    ("money", "付 ¥1,200.50 元", ["¥1,200.50 元"]), ("money", "金额: 1200", ["1200"]), ("money", "金额 2024年", []), ("money", "共 300万元整", ["300万元"]), ("money", "价值 55", []), ("money", "12美元 和 5€", ["12美元", "5€"]),
    ("account", "收款账号: 6222020200112233", ["6222020200112233"]), ("account", "账号 1234567", []), ("account", "号 6222020200112233", []),
    ("contract", "合同编号：HT-2024-00012。", ["HT-2024-00012"]), ("contract", "合同号 HT-24-00012", []), ("contract", "编号 HT-2024-00012", []),
]


@pytest.mark.parametrize(("rule", "text", "expected"), HITS)
def test_cases(rule, text, expected):
    assert [text[a:b] for a, b in RULES[rule].spans(text)] == expected


def test_detect_gives_code_points(spark):
    rows = [(1, "😀 13812345678"), (2, None), (3, ""), (4, "red widget red"), (5, "😀 13812345678")]
    got = detect(spark.createDataFrame(rows, "id long, text string"), "id", entries={"red": "COLOR", "red widget": "ITEM"}, today=TODAY).collect()
    assert sorted((r.id, r.start, r.end, r.entity_type, r.source) for r in got) == [
        (1, 2, 13, "PHONE_NUMBER", "rule:phone"), (4, 0, 10, "ITEM", "dict"), (4, 11, 14, "COLOR", "dict"), (5, 2, 13, "PHONE_NUMBER", "rule:phone"),
    ]
