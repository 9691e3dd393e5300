"""Requests and responses as JSON: replacing by path, restoring with codes, detectors joined."""

import json

import pytest

from redactory.operators import exchange as ex

MODELS = ("m",)


def scanned(spark, rows):
    return ex.scanned(spark.createDataFrame(rows, "k long, protocol string, body string"), "k", "body", "protocol", MODELS)


def body(*messages, model="m"):
    return json.dumps({"model": model, "messages": list(messages), "temperature": 0.5})


def test_the_first_fault_counts(spark):
    hi = {"role": "user", "content": "hi"}
    rows = [
        (1, "chat", body(hi)), (2, "ftp", "{"), (3, "chat", "{"), (4, "chat", body()), (5, "chat", body({"role": "nobody", "content": "x"}, model="other")), (6, "chat", body(hi, model="other")),
        (7, "messages", body({"role": "system", "content": "x"})), (8, "messages", body({"role": "user", "content": [{"type": "text", "text": "a"}]})), (9, None, None), (10, "chat", '{"model":"m","messages":[{"role":"user","role":"user","content":"x"}]}'),
    ]
    got = {r.k: r.code for r in scanned(spark, rows).collect()}
    assert got == {1: None, 2: "UNSUPPORTED_PROTOCOL", 3: "MALFORMED_JSON", 4: "CONTRACT_VIOLATION", 5: "CONTRACT_VIOLATION", 6: "MODEL_NOT_ALLOWED", 7: "CONTRACT_VIOLATION", 8: None, 9: "UNSUPPORTED_PROTOCOL", 10: "MALFORMED_JSON"}
    assert scanned(spark, rows).limit(0).count() == 0


def test_only_texts_change(spark):
    asked = scanned(spark, [(1, "chat", body({"role": "system", "content": "keep"}, {"role": "user", "content": 'a "b"\n张'})), (2, "chat", body({"role": "user", "content": "left"}))])
    texts = ex.leaves(asked, "k")
    assert {(r.k, r.json_path) for r in texts.collect()} == {(1, "messages[1].content"), (2, "messages[0].content")}
    done = {r.k: r for r in ex.replaced(asked, texts, texts.where("k = 1").selectExpr("k", "json_path", "concat('<A_001>', content) AS value"), "k").collect()}
    assert json.loads(done[1].body) == {"model": "m", "messages": [{"role": "system", "content": "keep"}, {"role": "user", "content": '<A_001>a "b"\n张'}], "temperature": 0.5}
    assert (done[2].body, done[2].code) == (None, "DETECTION_INCOMPLETE")


@pytest.mark.parametrize(("path", "good"), [("messages[0].content", True), ("messages[3].content", False), ("model.x", False), ("messages[0].none", False), ("messages", False)])
def test_a_path_without_a_text_spoils_the_body(path, good):
    root = json.loads(body({"role": "user", "content": "x"}))
    assert ex.put(root, path, "y") is good


def test_originals_are_not_read_again(spark):
    mapping = spark.createDataFrame([(1, "<ORG_001>", "<ORG_002>"), (1, "<ORG_002>", "B"), (2, "<PER_001>", "C")], "request long, token string, original string")
    texts = spark.createDataFrame([(1, 1, "<ORG_001> and <ORG_002>"), (2, 1, "<PER_001>"), (3, 2, "<PER_001>, PER_001"), (4, 2, "no token"), (5, 1, "cut <OR"), (6, 3, "<ORG_001>"), (7, 3, ""), (8, 2, "<PER_00")], "k long, request long, text string")
    got = {r.k: (r.restored, r.code) for r in ex.restored(texts, mapping, "request", "k", "text").collect()}
    assert got == {1: ("<ORG_002> and B", None), 2: (None, "UNKNOWN_TOKEN"), 3: (None, "MALFORMED_TOKEN"), 4: ("no token", None), 5: (None, "MALFORMED_TOKEN"), 6: (None, "UNKNOWN_TOKEN"), 7: ("", None), 8: (None, "MALFORMED_TOKEN")}


def test_a_missing_detector_holds_everything_back(spark):
    fragments = spark.createDataFrame([(1, "abc"), (2, "abc")], "k long, text string")
    found = spark.createDataFrame([(1, 0, 2, "ORG", None, "dict"), (2, 2, 9, "ORG", 3, "dict")], "k long, start int, end int, entity_type string, priority int, source string")
    rows, codes = ex.orchestrated(fragments, {"dictionary": found}, fragments.limit(0).selectExpr("k", "'rules' AS detector"), "k", "text")
    assert {r.code for r in codes.collect()} == {"DETECTION_INCOMPLETE"} and rows.count() == 0
    rows, codes = ex.orchestrated(fragments, {"dictionary": found, "rules": found.limit(0)}, fragments.limit(0).selectExpr("k", "'rules' AS detector"), "k", "text")
    assert {(r.k, r.code) for r in codes.collect()} == {(2, "INVALID_SPAN")}
    assert [(r.k, r.priority) for r in rows.collect()] == [(1, 3)]
