"""Payload trees against the standard library, on hand-made messages."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from heedline.functions import payload
from heedline.operators import attachments


def b64(text):
    return base64.urlsafe_b64encode(text.encode()).decode()


def leaf(mime, text=None, **extra):
    body = {"size": 1, **({"data": b64(text)} if text is not None else {})}
    return {"mimeType": mime, "body": {**body, **extra.pop("body", {})}, **extra}


def deep(levels, inner):
    for _ in range(levels):
        inner = {"mimeType": "multipart/mixed", "parts": [inner]}
    return inner


PDF = {"mimeType": "application/pdf", "filename": "report.PDF", "body": {"attachmentId": "A1", "size": 5}}
CASES = {
    "root": (leaf("text/plain", "hi"), ("hi", None), []),
    "first wins": ({"parts": [leaf("text/plain", "one"), leaf("text/plain", "two")]}, ("one", None), []),
    "empty skipped": ({"parts": [leaf("text/plain"), leaf("text/plain", "two")]}, ("two", None), []),
    "depth first": (
        {"parts": [{"parts": [leaf("text/html", "inner")]}, leaf("text/html", "outer")]},
        (None, "inner"),
        [],
    ),
    "own body first": (
        {"mimeType": "text/plain", "body": {"data": b64("own")}, "parts": [leaf("text/plain", "child")]},
        ("own", None),
        [],
    ),
    "very deep": (deep(40, {"parts": [leaf("text/plain", "bottom"), PDF]}), ("bottom", None), ["report.PDF"]),
    "parent is no match": ({"filename": "x.pdf", "body": {"attachmentId": "Z"}, "parts": []}, (None, None), []),
    "root match": (PDF, (None, None), ["report.PDF"]),
    "needs id": ({"parts": [{"filename": "x.pdf", "body": {"size": 3}}, {"filename": "y.txt", "body": {"attachmentId": "q"}}]}, (None, None), []),
    "many in order": (
        {"parts": [{**PDF, "filename": f"{i}.xls", "body": {"attachmentId": str(i)}} for i in range(12)]},
        (None, None),
        [f"{i}.xls" for i in range(12)],
    ),
    "brackets in text": ({"headers": [{"name": "S", "value": "[[[["}], "parts": [leaf("text/plain; x", "[hi]")]}, ("[hi]", None), []),
    "escaped key": (None, ("esc", None), []),
}
ESCAPED = '{"p\\u0061rts":[{"mimeType":"text/plain","body":{"data":"' + b64("esc") + '"}}]}'


@pytest.fixture(scope="module")
def walked(spark):
    rows = [(name, ESCAPED if tree is None else json.dumps(tree)) for name, (tree, _, _) in CASES.items()]
    df = spark.createDataFrame(rows, "id string, raw_payload string")
    parts = df.select("id", payload.part_tree(F.try_parse_json("raw_payload"), "raw_payload").alias("p"))
    bodies = parts.select("id", payload.body_text(F.col("p")).alias("t"), payload.body_html(F.col("p")).alias("h"))
    refs = attachments.attachment_rows(df).orderBy("message_id", "part_path").collect()
    return {r["id"]: (r["t"], r["h"]) for r in bodies.collect()}, refs


@pytest.mark.parametrize("name", CASES)
def test_bodies_and_attachments(walked, name):
    bodies, refs = walked
    assert bodies[name] == CASES[name][1]
    assert [r["filename"] for r in refs if r["message_id"] == name] == CASES[name][2]


def test_headers(spark):
    tree = {"headers": [{"name": "sUBJECT", "value": "a"}, {"name": "Subject", "value": "b"}, {"name": "Subject", "value": "c"}]}
    df = spark.createDataFrame([(json.dumps(tree),), ("{}",), ("no",)], "j string")
    headers = payload.headers_of(F.try_parse_json("j"))
    got = df.select(payload.first_header(headers, "Subject"), payload.header_or(headers, "Subject", "none")).collect()
    assert [tuple(r) for r in got] == [("a", "c"), (None, "none"), (None, "none")]


def test_broken_payloads_give_no_rows(spark):
    df = spark.createDataFrame([("1", "{bad"), ("2", None), ("3", "[]")], "id string, raw_payload string")
    assert attachments.attachment_rows(df).count() == 0
