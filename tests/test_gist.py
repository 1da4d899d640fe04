import json

import pytest
from pyspark.sql import functions as F

from heedline import constants as C
from heedline.functions import gist

GOOD = {
    "category": "billing",
    "intent": "info",
    "frivolous": False,
    "broadcast": False,
    "obligation": False,
    "critical": False,
    "sender": "s",
    "clue": "c",
}


def case(valid, **changes):
    return json.dumps({k: v for k, v in {**GOOD, **changes}.items() if v != "drop"}), valid


CASES = [
    case(True),
    *[case(True, category=c) for c in C.CATEGORIES],
    *[case(True, intent=i) for i in C.INTENTS],
    *[case(True, critical=w) for w in ("true", "T", "yes", "ON", "1", 1, 1.0, "no", "off", "F", "0", 0, 0.0)],
    *[case(False, critical=w) for w in ("", "maybe", 2, None, "1.0", [], {}, "drop")],
    *[case(True, amount=a) for a in (None, 1, 1.5, -2, "3", " 4.5 ", "1e3", True, "nan")],
    *[case(False, amount=a) for a in ("", "1d", "1,5", "abc", [1], {})],
    case(True, clue="x" * 42),
    case(True, clue="é" * 42),
    case(False, clue="x" * 43),
    case(False, clue=None),
    case(False, sender=1),
    case(False, currency=5),
    case(True, currency=None, due_date="soon", code="", error=""),
    case(True, extra={"a": [1]}),
    (json.dumps(GOOD) + " ", True),
    (json.dumps(GOOD) + "x", False),
    (json.dumps(GOOD) + ",{}", False),
    (json.dumps(GOOD) + "]", False),
    (json.dumps(GOOD) + "}", False),
    (json.dumps(GOOD) + ',"b":1', False),
    ("[]", False),
    ("null", False),
    ("", False),
    (None, False),
    (json.dumps([GOOD]), False),
]


def test_validation(spark):
    df = spark.createDataFrame([(i, j) for i, (j, _) in enumerate(CASES)], "i int, j string")
    got = {r["i"]: (r["valid"], r["reason"]) for r in df.select("i", gist.parse_gist("j").alias("p")).select("i", "p.*").collect()}
    wrong = [(CASES[i][0], got[i]) for i in got if got[i][0] != CASES[i][1]]
    assert not wrong
    assert all((reason is None) == valid for valid, reason in got.values())


def test_last_duplicate_wins(spark):
    text = json.dumps(GOOD)[:-1] + ', "sender": "second"}'
    row = spark.createDataFrame([(text,)], "j string").select(gist.parse_gist("j").alias("p")).select("p.gist.sender").first()
    assert row[0] == "second"


@pytest.mark.parametrize(
    ("changes", "group"),
    [
        ({"critical": True, "obligation": True}, 3),
        ({"obligation": True, "broadcast": True}, 2),
        ({"broadcast": True}, 0),
        ({"frivolous": True}, 0),
        ({}, 1),
        ({"error": "x", "critical": True}, -1),
        ({"error": ""}, 1),
        ({"sender": 3}, -1),
    ],
)
def test_priority(spark, changes, group):
    df = spark.createDataFrame([(json.dumps({**GOOD, **changes}),)], "j string").withColumn("p", gist.parse_gist("j"))
    assert df.select(gist.priority_group("j", F.col("p"))).first()[0] == group


def test_no_result_is_first(spark):
    df = spark.createDataFrame([("",), (None,)], "j string").withColumn("p", gist.parse_gist("j"))
    assert [r[0] for r in df.select(gist.priority_group("j", F.col("p"))).collect()] == [-2, -2]


def test_synthetic_records_are_valid(spark):
    df = spark.createDataFrame([('Ann "A" <a@b.c>', "s" * 60, "m1", "e" * 900), (None, None, "m2", "x")], "f string, s string, i string, e string")
    made = df.select(
        gist.blocked_gist("f", "s", "i").alias("blocked"), gist.failure_gist("f", "s", "s", "i", "e").alias("failed")
    )
    rows = made.select(gist.parse_gist("blocked").alias("b"), gist.parse_gist("failed").alias("f"), "blocked", "failed").collect()
    assert all(r["b"]["valid"] and r["f"]["valid"] for r in rows)
    assert list(json.loads(rows[0]["blocked"])) == ["category", "intent", "frivolous", "broadcast", "obligation", "critical", "sender", "amount", "currency", "due_date", "clue", "code", "error"]
    assert rows[0]["b"]["gist"]["error"] is None and rows[0]["f"]["gist"]["error"] == "e" * 900
    assert rows[0]["b"]["gist"]["sender"] == 'Ann "A'
    assert rows[1]["b"]["gist"]["clue"] == "m2" and rows[1]["f"]["gist"]["sender"] == "unknown"


def test_error_test_in_sql_terms(spark):
    texts = ['{"error":"x"}', '{"error":""}', '{"error":null}', "{}", "bad", None]
    df = spark.createDataFrame([(t,) for t in texts], "j string")
    assert [r[0] for r in df.select(gist.error_is_set("j")).collect()] == [True, True, False, False, False, False]
