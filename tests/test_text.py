import hashlib
from email.utils import parseaddr
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from heedline.functions import gist, ids, text


def one(spark, rows, schema, *columns):
    return spark.createDataFrame(rows, schema).select(*columns).collect()


def test_strip_knows_every_python_space(spark):
    rows = [(c, f"{chr(c)}a{chr(c)}") for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    got = one(spark, rows, "c int, s string", "c", text.strip("s").alias("s"))
    assert {r["c"]: r["s"] for r in got} == {c: s.strip() for c, s in rows}


def test_canonical_text_and_hash(spark):
    cases = [
        ("Bob <b@x.com>", "Hi", "text"),
        (None, None, " \n "),
        ("", "", ""),
        ("a", "", "x" * 8000),
        ("a", "s", "é" * 8001),
        (None, "s", None),
        ("a", None, "  lead and trail  "),
        ("a", "b", " " * 9000),
    ]
    body = text.canonical_text("f", "s", "b").alias("t"), text.message_hash("f", "s", "b").alias("h")
    for (sender, subject, message), row in zip(cases, one(spark, cases, "f string, s string, b string", *body)):
        lines = (f"From: {sender}\n" if sender else "") + (f"Subject: {subject}\n" if subject else "")
        expected = (lines + "\n" + (message or "")).strip()
        assert row["t"] == expected
        assert row["h"] == (hashlib.sha256(expected.encode()).hexdigest() if expected else None)


@pytest.mark.parametrize(
    "address",
    ["Bob <b@x.com>", '"A, B" <a@b.c>', "bare@x.org", "garbage", "a@b.c, d@e.f", "", "<only@x.y>", "c@d.e (Comment)"],
)
def test_reply_address(spark, address):
    got = one(spark, [(address,)], "a string", text.reply_address("a").alias("r"))[0]["r"]
    assert got == (parseaddr(address)[1] or address)


@pytest.mark.parametrize("name", ["a.pdf", ".pdf", "a.", "a.tar.PDF", "x/y.xls", "..pdf", "a..pdf", "", "a/", "a b.c d"])
def test_names_split_like_paths(spark, name):
    path = PurePosixPath(name)
    row = one(spark, [(name,)], "n string", text.path_stem("n").alias("stem"), text.path_suffix("n").alias("ext"))[0]
    assert (row["stem"], row["ext"]) == (path.stem, path.suffix.lower())


def test_document_path(spark):
    row = one(
        spark,
        [("Ann <ann@Shop.Example>", "0123456789", 'in<vo>ice: "7"|?*' + "z" * 40 + ".PDF")],
        "f string, i string, n string",
        text.document_path(F.to_timestamp_ntz(F.lit("2024-03-05 01:02:03")), "f", "i", "n", F.lit("h")).alias("p"),
    )[0]
    assert row["p"] == "2024-03/shop.example/20240305-shop.example-0123456789-in_vo_ice_ _7____" + "z" * 40 + "-h.pdf"


def test_like_folds_ascii_only_and_keeps_wildcards(spark):
    rows = [("ÉCOLE",), ("école",), ("a_b",), ("aXb",), ("100%",), ("a\\b",)]

    def found(term):
        return {r["s"] for r in spark.createDataFrame(rows, "s string").where(text.like_contains("s", term)).collect()}

    assert found("É") == {"ÉCOLE"}
    assert found("COLE") == {"ÉCOLE", "école"}
    assert found("A_B") == {"a_b", "aXb", "a\\b"}
    assert found("\\") == {"a\\b"}


def test_labels(spark):
    rows = [(["SENT"],), (["sent", "x"],), (["STARRED"],), (None,), ([],), ([None],)]
    got = one(spark, rows, "l array<string>", text.not_sent("l").alias("k"))
    assert [r["k"] for r in got] == [False, False, True, True, True, True]


def test_base32_hash(spark):
    import base64

    names = ["", "a", "18f2c", "é"]
    got = one(spark, [(n,) for n in names], "n string", ids.base32_hash("n").alias("h"))
    for name, row in zip(names, got):
        digest = hashlib.sha256(name.encode()).digest()
        assert row["h"] == base64.b32encode(digest).decode().lower().rstrip("=")


def test_money_rounds_half_even(spark):
    rows = [(2.5, "usd"), (3.5, "EUR"), (-0.4, "GBP"), (1e15, "SEK"), (7.0, None), (7.0, "")]
    got = [r["m"] for r in one(spark, rows, "a double, c string", gist.money("a", "c").alias("m"))]
    assert got == ["$2", "€4", "£0", "1000000000000000 SEK", "7", "7"]


def test_bad_bytes_become_replacement_characters(spark):
    got = one(spark, [("_w==",), ("-_-_",), ("a",)], "d string", text.utf8(text.from_base64url("d")).alias("t"))
    assert got[0]["t"] == "�"
    assert got[1]["t"] == b"\xfb\xff\xbf".decode("utf-8", errors="replace")
