"""Hot keys: same rows as a plain join, and the hot key spread over many tasks."""

import pytest
from pyspark.sql import functions as F

from heedline.operators import joins, keyed, shortid
from heedline.operators.search import lookup_by_prefix


@pytest.fixture(scope="module")
def sides(spark):
    # A third of the rows share one key, some have none.
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 10 == 1, None).otherwise(F.col("id") % 500)
    left = spark.range(6000).select(F.col("id").cast("string").alias("id"), key.alias("k"))
    right = spark.range(0, 600, 7).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    return left, right


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(sides, how):
    left, right = sides
    salted = joins.lookup_join(left, right, ["k"], how, "id")
    plain = left.join(right, ["k"], how)
    assert rows(salted.select(plain.columns)) == rows(plain)


def test_two_column_key(sides):
    left, right = sides
    left = left.withColumn("k2", F.col("k") % 2)
    right = right.withColumn("k2", F.col("k") % 2)
    salted = joins.lookup_join(left, right, ["k", "k2"], "left_anti", "id")
    assert rows(salted.select(left.columns)) == rows(left.join(right, ["k", "k2"], "left_anti").select(left.columns))


def test_hot_key_is_spread(spark, sides):
    left, right = sides
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        salted = joins.lookup_join(left, right, ["k"], "inner", "id").where("k = 7")
        sizes = salted.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.count("*")).first()
        plain = left.join(right, "k").where("k = 7")
        alone = plain.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.count("*")).first()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert alone[1] == 1 and alone[0] > 2000
    assert sizes[1] > 8 and sizes[0] < alone[0] / 3


def test_hot_list_is_small_and_right(sides):
    left, _ = sides
    hot = {r["k"]: r["__pieces"] for r in joins.hot_keys(left, ["k"]).collect()}
    assert set(hot) == {7} and 15 < hot[7] < 40


def test_every_size_takes_the_same_path(spark, sides):
    left, right = sides
    for rows_ in (left, left.limit(3), left.where("k IS NULL")):
        plan = joins.lookup_join(rows_, right, ["k"], "inner", "id")._jdf.queryExecution().optimizedPlan().toString()
        assert "__salt" in plan
    nulls = left.select("id", F.lit(None).cast("bigint").alias("k"))
    assert joins.lookup_join(nulls, right, ["k"], "left_anti", "id").count() == 6000


def test_repeated_lookup_keys_do_not_multiply_anti_join(sides):
    left, right = sides
    doubled = right.unionByName(right)
    kept = joins.without(left, doubled, ["k"], "id")
    assert rows(kept.select(left.columns)) == rows(left.join(right, ["k"], "left_anti").select(left.columns))


def test_newest_and_first_per_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, None), ("b", 1, "q")], "k string, n int, v string")
    assert rows(keyed.newest_per_key(df, ["k"], [F.col("n")])) == [("a", 3, "z"), ("b", 1, "q")]
    assert rows(keyed.first_per_key(df, ["k"], [F.col("n")])) == [("a", 1, "x"), ("b", 1, "q")]


def test_replace_by_key_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1, "old"), ("b", 1, "old")], "k string, n int, v string")
    new = spark.createDataFrame([("b", 2, "new"), ("c", 2, "new"), ("c", 1, "older")], "k string, n int, v string")
    once = keyed.replace_by_key(old, new, ["k"], [F.col("n")])
    expected = [("a", 1, "old"), ("b", 2, "new"), ("c", 2, "new")]
    assert rows(once) == expected
    assert rows(keyed.replace_by_key(once, new, ["k"], [F.col("n")])) == expected


@pytest.mark.parametrize("count", [0, 1, 40, 5000])
def test_short_ids_match_brute_force(spark, count):
    import base64
    import hashlib

    names = [f"msg{i}" for i in range(count)]
    hashes = {n: base64.b32encode(hashlib.sha256(n.encode()).digest()).decode().lower().rstrip("=") for n in names}
    n = 4
    while len({h[:n] for h in hashes.values()}) < len(hashes):
        n += 1
    df = spark.createDataFrame([(x,) for x in [*names, *names[:3], ""]], "id string")
    got = {tuple(r) for r in shortid.short_ids(df).collect()}
    assert got == {(name, h[: n + 1]) for name, h in hashes.items()}


def test_prefix_lookup_with_wildcards(spark):
    messages = spark.createDataFrame(
        [("abc1", 5), ("abc2", 9), ("ABd", 1), ("x_y", 3), ("xzy", 4), ("q", None)], "id string, internal_date long"
    )
    keys = ["abc1", "ab", "abc", "x_y", "x%", "%", "_bd", "none", "q", ""]
    requests = spark.createDataFrame([(k,) for k in keys], "key string")
    got = dict(map(tuple, lookup_by_prefix(requests, messages).collect()))
    assert got == {
        "abc1": "abc1",
        "ab": "abc2",
        "abc": "abc2",
        "x_y": "xzy",
        "x%": "xzy",
        "%": "abc2",
        "_bd": "ABd",
        "q": "q",
    }


def test_patterns_of_every_form(spark):
    import itertools
    import random
    import re

    rng = random.Random(8)
    ids = {"".join(rng.choice("abAB1\\é") for _ in range(rng.randint(1, 7))) for _ in range(150)} | {"", "aaaa", "abcabc"}
    messages = [(i, rng.choice([None, 1, 2, 3])) for i in sorted(ids)] + [(None, 9)]
    keys = {"".join(p) for n in (1, 2, 3) for p in itertools.product("a1%_", repeat=n)}
    keys |= {"%\\b", "_aA1%b", "%aba%", "abc%b", "ab%a%b", "%é_", "____", "%%", "a" * 9 + "%", "_" * 8}
    fold = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    want = {}
    for key in keys:
        pattern = re.compile("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in fold(key)), re.S)
        hits = [(-(at or 0), i) for i, at in messages if i is not None and pattern.match(fold(i))]
        if hits:
            want[key] = min(hits)[1]
    got = lookup_by_prefix(
        spark.createDataFrame([(k,) for k in keys], "key string"),
        spark.createDataFrame(messages, "id string, internal_date long"),
    )
    assert dict(map(tuple, got.collect())) == want
