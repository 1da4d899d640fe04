"""Newest rows: whole rows move for repeated keys alone."""

import datetime as dt

from pyspark.sql import functions as F

from heedline import schemas
from heedline.operators.keyed import newest_of_stored, newest_per_key
from heedline.session import durable
from heedline.sources import tables


def test_newest_of_stored_rows_sorts_repeated_keys_alone(spark):
    rows = [("a", 1, "x"), ("b", 1, "y"), ("b", 2, "z"), (None, 1, "p"), (None, 3, "q"), ("c", 1, "e"), ("c", 1, "e")]
    df = durable(spark.createDataFrame(rows, "id string, at int, body string"), "rows")
    found = newest_of_stored(df, ["id"], [F.col("at")])
    assert sorted(found.collect(), key=repr) == sorted(newest_per_key(df, ["id"], [F.col("at")]).collect(), key=repr)
    assert len(found.collect()) == 4
    once = df.where("id = 'a'")
    assert newest_of_stored(once, ["id"], [F.col("at")]) is once


def test_saved_messages_are_not_aggregated_whole(spark, folder, monkeypatch):
    """Rows whose id comes once must not pass an aggregate over whole rows."""
    aggregated = []
    monkeypatch.setattr("heedline.operators.keyed.newest_per_key", lambda df, *a: aggregated.append(df.count()) or newest_per_key(df, *a))
    box = tables.Mailbox(spark, folder, standing=True)
    at = dt.datetime(2024, 1, 1)
    rows = [(i, "old", at, f"h{i}") for i in "abcd"] + [("d", "new", at + dt.timedelta(1), "hd2")]
    box.save_messages(schemas.align(spark.createDataFrame(rows, "id string, subject string, synced_at timestamp, body_hash string"), schemas.MESSAGES))
    assert {(r["id"], r["subject"]) for r in box.messages.read().collect()} == {("a", "old"), ("b", "old"), ("c", "old"), ("d", "new")}
    assert {r["hash"] for r in box.standing.open("email").collect()} == {"ha", "hb", "hc", "hd2"}
    # The two rows of "d" are all that was.
    assert max(aggregated) == 2
