"""What moves between tasks: texts and payloads stay where they are read, keys go."""

import base64
import datetime as dt
import hashlib
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heedline.catalog import jobs, nested
from heedline.catalog.views import Views
from heedline.operators import inference, joins, pending
from heedline.plans import sync
from heedline.session import folder_names
from heedline.sources import landing, runs, tables


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def documents(spark, folder, ids) -> Views:
    rows = [(i, f"text {n} of {i}", "en", "web", 9) for n, i in enumerate(ids)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    return Views(spark, folder)


def joined_payloads(v) -> list:
    """Every row of the view with every text of its doc_id."""
    rows = v.view("msgs0").join(v.table("documents").select("doc_id", "text"), "doc_id")
    return sorted(rows.select("id", nested.payload_text().alias("raw_payload")).collect())


@pytest.mark.parametrize("ids", [[0, 1, 2, 3, 4, 15, 17, None], [1, 2, 2, 3, 18, 18, 18, None, None]])
def test_payloads_are_those_of_the_join_by_doc_id(spark, folder, ids):
    v = documents(spark, folder, ids)
    assert sorted(nested.payloads(v).select("id", "raw_payload").collect()) == joined_payloads(v)


def test_payloads_of_lone_documents_need_no_join(spark, folder):
    v = documents(spark, folder, range(20))
    assert "Join" not in plan(nested._payloads(v))
    assert "Join" not in plan(jobs._with_payload(v))


@pytest.mark.parametrize("ids", [[0, 1, 2, 3, 15, 17], [1, 2, 2, 3, 18, 18, 18, None]])
def test_messages_with_payload_are_those_of_the_join_by_id(spark, folder, ids):
    v = documents(spark, folder, ids)
    columns = ["id", "body_hash", "date", "internal_date", "synced_at", "raw_payload"]
    whole = v.messages.drop("raw_payload").join(nested.payloads(v).select("id", "raw_payload"), "id")
    key = lambda rows: sorted(map(repr, rows.select(*columns).collect()))
    assert key(jobs._with_payload(v)) == key(whole)


def test_landed_files_are_compressed_and_hold_every_delivery(spark, folder):
    v = documents(spark, folder, range(15))
    landed = jobs._landed(v)
    assert all(name.endswith(".gz") for name in folder_names(spark, landed) if name.startswith("part-"))
    ids = [r["id"] for r in landing.raw_messages(spark, landed).select("id").collect()]
    assert sorted(map(int, ids)) == sorted([*range(15), 0, 7, 14])


def test_deliveries_of_all_days_are_staged_without_a_folder_for_each(spark, folder):
    v = documents(spark, folder, range(0, 400, 40))
    raw = nested.raw_messages(v)
    fresh = pending.new_deliveries(raw.unionByName(raw), raw.where("id = '40'").select("id"))
    assert sorted(int(r["id"]) for r in fresh.select("id").collect()) == [i for i in range(0, 400, 40) if i != 40]
    assert not any(landing.DAY in path for path in fresh.inputFiles())


def test_texts_are_dealt_out_only_where_files_are_few(spark, folder):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = spark.createDataFrame([(i, f"text {i}", "en", "web", 9) for i in range(40)], schema)
    for name, files in (("one", 1), ("many", 2 * spark.sparkContext.defaultParallelism)):
        rows.repartition(files).write.parquet(f"{folder}/{name}/documents.parquet")
    one, many = Views(spark, f"{folder}/one"), Views(spark, f"{folder}/many")
    assert "Repartition" in plan(one.with_text("msgs")) and "Repartition" not in plan(many.with_text("msgs"))
    key = lambda v: sorted(map(repr, v.with_text("msgs").collect()))
    assert key(one) == key(many)


def test_what_lands_is_the_only_copy_of_payloads_that_is_written(spark, folder):
    v = documents(spark, folder, [0, 1, 2, 2, 3, 7, 14, 18])
    lines = lambda at: sorted(r["value"] for r in spark.read.text(at).collect())
    landed = lines(jobs._landed(v))
    assert not hasattr(v, "stored_payloads")
    nested.payloads(v)
    assert landed == lines(jobs._landed(v))


@pytest.mark.parametrize("ids", [range(12), [1, 2, 2, 3, 8, 8, 8, None]])
def test_bodies_need_references_and_no_stored_payloads(spark, folder, ids):
    v = documents(spark, folder, ids)
    html = ["<p>zero</p>", None, "<p>zwei</p>", "x"]
    spark.createDataFrame(list(enumerate(html)), "page_id bigint, html string").repartition(1).write.parquet(f"{folder}/pages.parquet")
    decoded = F.unbase64(F.translate("data", "-_", "+/")).cast("string")
    found = sorted(map(tuple, jobs._bodies(v).select("message_id", "attachment_id", decoded).collect()), key=repr)
    assert not hasattr(v, "stored_payloads")
    known = [i for i in ids if i is not None]
    # A doc_id meets every text of itself, so n rows of it give n * n of each reference.
    wanted = [(str(i), f"{letter}{i}", html[i % 4]) for i in known for _ in range(known.count(i)) for letter, kinds in (("a", (2, 3)), ("s", (3,))) if i % 5 in kinds]
    assert found == sorted(wanted, key=repr)


def test_large_runs_are_written_where_they_are_read(spark, folder):
    table = runs.Table(spark, f"{folder}/t", T.StructType.fromDDL("id string, text string"), ["id"], bucket_rows=4000)
    rows = lambda start, end, text: spark.range(start, end, 1, 3).select(F.col("id").cast("string").alias("id"), F.lit(text).alias("text"))
    files = lambda at: [str(p) for p in Path(f"{folder}/t/{at}").rglob("*.parquet")]
    table.write(rows(0, 12_000, "old"))
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    # Three tasks, four buckets.
    assert len(files("v=0")) == 12 and all(".zstd." in p for p in files("v=0"))
    table.upsert(rows(8_000, 24_000, "new"), [F.col("text")])
    counts = {r["text"]: r["n"] for r in table.read().groupBy("text").agg(F.countDistinct("id").alias("n"), F.count("*").alias("rows")).where("n = rows").collect()}
    assert counts == {"old": 8_000, "new": 16_000}
    wanted = spark.createDataFrame([("3",), ("9000",), ("x",)], "id string")
    assert sorted(map(tuple, table.current(wanted, ["text"]).collect())) == [("3", "old"), ("9000", "new")]
    # Small runs are brought together.
    table.append(rows(30_000, 30_100, "few"))
    assert len(files(f"v={table.number()}")) == 1


@pytest.mark.parametrize("most", [0, 1000])
def test_wanted_contents_meet_bodies_by_either_way(spark, folder, most, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_KEYS", most)
    plans, where_read = [], tables.cut_down
    monkeypatch.setattr(tables, "cut_down", lambda *given: plans.append(where_read(*given)) or plans[-1])
    coded = {c: base64.urlsafe_b64encode(c.encode()).decode() for c in "pqr"}
    given = [("1", "a", "p"), ("1", "a", "p"), ("2", "b", "q"), ("3", "c", "r"), ("4", "d", "p")]
    bodies = spark.createDataFrame([(m, a, coded[c]) for m, a, c in given] + [("5", "e", None)], "message_id string, attachment_id string, data string")
    sha = {c: hashlib.sha256(c.encode()).hexdigest() for c in coded}
    planned = [("1", "a", "p", "downloaded"), ("2", "b", "q", "downloaded"), ("3", "c", "r", "conversion_failed"), ("4", "d", "p", "exists")]
    plan_rows = [(m, a, f"/s/{c}", sha[c], f"s/2024-01/x.com/{c}", status) for m, a, c, status in planned]
    decided = spark.createDataFrame(plan_rows, "message_id string, attachment_id string, path string, content_hash string, raw_path string, status string")
    tables.write_contents(decided, bodies, f"{folder}/contents")
    assert ("broadcast" in plan(plans[0])) == (most > 0)
    stored = tables.stored_contents(spark, f"{folder}/contents").collect()
    assert sorted((r["path"], r["content_hash"], bytes(r["content"])) for r in stored) == [("/s/p", sha["p"], b"p"), ("/s/q", sha["q"], b"q")]


def test_new_messages_are_written_once_into_the_mailbox(spark, folder):
    v = documents(spark, folder, [*range(12), 2, 3])
    box = tables.Mailbox(spark, f"{folder}/box", standing=True)
    raw = nested.raw_messages(v)
    for more in (raw.where("id < '3'"), raw):
        done = sync.sync(box, more, None, dt.datetime(2024, 1, 31, 12), None)
        assert done["messages"].inputFiles() and all(f"{folder}/box/messages/" in path for path in done["messages"].inputFiles())
    assert sorted(r["id"] for r in done["messages"].select("id").collect()) == sorted("3456789")
    stored = [r["id"] for r in box.messages.read().select("id").collect()]
    assert sorted(stored, key=int) == [str(i) for i in range(12)]
    assert box.standing.open(tables.MESSAGE).count() == 12


def staged_rows(spark, folder) -> tuple:
    """Staged rows of two loads and picks on both sides of a block's end."""
    loads = spark.range(0, 70_000, 1, 2).crossJoin(spark.createDataFrame([(0,), (11,)], "load int")).repartition(3)
    named = loads.select(F.col("id").cast("string").alias("id"), F.concat_ws("-", "load", "id").alias(landing.ROW), F.repeat(F.lit("x"), 20).alias("payload"))
    named.write.parquet(f"{folder}/staged")
    picks = [(n, load) for n in (0, 1, 2, 7, 8, 9, 255, 256, 32767, 32768, 32769, 32770, 65536, 65537, 69999) for load in (0, 11) if (n + load) % 3]
    rows = [(str(n), f"{load}-{n}") for n, load in picks]
    spark.createDataFrame(rows, f"id string, {landing.ROW} string").write.parquet(f"{folder}/picks")
    return spark.read.parquet(f"{folder}/staged"), spark.read.parquet(f"{folder}/picks"), sorted(rows)


@pytest.mark.parametrize("blocks, moved", [(10, False), (0, True)])
def test_picks_meet_payloads_where_they_are_read(spark, folder, blocks, moved, monkeypatch):
    staged, picks, wanted = staged_rows(spark, folder)
    monkeypatch.setattr(landing, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(joins, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(landing, "BROADCAST_BLOCKS", blocks)
    found = landing.picked(staged, picks)
    assert found.columns == staged.columns and sorted(tuple(r) for r in found.select("id", landing.ROW).collect()) == wanted
    assert ("strategy=merge" in plan(found), "strategy=broadcast" in plan(found)) == (moved, not moved)
    # Names that are not unique do not bring in other rows.
    other = staged.unionByName(staged.withColumn("id", F.concat(F.lit("o"), "id")))
    assert sorted(tuple(r) for r in landing.picked(other, picks).select("id", landing.ROW).collect()) == wanted


def test_deliveries_beyond_a_broadcast_list_stay_where_they_are_staged(spark, folder, monkeypatch):
    monkeypatch.setattr(landing, "BROADCAST_KEYS", 2)
    monkeypatch.setattr(joins, "BROADCAST_KEYS", 2)
    v = documents(spark, folder, range(20))
    raw = nested.raw_messages(v)
    fresh = pending.new_deliveries(raw.unionByName(raw), raw.where("id < '15'").select("id"))
    assert "strategy=merge" not in plan(fresh)
    assert sorted(int(r["id"]) for r in fresh.select("id").collect()) == [2, 3, 4, 5, 6, 7, 8, 9, 15, 16, 17, 18, 19]
    assert all(".zstd." in path for path in fresh.inputFiles() if "/staged-" in path)


@pytest.mark.parametrize("most", [0, 1000])
def test_texts_and_bytes_move_once_to_their_calls(spark, folder, most, monkeypatch):
    def echoed(batch: pd.DataFrame) -> pd.DataFrame:
        """What a row was sent with."""
        content = batch["content"].map(lambda b: None if b is None else bytes(b).decode())
        return pd.DataFrame({"status": "ok", "text": batch["text"].fillna("-") + "/" + content.fillna("-"), "error": None}, index=batch.index)

    for module in (inference, joins):
        monkeypatch.setattr(module, "BROADCAST_KEYS", most)
    texts = [(str(i), f"text {i}") for i in range(20)] + [(None, "of nobody"), ("h1", "like a hash")]
    contents = [("h1", b"one"), ("h2", b"two"), ("3", b"like an id"), (None, b"of nothing")]
    for name, rows, schema in (("texts", texts, "message_id string, text string"), ("contents", contents, "content_hash string, content binary")):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}")
    mails = [("email", i, f"m{i}") for i in ("1", "3", "99", None)]
    rows = [*mails, ("email", None, "other"), ("pdf", None, "h1"), ("pdf", "3", "h2"), ("pdf", None, "lost"), (None, "1", "no kind")]
    missing = [F.lit(None).cast("string").alias(c) for c in ("path", "subject", "sender", "label", "date")]
    tasks = spark.createDataFrame(rows, "type string, message_id string, content_hash string").select("*", *missing)
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sent = inference.call(tasks, echoed, read("texts"), read("contents"), 3, 1, 0.0)
        lines = sent._jdf.queryExecution().executedPlan().toString().splitlines()
        moved = 0
        for line in [n for n, x in enumerate(lines) if "FileScan" in x and f"{folder}/texts" in x]:
            depth = lines[line].index("FileScan")
            for x in reversed(lines[:line]):
                at = len(x) - len(x.lstrip(" :+-"))
                if at < depth:
                    depth, moved = at, moved + ("Exchange hashpartitioning" in x)
        assert moved == 1
        # Rows of one call are in one of the three tasks.
        got = sorted(map(tuple, sent.select("content_hash", "reply").collect()))
        assert sent.rdd.getNumPartitions() == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == sorted([("m1", "text 1/-"), ("m3", "text 3/-"), ("m99", "-/-"), ("mNone", "-/-"), ("other", "-/-"), ("h1", "-/one"), ("h2", "-/two"), ("lost", "-/-")])
