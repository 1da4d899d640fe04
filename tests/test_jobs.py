"""Whole jobs on small hand-made mailboxes, run twice where that must change nothing."""

import base64
import datetime as dt
import hashlib
import json
import re
import sys
from pathlib import Path

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heedline import schemas
from heedline.operators.attempts import NO_TEXT, call_in_batches
from heedline.operators import inference, pending
from heedline.plans import analyze, gists, sync
from heedline.sources import landing, tables
from heedline.streaming import ingest

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NOW = dt.datetime(2024, 1, 31, 12)
QUICK = {"attempts": 2, "delay": 0.0}


def b64(data):
    return base64.urlsafe_b64encode(data).decode()


def raw(i, subject="Hello", body="text", attachments=(), date="Mon, 29 Jan 2024 10:00:00 +0000"):
    parts = [{"mimeType": "text/plain", "body": {"data": b64(body.encode())}}]
    parts += [{"filename": name, "body": {"attachmentId": aid, "size": 3}} for aid, name in attachments]
    headers = {"From": "Ann <ann@shop.example>", "Subject": subject, "Date": date, "Message-ID": f"<{i}@x>"}
    payload = {"mimeType": "multipart/mixed", "headers": [{"name": k, "value": v} for k, v in headers.items()], "parts": parts}
    return {"id": i, "threadId": "t", "labelIds": ["STARRED"], "snippet": body[:10], "internalDate": "1706522400000", "payload": payload}


def land(folder, name, messages):
    path = f"{folder}/{name}.json"
    with open(path, "w") as f:
        f.writelines(json.dumps(m) + "\n" for m in messages)


def classify(batch: pd.DataFrame) -> pd.DataFrame:
    text = batch["text"].fillna("").str.lower()
    status = pd.Series("ok", index=batch.index).mask(text.str.contains("racy"), "blocked").mask(text.str.contains("boom"), "failed")
    reply = json.dumps({"category": "other", "intent": "info", "frivolous": False, "broadcast": False, "obligation": True, "critical": False, "sender": "S", "clue": "c"})
    return pd.DataFrame({"status": status, "text": reply, "error": "no luck"}, index=batch.index)


@pytest.fixture
def box(spark, tmp_path):
    incoming = tmp_path / "landing"
    incoming.mkdir()
    land(
        incoming,
        "a",
        [
            raw("1", body="plain one"),
            raw("2", body="plain one"),
            raw("3", body="racy"),
            raw("4", body="boom"),
            raw("5", attachments=[("A", "x.pdf"), ("B", "y.xls")]),
            raw("5", attachments=[("A", "x.pdf"), ("B", "y.xls")]),
            raw("6", attachments=[("C", "same.pdf"), ("D", "z.png")]),
            raw("7", body="plain one", date="nonsense"),
        ],
    )
    return tables.Mailbox(spark, str(tmp_path / "box")), str(incoming)


def bodies(spark):
    rows = [("5", "A", b64(b"pdf bytes")), ("5", "B", b64(b"sheet")), ("6", "C", b64(b"pdf bytes"))]
    return spark.createDataFrame(rows, schemas.RAW_ATTACHMENTS)


def test_sync_then_sync_again(spark, box):
    mailbox, incoming = box
    options = analyze.Options(model="m", **QUICK)
    done = sync.sync(mailbox, landing.raw_messages(spark, incoming), bodies(spark), NOW, None, classify, options)
    statuses = {(r["message_id"], r["attachment_id"]): (r["status"], r["path"]) for r in done["attachments"].collect()}
    pdf, sheet = (hashlib.sha256(b).hexdigest() for b in (b"pdf bytes", b"sheet"))
    first = f"2024-01/shop.example/20240129-shop.example-5-x-{pdf}.pdf"
    assert statuses == {
        ("5", "A"): ("downloaded", first),
        ("5", "B"): ("conversion_failed", f"2024-01/shop.example/20240129-shop.example-5-y-{sheet}.xls"),
        ("6", "C"): ("exists", first),
    }
    assert mailbox.messages.read().count() == 7
    stored = mailbox.attachments.read()
    assert {(r["message_id"], r["local_path"]) for r in stored.collect()} == {("5", first), ("6", first)}

    outcome = {r["task_id"]: (r["description"] is not None, r["error"]) for r in done["results"].collect()}
    assert outcome["4"] == (False, "no luck") and outcome["1"] == outcome["2"] == (True, None) and outcome["3"][0]
    rows = mailbox.extractions.read().collect()
    hashes = mailbox.messages.read().select("body_hash").distinct().count()
    assert len(rows) == hashes == len({r["content_hash"] for r in rows})

    before = {name: sorted(map(str, getattr(mailbox, name).read().collect())) for name in ("messages", "attachments", "extractions")}
    again = sync.sync(mailbox, landing.raw_messages(spark, incoming), bodies(spark), NOW, None, classify, options)
    after = {name: sorted(map(str, getattr(mailbox, name).read().collect())) for name in before}
    assert again["results"].count() == 0 and before == after
    assert [tuple(d["tally"].first()) for d in (done, again)] == [(8, 0, 8, 7, 0), (8, 8, 0, 0, 0)]
    assert [(r["path"], bytes(r["content"])) for r in mailbox.contents().collect()] == [(first, b"pdf bytes")]


def test_failed_come_back_and_blocked_do_not(spark, box):
    mailbox, incoming = box
    sync.sync(mailbox, landing.raw_messages(spark, incoming), None, NOW, None, classify, analyze.Options(model="m", **QUICK))
    retry = analyze.Options(model="other", retry_failed=True, **QUICK)
    assert [r["task_id"] for r in analyze.analyze_mailbox(mailbox, classify, NOW, retry).collect()] == ["4"]

    def fixed(batch):
        return classify(batch.assign(text="fine"))

    analyze.analyze_mailbox(mailbox, fixed, NOW, retry)
    assert analyze.analyze_mailbox(mailbox, fixed, NOW, retry).count() == 0


def test_dry_run_writes_nothing_and_force_redoes(spark, box):
    mailbox, incoming = box
    sync.sync(mailbox, landing.raw_messages(spark, incoming), None, NOW, None, classify, analyze.Options(model="m", **QUICK))
    stored = sorted(map(str, mailbox.extractions.read().collect()))
    preview = analyze.analyze_mailbox(mailbox, classify, NOW, analyze.Options(model="m", dry_run=True, **QUICK))
    assert preview.count() == 7 and sorted(map(str, mailbox.extractions.read().collect())) == stored
    forced = analyze.analyze_mailbox(mailbox, classify, NOW, analyze.Options(model="m", force=True, **QUICK))
    assert forced.where("from_cache").count() == 0
    reused = analyze.analyze_mailbox(mailbox, classify, NOW, analyze.Options(model="m", force=True, compat=True, **QUICK))
    assert {r["task_id"] for r in reused.where("NOT from_cache").collect()} == {"4"}


def test_errors_show_though_noise_is_hidden(spark, box):
    mailbox, incoming = box
    done = sync.sync(mailbox, landing.raw_messages(spark, incoming), None, NOW, None, classify, analyze.Options(model="m", **QUICK))
    shown = gists.gists(mailbox.extractions.read(), mailbox.messages.read(), NOW.date()).collect()
    assert "3" not in {r["id"] for r in shown}
    assert [r["group"] for r in shown if r["id"] == "4"] == [-1]
    report = gists.results_view(done["results"], mailbox.messages.read(), NOW.date()).collect()
    assert [(r["group"], r["error"]) for r in report if r["id"] == "4"] == [(-2, "no luck")]
    assert [r["week_label"] for r in report if r["id"] == "7"] == ["sometime"]


def test_converted_documents_are_stored_and_found_done(spark, box):
    mailbox, incoming = box
    sheet = hashlib.sha256(b"sheet").hexdigest()
    converted = spark.createDataFrame([(sheet, "pdfhash")], "content_hash string, pdf_hash string")
    sync.sync(mailbox, landing.raw_messages(spark, incoming), bodies(spark), NOW, None, converted=converted)
    row = mailbox.attachments.read().where("gmail_attachment_id = 'B'").first()
    assert row["pdf_hash"] == "pdfhash" and row["local_path"].endswith(f"5-y-{sheet}.pdf")
    cache = spark.createDataFrame([("pdfhash", "m:gist:v3", "{}", NOW, None)], schemas.EXTRACTIONS)
    open_rows = pending.unclassified_documents(mailbox.attachments.read(), cache).collect()
    assert {r["gmail_attachment_id"] for r in open_rows} == {"A", "C"}


def test_contents_are_written_once(spark, box, folder):
    mailbox, incoming = box
    sync.sync(mailbox, landing.raw_messages(spark, incoming), bodies(spark), NOW, None, content_folder=f"{folder}/contents")
    rows = spark.read.parquet(f"{folder}/contents").collect()
    assert [bytes(r["content"]) for r in rows] == [b"pdf bytes"]


def test_backfill_takes_what_is_missing(spark, box):
    mailbox, incoming = box
    sync.sync(mailbox, landing.raw_messages(spark, incoming), None, NOW, None)
    first = sync.backfill(mailbox, bodies(spark).where("attachment_id = 'C'"), NOW, 30).collect()
    assert [(r["attachment_id"], r["status"]) for r in first] == [("C", "downloaded")]
    second = sync.backfill(mailbox, bodies(spark), NOW, 30).collect()
    assert {(r["attachment_id"], r["status"]) for r in second} == {("A", "exists"), ("B", "conversion_failed")}


def test_stream_takes_each_id_once(spark, box, folder):
    _, incoming = box
    log, checkpoint = f"{folder}/log", f"{folder}/checkpoint"

    def run(checkpoint):
        ingest.ingest(ingest.raw_stream(spark, incoming, 1), log, checkpoint, NOW).awaitTermination()
        return sorted(r["id"] for r in ingest.stored_log(spark, log).collect())

    assert run(checkpoint) == [str(i) for i in range(1, 8)]
    assert run(checkpoint) == [str(i) for i in range(1, 8)]
    land(incoming, "b", [raw("7"), raw("8")])
    assert run(checkpoint) == [str(i) for i in range(1, 9)]
    # A new checkpoint reads everything again and stores nothing twice.
    assert run(f"{folder}/other") == [str(i) for i in range(1, 9)]


def test_older_tables_are_migrated_once(spark):
    old = spark.createDataFrame(
        [("1", "s", "f", "b", "20 Apr 2026 10:00:00 +0000", '{"headers":[{"name":"message-id","value":"<1>"}]}'), ("2", "", "", "", "x", None)],
        "id string, subject string, from_addr string, body_text string, date string, raw_payload string",
    )
    once = tables.migrate_messages(old)
    rows = {r["id"]: r for r in once.collect()}
    expected = hashlib.sha256(b"From: f\nSubject: s\n\nb").hexdigest()
    assert (rows["1"]["body_hash"], rows["1"]["message_header_id"], rows["1"]["internal_date"]) == (expected, "<1>", 1776679200)
    assert (rows["2"]["body_hash"], rows["2"]["internal_date"]) == (None, None)
    assert sorted(map(str, tables.migrate_messages(once).collect())) == sorted(map(str, once.collect()))


def _prunes(df):
    return re.search(r"PartitionFilters: \[[^\]]*__bucket", df._jdf.queryExecution().toString()) is not None


def _files(folder):
    return {p: p.stat().st_size for p in Path(folder).rglob("*.parquet")}


def test_one_row_update_leaves_other_files(spark, folder):
    table = tables.Table(spark, f"{folder}/t", schemas.EXTRACTIONS, tables.EXTRACTION_KEY, bucket_rows=10)
    rows = [(f"h{i}", "m", f"text {i}", NOW, None) for i in range(100)]
    order = tables.extraction_order()
    table.upsert(spark.createDataFrame(rows[:60], schemas.EXTRACTIONS), order)
    table.upsert(spark.createDataFrame(rows[60:], schemas.EXTRACTIONS), order)
    before = _files(folder)
    changed = spark.createDataFrame([("h7", "m", "new", NOW, None), ("h7", "m", "newer", NOW + dt.timedelta(1), None)], schemas.EXTRACTIONS)
    table.upsert(changed, order)
    after = _files(folder)
    assert before.items() <= after.items() and len(after) - len(before) == 2
    got = {r["content_hash"]: r["extracted_json"] for r in table.read().collect()}
    assert len(got) == 100 and got["h7"] == "newer" and got["h8"] == "text 8" and table.read().count() == 100
    table.write(table.read().where("content_hash = 'h7'"))
    assert [r["extracted_json"] for r in table.read().collect()] == ["newer"]
    table.upsert(spark.createDataFrame([], schemas.EXTRACTIONS), order)
    assert table.read().count() == 1
    unused = table.remove_unused()
    assert unused and [r["extracted_json"] for r in table.read().collect()] == ["newer"]


def test_an_update_writes_little_more_than_its_rows(spark, folder):
    table = tables.Table(spark, f"{folder}/t", schemas.EXTRACTIONS, tables.EXTRACTION_KEY, bucket_rows=500)
    rows = lambda n, step, note: spark.range(0, n, step).select(
        F.sha2(F.col("id").cast("string"), 256).alias("content_hash"), F.lit("m").alias("model_name"),
        F.concat(F.lit(note), F.sha2(F.col("id").cast("string"), 512)).alias("extracted_json"), F.lit(NOW).alias("created_at"), F.lit(None).cast("string").alias("message_id"),
    )
    table.write(rows(20_000, 1, ""))
    before = _files(folder)
    assert len({p.parent for p in before}) > 32  # the bucket count follows the rows
    table.upsert(rows(20_000, 50, "new "), tables.extraction_order())
    written = sum(size for p, size in _files(folder).items() if p not in before)
    assert before.items() <= _files(folder).items() and written < 0.05 * sum(before.values())
    assert table.read().where("extracted_json LIKE 'new %'").count() == 400 and table.read().count() == 20_000
    # Keys of one bucket are looked up in that bucket.
    one = table.stored(rows(20_000, 51, "").select(*tables.EXTRACTION_KEY), ["extracted_json"])
    assert one.count() == 401 and not _prunes(one)
    few = table.stored(rows(100, 51, "").select(*tables.EXTRACTION_KEY), ["extracted_json"])
    assert few.count() == 3 and _prunes(few)  # one of the keys was replaced


def test_increments_of_any_size_give_the_last_write(spark, folder):
    import random

    rng, want = random.Random(2), {}
    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in schemas.EXTRACTIONS])
    table = tables.Table(spark, f"{folder}/t", nullable, tables.EXTRACTION_KEY, bucket_rows=8)
    unkeyed = 0
    for step, size in enumerate((40, 3, 1, 9, 2, 1, 30, 1, 5)):
        keys = rng.sample(range(60), size)
        rows = [(f"h{k}", "m", f"{step}", NOW, None) for k in keys] + [(f"h{keys[0]}", "m", "lost", NOW - dt.timedelta(1), None)]
        table.upsert(spark.createDataFrame(rows, nullable), tables.extraction_order())
        want |= {f"h{k}": str(step) for k in keys}
        if step % 4 == 1:
            table.append(spark.createDataFrame([(None, "m", "no key", NOW, None)], nullable))
            unkeyed += 1
        got = [(r["content_hash"], r["extracted_json"]) for r in table.read().collect()]
        assert sorted(got, key=str) == sorted([*want.items(), *[(None, "no key")] * unkeyed], key=str)
    assert len(table._state()[1]) <= 6


def test_tables_of_the_bucket_layout_are_read_on(spark, folder):
    rows = lambda *ids: spark.createDataFrame([(i, "m", t, NOW, None) for i, t in ids], schemas.EXTRACTIONS)
    old = {"0/kind=all": {0: [("a", "1"), ("b", "1")], 1: [("c", "1")]}, "1/kind=put": {0: [("a", "2"), ("b", "1")]}, "1/kind=add": {1: [("d", "2")]}}
    for place, buckets in old.items():
        for bucket, some in buckets.items():
            rows(*some).write.parquet(f"{folder}/t/v={place}/bucket={bucket}")
    for version in (0, 1):
        (Path(folder) / f"t/v={version}/_SUCCESS").touch()
    table = tables.Table(spark, f"{folder}/t", schemas.EXTRACTIONS, tables.EXTRACTION_KEY)
    read = lambda: {r["content_hash"]: r["extracted_json"] for r in table.read().collect()}
    assert read() == {"a": "2", "b": "1", "c": "1", "d": "2"}
    table.upsert(rows(("b", "3"), ("e", "3")), tables.extraction_order())
    assert read() == {"a": "2", "b": "3", "c": "1", "d": "2", "e": "3"}


def test_only_outdated_runs_are_migrated(spark, box):
    mailbox, incoming = box
    rows = landing.flatten_messages(landing.raw_messages(spark, incoming).dropDuplicates(["id"]), F.lit(NOW))
    outdated = F.col("id").isin("1", "2")
    mailbox.messages.write(rows.where(~outdated))
    mailbox.messages.append(rows.where(outdated).withColumns({"hash_version": F.lit(1), "body_hash": F.lit("old")}))
    before = _files(mailbox.root)
    runs = len(mailbox.messages._state()[1])
    opened = tables.Mailbox(spark, mailbox.root)
    got = {r["id"]: (r["body_hash"], r["hash_version"]) for r in opened.messages.read().collect()}
    want = {r["id"]: (r["body_hash"], r["hash_version"]) for r in rows.collect()}
    assert got == want and before.items() <= _files(mailbox.root).items()
    assert runs == 2 and len({p for p in _files(mailbox.root)} - set(before)) == 1
    again = _files(mailbox.root)
    tables.Mailbox(spark, mailbox.root)
    assert _files(mailbox.root) == again


def test_contents_with_one_name_tail_do_not_share_a_path(spark):
    names = ["a" * 40 + "-january.pdf", "a" * 40 + "-february.pdf"]
    rows = [("12345678AA", "A", names[0], "0", "x <x@y.z>", None, "h1", 1), ("12345678BB", "B", names[1], "0", "x <x@y.z>", None, "h2", 1)]
    schema = "message_id string, attachment_id string, filename string, part_path string, from_addr string, date string, content_hash string, size_bytes long"
    from heedline.operators import attachments

    plan = attachments.save_plan(spark.createDataFrame(rows, schema), spark.createDataFrame([], schemas.ATTACHMENTS), NOW)
    found = [(r["status"], r["path"]) for r in plan.collect()]
    assert {s for s, _ in found} == {"downloaded"} and len({p for _, p in found}) == 2


def test_late_and_undated_mail_is_kept(spark, tmp_path):
    incoming, once = tmp_path / "in", str(tmp_path / "once")
    incoming.mkdir()

    def run():
        raw_rows = ingest.without_recent_repeats(ingest.raw_stream(spark, str(incoming), 1)).select("id")
        writer = raw_rows.writeStream.format("parquet").option("path", once).option("checkpointLocation", str(tmp_path / "c"))
        writer.trigger(availableNow=True).start().awaitTermination()
        return sorted(r["id"] for r in spark.read.parquet(once).collect())

    land(incoming, "a", [raw("1")])
    assert run() == ["1"]
    late, new, undated = raw("2"), raw("3"), raw("4")
    late["internalDate"], new["internalDate"] = "1000", "1906522400000"
    del undated["internalDate"]
    land(incoming, "b", [new, raw("1")])
    land(incoming, "c", [late, undated, new])
    assert run() == ["1", "2", "3", "4"]


def test_of_differing_deliveries_the_latest_is_taken(spark, tmp_path):
    older, newer = raw("1", body="old"), raw("1", body="new")
    newer["internalDate"] = "1706522500000"
    land(tmp_path, "a", [newer, older, older])
    rows = sync.new_messages(landing.raw_messages(spark, str(tmp_path)), spark.createDataFrame([], schemas.MESSAGES), NOW, None)
    assert [r["snippet"] for r in rows.collect()] == ["new"]


def test_dates_of_headers_count_where_the_feed_has_none(spark, tmp_path):
    dated, undated, lost = raw("1"), raw("2"), raw("3", date="nonsense")
    for message in (undated, lost):
        message["internalDate"] = "soon"
    land(tmp_path, "a", [dated, undated, lost, raw("4") | {"internalDate": "1000"}, raw("5") | {"internalDate": "9" * 18}])
    landed = landing.raw_messages(spark, str(tmp_path))
    for rows in (landed, landing.staged(landed)):
        assert sorted(r["id"] for r in landing.within_days(rows, NOW, 7).collect()) == ["1", "2", "5"]
        assert sync.sync_tally(rows, spark.createDataFrame([], schemas.MESSAGES), NOW, 7).first()["undated"] == 1


def test_landed_files_are_read_once(spark, tmp_path):
    incoming = tmp_path / "in [1]"
    incoming.mkdir()
    box = landing.Landing(spark, str(tmp_path), f"{tmp_path}/staged.d")
    land(incoming, "a", [raw("1"), raw("2")])
    files = landing.Landing(spark, str(incoming).replace("[", "\\[").replace("]", "\\]"), f"{tmp_path}/staged")
    assert files.take_in() == 1 and files.take_in() == 0
    land(incoming, "b*", [raw("2", body="again"), raw("3")])
    assert files.take_in() == 1 and sorted(r["id"] for r in files.read().collect()) == ["1", "2", "2", "3"]
    empty = spark.createDataFrame([], schemas.MESSAGES)
    assert sorted(r["id"] for r in sync.new_messages(files.read(), empty, NOW, 7).collect()) == ["1", "2", "3"]
    assert box.read().count() == 0


def test_sync_reads_landed_files_once(spark, box, monkeypatch):
    mailbox, incoming = box
    scans = []
    write = landing.staged

    def counted(raw, *rest):
        scans.append("json" in raw._jdf.queryExecution().toString())
        return write(raw, *rest)

    for module in (landing, pending):
        monkeypatch.setattr(module, "staged", counted)
    rows = sync.sync(mailbox, landing.raw_messages(spark, incoming), None, NOW, None)
    assert rows["messages"].count() == 7 and scans.count(True) == 1


def test_texts_and_bytes_are_cut_down_before_they_move(spark, folder):
    texts = spark.range(50_000).select(F.col("id").cast("string").alias("message_id"), F.repeat(F.lit("x"), 2000).alias("text"))
    texts.write.parquet(f"{folder}/texts")
    texts = spark.read.parquet(f"{folder}/texts")
    contents = texts.select(F.sha2("message_id", 256).alias("content_hash"), F.encode("text", "utf-8").alias("content"))
    tasks = texts.where("message_id < '1002'").select(
        F.when(F.col("message_id").endswith("1"), "pdf").otherwise("email").alias("type"), "message_id",
        F.sha2("message_id", 256).alias("content_hash"), *[F.lit(None).cast("string").alias(c) for c in ("path", "subject", "sender", "label", "date")],
    )
    sent = inference.call(tasks, classify, texts=texts, contents=contents, attempts=1, delay=0.0)
    plan = sent._jdf.queryExecution().executedPlan().toString()
    # Whatever is exchanged of texts and contents has met the ids of the rows that are sent.
    assert plan.count("LeftSemi") == 2 and "BroadcastHashJoin" in plan
    for line, text in enumerate(lines := plan.splitlines()):
        if "Exchange hashpartitioning" in text or "Exchange REPARTITION" in text:
            depth = text.index("Exchange")
            below = [x for x in lines[line + 1 :] if x.strip(" :+-")][:8]
            if any("texts" in x and "ReadSchema" in x for x in below):
                assert any("LeftSemi" in x for x in below), (depth, below)
    assert sent.count() == tasks.count()


def test_document_bytes_are_read_for_what_is_sent(spark, tmp_path):
    for name, data in (("a.pdf", b"one"), ("b [x].pdf", b"two"), ("c.pdf", b"one"), ("d.pdf", b"three")):
        (tmp_path / name).write_bytes(data)
    fetch = landing.document_contents(spark, str(tmp_path))
    wanted = spark.createDataFrame([(hashlib.sha256(x).hexdigest(),) for x in (b"one", b"two", b"none")], "content_hash string")
    assert sorted(bytes(r["content"]) for r in fetch(wanted).collect()) == [b"one", b"two"]


def test_known_documents_are_not_read_again(spark, tmp_path):
    import os

    docs, manifest = tmp_path / "docs", f"{tmp_path}/manifest"
    docs.mkdir()
    (docs / "a.pdf").write_bytes(b"one")
    (docs / "b.pdf").write_bytes(b"two")
    hashes = lambda: {Path(r["path"]).name: r["content_hash"] for r in landing.documents(spark, str(docs), manifest).collect()}
    digest = lambda data: hashlib.sha256(data).hexdigest()
    assert hashes() == {"a.pdf": digest(b"one"), "b.pdf": digest(b"two")}
    # Other bytes of one length under the old time: nobody looks.
    stamp = os.stat(docs / "a.pdf")
    (docs / "a.pdf").write_bytes(b"ONE")
    os.utime(docs / "a.pdf", ns=(stamp.st_atime_ns, stamp.st_mtime_ns))
    (docs / "b.pdf").write_bytes(b"changed")
    (docs / "c.pdf").write_bytes(b"new")
    assert hashes() == {"a.pdf": digest(b"one"), "b.pdf": digest(b"changed"), "c.pdf": digest(b"new")}
    (docs / "b.pdf").unlink()
    assert set(hashes()) == {"a.pdf", "c.pdf"}


def test_streams_keep_their_state_on_disk(spark, tmp_path):
    incoming = tmp_path / "in"
    incoming.mkdir()
    land(incoming, "a", [raw("1"), raw("1")])
    rows = ingest.without_recent_repeats(ingest.raw_stream(spark, str(incoming), 1)).select("id")
    stream = rows.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    stream.awaitTermination()
    metrics = stream.lastProgress["stateOperators"][0]["customMetrics"]
    assert any(name.startswith("rocksdb") for name in metrics)


def test_a_micro_batch_reads_the_buckets_of_its_ids(spark, box, folder):
    _, incoming = box
    log = f"{folder}/log"
    ingest.ingest(ingest.raw_stream(spark, incoming), log, f"{folder}/c", NOW).awaitTermination()
    index = ingest.id_index(spark, log)
    assert sorted(r["id"] for r in index.read().collect()) == [str(i) for i in range(1, 8)]
    # A log that has no index yet gets one.
    import shutil

    shutil.move(f"{log}/_ids", f"{folder}/old-index")
    assert sorted(r["id"] for r in ingest.id_index(spark, log).read().collect()) == [str(i) for i in range(1, 8)]
    index.bucket_rows = 1
    index.write(index.read())
    found = index.stored(spark.createDataFrame([("3",)], "id string"), ["stream"])
    assert found.count() == 1 and _prunes(found)


def test_documents_are_spread_over_tasks(spark):
    tasks = spark.range(400).select(
        F.lit("pdf").alias("type"), F.sha2(F.col("id").cast("string"), 256).alias("content_hash"),
        *[F.lit(None).cast("string").alias(c) for c in ("message_id", "path", "subject", "sender", "label", "date")],
    )
    contents = tasks.select("content_hash", F.encode("content_hash", "utf-8").alias("content"))

    def sizes(batch):
        size = batch["content"].map(len).astype(str) + f" {len(batch)}"
        return pd.DataFrame({"status": "ok", "text": size, "error": None}, index=batch.index)

    rows = inference.call(tasks, sizes, contents=contents, attempts=1, delay=0.0).collect()
    assert len(rows) == 400 and all(r["reply"].startswith("64 ") for r in rows)
    assert max(int(r["reply"].split()[1]) for r in rows) < 200


def _states(box):
    cache, messages, atts = box.extractions.read(), box.messages.read(), box.attachments.read()
    joined = {
        "open": pending.unclassified_messages(messages, cache), "failed": pending.failed_messages(messages, cache),
        "open documents": pending.unclassified_documents(atts, cache), "failed documents": pending.failed_documents(atts, cache),
    }
    kept = {
        "open": pending.message_filter(messages, cache, "", True, "new", box.standing),
        "failed": pending.message_filter(messages, cache, "", True, "failed", box.standing),
        "open documents": pending.document_filter(atts, cache, "", True, "new", box.standing),
        "failed documents": pending.document_filter(atts, cache, "", True, "failed", box.standing),
    }
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    joined, kept = ({k: rows(df) for k, df in some.items()} for some in (joined, kept))
    assert joined == kept
    return {k: len(x) for k, x in kept.items()}


def test_standing_follows_increments(spark, tmp_path):
    box = tables.Mailbox(spark, f"{tmp_path}/box", standing=True)
    message = lambda i, h: (str(i), h, 2, NOW)
    save = lambda rows: box.save_messages(schemas.align(spark.createDataFrame(rows, "id string, body_hash string, hash_version int, synced_at timestamp"), schemas.MESSAGES))
    answer = lambda h, error, i=None, model="m:gist:v3": (h, model, json.dumps({"error": error}), NOW, i)
    cache = lambda *rows: box.save_extractions(spark.createDataFrame(rows, schemas.EXTRACTIONS))
    save([message(1, "a"), message(2, "a"), message(3, "b"), message(4, None)])
    cache(answer("a", "no", "1"), answer("x", None, "3"), answer("b", None, model="plain"))
    assert _states(box) == {"open": 1, "failed": 2, "open documents": 0, "failed documents": 0}
    save([message(5, "a"), message(3, "c"), message(2, "d")])  # a new copy, and two with another body
    cache(answer("a", None, "1"), answer("d", "no", "9"), answer("x", "no", "3"))  # written over, and again
    rows = [("7", "A", "x.pdf", "p", 1, "/p.pdf", None, NOW), ("7", None, "y.pdf", "q", 1, "/q.pdf", "r", NOW), ("8", None, "y.pdf", None, 1, "/q.pdf", None, NOW)]
    names = "message_id string, gmail_attachment_id string, filename string, content_hash string, size_bytes long, local_path string, pdf_hash string, downloaded_at timestamp"
    box.save_attachments(schemas.align(spark.createDataFrame(rows, names), schemas.ATTACHMENTS))
    cache(answer("p", "no"), answer("r", None))
    assert _states(box) == {"open": 1, "failed": 2, "open documents": 1, "failed documents": 1}
    # Changed behind its back, it is built anew on opening.
    box.extractions.upsert(spark.createDataFrame([answer("p", None, "4")], schemas.EXTRACTIONS), tables.extraction_order())
    box = tables.Mailbox(spark, f"{tmp_path}/box", standing=True)
    assert {r["id"] for r in box.standing.open("email").collect()} == set()
    assert {r["id"] for r in box.standing.failed("pdf").collect()} == set()


def test_a_run_with_standing_reads_increments_only(spark, box, monkeypatch):
    root, incoming = box[0].root, box[1]
    mailbox = tables.Mailbox(spark, root, standing=True)
    options = analyze.Options(source="all", model="m", **QUICK)
    done = sync.sync(mailbox, landing.raw_messages(spark, incoming), bodies(spark), NOW, None, classify, options)
    assert done["results"].count() > 5 and _states(mailbox)["failed"] == 1
    joined = []
    monkeypatch.setattr(pending, "unclassified_messages", lambda *a: joined.append(a))
    assert analyze.analyze_mailbox(mailbox, classify, NOW, options).count() == 0 and not joined
    # An increment opens the buckets of its own keys, not the tables.
    reads = []
    keep = type(mailbox.messages).read
    monkeypatch.setattr(type(mailbox.messages), "read", lambda self: reads.append(self.folder) or keep(self))
    land(incoming, "z", [raw("9", body="later")])
    rows = landing.flatten_messages(landing.raw_messages(spark, f"{incoming}/z.json"), F.lit(NOW))
    mailbox.save_messages(rows)
    assert reads == [] and [r["id"] for r in mailbox.standing.open("email").collect()] == ["9"]
    from heedline.operators import shortid

    assert mailbox.short_length() == shortid.short_id_length(keep(mailbox.messages).select("id")).first()["n"]


def test_short_id_length_follows_increments(spark, tmp_path):
    from heedline.operators import shortid
    from heedline.sources.shortids import ShortIds

    kept, so_far = ShortIds(spark, f"{tmp_path}/short"), []
    assert kept.length() == shortid.short_id_length(spark.createDataFrame([], "id string")).first()["n"]
    for step in (range(3), range(2, 40_000, 7), range(0, 120_000, 5)):
        ids = spark.createDataFrame([(f"id{i}",) for i in step], "id string")
        so_far += [(f"id{i}",) for i in step]
        kept.take_in(ids)
        assert kept.length() == shortid.short_id_length(spark.createDataFrame(so_far, "id string")).first()["n"]


# ---- the worker side of classification, without Spark --------------------------------------


def _batch(n):
    columns = {c: "x" for c in ("type", "message_id", "sender", "subject", "label", "text")}
    return pd.DataFrame({"content_hash": [str(i) for i in range(n)], **columns})


def _run(classify, attempts=3, n=4):
    return list(call_in_batches(classify, attempts, 0.0)(iter([_batch(n)])))[0]


def test_only_open_rows_are_tried_again():
    seen = []

    def flaky(batch):
        seen.append(list(batch["content_hash"]))
        ok = batch["content_hash"].astype(int) < len(seen)
        return pd.DataFrame({"status": ok.map({True: "ok", False: "failed"}), "text": "t", "error": "e"})

    out = _run(flaky)
    assert seen == [["0", "1", "2", "3"], ["1", "2", "3"], ["2", "3"]]
    assert list(out["outcome"]) == ["ok", "ok", "ok", "failed"] and out["reply"].iloc[3] is None


def test_exceptions_and_silence_become_failures():
    def broken(batch):
        raise ValueError("down")

    assert set(_run(broken)["call_error"]) == {"down"}
    silent = _run(lambda b: pd.DataFrame({"status": "ok", "text": "", "error": None}, index=b.index))
    assert set(silent["outcome"]) == {"failed"} and set(silent["call_error"]) == {NO_TEXT}


# ---- plans --------------------------------------------------------------------------------


def test_no_nested_loop_joins(spark):
    messages = spark.createDataFrame([], schemas.MESSAGES)
    atts = spark.createDataFrame([], schemas.ATTACHMENTS)
    cache = spark.createDataFrame([], schemas.EXTRACTIONS)
    for mode in ("new", "failed"):
        tasks = pending.pending_tasks(messages, atts, cache, "m", source="all", mode=mode)
        plan = tasks._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    plan = gists.gists(cache, messages, NOW.date())._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
