"""Composite jobs and streaming: B1-B12, T1, T2, S9."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heedline import schemas
from heedline.catalog.analysis import _TASKS_SQL as ANSWERS_SQL
from heedline.catalog.analysis import KEY
from heedline.catalog.expressions import label_sql, week_sql
from heedline.catalog.linking import SAVE_SQL, SHORT_IDS_SQL, copied_bodies, copied_refs
from heedline.catalog.nested import FLAT_MESSAGES_SQL, base64url, built_payloads, by_doc_id, flat_columns, payload_text, payloads, raw_messages, texts_joined
from heedline.catalog.registry import query
from heedline.catalog.rules import failure_sql, reply_sql
from heedline.catalog.selection import NOT_SENT_SQL, TASKS_SQL, second_delivery, unique_cache
from heedline.catalog.views import AS_OF, AS_OF_TIME, Views, message_columns
from heedline.operators import attachments
from heedline.plans import analyze, gists, sync, views as plan_views
from heedline.rules import by_hash
from heedline.session import durable, new_folder
from heedline.sources import landing, tables
from heedline.streaming import ingest

_QUICK = {"attempts": 1, "delay": 0.0}

# ---- views --------------------------------------------------------------------------------

_GISTS_SQL = (
    SHORT_IDS_SQL
    + f""", rows AS (SELECT m.id, m.date, m.date_key, m.wall_seconds, m.source, c.model_name, extracted_json j, {week_sql("wall_seconds")} AS week_idx
  FROM cache c JOIN msgs m ON c.message_id = m.id WHERE c.model_name LIKE '%:gist:v3'),
ranked AS (SELECT *, case when j->>'error' is not null then -1 when (j->>'critical')::BOOLEAN then 3 when (j->>'obligation')::BOOLEAN then 2
  when (j->>'broadcast')::BOOLEAN or (j->>'frivolous')::BOOLEAN then 0 else 1 end AS priority FROM rows)
SELECT week_idx, {label_sql("week_idx")} AS week_label, priority, r.id, model_name, s.short_id,
  case when wall_seconds is null then left(coalesce(date,''),10) when strftime(make_timestamp(wall_seconds*1000000),'%Y') = '2024'
    then strftime(make_timestamp(wall_seconds*1000000),'%a %b %d') else strftime(make_timestamp(wall_seconds*1000000),'%Y-%m-%d') end AS shown_date,
  j->>'sender' AS sender, '€' || cast(cast(round_even((j->>'amount')::DOUBLE,0) as bigint) as varchar) AS meta, j->>'clue' AS clue, j->>'error' AS error
FROM ranked r JOIN short_ids s ON s.id = r.id"""
)


def _shown(view: DataFrame) -> DataFrame:
    return view.withColumnRenamed("group", "priority").drop("sender_key", "date_key")


@query("b3_gists", _GISTS_SQL + " WHERE priority <> 0")
def gists_view(v: Views) -> DataFrame:
    return _shown(gists.gists(v.cache, v.messages, AS_OF))


@query("b3_gists_filtered", _GISTS_SQL + " WHERE week_idx < 5 AND contains(lower(j), 'item 2')")
def gists_filtered(v: Views) -> DataFrame:
    return _shown(gists.gists(v.cache, v.messages, AS_OF, pattern="Item 2", weeks=5, show_noise=True))


_CLIP = "left(coalesce({c},''),{n}) || case when length({c}) > {n} then '…' else '' end"


def _list_sql(where: str, from_chars: int, subject_chars: int) -> str:
    return f"""SELECT left(id,8) AS short, left(coalesce(date,''),16) AS date, {_CLIP.format(c="from_addr", n=from_chars)} AS from_short,
  {_CLIP.format(c="subject", n=subject_chars)} AS subject_short FROM msgs {where} ORDER BY coalesce(internal_date,0) DESC, id LIMIT 10"""


@query("b4_list", _list_sql("", 35, 40))
def recent(v: Views) -> DataFrame:
    return plan_views.recent(v.messages)


@query("b5_search", _list_sql("WHERE lower(from_addr) LIKE '%src3%' OR lower(subject) LIKE '%src3%'", 30, 35))
def search(v: Views) -> DataFrame:
    return plan_views.search_messages(v.messages, "SRC3")


@query(
    "b6_documents",
    """SELECT message_id, filename, round(size_bytes/1024.0,1) AS size_kb, left(m.from_addr,50) AS from_addr, local_path AS path, m.subject
FROM atts a JOIN msgs m ON m.id = a.message_id ORDER BY downloaded_seconds DESC, message_id, filename LIMIT 20""",
)
def documents(v: Views) -> DataFrame:
    return plan_views.documents(v.attachments, v.messages).drop("downloaded_at")


@query(
    "b10_reply_drafts",
    """, requests AS (SELECT 'src' AS x, cast(turn as string) || cast(conv_id % 10 as string) AS key, min(text) AS body FROM conversations GROUP BY 1, 2),
hits AS (SELECT r.key, r.body, m.*, row_number() OVER (PARTITION BY r.key ORDER BY coalesce(m.internal_date,0) DESC, m.id) AS n
  FROM requests r JOIN msgs m ON m.id = r.key OR m.id LIKE r.key || '%')
SELECT key, id, thread_id, regexp_extract(from_addr,'<(.*)>',1) AS to_addr, case when subject = '' then 'Re: (no subject)'
  when lower(subject) like 're:%' then subject else 'Re: ' || subject end AS reply_subject, message_header_id AS in_reply_to,
  sha256(trim(body, concat(' ',chr(9),chr(10),chr(11),chr(12),chr(13)))) AS body_sha FROM hits WHERE n = 1""",
)
def reply_drafts(v: Views) -> DataFrame:
    key = F.concat(F.col("turn").cast("string"), (F.col("conv_id") % 10).cast("string"))
    requests = v.table("conversations").groupBy(key.alias("key")).agg(F.min("text").alias("body"))
    drafts = plan_views.reply_drafts(requests, v.messages)
    return drafts.select(
        "key", "id", "thread_id", "to_addr", "reply_subject", "in_reply_to", F.sha2("body", 256).alias("body_sha")
    )


# ---- analyze ------------------------------------------------------------------------------

# Contents already answered by any model are not tasks; the rest get the rule's answer, and
# documents have no text, no fallback and are labelled by file name.
_ANALYZE_SQL = f""", todo AS ({TASKS_SQL}),
labelled AS (SELECT t.*, m.source, coalesce(nullif(m.subject,''), m.id) AS label, length(m.canonical) AS n FROM todo t
  JOIN msgs m ON m.id = t.task_id WHERE type = 'email'
  UNION ALL SELECT t.*, m.source, a.filename, 0 FROM todo t JOIN atts a ON a.local_path = t.task_id JOIN msgs m ON m.id = a.message_id WHERE type = 'pdf')
"""
_REFUSED = "(left(content_hash,1) = '1' OR (left(content_hash,1) = '0' AND type = 'pdf'))"


@query(
    "b2_analyze",
    _ANALYZE_SQL
    + f"""SELECT type, task_id, label, content_hash, case when {_REFUSED} then 'refused ' || left(content_hash,8) end AS error,
  case when {_REFUSED} then null when left(content_hash,1) = '0' then 'blocked' else {reply_sql("content_hash", "n")} end AS description FROM labelled""",
)
def analyze_all(v: Views) -> DataFrame:
    options = analyze.Options(source="all", model="lite", **_QUICK)
    done = analyze.analyze(v.messages, v.attachments, v.all_cache, by_hash, AS_OF_TIME, options)
    blocked = F.col("description").contains('"category":"newsletter"')
    return done.results.select(
        "type",
        "task_id",
        "label",
        "content_hash",
        "error",
        F.when(blocked, "blocked").otherwise(F.col("description")).alias("description"),
    )


@query(
    "b2_analyze_view",
    SHORT_IDS_SQL.replace("short_ids AS", "ids AS")
    + f""", open AS (SELECT m.*, {week_sql("wall_seconds")} AS week_idx FROM msgs m WHERE body <> '' AND {NOT_SENT_SQL}
  AND id NOT IN (SELECT message_id FROM cache WHERE model_name LIKE '%:gist:v3' AND message_id IS NOT NULL)
  AND body_hash NOT IN (SELECT content_hash FROM cache WHERE model_name LIKE '%:gist:v3'))
SELECT o.id, week_idx, {label_sql("week_idx")} AS week_label, i.short_id, case left(body_hash,1) when '1' then -2 when 'f' then 2 else 1 end AS priority,
  case left(body_hash,1) when '1' then 'refused ' || left(body_hash,8) end AS error,
  case when left(body_hash,1) <> '1' then length(canonical) || ' characters' end AS clue
FROM open o JOIN ids i ON i.id = o.id WHERE left(body_hash,1) <> '0'""",
)
def analyze_view(v: Views) -> DataFrame:
    """The report of a run: noise hidden, failures on top of their week."""
    options = analyze.Options(model="lite", **_QUICK)
    done = analyze.analyze(v.messages, v.attachments, v.cache, by_hash, AS_OF_TIME, options)
    view = gists.results_view(done.results, v.messages, AS_OF)
    return view.select(
        "id", "week_idx", "week_label", "short_id", F.col("group").alias("priority"), "error", "clue"
    )


@query(
    "s2_stored_upserts",
    """SELECT id, case when doc_id % 6 = 0 then 'later' when doc_id % 3 = 0 then 'again' else snippet end AS snippet, body_hash FROM msgs
UNION ALL SELECT 'n' || id, 'new', body_hash FROM msgs WHERE thread_id = '7'""",
)
def stored_upserts(v: Views) -> DataFrame:
    """A stored table and increments of several sizes, which are merged as they grow."""
    box = tables.Mailbox(v.spark, new_folder(v.spark, "mailbox"))
    box.messages.write(v.messages)
    changes = durable(second_delivery(v), "second-delivery")
    lot = F.pmod(F.xxhash64("id"), F.lit(16))
    for least, most in ((0, 0), (1, 1), (2, 5), (6, 15)):
        box.save_messages(changes.where(lot.between(least, most)))
    return box.messages.read().select("id", "snippet", "body_hash")


def _mailbox(v: Views, extractions: DataFrame) -> tables.Mailbox:
    box = tables.Mailbox(v.spark, new_folder(v.spark, "mailbox"))
    box.messages.write(v.messages)
    box.attachments.write(v.attachments)
    box.extractions.write(extractions)
    return box


@query(
    "b2_analyze_twice",
    ANSWERS_SQL
    + """SELECT count(DISTINCT t.body_hash) AS new_rows, 0 AS second_run FROM tasks t
WHERE t.id NOT IN (SELECT message_id FROM stored WHERE model_name LIKE '%:gist:v3' AND message_id IS NOT NULL)
  AND t.body_hash NOT IN (SELECT content_hash FROM stored WHERE model_name LIKE '%:gist:v3')""",
)
def analyze_twice(v: Views) -> DataFrame:
    """A second run, by another model, finds nothing to do."""
    cache = unique_cache(v)
    box = _mailbox(v, cache)
    analyze.analyze_mailbox(box, by_hash, AS_OF_TIME, analyze.Options(model="lite", **_QUICK))
    again = analyze.analyze_mailbox(box, by_hash, AS_OF_TIME, analyze.Options(model="other", **_QUICK))
    grown = box.extractions.read().join(cache, ["content_hash", "model_name"], "left_anti")
    second = again.agg(F.count(F.lit(1)).cast("int")).scalar()
    return grown.agg(F.count(F.lit(1)).alias("new_rows")).select("new_rows", second.alias("second_run"))


@query(
    "b2_retry_failed",
    f""", tries AS (SELECT *, json_extract_string(extracted_json,'$.error') IS NOT NULL AS failed FROM cache WHERE model_name LIKE '%:gist:v3'),
outcomes AS (SELECT m.id, t.failed FROM msgs m JOIN tries t ON t.message_id = m.id
  UNION ALL SELECT m.id, t.failed FROM msgs m JOIN tries t ON t.content_hash = m.body_hash),
retried AS (SELECT id FROM outcomes GROUP BY id HAVING bool_and(failed))
SELECT m.id AS task_id, left(body_hash,1) = '1' AS failed FROM msgs m JOIN retried r ON r.id = m.id WHERE body <> '' AND {NOT_SENT_SQL}""",
)
def retry_failed(v: Views) -> DataFrame:
    options = analyze.Options(model="pro", retry_failed=True, **_QUICK)
    done = analyze.analyze(v.messages, v.attachments, unique_cache(v), by_hash, AS_OF_TIME, options)
    return done.results.select("task_id", F.col("description").isNull().alias("failed"))


@query(
    "b8_describe_pending",
    """SELECT local_path AS path, case when left(content_hash,1) in ('0','1') then 'refused ' || left(content_hash,8) end AS error FROM (
  SELECT a.* FROM atts a LEFT JOIN all_cache c ON c.content_hash = a.content_hash WHERE c.content_hash IS NULL) AS t WHERE local_path IS NOT NULL""",
)
def describe_pending(v: Views) -> DataFrame:
    done = analyze.describe_documents(v.attachments, v.all_cache, by_hash, AS_OF_TIME, **_QUICK)
    return done.results.select("path", "error")


@query(
    "b8_describe_all",
    """SELECT local_path AS path, case when left(content_hash,1) in ('0','1') then 'refused ' || left(content_hash,8) end AS error
FROM atts WHERE local_path IS NOT NULL AND page_id % 7 <> 0""",
)
def describe_all(v: Views) -> DataFrame:
    done = analyze.describe_documents(
        v.attachments, v.all_cache, by_hash, AS_OF_TIME, everything=True, listing=v.listing, **_QUICK
    )
    return done.results.select("path", "error")


@query(
    "b9_preview",
    f"""SELECT id AS task_id, left(body_hash,1) = '1' AS failed FROM msgs WHERE body <> '' AND {NOT_SENT_SQL}
ORDER BY coalesce(internal_date,0) DESC, id LIMIT 10""",
)
def preview(v: Views) -> DataFrame:
    rows = analyze.preview(v.messages, by_hash, AS_OF_TIME, model="lite", **_QUICK)
    return rows.select("task_id", F.col("description").isNull().alias("failed"))


@query(
    "b11_documents_only",
    _ANALYZE_SQL
    + f"""SELECT content_hash, '{KEY}' AS model_name, case when {_REFUSED} then {failure_sql("source", "label", "'refused ' || left(content_hash,8)")}
  else {reply_sql("content_hash", "n")} end AS extracted_json FROM labelled WHERE type = 'pdf'""",
)
def documents_only(v: Views) -> DataFrame:
    done = analyze.analyze_documents(
        v.messages, v.attachments, v.all_cache, by_hash, AS_OF_TIME, model="lite", **_QUICK
    )
    return done.cache_rows.select("content_hash", "model_name", "extracted_json")


@query(
    "b11_documents_with_bytes",
    _ANALYZE_SQL
    + f""", bytes AS (SELECT sha256(html) AS h, any_value(strlen(html)) AS size FROM pages GROUP BY 1)
SELECT content_hash, '{KEY}' AS model_name, case when {_REFUSED} then {failure_sql("source", "label", "'refused ' || left(content_hash,8)")}
  else {reply_sql("content_hash", "size")} end AS extracted_json FROM labelled JOIN bytes ON h = content_hash WHERE type = 'pdf'""",
)
def documents_with_bytes(v: Views) -> DataFrame:
    """The classifier counts the bytes of the documents it is sent."""
    content = F.col("html").cast("binary")
    contents = v.table("pages").select(F.sha2(content, 256).alias("content_hash"), content.alias("content"))
    done = analyze.analyze_documents(
        v.messages, v.attachments, v.all_cache, by_hash, AS_OF_TIME,
        contents=contents.dropDuplicates(["content_hash"]), model="lite", **_QUICK,
    )
    return done.cache_rows.select("content_hash", "model_name", "extracted_json")


# ---- sync and backfill --------------------------------------------------------------------


def _landed(v: Views) -> str:
    """Raw messages as JSON lines, each seventh delivered twice; payloads are base64, so files are compressed.

    They are built as documents are read: what lands is the one copy of them that is written.
    """
    folder = new_folder(v.spark, "landing")
    raw = raw_messages(v, built_payloads(v))
    repeated = raw.where(F.col("id").cast("long") % 7 == 0)
    lines = raw.unionByName(repeated).select(F.to_json(F.struct(*schemas.RAW_MESSAGES.names)).alias("value"))
    lines.write.option("compression", "gzip").text(folder)
    return folder


def _bodies(v: Views) -> DataFrame:
    """Attachment bodies for every reference of the landed messages: the page of the same number
    modulo the number of pages, so that all are read and contents repeat.  References are stored, not
    the payloads they are read from; pages are coded when they have met them."""
    refs = attachments.attachment_rows(built_payloads(v)).select("message_id", "attachment_id")
    refs, pages = durable(refs, "body-references"), v.table("pages").select("page_id", "html")
    met = refs.join(pages, F.col("message_id").cast("long") % v.table("pages").count() == F.col("page_id"))
    return met.select("message_id", "attachment_id", base64url(F.col("html")).alias("data"))


@query(
    "s1_staged_landing",
    """SELECT id, count(*) AS deliveries FROM (SELECT id, internal_date FROM msgs UNION ALL SELECT id, internal_date FROM msgs WHERE doc_id % 7 = 0) AS m
WHERE internal_date >= epoch(DATE '2024-01-31' - 21) GROUP BY 1""",
)
def staged_landing(v: Views) -> DataFrame:
    """Files that land in two lots; each is read once, and the window prunes by day."""
    raw, path = v.spark.read.text(_landed(v)), new_folder(v.spark, "landing")
    lots, box = F.pmod(F.xxhash64("value"), F.lit(2)), landing.Landing(v.spark, path, new_folder(v.spark, "staged"))
    for lot in range(2):
        raw.where(lots == lot).write.option("compression", "gzip").text(f"{path}/{lot}")
        box.take_in()
    if box.take_in():
        raise RuntimeError("files were staged twice")
    return landing.within_days(box.read(), AS_OF, 21).groupBy("id").agg(F.count(F.lit(1)).alias("deliveries"))


@query("t1_stream_ingest", FLAT_MESSAGES_SQL)
def stream_ingest(v: Views) -> DataFrame:
    """Two runs over one landing folder; the second finds only what is new."""
    folder, checkpoint = new_folder(v.spark, "messages"), new_folder(v.spark, "checkpoint")
    landed = _landed(v)
    for _ in range(2):
        raw = ingest.raw_stream(v.spark, landed, files_per_trigger=4)
        ingest.ingest(raw, folder, checkpoint, AS_OF_TIME).awaitTermination()
    return flat_columns(ingest.stored_log(v.spark, folder))


@query("t2_stream_repeats_dropped", "SELECT id, internal_date FROM msgs")
def stream_repeats(v: Views) -> DataFrame:
    """Several micro-batches in file order, so mail comes early, late and undated."""
    folder, checkpoint = new_folder(v.spark, "once"), new_folder(v.spark, "checkpoint")
    raw = ingest.without_recent_repeats(ingest.raw_stream(v.spark, _landed(v), files_per_trigger=2))
    rows = raw.select("id", (F.col("internalDate").cast("long") / 1000).cast("bigint").alias("internal_date"))
    writer = rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
    return v.spark.read.parquet(folder)


@query(
    "t1_weekly_event_counts",
    """SELECT epoch(date_trunc('week', ts))::BIGINT AS week_start, event_type, count(*) AS rows FROM events GROUP BY ALL""",
)
def weekly_event_counts(v: Views) -> DataFrame:
    """Streaming twin of the week grouping, an extension; all windows are read back."""
    name = "weekly_" + new_folder(v.spark, "w").rsplit("-", 1)[1]
    events = v.spark.readStream.schema(v.table("events").schema).option("pathGlobFilter", "events.parquet").parquet(v.sf_dir)
    counts = ingest.weekly_counts(events, "ts")
    stream = counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True)
    stream.start().awaitTermination()
    return v.spark.table(name).select(F.unix_timestamp("week.start").alias("week_start"), "event_type", "rows")


_SYNC_REFS_SQL = """, refs AS (SELECT cast(doc_id as string) AS message_id, 'a' || doc_id AS attachment_id, true AS pdf, doc_id FROM documents WHERE doc_id % 5 in (2, 3)
  UNION ALL SELECT cast(doc_id as string), 's' || doc_id, false, doc_id FROM documents WHERE doc_id % 5 = 3),
got AS (SELECT r.*, sha256(p.html) AS content_hash FROM refs r JOIN pages p ON p.page_id = r.doc_id % (SELECT count(*) FROM pages)),
-- a PDF path of a content serves every later row of it; message and part order decide
firsts AS (SELECT content_hash, min((message_id, attachment_id = 'a' || doc_id AND doc_id % 5 = 3)) AS place FROM got WHERE pdf GROUP BY 1)
"""


def _synced(v: Views) -> tuple[tables.Mailbox, dict]:
    box = tables.Mailbox(v.spark, new_folder(v.spark, "mailbox"))
    raw = landing.raw_messages(v.spark, _landed(v))
    options = analyze.Options(source="all", model="lite", **_QUICK)
    done = sync.sync(box, raw, _bodies(v), AS_OF_TIME, None, by_hash, options, new_folder(v.spark, "contents"))
    return box, done


@query("b1_sync_messages", FLAT_MESSAGES_SQL)
def sync_messages(v: Views) -> DataFrame:
    return flat_columns(_synced(v)[0].messages.read())


@query(
    "b1_sync_attachments",
    _SYNC_REFS_SQL
    + """SELECT g.message_id, attachment_id, case when (g.message_id, attachment_id = 'a' || doc_id AND doc_id % 5 = 3) = f.place and pdf then 'downloaded'
  when pdf or (g.message_id, false) > f.place then 'exists' else 'conversion_failed' end AS status FROM got g LEFT JOIN firsts f ON f.content_hash = g.content_hash""",
)
def sync_attachments(v: Views) -> DataFrame:
    return _synced(v)[1]["attachments"].select("message_id", "attachment_id", "status")


@query(
    "b7_backfill_refs",
    """SELECT cast(doc_id as string) AS message_id, 'a' || doc_id AS attachment_id FROM documents WHERE doc_id % 5 in (2,3) AND doc_id % 4 <> 0
  AND 1704067200 + doc_id*1800 + 3600 >= epoch(DATE '2024-01-31' - 21)
UNION ALL SELECT cast(doc_id as string), 's' || doc_id FROM documents WHERE doc_id % 5 = 3
  AND 1704067200 + doc_id*1800 + 3600 >= epoch(DATE '2024-01-31' - 21)""",
)
def backfill_refs(v: Views) -> DataFrame:
    """Recent stored payloads against a table holding every fourth message's first reference."""
    stored = _with_payload(v)
    refs = attachments.attachment_rows(stored).where(F.startswith("attachment_id", F.lit("a")))
    kept = refs.where(F.col("message_id").cast("long") % 4 == 0).select(
        "message_id",
        F.col("attachment_id").alias("gmail_attachment_id"),
        "filename",
        F.lit("h").alias("content_hash"),
        F.lit("/docs/x.pdf").alias("local_path"),
    )
    known = schemas.align(kept, schemas.ATTACHMENTS)
    return sync.backfill_refs(stored, known, AS_OF, 21).select("message_id", "attachment_id")


def _with_payload(v: Views) -> DataFrame:
    """Messages with their payloads, as a join by id gives them; where a doc_id is alone that is one row."""
    single, again = by_doc_id(v, "msgs")
    rows = single.withColumn("raw_payload", payload_text())
    if again is not None:
        built = texts_joined(again).select("doc_id", payload_text().alias("raw_payload"))
        rows = rows.unionByName(again.join(built, "doc_id").select(*rows.columns))
    return schemas.align(message_columns(rows), schemas.MESSAGES)


@query(
    "b7_backfill",
    _SYNC_REFS_SQL
    + """SELECT g.message_id, attachment_id, case when (g.message_id, attachment_id = 'a' || doc_id AND doc_id % 5 = 3) = f.place and pdf then 'downloaded'
  when pdf or (g.message_id, false) > f.place then 'exists' else 'conversion_failed' end AS status FROM got g LEFT JOIN firsts f ON f.content_hash = g.content_hash""",
)
def backfill(v: Views) -> DataFrame:
    box = tables.Mailbox(v.spark, new_folder(v.spark, "mailbox"))
    box.messages.write(_with_payload(v))
    return sync.backfill(box, _bodies(v), AS_OF_TIME, days=3650).select("message_id", "attachment_id", "status")


@query("s9_content_sink", SAVE_SQL + "SELECT path, content_hash FROM statuses WHERE status = 'downloaded'")
def content_sink(v: Views) -> DataFrame:
    """New contents as written: one row per content, hash taken from the stored bytes."""
    got = durable(attachments.fetched(copied_refs(v), copied_bodies(v)), "fetched-hashes")
    stored = v.attachments.where(F.col("message_id").cast("long") % 4 == 0)
    page = F.substring("attachment_id", 2, 20).cast("long")
    converted = got.where(page % 10 == 0).select("content_hash", F.sha2("content_hash", 256).alias("pdf_hash"))
    plan = durable(attachments.save_plan(got, stored, AS_OF, "/store/", converted), "save-plan")
    folder = new_folder(v.spark, "contents")
    for _ in range(2):  # a second run adds nothing
        tables.write_contents(plan, copied_bodies(v), folder)
    return tables.stored_contents(v.spark, folder).select("path", F.sha2("content", 256).alias("content_hash"))


@query("b12_download_statuses", _SYNC_REFS_SQL + """SELECT g.message_id, attachment_id, case when (g.message_id, attachment_id = 'a' || doc_id AND doc_id % 5 = 3) = f.place and pdf then 'downloaded'
  when pdf or (g.message_id, false) > f.place then 'exists' else 'conversion_failed' end AS status FROM got g LEFT JOIN firsts f ON f.content_hash = g.content_hash""")
def download_statuses(v: Views) -> DataFrame:
    empty = v.spark.createDataFrame([], schemas.ATTACHMENTS)
    rows = sync.download_statuses(payloads(v).select("id", "raw_payload"), _bodies(v), empty, AS_OF)
    return rows.select("message_id", "attachment_id", "status")
