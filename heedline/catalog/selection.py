"""Tables, filters, lists and set operations: S1-S6, S10-S12, P1-P21, L1-L6, U1, U2."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heedline import schemas
from heedline.catalog.expressions import NAMES_SQL
from heedline.catalog.registry import query
from heedline.catalog.views import AS_OF, Views
from heedline.functions import text
from heedline.functions import payload
from heedline.operators import attachments, pending, search
from heedline.operators.weeks import recent_weeks, with_week
from heedline.plans import gists, views as plan_views
from heedline.session import durable, new_folder
from heedline.sources import landing, tables

NOT_SENT_SQL = "(label_ids IS NULL OR label_ids NOT LIKE '%\"SENT\"%')"

# ---- tables -------------------------------------------------------------------------------


@query(
    "s1_recent_landed",
    "SELECT id FROM msgs WHERE internal_date >= epoch(DATE '2024-01-31' - 21)",
)
def recent_landed(v: Views) -> DataFrame:
    raw = v.messages.select("id", (F.col("internal_date") * 1000).cast("string").alias("internalDate"))
    return landing.within_days(raw, AS_OF, 21).select("id")


def second_delivery(v: Views) -> DataFrame:
    """A later delivery of every third message, and messages not seen before."""
    m = v.messages
    again = m.where(F.col("id").cast("long") % 3 == 0).withColumns(
        {"synced_at": F.col("synced_at") + F.expr("INTERVAL 1 DAY"), "snippet": F.lit("again")}
    )
    later = again.withColumns(
        {"synced_at": F.col("synced_at") + F.expr("INTERVAL 1 DAY"), "snippet": F.lit("later")}
    ).where(F.col("id").cast("long") % 6 == 0)
    fresh = m.withColumns({"id": F.concat(F.lit("n"), "id"), "snippet": F.lit("new")})
    return again.unionByName(later).unionByName(fresh.where(F.col("thread_id") == "7"))


@query(
    "s2_upsert_messages",
    """SELECT id, case when doc_id % 6 = 0 then 'later' when doc_id % 3 = 0 then 'again' else snippet end AS snippet, body_hash FROM msgs
UNION ALL SELECT 'n' || id, 'new', body_hash FROM msgs WHERE thread_id = '7'""",
)
def upsert_messages(v: Views) -> DataFrame:
    return tables.upsert_messages(v.messages, second_delivery(v)).select("id", "snippet", "body_hash")


@query(
    "s2_latest_of_log",
    """SELECT id, case when doc_id % 6 = 0 then 'later' when doc_id % 3 = 0 then 'again' else snippet end AS snippet FROM msgs
UNION ALL SELECT 'n' || id, 'new' FROM msgs WHERE thread_id = '7'""",
)
def latest_of_log(v: Views) -> DataFrame:
    return tables.latest_messages(v.messages.unionByName(second_delivery(v))).select("id", "snippet")


_LATEST_CACHE = """(SELECT * FROM cache QUALIFY row_number() OVER
  (PARTITION BY content_hash, model_name ORDER BY created_seconds DESC) = 1)"""


@query(
    "s3_upsert_cache",
    f"""SELECT content_hash, model_name, extracted_json, message_id FROM {_LATEST_CACHE} AS c WHERE model_name <> 'lite:gist:v3'
UNION ALL
SELECT content_hash, model_name, '{{"redone":' || created_seconds || '}}', message_id FROM {_LATEST_CACHE} AS c WHERE model_name = 'lite:gist:v3'
UNION ALL
SELECT content_hash, 'new:gist:v3', extracted_json, message_id FROM {_LATEST_CACHE} AS c WHERE model_name = 'pro'""",
)
def upsert_cache(v: Views) -> DataFrame:
    stored = unique_cache(v)
    redone = stored.where(F.col("model_name") == "lite:gist:v3").withColumns(
        {
            "extracted_json": F.concat(F.lit('{"redone":'), F.unix_timestamp("created_at").cast("string"), F.lit("}")),
            "created_at": F.col("created_at") + F.expr("INTERVAL 1 DAY"),
        }
    )
    added = stored.where(F.col("model_name") == "pro").withColumn("model_name", F.lit("new:gist:v3"))
    result = tables.upsert_extractions(stored, redone.unionByName(added))
    return result.select("content_hash", "model_name", "extracted_json", "message_id")


def unique_cache(v: Views) -> DataFrame:
    """The cache view under its key, stored as a table; the raw view repeats keys for twins."""
    if not hasattr(v, "stored_cache"):
        empty = v.spark.createDataFrame([], schemas.EXTRACTIONS)
        v.stored_cache = durable(tables.upsert_extractions(empty, v.cache), "cache")
    return v.stored_cache


@query(
    "s4_cached_text",
    f"""SELECT m.id, c.extracted_json AS cached FROM msgs m LEFT JOIN
  (SELECT * FROM {_LATEST_CACHE} AS u WHERE model_name = 'pro:gist:v3') AS c ON c.content_hash = m.body_hash""",
)
def cached_text(v: Views) -> DataFrame:
    tasks = v.messages.select("id", F.col("body_hash").alias("content_hash"))
    return tables.cached_text(tasks, unique_cache(v), "pro:gist:v3").select("id", "cached")


@query(
    "s4_hot_content",
    f""", latest AS (SELECT * FROM {_LATEST_CACHE} AS u WHERE model_name = 'pro:gist:v3'),
tasks AS (SELECT id, case when doc_id % 3 = 0 then (SELECT min(content_hash) FROM latest) when doc_id % 3 = 1 then body_hash end AS h FROM msgs)
SELECT t.id, c.extracted_json AS cached FROM tasks t LEFT JOIN latest c ON c.content_hash = t.h""",
)
def cached_text_of_hot_content(v: Views) -> DataFrame:
    """One content on a third of the tasks, and none on another third."""
    cache = unique_cache(v)
    hot = cache.where(F.col("model_name") == "pro:gist:v3").agg(F.min("content_hash")).scalar()
    third = F.col("id").cast("long") % 3
    key = F.when(third == 0, hot).when(third == 1, F.col("body_hash")).alias("content_hash")
    return tables.cached_text(v.messages.select("id", key), cache, "pro:gist:v3").select("id", "cached")


def _attachment_changes(v: Views) -> DataFrame:
    """Updates for every fourth stored row and rows for messages without attachments."""
    stored = v.attachments.withColumn("downloaded_at", F.lit(AS_OF).cast("timestamp"))
    changed = stored.where(F.col("message_id").cast("long") % 8 == 0).withColumn("local_path", F.lit("/docs/new.pdf"))
    added = stored.where(F.col("message_id").cast("long") % 10 == 4).withColumn(
        "gmail_attachment_id", F.concat(F.lit("b"), "message_id")
    )
    return changed.unionByName(added)


@query(
    "s5_s6_write_attachments",
    """SELECT message_id, gmail_attachment_id, filename, case when page_id % 4 = 0 and gmail_attachment_id is not null
  then '/docs/new.pdf' else local_path end AS local_path FROM atts
UNION ALL SELECT message_id, gmail_attachment_id, filename, '/docs/new.pdf' FROM atts WHERE page_id % 4 = 0 AND gmail_attachment_id IS NULL
UNION ALL SELECT message_id, 'b' || message_id, filename, local_path FROM atts WHERE page_id % 5 = 2""",
)
def write_attachments(v: Views) -> DataFrame:
    result = attachments.write_attachments(v.attachments, _attachment_changes(v))
    return result.select("message_id", "gmail_attachment_id", "filename", "local_path")


@query(
    "s11_additive_schema",
    "SELECT id, cast(null as string) AS message_header_id, cast(null as bigint) AS internal_date, 17 AS n_columns FROM msgs",
)
def additive_schema(v: Views) -> DataFrame:
    old = v.messages.drop("message_header_id", "body_hash", "internal_date", "date_wall", "hash_version")
    new = schemas.align(old, schemas.MESSAGES)
    return new.select("id", "message_header_id", "internal_date", F.lit(len(new.columns)).alias("n_columns"))


@query(
    "s12_compound_key",
    """SELECT content_hash, model_name, extracted_json FROM cache
QUALIFY row_number() OVER (PARTITION BY content_hash, model_name ORDER BY created_seconds) = 1""",
)
def compound_key(v: Views) -> DataFrame:
    rows = v.view("cache").withColumnRenamed("created_seconds", "id")
    return tables.compound_key(rows).select("content_hash", "model_name", "extracted_json")


# ---- predicates and projections -----------------------------------------------------------


@query("p1_has_body", "SELECT id FROM msgs WHERE coalesce(nullif(body_text,''),nullif(body_html,''),nullif(snippet,'')) IS NOT NULL")
def has_body(v: Views) -> DataFrame:
    return v.messages.where(text.has_body("body_text", "body_html", "snippet")).select("id")


@query("p2_effective_body", "SELECT id, sha256(body) AS body_sha FROM msgs")
def effective_body(v: Views) -> DataFrame:
    body = text.effective_body("body_text", "body_html", "snippet")
    return v.messages.select("id", F.sha2(body, 256).alias("body_sha"))


@query("p3_not_sent", f"SELECT id FROM threads WHERE {NOT_SENT_SQL}")
def not_sent(v: Views) -> DataFrame:
    return v.threads.where(text.not_sent("label_ids")).select("id")


_MATCH_SQL = "(lower(from_addr) LIKE '%{t}%' OR translate(subject,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') LIKE '%{t}%')"


@query("p4_search", f"SELECT id FROM msgs WHERE {_MATCH_SQL.format(t='src_ <')}")
def search_term(v: Views) -> DataFrame:
    return search.matching(v.messages, "SRC_ <").select("id")


@query("p4_search_literal", f"SELECT id FROM msgs WHERE {_MATCH_SQL.format(t='the')}")
def search_literal(v: Views) -> DataFrame:
    return search.matching(v.messages, "The").select("id")


@query(
    "p5_newest_match",
    f"SELECT id, thread_id, subject, from_addr, date FROM msgs WHERE {_MATCH_SQL.format(t='src3')} ORDER BY date DESC NULLS LAST, id LIMIT 1",
)
def newest_match(v: Views) -> DataFrame:
    return search.newest_match(v.messages, "src3")


_REQUESTS_SQL = "(SELECT DISTINCT substr(o_orderkey::VARCHAR, 1, (1 + o_orderkey % 3)::INT) AS key FROM orders)"


@query(
    "p6_lookup_by_prefix",
    f"""SELECT key, id FROM (SELECT r.key, m.id, row_number() OVER (PARTITION BY r.key ORDER BY coalesce(m.internal_date,0) DESC, m.id) AS n
  FROM {_REQUESTS_SQL} AS r JOIN msgs m ON m.id = r.key OR m.id LIKE r.key || '%') AS c WHERE n = 1""",
)
def lookup_by_prefix(v: Views) -> DataFrame:
    return search.lookup_by_prefix(_requests(v), v.messages)


@query(
    "p6_lookup_by_pattern",
    f""", keys AS (SELECT unnest(['%' || key, '_' || substr(key, 2, 9), substr(key, 1, 1) || '%' || substr(key, 2, 1)]) AS key FROM {_REQUESTS_SQL} AS r)
SELECT key, id FROM (SELECT r.key, m.id, row_number() OVER (PARTITION BY r.key ORDER BY coalesce(m.internal_date,0) DESC, m.id) AS n
  FROM (SELECT DISTINCT key FROM keys) AS r JOIN msgs m ON m.id = r.key OR m.id LIKE r.key || '%') AS c WHERE n = 1""",
)
def lookup_by_pattern(v: Views) -> DataFrame:
    """Requests with wildcards, some of which begin with one."""
    forms = ["concat('%', key)", "concat('_', substr(key, 2, 9))", "concat(substr(key, 1, 1), '%', substr(key, 2, 1))"]
    keys = _requests(v).selectExpr(f"explode(array({', '.join(forms)})) AS key").distinct()
    return search.lookup_by_prefix(keys, v.messages)


def _requests(v: Views) -> DataFrame:
    """Id prefixes of one to three digits, taken from the order keys."""
    return v.table("orders").selectExpr("substr(cast(o_orderkey as string), 1, cast(1 + o_orderkey % 3 as int)) AS key").distinct()


@query("p7_grep", "SELECT content_hash, model_name, message_id FROM cache WHERE contains(lower(extracted_json), 'item 1')")
def grep(v: Views) -> DataFrame:
    return gists.grep(v.cache, "ITEM 1").select("content_hash", "model_name", "message_id")


_WEEKS = "datediff('day', date_trunc('week', make_timestamp(wall_seconds*1000000))::DATE, DATE '2024-01-29') // 7"


@query("p8_recent_weeks", f"SELECT id FROM msgs WHERE wall_seconds IS NOT NULL AND {_WEEKS} < 3")
def weeks_filter(v: Views) -> DataFrame:
    return recent_weeks(with_week(v.messages, "date_wall", AS_OF), 3).select("id")


@query(
    "p9_hide_noise",
    """SELECT m.id, c.model_name FROM cache c JOIN msgs m ON c.message_id = m.id WHERE c.model_name LIKE '%:gist:v3'
  AND (extracted_json->>'error' IS NOT NULL OR (extracted_json->>'critical')::BOOLEAN OR (extracted_json->>'obligation')::BOOLEAN
    OR NOT ((extracted_json->>'broadcast')::BOOLEAN OR (extracted_json->>'frivolous')::BOOLEAN))""",
)
def hide_noise(v: Views) -> DataFrame:
    rows = gists.gists_with_message(v.cache, v.messages)
    return gists.ranked(rows, AS_OF).select("id", "model_name")


@query("p10_gist_models", "SELECT content_hash, model_name, message_id FROM all_cache WHERE model_name LIKE '%:gist:v3'")
def gist_models(v: Views) -> DataFrame:
    return pending.gist_rows(v.all_cache, "", gist=True).select("content_hash", "model_name", "message_id")


@query("p11_ready_documents", "SELECT message_id, local_path FROM atts WHERE local_path IS NOT NULL AND page_id % 7 <> 0")
def ready_documents(v: Views) -> DataFrame:
    return pending.ready_documents(v.attachments, v.listing).select("message_id", "local_path")


@query("p12_document_names", "SELECT doc_id FROM documents WHERE doc_id % 8 NOT IN (5, 6)")
def document_names(v: Views) -> DataFrame:
    rows = v.table("documents").selectExpr("doc_id", f"{NAMES_SQL} AS filename")
    return rows.where(text.is_document_name("filename")).select("doc_id")


@query(
    "p13_since_window",
    "SELECT id FROM msgs WHERE synced_seconds >= epoch(DATE '2024-01-31' - 21) OR internal_date >= epoch(DATE '2024-01-31' - 21)",
)
def since_window(v: Views) -> DataFrame:
    return tables.since_window(v.messages, AS_OF, 21).select("id")


@query(
    "p13_since_window_compat",
    "SELECT id FROM msgs WHERE synced_seconds >= epoch(DATE '2024-01-31' - 21) OR date >= '2024-01-10T00:00:00'",
)
def since_window_compat(v: Views) -> DataFrame:
    return tables.since_window(v.messages, AS_OF, 21, compat=True).select("id")


def _every_second(v: Views, **columns) -> DataFrame:
    """Messages with some stored values missing."""
    odd = F.col("id").cast("long") % 2 == 1
    return v.messages.withColumns({name: F.when(odd, value) for name, value in columns.items()})


@query("p14_backfill_body_hash", "SELECT id, case when body <> '' or doc_id % 2 = 1 then body_hash end AS body_hash FROM msgs")
def backfill_body_hash(v: Views) -> DataFrame:
    return tables.backfill_body_hash(_every_second(v, body_hash=F.col("body_hash"))).select("id", "body_hash")


@query("p15_backfill_internal_date", "SELECT id, internal_date FROM msgs")
def backfill_internal_date(v: Views) -> DataFrame:
    missing = _every_second(v, internal_date=F.col("internal_date"))
    return tables.backfill_internal_date(missing).select("id", "internal_date")


@query("p16_backfill_header_id", "SELECT id, message_header_id FROM msgs")
def backfill_header_id(v: Views) -> DataFrame:
    header = F.struct(F.lit("MESSAGE-id").alias("name"), F.col("message_header_id").alias("value"))
    stored = F.to_json(F.struct(F.array(header).alias("headers")))
    known = v.messages.withColumn("raw_payload", F.when(F.col("message_header_id").isNotNull(), stored).otherwise("no json"))
    odd = F.col("id").cast("long") % 2 == 1
    missing = known.withColumn("message_header_id", F.when(odd, F.col("message_header_id")))
    return tables.backfill_message_header_id(missing).select("id", "message_header_id")


@query(
    "p17_rehash_once",
    "SELECT id, case when doc_id % 2 = 1 then 'kept' when body <> '' then body_hash end AS body_hash, 2 AS hash_version FROM msgs",
)
def rehash_once(v: Views) -> DataFrame:
    odd = F.col("id").cast("long") % 2 == 1
    old = v.messages.withColumns(
        {"hash_version": F.when(odd, F.lit(landing.HASH_VERSION)), "body_hash": F.when(odd, "kept").otherwise("old formula")}
    )
    return tables.rehash_once(old).select("id", "body_hash", "hash_version")


@query(
    "p17_mailbox_migration",
    """SELECT id, case when body <> '' then body_hash end AS body_hash, internal_date, 2 AS hash_version FROM msgs""",
)
def mailbox_migration(v: Views) -> DataFrame:
    """A messages table of an older schema, opened twice: its rows are brought up to date once."""
    root = new_folder(v.spark, "old-mailbox")
    old = v.messages.drop("message_header_id", "body_hash", "internal_date", "date_wall", "hash_version")
    old.write.parquet(f"{root}/messages/v=0")
    tables.Mailbox(v.spark, root)
    return tables.Mailbox(v.spark, root).messages.read().select("id", "body_hash", "internal_date", "hash_version")


_CLIP = "left(coalesce({c},''),{n}) || case when length({c}) > {n} then '…' else '' end"


@query(
    "p18_list_rows",
    f"""SELECT left(id,8) AS short, left(coalesce(date,''),16) AS date, {_CLIP.format(c="from_addr", n=35)} AS from_short,
  {_CLIP.format(c="subject", n=40)} AS subject_short FROM msgs""",
)
def list_rows(v: Views) -> DataFrame:
    return search.list_rows(v.messages)


@query(
    "p19_reply_columns",
    """SELECT id, thread_id, regexp_extract(from_addr,'<(.*)>',1) AS to_addr,
  case when subject = '' then 'Re: (no subject)' when lower(subject) like 're:%' then subject else 'Re: ' || subject end AS reply_subject,
  message_header_id AS in_reply_to, message_header_id AS "references" FROM msgs""",
)
def reply_columns(v: Views) -> DataFrame:
    return plan_views.draft_columns(v.messages)


TASKS_SQL = f"""SELECT 'email' AS type, id AS task_id, body_hash AS content_hash, internal_date FROM msgs WHERE body <> '' AND {NOT_SENT_SQL}
  AND id NOT IN (SELECT message_id FROM all_cache WHERE model_name LIKE '%:gist:v3' AND message_id IS NOT NULL)
  AND body_hash NOT IN (SELECT content_hash FROM all_cache WHERE model_name LIKE '%:gist:v3')
UNION ALL
SELECT 'pdf', local_path, content_hash, m.internal_date FROM atts a JOIN msgs m ON m.id = a.message_id WHERE local_path IS NOT NULL
  AND content_hash NOT IN (SELECT content_hash FROM all_cache WHERE model_name LIKE '%:gist:v3')"""


def _tasks(v: Views, **kw) -> DataFrame:
    rows = pending.pending_tasks(v.messages, v.attachments, v.all_cache, "", **kw)
    return rows.select("type", "task_id", "content_hash", "internal_date")


@query("p20_source_selector", f"SELECT * FROM ({TASKS_SQL}) AS t WHERE type = 'pdf'")
def source_selector(v: Views) -> DataFrame:
    return _tasks(v, source="pdfs")


@query("u1_task_union", TASKS_SQL)
def task_union(v: Views) -> DataFrame:
    return _tasks(v, source="all")


_TASK_ORDER = "ORDER BY type DESC, coalesce(internal_date,0) DESC, task_id"


@query("l6_task_cap", f"SELECT * FROM ({TASKS_SQL}) AS t {_TASK_ORDER} LIMIT 200")
def task_cap(v: Views) -> DataFrame:
    return _tasks(v, source="all", limit=200)


_DOCUMENTS_SQL = """SELECT message_id, filename, round(size_bytes/1024.0,1) AS size_kb, left(m.from_addr,50) AS from_addr,
  local_path AS path, m.subject, downloaded_seconds FROM atts a JOIN msgs m ON m.id = a.message_id
ORDER BY downloaded_seconds DESC, message_id, filename"""


def _documents(v: Views, limit: int | None) -> DataFrame:
    rows = plan_views.documents(v.attachments, v.messages, limit)
    return rows.withColumn("downloaded_seconds", F.unix_timestamp("downloaded_at")).drop("downloaded_at")


@query("p21_document_rows", _DOCUMENTS_SQL)
def document_rows(v: Views) -> DataFrame:
    return _documents(v, None)


# ---- order and top-k ----------------------------------------------------------------------

_NEWEST = "ORDER BY coalesce(internal_date,0) DESC, id"


@query("l1_newest_first", f"SELECT id, internal_date FROM msgs {_NEWEST}")
def newest_first(v: Views) -> DataFrame:
    return search.newest(v.messages.select("id", "internal_date"), None)


@query("l2_top_k", f"SELECT id, internal_date FROM msgs {_NEWEST} LIMIT 10")
def top_k(v: Views) -> DataFrame:
    return search.newest(v.messages.select("id", "internal_date"), 10)


@query("l3_latest_downloads", "SELECT message_id, filename FROM atts ORDER BY downloaded_seconds DESC, message_id, filename LIMIT 20")
def latest_downloads(v: Views) -> DataFrame:
    return search.latest_downloads(v.attachments, 20).select("message_id", "filename")


@query(
    "l4_order_in_week",
    """, ranked AS (SELECT m.id, c.model_name, case when extracted_json->>'error' is not null then -1
    when (extracted_json->>'critical')::BOOLEAN then 3 when (extracted_json->>'obligation')::BOOLEAN then 2
    when (extracted_json->>'broadcast')::BOOLEAN or (extracted_json->>'frivolous')::BOOLEAN then 0 else 1 end AS priority,
    lower(extracted_json->>'sender') AS sender_key, m.date_key, case when wall_seconds is null then 9999 else greatest(-1, """
    + _WEEKS
    + """) end AS week_idx
  FROM cache c JOIN msgs m ON c.message_id = m.id WHERE c.model_name LIKE '%:gist:v3')
SELECT id, model_name, priority, sender_key, date_key FROM ranked
ORDER BY week_idx DESC, priority, sender_key, date_key, id, model_name""",
)
def order_in_week(v: Views) -> DataFrame:
    rows = gists.ranked(gists.gists_with_message(v.cache, v.messages), AS_OF, show_noise=True)
    ordered = rows.orderBy(*gists.order_of_view())
    return ordered.select("id", "model_name", F.col("group").alias("priority"), "sender_key", "date_key")


@query(
    "l5_week_order",
    """, weeks AS (SELECT case when wall_seconds is null then 9999 else greatest(-1, """
    + _WEEKS
    + """) end AS week_idx FROM msgs)
SELECT week_idx, count(*) AS rows FROM weeks GROUP BY week_idx ORDER BY week_idx DESC""",
)
def week_order(v: Views) -> DataFrame:
    from heedline.operators import weeks

    counts = weeks.week_counts(with_week(v.messages, "date_wall", AS_OF))
    return weeks.oldest_first(counts).select("week_idx", "rows")


@query("u2_id_difference", "SELECT id FROM msgs WHERE doc_id % 3 <> 0")
def id_difference(v: Views) -> DataFrame:
    stored = v.messages.where(F.col("id").cast("long") % 3 == 0)
    return pending.new_ids(v.messages.select("id").unionByName(v.messages.select("id")), stored)


@query("n6_label_json", "SELECT id, replace(coalesce(label_ids,'[]'),' ','') AS labels FROM msgs")
def label_json(v: Views) -> DataFrame:
    text_form = payload.labels_to_json("label_ids")
    return v.messages.select("id", payload.labels_to_json(payload.labels_from_json(text_form)).alias("labels"))
