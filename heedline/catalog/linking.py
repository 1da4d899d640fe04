"""Joins and aggregates: J1-J13, A1-A8."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heedline import schemas
from heedline.catalog.expressions import base32_sql, label_sql, week_sql
from heedline.catalog.nested import base64url
from heedline.catalog.registry import query
from heedline.catalog.views import AS_OF, Views
from heedline.operators import attachments, inference, pending, shortid, weeks
from heedline.plans import analyze, gists, sync
from heedline.session import durable, new_folder
from heedline.sources import shortids, tables

_GIST = "model_name LIKE '%:gist:v3'"

# ---- joins --------------------------------------------------------------------------------


@query(
    "j1_attachments_with_message",
    """SELECT a.message_id, a.filename, a.content_hash, m.from_addr, m.subject, m.date, m.internal_date
FROM atts a JOIN msgs m ON a.message_id = m.id""",
)
def attachments_with_message(v: Views) -> DataFrame:
    rows = pending.with_message(v.attachments, v.messages)
    return rows.select("message_id", "filename", "content_hash", "from_addr", "subject", "date", "internal_date")


@query(
    "j2_gists_with_message",
    f"SELECT m.id, m.date, m.from_addr, c.model_name, c.extracted_json FROM cache c JOIN msgs m ON c.message_id = m.id WHERE {_GIST}",
)
def gists_with_message(v: Views) -> DataFrame:
    rows = gists.gists_with_message(v.cache, v.messages)
    return rows.select("id", "date", "from_addr", "model_name", "extracted_json")


@query(
    "j2_gists_of_twins",
    f"SELECT m.id, c.model_name, c.extracted_json FROM cache c JOIN msgs m ON c.content_hash = m.body_hash WHERE {_GIST}",
)
def gists_of_twins(v: Views) -> DataFrame:
    return gists.gists_of_twins(v.cache, v.messages).select("id", "model_name", "extracted_json")


@query(
    "j3_unclassified_messages",
    f"""SELECT id, body_hash FROM msgs m WHERE NOT EXISTS (SELECT 1 FROM cache c WHERE {_GIST} AND c.message_id = m.id)
AND NOT EXISTS (SELECT 1 FROM cache c WHERE {_GIST} AND c.content_hash = m.body_hash)""",
)
def unclassified_messages(v: Views) -> DataFrame:
    return pending.unclassified_messages(v.messages, v.cache).select("id", "body_hash")


@query(
    "j3_unclassified_one_model",
    """SELECT id FROM msgs m WHERE NOT EXISTS (SELECT 1 FROM cache c WHERE model_name = 'pro' AND c.message_id = m.id)
AND NOT EXISTS (SELECT 1 FROM cache c WHERE model_name = 'pro' AND c.content_hash = m.body_hash)""",
)
def unclassified_one_model(v: Views) -> DataFrame:
    return pending.unclassified_messages(v.messages, v.cache, "pro", gist=False).select("id")


@query(
    "j4_unclassified_documents",
    f"SELECT message_id, filename FROM atts a WHERE NOT EXISTS (SELECT 1 FROM all_cache c WHERE {_GIST} AND c.content_hash = a.content_hash)",
)
def unclassified_documents(v: Views) -> DataFrame:
    return pending.unclassified_documents(v.attachments, v.all_cache).select("message_id", "filename")


@query(
    "j5_failed_messages",
    f""", tries AS (SELECT *, json_extract_string(extracted_json,'$.error') IS NOT NULL AS failed FROM cache WHERE {_GIST}),
outcomes AS (SELECT m.id, t.failed FROM msgs m JOIN tries t ON t.message_id = m.id
  UNION ALL SELECT m.id, t.failed FROM msgs m JOIN tries t ON t.content_hash = m.body_hash)
SELECT id FROM outcomes GROUP BY id HAVING bool_and(failed)""",
)
def failed_messages(v: Views) -> DataFrame:
    return pending.failed_messages(v.messages, v.cache).select("id")


@query(
    "j6_failed_documents",
    f"""SELECT message_id, filename FROM atts WHERE content_hash IN (SELECT content_hash FROM all_cache WHERE {_GIST}
  GROUP BY content_hash HAVING bool_and(json_extract_string(extracted_json,'$.error') IS NOT NULL))""",
)
def failed_documents(v: Views) -> DataFrame:
    return pending.failed_documents(v.attachments, v.all_cache).select("message_id", "filename")


_KEPT_SQL = f""", stored AS (SELECT * FROM all_cache QUALIFY row_number() OVER (PARTITION BY content_hash, model_name ORDER BY created_seconds DESC) = 1),
tries AS (SELECT *, json_extract_string(extracted_json,'$.error') IS NOT NULL AS failed FROM stored WHERE {_GIST}),
"""


def _kept_up(v: Views) -> tables.Mailbox:
    """A mailbox that messages, documents and cache rows come to in two lots each, the cache rows by age.

    Made once for the queries that read it.
    """
    if not hasattr(v, "kept_up"):
        v.kept_up = _filled_in_lots(v)
    return v.kept_up


def _filled_in_lots(v: Views) -> tables.Mailbox:
    box = tables.Mailbox(v.spark, new_folder(v.spark, "mailbox"), standing=True)
    age = F.unix_seconds("created_at")
    cuts = v.all_cache.select(age.alias("s")).approxQuantile("s", [0.6], 0.01) or [0.0]
    for lot in range(2):
        box.save_extractions(v.all_cache.where((age >= cuts[0]).cast("int") == lot))
        box.save_messages(v.messages.where(F.pmod(F.xxhash64("id"), F.lit(2)) == lot), stored=True)
        box.save_attachments(v.attachments.where(F.pmod(F.xxhash64("filename"), F.lit(2)) == lot))
    return box


@query(
    "j3_j5_kept_up",
    _KEPT_SQL
    + """marks AS (SELECT m.id, t.failed FROM msgs m JOIN tries t ON t.message_id = m.id
  UNION ALL SELECT m.id, t.failed FROM msgs m JOIN tries t ON t.content_hash = m.body_hash),
states AS (SELECT m.id, count(k.id) AS n, bool_and(k.failed) AS failed FROM msgs m LEFT JOIN marks k ON k.id = m.id GROUP BY 1)
SELECT id, case when n = 0 then 'open' else 'failed' end AS state FROM states WHERE n = 0 OR failed""",
)
def messages_kept_up(v: Views) -> DataFrame:
    """Open and failed messages from the state that increments have left."""
    box = _kept_up(v)
    pick = lambda mode, state: pending.message_filter(
        box.messages.read(), box.extractions.read(), "", True, mode, box.standing
    ).select("id", F.lit(state).alias("state"))
    return pick("new", "open").unionByName(pick("failed", "failed"))


@query(
    "j4_j6_kept_up",
    _KEPT_SQL
    + """states AS (SELECT content_hash, bool_and(failed) AS failed FROM tries GROUP BY 1)
SELECT a.message_id, a.filename, case when s.content_hash IS NULL then 'open' else 'failed' end AS state
FROM atts a LEFT JOIN states s ON s.content_hash = a.content_hash WHERE s.content_hash IS NULL OR s.failed""",
)
def documents_kept_up(v: Views) -> DataFrame:
    box = _kept_up(v)
    pick = lambda mode, state: pending.document_filter(
        box.attachments.read(), box.extractions.read(), "", True, mode, box.standing
    ).select("message_id", "filename", F.lit(state).alias("state"))
    return pick("new", "open").unionByName(pick("failed", "failed"))


@query(
    "j7_never_described",
    """SELECT a.message_id, a.filename FROM atts a LEFT JOIN all_cache c ON a.content_hash = c.content_hash
WHERE c.content_hash IS NULL""",
)
def never_described(v: Views) -> DataFrame:
    return analyze.undescribed(v.attachments, v.all_cache).select("message_id", "filename")


@query("j8_new_ids", "SELECT id FROM msgs WHERE id NOT IN (SELECT message_id FROM cache WHERE message_id IS NOT NULL)")
def new_ids(v: Views) -> DataFrame:
    return pending.new_ids(v.messages, v.cache.select(F.col("message_id").alias("id")))


# References: two per page's message, by id and by name, to be matched against the table.
_REFS_SQL = """, refs AS (SELECT cast(page_id*2 as string) AS message_id, concat('a', cast(page_id as string)) AS attachment_id,
  concat('p', cast(page_id as string), case when page_id % 4 = 0 then '.XLSX' else '.pdf' end) AS filename, '0' AS part_path FROM pages
  UNION ALL SELECT cast(page_id*2 as string), concat('z', cast(page_id as string)), concat('p', cast(page_id as string), '.pdf'), '1' FROM pages),
ready AS (SELECT * FROM atts WHERE local_path IS NOT NULL)
"""


def _refs(v: Views) -> DataFrame:
    page = F.col("page_id").cast("string")
    message = (F.col("page_id") * 2).cast("string").alias("message_id")
    suffix = F.when(F.col("page_id") % 4 == 0, ".XLSX").otherwise(".pdf")

    def ref(letter: str, name, path: str) -> DataFrame:
        return v.table("pages").select(
            message,
            F.concat(F.lit(letter), page).alias("attachment_id"),
            name.alias("filename"),
            F.lit(path).alias("part_path"),
        )

    named = F.concat(F.lit("p"), page, suffix)
    return ref("a", named, "0").unionByName(ref("z", F.concat(F.lit("p"), page, F.lit(".pdf")), "1"))


@query(
    "j9_missing_attachments",
    _REFS_SQL
    + """SELECT message_id, attachment_id, filename FROM refs r
WHERE NOT EXISTS (SELECT 1 FROM ready a WHERE a.message_id = r.message_id AND a.gmail_attachment_id = r.attachment_id)
AND NOT (NOT EXISTS (SELECT 1 FROM ready a WHERE a.message_id = r.message_id AND a.gmail_attachment_id IS NOT NULL)
  AND EXISTS (SELECT 1 FROM ready a WHERE a.message_id = r.message_id AND a.gmail_attachment_id IS NULL AND a.filename = r.filename))""",
)
def missing_attachments(v: Views) -> DataFrame:
    return pending.missing_attachments(_refs(v), v.attachments).select("message_id", "attachment_id", "filename")


@query(
    "j10_stored_for_message",
    _REFS_SQL
    + """SELECT r.message_id, r.attachment_id, a.local_path AS message_path FROM refs r
LEFT JOIN ready a ON a.message_id = r.message_id AND a.gmail_attachment_id = r.attachment_id""",
)
def stored_for_message(v: Views) -> DataFrame:
    rows = attachments.stored_path_for_message(_refs(v), v.attachments)
    return rows.select("message_id", "attachment_id", "message_path")


# Contents shared by three neighbouring pages, so that copies exist.
_COPIES_SQL = """, bodies AS (SELECT cast(p.page_id*2 as string) AS message_id, concat('c', cast(p.page_id as string)) AS attachment_id,
  q.html AS content, p.page_id FROM pages p JOIN pages q ON q.page_id = p.page_id - p.page_id % 3)
"""


def copied_bodies(v: Views) -> DataFrame:
    pages = v.table("pages")
    source = pages.select(F.col("page_id").alias("source_id"), "html")
    rows = pages.select("page_id", (F.col("page_id") - F.col("page_id") % 3).alias("source_id")).join(source, "source_id")
    coded = base64url(F.col("html"))
    return rows.select(
        (F.col("page_id") * 2).cast("string").alias("message_id"),
        F.concat(F.lit("c"), F.col("page_id").cast("string")).alias("attachment_id"),
        coded.alias("data"),
    )


def copied_refs(v: Views) -> DataFrame:
    page = F.col("page_id").cast("string")
    suffix = F.when(F.col("page_id") % 5 == 0, ".xls").otherwise(".pdf")
    dates = v.messages.select("id", "date", "from_addr")
    refs = v.table("pages").select(
        (F.col("page_id") * 2).cast("string").alias("message_id"),
        F.concat(F.lit("c"), page).alias("attachment_id"),
        F.concat(F.lit("copy"), page, suffix).alias("filename"),
        F.lpad(page, 10, "0").alias("part_path"),
    )
    return refs.join(dates, refs["message_id"] == dates["id"]).drop("id")


@query(
    "j11_stored_for_content",
    _COPIES_SQL
    + """SELECT b.message_id, b.attachment_id, min(a.local_path) AS content_path FROM bodies b
LEFT JOIN (SELECT * FROM atts WHERE local_path IS NOT NULL AND page_id % 7 <> 0) AS a ON a.content_hash = sha256(b.content) GROUP BY ALL""",
)
def stored_for_content(v: Views) -> DataFrame:
    got = attachments.fetched(copied_refs(v), copied_bodies(v))
    rows = attachments.stored_path_for_content(got, v.attachments, v.listing)
    return rows.select("message_id", "attachment_id", "content_path")


@query(
    "j12_fetched_bytes",
    _COPIES_SQL + "SELECT message_id, attachment_id, sha256(content) AS content_hash, strlen(content) AS size_bytes FROM bodies WHERE page_id % 4 <> 0",
)
def fetched_bytes(v: Views) -> DataFrame:
    delivered = copied_bodies(v).where(F.substring("attachment_id", 2, 20).cast("long") % 4 != 0)
    rows = attachments.fetched(copied_refs(v), delivered)
    return rows.select("message_id", "attachment_id", "content_hash", "size_bytes")


SHORT_IDS_SQL = f""", hashes AS (SELECT id, {base32_sql("id")} AS h FROM msgs),
width AS (SELECT min(n) + 1 AS n FROM (SELECT n, count(DISTINCT substr(h,1,n)) AS k FROM hashes, range(4,17) AS r(n) GROUP BY n) AS c
  WHERE k = (SELECT count(*) FROM hashes)),
short_ids AS (SELECT id, substr(h, 1, (SELECT n FROM width)::INT) AS short_id FROM hashes)
"""


@query("a6_short_ids", SHORT_IDS_SQL + "SELECT id, short_id FROM short_ids")
def short_ids(v: Views) -> DataFrame:
    return shortid.short_ids(v.messages.select("id"))


@query("a6_kept_up", SHORT_IDS_SQL + "SELECT id, short_id FROM short_ids")
def short_ids_kept_up(v: Views) -> DataFrame:
    """The length from three increments of ids, of which some come twice."""
    kept, lot = shortids.ShortIds(v.spark, new_folder(v.spark, "short-ids")), F.pmod(F.xxhash64("id"), F.lit(4))
    for some in ((0,), (0, 1), (1, 2, 3)):
        kept.take_in(v.messages.where(lot.isin(*some)).select("id"))
    short = shortid.short_id_column(v.messages, length=kept.length())
    return v.messages.select("id", short.alias("short_id"))


@query(
    "j13_short_id_or_prefix",
    SHORT_IDS_SQL
    + f"SELECT a.message_id AS id, filename, coalesce(s.short_id, substr({base32_sql('a.message_id')},1,7)) AS short_id FROM atts a LEFT JOIN short_ids s ON s.id = a.message_id AND s.id::INT % 3 = 0",
)
def short_id_or_prefix(v: Views) -> DataFrame:
    known = shortid.short_ids(v.messages.select("id")).where(F.col("id").cast("long") % 3 == 0)
    rows = v.attachments.select(F.col("message_id").alias("id"), "filename")
    return shortid.with_short_id(rows, known).select("id", "filename", "short_id")


# ---- aggregates ---------------------------------------------------------------------------

_WEEKS_SQL = f""", dated AS (SELECT m.id, c.model_name, {week_sql("wall_seconds")} AS week_idx
  FROM cache c JOIN msgs m ON c.message_id = m.id WHERE {_GIST})
"""


@query(
    "a1_rows_by_week",
    _WEEKS_SQL + f"SELECT id, model_name, week_idx, {label_sql('week_idx')} AS week_label FROM dated",
)
def rows_by_week(v: Views) -> DataFrame:
    ranked = gists.ranked(gists.gists_with_message(v.cache, v.messages), AS_OF, show_noise=True)
    return ranked.select("id", "model_name", "week_idx", "week_label")


@query("a2_attachment_count", "SELECT count(*) AS attachments FROM atts")
def attachment_count(v: Views) -> DataFrame:
    return sync.attachment_count(v.attachments)


@query(
    "a3_error_tally",
    "SELECT count(*) AS tasks, count(*) FILTER (json_extract_string(extracted_json,'$.error') IS NOT NULL) AS errors FROM cache",
)
def error_tally(v: Views) -> DataFrame:
    return inference.error_tally(v.cache.withColumn("description", F.col("extracted_json")), gist=True)


@query(
    "a4_sync_tally",
    """SELECT count(*) AS listed, count(*) FILTER (id IN (SELECT message_id FROM cache WHERE message_id IS NOT NULL)) AS stored,
  count(*) FILTER (id NOT IN (SELECT message_id FROM cache WHERE message_id IS NOT NULL)) AS new,
  count(DISTINCT id) FILTER (id NOT IN (SELECT message_id FROM cache WHERE message_id IS NOT NULL)) AS downloaded,
  (SELECT count(*) FROM msgs WHERE internal_date IS NULL) AS undated
FROM (SELECT id, internal_date FROM msgs UNION ALL SELECT id, internal_date FROM msgs WHERE doc_id % 7 = 0 AND internal_date IS NOT NULL) AS m
WHERE internal_date >= epoch(DATE '2024-01-31' - 21)""",
)
def sync_tally(v: Views) -> DataFrame:
    raw = v.messages.select("id", (F.col("internal_date") * 1000).cast("string").alias("internalDate"))
    raw = raw.unionByName(raw.where((F.col("id").cast("long") % 7 == 0) & F.col("internalDate").isNotNull()))
    stored = v.cache.where(F.col("message_id").isNotNull()).select(F.col("message_id").alias("id")).distinct()
    return sync.sync_tally(raw, stored, AS_OF, 21)


@query("a5_week_counts", _WEEKS_SQL + f"SELECT week_idx, {label_sql('week_idx')} AS week_label, count(*) AS rows FROM dated GROUP BY ALL")
def week_counts(v: Views) -> DataFrame:
    ranked = gists.ranked(gists.gists_with_message(v.cache, v.messages), AS_OF, show_noise=True)
    return weeks.week_counts(ranked)


@query(
    "a7_one_task_per_content",
    """SELECT id AS task_id, body_hash AS content_hash FROM msgs WHERE body <> '' AND (label_ids IS NULL OR label_ids NOT LIKE '%"SENT"%')
QUALIFY row_number() OVER (PARTITION BY body_hash ORDER BY coalesce(internal_date,0) DESC, id) = 1""",
)
def one_task_per_content(v: Views) -> DataFrame:
    return inference.one_per_content(pending.email_tasks(v.messages)).select("task_id", "content_hash")


SAVE_SQL = (
    _COPIES_SQL
    + """, rows AS (SELECT b.message_id, b.attachment_id, sha256(b.content) AS content_hash, lpad(cast(b.page_id as string),10,'0') AS part_path,
  'copy' || b.page_id AS stem, case when b.page_id % 5 = 0 then '.xls' else '.pdf' end AS ext,
  m.source, m.wall_seconds, b.page_id FROM bodies b JOIN msgs m ON m.id = b.message_id),
placed AS (SELECT *, '/store/' || strftime(w,'%Y-%m') || '/' || source || '.example.com/' || strftime(w,'%Y%m%d') || '-' || source
  || '.example.com-' || message_id || '-' || stem || '-' || content_hash || ext AS raw_path
  FROM (SELECT *, make_timestamp(coalesce(wall_seconds, 1706659200)*1000000) AS w FROM rows) AS c),
known AS (SELECT content_hash, min(local_path) AS content_path FROM atts WHERE local_path IS NOT NULL AND page_id % 2 = 0 GROUP BY 1),
-- the SQL-side store holds every second row; xls contents of pages divisible by 10 were converted
facts AS (SELECT p.*, k.content_path, (p.ext = '.pdf' OR p.content_hash IN (SELECT content_hash FROM rows WHERE page_id % 10 = 0)) AS can_store
  FROM placed p LEFT JOIN known k ON k.content_hash = p.content_hash),
firsts AS (SELECT content_hash, message_id AS first_message, replace(raw_path,'.xls','.pdf') AS first_path FROM facts
  WHERE content_path IS NULL AND can_store
  QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY message_id, part_path) = 1),
statuses AS (SELECT f.message_id, f.attachment_id, f.content_hash,
  case when f.content_path is not null then 'exists' when f.message_id = s.first_message then 'downloaded'
    when f.can_store or f.message_id > s.first_message then 'exists' else 'conversion_failed' end AS status,
  case when f.content_path is not null then f.content_path when f.can_store or f.message_id >= s.first_message then s.first_path else f.raw_path end AS path
  FROM facts f LEFT JOIN firsts s ON s.content_hash = f.content_hash)
"""
)


def save_plan(v: Views) -> DataFrame:
    got = durable(attachments.fetched(copied_refs(v), copied_bodies(v)), "hashes")
    stored = v.attachments.where(F.col("message_id").cast("long") % 4 == 0)
    page = F.substring("attachment_id", 2, 20).cast("long")
    converted = got.where(page % 10 == 0).select("content_hash", F.sha2("content_hash", 256).alias("pdf_hash"))
    return attachments.save_plan(got, stored, AS_OF, "/store/", converted)


@query("a8_attachment_statuses", SAVE_SQL + "SELECT message_id, attachment_id, content_hash, status, path FROM statuses")
def attachment_statuses(v: Views) -> DataFrame:
    return save_plan(v).select("message_id", "attachment_id", "content_hash", "status", "path")


@query(
    "a8_table_after_save",
    SAVE_SQL
    + """SELECT message_id, attachment_id AS gmail_attachment_id, path AS local_path FROM statuses WHERE status <> 'conversion_failed'
UNION ALL SELECT message_id, gmail_attachment_id, local_path FROM atts WHERE page_id % 2 = 0""",
)
def table_after_save(v: Views) -> DataFrame:
    stored = schemas.align(v.attachments.where(F.col("message_id").cast("long") % 4 == 0), schemas.ATTACHMENTS)
    result = attachments.write_attachments(stored, attachments.attachment_updates(save_plan(v), AS_OF))
    return result.select("message_id", "gmail_attachment_id", "local_path")
