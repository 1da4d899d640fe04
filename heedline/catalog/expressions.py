"""Column expressions: H1-H22."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heedline import constants as C
from heedline.catalog.registry import query
from heedline.catalog.views import AS_OF, AS_OF_SECONDS, Views
from heedline.functions import dates, gist, ids, text
from heedline.operators.pending import document_tasks, email_tasks
from heedline.operators.weeks import with_week

# ---- text and hashes ----------------------------------------------------------------------


@query(
    "h2_long_body_hash",
    """SELECT doc_id, sha256(trim('From: f' || chr(10) || chr(10) || repeat('x', 8000) || text, concat(' ',chr(9),chr(10),chr(11),chr(12),chr(13)))) AS h
FROM documents""",
)
def long_body_hash(v: Views) -> DataFrame:
    """Bodies that are alike for 8,000 characters."""
    body = F.concat(F.repeat(F.lit("x"), F.lit(8000)), "text")
    return v.table("documents").select("doc_id", text.message_hash(F.lit("f"), F.lit(""), body).alias("h"))


@query("h1_canonical_text", "SELECT id, sha256(canonical) AS text_hash, length(canonical) AS n_chars FROM msgs")
def canonical_text(v: Views) -> DataFrame:
    body = text.effective_body("body_text", "body_html", "snippet")
    canonical = text.canonical_text("from_addr", "subject", body)
    return v.messages.select(
        "id", F.sha2(canonical, 256).alias("text_hash"), F.length(canonical).cast("bigint").alias("n_chars")
    )


@query("h2_content_hash", "SELECT id, body_hash FROM msgs")
def content_hash(v: Views) -> DataFrame:
    return v.messages.select("id", text.body_hash().alias("body_hash"))


@query(
    "h2_task_hash",
    """SELECT id AS task_id, body_hash AS content_hash FROM msgs
WHERE body <> '' AND (label_ids IS NULL OR label_ids NOT LIKE '%"SENT"%')
UNION ALL SELECT local_path, content_hash FROM atts WHERE local_path IS NOT NULL""",
)
def task_hash(v: Views) -> DataFrame:
    documents = v.attachments.where(text.is_pdf_path("local_path")).withColumns(
        {c: F.lit(None).cast("string") for c in ("from_addr", "date", "date_wall", "internal_date")}
    )
    tasks = email_tasks(v.messages).unionByName(document_tasks(documents))
    return tasks.select("task_id", "content_hash")


_BASE32 = """translate(concat(
  to_base(('0x' || substr(sha256({x}),1,10))::BIGINT,32,8), to_base(('0x' || substr(sha256({x}),11,10))::BIGINT,32,8),
  to_base(('0x' || substr(sha256({x}),21,10))::BIGINT,32,8), to_base(('0x' || substr(sha256({x}),31,10))::BIGINT,32,8),
  to_base(('0x' || substr(sha256({x}),41,10))::BIGINT,32,8), to_base(('0x' || substr(sha256({x}),51,10))::BIGINT,32,8),
  to_base(('0x' || substr(sha256({x}),61,4) || '0')::BIGINT,32,4)),
  '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'abcdefghijklmnopqrstuvwxyz234567')"""


def base32_sql(x: str) -> str:
    return _BASE32.replace("{x}", x)


@query("h3_base32_hash", f"SELECT id, {base32_sql('id')} AS h FROM msgs")
def base32_hash(v: Views) -> DataFrame:
    return v.messages.select("id", ids.base32_hash("id").alias("h"))


# ---- addresses ----------------------------------------------------------------------------

_ADDRESS = """case doc_id % 7
  when 0 then concat('Bob {s} <b', {i}, '@X-{s}.Com>')
  when 1 then concat('"Quoted {s}" <q', {i}, '@sub.{s}.org>')
  when 2 then concat('plain', {i}, '@Mail.{s}.net')
  when 3 then concat('garbage ', {i})
  when 4 then ''
  when 5 then concat('<only', {i}, '@{s}.io>')
  else null end"""
# The source name is spliced in by concat pieces, so that both engines read the same text.
ADDRESS_SQL = _ADDRESS.replace("{i}", "cast(doc_id as string)").replace("{s}", "', source, '")


def _addresses(v: Views) -> DataFrame:
    return v.table("documents").selectExpr("doc_id", f"{ADDRESS_SQL} AS addr", "substr(text,1,30) AS subject")


_ADDR_CTE = f", addresses AS (SELECT doc_id, source, {ADDRESS_SQL} AS addr, substr(text,1,30) AS subject FROM documents)\n"


@query(
    "h4_display_sender",
    _ADDR_CTE
    + """SELECT doc_id, case doc_id % 7 when 0 then 'Bob ' || source when 1 then 'Quoted ' || source
  when 2 then left(addr,40) when 3 then addr else 'unknown' end AS sender,
  case doc_id % 7 when 0 then 'Bob ' || source when 1 then 'Quoted ' || source
  when 2 then addr when 3 then addr when 5 then addr else 'label' end AS shown FROM addresses""",
)
def display_sender(v: Views) -> DataFrame:
    return _addresses(v).select(
        "doc_id",
        text.display_sender("addr").alias("sender"),
        text.row_sender("addr", F.lit("label")).alias("shown"),
    )


@query(
    "h5_sender_domain",
    _ADDR_CTE
    + """SELECT doc_id, case doc_id % 7 when 0 then 'x-' || source || '.com' when 1 then 'sub.' || source || '.org'
  when 2 then 'mail.' || source || '.net' when 5 then source || '.io' else 'unknown.com' end AS domain FROM addresses""",
)
def sender_domain(v: Views) -> DataFrame:
    return _addresses(v).select("doc_id", text.sender_domain("addr").alias("domain"))


@query(
    "h9_reply_address",
    _ADDR_CTE
    + """, subjects AS (SELECT *, case doc_id % 4 when 0 then '' when 1 then 'RE: ' || subject
  when 2 then 're:' || subject else subject end AS s FROM addresses)
SELECT doc_id, case doc_id % 7 when 0 then 'b' || doc_id || '@X-' || source || '.Com'
  when 1 then 'q' || doc_id || '@sub.' || source || '.org' when 2 then addr when 3 then addr
  when 5 then 'only' || doc_id || '@' || source || '.io' else '' end AS to_addr,
  case when s = '' then 'Re: (no subject)' when lower(s) like 're:%' then s else 'Re: ' || s end AS reply_subject
FROM subjects""",
)
def reply_address(v: Views) -> DataFrame:
    rows = _addresses(v).withColumn(
        "s",
        F.when(F.col("doc_id") % 4 == 0, "")
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("RE: "), "subject"))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("re:"), "subject"))
        .otherwise(F.col("subject")),
    )
    return rows.select(
        "doc_id", text.reply_address("addr").alias("to_addr"), text.reply_subject("s").alias("reply_subject")
    )


# ---- dates --------------------------------------------------------------------------------

# Ten spellings of a mail date.  Spark writes the header text; the SQL never parses it, it
# knows the wall clock (w) and the offset (o, NULL for naive) each spelling stands for.
_HEADERS = """case doc_id % 10
  when 0 then concat(date_format(t,'EEE, dd MMM yyyy HH:mm:ss'), ' +0000')
  when 1 then concat(date_format(t,'d MMM yyyy HH:mm:ss'), ' -0700 (PDT)')
  when 2 then concat(date_format(t,'EEE, d MMM yy HH:mm'), ' +0530')
  when 3 then concat(date_format(t,'EEE, dd MMM yyyy HH:mm:ss'), ' GMT')
  when 4 then concat(date_format(t,'dd-MMM-yyyy HH:mm:ss'), ' EST')
  when 5 then concat(date_format(t,'EEE, dd MMMM yyyy HH:mm:ss'), ' -0000')
  when 6 then concat(date_format(t,'MMM dd, yyyy HH:mm:ss'), ' +0100')
  when 7 then date_format(t,"yyyy-MM-dd'T'HH:mm:ss")
  when 8 then concat('31 Feb ', date_format(t,'yyyy HH:mm:ss'), ' +0000')
  else date_format(t,'EEE, dd MMM yyyy HH:mm:ss') end"""

_DATED_CTE = """, seconds AS (SELECT doc_id, 1704067200 + doc_id * 86461 AS s FROM documents),
dated AS (SELECT doc_id, make_timestamp(s*1000000) AS t,
  case when doc_id % 10 in (7,8) then null when doc_id % 10 = 2 then make_timestamp((s - s % 60)*1000000)
    else make_timestamp(s*1000000) end AS w,
  case doc_id % 10 when 0 then 0 when 1 then -25200 when 2 then 19800 when 3 then 0 when 4 then -18000 when 6 then 3600 end AS o,
  case doc_id % 10 when 0 then '+00:00' when 1 then '-07:00' when 2 then '+05:30' when 3 then '+00:00'
    when 4 then '-05:00' when 6 then '+01:00' else '' end AS z
  FROM seconds)
"""


def _dated(v: Views) -> DataFrame:
    timed = v.table("documents").selectExpr("doc_id", "timestamp_seconds(1704067200 + doc_id * 86461) AS t")
    return timed.selectExpr("doc_id", f"{_HEADERS} AS header")


@query(
    "h6_mail_date",
    _DATED_CTE
    + """SELECT doc_id, cast(epoch(w) as bigint) - coalesce(o, 0) AS instant, strftime(w,'%Y-%m-%d %H:%M:%S') AS wall,
  case when w is not null then cast(o as bigint) end AS utc_offset FROM dated""",
)
def mail_date(v: Views) -> DataFrame:
    mail = F.col("mail")
    return _dated(v).select("doc_id", dates.mail_date("header").alias("mail")).select(
        "doc_id",
        dates.epoch_of(mail).alias("instant"),
        F.date_format(mail["wall"], "yyyy-MM-dd HH:mm:ss").alias("wall"),
        F.when(mail["wall"].isNotNull(), mail["utc_offset"]).alias("utc_offset"),
    )


@query("h7_date_sort_key", _DATED_CTE + "SELECT doc_id, coalesce(strftime(w,'%Y-%m-%dT%H:%M:%S') || z, '') AS date_key FROM dated")
def date_sort_key(v: Views) -> DataFrame:
    return _dated(v).select("doc_id", dates.date_sort_key("header").alias("date_key"))


_RAW10 = "case doc_id % 10 when 7 then strftime(t,'%Y-%m-%d') when 8 then '31 Feb ' || strftime(t,'%Y')[1:3] end"


@query(
    "h8_short_date",
    _DATED_CTE
    + f"""SELECT doc_id, case when w is null then {_RAW10} when year(w) = 2024 then strftime(w,'%a %b %d')
  else strftime(w,'%Y-%m-%d') end AS shown FROM dated""",
)
def short_date(v: Views) -> DataFrame:
    return _dated(v).select("doc_id", dates.short_date("header", AS_OF).alias("shown"))


@query(
    "h10_simple_date",
    _DATED_CTE
    + f"""SELECT doc_id, case when doc_id % 10 = 7 then {_RAW10} when doc_id % 10 = 8 then strftime(t,'%Y') || '-02-31'
  else strftime(w,'%Y-%m-%d') end AS day FROM dated""",
)
def simple_date(v: Views) -> DataFrame:
    return _dated(v).select("doc_id", dates.simple_date("header").alias("day"))


@query(
    "h11_message_date",
    _DATED_CTE
    + """SELECT doc_id, strftime(coalesce(w, case when doc_id % 3 = 0 then make_timestamp(1700000000000000 + doc_id*1000000) end,
  TIMESTAMP '2024-01-31'),'%Y-%m-%d %H:%M:%S') AS wall FROM dated""",
)
def message_date(v: Views) -> DataFrame:
    feed = F.when(F.col("doc_id") % 3 == 0, ((F.col("doc_id") + 1_700_000_000) * 1000).cast("string"))
    rows = _dated(v).withColumn("feed_millis", feed)
    wall = dates.message_wall("header", "feed_millis", AS_OF)
    return rows.select("doc_id", F.date_format(wall, "yyyy-MM-dd HH:mm:ss").alias("wall"))


# Week number and label of a wall clock in unix seconds, as SQL; 2024-01-29 is the Monday.
WEEK_SQL = """case when {w} is null then 9999 else greatest(-1,
  cast(floor(datediff('day', date_trunc('week', make_timestamp({w}*1000000))::DATE, DATE '2024-01-29') / 7.0) as int)) end"""
LABEL_SQL = """case when {i} = 9999 then 'sometime' when {i} < 0 then 'upcoming' when {i} = 0 then 'this week'
  when {i} = 1 then 'last week' when {i} < 8 then {i} || ' weeks ago' else ({i} // 4) || ' months ago' end"""


def week_sql(wall: str) -> str:
    return WEEK_SQL.replace("{w}", wall)


def label_sql(index: str) -> str:
    return LABEL_SQL.replace("{i}", index)


@query(
    "h13_week_bucket",
    f""", weeks AS (SELECT doc_id, {week_sql("ws")} AS week_idx FROM (
  SELECT doc_id, case when doc_id % 17 = 0 then null else 1706702400 - doc_id * 43200 + 1209600 end AS ws FROM documents) AS c)
SELECT doc_id, week_idx, {label_sql("week_idx")} AS week_label FROM weeks""",
)
def week_bucket(v: Views) -> DataFrame:
    seconds = F.when(F.col("doc_id") % 17 != 0, AS_OF_SECONDS - F.col("doc_id") * 43200 + 1209600)
    rows = v.table("documents").select("doc_id", F.timestamp_seconds(seconds).cast("timestamp_ntz").alias("wall"))
    return with_week(rows, "wall", AS_OF).select("doc_id", "week_idx", "week_label")


@query(
    "h16_relative_due",
    """, dues AS (SELECT doc_id, DATE '2024-01-31' + cast(doc_id % 60 - 30 as int) AS d, cast(doc_id % 60 - 30 as int) AS n FROM documents)
SELECT doc_id, case when doc_id % 13 = 0 then '' when doc_id % 13 = 1 then 'due soon' when doc_id % 13 = 2 then 'due 2024-02-30'
  when n = 0 then 'due today' when n = 1 then 'due tomorrow' when n = -1 then 'due yesterday'
  when n < 0 then 'due ' || (-n) || ' days ago' else 'due in ' || n || ' days' end AS phrase FROM dues""",
)
def relative_due(v: Views) -> DataFrame:
    day = F.date_add(F.lit(AS_OF), (F.col("doc_id") % 60 - 30).cast("int"))
    k = F.col("doc_id") % 13
    due = (
        F.when(k == 0, F.lit(None))
        .when(k == 1, "soon")
        .when(k == 2, "2024-02-30")
        .when(k == 3, F.date_format(day, "yyyy-M-d"))
        .otherwise(day.cast("string"))
    )
    return v.table("documents").select("doc_id", dates.relative_due(due, AS_OF).alias("phrase"))


@query(
    "h22_cutoff_day",
    "SELECT user_id, count(*) AS recent FROM events WHERE ts >= DATE '2024-01-31' - 7 GROUP BY user_id",
)
def cutoff_day(v: Views) -> DataFrame:
    recent = v.table("events").where(F.col("ts") >= dates.cutoff(AS_OF, 7).cast("timestamp_ntz"))
    return recent.groupBy("user_id").agg(F.count(F.lit(1)).alias("recent"))


# ---- paths, models, money -----------------------------------------------------------------

# File names by form, with the stem and extension each must give.
_NAMES = """case doc_id % 8
  when 0 then concat('Report ', {i}, '.PDF')
  when 1 then concat('a<b>:', {i}, '"|?*.xlsx')
  when 2 then concat('archive.', {i}, '.tar.ODS')
  when 3 then concat('dir/sub/file', {i}, '.xls')
  when 4 then '.pdf'
  when 5 then concat('noext', {i})
  when 6 then concat('trailing', {i}, '.')
  else concat(substr(source,1,3), repeat('x', 40), '.pdf') end"""
NAMES_SQL = _NAMES.replace("{i}", "cast(doc_id as string)")


@query(
    "h12_document_path",
    """, named AS (SELECT *, case doc_id % 8 when 0 then 'Report ' || doc_id when 1 then 'a_b__' || doc_id || '____'
  when 2 then 'archive.' || doc_id || '.tar' when 3 then 'file' || doc_id when 4 then '.pdf' when 5 then 'noext' || doc_id
  when 6 then 'trailing' || doc_id || '.' else left(source,3) || repeat('x',40) end AS stem,
  case doc_id % 8 when 0 then '.pdf' when 1 then '.xlsx' when 2 then '.ods' when 3 then '.xls' when 7 then '.pdf' else '.bin' end AS ext,
  make_timestamp(coalesce(wall_seconds, 1706659200) * 1000000) AS w FROM msgs)
SELECT id, strftime(w,'%Y-%m') || '/' || lower(source) || '.example.com/' || strftime(w,'%Y%m%d') || '-' || lower(source)
  || '.example.com-' || id || '-' || stem || '-' || sha256(id) || ext AS path FROM named""",
)
def document_path(v: Views) -> DataFrame:
    rows = v.view("msgs0").selectExpr("id", "from_addr", "date", f"{NAMES_SQL} AS filename")
    wall = dates.message_wall("date", F.lit(None), AS_OF)
    return rows.select("id", text.document_path(wall, "from_addr", "id", "filename", F.sha2("id", 256)).alias("path"))


@query(
    "h15_money",
    """, sums AS (SELECT o_orderkey, case when o_orderkey % 3 = 0 then floor(o_totalprice) + 0.5 else o_totalprice end AS a,
  case o_orderkey % 6 when 0 then 'USD' when 1 then 'eur' when 2 then 'GBP' when 3 then 'JPY' when 4 then 'sek' end AS cur FROM orders)
SELECT o_orderkey, case when cur = 'USD' then '$' || n when cur = 'eur' then '€' || n when cur = 'GBP' then '£' || n
  when cur = 'JPY' then '¥' || n when cur = 'sek' then n || ' SEK' else n end AS shown
FROM (SELECT o_orderkey, cur, cast(cast(round_even(a, 0) as bigint) as varchar) AS n FROM sums) AS c""",
)
def money(v: Views) -> DataFrame:
    key = F.col("o_orderkey")
    amount = F.when(key % 3 == 0, F.floor("o_totalprice") + 0.5).otherwise(F.col("o_totalprice"))
    codes = F.array(*[F.lit(c) for c in ("USD", "eur", "GBP", "JPY", "sek", None)])
    currency = F.get(codes, (key % 6).cast("int"))
    return v.table("orders").select("o_orderkey", gist.money(amount, currency).alias("shown"))


@query(
    "h17_model_label",
    """SELECT model_name, case when model_name = 'gemini-3.1-flash-lite-preview' then 'Flash Lite'
  when model_name = 'gemini-3-flash-preview' then 'Flash' else 'Pro' end AS label, count(*) AS rows FROM (
  SELECT case doc_id % 3 when 0 then 'gemini-3-pro-preview' when 1 then 'gemini-3-flash-preview'
    else 'gemini-3.1-flash-lite-preview' end AS model_name FROM documents) AS c GROUP BY ALL""",
)
def model_label(v: Views) -> DataFrame:
    models = F.array(F.lit(C.MODEL_PRO), F.lit(C.MODEL_FLASH), F.lit(C.MODEL_FLASH_LITE))
    rows = v.table("documents").select(F.get(models, (F.col("doc_id") % 3).cast("int")).alias("model_name"))
    counts = rows.groupBy("model_name").agg(F.count(F.lit(1)).alias("rows"))
    return counts.select("model_name", text.model_label("model_name").alias("label"), "rows")


@query("h18_cache_key", "SELECT count(*) AS rows FROM cache WHERE model_name = 'lite:gist:v3'")
def cache_key(v: Views) -> DataFrame:
    return v.cache.where(F.col("model_name") == text.cache_key("lite", gist=True)).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "h19_error_rows",
    """SELECT content_hash, model_name, json_extract_string(extracted_json,'$.error') IS NOT NULL AS failed
FROM all_cache""",
)
def error_rows(v: Views) -> DataFrame:
    return v.all_cache.select("content_hash", "model_name", gist.error_is_set("extracted_json").alias("failed"))


@query("h20_base64url_text", "SELECT doc_id, sha256(text) AS text_hash FROM documents")
def base64url_text(v: Views) -> DataFrame:
    coded = F.translate(F.base64(F.encode("text", "UTF-8")), "+/", "-_")
    rows = v.table("documents").select("doc_id", coded.alias("data"))
    return rows.select("doc_id", F.sha2(text.utf8(text.from_base64url("data")), 256).alias("text_hash"))


@query(
    "h14_priority_group",
    """SELECT message_id, content_hash, model_name, case when json_extract_string(extracted_json,'$.error') <> '' then -1
  when (extracted_json->>'critical')::BOOLEAN then 3 when (extracted_json->>'obligation')::BOOLEAN then 2
  when (extracted_json->>'broadcast')::BOOLEAN or (extracted_json->>'frivolous')::BOOLEAN then 0 else 1 end AS priority
FROM cache""",
)
def priority_group(v: Views) -> DataFrame:
    rows = v.cache.withColumn("parsed", gist.parse_gist("extracted_json"))
    group = gist.priority_group("extracted_json", F.col("parsed"))
    return rows.select("message_id", "content_hash", "model_name", group.alias("priority"))


@query(
    "h21_row_fields",
    """SELECT message_id, content_hash, model_name, lower(trim(extracted_json->>'sender')) AS sender_key,
  '€' || cast(cast(round_even((extracted_json->>'amount')::DOUBLE, 0) as bigint) as varchar) AS meta FROM cache""",
)
def row_fields(v: Views) -> DataFrame:
    rows = v.cache.withColumn("parsed", gist.parse_gist("extracted_json"))
    record = F.col("parsed.gist")
    return rows.select(
        "message_id",
        "content_hash",
        "model_name",
        F.lower(text.strip(record["sender"])).alias("sender_key"),
        gist.row_meta(record, AS_OF).alias("meta"),
    )
