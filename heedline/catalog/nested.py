"""Nested payloads, documents and invoices: N1-N5, N7-N9, S7-S9, A9.

Payloads are built by Spark from whole documents in five shapes.  The SQL side never sees
JSON: it states what each shape must yield.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heedline.catalog.registry import query
from heedline.catalog.views import AS_OF_TIME, Views
from heedline.functions import gist, invoice, payload, text
from heedline.operators import attachments
from heedline.operators.joins import cut_down, left_out
from heedline.session import durable, new_folder
from heedline.sources import landing, tables

# ---- raw messages -------------------------------------------------------------------------


def base64url(c: Column) -> Column:
    coded = F.replace(F.base64(F.encode(c, "UTF-8")), F.lit("\r\n"), F.lit(""))
    return F.replace(F.replace(coded, F.lit("+"), F.lit("-")), F.lit("/"), F.lit("_"))


_PLAIN = '{"mimeType":"text/plain; charset=utf-8","body":{"size":10,"data":"<text>"}}'
_HTML = '{"mimeType":"text/html","body":{"size":10,"data":"<html>"}}'
_PDF = '{"mimeType":"application/x","filename":"report-<id>.PDF","body":{"size":7,"attachmentId":"a<id>"}}'
_SHEET = '{"mimeType":"application/x","filename":"sheet<id>.xlsx","body":{"size":7,"attachmentId":"s<id>"}}'
_IMAGE = '{"mimeType":"application/x","filename":"photo.png","body":{"size":7,"attachmentId":"img"}}'
_UNNAMED = '{"mimeType":"application/x","filename":"lost.pdf","body":{"size":7}}'


def _multipart(kind: str, *parts: str) -> str:
    return f'{{"mimeType":"multipart/{kind}","parts":[{",".join(parts)}]}}'


# Part tree and html tag of a document by doc_id % 5.
_SHAPES = [
    (_PLAIN, ""),
    (_multipart("alternative", _PLAIN, _HTML), "<b>"),
    (_multipart("mixed", _multipart("alternative", _PLAIN, _HTML), _PDF, _IMAGE, _UNNAMED), "<p>"),
    (_multipart("mixed", _HTML, _multipart("related", _multipart("alternative", _PLAIN), _SHEET), _PDF), "<i>"),
    (_HTML, "<u>"),
]


def payload_json(doc: Column, body: Column) -> Column:
    """Part tree of a document, without headers."""
    filled_in = None
    for k, (shape, tag) in enumerate(_SHAPES):
        tree = F.replace(F.lit(shape), F.lit("<id>"), doc.cast("string"))
        if "<text>" in shape:
            tree = F.replace(tree, F.lit("<text>"), base64url(body))
        if "<html>" in shape:
            tree = F.replace(tree, F.lit("<html>"), base64url(F.concat(F.lit(tag), body)))
        test = doc % len(_SHAPES) == k
        filled_in = F.when(test, tree) if filled_in is None else filled_in.when(test, tree)
    return filled_in


def payloads(v: Views) -> DataFrame:
    """Stored messages with headers in odd case and one repeated, and their raw payload text."""
    if not hasattr(v, "stored_payloads"):
        v.stored_payloads = durable(built_payloads(v), "payloads")
    return v.stored_payloads


def built_payloads(v: Views) -> DataFrame:
    """The rows of ``payloads`` for one reader: unless they are stored already, they are built as texts are read."""
    columns = ["id", "doc_id", "internal_date", "thread_id", "snippet", "label_ids", "raw_payload"]
    return v.stored_payloads if hasattr(v, "stored_payloads") else _payloads(v).select(*columns)


def _payloads(v: Views) -> DataFrame:
    single, again = by_doc_id(v, "msgs0")
    if again is not None:
        single = single.unionByName(texts_joined(again))
    return single.withColumn("raw_payload", payload_text())


def by_doc_id(v: Views, name: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows of a view with their texts: those that have a doc_id alone, and the others, if there are any.

    Joining documents with the view by doc_id gives the first as they are.  Which doc_ids are
    repeated is settled on them alone, so no text moves for it.
    """
    rows = v.with_text(name)
    ids = v.table("documents").where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    repeated = durable(ids.where("n > 1").select("doc_id"), "repeated-ids")
    n = repeated.count()
    if not n:
        return rows, None
    return left_out(rows, repeated, ["doc_id"], n), cut_down(rows, repeated, ["doc_id"], n)


def texts_joined(again: DataFrame) -> DataFrame:
    """Every row with every text of its doc_id."""
    return again.drop("text").join(again.select("doc_id", "text"), "doc_id")


def payload_text() -> Column:
    """Stored payload of a row of ``with_text``."""

    def header(name: str, value: Column | str) -> Column:
        return F.struct(F.lit(name).alias("name"), text.col(value).alias("value"))

    headers = F.array(
        header("SUBJECT", "subject"),
        header("From", "from_addr"),
        header("subject", F.lit("second subject")),
        header("To", "to_addr"),
        header("message-ID", "message_header_id"),
        header("Date", "date"),
        header("To", F.lit("other@example.com")),
    )
    known = F.filter(headers, lambda h: h["value"].isNotNull())
    tree = payload_json(F.col("doc_id"), F.col("text"))
    return F.concat(F.lit('{"headers":'), F.to_json(known), F.lit(","), F.substr(tree, F.lit(2)))


def raw_messages(v: Views, stored: DataFrame | None = None) -> DataFrame:
    """Rows of ``payloads``, or of ``stored``, as they land."""
    labels = F.from_json("label_ids", "array<string>")
    return (payloads(v) if stored is None else stored).select(
        "id",
        F.col("thread_id").alias("threadId"),
        labels.alias("labelIds"),
        "snippet",
        (F.col("internal_date") * 1000).cast("string").alias("internalDate"),
        F.parse_json("raw_payload").alias("payload"),
    )


@query(
    "n1_first_header",
    "SELECT id, subject, from_addr, message_header_id, to_addr FROM msgs",
)
def first_header(v: Views) -> DataFrame:
    headers = payload.headers_of(F.parse_json("raw_payload"))
    names = {"subject": "Subject", "from_addr": "FROM", "message_header_id": "Message-Id", "to_addr": "to"}
    rows = payloads(v).select("id", headers.alias("headers"))
    return rows.select("id", *[payload.first_header(F.col("headers"), h).alias(c) for c, h in names.items()])


_BODY_TEXT = "case when doc_id % 5 <> 4 then text end"
_BODY_HTML = "case doc_id % 5 when 1 then '<b>' || text when 2 then '<p>' || text when 3 then '<i>' || text when 4 then '<u>' || text end"


@query(
    "n2_body_parts",
    f"SELECT cast(doc_id as string) AS id, sha256({_BODY_TEXT}) AS text_sha, sha256({_BODY_HTML}) AS html_sha FROM documents",
)
def body_parts(v: Views) -> DataFrame:
    rows = payloads(v).select("id", payload.part_tree(F.parse_json("raw_payload"), "raw_payload").alias("parts"))
    parts = F.col("parts")
    return rows.select(
        "id",
        F.sha2(payload.body_text(parts), 256).alias("text_sha"),
        F.sha2(payload.body_html(parts), 256).alias("html_sha"),
    )


_REFS_SQL = """SELECT cast(doc_id as string) AS message_id, 'a' || doc_id AS attachment_id, 'report-' || doc_id || '.PDF' AS filename, 7 AS size
  FROM documents WHERE doc_id % 5 in (2, 3)
UNION ALL SELECT cast(doc_id as string), 's' || doc_id, 'sheet' || doc_id || '.xlsx', 7 FROM documents WHERE doc_id % 5 = 3"""


@query("n3_attachment_refs", _REFS_SQL)
def attachment_refs(v: Views) -> DataFrame:
    refs = payload.attachment_refs(payload.part_tree(F.parse_json("raw_payload"), "raw_payload"))
    rows = payloads(v).select(F.col("id").alias("message_id"), F.explode(refs).alias("r"))
    return rows.select("message_id", "r.attachment_id", "r.filename", "r.size")


@query(
    "n4_header_map",
    """SELECT id, coalesce(subject,'(no subject)') AS upper_subject, 'second subject' AS subject, 'other@example.com' AS last_to,
  '(unknown)' AS reply_to FROM msgs""",
)
def header_map(v: Views) -> DataFrame:
    rows = payloads(v).select("id", payload.headers_of(F.parse_json("raw_payload")).alias("headers"))
    h = F.col("headers")
    return rows.select(
        "id",
        payload.header_or(h, "SUBJECT", "(no subject)").alias("upper_subject"),
        payload.header_or(h, "subject", "(no subject)").alias("subject"),
        payload.header_or(h, "To", "").alias("last_to"),
        payload.header_or(h, "Reply-To", "(unknown)").alias("reply_to"),
    )


# Preorder paths of each shape: '.' is the root, digits are positions.
_TREE_SQL = """, shapes(k, path, mime, is_leaf) AS (VALUES
  (0,'','text/plain; charset=utf-8',true),
  (1,'','multipart/alternative',false),(1,'0','text/plain; charset=utf-8',true),(1,'1','text/html',true),
  (2,'','multipart/mixed',false),(2,'0','multipart/alternative',false),(2,'00','text/plain; charset=utf-8',true),(2,'01','text/html',true),
  (2,'1','application/x',true),(2,'2','application/x',true),(2,'3','application/x',true),
  (3,'','multipart/mixed',false),(3,'0','text/html',true),(3,'1','multipart/related',false),(3,'10','multipart/alternative',false),
  (3,'100','text/plain; charset=utf-8',true),(3,'11','application/x',true),(3,'2','application/x',true),
  (4,'','text/html',true))
"""


@query(
    "n5_part_tree",
    _TREE_SQL + "SELECT cast(d.doc_id as string) AS id, s.path, s.mime, s.is_leaf FROM documents d JOIN shapes s ON s.k = d.doc_id % 5",
)
def part_tree(v: Views) -> DataFrame:
    rows = payloads(v).select("id", F.explode(payload.part_tree(F.parse_json("raw_payload"), "raw_payload")).alias("p"))
    digits = F.regexp_replace("p.path", "0{9}(\\d)", "$1")
    return rows.select("id", digits.alias("path"), "p.mime", "p.is_leaf")


_FLAT_SQL = f""", flat AS (SELECT m.*, {_BODY_TEXT.replace("text end", "d.text end").replace("doc_id", "d.doc_id")} AS t,
  {_BODY_HTML.replace("text", "d.text").replace("case doc_id", "case d.doc_id")} AS h, d.text FROM msgs m JOIN documents d ON d.doc_id = m.doc_id),
flat1 AS (SELECT *, coalesce(t, h) AS b FROM flat),
flat2 AS (SELECT *, sha256(trim(concat(head, b), concat(' ',chr(9),chr(10),chr(11),chr(12),chr(13)))) AS hash FROM flat1)
"""
_FLAT_COLUMNS = """SELECT id, thread_id, replace(coalesce(label_ids,'[]'),' ','') AS labels, snippet, subject, from_addr, to_addr,
  message_header_id, date, sha256(t) AS text_sha, sha256(h) AS html_sha, hash AS body_hash, internal_date, wall_seconds FROM flat2"""
FLAT_MESSAGES_SQL = _FLAT_SQL + _FLAT_COLUMNS


def flat_columns(messages: DataFrame) -> DataFrame:
    return messages.select(
        "id",
        "thread_id",
        payload.labels_to_json("label_ids").alias("labels"),
        *["snippet", "subject", "from_addr", "to_addr", "message_header_id", "date"],
        F.sha2("body_text", 256).alias("text_sha"),
        F.sha2("body_html", 256).alias("html_sha"),
        "body_hash",
        "internal_date",
        F.unix_timestamp(F.col("date_wall").cast("timestamp")).alias("wall_seconds"),
    )


@query("n7_flatten_messages", FLAT_MESSAGES_SQL)
def flatten_messages(v: Views) -> DataFrame:
    return flat_columns(landing.flatten_messages(raw_messages(v), AS_OF_TIME))


# ---- gist validation ----------------------------------------------------------------------

# Twenty spellings of a record, each with its verdict.  %d stands for the document id.
_GIST_HEAD = '{"category":"billing","intent":"info",'
_GIST_FLAGS = '"frivolous":true,"broadcast":false,"obligation":false,"critical":false,'
_GIST_TAIL = '"sender":"s%d","clue":"c"}'
_VARIANTS = [
    (_GIST_HEAD + _GIST_FLAGS + _GIST_TAIL, None),
    (_GIST_HEAD + '"frivolous":"YES","broadcast":0,"obligation":"off","critical":1.0,' + _GIST_TAIL, None),
    (_GIST_HEAD + '"frivolous":2,"broadcast":false,"obligation":false,"critical":false,' + _GIST_TAIL, "frivolous"),
    (_GIST_HEAD + '"frivolous":true,"broadcast":null,"obligation":false,"critical":false,' + _GIST_TAIL, "broadcast"),
    (_GIST_HEAD + _GIST_FLAGS + '"amount":"12.50",' + _GIST_TAIL, None),
    (_GIST_HEAD + _GIST_FLAGS + '"amount":true,"currency":"EUR",' + _GIST_TAIL, None),
    (_GIST_HEAD + _GIST_FLAGS + '"amount":"12.5x",' + _GIST_TAIL, "amount"),
    (_GIST_HEAD + _GIST_FLAGS + '"sender":5,"clue":"c"}', "sender"),
    (_GIST_HEAD + _GIST_FLAGS + '"sender":"s%d","clue":"' + "x" * 42 + '"}', None),
    (_GIST_HEAD + _GIST_FLAGS + '"sender":"s%d","clue":"' + "x" * 43 + '"}', "clue"),
    (_GIST_HEAD + _GIST_FLAGS + _GIST_TAIL + "x", "json"),
    (_GIST_HEAD + _GIST_FLAGS + _GIST_TAIL + "]", "json"),
    (_GIST_HEAD + _GIST_FLAGS + _GIST_TAIL + "}", "json"),
    ("[]", "object"),
    (_GIST_HEAD.replace("billing", "Billing") + _GIST_FLAGS + _GIST_TAIL, "category"),
    (_GIST_HEAD.replace("info", "news") + _GIST_FLAGS + _GIST_TAIL, "intent"),
    (_GIST_HEAD + _GIST_FLAGS + '"sender":"first",' + _GIST_TAIL, None),
    (_GIST_HEAD + _GIST_FLAGS + '"code":7,' + _GIST_TAIL, "code"),
    (_GIST_HEAD + _GIST_FLAGS + '"extra":[1],"due_date":"soon","error":"",' + _GIST_TAIL, None),
    (_GIST_HEAD + '"broadcast":false,"obligation":false,"critical":false,' + _GIST_TAIL, "frivolous"),
]
_VERDICTS = ",".join(f"({i},{'NULL' if r is None else repr(r)})" for i, (_, r) in enumerate(_VARIANTS))


@query(
    "n8_gist_validation",
    f""", verdicts(k, reason) AS (VALUES {_VERDICTS})
SELECT doc_id, reason IS NULL AS valid, reason, case when reason IS NULL then 's' || doc_id end AS sender,
  case when k = 4 then 12.5 when k = 5 then 1.0 end AS amount, case when reason IS NULL then true end AS frivolous,
  case when reason IS NULL then k = 1 end AS critical, case when k = 18 then '' end AS error
FROM documents JOIN verdicts ON k = doc_id % {len(_VARIANTS)}""",
)
def gist_validation(v: Views) -> DataFrame:
    variants = F.array(*[F.lit(json) for json, _ in _VARIANTS])
    doc = F.col("doc_id")
    json = F.replace(F.get(variants, (doc % len(_VARIANTS)).cast("int")), F.lit("%d"), doc.cast("string"))
    rows = v.table("documents").select("doc_id", json.alias("json")).select("doc_id", gist.parse_gist("json").alias("p"))
    return rows.select(
        "doc_id", "p.valid", "p.reason", "p.gist.sender", "p.gist.amount", "p.gist.frivolous", "p.gist.critical", "p.gist.error"
    )


# ---- invoices -----------------------------------------------------------------------------


def invoice_json(v: Views) -> DataFrame:
    """One invoice per order, numbers partly as text, strings padded with blanks."""
    item = F.struct(
        F.lit(" * ").alias("icon"),
        F.concat(F.lit(" part "), F.col("l_partkey").cast("string")).alias("kind"),
        F.array(F.lit(" x "), F.lit("y")).alias("attributes"),
        F.col("l_quantity").cast("decimal(18,4)").cast("string").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(18,4)").alias("subtotal"),
        F.col("l_linenumber").alias("line"),
    )
    # Spread raw rows by order first: the texts are then built in parallel, after the one shuffle.
    items = v.table("lineitem").repartition("l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("items"))
    rows = v.table("orders").join(v.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    joined = rows.repartition("o_orderkey").join(items, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    record = F.struct(
        F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit(" LV01 "))).alias("iban"),
        F.concat(F.lit("\n "), F.col("c_name"), F.lit("\t")).alias("company_name"),
        F.col("o_totalprice").cast("decimal(18,4)").cast("string").alias("amount"),
        F.lit(" EUR").alias("currency"),
        F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("ref "), F.col("o_orderkey").cast("string"))).alias("payment_reference"),
        F.col("items").alias("line_items"),
    )
    return joined.select("o_orderkey", F.to_json(record).alias("json"))


@query(
    "n9_invoice_totals",
    """, items AS (SELECT l_orderkey, count(*) AS n, sum(cast(l_quantity as decimal(18,4))) AS q,
  sum(cast(l_extendedprice as decimal(18,4))) AS s, min('part ' || l_partkey) AS first_kind FROM lineitem GROUP BY 1)
SELECT o_orderkey, c_name AS company_name, case when o_orderkey % 2 = 0 then 'LV01' end AS iban, 'EUR' AS currency,
  cast(cast(o_totalprice as decimal(18,4)) as varchar) AS amount, o_orderkey % 5 <> 0 AS complete, coalesce(n,0)::INT AS n_items,
  coalesce(cast(q as varchar),'0.0000') AS quantity, coalesce(cast(s as varchar),'0.0000') AS subtotal, first_kind
FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN items ON l_orderkey = o_orderkey""",
)
def invoice_totals(v: Views) -> DataFrame:
    parsed = invoice_json(v).select("o_orderkey", invoice.parse_invoice("json").alias("r"))
    zero = F.lit(0).cast("decimal(28,4)")

    def total(field: str) -> Column:
        return F.aggregate("r.line_items", zero, lambda a, x: (a + x[field]).cast("decimal(28,4)")).cast("string")

    kinds = F.transform("r.line_items", lambda x: x["kind"])
    return parsed.select(
        "o_orderkey",
        "r.company_name",
        F.get("r.iban", F.lit(0)).alias("iban"),
        "r.currency",
        F.col("r.amount").cast("string").alias("amount"),
        invoice.invoice_is_complete("r").alias("complete"),
        F.size("r.line_items").alias("n_items"),
        total("quantity").alias("quantity"),
        total("subtotal").alias("subtotal"),
        F.array_min(kinds).alias("first_kind"),
    )


# ---- payload rescans, documents, sinks ----------------------------------------------------


def stored_payloads(v: Views) -> DataFrame:
    """Stored messages whose payload text is broken for every seventh."""
    bad = F.col("doc_id") % 7 == 0
    return payloads(v).withColumn("raw_payload", F.when(bad, "{not json").otherwise(F.col("raw_payload")))


@query("s7_payload_rescan", f"SELECT * FROM ({_REFS_SQL}) AS r WHERE message_id::BIGINT % 7 <> 0")
def payload_rescan(v: Views) -> DataFrame:
    return attachments.attachment_rows(stored_payloads(v)).select("message_id", "attachment_id", "filename", "size")


@query(
    "a9_attachments_per_message",
    f"SELECT message_id, count(*) AS n, min(filename) AS first_name FROM ({_REFS_SQL}) AS r GROUP BY message_id",
)
def attachments_per_message(v: Views) -> DataFrame:
    rows = attachments.attachment_rows(payloads(v))
    return rows.groupBy("message_id").agg(F.count(F.lit(1)).alias("n"), F.min("filename").alias("first_name"))


PAGES_PER_FILE = 10
# The document files: every page, in page order, some to a file.
FILES_SQL = f""", files AS (SELECT page_id % greatest(1, (SELECT count(*) FROM pages) // {PAGES_PER_FILE}) AS bucket,
  string_agg(html || chr(10), '' ORDER BY page_id) AS content FROM pages GROUP BY 1)
"""


def document_files(v: Views) -> str:
    """Write all pages into files of about PAGES_PER_FILE and return the folder."""
    folder = new_folder(v.spark, "documents")
    files = max(1, v.table("pages").count() // PAGES_PER_FILE)
    pages = v.table("pages").select("page_id", "html", (F.col("page_id") % files).alias("bucket"))
    ordered = pages.repartition("bucket").sortWithinPartitions("bucket", "page_id")
    ordered.select("html", "bucket").write.partitionBy("bucket").option("lineSep", "\n").text(folder)
    return folder


@query("s8_document_scan", FILES_SQL + "SELECT bucket, sha256(content) AS content_hash, strlen(content) AS size_bytes FROM files")
def document_scan(v: Views) -> DataFrame:
    files = landing.documents(v.spark, document_files(v))
    bucket = F.regexp_extract("path", "bucket=(\\d+)", 1).cast("bigint")
    return files.select(bucket.alias("bucket"), "content_hash", "size_bytes")


@query(
    "s8_changed_document",
    FILES_SQL
    + """, now AS (SELECT bucket, case when bucket = 0 then 'changed' || content else content END AS content FROM files)
SELECT bucket, sha256(content) AS content_hash, strlen(content) AS size_bytes FROM now""",
)
def changed_document(v: Views) -> DataFrame:
    """Scanned with a manifest, then again after one file has changed: that one is hashed anew."""
    folder, manifest = document_files(v), new_folder(v.spark, "manifest")
    landing.documents(v.spark, folder, manifest)
    first = v.spark.read.text(f"{folder}/bucket=0", wholetext=True)
    # The writer adds a line feed of its own.
    value = F.concat(F.lit("changed"), F.regexp_replace("value", "\n$", ""))
    changed = durable(first.select(value.alias("value")), "changed-document")
    changed.write.mode("overwrite").option("lineSep", "\n").text(f"{folder}/bucket=0")
    files = landing.documents(v.spark, folder, manifest)
    bucket = F.regexp_extract("path", "bucket=(\\d+)", 1).cast("bigint")
    return files.select(bucket.alias("bucket"), "content_hash", "size_bytes")


@query("s10_result_texts", "SELECT replace(local_path,'.pdf','.gist.txt') AS path, 'described ' || filename AS text FROM atts WHERE local_path IS NOT NULL")
def result_texts(v: Views) -> DataFrame:
    results = v.attachments.where(F.col("local_path").isNotNull()).select(
        F.lit("pdf").alias("type"),
        F.col("local_path").alias("path"),
        F.concat(F.lit("described "), "filename").alias("description"),
    )
    folder = new_folder(v.spark, "texts")
    for _ in range(2):  # a second run changes nothing
        tables.write_result_texts(results, folder, gist=True)
    return tables.text_table(v.spark, folder).read()
