"""What still needs work: unclassified, only ever failed, new, not yet fetched
(SURVEY J1, J3-J10, U1, U2, L1, L6, P20).

The disjunctive test "a cache row has my id or my hash" is never written as an OR join, which
would compare every message with every cache row.  It is two equi joins.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heedline.functions import text
from heedline.functions.gist import error_is_set
from heedline.operators.joins import cut_down, lookup_join, only_with, without
from heedline.session import durable
from heedline.sources.landing import DAY, DIGEST, MILLIS, ROW, picked, staged
from heedline.sources.standing import DOCUMENT, MESSAGE, Standing


def newest_first() -> list[Column]:
    """L1; the id tie-break makes the order total."""
    return [F.coalesce("internal_date", F.lit(0)).desc(), F.col("id").asc()]


def gist_rows(cache: DataFrame, key: str, gist: bool = True) -> DataFrame:
    return cache.where(text.model_matches("model_name", key, gist))


def unclassified_messages(messages: DataFrame, cache: DataFrame, key: str = "", gist: bool = True) -> DataFrame:
    """Messages without a cache row by message id or by body hash."""
    done = gist_rows(cache, key, gist)
    by_id = done.select(F.col("message_id").alias("id"))
    by_hash = done.select(F.col("content_hash").alias("body_hash"))
    left = without(messages, by_id, ["id"], "id", counted=messages)
    return without(left, by_hash, ["body_hash"], "id", counted=messages)


def unclassified_documents(atts: DataFrame, cache: DataFrame, key: str = "", gist: bool = True) -> DataFrame:
    """Attachments whose bytes (the PDF's, where converted) have no cache row."""
    done = gist_rows(cache, key, gist).select(F.col("content_hash").alias("cache_hash"))
    keyed = atts.withColumn("cache_hash", document_hash(atts))
    return without(keyed, done, ["cache_hash"], attachment_row()).drop("cache_hash")


def document_hash(atts: DataFrame) -> Column:
    """Hash a document is cached by: of the converted PDF if there is one."""
    if "pdf_hash" in atts.columns:
        return F.coalesce("pdf_hash", "content_hash")
    return F.col("content_hash")


def attachment_row() -> Column:
    return F.concat_ws(" ", "message_id", "gmail_attachment_id", "filename")


def _outcomes(rows: DataFrame, key: str) -> DataFrame:
    """Per key: did any attempt fail, did any succeed.  Partial aggregates, one row per key."""
    failed = error_is_set("extracted_json")
    return (
        rows.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.bool_or(failed).alias("err"), F.bool_or(~failed).alias("ok"))
    )


def _retry(err: Column, ok: Column) -> Column:
    return F.coalesce(err, F.lit(False)) & ~F.coalesce(ok, F.lit(False))


def failed_messages(messages: DataFrame, cache: DataFrame, key: str = "", gist: bool = True) -> DataFrame:
    """Messages with some error row and no success row, by id or by hash."""
    rows = gist_rows(cache, key, gist)
    by_id = _outcomes(rows, "message_id").select(
        F.col("message_id").alias("id"), F.col("err").alias("id_err"), F.col("ok").alias("id_ok")
    )
    by_hash = _outcomes(rows, "content_hash").select(
        F.col("content_hash").alias("body_hash"),
        F.col("err").alias("hash_err"),
        F.col("ok").alias("hash_ok"),
    )
    flagged = lookup_join(messages, by_id, ["id"], "left", "id", counted=messages)
    flagged = lookup_join(flagged, by_hash, ["body_hash"], "left", "id", counted=messages)

    def either(a: str, b: str) -> Column:
        return F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))

    keep = _retry(either("id_err", "hash_err"), either("id_ok", "hash_ok"))
    return flagged.where(keep).select(*messages.columns)


def failed_documents(atts: DataFrame, cache: DataFrame, key: str = "", gist: bool = True) -> DataFrame:
    """Attachments whose every attempt failed."""
    failed = _outcomes(gist_rows(cache, key, gist), "content_hash").where(_retry(F.col("err"), F.col("ok")))
    keyed = atts.withColumn("cache_hash", document_hash(atts))
    hashes = failed.select(F.col("content_hash").alias("cache_hash"))
    return only_with(keyed, hashes, ["cache_hash"], attachment_row()).drop("cache_hash")


def never_described(atts: DataFrame, cache: DataFrame) -> DataFrame:
    """Attachments no model has described."""
    return without(atts, cache.select("content_hash"), ["content_hash"], attachment_row())


def unknown(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming rows whose id is not stored.

    The stored ids are first cut down to those the increment names.  That semi join broadcasts
    the increment's ids when they are few, so the stored table is scanned but not shuffled.
    """
    known = stored.select("id").join(incoming.select("id").distinct(), "id", "left_semi")
    # Missing ids match nothing; a digest of the plain columns spreads them.
    plain = [c for c, kind in incoming.dtypes if kind in ("string", "bigint")]
    return without(incoming, known, ["id"], F.xxhash64(*plain))


def new_deliveries(raw: DataFrame, stored: DataFrame) -> DataFrame:
    """Raw records with an id that is not stored, one per id.

    Which ones is settled on (id, feed time, digest, row): the latest delivery, and of equally
    late ones the one with the greatest digest.  Payloads meet those picks afterwards, where they
    are read (``landing.picked``).  Records that were not staged are staged first.
    """
    raw = staged(raw, None, 0, False)
    last = F.struct(F.coalesce(F.col("internalDate").try_cast("long"), F.lit(0)).alias("at"), DIGEST, ROW)
    latest = raw.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(last).alias("last"))
    picks = durable(unknown(latest.select("id", F.col(f"last.{ROW}").alias(ROW)), stored), "new-ids")
    return picked(raw, picks).drop(MILLIS, DIGEST, ROW, DAY)


def new_ids(listed: DataFrame, stored: DataFrame) -> DataFrame:
    """Listed ids not stored yet, each once."""
    return unknown(listed.select("id").distinct(), stored)


def with_message(atts: DataFrame, messages: DataFrame) -> DataFrame:
    """Attachments with the columns of their message."""
    parents = messages.select(
        F.col("id").alias("message_id"), "date", "date_wall", "from_addr", "subject", "internal_date"
    )
    return lookup_join(atts, parents, ["message_id"], "inner", attachment_row())


def ready_documents(atts: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """Rows whose stored path is a PDF and, given a listing of paths, exists.

    A listing is any table with a ``path`` column, such as ``Mailbox.contents``.
    """
    ready = atts.where(text.is_pdf_path("local_path"))
    if listing is None:
        return ready
    paths = listing.select(F.col("path").alias("local_path"))
    return only_with(ready, paths, ["local_path"], attachment_row())


def message_filter(
    messages: DataFrame, cache: DataFrame, key: str, gist: bool, mode: str, standing: Standing | None = None
) -> DataFrame:
    """mode: 'new' (default), 'failed' (retry), 'all' (force, dry run).

    A ``standing`` that is kept for the same key knows the ids, so that nothing is joined but those.
    """
    if standing and standing.gist == gist and mode != "all":
        found = standing.failed(MESSAGE) if mode == "failed" else standing.open(MESSAGE)
        return cut_down(messages, durable(found.select("id"), "standing-ids"), ["id"])
    if mode == "failed":
        return failed_messages(messages, cache, key, gist)
    if mode == "new":
        return unclassified_messages(messages, cache, key, gist)
    return messages


def document_filter(
    atts: DataFrame, cache: DataFrame, key: str, gist: bool, mode: str, standing: Standing | None = None
) -> DataFrame:
    if standing and standing.gist == gist and mode != "all":
        found = standing.failed(DOCUMENT) if mode == "failed" else standing.open(DOCUMENT)
        hashes = durable(found.select(F.col("hash").alias("cache_hash")).distinct(), "standing-hashes")
        keyed = atts.withColumn("cache_hash", document_hash(atts))
        known = cut_down(keyed, hashes.where("cache_hash IS NOT NULL"), ["cache_hash"])
        # Documents without a hash have no cache rows, so they are open.
        unhashed = keyed.where(F.col("cache_hash").isNull() & F.lit(mode == "new"))
        return known.unionByName(unhashed).drop("cache_hash")
    if mode == "failed":
        return failed_documents(atts, cache, key, gist)
    if mode == "new":
        return unclassified_documents(atts, cache, key, gist)
    return atts


def selection_mode(force: bool, retry_failed: bool, dry_run: bool) -> str:
    """force wins over retry-failed, which wins over a dry run's "everything"."""
    if force:
        return "all"
    if retry_failed:
        return "failed"
    return "all" if dry_run else "new"


def email_tasks(messages: DataFrame) -> DataFrame:
    """Received messages with a body, as classification tasks.

    Tasks carry no text: bodies are read for the has-body test and then dropped, so the joins
    that settle what is pending move narrow rows.  See ``message_texts``.
    """
    kept = messages.where(
        text.has_body("body_text", "body_html", "snippet") & text.not_sent("label_ids")
    )
    subject = text.or_empty("subject")
    return kept.select(
        F.lit("email").alias("type"),
        F.lit(1).alias("source_rank"),
        F.col("id").alias("task_id"),
        F.col("id").alias("message_id"),
        F.coalesce(text.filled("subject"), F.col("id")).alias("label"),
        subject.alias("subject"),
        text.or_empty("from_addr").alias("sender"),
        "date",
        "date_wall",
        "internal_date",
        F.lit(None).cast("string").alias("path"),
        F.col("body_hash").alias("content_hash"),
    )


def message_texts(messages: DataFrame) -> DataFrame:
    """(message_id, text): what a classifier reads, to be joined to the few rows it is sent."""
    body = text.effective_body("body_text", "body_html", "snippet")
    canonical = text.filled(text.canonical_text("from_addr", "subject", body))
    return messages.select(F.col("id").alias("message_id"), canonical.alias("text"))


def document_tasks(atts_with_message: DataFrame) -> DataFrame:
    """Ready documents as classification tasks."""
    return atts_with_message.select(
        F.lit("pdf").alias("type"),
        F.lit(0).alias("source_rank"),
        F.col("local_path").alias("task_id"),
        F.lit(None).cast("string").alias("message_id"),
        F.col("filename").alias("label"),
        F.lit(None).cast("string").alias("subject"),
        text.or_empty("from_addr").alias("sender"),
        "date",
        "date_wall",
        "internal_date",
        F.col("local_path").alias("path"),
        document_hash(atts_with_message).alias("content_hash"),
    )


def task_order() -> list[Column]:
    """Documents before messages, newest first within each."""
    return [
        F.col("source_rank").asc(),
        F.coalesce("internal_date", F.lit(0)).desc(),
        F.col("task_id").asc(),
    ]


def pending_tasks(
    messages: DataFrame,
    atts: DataFrame,
    cache: DataFrame,
    key: str,
    gist: bool = True,
    source: str = "emails",
    mode: str = "new",
    limit: int | None = None,
    listing: DataFrame | None = None,
    standing: Standing | None = None,
) -> DataFrame:
    """The work list: documents, messages or both (U1), capped on request."""
    parts = []
    if source in ("pdfs", "all"):
        stored = atts.where(F.col("local_path").isNotNull())
        rows = with_message(document_filter(stored, cache, key, gist, mode, standing), messages)
        if limit and source == "pdfs":
            # The cap comes before the readiness test here, as in the work list it mirrors.
            order = [F.coalesce("internal_date", F.lit(0)).desc(), F.col("local_path").asc()]
            rows = rows.orderBy(*order).limit(limit)
        parts.append(document_tasks(ready_documents(rows, listing)))
    if source in ("emails", "all"):
        rows = email_tasks(message_filter(messages, cache, key, gist, mode, standing))
        if limit and source == "emails":
            rows = rows.orderBy(*task_order()).limit(limit)
        parts.append(rows)
    tasks = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return tasks.orderBy(*task_order()).limit(limit) if limit and source == "all" else tasks


def missing_attachments(refs: DataFrame, atts: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """Attachment references whose bytes are not stored yet.

    A reference is stored if its attachment id is, with a ready path.  Old rows without an id
    count by filename, but only for messages none of whose ids is stored.
    """
    ready = ready_documents(atts, listing)
    has_id = text.filled("gmail_attachment_id").isNotNull()
    by_id = ready.where(has_id).select("message_id", F.col("gmail_attachment_id").alias("attachment_id"))
    by_name = ready.where(~has_id).select("message_id", "filename")
    by_name = by_name.distinct().join(by_id.select("message_id").distinct(), "message_id", "left_anti")
    row_id = F.concat_ws(" ", "message_id", "attachment_id", "part_path")
    left = without(refs, by_id, ["message_id", "attachment_id"], row_id)
    return without(left, by_name, ["message_id", "filename"], row_id, counted=refs)
