"""Recent lists, search, documents and reply drafts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heedline.functions import text
from heedline.operators import pending, search

_LIST_COLUMNS = ("id", "date", "from_addr", "subject", "internal_date")


def recent(messages: DataFrame, limit: int | None = 10) -> DataFrame:
    """Newest messages for display."""
    return search.list_rows(search.newest(messages.select(*_LIST_COLUMNS), limit), 35, 40)


def search_messages(messages: DataFrame, term: str, limit: int | None = 10) -> DataFrame:
    """Newest messages whose sender or subject contains the term."""
    hits = search.matching(messages.select(*_LIST_COLUMNS), term)
    return search.list_rows(search.newest(hits, limit), 30, 35)


def documents(atts: DataFrame, messages: DataFrame, limit: int | None = 20) -> DataFrame:
    """Latest stored documents with sender and size in KB.

    Cut before formatting; the join only ever feeds a top-k.
    """
    rows = search.latest_downloads(pending.with_message(atts, messages), limit)
    size = F.coalesce(F.col("size_bytes") / 1024, F.lit(0.0))
    return rows.select(
        "message_id",
        "filename",
        F.round(size, 1).alias("size_kb"),
        text.left(text.or_empty("from_addr"), 50).alias("from_addr"),
        F.col("local_path").alias("path"),
        "subject",
        "downloaded_at",
    )


def reply_drafts(requests: DataFrame, messages: DataFrame) -> DataFrame:
    """Drafts for requests (key, body): recipient, subject, thread and references.

    Unknown keys and empty bodies give no draft.  Nothing is sent.
    """
    worded = requests.withColumn("body", text.strip("body")).where(F.col("body") != "")
    return draft_columns(search.found_messages(worded, messages)).withColumn("preview", text.clip("body", 500))


def draft_columns(rows: DataFrame) -> DataFrame:
    reference = text.filled("message_header_id")
    extra = [c for c in ("key", "body") if c in rows.columns]
    return rows.select(
        *extra,
        "id",
        "thread_id",
        text.reply_address("from_addr").alias("to_addr"),
        text.reply_subject("subject").alias("reply_subject"),
        reference.alias("in_reply_to"),
        reference.alias("references"),
    )
