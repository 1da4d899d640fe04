"""The three tables of a mailbox, and their upkeep.

How they are stored is described in ``runs``.
"""

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heedline import schemas
from heedline.functions import dates, payload, text
from heedline.operators.attachments import decoded
from heedline.operators.joins import cut_down, lookup_join, without
from heedline.operators.keyed import first_per_key, newest_of_stored, newest_per_key, replace_by_key
from heedline.operators.pending import attachment_row, document_hash
from heedline.session import durable
from heedline.sources.landing import HASH_VERSION
from heedline.sources.runs import Table
from heedline.sources.shortids import ShortIds
from heedline.sources.standing import DOCUMENT, MESSAGE, Standing

MESSAGE_KEY = ["id"]
EXTRACTION_KEY = ["content_hash", "model_name"]
ATTACHMENT_KEY = ["message_id", "gmail_attachment_id"]


class Mailbox:
    """The messages, attachments and extraction-cache tables and the contents under one root.

    Messages that were hashed by an older version are brought up to date on opening; which runs hold
    such rows is known from the list of runs, so opening reads no rows.

    With ``standing`` it is kept from save to save which messages and documents are open or failed
    for any gist model, so that an analysis need not join the tables to find them, and how long short
    ids are, so that a view need not hash all ids.
    """

    def __init__(self, spark: SparkSession, root: str, standing: bool = False):
        self.spark, self.root = spark, root.rstrip("/")
        self.messages = Table(spark, f"{self.root}/messages", schemas.MESSAGES, MESSAGE_KEY, stamp="hash_version")
        self.attachments = Table(spark, f"{self.root}/attachments", schemas.ATTACHMENTS, ATTACHMENT_KEY)
        self.extractions = Table(spark, f"{self.root}/extractions", schemas.EXTRACTIONS, EXTRACTION_KEY)
        self.content_folder = f"{self.root}/contents"
        self.messages.change(HASH_VERSION, migrate_messages)
        self.standing = Standing(spark, f"{self.root}/standing") if standing else None
        self.short_ids = ShortIds(spark, f"{self.root}/short-ids") if standing else None
        if standing and self.standing.seen() != self._numbers():
            # The tables were changed without it, or a job ended in between.
            items = message_items(self.messages.read()).unionByName(document_items(self.attachments.read()))
            self.standing.rebuild(items, self.extractions.read())
            self.short_ids.take_in(self.messages.read().select("id"))
            self.standing.note(self._numbers())

    def _numbers(self) -> dict[str, int]:
        return {name: getattr(self, name).number() for name in ("messages", "attachments", "extractions")}

    def _keep_up(self, **changes: DataFrame) -> None:
        if self.standing:
            self.standing.take_in(**changes)
            self.standing.note(self._numbers())

    def short_length(self) -> int | None:
        """The length of short ids, if it is kept."""
        return self.short_ids.length() if self.short_ids else None

    def contents(self) -> DataFrame:
        """(path, content_hash, content) of what was stored."""
        return stored_contents(self.spark, self.content_folder)

    def save_messages(self, rows: DataFrame, stored: bool = False) -> None:
        """``stored``: ``rows`` are read from a table, so they need not be written to be read again."""
        rows = schemas.align(rows, schemas.MESSAGES)
        rows = rows if stored else durable(rows, "given-messages")
        fresh = newest_of_stored(rows, MESSAGE_KEY, message_order())
        self.messages.put(fresh)
        if self.short_ids:
            self.short_ids.take_in(rows.select("id"))
        self._keep_up(items=message_items(fresh))

    def add_messages(self, rows: DataFrame, n: int | None = None) -> DataFrame:
        """Save ``n`` rows with new ids, each once, as they are read: the run is their one copy, which is returned."""
        added = self.messages.append(rows, n)
        if self.short_ids:
            self.short_ids.take_in(added.select("id"))
        self._keep_up(items=message_items(added))
        return added

    def save_extractions(self, rows: DataFrame) -> None:
        if not self.standing:
            self.extractions.upsert(rows, extraction_order())
            return
        rows = durable(schemas.align(rows, schemas.EXTRACTIONS), "given-extractions")
        fresh = newest_of_stored(rows, EXTRACTION_KEY, extraction_order())
        replaced = self.extractions.current(fresh.select(*EXTRACTION_KEY), ["extracted_json", "message_id"])
        replaced = durable(replaced, "replaced-extractions")
        self.extractions.put(fresh)
        self._keep_up(added=fresh, replaced=replaced)

    def save_attachments(self, rows: DataFrame) -> None:
        """Rows without an attachment id have no key and are appended."""
        named = rows.where(F.col("gmail_attachment_id").isNotNull())
        self.attachments.upsert(named, [F.col("downloaded_at"), F.col("content_hash"), F.col("filename")])
        unnamed = rows.where(F.col("gmail_attachment_id").isNull())
        if not unnamed.isEmpty():
            self.attachments.append(unnamed)
        if self.standing:
            # As stored: of rows with one key the last.
            wanted = durable(named.select(*ATTACHMENT_KEY).distinct(), "saved-attachments")
            stored = self.attachments.current(wanted, ["filename", "content_hash", "pdf_hash"])
            changed = stored.unionByName(schemas.align(unnamed, schemas.ATTACHMENTS).select(*stored.columns))
            self._keep_up(items=document_items(changed))


def message_items(messages: DataFrame) -> DataFrame:
    """Messages as items of ``standing``."""
    return messages.select(F.lit(MESSAGE).alias("kind"), "id", F.col("body_hash").alias("hash"))


def document_items(atts: DataFrame) -> DataFrame:
    """Attachment rows as items of ``standing``: rows that can't be told apart otherwise go by their hash."""
    digest = document_hash(atts)
    row = F.concat_ws(" ", attachment_row(), digest)
    return atts.select(F.lit(DOCUMENT).alias("kind"), row.alias("id"), digest.alias("hash"))


# ---- upserts ------------------------------------------------------------------------------


def message_order() -> list[Column]:
    return [F.col("synced_at"), F.coalesce("body_hash", F.lit(""))]


def extraction_order() -> list[Column]:
    return [F.col("created_at"), F.coalesce("message_id", F.lit("")), F.coalesce("extracted_json", F.lit(""))]


def upsert_messages(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The last write of an id wins."""
    return replace_by_key(stored, incoming, MESSAGE_KEY, message_order())


def upsert_extractions(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The last write of a (content, model) wins (S3)."""
    return replace_by_key(stored, incoming, EXTRACTION_KEY, extraction_order())


def latest_messages(log: DataFrame) -> DataFrame:
    """Current rows of an append-only message log (S2 as merge-on-read)."""
    return newest_per_key(log, MESSAGE_KEY, message_order())


def compound_key(rows: DataFrame) -> DataFrame:
    """Migration to the (content, model) key: of equal keys the lowest row id stays."""
    return first_per_key(rows, EXTRACTION_KEY, [F.col("id")])


def cached_text(tasks: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Any row stored for (content_hash, key), next to each task."""
    rows = cache.where(F.col("model_name") == key).select("content_hash", F.col("extracted_json").alias("cached"))
    return lookup_join(tasks, rows, ["content_hash"], "left", F.xxhash64(*tasks.columns))


# ---- upkeep of stored messages ------------------------------------------------------------


def backfill_body_hash(messages: DataFrame) -> DataFrame:
    """Fill missing hashes where there is a body."""
    has_body = text.has_body("body_text", "body_html", "snippet")
    return messages.withColumn("body_hash", F.coalesce("body_hash", F.when(has_body, text.body_hash())))


def rehash_once(messages: DataFrame) -> DataFrame:
    """Recompute hashes written by an older formula, once.

    Rows stamped with the current version are left alone, so a second run changes nothing.
    """
    old = F.coalesce("hash_version", F.lit(0)) < HASH_VERSION
    cleared = messages.withColumn("body_hash", F.when(~old, F.col("body_hash")))
    return backfill_body_hash(cleared).withColumn("hash_version", F.lit(HASH_VERSION))


def backfill_internal_date(messages: DataFrame) -> DataFrame:
    """Fill missing instants from the date header."""
    return messages.withColumn("internal_date", F.coalesce("internal_date", dates.mail_epoch("date")))


def backfill_message_header_id(messages: DataFrame) -> DataFrame:
    """Fill missing Message-IDs from the stored payload."""
    headers = payload.headers_of(F.try_parse_json(F.col("raw_payload")))
    found = text.filled(payload.first_header(headers, "Message-ID"))
    return messages.withColumn("message_header_id", F.coalesce("message_header_id", found))


def migrate_messages(messages: DataFrame) -> DataFrame:
    """Bring any older messages table to the current schema and contents."""
    current = schemas.align(messages, schemas.MESSAGES)
    return backfill_internal_date(rehash_once(backfill_message_header_id(current)))


def since_window(
    messages: DataFrame, as_of: Column | str | dt.datetime, days: int, compat: bool = False
) -> DataFrame:
    """Messages synced or dated in the last ``days``.

    ``compat`` compares the raw header text with ISO text, which passes almost any header that
    starts with a weekday; the default compares instants.
    """
    start = (as_of if isinstance(as_of, Column) else F.lit(as_of)).cast("timestamp") - F.make_dt_interval(F.lit(days))
    synced = F.col("synced_at") >= start
    if compat:
        iso = F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss")
        return messages.where(synced | (F.col("date") >= iso))
    return messages.where(synced | (F.col("internal_date") >= F.unix_timestamp(start)))


# ---- sinks --------------------------------------------------------------------------------

_CONTENTS = "path string, content_hash string, content binary, domain string, year_month string"


def stored_contents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content_hash, content) of the content sink; no rows if there is none yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stored = spark.read.schema(_CONTENTS).parquet(folder) if fs.exists(path) else spark.createDataFrame([], _CONTENTS)
    return stored.select("path", "content_hash", "content")


def write_contents(
    plan: DataFrame, bodies: DataFrame, folder: str, partition_by: tuple[str, ...] = ("year_month",)
) -> None:
    """Bytes of newly stored attachments, once per content.

    What is stored already is left out, so a job that is run again writes nothing twice.  That
    is settled on hashes; only the bytes to be written are then taken from ``bodies``, and move once.
    Month folders stay few; add "domain" only for archives with few senders.
    """
    pieces = F.split(F.col("raw_path"), "/")
    rows = plan.where(F.col("status") == "downloaded").select(
        "message_id",
        "attachment_id",
        "path",
        "content_hash",
        F.element_at(pieces, -2).alias("domain"),
        F.element_at(pieces, -3).alias("year_month"),
    )
    known = stored_contents(plan.sparkSession, folder).select("content_hash")
    wanted = durable(without(rows, known, ["content_hash"], "path"), "wanted-contents")
    found = cut_down(decoded(bodies), wanted, ["message_id", "attachment_id", "content_hash"])
    # An attachment may have been delivered more than once.
    once = found.select("content_hash", "content").repartition("content_hash").dropDuplicates(["content_hash"])
    places = wanted.select("path", "content_hash", "domain", "year_month").dropDuplicates(["content_hash"])
    once = once.join(places, "content_hash").select("path", "content_hash", "content", "domain", "year_month")
    once.write.mode("append").option("compression", "zstd").partitionBy(*partition_by).parquet(folder)


def result_texts(results: DataFrame, gist: bool) -> DataFrame:
    """(path, text) of each described document, the path ending in .gist.txt or .txt."""
    suffix = ".gist.txt" if gist else ".txt"
    described = results.where((F.col("type") == "pdf") & text.filled("description").isNotNull())
    return described.select(text.with_suffix("path", suffix).alias("path"), F.col("description").alias("text"))


def text_table(spark: SparkSession, folder: str) -> Table:
    """The result texts: one dataset with a row per path, not a file per document."""
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("text", T.StringType())])
    return Table(spark, folder, schema, ["path"])


def write_result_texts(results: DataFrame, folder: str, gist: bool) -> None:
    """Writes over texts of the same path, so a job may be run again."""
    rows = durable(result_texts(results, gist), "result-texts")
    text_table(results.sparkSession, folder).upsert(rows, [F.col("text")])
