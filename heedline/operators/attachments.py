"""Storing fetched attachments once per content."""

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heedline import schemas
from heedline.functions import dates, payload, text
from heedline.operators.joins import lookup_join
from heedline.operators.keyed import replace_by_key
from heedline.operators.pending import ready_documents

_KEY = ["message_id", "gmail_attachment_id"]


def attachment_rows(messages: DataFrame, payload_json: str = "raw_payload") -> DataFrame:
    """One row per document reference of each stored message.

    ``payload_json`` holds the stored payload text; text that is no JSON yields no rows.
    Lists stay exploded: a message with very many attachments is many rows, not one wide one.
    """
    tree = F.try_parse_json(F.col(payload_json))
    read = messages.select("id", F.col(payload_json).alias("json"), tree.alias("tree"))
    headers = F.col("headers")
    found = read.withColumn("headers", payload.headers_of("tree")).select(
        F.col("id").alias("message_id"),
        payload.first_header(headers, "From").alias("from_addr"),
        payload.first_header(headers, "Date").alias("date"),
        F.explode(payload.attachment_refs(payload.part_tree("tree", "json"))).alias("ref"),
    )
    return found.select(
        "message_id",
        "from_addr",
        "date",
        F.col("ref.attachment_id").alias("attachment_id"),
        F.col("ref.filename").alias("filename"),
        F.col("ref.size").alias("size"),
        F.col("ref.part_path").alias("part_path"),
    )


def decoded(bodies: DataFrame) -> DataFrame:
    """Delivered bytes with their hash; text that is no base64 drops out.  A pure projection."""
    read = bodies.where(F.col("data").isNotNull()).select(
        "message_id", "attachment_id", text.from_base64url("data").alias("content")
    )
    return read.where(F.col("content").isNotNull()).withColumn("content_hash", F.sha2("content", 256))


def fetched(refs: DataFrame, bodies: DataFrame) -> DataFrame:
    """References with hash and size of their bytes; those not delivered drop out.

    Bytes are hashed where they are read and go no further.  Of several deliveries of one
    attachment the one with the smallest hash counts; ``write_contents`` takes the same.
    """
    size = F.octet_length("content").cast("bigint").alias("size_bytes")
    hashed = decoded(bodies).select("message_id", "attachment_id", F.struct("content_hash", size).alias("got"))
    one = hashed.groupBy("message_id", "attachment_id").agg(F.min("got").alias("got"))
    joined = refs.join(one, ["message_id", "attachment_id"])
    return joined.select(*[joined[c] for c in refs.columns], "got.content_hash", "got.size_bytes")


def stored_path_for_message(
    rows: DataFrame, atts: DataFrame, listing: DataFrame | None = None, counted: DataFrame | None = None
) -> DataFrame:
    """Adds ``message_path``: the ready path already stored for this very attachment."""
    known = ready_documents(atts, listing).where(text.filled("gmail_attachment_id").isNotNull())
    paths = known.groupBy("message_id", F.col("gmail_attachment_id").alias("attachment_id")).agg(
        F.min("local_path").alias("message_path")
    )
    row_id = F.concat_ws(" ", "message_id", "attachment_id", "part_path")
    return lookup_join(rows, paths, ["message_id", "attachment_id"], "left", row_id, counted=counted)


def stored_path_for_content(
    rows: DataFrame, atts: DataFrame, listing: DataFrame | None = None, counted: DataFrame | None = None
) -> DataFrame:
    """Adds ``content_path``: a ready path holding the same bytes, and its PDF's hash.

    The smallest path is taken, so repeated runs agree.
    """
    ready = schemas.align(ready_documents(atts, listing), schemas.ATTACHMENTS)
    best = F.min(F.struct("local_path", "pdf_hash")).alias("best")
    paths = ready.groupBy("content_hash").agg(best).select(
        "content_hash",
        F.col("best.local_path").alias("content_path"),
        F.col("best.pdf_hash").alias("content_pdf_hash"),
    )
    row_id = F.concat_ws(" ", "message_id", "attachment_id", "part_path")
    return lookup_join(rows, paths, ["content_hash"], "left", row_id, counted=counted)


def save_plan(
    rows: DataFrame,
    atts: DataFrame,
    as_of: Column | str | dt.datetime,
    root: str = "",
    converted: DataFrame | None = None,
    listing: DataFrame | None = None,
) -> DataFrame:
    """Decide the status and path of each fetched attachment.

    exists             stored for this message, or the same bytes are stored, or an earlier
                       row of this batch stores them
    downloaded         the first storable row of its content: its bytes are to be written
    conversion_failed  not a PDF and no converted file was supplied; nothing is stored

    ``rows`` needs message_id, attachment_id, filename, part_path, from_addr, date,
    content_hash and size_bytes.  ``converted`` lists (content_hash, pdf_hash) of documents
    whose PDF form was produced next to the raw file.
    """
    wall = dates.message_wall("date", F.col("feed_millis") if "feed_millis" in rows.columns else F.lit(None), as_of)
    raw_path = F.concat(F.lit(root), text.document_path(wall, "from_addr", "message_id", "filename", "content_hash"))
    found = stored_path_for_message(rows, atts, listing, counted=rows)
    found = stored_path_for_content(found, atts, listing, counted=rows)
    found = found.withColumn("raw_path", raw_path)
    row_id = F.concat_ws(" ", "message_id", "attachment_id", "part_path")
    if converted is None:
        found = found.withColumn("pdf_hash", F.lit(None).cast("string"))
    else:
        known = converted.groupBy("content_hash").agg(F.min("pdf_hash").alias("pdf_hash"))
        found = lookup_join(found, known, ["content_hash"], "left", row_id, counted=rows)

    native = text.is_pdf_path("raw_path")
    fresh = F.col("message_path").isNull() & F.col("content_path").isNull()
    storable = fresh & (native | F.col("pdf_hash").isNotNull())
    own_path = F.when(native, F.col("raw_path")).otherwise(text.with_suffix("raw_path", ".pdf"))
    place = F.struct("message_id", "part_path", "attachment_id")

    # First storable row per content: an aggregate with map-side combine, then a lookup back.
    first = (
        found.where(storable)
        .select("content_hash", place.alias("place"), own_path.alias("path"))
        .groupBy("content_hash")
        .agg(F.min(F.struct("place", "path")).alias("first"))
    )
    joined = lookup_join(found, first, ["content_hash"], "left", row_id, counted=rows)
    leads = joined.withColumn("place", place)
    before = F.col("first").isNull() | (F.col("place") < F.col("first.place"))
    status = (
        F.when(~fresh, "exists")
        .when(storable & (F.col("place") == F.col("first.place")), "downloaded")
        .when(~storable & before, "conversion_failed")
        .otherwise("exists")
    )
    path = F.coalesce("message_path", "content_path", F.when(~storable & before, F.col("raw_path")), "first.path")
    return leads.withColumns({"status": status, "path": path}).drop("place", "first")


def save_statuses(plan: DataFrame) -> DataFrame:
    """What a caller of a download gets back per attachment."""
    return plan.select("message_id", "attachment_id", "filename", "path", "status")


def attachment_updates(plan: DataFrame, as_of: Column | str | dt.datetime) -> DataFrame:
    """Table rows to insert or update; untouched and failed ones give none."""
    stamp = as_of if isinstance(as_of, Column) else F.lit(as_of)
    changed = plan.where(F.col("message_path").isNull() & (F.col("status") != "conversion_failed"))
    rows = changed.select(
        "message_id",
        F.col("attachment_id").alias("gmail_attachment_id"),
        "filename",
        "content_hash",
        F.coalesce("pdf_hash", "content_pdf_hash").alias("pdf_hash"),
        "size_bytes",
        F.col("path").alias("local_path"),
        stamp.cast("timestamp").alias("downloaded_at"),
    )
    return schemas.align(rows, schemas.ATTACHMENTS)


def write_attachments(atts: DataFrame, updates: DataFrame) -> DataFrame:
    """The attachments table after ``updates``.  Rows without an attachment id are appended."""
    named = updates.where(F.col("gmail_attachment_id").isNotNull())
    unnamed = updates.where(F.col("gmail_attachment_id").isNull())
    order = [F.col("downloaded_at"), F.col("content_hash"), F.col("filename")]
    stored = replace_by_key(schemas.align(atts, schemas.ATTACHMENTS), named, _KEY, order)
    return stored.unionByName(unnamed)
