"""Take in new messages and their attachments, then classify."""

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heedline import schemas
from heedline.operators import attachments, inference, pending
from heedline.plans.analyze import Options, analyze_mailbox
from heedline.session import durable
from heedline.sources import landing, tables


def new_messages(raw: DataFrame, stored: DataFrame, as_of, days: int | None = 7) -> DataFrame:
    """Landed records inside the look-back window whose id is unknown."""
    listed = raw if days is None else landing.within_days(raw, as_of, days)
    return pending.new_deliveries(listed, stored)


def sync_tally(raw: DataFrame, stored: DataFrame, as_of, days: int | None = 7) -> DataFrame:
    """Listed, already stored, new and downloaded records, as one row (A4).

    An id that is delivered twice is downloaded once.  ``undated`` counts the records that the
    look-back window leaves out because neither the feed's date nor the header's can be read.
    """
    listed = raw if days is None else landing.within_days(raw, as_of, days)
    ids = listed.select("id")
    known = stored.select("id").join(ids.distinct(), "id", "left_semi").distinct().withColumn("known", F.lit(True))
    undated = landing.dated(raw).agg(F.count_if(F.col(landing.MILLIS).isNull())).scalar() if days is not None else F.lit(0).cast("bigint")
    counts = ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).join(known, "id", "left")
    new = F.col("known").isNull()
    zero = F.lit(0).cast("bigint")
    return counts.agg(
        F.coalesce(F.sum("n"), zero).alias("listed"),
        F.coalesce(F.sum(F.when(~new, F.col("n"))), zero).alias("stored"),
        F.coalesce(F.sum(F.when(new, F.col("n"))), zero).alias("new"),
        F.count_if(new & F.col("id").isNotNull()).alias("downloaded"),
    ).withColumn("undated", undated)


def save_attachments(
    box: tables.Mailbox,
    refs: DataFrame,
    bodies: DataFrame,
    as_of,
    content_folder: str | None = None,
    converted: DataFrame | None = None,
    listing: DataFrame | None = None,
) -> DataFrame:
    """Store fetched attachments once per content; returns the status of each.

    Bytes are hashed where they are read; they are read again only to write the contents that
    are new, by default into the mailbox.
    """
    hashed = durable(attachments.fetched(refs, bodies), "attachment-hashes")
    stored = box.attachments.read()
    plan = durable(attachments.save_plan(hashed, stored, as_of, "", converted, listing), "attachment-plan")
    tables.write_contents(plan, bodies, content_folder or box.content_folder)
    box.save_attachments(durable(attachments.attachment_updates(plan, as_of), "attachment-updates"))
    return attachments.save_statuses(plan)


def sync(
    box: tables.Mailbox,
    raw: DataFrame,
    bodies: DataFrame | None,
    as_of,
    days: int | None = 7,
    classify: inference.Classify | None = None,
    options: Options = Options(source="all"),
    content_folder: str | None = None,
    converted: DataFrame | None = None,
    listing: DataFrame | None = None,
) -> dict[str, DataFrame | None]:
    """Messages, then attachments, then (given a classifier) the analysis; and the tally.

    ``raw`` is read once, unless it is staged already (``landing.Landing``).  New messages are written
    once, into the mailbox; ``messages`` reads them there, until unused runs are removed.
    """
    raw, stored = landing.staged(raw, None, 0, days is not None), box.messages.read()
    tally = durable(sync_tally(raw, stored, as_of, days), "tally")
    fresh = new_messages(raw, stored, as_of, days)
    rows = box.add_messages(landing.flatten_messages(fresh, F.lit(as_of)), fresh.count())
    statuses = None
    if bodies is not None:
        refs = attachments.attachment_rows(rows)
        statuses = save_attachments(box, refs, bodies, as_of, content_folder, converted, listing)
    results = analyze_mailbox(box, classify, as_of, options, listing) if classify else None
    return {"messages": rows, "attachments": statuses, "results": results, "tally": tally}


def attachment_count(atts: DataFrame) -> DataFrame:
    """Rows in the attachments table (A2)."""
    return atts.agg(F.count(F.lit(1)).alias("attachments"))


def backfill_refs(messages: DataFrame, atts: DataFrame, as_of, days: int = 30, compat: bool = False, listing=None) -> DataFrame:
    """References in recent stored payloads whose bytes are still missing."""
    window = tables.since_window(messages, as_of, days, compat)
    # Read several times in what follows, so payloads are not parsed again for each.
    refs = durable(attachments.attachment_rows(window), "window-references")
    return pending.missing_attachments(refs, atts, listing)


def backfill(
    box: tables.Mailbox, bodies: DataFrame, as_of, days: int = 30, compat: bool = False, **save_options
) -> DataFrame:
    """Fetch what the window still lacks; statuses as in ``save_attachments``."""
    refs = backfill_refs(
        box.messages.read(), box.attachments.read(), as_of, days, compat, save_options.get("listing")
    )
    return save_attachments(box, durable(refs, "missing-attachments"), bodies, as_of, **save_options)


def download_statuses(messages: DataFrame, bodies: DataFrame, atts: DataFrame, as_of, **plan_options) -> DataFrame:
    """Status of every attachment of the given messages, without storing anything."""
    got = attachments.fetched(attachments.attachment_rows(messages), bodies)
    plan = attachments.save_plan(got, schemas.align(atts, schemas.ATTACHMENTS), as_of, **plan_options)
    return attachments.save_statuses(plan)
