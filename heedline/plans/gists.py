"""The triage view: cached gists week by week, most urgent last."""

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heedline.functions import dates, gist as g, text
from heedline.operators.joins import lookup_join
from heedline.operators.shortid import short_id_column
from heedline.operators.weeks import compute_once, recent_weeks, with_week


def gists_with_message(cache: DataFrame, messages: DataFrame) -> DataFrame:
    """Structured cache rows joined to their message (J2, P10); rows without one drop out."""
    rows = cache.where(text.is_gist_model("model_name") & F.col("message_id").isNotNull()).select(
        F.col("message_id").alias("id"), "model_name", "content_hash", "extracted_json"
    )
    parents = messages.select("id", "date", "date_wall", "from_addr")
    return lookup_join(rows, parents, ["id"], "inner", "content_hash")


def gists_of_twins(cache: DataFrame, messages: DataFrame) -> DataFrame:
    """As above, but every message with the same content shows the shared gist.

    Several models may have described one content; their rows are told apart by model name,
    so the lookup side repeats a hash at most once per model.
    """
    rows = cache.where(text.is_gist_model("model_name")).select(
        F.col("content_hash").alias("body_hash"), "model_name", "content_hash", "extracted_json"
    )
    parents = messages.select("id", "date", "date_wall", "from_addr", "body_hash")
    return lookup_join(parents, rows, ["body_hash"], "inner", "id").drop("body_hash")


def grep(rows: DataFrame, pattern: str | None) -> DataFrame:
    """Keep rows whose JSON text contains the pattern, any case."""
    if not pattern:
        return rows
    return rows.where(F.contains(F.lower(text.or_empty("extracted_json")), F.lit(pattern.lower())))


def ranked(
    rows: DataFrame,
    as_of: Column | str | dt.date,
    weeks: int | None = None,
    show_noise: bool = False,
    description: str = "extracted_json",
    sender: str = "from_addr",
) -> DataFrame:
    """Week, priority group and sort keys of each row; noise dropped unless asked for
    (H13, P8, N8, H14, P9, L4).

    The week filter runs on the stored wall date, before any JSON is parsed; the JSON of a row
    is parsed once.
    """
    dated = recent_weeks(with_week(rows, "date_wall", as_of), weeks)
    parsed = compute_once(dated, "parsed", g.parse_gist(description))
    grouped = parsed.withColumn("group", g.priority_group(description, F.col("parsed")))
    shown = grouped if show_noise else grouped.where(F.col("group") != 0)
    # A row without a usable record sorts by its message's sender.
    own = F.when(F.col("group") > -2, text.filled(F.col("parsed.gist.sender")))
    name = F.coalesce(own, F.col(sender), F.lit(""))
    return shown.withColumns(
        {"sender_key": F.lower(text.strip(name)), "date_key": dates.date_sort_key("date")}
    )


def order_of_view(models: bool = True) -> list[Column]:
    """Oldest week first; inside a week errors, noise, routine, obligations, critical.

    Id and model (where there is one) make the order total, and let a range sort split one very
    large week.
    """
    return [
        F.col("week_idx").desc(),
        F.col("week_label").desc(),
        F.col("group").asc(),
        F.col("sender_key").asc(),
        F.col("date_key").asc(),
        F.col("id").asc(),
        *([F.col("model_name").asc()] if models else []),
    ]


def view_columns(
    rows: DataFrame, as_of: Column | str | dt.date, short_id: Column, description: str = "extracted_json"
) -> DataFrame:
    """Printed fields of each row."""
    record = F.col("parsed.gist")
    kept = [c for c in ("model_name", "type") if c in rows.columns]
    failed = F.col("task_error") if "task_error" in rows.columns else F.lit(None).cast("string")
    unread = F.when(text.filled(description).isNotNull() & ~F.col("parsed.valid"), F.concat(F.lit("bad field: "), "parsed.reason"))
    return rows.select(
        "week_idx",
        "week_label",
        "group",
        "sender_key",
        "date_key",
        "id",
        *kept,
        short_id.alias("short_id"),
        dates.short_date_of(F.col("date_wall"), "date", as_of).alias("shown_date"),
        F.coalesce(text.filled(record["sender"]), text.row_sender("from_addr", "id")).alias("sender"),
        g.row_meta(record, as_of).alias("meta"),
        record["clue"].alias("clue"),
        F.coalesce(failed, unread, record["error"]).alias("error"),
    )


def gists(
    cache: DataFrame,
    messages: DataFrame,
    as_of: Column | str | dt.date,
    pattern: str | None = None,
    weeks: int | None = None,
    show_noise: bool = False,
    short_length: int | None = None,
) -> DataFrame:
    """All cached gists, filtered, ranked and in display order.

    ``short_length`` is the length of short ids where it is known (``sources.shortids``).
    """
    rows = grep(gists_with_message(cache, messages), pattern)
    shown = ranked(rows, as_of, weeks, show_noise)
    return view_columns(shown, as_of, short_id_column(messages, length=short_length)).orderBy(*order_of_view())


def results_view(
    results: DataFrame,
    messages: DataFrame,
    as_of: Column | str | dt.date,
    show_noise: bool = False,
    short_length: int | None = None,
) -> DataFrame:
    """The same view over the results of a run; failed tasks come first (B2's report)."""
    rows = results.withColumnsRenamed({"task_id": "id", "sender": "from_addr"}).withColumn("task_error", F.col("error"))
    shown = ranked(rows.drop("error"), as_of, None, show_noise, "description")
    view = view_columns(shown, as_of, short_id_column(messages, length=short_length), "description")
    return view.orderBy(*order_of_view("model_name" in view.columns))
