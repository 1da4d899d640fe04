"""Classify what is still open."""

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heedline import constants as C
from heedline.functions.text import cache_key
from heedline.operators import inference, pending, search
from heedline.session import durable
from heedline.sources import tables
from heedline.sources.standing import Standing


@dataclass(frozen=True)
class Options:
    """How to pick and classify tasks.

    ``force`` redoes everything; with ``compat`` it only widens the selection and still takes
    good cached rows.  ``dry_run`` neither reads nor writes the cache.
    """

    source: str = "emails"
    model: str = C.MODEL_PRO
    gist: bool = True
    limit: int | None = None
    force: bool = False
    retry_failed: bool = False
    dry_run: bool = False
    compat: bool = False
    partitions: int | None = None
    attempts: int = C.MAX_ATTEMPTS
    delay: float = C.RETRY_DELAY_SECONDS

    @property
    def key(self) -> str:
        return cache_key(self.model, self.gist)

    @property
    def use_cache(self) -> bool:
        return not self.dry_run and (not self.force or self.compat)


@dataclass(frozen=True)
class Analysis:
    """``results``: every task with description, error and from_cache; ``cache_rows``: what is
    to be stored, empty on a dry run."""

    results: DataFrame
    cache_rows: DataFrame


def analyze(
    messages: DataFrame,
    atts: DataFrame,
    cache: DataFrame,
    classify: inference.Classify,
    as_of: dt.datetime | dt.date | str,
    options: Options = Options(),
    listing: DataFrame | None = None,
    contents: inference.Contents | None = None,
    materialize: bool = True,
    standing: Standing | None = None,
) -> Analysis:
    """Select tasks, classify each distinct content once, give every task its outcome.

    The work list and the outcomes are written to the shared folder before anything reads
    them: the list is narrow and read by every later step, and classifier calls are dear.
    ``contents`` (content_hash, content) has the bytes of documents, or gives them for wanted hashes.
    """
    mode = pending.selection_mode(options.force, options.retry_failed, options.dry_run)
    tasks = pending.pending_tasks(
        messages, atts, cache, options.key, options.gist, options.source, mode, options.limit, listing, standing
    )
    if materialize:
        tasks = durable(tasks, "tasks")
    return run_tasks(tasks, cache, classify, as_of, options, pending.message_texts(messages), contents, materialize)


def run_tasks(
    tasks: DataFrame,
    cache: DataFrame,
    classify: inference.Classify,
    as_of: dt.datetime | dt.date | str,
    options: Options,
    texts: DataFrame | None = None,
    contents: inference.Contents | None = None,
    materialize: bool = True,
) -> Analysis:
    """Classify a given work list; ``texts`` and ``contents`` hold what it is about."""
    outcomes = inference.call_outcomes(
        tasks,
        cache,
        classify,
        options.key,
        options.gist,
        texts,
        contents,
        options.use_cache,
        options.dry_run,
        options.partitions,
        options.attempts,
        options.delay,
    )
    if materialize:
        outcomes = durable(outcomes, "outcomes")
    results = inference.task_results(tasks, cache, outcomes, options.key, options.gist, options.use_cache)
    rows = inference.new_cache_rows(outcomes, options.key, options.gist, F.lit(as_of))
    return Analysis(results, rows.where(F.lit(not options.dry_run)))


def analyze_mailbox(
    box: tables.Mailbox,
    classify: inference.Classify,
    as_of: dt.datetime | dt.date | str,
    options: Options = Options(),
    listing: DataFrame | None = None,
) -> DataFrame:
    """Analyze the stored tables, save the new cache rows, return the results."""
    stored = (box.messages.read(), box.attachments.read(), box.extractions.read())
    done = analyze(*stored, classify, as_of, options, listing, box.contents(), standing=box.standing)
    results = durable(done.results, "results")
    if not options.dry_run:
        box.save_extractions(done.cache_rows)
    return results


def preview(
    messages: DataFrame, classify: inference.Classify, as_of: dt.datetime | dt.date | str, limit: int = 10, **options
) -> DataFrame:
    """Dry run over the newest messages."""
    chosen = Options(source="emails", dry_run=True, limit=limit, **options)
    no_rows = messages.sparkSession.createDataFrame([], tables.schemas.EXTRACTIONS)
    no_atts = messages.sparkSession.createDataFrame([], tables.schemas.ATTACHMENTS)
    return analyze(messages, no_atts, no_rows, classify, as_of, chosen).results


def analyze_documents(
    messages: DataFrame,
    atts: DataFrame,
    cache: DataFrame,
    classify: inference.Classify,
    as_of: dt.datetime | dt.date | str,
    listing: DataFrame | None = None,
    contents: inference.Contents | None = None,
    **options,
) -> Analysis:
    """Documents only (B11), with their bytes where ``contents`` has them."""
    return analyze(messages, atts, cache, classify, as_of, Options(source="pdfs", **options), listing, contents)


def undescribed(atts: DataFrame, cache: DataFrame, limit: int | None = None) -> DataFrame:
    """Documents no model has described, latest first; all unless a limit is given."""
    return search.latest_downloads(pending.never_described(atts, cache), limit)


def document_path_tasks(atts: DataFrame) -> DataFrame:
    """Stored documents as tasks without their message, labelled by file name."""
    columns = {
        "type": F.lit("pdf"),
        "source_rank": F.lit(0),
        "task_id": F.col("local_path"),
        "message_id": F.lit(None).cast("string"),
        "label": F.element_at(F.split("local_path", "/"), -1),
        "subject": F.lit(None).cast("string"),
        "sender": F.lit(""),
        "date": F.lit(None).cast("string"),
        "date_wall": F.lit(None).cast("timestamp_ntz"),
        "internal_date": F.unix_timestamp(F.col("downloaded_at").cast("timestamp")),
        "path": F.col("local_path"),
        "content_hash": pending.document_hash(atts),
    }
    return atts.select(*[value.alias(name) for name, value in columns.items()])


def describe_documents(
    atts: DataFrame,
    cache: DataFrame,
    classify: inference.Classify,
    as_of: dt.datetime | dt.date | str,
    model: str = C.MODEL_FLASH,
    everything: bool = False,
    limit: int | None = None,
    listing: DataFrame | None = None,
    contents: inference.Contents | None = None,
    **options,
) -> Analysis:
    """Describe undescribed documents as plain text, or redo all of them."""
    rows = atts if everything else undescribed(atts, cache, limit)
    tasks = document_path_tasks(pending.ready_documents(rows, listing))
    chosen = Options(model=model, gist=False, force=everything, **options)
    return run_tasks(tasks, cache, classify, as_of, chosen, contents=contents)


def describe_paths(
    documents: DataFrame,
    cache: DataFrame,
    classify: inference.Classify,
    as_of: dt.datetime | dt.date | str,
    model: str = C.MODEL_FLASH,
    contents: inference.Contents | None = None,
    **options,
) -> Analysis:
    """Describe document files by path (B8 with one path); see ``landing.documents``."""
    columns = documents.select(
        F.col("path").alias("local_path"), "content_hash", F.lit(None).cast("timestamp").alias("downloaded_at")
    )
    chosen = Options(model=model, gist=False, **options)
    return run_tasks(document_path_tasks(columns), cache, classify, as_of, chosen, contents=contents)
