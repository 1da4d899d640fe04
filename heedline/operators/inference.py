"""Cached batch classification.

The classifier is a callable the user supplies; it is the only Python that runs on executors.
It gets pandas batches and returns one outcome per row:

    classify(batch: pandas.DataFrame) -> pandas.DataFrame

with the index of ``batch`` and the columns ``status`` ('ok', 'blocked' or 'failed'), ``text``
and ``error``.  Spark decides how the rows are spread, and every distinct content is sent once.
"""

from collections.abc import Callable
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heedline import constants as C
from heedline import schemas
from heedline.functions.gist import blocked_gist, failure_gist, parse_gist, usable_cache_row
from heedline.functions.text import filled, let
from heedline.operators import attempts as worker_side
from heedline.operators.attempts import KEPT_COLUMNS, Classify, call_in_batches
from heedline.operators.joins import BROADCAST_KEYS, cut_down, lookup_join
from heedline.operators.keyed import first_per_key
from heedline.operators.weeks import compute_once
from heedline.session import durable

# Ship the worker-side code with the job, so that executors need not have this package.
cloudpickle.register_pickle_by_value(worker_side)

NO_RESPONSE = "no response"

# (content_hash, content), or what gives it for a table of wanted hashes.
Contents = DataFrame | Callable[[DataFrame], DataFrame]

# Columns of a task the classifier may read.
BATCH_COLUMNS = ["content_hash", "type", "text", "content", "path", "subject", "sender", "label", "message_id", "date"]
# Calls are slow: no more rows than this to one task.
ROWS_PER_CALL_TASK = 1000
_OF = "__of"
_CALL_SCHEMA = ", ".join(f"{c} string" for c in [*KEPT_COLUMNS, "outcome", "reply", "call_error"])


def with_cached(tasks: DataFrame, cache: DataFrame, key: str, gist: bool, use_cache: bool = True) -> DataFrame:
    """Adds ``cached``: the usable text stored for this content and model, else NULL.

    Cache rows are cut down to the contents of the work list before their JSON is parsed.
    """
    if not use_cache:
        return tasks.withColumn("cached", F.lit(None).cast("string"))
    asked = tasks.select("content_hash").where(F.col("content_hash").isNotNull()).distinct()
    rows = cache.where(F.col("model_name") == key).join(asked, "content_hash", "left_semi")
    usable = let(parse_gist("extracted_json"), lambda p: usable_cache_row("extracted_json", p, gist))
    hits = compute_once(rows, "usable", usable).where("usable")
    hits = hits.select("content_hash", F.col("extracted_json").alias("cached"))
    return lookup_join(tasks, hits, ["content_hash"], "left", "task_id", counted=tasks)


def one_per_content(tasks: DataFrame) -> DataFrame:
    """The newest task of each content.

    Picked with map-side combine, then fetched by task id: the copies of a much-repeated
    content are never brought together.
    """
    place = F.struct(
        "source_rank",
        (-F.coalesce("internal_date", F.lit(0))).alias("age"),
        "task_id",
    )
    known = tasks.where(F.col("content_hash").isNotNull())
    chosen = known.groupBy("content_hash").agg(F.min(place).alias("p"))
    chosen = chosen.select("p.source_rank", "p.task_id", "content_hash")
    picked = known.join(chosen, ["source_rank", "task_id", "content_hash"], "left_semi")
    # A stored path may serve several attachments; such rows merge here.
    documents = picked.where(F.col("type") == "pdf")
    one_each = first_per_key(documents, ["content_hash"], [F.col("task_id"), F.col("label"), F.col("date")])
    return picked.where(F.col("type") != "pdf").unionByName(one_each)


def call(
    misses: DataFrame,
    classify: Classify,
    texts: DataFrame | None = None,
    contents: Contents | None = None,
    partitions: int | None = None,
    attempts: int = C.MAX_ATTEMPTS,
    delay: float = C.RETRY_DELAY_SECONDS,
) -> DataFrame:
    """Run the classifier over rows that are distinct by content_hash.

    ``texts`` has (message_id, text) for messages, ``contents`` (content_hash, content) for
    documents, or is a function that gives these for a table of wanted hashes.  Both are cut down
    to the rows that are sent where they are read, so no other text or byte moves; for more rows than
    are broadcast all of them move.  The rows are spread over a number of tasks that follows from rows
    and cores, which adaptive execution leaves alone, and texts and bytes meet them in these tasks, so
    that each moves once.  Messages go by their id, documents by their hash.
    """
    misses = durable(misses.where(F.col("type").isNotNull()), "misses")
    document = F.col("type") == "pdf"
    if partitions is None:
        rows, cores = misses.count(), misses.sparkSession.sparkContext.defaultParallelism
        partitions = max(1, min(rows, 2 * cores), -(-rows // ROWS_PER_CALL_TASK))
    of_message, of_document = F.concat(F.lit("m"), "message_id"), F.concat(F.lit("d"), "content_hash")
    # Messages without an id have no text and are spread by their hash.
    own = F.coalesce(F.when(document, of_document).otherwise(of_message), F.concat(F.lit("n"), "content_hash"))
    batch = misses.withColumn(_OF, own).repartition(partitions, _OF)
    no_text, no_content = F.lit(None).cast("string").alias("text"), F.lit(None).cast("binary").alias("content")
    found = []
    if texts is not None:
        ids = misses.where(~document & F.col("message_id").isNotNull()).select("message_id").distinct()
        found.append(_sent(texts, ids, "message_id").select(of_message.alias(_OF), "text", no_content))
    if contents is not None:
        hashes = misses.where(document).select("content_hash").distinct()
        given = contents(hashes) if callable(contents) else _sent(contents, hashes, "content_hash")
        found.append(given.select(of_document.alias(_OF), no_text, "content"))
    if found:
        met = reduce(DataFrame.unionByName, found).where(F.col(_OF).isNotNull())
        # A join has the session's number of partitions at least.
        batch = batch.join(met.repartition(partitions, _OF), _OF, "left").coalesce(partitions)
    else:
        batch = batch.withColumns({"text": no_text, "content": no_content})
    sent = batch.select(*BATCH_COLUMNS)
    return sent.mapInPandas(call_in_batches(classify, attempts, delay), _CALL_SCHEMA)


def _sent(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Texts or bytes that are wanted, if they can be picked where they are read; else all."""
    n = wanted.count()
    return cut_down(rows, wanted, [key], n) if n <= BROADCAST_KEYS else rows


def call_outcomes(
    tasks: DataFrame,
    cache: DataFrame,
    classify: Classify,
    key: str,
    gist: bool = True,
    texts: DataFrame | None = None,
    contents: Contents | None = None,
    use_cache: bool = True,
    dry_run: bool = False,
    partitions: int | None = None,
    attempts: int = C.MAX_ATTEMPTS,
    delay: float = C.RETRY_DELAY_SECONDS,
) -> DataFrame:
    """One row per distinct content that had to be classified: the calls and what they gave.

    Blocked messages get their fallback record here (C4), so that everything downstream sees
    a reply or an error.
    """
    looked_up = with_cached(tasks, cache, key, gist, use_cache and not dry_run)
    misses = one_per_content(looked_up.where(F.col("cached").isNull()).drop("cached"))
    rows = call(misses, classify, texts, contents, partitions, attempts, delay)
    fallback = (F.col("outcome") == "blocked") & (F.col("type") == "email") & F.lit(gist)
    return rows.withColumns(
        {
            "reply": F.when(fallback, blocked_gist("sender", "subject")).otherwise(F.col("reply")),
            "call_error": F.when(~fallback & (F.col("outcome") != "ok"), F.coalesce("call_error", "outcome")),
        }
    )


def new_cache_rows(outcomes: DataFrame, key: str, gist: bool, as_of: Column) -> DataFrame:
    """Cache rows to upsert: replies as they came, and in gist mode failures as error records."""
    failure = failure_gist("sender", "label", "subject", "message_id", F.coalesce("call_error", F.lit(NO_RESPONSE)))
    stored = F.when(F.col("reply").isNotNull(), F.col("reply"))
    if gist:
        stored = F.coalesce(stored, failure)
    rows = outcomes.select(
        "content_hash",
        F.lit(key).alias("model_name"),
        stored.alias("extracted_json"),
        as_of.cast("timestamp").alias("created_at"),
        "message_id",
    ).where(F.col("extracted_json").isNotNull())
    return schemas.align(rows, schemas.EXTRACTIONS)


def task_results(
    tasks: DataFrame, cache: DataFrame, outcomes: DataFrame, key: str, gist: bool, use_cache: bool = True
) -> DataFrame:
    """Every task with its description or error; copies share one outcome.

    Tasks without content (C6) have neither and end as 'no response'.
    """
    looked_up = with_cached(tasks, cache, key, gist, use_cache)
    answers = outcomes.select("content_hash", "reply", "call_error")
    joined = lookup_join(looked_up, answers, ["content_hash"], "left", "task_id", counted=tasks)
    description = F.coalesce("cached", "reply")
    return joined.withColumns(
        {
            "description": description,
            "error": F.when(description.isNull(), F.coalesce("call_error", F.lit(NO_RESPONSE))),
            "from_cache": F.col("cached").isNotNull(),
        }
    ).drop("cached", "reply", "call_error")


def is_error(description: str, gist: bool) -> Column:
    """Failed, empty, unparsable, or a record that carries an error (A3)."""
    text = filled(description)
    if not gist:
        return text.isNull()
    faulty = let(parse_gist(description), lambda p: ~p["valid"] | filled(p["gist"]["error"]).isNotNull())
    return text.isNull() | faulty


def error_tally(results: DataFrame, gist: bool) -> DataFrame:
    bad = F.coalesce(is_error("description", gist), F.lit(True))
    return results.agg(F.count(F.lit(1)).alias("tasks"), F.count_if(bad).alias("errors"))
