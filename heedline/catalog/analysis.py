"""Cached classification: C1-C11, with a deterministic rule in place of a model."""

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heedline import rules
from heedline.catalog.nested import FILES_SQL, document_files
from heedline.catalog.registry import query
from heedline.catalog.rules import blocked_sql, failure_sql, reply_sql
from heedline.catalog.selection import NOT_SENT_SQL, unique_cache
from heedline.catalog.views import AS_OF, AS_OF_TIME, Views
from heedline.functions import gist
from heedline.operators import inference, pending
from heedline.plans import analyze
from heedline.rules import by_hash
from heedline.sources import landing

cloudpickle.register_pickle_by_value(rules)

KEY = "lite:gist:v3"
_QUICK = {"attempts": 1, "delay": 0.0}

# Received messages with a body, their usable cached text for KEY, and what the rule says.
_TASKS_SQL = f""", stored AS (SELECT * FROM cache QUALIFY row_number() OVER
  (PARTITION BY content_hash, model_name ORDER BY created_seconds DESC) = 1),
tasks AS (SELECT m.id, m.body_hash, m.from_addr, m.source, m.subject, m.date, m.internal_date, length(m.canonical) AS n,
  case when json_extract_string(s.extracted_json,'$.error') is null then s.extracted_json end AS cached
  FROM msgs m LEFT JOIN stored s ON s.content_hash = m.body_hash AND s.model_name = '{KEY}'
  WHERE m.body <> '' AND {NOT_SENT_SQL}),
-- the newest copy of each content speaks for all of them
spoken AS (SELECT *, row_number() OVER (PARTITION BY body_hash ORDER BY coalesce(internal_date,0) DESC, id) AS copy FROM tasks),
answers AS (SELECT body_hash, id AS message_id, coalesce(nullif(subject,''), id) AS label, subject, source, n,
  case left(body_hash,1) when '0' then {blocked_sql("source", "coalesce(nullif(subject,''), id)")}
    when '1' then null else {reply_sql("body_hash", "n")} end AS reply,
  case when left(body_hash,1) = '1' then 'refused ' || left(body_hash,8) end AS error FROM spoken WHERE copy = 1)
"""


def _tasks(v: Views) -> DataFrame:
    return pending.email_tasks(v.messages)


def _outcomes(v: Views, **kw) -> DataFrame:
    texts = pending.message_texts(v.messages)
    return inference.call_outcomes(_tasks(v), unique_cache(v), by_hash, KEY, texts=texts, **{**_QUICK, **kw})


@query(
    "c1_cached_inference",
    _TASKS_SQL
    + """SELECT t.id AS task_id, coalesce(t.cached, a.reply) AS description, case when t.cached is null then a.error end AS error,
  t.cached IS NOT NULL AS from_cache FROM tasks t JOIN answers a ON a.body_hash = t.body_hash""",
)
def cached_inference(v: Views) -> DataFrame:
    options = analyze.Options(model="lite", **_QUICK)
    texts = pending.message_texts(v.messages)
    done = analyze.run_tasks(_tasks(v), unique_cache(v), by_hash, AS_OF_TIME, options, texts)
    return done.results.select("task_id", "description", "error", "from_cache")


@query(
    "c1_new_cache_rows",
    _TASKS_SQL
    + f"""SELECT body_hash AS content_hash, '{KEY}' AS model_name, message_id,
  coalesce(reply, {failure_sql("source", "label", "error")}) AS extracted_json
FROM answers WHERE body_hash IN (SELECT body_hash FROM tasks WHERE cached IS NULL)""",
)
def new_cache_rows(v: Views) -> DataFrame:
    rows = inference.new_cache_rows(_outcomes(v), KEY, True, F.lit(AS_OF_TIME))
    return rows.select("content_hash", "model_name", "message_id", "extracted_json")


@query("c2_usable_cached", _TASKS_SQL + "SELECT id AS task_id, cached FROM tasks")
def usable_cached(v: Views) -> DataFrame:
    return inference.with_cached(_tasks(v), unique_cache(v), KEY, gist=True).select("task_id", "cached")


@query(
    "c3_bounded_attempts",
    _TASKS_SQL
    + """SELECT DISTINCT body_hash AS content_hash, case when right(body_hash,1) <= '7' then 'failed' when left(body_hash,1) = '0' then 'blocked'
  when left(body_hash,1) = '1' then 'failed' else 'ok' end AS outcome, case when right(body_hash,1) <= '7' then 'not yet'
  when left(body_hash,1) in ('0','1') then 'refused ' || left(body_hash,8) end AS call_error FROM tasks""",
)
def bounded_attempts(v: Views) -> DataFrame:
    misses = inference.one_per_content(_tasks(v))

    def never_ready(batch):
        """Rows with a low last digit fail on every try, the others as the rule says."""
        out = by_hash(batch)
        late = batch["content_hash"].str[-1].isin(list("01234567"))
        out.loc[late, "status"], out.loc[late, "text"], out.loc[late, "error"] = "failed", None, "not yet"
        return out

    rows = inference.call(misses, never_ready, attempts=3, delay=0.0)
    return rows.select("content_hash", "outcome", "call_error")


@query(
    "c4_blocked_fallback",
    _TASKS_SQL + "SELECT body_hash AS content_hash, reply FROM answers WHERE left(body_hash,1) = '0' AND body_hash IN (SELECT body_hash FROM tasks WHERE cached IS NULL)",
)
def blocked_fallback(v: Views) -> DataFrame:
    return _outcomes(v).where(F.col("outcome") == "blocked").select("content_hash", "reply")


@query(
    "c5_failure_records",
    f"SELECT id, {failure_sql('source', chr(39) + 'label ' + chr(39) + ' || subject', chr(39) + 'bad ' + chr(39) + ' || subject')} AS record FROM msgs",
)
def failure_records(v: Views) -> DataFrame:
    label = F.concat(F.lit("label "), "subject")
    error = F.concat(F.lit("bad "), "subject")
    return v.messages.select("id", gist.failure_gist("from_addr", label, "subject", "id", error).alias("record"))


@query("c6_empty_messages", "SELECT id AS task_id, 'no response' AS error FROM msgs WHERE doc_id % 15 = 0")
def empty_messages(v: Views) -> DataFrame:
    """Tasks whose text is empty get no call and no cache row."""
    empty = F.lit(None).cast("string")
    blank = _tasks(v).where(F.lit(False)).unionByName(
        v.messages.where(F.col("id").cast("long") % 15 == 0).select(
            F.lit("email").alias("type"), F.col("id").alias("task_id"), empty.alias("content_hash")
        ),
        allowMissingColumns=True,
    )
    outcomes = inference.call_outcomes(blank, unique_cache(v), by_hash, KEY, **_QUICK)
    return inference.task_results(blank, unique_cache(v), outcomes, KEY, True).select("task_id", "error")


@query(
    "c7_document_inference",
    FILES_SQL
    + """, hashed AS (SELECT sha256(content) AS h, strlen(content) AS n FROM files)
SELECT h AS content_hash, case when left(h,1) in ('0','1') then 'refused ' || left(h,8) end AS error,
  case when left(h,1) not in ('0','1') then n || ' characters' end AS clue FROM hashed""",
)
def document_inference(v: Views) -> DataFrame:
    """Document files by the hash of their bytes, which the rule counts; blocked is a failure here."""
    folder = document_files(v)
    files, contents = landing.documents(v.spark, folder), landing.document_contents(v.spark, folder)
    done = analyze.describe_paths(files, unique_cache(v), by_hash, AS_OF, model="lite", contents=contents, **_QUICK)
    return done.results.select("content_hash", "error", F.get_json_object("description", "$.clue").alias("clue"))


@query(
    "c8_task_outcomes",
    _TASKS_SQL
    + """SELECT t.id AS task_id, coalesce(nullif(t.subject,''), t.id) AS label, coalesce(t.cached, a.reply) IS NULL AS failed
FROM tasks t JOIN answers a ON a.body_hash = t.body_hash""",
)
def task_outcomes(v: Views) -> DataFrame:
    results = inference.task_results(_tasks(v), unique_cache(v), _outcomes(v), KEY, True)
    return results.select("task_id", "label", F.col("description").isNull().alias("failed"))


@query(
    "c9_error_count",
    _TASKS_SQL
    + """SELECT count(*) AS tasks, count(*) FILTER (t.cached IS NULL AND left(t.body_hash,1) = '1') AS errors FROM tasks t""",
)
def error_count(v: Views) -> DataFrame:
    results = inference.task_results(_tasks(v), unique_cache(v), _outcomes(v, partitions=4), KEY, True)
    return inference.error_tally(results, gist=True)


@query(
    "c10_dry_run",
    _TASKS_SQL
    + "SELECT t.id AS task_id, a.reply AS description, false AS from_cache, 0 AS cache_rows FROM tasks t JOIN answers a ON a.body_hash = t.body_hash",
)
def dry_run(v: Views) -> DataFrame:
    options = analyze.Options(model="lite", dry_run=True, **_QUICK)
    done = analyze.analyze(v.messages, v.attachments, unique_cache(v), by_hash, AS_OF_TIME, options)
    rows = done.cache_rows.agg(F.count(F.lit(1)).cast("int")).scalar()
    return done.results.select("task_id", "description", "from_cache", rows.alias("cache_rows"))


@query(
    "c11_force",
    _TASKS_SQL + "SELECT t.id AS task_id, a.reply AS description, false AS from_cache FROM tasks t JOIN answers a ON a.body_hash = t.body_hash",
)
def force(v: Views) -> DataFrame:
    return _forced(v, compat=False)


@query(
    "c11_force_compat",
    _TASKS_SQL
    + "SELECT t.id AS task_id, coalesce(t.cached, a.reply) AS description, t.cached IS NOT NULL AS from_cache FROM tasks t JOIN answers a ON a.body_hash = t.body_hash",
)
def force_compat(v: Views) -> DataFrame:
    return _forced(v, compat=True)


def _forced(v: Views, compat: bool) -> DataFrame:
    options = analyze.Options(model="lite", force=True, compat=compat, **_QUICK)
    done = analyze.analyze(v.messages, v.attachments, unique_cache(v), by_hash, AS_OF_TIME, options)
    return done.results.select("task_id", "description", "from_cache")
