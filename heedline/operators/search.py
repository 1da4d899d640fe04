"""Recent lists, search and prefix lookup."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heedline.functions import text
from heedline.operators.joins import lookup_join
from heedline.operators.pending import newest_first

# Characters of a pattern's literal that it is filed under.
GRAM = 3


def newest(messages: DataFrame, limit: int | None) -> DataFrame:
    """Top-k newest; no limit (or 0) gives all, in order (L1, L2)."""
    ordered = messages.orderBy(*newest_first())
    return ordered.limit(limit) if limit else ordered


def matching(messages: DataFrame, term: str) -> DataFrame:
    """Messages whose sender or subject contains the term."""
    return messages.where(text.like_contains("from_addr", term) | text.like_contains("subject", term))


def newest_match(messages: DataFrame, term: str) -> DataFrame:
    """The one match with the greatest raw date text (P5)."""
    columns = ["id", "thread_id", "subject", "from_addr", "date"]
    return matching(messages, term).orderBy(F.desc("date"), F.asc("id")).limit(1).select(*columns)


def list_rows(messages: DataFrame, from_chars: int = 35, subject_chars: int = 40) -> DataFrame:
    """Display columns of a recent list."""
    return messages.select(
        text.left("id", 8).alias("short"),
        text.left(text.or_empty("date"), 16).alias("date"),
        text.clip("from_addr", from_chars).alias("from_short"),
        text.clip("subject", subject_chars).alias("subject_short"),
    )


def latest_downloads(atts: DataFrame, limit: int | None) -> DataFrame:
    """Newest downloads first (L3)."""
    order = [F.desc("downloaded_at"), F.asc("message_id"), F.asc("filename")]
    ordered = atts.orderBy(*order)
    return ordered.limit(limit) if limit else ordered


def lookup_by_prefix(requests: DataFrame, messages: DataFrame) -> DataFrame:
    """For each request (column ``key``): the newest message with that id or id prefix.

    LIKE semantics.  A key without wildcards is its own head: each message offers its heads of
    the lengths that some key has, and the newest per head is taken before the join, which so
    gets one row per head.  Keys with wildcards are filed, see ``_patterns``.
    """
    keys = requests.select("key").where(text.filled("key").isNotNull()).distinct()
    keys = keys.withColumn("head", text.ascii_lower(F.regexp_extract("key", "(?s)^[^%_]*", 0)))
    keys = keys.withColumn("n", F.length("head"))
    plain = keys.where(F.length("key") == F.col("n"))

    narrow = messages.select("id", F.coalesce("internal_date", F.lit(0)).alias("at"))
    newest = F.min(F.struct((-F.col("at")).alias("age"), "id")).alias("best")
    first = _heads(plain, narrow).groupBy("head", "n").agg(newest)
    found = plain.join(first, ["head", "n"]).select("key", "best")
    whole = found.unionByName(_patterns(keys.where(F.length("key") > F.col("n")), narrow, newest))
    return whole.select("key", F.col("best.id").alias("id"))


def _heads(keys: DataFrame, narrow: DataFrame) -> DataFrame:
    """Each message with its heads of the lengths of ``keys``; these are no more than the longest id has characters."""
    lengths = keys.agg(F.collect_set("n")).scalar()
    offered = narrow.select("id", "at", F.explode(lengths).alias("n")).where(F.length("id") >= F.col("n"))
    return offered.withColumn("head", text.ascii_lower(F.substring("id", F.lit(1), F.col("n"))))


def _patterns(patterns: DataFrame, narrow: DataFrame, newest: Column) -> DataFrame:
    """(key, best) of keys with wildcards.

    A pattern is filed under its head, if that has GRAM characters, or else under the first
    GRAM characters (or as many as there are) of its longest literal.  Messages offer their heads
    and grams, only those that are asked for, and are tested against the patterns they meet there.
    A pattern of wildcards alone says no more than how long an id must be: it takes the newest of
    the ids that are long enough, from one row for each length.
    """
    literals = F.filter(F.split(text.ascii_lower(F.col("key")), "[%_]"), lambda part: part != "")
    longest = F.try_element_at(F.sort_array(F.transform(literals, lambda part: F.struct(F.length(part).alias("n"), part.alias("part"))), asc=False), F.lit(1))
    filed = patterns.withColumn("gram", F.substring(longest["part"], 1, GRAM))
    headed, rest = filed.where(F.col("n") >= GRAM), filed.where((F.col("n") < GRAM) & F.col("gram").isNotNull())

    pairs = lookup_join(_heads(headed, narrow), headed.drop("gram"), ["head", "n"], "inner", "id")
    by_head = pairs.where(text.like_prefix("id", F.col("key"))).groupBy("key").agg(newest)

    # Every id's grams of the lengths that are asked for; those that no pattern is filed under go at once.
    asked = rest.select("gram").distinct()
    sizes = asked.agg(F.collect_set(F.length("gram"))).scalar()
    low = text.ascii_lower(F.col("id"))
    starts = F.sequence(F.lit(1), F.greatest(F.length("id"), F.lit(1)))
    grams = F.array_distinct(F.flatten(F.transform("sizes", lambda n: F.transform(starts, lambda i: F.substring(low, i, n)))))
    offered = narrow.withColumn("sizes", sizes).select("id", "at", F.explode(grams).alias("gram"))
    offered = offered.join(asked, "gram", "left_semi")
    pairs = lookup_join(offered, rest.select("key", "gram"), ["gram"], "inner", "id")
    by_gram = pairs.where(text.like_prefix("id", F.col("key"))).groupBy("key").agg(newest)

    free = filed.where(F.col("gram").isNull()).withColumn("least", F.length(F.translate("key", "%", "")))
    per_length = narrow.groupBy(F.length("id").alias("length")).agg(newest)
    lengths = per_length.agg(F.collect_list(F.struct("length", "best"))).scalar()
    long_enough = F.filter(F.col("lengths"), lambda x: x["length"] >= F.col("least"))
    best = F.array_min(F.transform(long_enough, lambda x: x["best"]))
    by_length = free.withColumn("lengths", lengths).select("key", best.alias("best")).where("best IS NOT NULL")
    return by_head.unionByName(by_gram).unionByName(by_length)


def found_messages(requests: DataFrame, messages: DataFrame) -> DataFrame:
    """Requests joined to the message their key means; unknown keys drop out."""
    hits = lookup_by_prefix(requests, messages)
    return requests.join(hits, "key").join(messages, "id")
