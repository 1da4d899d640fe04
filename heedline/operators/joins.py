"""Lookup joins that survive a hot key.

Most joins here look rows up in a table that holds one row per key, while the *left* side may
carry one key on a third of its rows: copies of one newsletter share a body hash, one sender
attaches the same file for years.  A plain shuffle join sends all of them to one task.

``lookup_join`` spreads each hot key over several tasks: its left rows get a salt taken from a
row id, its one right row is repeated per salt.  Rows with a NULL key match nothing, but an
outer or anti join still shuffles them, so they are spread as well.

There is one plan for all sizes.  What is hot follows from the number of rows: a key with at
least one HOT_SHARE-th of them, so there are at most HOT_SHARE hot keys.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot from this share of all rows on, and is split into pieces of about that size ...
HOT_SHARE = 10_000
# ... but of no fewer rows than this.
LEAST_PIECE = 100

# Keys that may go to every task: ids and hashes of some 64 bytes, so 32 MB of them.
BROADCAST_KEYS = 500_000

_SALT, _PIECES = "__salt", "__pieces"


def _counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key, combined map-side: the hot key itself costs one row per task."""
    return df.select(*keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))


def _any_null(keys: Sequence[str]) -> Column:
    test = F.lit(False)
    for k in keys:
        test = test | F.col(k).isNull()
    return test


def _piece_rows(counts: DataFrame) -> Column:
    """Rows of one piece, from the number of all rows."""
    share = counts.agg(F.coalesce(F.sum("__n"), F.lit(0)) / HOT_SHARE).scalar()
    return F.greatest(F.lit(float(LEAST_PIECE)), share)


def hot_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hot keys and the number of pieces to split them into; HOT_SHARE rows at most."""
    counts = _counts(df, keys)
    piece = _piece_rows(counts)
    hot = counts.where(~_any_null(keys) & (F.col("__n") >= piece))
    return hot.select(*keys, (F.ceil(F.col("__n") / piece).cast("int") + 1).alias(_PIECES))


def _renamed(df: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    return df.withColumnsRenamed({k: f"{prefix}{k}" for k in keys})


def _with_pieces(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach the piece count of each row's key; the hot list is bounded, hence broadcast."""
    right = F.broadcast(_renamed(hot, keys, "__hot_"))
    match = [df[k] == right[f"__hot_{k}"] for k in keys]
    return df.join(right, match, "left").drop(*[f"__hot_{k}" for k in keys])


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str,
    spread: Column | str,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Join ``left`` to ``right`` (unique on ``on``) by inner, left, left_semi or left_anti.

    ``spread`` is any left-side value that differs among the rows of one key, normally the row
    id.  ``counted`` names where to count keys when that is cheaper than ``left`` itself, such
    as the stored table ``left`` was filtered from: salting a key that is no longer hot is
    harmless.
    """
    keys = list(on)
    basis = left if counted is None else counted
    hot = hot_keys(basis, keys)
    counts = _counts(basis, keys)
    nulls = counts.agg(F.coalesce(F.sum(F.when(_any_null(keys), F.col("__n"))), F.lit(0))).scalar()
    null_pieces = F.ceil(nulls / _piece_rows(counts)) + 1
    row_hash = F.xxhash64(F.col(spread) if isinstance(spread, str) else spread)

    salt = (
        F.when(_any_null(keys), F.pmod(row_hash, null_pieces))
        .when(F.col(_PIECES).isNotNull(), F.pmod(row_hash, F.col(_PIECES)))
        .otherwise(0)
        .cast("int")
    )
    salted_left = _with_pieces(left, hot, keys).withColumn(_SALT, salt).drop(_PIECES)
    last = F.coalesce(F.col(_PIECES), F.lit(1)) - 1
    salted_right = (
        _with_pieces(right.dropna(how="any", subset=keys), hot, keys)
        .withColumn(_SALT, F.explode(F.sequence(F.lit(0), last)))
        .drop(_PIECES)
    )
    return salted_left.join(salted_right, [*keys, _SALT], how).drop(_SALT)


def without(left: DataFrame, right: DataFrame, on: Sequence[str], spread: Column | str, **kw) -> DataFrame:
    """Rows of ``left`` whose key does not occur in ``right`` (which may repeat keys)."""
    return lookup_join(left, right.select(*on).distinct(), on, "left_anti", spread, **kw)


def only_with(left: DataFrame, right: DataFrame, on: Sequence[str], spread: Column | str, **kw) -> DataFrame:
    """Rows of ``left`` whose key occurs in ``right`` (which may repeat keys)."""
    return lookup_join(left, right.select(*on).distinct(), on, "left_semi", spread, **kw)


def cut_down(rows: DataFrame, wanted: DataFrame, keys: Sequence[str], n: int | None = None) -> DataFrame:
    """Rows of ``rows`` with one of the ``wanted`` keys, which are distinct and stored (they are counted).

    Up to BROADCAST_KEYS keys go to every task, so that ``rows`` are filtered where they are read;
    more of them meet by a shuffle.
    """
    return _matched(rows, wanted, keys, n, "left_semi")


def left_out(rows: DataFrame, unwanted: DataFrame, keys: Sequence[str], n: int | None = None) -> DataFrame:
    """Rows of ``rows`` with none of the ``unwanted`` keys, by the same ways as ``cut_down``."""
    return _matched(rows, unwanted, keys, n, "left_anti")


def _matched(rows: DataFrame, listed: DataFrame, keys: Sequence[str], n: int | None, how: str) -> DataFrame:
    n = listed.count() if n is None else n
    listed = listed.select(*keys)
    return rows.join(F.broadcast(listed) if n <= BROADCAST_KEYS else listed.hint("merge"), list(keys), how)
