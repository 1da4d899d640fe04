"""Keyed tables without MERGE: newest row per key, replace-by-key, first row kept
(SURVEY S2, S3, S5, S6, S12)."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heedline.operators.joins import BROADCAST_KEYS
from heedline.session import durable


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[Column], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    # Rows that tie in the order differ in their digest, or are equal.
    row = pick(F.struct(*rest), F.struct(*order, F.xxhash64(*rest))).alias("__row")
    chosen = df.groupBy(*keys).agg(row)
    return chosen.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])


def newest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row with the greatest ``order`` of each key.

    An aggregate, not a row_number window: each task first reduces its own rows to one per
    key, so a key that was written a billion times reaches its reducer as one row per task.
    """
    return _pick(df, keys, order, F.max_by)


def newest_of_stored(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """As ``newest_per_key``, for rows that are stored and so may be read several times.

    Keys are counted apart from their rows.  A row whose key comes once is passed on where it is
    read; only the others are sorted and moved.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    repeated = durable(counted.where("__n > 1").select(*keys), "repeated-keys")
    n = repeated.count()
    if not n:
        return df
    listed = repeated.withColumnsRenamed({k: f"__{k}" for k in keys})
    listed = F.broadcast(listed) if n <= BROADCAST_KEYS else listed.hint("merge")
    # A missing key is a key.
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    several = newest_per_key(df.join(listed, same, "left_semi"), keys, order)
    return df.join(listed, same, "left_anti").unionByName(several)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return _pick(df, keys, order, F.min_by)


def replace_by_key(
    stored: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column]
) -> DataFrame:
    """``stored`` with ``incoming`` written over it; the last incoming write of a key wins.

    ``stored`` is unique on the key already, so only the keys of the (small) increment are
    matched against it: an anti join, which broadcasts the increment's keys when they are few
    and shuffles otherwise.  Stored rows are not aggregated or sorted.
    """
    fresh = newest_per_key(incoming, keys, order)
    kept = stored.join(incoming.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)
