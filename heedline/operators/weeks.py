"""Rows by week."""

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heedline.functions import dates


def compute_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a dear expression as a column that later filters cannot copy.

    A filter on a plain projected column is pushed below it, with the whole expression repeated
    per use.  A generator's output stays where it is: one evaluation per row.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_week(df: DataFrame, wall: Column | str, as_of: Column | str | dt.date) -> DataFrame:
    indexed = df.withColumn("week_idx", dates.week_index(wall, as_of))
    return indexed.withColumn("week_label", dates.week_label("week_idx"))


def recent_weeks(df: DataFrame, weeks: int | None) -> DataFrame:
    """Keep ``week_idx < weeks``: upcoming rows stay, undated ones go."""
    return df if weeks is None else df.where(F.col("week_idx") < weeks)


def week_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("week_idx", "week_label").agg(F.count(F.lit(1)).alias("rows"))


def oldest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("week_idx"), F.desc("week_label"))
