"""Every registered query against its SQL twin in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from heedline import catalog

SF_DIR = os.environ.get("HEEDLINE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
# Queries whose order is the feature.
ORDERED = ("l1_newest_first", "l2_top_k", "l3_latest_downloads", "l4_order_in_week", "l5_week_order", "b4_list")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    return repr(round(value, 6)) if isinstance(value, float) else str(value)


def _rows(rows, columns, ordered):
    order = [columns.index(c) for c in sorted(columns)]
    cells = [tuple(_cell(row[i]) for i in order) for row in rows]
    return cells if ordered else sorted(cells)


@pytest.mark.parametrize("name", sorted(catalog.REGISTRY))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF_DIR)
    cursor = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    ordered = name in ORDERED
    assert _rows(df.collect(), df.columns, ordered) == _rows(cursor.fetchall(), columns, ordered)


def test_every_query_has_a_twin():
    assert set(catalog.oracle_sql()) == set(catalog.queries())
