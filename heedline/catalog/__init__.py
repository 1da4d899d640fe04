"""The registered queries: each runs a library operator over the driver's tables, next to the
SQL that states the expected result independently."""

from heedline.catalog import (  # noqa: F401 - importing registers the queries
    analysis,
    expressions,
    jobs,
    linking,
    nested,
    selection,
)
from heedline.catalog.registry import REGISTRY, queries, oracle_sql

__all__ = ["REGISTRY", "queries", "oracle_sql"]
