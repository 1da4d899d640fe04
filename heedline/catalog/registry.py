"""Registration of catalog queries."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from heedline.catalog.views import ORACLE_VIEWS, Views
from heedline.session import configure


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Views], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``build(views)``; ``sql`` may use any view of ``views`` by name."""

    def register(build: Callable[[Views], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, build, sql)
        return build

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def runner(q: Query):
        return lambda spark, sf_dir: q.build(Views.of(configure(spark), sf_dir))

    return {name: runner(q) for name, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: ORACLE_VIEWS + q.sql for name, q in REGISTRY.items() if q.sql}
