"""Named queries over the driver's tables and the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.ordered import SAMPLES_CONF, SLICE_ROWS_CONF

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


def also_sliced(name: str, rows: int = 24, samples: int = 4) -> None:
    """Register a query again with every recording of more than ``rows`` rows cut into slices; the SQL stays the same."""
    plain = QUERIES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        before = {k: spark.conf.get(k, None) for k in (SLICE_ROWS_CONF, SAMPLES_CONF)}
        spark.conf.set(SLICE_ROWS_CONF, str(rows))
        spark.conf.set(SAMPLES_CONF, str(samples))
        try:
            return plain(spark, sf_dir)  # slices are decided while the plan is built
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)

    query(f"{name}_sliced", ORACLES[name])(run)
