"""Named queries: a Spark plan and, where SQL can say the same, an oracle
SQL text for DuckDB over the same Parquet tables.

Every registered plan reads the given tables (or frames Spark derives from
them), so its work grows with them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Registered:
    name: str
    fn: QueryFn
    sql: str | None
    covers: str


REGISTRY: dict[str, Registered] = {}


def register(name: str, sql: str | None = None, covers: str = ""):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query name {name}")
        REGISTRY[name] = Registered(name, fn, sql, covers)
        return fn

    return deco


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round double columns for comparison: sums of doubles differ in the
    last bits between engines that add in different orders."""
    cols = [
        F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cols)


def load_all() -> dict[str, Registered]:
    """Import every plan module so their registrations run."""
    from thresher.plans import (  # noqa: F401
        access_queries, backtest_queries, breakdown_queries, filter_queries, live_queries, live_stream_queries,
        multi_rule_queries, results_queries, rules_queries, stream_queries,
    )

    return REGISTRY
