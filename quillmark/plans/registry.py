"""Queries with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *tables: str) -> Callable[[Query], Query]:
    """Registers a query under its function's name; tables are common table expressions that its SQL builds on."""

    def add(f: Query) -> Query:
        @wraps(f)
        def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
            """Whole numbers as longs, as the SQL has them."""
            out = f(spark, sf_dir)
            return out.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in out.dtypes])

        QUERIES[f.__name__] = wide
        if sql is not None:
            ORACLES[f.__name__] = (f"WITH {', '.join(tables)}\n" if tables else "") + sql.strip()
        return f

    return add
