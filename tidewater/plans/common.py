"""What the query modules share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def millis(df: DataFrame, name: str) -> Column:
    """Milliseconds of a time column as UTC, whatever the session's time zone."""
    c = F.col(name)
    return F.unix_millis(F.concat(c.cast("string"), F.lit("Z")).cast("timestamp")) if df.schema[name].dataType.typeName() == "timestamp_ntz" else F.unix_millis(c)


class Book:
    """Queries and their SQL, as a module registers them."""

    def __init__(self):
        self.queries: dict = {}
        self.oracle: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def put(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracle[f.__name__] = sql
            return f

        return put
