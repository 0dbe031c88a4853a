"""The table of queries: name -> (DataFrame builder, checker SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bindings

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Callable], Builder]:
    """Register ``fn(get, spark)``; ``get(name)`` loads a table or view of the input folder."""

    def wrap(fn: Callable) -> Builder:
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda n: bindings.load(spark, sf_dir, n), spark)

        build.__name__ = name
        build.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = build
        if oracle:
            ORACLES[name] = bindings.sql(oracle)
        return build

    return wrap


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Round columns that come from long floating sums; the rest stays exact."""
    def value(c: str) -> Column:
        return F.round(F.col(c), digits).alias(c)

    return df.select(*[value(c) if c in cols else F.col(c) for c in df.columns])
