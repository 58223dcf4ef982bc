"""Numeric columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ..graph import dense_index


@pandas_udf(DoubleType())
def to_half(x: pd.Series) -> pd.Series:
    """Rounded to half precision."""
    return x.astype("float16").astype("float64")


def degree_bucket(d: Column) -> Column:
    """0, 1, 2-3, 4-7, ... numbered from 0."""
    return F.when(d <= 0, 0).otherwise(F.floor(F.log2(d)) + 1).cast("int")


def normalized(df: DataFrame, col: str, out: str) -> DataFrame:
    """(v - min) / max(max - min, 1e-6); the extremes are one broadcast row."""
    ends = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    return df.crossJoin(F.broadcast(ends)).withColumn(out, (F.col(col) - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-6))).drop("_lo", "_hi")


def nearest_rank(df: DataFrame, col: str, *qs: float) -> DataFrame:
    """value, q: the value at place floor((n - 1) q) of the finite values in order, for each q; sorted by ranges, not in one task."""
    finite = df.filter(~F.isnan(col) & F.col(col).isNotNull() & (F.abs(col) != float("inf")))
    ranked = dense_index(finite.select(F.col(col).alias("value")), "value")
    size = ranked.agg(F.count("*").alias("n"))
    wanted = size.select("n", F.explode(F.array(*map(F.lit, qs))).alias("q")).select("q", F.floor((F.col("n") - 1) * F.col("q")).alias("idx"))
    return ranked.join(F.broadcast(wanted), "idx").select("value", "q")  # one row for each q
