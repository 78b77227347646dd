"""Bars and single series in CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.schema import KEYS, nan_to_null, rename_aliases, to_instant

TRUE = ("true", "1", "yes", "y", "t")
PRICES = ("open", "high", "low", "close", "volume")


def _number(c: str) -> Column:
    """A number, null for an empty field; anything else is an error."""
    return F.when(F.trim(c) != "", F.trim(c).cast("double"))


def read_csv(spark: SparkSession, path: str, symbol: str, timeframe: str, source: str = "ohlcv", **columns: str) -> DataFrame:
    """Bars where all five price columns are there, else a series of ``value``.

    ``columns`` names the file's columns (``open="o"``). The header decides the shape; values are
    checked as the rows are read, and a bad one fails the read.
    """
    df = spark.read.csv(path, header=True, inferSchema=False, mode="FAILFAST")
    df = rename_aliases(df.withColumnsRenamed({v: k for k, v in columns.items()}))
    if "ts" not in df.columns:
        raise ValueError(f"no time column in {path}")
    fixed = [F.lit(v).alias(k) for k, v in zip(KEYS, (symbol, timeframe, source))]
    raw = F.trim("ts")
    ts = F.when(to_instant(raw).isNotNull(), to_instant(raw)).otherwise(F.raise_error(F.concat(F.lit("no time: "), F.coalesce(raw, F.lit("null")))).cast("timestamp"))
    if all(c in df.columns for c in PRICES):
        closed = F.lower(F.trim("is_closed")).isin(*TRUE) if "is_closed" in df.columns else F.lit(True)
        return nan_to_null(df.select(*fixed, ts.alias("ts"), *[_number(c).alias(c) for c in PRICES], closed.alias("is_closed")))
    if "value" not in df.columns:
        raise ValueError(f"{path} has neither {', '.join(PRICES)} nor value")
    return nan_to_null(df.select(*fixed, ts.alias("ts"), _number("value").alias("value")))


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """A folder of CSV files with ISO times."""
    out = df.withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    out.write.mode(mode).option("header", True).csv(path)
