"""Bars and side series from records, and points back to records."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.bars import BarSet
from tickloom.schema import ALIASES, BAR_SCHEMA, KEYS, SOURCES


def instant(v: Any) -> dt.datetime:
    """UTC instant of a datetime, date, number (unit by size) or ISO text."""
    if isinstance(v, dt.datetime):
        return v.astimezone(dt.timezone.utc) if v.tzinfo else v.replace(tzinfo=dt.timezone.utc)
    if isinstance(v, dt.date):
        return dt.datetime(v.year, v.month, v.day, tzinfo=dt.timezone.utc)
    if isinstance(v, str):
        try:
            v = float(v)
        except ValueError:
            return instant(dt.datetime.fromisoformat(v.strip().replace("Z", "+00:00")))
    n = abs(v)
    return dt.datetime.fromtimestamp(float(v) / (1 if n < 1e10 else 1e3 if n < 1e13 else 1e6 if n < 1e16 else 1e9), dt.timezone.utc)


def _number(v: Any) -> float | None:
    return None if v is None or v == "" or float(v) != float(v) else float(v)


def _pick(row: dict[str, Any], name: str, default: Any = None) -> Any:
    return next((row[a] for a in ALIASES.get(name, (name,)) if a in row), default)


def from_bars(spark: SparkSession, rows: Iterable[dict[str, Any]], symbol: str, timeframe: str, source: str = "ohlcv") -> DataFrame:
    """Bars from dictionaries, under any name of their fields; volume is 0 and the bar closed where they are not given."""
    out = []
    for i, r in enumerate(rows):
        ts = _pick(r, "ts")
        if ts is None:
            raise ValueError(f"row {i}: no time")
        prices = [_number(_pick(r, c)) for c in ("open", "high", "low", "close")]
        out.append((symbol, timeframe, source, instant(ts), *prices, _number(_pick(r, "volume", 0.0)), bool(_pick(r, "is_closed", True))))
    return spark.createDataFrame(out, BAR_SCHEMA)


def side_series(spark: SparkSession, name: str, rows: Iterable[dict[str, Any]], symbol: str, timeframe: str) -> DataFrame:
    """A side series; each required field must be there."""
    required, optional = SOURCES[name]
    schema = T.StructType([*BAR_SCHEMA.fields[:4], *[T.StructField(f, T.DoubleType()) for f in (*required, *optional) if f != "side"]])
    out = []
    for i, r in enumerate(rows):
        missing = [f for f in required if f not in r]
        if missing:
            raise ValueError(f"{name} row {i}: no {', '.join(missing)}")
        out.append((symbol, timeframe, name, instant(_pick(r, "ts")), *[_number(r.get(f)) for f in (*required, *optional) if f != "side"]))
    return spark.createDataFrame(out, schema)


def multisource(spark: SparkSession, symbol: str, timeframe: str, bars: Iterable[dict], **series: Iterable[dict]) -> BarSet:
    """Bars and side series of one symbol."""
    return BarSet(from_bars(spark, bars, symbol, timeframe), **{k: side_series(spark, k, v, symbol, timeframe) for k, v in series.items()})


def points(df: DataFrame, value: str) -> DataFrame:
    """One JSON text per key and row with a value: ``{"time": ..., "value": ...}``."""
    point = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), F.col(value).alias("value")))
    return df.where(F.col(value).isNotNull()).select(*KEYS, "ts", point.alias("point"))


def to_json(df: DataFrame) -> DataFrame:
    """One JSON text per row, that ``from_json`` reads back."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def from_json(df: DataFrame, schema: T.StructType = BAR_SCHEMA) -> DataFrame:
    return df.select(F.from_json("json", schema).alias("r")).select("r.*")


def schema_json(df: DataFrame) -> str:
    return json.dumps(json.loads(df.schema.json()), sort_keys=True)
