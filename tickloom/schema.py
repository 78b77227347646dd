"""Schemas of bars and side series, their aliases and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.util import DAY, MINUTE

KEYS = ["symbol", "timeframe", "source"]
_D = T.DoubleType()
BAR_SCHEMA = T.StructType(
    [T.StructField(k, T.StringType(), False) for k in KEYS]
    + [T.StructField("ts", T.TimestampType(), False)]
    + [T.StructField(c, _D) for c in ("open", "high", "low", "close", "volume")]
    + [T.StructField("is_closed", T.BooleanType())]
)
#: Required fields of each side source, then the optional ones. Fixed values.
SOURCES = {
    "ohlcv": (("open", "high", "low", "close", "volume"), ("is_closed",)),
    "trades": (("volume", "count", "buy_volume", "sell_volume", "large_count", "whale_count", "avg_price", "vwap"), ("max_amount", "min_price", "price", "amount", "side")),
    "orderbook": (("best_bid", "best_ask", "spread", "spread_bps", "mid_price", "bid_depth", "ask_depth", "imbalance", "pressure"), ("large_liquidity",)),
    "liquidation": (("count", "volume", "value", "long_count", "short_count", "long_value", "short_value", "large_count", "large_value"), ()),
}
#: Names a field may have where it comes in. Fixed values.
ALIASES = {
    "ts": ("ts", "timestamp"),
    "open": ("open", "open_price", "o"),
    "high": ("high", "high_price", "h"),
    "low": ("low", "low_price", "l"),
    "close": ("close", "close_price", "c"),
    "volume": ("volume", "volume_qty", "v"),
    "is_closed": ("is_closed", "closed", "x"),
}
FIELD_ALIASES = {"o": "open", "h": "high", "l": "low", "c": "close", "v": "volume", "price": "close"}
DERIVED = ("hlc3", "typical_price", "ohlc4", "weighted_close", "hl2", "median_price", "range", "upper_wick", "lower_wick", "body_size", "total_range")


def derived(name: str) -> Column:
    """A projection of the bar's own fields."""
    o, h, lw, c = (F.col(x) for x in ("open", "high", "low", "close"))
    body_top = F.when(o.isNotNull() & c.isNotNull(), F.greatest(o, c))
    body_bottom = F.when(o.isNotNull() & c.isNotNull(), F.least(o, c))
    return {
        "hlc3": (h + lw + c) / F.lit(3.0),
        "typical_price": (h + lw + c) / F.lit(3.0),
        "ohlc4": (o + h + lw + c) / F.lit(4.0),
        "weighted_close": (o + h + lw + c) / F.lit(4.0),
        "hl2": (h + lw) / F.lit(2.0),
        "median_price": (h + lw) / F.lit(2.0),
        "range": h - lw,
        "total_range": h - lw,
        "upper_wick": h - body_top,
        "lower_wick": body_bottom - lw,
        "body_size": F.abs(c - o),
    }[name]


def field(name: str, columns: list[str]) -> Column:
    """A stored or derived field; an unknown name is an error."""
    if name in columns:
        return F.col(name)
    if FIELD_ALIASES.get(name) in columns:
        return F.col(FIELD_ALIASES[name])
    if name in DERIVED:
        return derived(name)
    raise ValueError(f"unknown field {name!r}; there are {', '.join(columns)}")


def rename_aliases(df: DataFrame) -> DataFrame:
    have = {c.lower(): c for c in df.columns}
    renames = {have[a]: name for name, names in ALIASES.items() if name not in df.columns for a in names[1:] if a in have}
    return df.withColumnsRenamed(renames)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is no value in this engine: null is."""
    fixes = {f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(fixes) if fixes else df


def bar_is_valid() -> Column:
    """High above all, low below all, no negative volume; null where a field is missing."""
    h, lw, o, c = (F.col(x) for x in ("high", "low", "open", "close"))
    return (h >= lw) & (h >= F.greatest(o, c)) & (lw <= F.least(o, c)) & (F.col("volume") >= 0)


def timeframe_minutes(tf: str) -> int:
    """Minutes of ``15m 1h 1d 1w``."""
    unit = {"m": 1, "h": 60, "d": DAY // MINUTE, "w": 7 * DAY // MINUTE}.get(tf[-1:])
    if unit is None or not tf[:-1].isdigit() or int(tf[:-1]) < 1:
        raise ValueError(f"no timeframe: {tf!r}")
    return int(tf[:-1]) * unit


def to_instant(raw: Column) -> Column:
    """A timestamp from text or a number; the unit of a number follows from its size."""
    n = raw.cast("string").try_cast("decimal(28,9)")  # no digit is lost, as in a double
    size = F.abs(n)
    micros = F.when(size < 1e10, n * 1_000_000).when(size < 1e13, n * 1000).when(size < 1e16, n).otherwise(F.call_function("div", n, F.lit(1000)))
    return F.when(n.isNotNull(), F.timestamp_micros(micros.cast("long"))).otherwise(raw.cast("string").try_cast("timestamp"))
