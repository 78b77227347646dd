"""Bars as DataFrames: where they come from and how their time base changes.

A bar frame is one long DataFrame keyed by (symbol, timeframe, source) and ordered by
ts. All operators work on all keys at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.schema import KEYS, SOURCES, field, nan_to_null, rename_aliases, timeframe_minutes

AGGREGATES = ("first", "last", "mean", "sum", "max", "min")


def order(df: DataFrame) -> list[str]:
    """ts, then what makes equal instants fall in one order."""
    return ["ts", *[c for c in ("seq",) if c in df.columns]]


def w_keys(df: DataFrame):
    return Window.partitionBy(*KEYS).orderBy(*order(df))


def bars_from_ticks(ticks: DataFrame, symbol: str, ts: str, tie: str, price: str, timeframe: str = "1h", source: str = "ohlcv") -> DataFrame:
    """OHLCV bars on the clock from single prices; the volume is their sum, added in hundredths so that its order does not matter."""
    minutes = timeframe_minutes(timeframe)
    at = F.struct(F.col(ts), F.col(tie))
    slot = F.window(F.col(ts).cast("timestamp"), f"{minutes} minutes")["start"]
    g = ticks.where(F.col(price).isNotNull() & F.col(ts).isNotNull()).groupBy(F.col(symbol).alias("symbol"), slot.alias("ts"))
    bars = g.agg(
        F.min_by(price, at).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, at).alias("close"),
        (F.sum(F.round(F.col(price) * 100).cast("long")) / F.lit(100.0)).alias("volume"),
    )
    return bars.select("symbol", F.lit(timeframe).alias("timeframe"), F.lit(source).alias("source"), "ts", "open", "high", "low", "close", "volume", F.lit(True).alias("is_closed"))


def bars_from_events(spark: SparkSession, sf_dir: str, timeframe: str = "1h") -> DataFrame:
    """Bars per event type."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "ts", "event_id", "value")
    return bars_from_ticks(events, "event_type", "ts", "event_id", "value", timeframe)


def trades_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as single trades per return flag."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return li.select(F.col("l_returnflag").alias("symbol"), F.lit("1d").alias("timeframe"), F.lit("trades").alias("source"), F.col("l_shipdate").cast("timestamp").alias("ts"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_quantity").alias("amount"), F.col("l_extendedprice").alias("price"))


def as_bars(df: DataFrame) -> DataFrame:
    """Any frame with bar fields under one of their names, in this engine's form."""
    df = nan_to_null(rename_aliases(df))
    defaults = {"timeframe": F.lit("1h"), "source": F.lit("ohlcv"), "volume": F.lit(0.0), "is_closed": F.lit(True)}
    return df.withColumns({k: v for k, v in defaults.items() if k not in df.columns})


class BarSet:
    """A bar frame with its side series."""

    def __init__(self, bars: DataFrame, **series: DataFrame):
        unknown = set(series) - set(SOURCES)
        if unknown:
            raise ValueError(f"unknown sources: {', '.join(sorted(unknown))}")
        self.bars, self.series = bars, series

    def where(self, symbol: str | None = None, timeframe: str | None = None, source: str | None = None) -> BarSet:
        """The part with these key values; the filters reach the scan."""
        on = [(k, v) for k, v in (("symbol", symbol), ("timeframe", timeframe), ("source", source)) if v is not None]
        pick = lambda df, by: reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), by, df)
        return BarSet(pick(self.bars, on), **{k: pick(v, [x for x in on if x[0] != "source"]) for k, v in self.series.items()})

    def wide(self) -> DataFrame:
        """Bars with each side field as ``source_field``."""
        out = self.bars
        for name, df in self.series.items():
            fields = [c for c in df.columns if c not in (*KEYS, "ts", "seq")]
            out = out.join(df.select("symbol", "timeframe", "ts", *[F.col(c).alias(f"{name}_{c}") for c in fields]), ["symbol", "timeframe", "ts"], "left")
        return out

    def info(self) -> DataFrame:
        """Rows and span of each key."""
        return self.bars.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def append(df: DataFrame, new: DataFrame, check: bool = False) -> DataFrame:
    """Both, by name. With ``check``, ``new`` is looked through first, and a ValueError says why it may not be appended."""
    if check and (wrong := append_problems(df, new).limit(5).collect()):
        raise ValueError("; ".join(f"{'|'.join(str(r[k]) for k in KEYS)}: {r.n} rows {r.problem}" for r in wrong))
    return df.unionByName(new, allowMissingColumns=True)


def append_problems(df: DataFrame, new: DataFrame) -> DataFrame:
    """Why ``new`` may not be appended: (keys, problem, n) for empty keys and rows before the last stored one."""
    last = df.groupBy(*KEYS).agg(F.max("ts").alias("last_ts"))
    empty = reduce(lambda a, b: a | b, [F.coalesce(F.col(k), F.lit("")) == "" for k in KEYS])
    problem = F.when(empty, "empty key").when(F.col("ts").isNull(), "no time").when(F.col("ts") < F.col("last_ts"), "before the last row")
    return new.join(last, KEYS, "left").withColumn("problem", problem).where("problem is not null").groupBy(*KEYS, "problem").agg(F.count(F.lit(1)).alias("n"))


def trim(df: DataFrame, n: int) -> DataFrame:
    """Without each key's first ``n`` bars."""
    return df.withColumn("__rn", F.row_number().over(w_keys(df))).where(F.col("__rn") > n).drop("__rn")


def slice_time(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """Both ends included."""
    return df.where(F.col("ts").between(start, end))


def _bucketed(df: DataFrame, factor: int) -> DataFrame:
    if factor < 1:
        raise ValueError("factor must be at least 1")
    return df.withColumn("__rn", F.row_number().over(w_keys(df))).withColumn("__b", F.floor((F.col("__rn") - 1) / factor))


def _aggregate(how: str, c: Column) -> Column:
    return {
        "first": lambda: F.min_by(c, "__rn"),
        "last": lambda: F.max_by(c, "__rn"),
        "mean": lambda: F.avg(c),
        "sum": lambda: F.sum(c),
        "max": lambda: F.max(c),
        "min": lambda: F.min(c),
    }[how]()


def downsample(df: DataFrame, factor: int, how: str = "last", column: str = "close", timeframe: str | None = None) -> DataFrame:
    """One row for every ``factor`` rows of a key, at the last one's ts; the rest at the end is kept."""
    if how not in AGGREGATES:
        raise ValueError(f"unknown aggregate {how!r}")
    g = _bucketed(df, factor).groupBy(*KEYS, "__b").agg(F.max_by("ts", "__rn").alias("ts"), _aggregate(how, field(column, df.columns)).alias(column)).drop("__b")
    return g.withColumn("timeframe", F.lit(timeframe)) if timeframe else g


def downsample_ohlcv(df: DataFrame, factor: int, timeframe: str | None = None) -> DataFrame:
    how = {"open": "first", "high": "max", "low": "min", "close": "last", "volume": "sum"}
    g = _bucketed(df, factor).groupBy(*KEYS, "__b").agg(F.max_by("ts", "__rn").alias("ts"), *[_aggregate(h, F.col(c)).alias(c) for c, h in how.items()]).drop("__b")
    return g.withColumn("timeframe", F.lit(timeframe)) if timeframe else g


def resample(df: DataFrame, from_tf: str, to_tf: str) -> DataFrame:
    """OHLCV of a longer timeframe, counted in rows of the shorter."""
    a, b = timeframe_minutes(from_tf), timeframe_minutes(to_tf)
    if b < a or b % a:
        raise ValueError(f"{to_tf} is no multiple of {from_tf}")
    return downsample_ohlcv(df.where(F.col("timeframe") == from_tf), b // a, to_tf)


def resample_clock(df: DataFrame, to_tf: str) -> DataFrame:
    """OHLCV of a longer timeframe by the clock: one partial aggregation, no ordering of a whole key."""
    slot = F.window("ts", f"{timeframe_minutes(to_tf)} minutes")["start"]
    at = F.col("ts")
    g = df.groupBy("symbol", "source", slot.alias("slot")).agg(F.min_by("open", at).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", at).alias("close"), F.sum("volume").alias("volume"))
    return g.select("symbol", F.lit(to_tf).alias("timeframe"), "source", F.col("slot").alias("ts"), "open", "high", "low", "close", "volume")


def upsample(df: DataFrame, factor: int) -> DataFrame:
    """Each row ``factor`` times at its own ts, the last of a key once; ``copy`` numbers them."""
    if factor < 1:
        raise ValueError("factor must be at least 1")
    rows = df.withColumn("__last", F.lead(F.lit(1)).over(w_keys(df)).isNull())
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(F.col("__last"), 0).otherwise(factor - 1)))).drop("__last")


def sync(series: DataFrame, reference: DataFrame, value: str = "value", how: str = "ffill", by: list[str] | None = None) -> DataFrame:
    """``value`` at the reference's instants: the last one before (the first, where there is none), or between neighbours on a line.

    A merge of both in one window per key: one shuffle, no join.
    """
    if how not in ("ffill", "linear"):
        raise ValueError(f"unknown fill {how!r}")
    by = by or ["symbol"]
    s = series.select(*by, "ts", F.col(value).alias("__v"), F.lit(0).alias("__side"))
    r = reference.select(*by, "ts", F.lit(None).cast("double").alias("__v"), F.lit(1).alias("__side"), *[c for c in reference.columns if c not in (*by, "ts", value)])
    both = r.unionByName(s, allowMissingColumns=True)
    point = F.when(F.col("__side") == 0, F.struct(F.unix_micros("ts").alias("t"), F.col("__v").alias("v")))
    up = Window.partitionBy(*by).orderBy("ts", "__side").rowsBetween(Window.unboundedPreceding, 0)
    # the next point is the last one seen from the other end
    down = Window.partitionBy(*by).orderBy(F.desc("ts"), F.desc("__side")).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumns({"__p": F.last(point, ignorenulls=True).over(up), "__first": F.first(point, ignorenulls=True).over(Window.partitionBy(*by).orderBy("ts", "__side").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    prev = F.coalesce(F.col("__p.v"), F.col("__first.v"), F.lit(0.0))
    if how == "linear":
        out = out.withColumn("__n", F.last(point, ignorenulls=True).over(down))
        span, t = F.col("__n.t") - F.col("__p.t"), F.unix_micros("ts") - F.col("__p.t")
        inner = F.col("__p.v") + (F.col("__n.v") - F.col("__p.v")) * (t / F.nullif(span, F.lit(0)))
        prev = F.coalesce(F.when(F.col("__p").isNotNull() & F.col("__n").isNotNull(), F.coalesce(inner, F.col("__p.v"))), F.col("__p.v"), F.col("__n.v"), F.lit(0.0))
    return out.where("__side = 1").withColumn(value, prev).drop("__v", "__side", "__p", "__first", "__n")


def align(left: DataFrame, right: DataFrame, how: str = "inner", fill: str = "none", seed_left: float | None = None, seed_right: float | None = None, value: str = "value", strict: bool = False) -> DataFrame:
    """Two series on common instants as ``left`` and ``right``; ``ffill`` closes gaps with the last value, then the seed.

    What is still missing is null; with ``strict`` it is an error when the rows are computed.
    """
    if how not in ("inner", "outer", "left", "right") or fill not in ("none", "ffill"):
        raise ValueError(f"unknown alignment {how!r} or fill {fill!r}")
    on = ["symbol", "timeframe", "ts"]
    j = left.select(*on, F.col(value).alias("left")).join(right.select(*on, F.col(value).alias("right")), on, how)
    whole = lambda c: F.coalesce(c, F.raise_error(F.concat(F.lit("no value at "), F.col("ts").cast("string"))).cast("double")) if strict else F.col(c)
    if fill == "none":
        return j.withColumns({c: whole(c) for c in ("left", "right")})
    w = Window.partitionBy("symbol", "timeframe").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    filled = lambda c, seed: F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(seed).cast("double"))
    return j.withColumns({"left": filled("left", seed_left), "right": filled("right", seed_right)}).withColumns({c: whole(c) for c in ("left", "right")})


def ref(bars: DataFrame, timeframe: str, name: str, reference: DataFrame, value: str = "value") -> DataFrame:
    """The reference with a field of another timeframe, as of each of its instants."""
    series = bars.where(F.col("timeframe") == timeframe).select("symbol", "ts", field(name, bars.columns).alias(value))
    return sync(series, reference, value)
