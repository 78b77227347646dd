"""Queries of the general data problems over a folder of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.changes import changed_since, last_successful_runs
from tickloom.operators.grid import missing_slots, regular_grid, series_points
from tickloom.operators.nearest import nearest_join
from tickloom.operators.spikes import Level, Wick, flag_implausible, flagged
from tickloom.operators.timestamps import is_plain, normalize_timestamps
from tickloom.operators.trailing import trailing_totals
from tickloom.queries_data_sql import ORACLES as ORACLES
from tickloom.util import SECOND, table, timeframe_us, written

SOURCE = ["symbol", "exchange", "shard", "timeframe"]


def bars_with_instants(spark: SparkSession, d: str) -> DataFrame:
    return normalize_timestamps(table(spark, d, "bars"), table(spark, d, "feeds"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    dirty = table(spark, d, "bars").where(F.col("timestamp").isNotNull() & ~is_plain(F.col("timestamp")))
    return normalize_timestamps(dirty.select("bar_id", "exchange", "timestamp"), table(spark, d, "feeds")).select("bar_id", "ts_us")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return changed_since(table(spark, d, "tick_updates"), last_successful_runs(table(spark, d, "runtime_snapshots")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    field = F.lit
    bars = bars_with_instants(spark, d).select(field("bars.volume").alias("field"), *SOURCE, "ts_us", F.col("volume").alias("v"), "received_at", F.col("bar_id").alias("id"))
    liq = table(spark, d, "liquidations").select(field("liquidations.value").alias("field"), "symbol", "exchange", "shard", F.lit("").alias("timeframe"), F.unix_micros("timestamp").alias("ts_us"), F.col("value").alias("v"), "received_at", F.col("liquidation_id").alias("id"))
    keys = ["field", *SOURCE]
    t = trailing_totals(bars.unionByName(liq), keys, "ts_us", "v", ["received_at", "id"])
    return t.select(*keys, F.date_format(F.date_from_unix_date("day"), "yyyy-MM-dd").alias("day"), F.col("sum_7").alias("total_7d_cents"), F.col("sum_30").alias("total_30d_cents"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    keys = ["symbol", "exchange", "shard"]
    bars = bars_with_instants(spark, d).select(*keys, F.lit("bars").alias("tbl"), "ts_us", F.col("bar_id").alias("record_id"))
    liq = table(spark, d, "liquidations").select(*keys, F.lit("liquidations").alias("tbl"), F.unix_micros("timestamp").alias("ts_us"), F.col("liquidation_id").alias("record_id"))
    book = table(spark, d, "orderbook").where(F.col("mid_price").isNotNull()).select(*keys, F.unix_micros("timestamp").alias("ts_us"), "book_id")
    return nearest_join(bars.unionByName(liq), book, keys, "ts_us", "ts_us", "record_id", "book_id", 45 * SECOND).select("tbl", "record_id", "book_id")


def p5_readings(spark: SparkSession, d: str) -> DataFrame:
    bars = bars_with_instants(spark, d).where(F.col("close").isNotNull()).select(F.lit("bars.close").alias("field"), *SOURCE, F.col("ts_us").alias("t_us"), F.col("close").alias("value"), F.col("bar_id").alias("version"))
    series = series_points(table(spark, d, "metric_series").withColumnRenamed("metric", "field"), ["field", *SOURCE])
    return bars.unionByName(series)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    keys = ["field", *SOURCE]
    return missing_slots(regular_grid(p5_readings(spark, d), keys)).select(*keys, "slot_us")


def p5_grid(spark: SparkSession, d: str) -> DataFrame:
    """The whole grid: every slot with its time-weighted average, coverage and number of readings."""
    keys = ["field", *SOURCE]
    return regular_grid(p5_readings(spark, d), keys).select(*keys, "slot_us", "n_readings", F.round("avg", 6).alias("avg"), F.round("coverage", 6).alias("coverage"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    bars = bars_with_instants(spark, d).withColumn("arrived", F.unix_micros("received_at") - F.coalesce(timeframe_us(F.col("timeframe")), F.lit(0)))
    # the operator reads its rows twice, to count and to cut them: their instants are worked out once
    bars = written(bars.select(*SOURCE, "ts_us", "bar_id", "open", "high", "low", "close", "volume", "arrived"), "instants")
    b = flag_implausible(bars, SOURCE, "ts_us", "bar_id", [Wick("high"), Wick("low"), Level("volume", floor=0.35)], "arrived")
    book = table(spark, d, "orderbook").select("symbol", "exchange", "shard", F.unix_micros("timestamp").alias("ts_us"), F.unix_micros("received_at").alias("arrived"), "book_id", "spread_bps")
    o = flag_implausible(book, SOURCE[:3], "ts_us", "book_id", [Level("spread_bps", top=20_000.0)], "arrived")
    hits = flagged(b, "bar_id").select("bar_id")
    return hits.select(F.lit("bars").alias("tbl"), F.col("bar_id").alias("record_id")).union(flagged(o, "book_id").select(F.lit("orderbook").alias("tbl"), F.col("book_id").alias("record_id")))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p3_found, p4_found, p5_found, p5_grid, p6_found)}
