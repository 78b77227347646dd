"""Irregular readings onto a regular grid.

Each reading holds from its instant to the next reading of its source, at most
``hold`` grid steps: a step function, kept as validity intervals. The intervals are
intersected with the grid cells; every cell from a source's first to its last
reading gets the number of its readings, the time-weighted average of what held
in it, and the fraction of it that is covered.

A source is cut into pieces of ``PIECE`` cells, so that no task holds a whole
source; the edges of the pieces are joined by ``lead_across``. A gap is cut into pieces too, which are spread over tasks before
their cells are made: a reading centuries away is no row of millions of cells.

Defined results: null or -1 instants, null values and timeframes that are none take no part;
a NaN value is a reading, but gives no average; of readings at one instant the
latest version holds; null source columns are a group of their own; an empty
frame gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.util import floor_div, lead_across, timeframe_us

PIECE = 4096


def series_points(series: DataFrame, keys: list[str]) -> DataFrame:
    """The usable points of chunked series: (keys, t_us, value, version). A null mask makes every point available, a null entry of one none."""
    z = F.arrays_zip(F.col("timestamps").alias("t"), F.col("vals").alias("v"), F.coalesce(F.col("availability_mask"), F.transform("timestamps", lambda _: F.lit(True))).alias("m"))
    p = series.select(*keys, F.col("chunk_id").alias("version"), F.explode(z).alias("p"))
    return p.where(F.col("p.t").isNotNull() & F.col("p.v").isNotNull() & F.coalesce(F.col("p.m"), F.lit(False))).select(*keys, F.unix_micros("p.t").alias("t_us"), F.col("p.v").alias("value"), "version")


def regular_grid(readings: DataFrame, keys: list[str], timeframe: str = "timeframe", hold: int = 1) -> DataFrame:
    """(keys, slot_us, n_readings, avg, coverage) from readings (keys, t_us, value, version); ``timeframe`` is one of the keys."""
    r = readings.where(F.col("t_us").isNotNull() & (F.col("t_us") != -1) & F.col("value").isNotNull()).withColumn("__step", timeframe_us(F.col(timeframe)))
    r = r.where(F.col("__step").isNotNull()).withColumn("__slot", floor_div(F.col("t_us"), F.col("__step")))
    r = r.withColumn("__piece", floor_div(F.col("__slot"), PIECE))
    r = lead_across(r, keys, "__piece", ["t_us", "version"], "t_us", "__next")
    step, t, nxt = F.col("__step"), F.col("t_us"), F.col("__next")
    until = F.least(nxt, t + step * hold)
    last = F.coalesce(F.greatest(F.col("__slot"), floor_div(nxt - 1, step)), F.col("__slot"))
    r = r.select(*keys, "__step", "__slot", t, "value", until.alias("__until"), last.alias("__last"))
    r = r.withColumn("__piece", F.explode(F.sequence(floor_div(F.col("__slot"), PIECE), floor_div(F.col("__last"), PIECE))))
    # the cells of a piece are made where they are summed: the exchange by piece serves the grouping by cell too
    begin = F.col("__piece") * PIECE
    inside = F.sequence(F.greatest(F.col("__slot"), begin), F.least(F.col("__last"), begin + PIECE - 1))
    cells = r.repartition(*keys, "__piece").withColumn("__cell", F.explode(inside))
    # the last reading of a source holds for its own cell
    end = F.coalesce(F.col("__until"), (F.col("__slot") + 1) * step)
    held = F.greatest(F.lit(0), F.least(end, (F.col("__cell") + 1) * step) - F.greatest(t, F.col("__cell") * step))
    cells = cells.select(*keys, "__step", "__piece", "__cell", (F.col("__cell") == F.col("__slot")).cast("long").alias("__own"), held.alias("__held"), "value")
    g = cells.groupBy(*keys, "__step", "__piece", "__cell").agg(F.sum("__own").alias("n_readings"), F.sum("__held").alias("__h"), F.sum(F.col("value") * F.col("__held")).alias("__vh"))
    avg = F.when(F.col("__h") > 0, F.col("__vh") / F.col("__h"))
    return g.select(*keys, (F.col("__cell") * step).alias("slot_us"), "n_readings", F.when(~F.isnan(avg), avg).alias("avg"), (F.col("__h") / step).alias("coverage"))


def missing_slots(grid: DataFrame) -> DataFrame:
    return grid.where(F.col("n_readings") == 0)
