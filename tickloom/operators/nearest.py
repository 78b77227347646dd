"""Nearest record in time for the same entity, within a tolerance.

Right-side timestamps become nearest-neighbour intervals: a record owns the
instants nearer to it than to its neighbours, bounded by the midpoints and by the
tolerance. The intervals of one entity do not overlap. They are indexed by
(entity, time cell): an interval that may reach into a neighbouring cell is there
too. A left record stabs the index of its own cell: in order of time, the last
interval that has begun is the only one that can hold it. That is a merge, so
no pairs within a cell are made, and a cell bounds what one task holds.

Defined results: rows with a null or -1 instant or a null entity column find no
partner; right rows whose ``valid`` column is null are none; of equally near
records the earlier counts, then the smaller id; repeated rows all count on the
left; an empty side gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.util import MINUTE, floor_div


def nearest_intervals(right: DataFrame, keys: list[str], at_us: str, right_id: str, tolerance_us: int, cell_us: int) -> DataFrame:
    """(keys, cell, lo, hi, right_id): who is nearest from lo to hi (both included), for instants of the cell."""
    t = F.col(at_us)
    r = right.where(t.isNotNull() & (t != -1)).dropna(subset=keys)
    reach = F.sequence(floor_div(t - tolerance_us, cell_us), floor_div(t + tolerance_us, cell_us))
    r = r.select(*keys, t.alias("__t"), F.col(right_id).alias("__id"), F.explode(reach).alias("__cell"))
    w = Window.partitionBy(*keys, "__cell").orderBy("__t", "__id")
    r = r.withColumns({"__prev": F.lag("__t").over(w), "__rest": F.lead("__t").over(w)})
    # of several at one instant the first stands, and its successor is the next instant
    r = r.where(~F.coalesce(F.col("__prev") == F.col("__t"), F.lit(False)))
    r = r.withColumn("__next", F.lead("__t").over(w))
    tt = F.col("__t")
    # an instant at the midpoint belongs to the earlier record
    lo = F.greatest(tt - tolerance_us, floor_div(F.col("__prev") + tt, 2) + 1)
    hi = F.least(tt + tolerance_us, floor_div(tt + F.col("__next"), 2))
    return r.select(*keys, "__cell", lo.alias("__lo"), hi.alias("__hi"), "__id")


def nearest_join(left: DataFrame, right: DataFrame, keys: list[str], left_us: str, right_us: str, left_id: str, right_id: str, tolerance_us: int, cell_us: int = 60 * MINUTE) -> DataFrame:
    """(keys, left columns, right_id) for each left row with a right record within the tolerance."""
    ix = nearest_intervals(right, keys, right_us, right_id, tolerance_us, cell_us)
    ix = ix.select(*keys, "__cell", F.col("__lo").alias("__at"), F.lit(0).alias("__side"), F.struct(F.col("__hi").alias("hi"), F.col("__id").alias("id")).alias("__iv"), F.lit(None).cast(left.schema[left_id].dataType).alias("__left"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in (*keys, left_us, left_id)])
    t = F.col(left_us)
    lf = left.where(t.isNotNull() & (t != -1)).dropna(subset=keys)
    lf = lf.select(*keys, floor_div(t, cell_us).alias("__cell"), t.alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(ix.schema["__iv"].dataType).alias("__iv"), F.col(left_id).alias("__left"), *[c for c in left.columns if c not in (*keys, left_us, left_id)])
    w = Window.partitionBy(*keys, "__cell").orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = ix.unionByName(lf).withColumn("__hit", F.last("__iv", ignorenulls=True).over(w))
    hit = both.where((F.col("__side") == 1) & (F.col("__hit.hi") >= F.col("__at")))
    return hit.select(*keys, *[c for c in left.columns if c not in (*keys, left_us, left_id)], F.col("__left").alias(left_id), F.col("__hit.id").alias(right_id))
