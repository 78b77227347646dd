"""Trailing totals per entity and day from segment trees.

A time shard is 64 days of one entity, or as many as the longest period has, up to a power of two. Its rows become one segment tree of sums
and one of counts, kept as arrays in heap order: node 1 is the shard, node i has
the children 2i and 2i+1, day d of a shard of S days is leaf S+d. A trailing period that ends with day
d is a range of leaves; it is answered from the few nodes that cover it, in this
shard's tree and the one before. A late correction touches only the leaf's ancestors
(``correct``).

Rows are summed per entity and day before they meet (map-side first), so a hot
entity reaches the trees as one row per day.

Defined results: a null value counts as nothing (the day still counts as one with a row); a NaN value too;
null or -1 instants take no part; rows of one entity and instant are one record, the
latest ``version`` counting; null entity columns are a group of their own; an
empty frame gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from tickloom.util import DAY, floor_div

SHARD = 64  # days at least; a power of two
LONGS = ArrayType(LongType())


def shard_days(periods: tuple[int, ...]) -> int:
    """Days of a shard: no period is longer, so that it ends in the shard before at most."""
    return max(SHARD, 1 << (max(periods) - 1).bit_length())


def cover(lo: int, hi: int, shard: int = SHARD) -> list[int]:
    """The fewest tree nodes that make up the leaves lo..hi."""
    out, a, b = [], lo + shard, hi + shard + 1
    while a < b:
        if a & 1:
            out.append(a)
            a += 1
        if b & 1:
            b -= 1
            out.append(b)
        a, b = a >> 1, b >> 1
    return out if lo <= hi else []


def _tree(shard: int) -> Callable[..., Column]:
    """One heap-ordered tree (index 0 unused) per row from its leaves' positions and values."""

    @F.pandas_udf(LONGS)
    def tree(days: pd.Series, values: pd.Series) -> pd.Series:
        t = np.zeros((len(days), 2 * shard), np.int64)
        if len(days):
            row = np.repeat(np.arange(len(days)), days.map(len))
            t[row, shard + np.concatenate(days.to_list()).astype(np.int64)] = np.concatenate(values.to_list())
        size = shard
        while size > 1:
            t[:, size // 2 : size] = t[:, size : 2 * size : 2] + t[:, size + 1 : 2 * size : 2]
            size //= 2
        return pd.Series(list(t))

    return tree


def _answer(periods: tuple[int, ...], shard: int) -> Callable[..., Column]:
    """An expression of (tree, tree before): a total for each day of the shard, one period after the other."""
    own = [cover(max(0, d - p + 1), d, shard) for p in periods for d in range(shard)]
    before = [cover(shard + d - p + 1, shard - 1, shard) if d < p - 1 else [] for p in periods for d in range(shard)]

    @F.pandas_udf(LONGS)
    def answer(tree: pd.Series, prev: pd.Series) -> pd.Series:
        if not len(tree):
            return pd.Series([], dtype=object)
        t, p = np.stack(tree.to_list()), np.stack(prev.to_list())
        return pd.Series(list(np.stack([t[:, a].sum(1) + p[:, b].sum(1) for a, b in zip(own, before)], 1)))

    return answer


def daily(df: DataFrame, keys: list[str], at_us: str, value: str, version: list[str], scale: int = 100) -> DataFrame:
    """(keys, __day, __sum, __n): one record per entity and instant, summed by UTC day in ``1/scale`` units."""
    v = F.when(~F.isnan(value), F.round(F.col(value) * scale).cast("long"))
    rows = df.where(F.col(at_us).isNotNull() & (F.col(at_us) != -1)).select(*keys, at_us, F.struct(*[F.col(c) for c in version], v.alias("__v")).alias("__r"))
    records = rows.groupBy(*keys, at_us).agg(F.max("__r").alias("__r"))
    day = floor_div(F.col(at_us), DAY).cast("int")
    return records.groupBy(*keys, day.alias("__day")).agg(F.coalesce(F.sum("__r.__v"), F.lit(0)).alias("__sum"), F.count("__r.__v").alias("__n"))


def build_trees(days: DataFrame, keys: list[str], shard: int = SHARD) -> DataFrame:
    """(keys, time_shard, first, last, sums, counts): one row per entity and shard that has rows."""
    d = F.pmod(F.col("__day"), F.lit(shard))
    tree = _tree(shard)
    g = days.groupBy(*keys, floor_div(F.col("__day"), shard).cast("int").alias("time_shard")).agg(
        F.collect_list(F.struct(d.alias("d"), F.col("__sum").alias("s"), F.col("__n").alias("n"))).alias("m"),
        F.min("__day").alias("first"),
        F.max("__day").alias("last"),
    )
    return g.select(*keys, "time_shard", "first", "last", tree(F.col("m.d"), F.col("m.s")).alias("sums"), tree(F.col("m.d"), F.col("m.n")).alias("counts"))


def correct(trees: DataFrame, deltas: DataFrame, keys: list[str], shard: int = SHARD) -> DataFrame:
    """Trees after late corrections (keys, __day, __sum, __n as differences): only the leaves' ancestors change.

    Corrections beyond an entity's present shards make new trees.
    """
    d = deltas.groupBy(*keys, "__day").agg(F.sum("__sum").alias("__sum"), F.sum("__n").alias("__n"))
    leaf = F.pmod(F.col("__day"), F.lit(shard)) + shard
    # each delta goes to its leaf and the ancestors of it, and to no other node
    nodes = d.select(*keys, "__day", floor_div(F.col("__day"), shard).cast("int").alias("time_shard"), F.explode(F.array(*[F.shiftright(leaf, k) for k in range(shard.bit_length())])).alias("node"), "__sum", "__n")
    per_node = nodes.groupBy(*keys, "time_shard", "node").agg(F.sum("__sum").alias("s"), F.sum("__n").alias("n"), F.min("__day").alias("lo"), F.max("__day").alias("hi"))
    g = per_node.groupBy(*keys, "time_shard").agg(F.map_from_entries(F.collect_list(F.struct("node", F.struct("s", "n")))).alias("m"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    left, right = trees.alias("t"), g.alias("d")
    on = reduce(lambda a, b: a & b, [F.col(f"t.{k}").eqNullSafe(F.col(f"d.{k}")) for k in [*keys, "time_shard"]])
    empty = F.array_repeat(F.lit(0).cast("long"), 2 * shard)

    def updated(name: str, f: str) -> Column:
        old = F.coalesce(F.col(f"t.{name}"), empty)
        return F.when(F.col("d.m").isNull(), old).otherwise(F.transform(old, lambda x, i: x + F.coalesce(F.try_element_at(F.col("d.m"), i)[f], F.lit(0)))).alias(name)

    return left.join(right, on, "full_outer").select(
        *[F.coalesce(F.col(f"t.{k}"), F.col(f"d.{k}")).alias(k) for k in [*keys, "time_shard"]],
        F.least("t.first", "d.lo").alias("first"),
        F.greatest("t.last", "d.hi").alias("last"),
        updated("sums", "s"),
        updated("counts", "n"),
    )


def query_trees(trees: DataFrame, keys: list[str], periods: tuple[int, ...] = (7, 30), shard: int = SHARD) -> DataFrame:
    """(keys, day, sum_P, n_P ...) for each day from an entity's first to its last, days without rows included."""
    if max(periods) > shard:
        raise ValueError(f"trees of {shard} days answer no longer periods")
    w = Window.partitionBy(*keys).orderBy("time_shard")
    t = trees.withColumns({
        "p_shard": F.lag("time_shard").over(w),
        "p_sums": F.lag("sums").over(w),
        "p_counts": F.lag("counts").over(w),
        "n_shard": F.lead("time_shard").over(w),
        "from": F.min("first").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "to": F.max("last").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })
    zero = F.array_repeat(F.lit(0).cast("long"), 2 * shard)
    # shards without any row are made here, so that their days come out too
    t = t.withColumn("x", F.explode(F.sequence(F.col("time_shard"), F.coalesce(F.col("n_shard") - 1, F.col("time_shard")))))
    own, first_gap = F.col("x") == F.col("time_shard"), F.col("x") == F.col("time_shard") + 1
    near = F.col("p_shard") == F.col("time_shard") - 1
    pick = lambda c: F.when(own, F.col(c)).otherwise(zero)
    pick_prev = lambda c: F.when(own, F.when(near, F.col(f"p_{c}")).otherwise(zero)).when(first_gap, F.col(c)).otherwise(zero)
    lo = F.greatest(F.col("from"), F.col("x") * shard)
    hi = F.least(F.col("to"), F.col("x") * shard + shard - 1)
    t = t.select(*keys, lo.alias("lo"), hi.alias("hi"), pick("sums").alias("s"), pick("counts").alias("n"), pick_prev("sums").alias("ps"), pick_prev("counts").alias("pn"))
    answer = _answer(periods, shard)
    t = t.withColumns({"s": answer("s", "ps"), "n": answer("n", "pn")})
    at = lambda c, k, i: F.get(F.col(c), F.pmod(i, F.lit(shard)) + k * shard)
    per_day = F.transform(
        F.sequence("lo", "hi"),
        lambda i: F.struct(i.alias("day"), *[x for k, p in enumerate(periods) for x in (at("s", k, i).alias(f"sum_{p}"), at("n", k, i).alias(f"n_{p}"))]),
    )
    return t.select(*keys, F.explode(per_day).alias("r")).select(*keys, "r.*")


def trailing_totals(df: DataFrame, keys: list[str], at_us: str, value: str, version: list[str], periods: tuple[int, ...] = (7, 30), scale: int = 100) -> DataFrame:
    """Totals (``sum_P`` in 1/scale units), counts (``n_P``) and averages (``avg_P``) per entity and UTC day."""
    shard = shard_days(periods)
    out = query_trees(build_trees(daily(df, keys, at_us, value, version, scale), keys, shard), keys, periods, shard)
    return out.withColumns({f"avg_{p}": F.when(F.col(f"n_{p}") > 0, F.col(f"sum_{p}") / F.lit(float(scale)) / F.col(f"n_{p}")) for p in periods})
