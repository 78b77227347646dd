"""Nearest partners and regular grids, against brute force."""

import random
from collections import defaultdict

import pytest

from tickloom.operators import grid as G
from tickloom.operators.nearest import nearest_join

S = 1_000_000


def nearest(spark, left, right, tol=45 * S, cell=60 * S):
    lf = spark.createDataFrame(left, "k string, t long, i long, tbl string")
    rt = spark.createDataFrame(right, "k string, t long, j long, tbl int")
    out = nearest_join(lf, rt, ["k"], "t", "t", "i", "j", tol, cell)
    return sorted((r.tbl, r.i, r.j) for r in out.collect())


def brute(left, right, tol=45 * S):
    out = []
    for k, t, i, tbl in left:
        if t is None or t == -1 or k is None:
            continue
        c = [(abs(u - t), u, j) for k2, u, j, _ in right if k2 == k and u is not None and abs(u - t) <= tol]
        if c:
            out.append((tbl, i, min(c)[2]))
    return sorted(out)


@pytest.mark.parametrize("cell", [30 * S, 60 * S, 3600 * S])
def test_random(spark, cell):
    rnd = random.Random(2)
    base = 1_700_000_000 * S
    left = [(rnd.choice("ab"), base + rnd.randrange(4000) * S, i, "x") for i in range(300)]
    right = [(rnd.choice("ab"), base + rnd.randrange(4000) * S + rnd.choice([0, 0, 1]), j, 0) for j in range(150)]
    assert nearest(spark, left, right, cell=cell) == brute(left, right)


def test_ties_repeats_and_bounds(spark):
    t = 10_000 * S
    left = [("a", t, 1, "x"), ("a", t, 1, "x"), ("a", t + 200 * S, 2, None), ("a", -1, 3, "x"), ("a", None, 4, "x"), (None, t, 5, "x"), ("b", t, 6, "x"), ("a", -500 * S, 7, "x")]
    right = [("a", t - 10 * S, 9, 0), ("a", t + 10 * S, 8, 0), ("a", t - 10 * S, 7, 0), ("a", t + 155 * S, 5, 0), ("b", t + 45 * S + 1, 1, 0), ("b", None, 2, 0), (None, t, 3, 0), ("a", -545 * S, 4, 0)]
    assert nearest(spark, [x for x in left if x[3]], right) == [("x", 1, 7), ("x", 1, 7), ("x", 7, 4)]
    assert nearest(spark, [("a", t + 200 * S, 2, "y")], right) == [("y", 2, 5)]


def test_one_hot_key_and_empty_sides(spark):
    left = [("a", i * S, i, "x") for i in range(500)]
    right = [("a", i * S // 3, 10_000 + i, 0) for i in range(1500)]
    assert nearest(spark, left, right) == brute(left, right)
    assert nearest(spark, [], right) == nearest(spark, left, []) == []


def grid(spark, rows, **kw):
    df = spark.createDataFrame(rows, "k string, timeframe string, t_us long, value double, version long")
    out = G.regular_grid(df, ["k", "timeframe"], **kw)
    return {(r.k, r.slot_us): (r.n_readings, r.avg, r.coverage) for r in out.collect()}


def test_hand_made(spark):
    m = 60 * S
    got = grid(spark, [("a", "1m", 0, 10.0, 1), ("a", "1m", 30 * S, 20.0, 1), ("a", "1m", 3 * m + 15 * S, 40.0, 1)])
    assert got["a", 0] == (2, 15.0, 1.0)
    assert got["a", m] == (0, 20.0, 0.5)
    assert got["a", 2 * m] == (0, None, 0.0)
    assert got["a", 3 * m] == (1, 40.0, 0.75)


@pytest.mark.parametrize("piece", [2, 4096])
def test_missing_slots(spark, monkeypatch, piece):
    monkeypatch.setattr(G, "PIECE", piece)
    rnd = random.Random(3)
    rows, slots = [], defaultdict(set)
    for k in "abc":
        for _ in range(60):
            t = rnd.randrange(-5000, 90_000) * S
            rows.append((k, "5m", t, rnd.choice([1.0, 2.0]), rnd.randrange(3)))
            slots[k].add(t // (300 * S))
    rows += rows[:20]
    rows += [("a", "5m", None, 1.0, 1), ("a", "5m", -1, 1.0, 1), ("a", "5m", 9 * 10**12, None, 1), ("a", "x", 5, 1.0, 1), ("a", None, 5, 1.0, 1)]
    rows = [r for r in rows if r[2] != -1 or r[0] != "a" or True]
    got = grid(spark, rows)
    missing = {x for x, v in got.items() if v[0] == 0}
    assert missing == {(k, s * 300 * S) for k, v in slots.items() for s in range(min(v), max(v) + 1) if s not in v}
    assert set(got) == {(k, s * 300 * S) for k, v in slots.items() for s in range(min(v), max(v) + 1)}


def test_a_gap_of_decades_is_spread_over_tasks(spark):
    """One reading sent with a wrong year: its empty cells are made piece by piece, in many tasks."""
    from pyspark.sql import functions as F

    years = 54 * 365 * 86_400 * S
    df = spark.createDataFrame([("a", "1h", 0, 1.0, 1), ("a", "1h", years, 2.0, 1)], "k string, timeframe string, t_us long, value double, version long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = G.missing_slots(G.regular_grid(df, ["k", "timeframe"])).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in got) == 54 * 365 * 24 - 1 and len(got) == 4 and max(r["count"] for r in got) < 54 * 365 * 24 // 2


def test_points_of_series(spark):
    import datetime as dt

    t = [dt.datetime(2024, 1, 1, 0, i) for i in range(3)]
    rows = [("a", 1, t, [1.0, None, 3.0], None), ("a", 2, t, [1.0, 2.0, 3.0], [True, False, None]), ("b", 3, [], [], []), ("c", 4, None, None, None)]
    df = spark.createDataFrame(rows, "k string, chunk_id long, timestamps array<timestamp>, vals array<double>, availability_mask array<boolean>")
    got = sorted((r.k, r.version, r.value) for r in G.series_points(df, ["k"]).collect())
    assert got == [("a", 1, 1.0), ("a", 1, 3.0), ("a", 2, 1.0)]


def test_empty(spark):
    assert grid(spark, []) == {}
