"""Trailing totals against plain sums."""

import random
from collections import defaultdict

import pytest

from tickloom.operators import trailing as T

DAY = 86_400_000_000


def brute(rows, periods=(7, 30)):
    rec = {}
    for k, t, v, r in rows:
        if t is not None and t != -1 and ((k, t) not in rec or r > rec[k, t][0]):
            rec[k, t] = (r, v)
    days = defaultdict(lambda: defaultdict(int))
    n = defaultdict(lambda: defaultdict(int))
    for (k, t), (_, v) in rec.items():
        days[k][t // DAY] += 0 if v is None or v != v else round(v * 100)
        n[k][t // DAY] += 0 if v is None or v != v else 1
    return {(k, d): tuple(x for p in periods for x in (sum(m.get(d - i, 0) for i in range(p)), sum(n[k].get(d - i, 0) for i in range(p)))) for k, m in days.items() for d in range(min(m), max(m) + 1)}


def run(spark, rows, periods=(7, 30)):
    df = spark.createDataFrame(rows, "k string, t long, v double, r long")
    out = T.trailing_totals(df, ["k"], "t", "v", ["r"], periods)
    return {(r["k"], r["day"]): tuple(r[f"{x}_{p}"] for p in periods for x in ("sum", "n")) for r in out.collect()}


def test_cover_is_exact():
    for lo in range(0, 64, 3):
        for hi in range(lo, 64):
            leaves = set()
            for n in T.cover(lo, hi):
                a = z = n
                while a < T.SHARD:
                    a, z = 2 * a, 2 * z + 1
                assert not leaves & set(range(a, z + 1))
                leaves |= set(range(a, z + 1))
            assert leaves == set(range(64 + lo, 64 + hi + 1))
            assert len(T.cover(lo, hi)) <= 12


@pytest.mark.parametrize("periods", [(7, 30), (1, 64)])
def test_random_with_gaps(spark, periods):
    rnd = random.Random(1)
    rows = []
    for k, days, n in (("a", 200, 300), ("b", 900, 12), ("c", 3, 40), (None, 70, 20)):
        for i in range(n):
            t = (19_700 + rnd.randrange(days)) * DAY + rnd.randrange(24) * 3_600_000_000
            rows.append((k, t, rnd.choice([None, float("nan"), round(rnd.uniform(-5, 99), 2), 12.34]), i))
    rows += [("a", None, 5.0, 1), ("a", -1, 5.0, 2)]
    rows += [(k, t, 77.77, r + 1000) for k, t, v, r in rows[:30] if t]  # sent again, corrected
    assert run(spark, rows, periods) == brute(rows, periods)


def test_before_1970_and_empty(spark):
    rows = [("a", -3 * DAY + 5, 1.0, 1), ("a", 2 * DAY, 2.0, 1)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == {}


def test_corrections_touch_ancestors_only(spark):
    rows = [("a", (19_700 + d) * DAY, float(d), 1) for d in range(0, 150, 2)]
    df = spark.createDataFrame(rows, "k string, t long, v double, r long")
    trees = T.build_trees(T.daily(df, ["k"], "t", "v", ["r"]), ["k"])
    deltas = spark.createDataFrame([("a", 19_703, 500, 1), ("b", 19_703, 100, 1)], "k string, __day int, __sum long, __n long")
    old = {(r.k, r.time_shard): r for r in trees.collect()}
    new = {(r.k, r.time_shard): r for r in T.correct(trees, deltas, ["k"]).collect()}
    shard = 19_703 // 64
    changed = {i for i, (x, y) in enumerate(zip(old["a", shard].sums, new["a", shard].sums)) if x != y}
    leaf = 64 + 19_703 % 64
    assert changed == {leaf >> i for i in range(7)}
    assert all(new[k].sums == old[k].sums for k in old if k != ("a", shard)) and ("b", shard) in new
    want = brute([*rows, ("a", 19_703 * DAY, 5.0, 9), ("b", 19_703 * DAY, 1.0, 9)])
    got = T.query_trees(T.correct(trees, deltas, ["k"]), ["k"]).collect()
    assert {(r.k, r.day): (r.sum_7, r.n_7, r.sum_30, r.n_30) for r in got} == want


@pytest.mark.parametrize("periods", [(65,), (90, 7), (365, 30)])
def test_longer_periods_take_larger_shards(spark, periods):
    rnd = random.Random(6)
    rows = [("a", (19_700 + rnd.randrange(1200)) * DAY + i, round(rnd.uniform(-5, 99), 2), i) for i in range(120)]
    rows += [("b", (19_700 + d) * DAY, 1.0, 1) for d in (0, 64, 65, 511, 512, 900)]
    assert run(spark, rows, periods) == brute(rows, periods)
    trees = T.build_trees(T.daily(spark.createDataFrame(rows, "k string, t long, v double, r long"), ["k"], "t", "v", ["r"]), ["k"])
    with pytest.raises(ValueError):
        T.query_trees(trees, ["k"], periods)
