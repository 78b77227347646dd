"""Implausible readings planted into made sources."""

import numpy as np
import pytest

from tickloom.operators import spikes as P

SCHEMA = "id long, k string, t long, arrived long, open double, high double, low double, close double, volume double"


def bars(n=400, seed=0, k="a", quiet=False):
    r = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(r.normal(0, 0.003, n)))
    open_ = np.r_[100, close[:-1]]
    high = np.maximum(open_, close) * (1 + abs(r.normal(0, 0.002, n)))
    low = np.minimum(open_, close) * (1 - abs(r.normal(0, 0.002, n)))
    volume = np.round(np.exp(r.normal(5, 0.4, n)), 2)
    if quiet:
        volume[r.random(n) < 0.6] = 0.0
    return [[i, k, i * 1000, i * 1000 + 5, *map(float, x)] for i, x in enumerate(zip(open_, high, low, close, volume))]


def flags(spark, rows, **kw):
    df = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
    out = P.flag_implausible(df, ["k"], "t", "id", [P.Wick("high"), P.Wick("low"), P.Level("volume", **kw)], "arrived")
    return {r.id: (r.high, r.low, r.volume) for r in out.collect()}


def bad(got):
    return {i for i, s in got.items() if set(s) != {"normal"}}


def test_planted(spark):
    rows = bars()
    rows[50][5] *= 1.4  # high
    rows[80][6] *= 0.5  # low
    rows[120][8] *= 60  # volume
    rows[150][8] = -1.0
    rows[160][5] = rows[160][6] - 1  # high under low
    rows[170][6] = 0.0
    for i in range(200, 209):
        rows[i][8] = rows[200][8]
    for i in range(300, 304):  # too short a run
        rows[i][8] = rows[300][8]
    rows[250][8] = None
    rows[260][5], rows[270][4] = float("nan"), float("nan")
    got = flags(spark, rows)
    assert bad(got) == {50, 80, 120, 150, 160, 170, *range(200, 209)}
    assert got[50][0] == got[80][1] == got[120][2] == "spike" and got[150][2] == "out_of_range" and got[204][2] == "stuck"


@pytest.mark.parametrize("piece", [64, 2048])
def test_level_change_drift_and_quiet_sources_are_normal(spark, monkeypatch, piece):
    monkeypatch.setattr(P, "PIECE", piece)
    a, b, c = bars(k="a"), bars(seed=1, k="b", quiet=True), bars(seed=2, k="c")
    for i, x in enumerate(a):
        x[8] = round(x[8] * (8 if i > 200 else 1), 2)
    for i, x in enumerate(c):
        x[8] = round(x[8] * 1.01**i, 2)
    rows = a + b + c
    for i, x in enumerate(rows):
        x[0] = i
    rows[30][8] *= 100
    got = flags(spark, rows)
    assert len(got) == len(rows) and bad(got) == {30}


def test_spike_that_is_sent_again(spark):
    rows = bars()
    rows[100][8] *= 90
    rows.append([1000, *rows[100][1:]])
    assert bad(flags(spark, rows)) == {100, 1000}


def test_rows_without_instant_and_small_sources(spark):
    rows = bars(30)
    rows[5][2] = None
    rows[6][2] = -1
    rows[7][2] = rows[7][3] = None
    rows[7][8] = -3.0
    rows += [[100, "b", 5, 5, 1.0, 2.0, 0.5, 1.0, 7.0], [101, None, 5, 5, 1.0, 0.5, 0.6, 1.0, None], [102, "e", None, None, None, None, None, None, None]]
    assert bad(flags(spark, rows)) == {7, 101}


@pytest.mark.parametrize("shape", ["even", "stray", "burst"])
def test_pieces_are_cut_by_rows(spark, monkeypatch, shape):
    """However the instants lie, a piece holds PIECE rows and the margins, and each row is at home once."""
    monkeypatch.setattr(P, "PIECE", 64)
    monkeypatch.setattr(P, "MARGIN", 16)
    day = 86_400_000_000
    at = {"even": lambda i: i * day // 7, "stray": lambda i: -7300 * day if i == 0 else i * 1_000_000, "burst": lambda i: 5}[shape]
    df = spark.createDataFrame([(s, at(i), i) for s in (1, 2) for i in range(1000 if s == 1 else 3)], "__s long, __t long, __id long")
    out = P.cut_in_pieces(df).collect()
    groups = {}
    for r in out:
        groups.setdefault((r["__s"], r["__piece"]), []).append((r["__id"], r["__home"] == r["__piece"]))
    assert sorted(i for g in groups.values() for i, own in g if own) == sorted([*range(1000), *range(3)])
    for (s, p), g in groups.items():
        assert sorted(i for i, _ in g) == list(range(max(0, p * 64 - 16), min((p + 1) * 64 + 16, 1000 if s == 1 else 3)))


def test_first_reading_is_judged_with_its_neighbours(spark):
    """An instant long before the first arrival does not leave its reading alone."""
    rows = bars(60)
    for x in rows[1:]:
        x[2], x[3] = x[2] + 20_000, x[3] + 20_000
    rows[0][2] = -1_000_000
    rows[0][8] *= 90
    assert bad(flags(spark, rows)) == {0}


def test_empty(spark):
    assert flags(spark, []) == {}


def test_forward_backward_is_exact():
    """Blocks with margins give what one pass over each segment gives."""
    r = np.random.default_rng(1)
    n = 700
    emit = r.random((n, 4)) ** 4 + 1e-9
    lo = np.zeros(n, int)
    lo[300:] = 300
    prior = np.array([1 - P.ENTER_SPIKE - 2 * P.ENTER_STUCK, P.ENTER_SPIKE, P.ENTER_STUCK, P.ENTER_STUCK])
    move = np.tile(prior, (4, 1))
    move[P.STUCK] = prior * (1 - P.STAY_STUCK)
    move[P.STUCK, P.STUCK] += P.STAY_STUCK
    want = np.empty((n, 4))
    for a, z in ((0, 300), (300, n)):
        f, fw = None, []
        for t in range(a, z):
            f = (prior if f is None else f @ move) * emit[t]
            f /= f.sum()
            fw.append(f)
        g = np.ones(4)
        for t in range(z - 1, a - 1, -1):
            p = fw[t - a] * g
            want[t] = p / p.sum()
            g = move @ (emit[t] * g)
            g /= g.sum()
    assert abs(P.forward_backward(emit, lo) - want).max() < 0.02
