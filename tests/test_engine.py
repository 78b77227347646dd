"""Operators on published vectors, the expression language, the time base, streams and sources."""

import datetime as dt
import json
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tickloom import bars as B
from tickloom import registry
from tickloom.bars import BarSet
from tickloom.functions import kernels as K
from tickloom.plans import ir
from tickloom.plans.compile import analyze, evaluate, evaluate_split, recent, triggers, validate
from tickloom.plans.parser import ExpressionError, parse
from tickloom.plans.planner import plan
from tickloom.sources import csv, records
from tickloom.streaming.expressions import ExpressionStream
from tickloom.streaming.stream import Node, Stepper, Stream, indicators

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "symbol string, timeframe string, source string, ts timestamp, open double, high double, low double, close double, volume double"


def hours(i):
    return T0 + dt.timedelta(hours=i)


def frame(spark, close, high=None, low=None, volume=None, symbol="X"):
    n = len(close)
    high, low, volume = high or close, low or close, volume or [1.0] * n
    f = lambda v: None if v is None else float(v)
    return spark.createDataFrame([(symbol, "1h", "ohlcv", hours(i), f(close[i]), f(high[i]), f(low[i]), f(close[i]), f(volume[i])) for i in range(n)], SCHEMA)


def values(df, column, places=6):
    rows = sorted(df.collect(), key=lambda r: r.ts)
    return [None if r[column] is None else round(float(r[column]), places) for r in rows]


def op(spark, name, close, column=None, **params):
    return values(registry.apply(frame(spark, close), name, **params), column or name)


_ = None
VECTORS = [
    ("rolling_sum", {"period": 3}, [1, 2, 3, 4, 5], [_, _, 6, 9, 12]),
    ("rolling_mean", {"period": 3}, [1, 2, 3, 4, 5], [_, _, 2, 3, 4]),
    ("rolling_std", {"period": 4}, [2, 4, 4, 6], [_, _, _, 1.414214]),
    ("ema", {"period": 3}, [1, 2, 3], [1, 1.5, 2.25]),
    ("rolling_min", {"period": 2}, [5, 3, 4, 2], [_, 3, 3, 2]),
    ("rolling_max", {"period": 2}, [5, 3, 4, 2], [_, 5, 4, 4]),
    ("rolling_argmax", {"period": 3}, [1, 3, 2, 4, 3], [_, _, 1, 0, 1]),
    ("rolling_argmin", {"period": 3}, [5, 3, 4, 2, 3], [_, _, 1, 0, 1]),
    ("rolling_argmax", {"period": 2}, [4, 4, 4], [_, 0, 0]),
    ("rolling_median", {"period": 4}, [4, 1, 3, 2], [_, _, _, 3]),
    ("rolling_mean", {"period": 2}, [102, 106, 110, 114], [_, 104, 108, 112]),
    ("rolling_mean", {"period": 2}, [1, _, 3, 4], [_, _, _, 3.5]),
    ("wma", {"period": 3}, [1, 2, 4], [_, _, 17 / 6]),
    ("change_pct", {"periods": 1}, [0, 5, 10], [_, _, 100]),
    ("roc", {"period": 2}, [1, 2, 3], [_, _, 200]),
    ("shift", {"periods": 1}, [1, 2, 3], [_, 1, 2]),
    ("shift", {"periods": -1}, [1, 2, 3], [2, 3, _]),
    ("shift_clamped", {"periods": 2}, [1, 2, 3], [1, 1, 1]),
    ("shift_clamped", {"periods": -1}, [1, 2, 3], [2, 3, 3]),
    ("sign", {}, [1, 3, 3, 2], [_, 1, 0, -1]),
    ("rsi", {"period": 2}, [1, 1, 1, 1], [_, _, 50, 50]),
    ("williams_r", {"period": 2}, [1, 1, 1], [_, 0, 0]),
    ("cumulative_sum", {}, [1, 2, 3], [1, 3, 6]),
    ("rising", {}, [1, 2, 2, 1], [0, 1, 0, 0]),
    ("rolling_mean", {"period": 3}, [1, 2], [_, _]),
    ("ema", {"period": 3}, [_, 1, _, 2], [_, 1, _, 1.5]),
]


@pytest.mark.parametrize("name,params,given,want", VECTORS)
def test_vectors(spark, name, params, given, want):
    assert op(spark, name, given, **params) == [None if w is None else round(w, 6) for w in want]


CLOSE = [1, 2, 3, 4, 3.5, 4.2, 5, 5.2, 5.8, 6.1]
HIGH = [1.1, 2.2, 3.1, 4.2, 3.7, 4.5, 5.1, 5.6, 6.0, 6.3]
LOW = [0.9, 1.8, 2.7, 3.8, 3.2, 3.9, 4.7, 4.9, 5.4, 5.8]
VOLUME = [100, 120, 110, 150, 90, 180, 160, 170, 155, 165]
PARITY = [
    ("rma p=3", "rma", {"period": 3}, "rma"),
    ("rsi p=3", "rsi", {"period": 3}, "rsi"),
    ("true_range", "true_range", {}, "true_range"),
    ("atr p=3", "atr", {"period": 3}, "atr"),
    ("macd 2/4/2 line", "macd", {"fast": 2, "slow": 4, "signal": 2}, "macd_macd"),
    ("macd signal", "macd", {"fast": 2, "slow": 4, "signal": 2}, "macd_signal"),
    ("macd histogram", "macd", {"fast": 2, "slow": 4, "signal": 2}, "macd_histogram"),
    ("adx p=3", "adx", {"period": 3}, "adx_adx"),
    ("plus_di p=3", "adx", {"period": 3}, "adx_plus_di"),
    ("minus_di p=3", "adx", {"period": 3}, "adx_minus_di"),
    ("psar sar .02/.02/.2", "psar", {}, "psar_sar"),
    ("psar direction", "psar", {}, "psar_direction"),
    ("supertrend 3/3.0", "supertrend", {"period": 3}, "supertrend_supertrend"),
    ("supertrend 3/3.0 direction", "supertrend", {"period": 3}, "supertrend_direction"),
    ("supertrend 3/1.0", "supertrend", {"period": 3, "multiplier": 1.0}, "supertrend_supertrend"),
    ("fisher p=3", "fisher", {"period": 3}, "fisher_fisher"),
    ("fisher signal", "fisher", {"period": 3}, "fisher_signal"),
    ("elder_ray p=3 bull", "elder_ray", {"period": 3}, "elder_ray_bull"),
    ("keltner 3/3/2 upper", "keltner", {"ema_period": 3, "atr_period": 3}, "keltner_upper"),
    ("obv", "obv", {}, "obv"),
    ("vwap", "vwap", {}, "vwap"),
    ("klinger_vf", "klinger_vf", {}, "klinger_vf"),
    ("klinger 2/4/2", "klinger", {"fast": 2, "slow": 4, "signal": 2}, "klinger_klinger"),
    ("klinger signal", "klinger", {"fast": 2, "slow": 4, "signal": 2}, "klinger_signal"),
]


def _published():
    text = (Path(__file__).resolve().parents[1] / "FIXTURES.md").read_text()
    return {m[1].strip(): [None if x.strip() == "_" else float(x) for x in m[2].split(",")] for m in re.finditer(r"^\| ([^|]+) \| ((?:[-0-9._]+, )+[-0-9._]+) \|$", text, re.M)}


@pytest.mark.parametrize("label,name,params,column", PARITY)
def test_parity_vectors(spark, label, name, params, column):
    got = values(registry.apply(frame(spark, CLOSE, HIGH, LOW, VOLUME), name, **params), column)
    want = _published()[label]
    assert [x is None for x in got] == [x is None for x in want]
    assert all(a is None or abs(a - b) < 2e-6 for a, b in zip(got, want))


def test_keys_do_not_mix_and_order_of_rows_does_not_matter(spark):
    rnd = random.Random(3)
    a, b = ([rnd.uniform(1, 9) for _ in range(50)] for _ in "ab")
    both = frame(spark, a, symbol="A").unionByName(frame(spark, b, symbol="B")).orderBy(F.rand(1)).repartition(3)
    for name, column in (("ema", "ema"), ("rolling_std", "rolling_std"), ("fib_retracement", "fib_retracement_anchor_high"), ("rsi", "rsi")):
        got = registry.apply(both, name)
        for s, x in (("A", a), ("B", b)):
            assert values(got.where(F.col("symbol") == s), column) == values(registry.apply(frame(spark, x), name), column)


def test_swings(spark):
    high = [1, 2, 5, 2, 1, 2, 6, 2, 1, 1, 1]
    low = [5, 4, 4, 3, 1, 3, 4, 4, 4, 0, 4]
    df = frame(spark, high, high, low)
    assert [bool(x) for x in values(registry.apply(df, "swing_highs"), "swing_highs")] == [i in (4, 8) for i in range(11)]
    assert values(registry.apply(df, "swing_lows", return_mode="levels"), "swing_lows") == [1.0 if i == 6 else None for i in range(11)]
    assert values(registry.apply(df, "swing_high_at", index=2), "swing_high_at") == [None] * 8 + [5.0] * 3
    # two equal highs: none, unless allowed
    flat = frame(spark, [1, 3, 3, 1, 0, 0])
    assert not any(values(registry.apply(flat, "swing_highs", left=1, right=1), "swing_highs"))
    assert any(values(registry.apply(flat, "swing_highs", left=1, right=1, allow_equal_extremes=True), "swing_highs"))


def legs_brute(pivots, n, leg, strict, min_pct, max_age):
    """All legs built anew at each row."""
    out = []
    for row in range(n):
        seen = [p for p in pivots if p[0] <= row]
        both = []
        for way in ("down", "up"):
            legs = []
            if strict:
                alt = []
                for p in seen:
                    if alt and alt[-1][1] == p[1]:
                        if (p[2] >= alt[-1][2]) if p[1] else (p[2] <= alt[-1][2]):
                            alt[-1] = p
                    else:
                        alt.append(p)
                pairs = [(x, y) for x, y in zip(alt, alt[1:]) if y[1] == (way == "down")]
            else:
                pairs, other = [], None
                for p in seen:
                    if p[1] != (way == "down"):
                        other = p
                    elif other is not None:
                        pairs.append((other, p))
            for x, y in pairs:
                hi, lo = (y[2], x[2]) if y[1] else (x[2], y[2])
                if y[0] > x[0] and hi > lo and (min_pct is None or abs(y[2] - x[2]) / abs(x[2]) * 100 >= min_pct):
                    legs.append((hi, lo, y[0]))
            g = legs[-leg] if len(legs) >= leg else None
            both.append(g if g and (max_age is None or row - g[2] <= max_age) else None)
        out.append(both)
    return out


@pytest.mark.parametrize("pairing", ["strict_alternating", "latest_valid"])
@pytest.mark.parametrize("leg,min_pct,max_age", [(1, None, None), (2, None, 12), (1, 20.0, None), (3, 5.0, 30)])
def test_fibonacci_legs(pairing, leg, min_pct, max_age):
    from tickloom.functions.pattern import Legs

    rnd = random.Random(leg)
    n = 200
    hi = [rnd.randrange(5, 15) * 1.0 if rnd.random() < 0.2 else None for _ in range(n)]
    lo = [rnd.randrange(1, 12) * 1.0 if rnd.random() < 0.2 else None for _ in range(n)]
    pivots = [p for i in range(n) for p in ((i, True, hi[i]), (i, False, lo[i])) if p[2] is not None]
    want = legs_brute(pivots, n, leg, pairing == "strict_alternating", min_pct, max_age)
    k = Legs(leg, pairing, max_age, min_pct)
    s = k.start()
    for i in range(n):
        got = k.advance(s, hi[i], lo[i])
        s = json.loads(json.dumps(s))
        assert [None if got[j] is None else tuple(got[j : j + 3]) for j in (0, 3)] == want[i], i


# the language

CORPUS = """sma(close, 12)|sma(12)|sma(close, period=3 * 4)|ema(close, 5) >= ema(close, 8)|rsi(price, 9) < 25|rsi(hl2, 9)|not (low >= open)|+close - -open|wma(ema(close, 4), 6)|hma(high, 9)
trades.max(price)|trades.filter(amount >= 7).min(price)|trades.avg(amount) != ohlcv.volume|orderbook.imbalance > 0.2|liquidation.filter(long_count > 2).count()|ohlcv.filter(close > open).avg(volume)|sma(orderbook.spread_bps, 4)
low < open <= high|(close - open) / (high - low) ** 2|volume % 3 == 0|close.change_12h > 0|close.change_pct_3h|volume.ago('6h')|close.change(2)
keltner(10, 5, 1.5).lower < low|ichimoku().tenkan_sen > ichimoku().kijun_sen|adx(7).plus_di > adx(7).minus_di and adx(7).adx > 20|supertrend(7, 2).direction == 1|psar().sar < close
crossup(ema(close, 3), ema(close, 9)) or crossdown(rsi(5), 50)|in_channel(close, donchian(5).upper, donchian(5).lower)|swing_high_at(1, 2, 2) > close|fib_level_down(0.5) < close|rolling_argmax(high, 5) == 0|abs(diff(close)) > 2 * rolling_std(close, 10)"""
TEXTS = [t for line in CORPUS.split("\n") for t in line.split("|")]


def test_corpus():
    assert len(TEXTS) == 35
    for t in TEXTS:
        assert validate(t) == [], t
        assert ir.loads(ir.dumps(parse(t))) == parse(t)


@pytest.mark.parametrize("text", ["sma(close, -2)", "trades.filter(7)", "trades.sum('nothing')", "somewhere.AB.ohlcv.close > 1", "sma(close, 2.5)", "nope(3)", "close +", "close.upper", "sma(close, 3, 4)", "sma(close, period=3, lookback=4)", "trades + 1", "'a' * 2", "(close > 1) + 2", "[1]", "lambda: 1", "sma(**x)", "macd(close, 26, 12, 9) > 0"])
def test_rejected(spark, text):
    if validate(text):
        return
    with pytest.raises((ExpressionError, ValueError)):
        evaluate(frame(spark, [1.0, 2.0]), text)


def test_folding_and_requirements():
    assert parse("sma(close, 5 + 5)") != plan("sma(close, 10)").root
    assert plan("sma(close, 5 + 5)").hash == plan("sma(price, 10)").hash
    assert plan("2 * 3 + 1").root == ir.Literal(7.0)
    assert plan("(close > 1) and True").root == plan("close > 1").root
    assert plan("(close > 1) or True").root == ir.Literal(True)
    assert analyze("rma(tr(), period=14) > 50")["lookback"] == {"ohlcv.close": 15, "ohlcv.high": 15, "ohlcv.low": 15}
    assert analyze("sma(sma(close, 3), 5)")["lookback"] == {"ohlcv.close": 7} and analyze("sma(close, 3)")["bounded"]
    assert len(plan("sma(close, 3) > sma(close, 3) * 2").nodes) == len(plan("sma(close, 3) > 2 * 1.0").nodes) + 1
    assert "->" in ir.Graph.of(parse("close + open")).to_dot()


def test_meaning(spark):
    df = frame(spark, [1, 2, 4, None, 8], [2, 2, 5, 5, 8], [0, 2, 3, 3, 8])
    def ev(t):
        return values(evaluate(df, t), "value")

    assert ev("close / (high - low)") == [0.5, 0.0, 2.0, None, 0.0]
    assert ev("close % (high - low)") == [1.0, None, 0.0, None, None]
    assert ev("close > 2") == [0, 0, 1, 0, 1] and ev("close != 2") == [1, 0, 1, 1, 1]
    assert ev("not close") == [0, 0, 0, 1, 0]
    assert ev("close.filter(close > 1)") == [None, 2, 4, None, 8]
    assert ev("close.filter(close > 1).sum()") == [14.0] * 5 and ev("close.count()") == [4.0] * 5 and ev("close.filter(close > 99).sum()") == [0.0] * 5
    assert ev("1 < close < 8") == [0, 1, 1, 0, 0]
    assert ev("close.change_2h") == [None, None, 3, None, 4] and ev("close.ago('1h')") == [None, 1, 2, 4, None]
    assert ev("crossup(close, 3)") == [0, 0, 1, 0, 0]
    assert ev("-close + 1") == [0, -1, -3, None, -7]
    assert ev("bbands(close, 2).middle") == ev("sma(2)")
    assert [r.close for r in triggers(df, "close > 2").orderBy("ts").collect()] == [4.0, 8.0]
    with pytest.raises(ValueError):
        evaluate(df, "nothing > 1")
    last = values(evaluate(recent(df, plan("sma(close, 2)")), "sma(close, 1)"), "value")
    assert len(last) == 2


def test_side_series(spark):
    bars = frame(spark, [10, 11, 12])
    trades = bars.select("symbol", "timeframe", F.lit("trades").alias("source"), "ts", (F.col("close") * 10).alias("amount"), F.col("close").alias("price"))
    both = BarSet(bars, trades=trades.where(F.col("price") > 10))
    assert values(evaluate(both, "trades.filter(amount > 110).sum(price)"), "value") == [12.0] * 3
    assert values(evaluate(both, "sma(trades.amount, 2)"), "value") == [None, None, 115.0]
    assert both.where(symbol="Y").bars.count() == 0 and both.info().collect()[0].n == 3


def test_one_exchange_for_many_windows(spark):
    p = evaluate(frame(spark, [1.0] * 5), a="sma(close, 3) > sma(close, 5)", b="bbands(close, 3).upper", c="cci(4)")._jdf.queryExecution().executedPlan().toString()
    assert p.count("Exchange hashpartitioning") == 1 and "Python" not in p
    q = evaluate(frame(spark, [1.0] * 5), a="ema(3) > ema(5)", b="rsi(4)", c="macd().signal")._jdf.queryExecution().executedPlan().toString()
    assert q.count("MapInPandas") + q.count("PythonMapInArrow") <= 1


BOUNDED = ["sma(close, 7)", "rolling_median(9)", "wma(70)", "hma(9)", "bbands(5).upper", "ichimoku(3, 5, 9, 4).senkou_span_b", "ichimoku(3, 5, 9, 4).chikou_span", "stochastic(5, 3, 2).d", "cci(6)", "roc(5)", "williams_r(5)", "cmo(5)", "ao(3, 8)", "coppock(4, 5, 7)", "mfi(5)", "vortex(5).plus", "donchian(5).middle", "cmf(5)", "klinger_vf()", "true_range()", "crossup(close, sma(close, 5))", "rising(close)", "swing_highs(2, 2)", "rolling_argmin(6)", "close.ago('9h')", "sign(close)"]


def test_keys_cut_into_pieces(spark):
    rnd = random.Random(8)
    c = [rnd.uniform(10, 20) for _ in range(300)]
    v = [rnd.uniform(1, 5) for _ in range(300)]
    df = frame(spark, c, [x + rnd.random() for x in c], [x - rnd.random() for x in c], v).unionByName(frame(spark, v[:40], symbol="Y"))
    named = {f"v{i}": t for i, t in enumerate(BOUNDED)}
    rounded = lambda d: sorted(tuple(round(x, 8) if isinstance(x, float) else x for x in r) for r in d.select("symbol", F.col("ts").cast("string"), *[F.coalesce(F.col(n).cast("double"), F.lit(-9e9)) for n in named]).collect())
    assert rounded(evaluate_split(df, 80, **named)) == rounded(evaluate(df, **named))
    for text in ("psar()", "obv()", "close.sum()", "swing_lows(2, 2)", "supertrend(3)", "ema(obv(), 3)"):
        with pytest.raises(ExpressionError):
            evaluate_split(df, 80, v=text)
    with pytest.raises(ValueError):
        evaluate_split(df, 5, v="sma(close, 9)")


FORGETTING = ["ema(3)", "rma(2)", "macd(2, 4, 3).histogram", "rsi(3)", "atr(3)", "adx(2).adx", "keltner(3, 2).upper", "klinger(2, 4, 3).signal", "elder_ray(3).bull", "sma(ema(3), 4) - rsi(2).ago('2h')"]


def test_recurrences_of_one_key_in_pieces(spark):
    """One key, cut into pieces that run in many tasks, gives what the whole key gives."""
    rnd = random.Random(9)
    c = [rnd.uniform(10, 20) for _ in range(3000)]
    df = frame(spark, c, [x + rnd.random() for x in c], [x - rnd.random() for x in c], [rnd.uniform(1, 5) for _ in c])
    named = {f"v{i}": t for i, t in enumerate(FORGETTING)}
    split, whole = (sorted([tuple(r) for r in d.select(F.col("ts").cast("string"), *named).collect()]) for d in (evaluate_split(df, 500, **named), evaluate(df, **named)))
    assert len(split) == len(whole) == 3000
    for a, b in zip(split, whole):
        assert a[0] == b[0] and [x is None for x in a] == [x is None for x in b]
        assert [x or 0.0 for x in a[1:]] == pytest.approx([x or 0.0 for x in b[1:]], rel=1e-10, abs=1e-10)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = evaluate_split(df, 500, v="ema(3)").withColumn("task", F.spark_partition_id()).select("task").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.task for r in tasks}) > 1
    with pytest.raises(ValueError):
        evaluate_split(df, 80, v="ema(20)")


# registry


def test_registry(spark):
    assert registry.find("SMA").name == "rolling_mean" and registry.find("bb").name == "bbands"
    assert len(registry.names()) >= 75 and registry.catalog(spark).count() == len(registry.names())
    for bad in ({"period": 0}, {"period": "x"}, {"perioid": 3}, {"period": 3, "lookback": 4}):
        with pytest.raises(ValueError):
            registry.find("sma").bind((), bad)
    assert registry.find("sma").bind((), {"lookback": "7"})["period"] == 7

    @registry.register("twice", (), source="close")
    def twice(b, source="close"):
        return b.field(source) * 2

    try:
        assert op(spark, "twice", [1, 2]) == [2, 4]
        assert values(evaluate(frame(spark, [1, 2]), "twice(close) + 1"), "value") == [3, 5]
        with pytest.raises(ValueError):
            registry.register("twice")(twice)
    finally:
        registry.unregister("twice")


# time base


def test_time_base(spark):
    df = frame(spark, [10, 20, 30, 40, 50])
    got = {h: values(B.downsample(df, 2, h), "close") for h in B.AGGREGATES}
    assert got == {"last": [20, 40, 50], "mean": [15, 35, 50], "sum": [30, 70, 50], "first": [10, 30, 50], "max": [20, 40, 50], "min": [10, 30, 50]}
    assert [r.ts.hour for r in B.downsample(df, 2).orderBy("ts").collect()] == [1, 3, 4]
    assert values(B.upsample(df.where("close <= 30"), 3), "close") == [10] * 3 + [20] * 3 + [30]
    src = spark.createDataFrame([("X", hours(h), float(v)) for h, v in ((10, 1), (20, 3), (30, 5))], "symbol string, ts timestamp, value double")
    ref = spark.createDataFrame([("X", hours(h)) for h in (5, 10, 15, 20, 25, 35)], "symbol string, ts timestamp")
    assert values(B.sync(src, ref), "value") == [1, 1, 1, 3, 3, 5]
    assert values(B.sync(src, ref, how="linear"), "value") == [1, 1, 2, 3, 4, 5]
    assert values(B.sync(src.limit(0), ref), "value") == [0.0] * 6
    assert values(B.trim(df, 3), "close") == [40, 50]
    for bad in (lambda: B.downsample(df, 0), lambda: B.sync(src, ref, how="x"), lambda: B.resample(df, "4h", "1h"), lambda: B.resample(df, "2h", "3h"), lambda: B.align(df, df, "cross")):
        with pytest.raises(ValueError):
            bad()
    a = spark.createDataFrame([("X", "1h", hours(h), float(h)) for h in (1, 2)], "symbol string, timeframe string, ts timestamp, value double")
    b = spark.createDataFrame([("X", "1h", hours(h), float(h)) for h in (2, 3)], "symbol string, timeframe string, ts timestamp, value double")
    assert [(r.left, r.right) for r in B.align(a, b, "outer", "ffill", seed_right=9.0).orderBy("ts").collect()] == [(1, 9), (2, 2), (2, 3)]
    problems = B.append_problems(df, frame(spark, [1.0]).unionByName(frame(spark, [1.0], symbol="")))
    assert {(r.symbol, r.problem) for r in problems.collect()} == {("X", "before the last row"), ("", "empty key")}


# streams


def walk(n=60):
    r = random.Random(4)
    out, c = [], 100.0
    for i in range(n):
        c += r.uniform(-2, 2)
        out.append({"symbol": "X", "timeframe": "1h", "source": "ohlcv", "ts": hours(i), "open": c, "high": c + 1, "low": c - 1, "close": c + 0.5, "volume": 10.0 + i, "is_closed": True})
    return out


NODES = (Node("r", "rsi", (5,)), Node("m", "macd", (3, 6, 2)), Node("a", "atr", (4,)), Node("s", "supertrend", (4, 2.0)), Node("v", "vwap"), Node("k", "stoch_k", (5,)), Node("x", "adx", (4,)))


def test_snapshot_and_replay_go_on(spark):
    rows = walk()
    one = Stepper(*NODES)
    all_ = [one.step(b) for b in rows]
    half = Stepper(*NODES)
    for b in rows[:25]:
        half.step(b)
    assert Stepper(*NODES).replay(half.snapshot(), rows[25:]) == all_[25:]
    batch = registry.apply(spark.createDataFrame(rows), "rsi", period=5)
    assert values(batch, "rsi") == [None if r["r"] is None else round(r["r"], 6) for r in all_]
    with pytest.raises(ValueError):
        half.restore('{"schema_version": 2}')
    with pytest.raises(ValueError):
        Node("z", "hma").kernel()


def test_missing_inputs():
    bar = {"close": None}
    s = Stepper(Node("e", "ema", (2,)), missing="hold")
    s.step({"close": 4.0})
    assert s.step(bar) == {"e": 4.0} and Stepper(Node("e", "ema", (2,))).step(bar) == {"e": None}
    with pytest.raises(ValueError):
        Stepper(Node("e", "ema", (2,)), missing="fail").step(bar)


def test_stream_of_single_bars():
    s, seen = Stream(), []
    s.register("r", "rsi", 3)
    s.on_transition(lambda name, key, bar: seen.append((name, bar["ts"])))
    out = [s.update(b)["r"] for b in walk(6)]
    assert [v is None for v in out] == [True] * 3 + [False] * 3 and seen == [("r", hours(3))]
    with pytest.raises(ValueError):
        s.update(walk(1)[0])


def test_structured_stream_equals_batch(spark, tmp_path):
    rows = walk(45)
    extra = [dict(b, symbol="Y", close=b["close"] * 2) for b in rows]
    df = spark.createDataFrame(rows + extra)
    for i in range(3):
        df.where((F.hour("ts") + F.dayofmonth("ts") * 24 - 24).between(i * 15, i * 15 + 14)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    nodes = (Node("r", "rsi", (5,)), Node("e", "ema", (4,)))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = indicators(stream, *nodes).writeStream.format("memory").queryName("out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.symbol, r.ts): (r.r, r.e) for r in spark.table("out").collect()}
    batch = {(r.symbol, r.ts): (r.rsi, r.ema) for r in registry.apply(registry.apply(df, "rsi", period=5), "ema", period=4).collect()}
    assert len(got) == 90 and got.keys() == batch.keys()
    for k in got:
        assert [x or 0.0 for x in got[k]] == pytest.approx([x or 0.0 for x in batch[k]], abs=1e-9)


def test_expressions_on_a_stream(spark, tmp_path):
    """Micro-batches that hand on what they remember give what the batch gives; one run again gives it once."""
    df = spark.createDataFrame(walk(60) + [dict(b, symbol="Y", close=b["close"] * 2) for b in walk(40)])
    texts = {"a": "rsi(3) > 50 and sma(close, 4) < close", "b": "macd(2, 4, 3).histogram", "c": "close.ago('2h') - low", "d": "obv()", "e": "psar().sar"}
    bounded = {k: texts[k] for k in "abc"}
    for i, named in enumerate((bounded, texts)):
        s = ExpressionStream(spark, f"file://{tmp_path}/{i}")
        for k, t in named.items():
            s.register(k, t)
        assert (s.memory is None) == (i == 1)
        at = (F.hour("ts") + F.dayofmonth("ts") * 24 - 24)
        for epoch, (lo, hi) in enumerate(((0, 9), (10, 30), (31, 60))):
            part = df.where(at.between(lo, hi))
            s.advance(part, epoch)
            s.advance(part.unionByName(df.where(at == 5)) if epoch else part, epoch)  # replayed, with a late bar
        got, want = ({(r.symbol, r.ts): r for r in d.collect()} for d in (s.results(), evaluate(df, **named)))
        assert got.keys() == want.keys() and s.results().count() == 100
        for k, r in got.items():
            for c in named:
                if c != "e":  # the first side of the SAR looks a bar ahead
                    assert (r[c] or 0.0) == pytest.approx(want[k][c] or 0.0, abs=1e-9), (k, c)
    with pytest.raises(ValueError):
        s.register("a", "close")
    with pytest.raises(ValueError):
        s.register("z", "nothing(3)")


def test_shifts_in_time(spark):
    df = frame(spark, list(range(1, 13)))
    four = df.withColumn("timeframe", F.lit("4h"))
    assert values(evaluate(four, "close.ago('8h')", timeframe="4h"), "value")[:4] == [None, None, 1.0, 2.0]
    assert values(evaluate(four, "close.change_1d", timeframe="4h"), "value")[6] == 6.0
    assert values(evaluate(four, "close.ago('8h')"), "value")[8] == 1.0  # without a timeframe, bars
    with pytest.raises(ExpressionError):
        evaluate(four, "close.ago('6h')", timeframe="4h")


def test_checked_appends_and_strict_alignment(spark):
    a, z = frame(spark, [1.0, 2.0]), frame(spark, [3.0]).withColumn("ts", F.expr("ts + interval 5 hours"))
    assert B.append(a, z, check=True).count() == 3
    with pytest.raises(ValueError, match="before the last row"):
        B.append(z, a, check=True)
    series = lambda d: d.select("symbol", "timeframe", "ts", F.col("close").alias("value"))
    assert B.align(series(a), series(z), "outer").count() == 3
    with pytest.raises(Exception, match="no value at"):
        B.align(series(a), series(z), "outer", strict=True).collect()


def test_instants_of_long_numbers(spark):
    from tickloom.schema import to_instant

    us = 1_704_067_200_123_457
    df = spark.createDataFrame([(t,) for t in (f"{us}789", str(us), f"{us / 1e6:.6f}", "1704067200", "1.7040672e9", "never")], "t string")
    assert [r[0] for r in df.select(F.unix_micros(to_instant(F.col("t")))).collect()] == [us, us, us, us // 10**6 * 10**6, us // 10**6 * 10**6, None]


# sources


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp,o,high,low,close,volume,closed\n2024-01-01T00:00:00Z,1,2,0.5,1.5,10,TRUE\n1704070800,1,2,0.5,,10,no\n")
    df = csv.read_csv(spark, str(tmp_path / "a.csv"), "X", "1h", open="o")
    assert [(r.ts.hour, r.close, r.is_closed) for r in df.orderBy("ts").collect()] == [(0, 1.5, True), (1, None, False)]
    csv.write_csv(df, str(tmp_path / "out"))
    again = csv.read_csv(spark, str(tmp_path / "out"), "X", "1h")
    assert sorted(again.collect()) == sorted(df.collect())
    (tmp_path / "b.csv").write_text("ts,value\n2024-01-01,3\nnever,4\n")
    with pytest.raises(Exception, match="no time"):
        csv.read_csv(spark, str(tmp_path / "b.csv"), "X", "1h").collect()
    (tmp_path / "c.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        csv.read_csv(spark, str(tmp_path / "c.csv"), "X", "1h")


def test_records(spark):
    df = records.from_bars(spark, [{"timestamp": 1704067200, "o": 1, "h": "2", "l": 0.5, "c": float("nan")}], "X", "1h")
    r = df.collect()[0]
    assert (r.ts.year, r.high, r.close, r.volume, r.is_closed) == (2024, 2.0, None, 0.0, True)
    assert records.from_json(records.to_json(df)).collect() == df.collect()
    assert records.points(df, "high").collect()[0].point == '{"time":"2024-01-01T00:00:00Z","value":2.0}' and records.points(df, "close").count() == 0
    with pytest.raises(ValueError, match="no volume"):
        records.side_series(spark, "trades", [{"ts": 1}], "X", "1h")
    for v in ("2024-01-01T00:00:00Z", 1704067200, 1704067200000, 1704067200000000, dt.date(2024, 1, 1), "1704067200"):
        assert records.instant(v) == T0


def test_kernel_protocol():
    s, out = K.ema(3).run(None, [[1.0, 2.0, 3.0, 5.0]], 4, [0, 3])
    assert [v.tolist() for v in out] == [[1.0, 1.5, 2.25, 5.0]]
