"""The operators, as functions from a builder and parameters to columns.

Each one is registered with its name, aliases, parameters and outputs. Those over finite or
cumulative windows are Catalyst expressions; those that need their own last
value run as kernels in one ordered scan.

Null is the only missing value: a windowed result is null until its window is full of
values; divisions by zero give what each operator defines, never an error.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions import kernels as K
from tickloom.functions.build import Build
from tickloom.registry import register

Source = str | Column


def _p(p: int) -> int:
    return K.period(p)


def safe_div(a: Column, b: Column, zero: Column | float | None = None) -> Column:
    """a / b, and ``zero`` where b is 0."""
    z = F.lit(zero).cast("double") if not isinstance(zero, Column) else zero
    return F.when(b == 0, z).otherwise(a / F.nullif(b, F.lit(0.0)))


def both(a: Column, b: Column, value: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), value)


# rolling windows


def _rolling(fn):
    def op(b: Build, period: int = 20, source: Source = "close") -> Column:
        x = b.let(b.field(source))
        return b.warm(x, _p(period), fn(b, x, period))

    return op


def _bars_since(b: Build, x: Column, p: int, sign: int) -> Column:
    at = F.max_by(b.rn, F.struct(x * sign, b.rn)).over(b.over(p))
    return (b.rn - at).cast("double")


rolling_sum = register("rolling_sum", ("sum",), period=20, source="close")(_rolling(lambda b, x, p: F.sum(x).over(b.over(p))))
rolling_mean = register("rolling_mean", ("mean", "average", "avg", "sma"), period=20, source="close")(_rolling(lambda b, x, p: F.avg(x).over(b.over(p))))
rolling_std = register("rolling_std", ("std", "stddev"), period=20, source="close")(_rolling(lambda b, x, p: F.stddev_pop(x).over(b.over(p))))
rolling_max = register("rolling_max", ("max",), period=20, source="close")(_rolling(lambda b, x, p: F.max(x).over(b.over(p))))
rolling_min = register("rolling_min", ("min",), period=20, source="close")(_rolling(lambda b, x, p: F.min(x).over(b.over(p))))
rolling_argmax = register("rolling_argmax", ("argmax",), period=20, source="close")(_rolling(lambda b, x, p: _bars_since(b, x, p, 1)))
rolling_argmin = register("rolling_argmin", ("argmin",), period=20, source="close")(_rolling(lambda b, x, p: _bars_since(b, x, p, -1)))
#: the upper of the two middle values
rolling_median = register("rolling_median", ("median", "med"), period=20, source="close")(_rolling(lambda b, x, p: F.get(F.array_sort(F.collect_list(x).over(b.over(p))), F.lit(p // 2))))


@register("wma", ("rolling_wma",), period=14, source="close")
def wma(b: Build, period: int = 14, source: Source = "close") -> Column:
    p = _p(period)
    x = b.let(b.field(source))
    if p <= 64:
        lags = [F.lag(x, k).over(b._spec) for k in range(1, p)]
        total = sum((lg * float(p - k) for k, lg in enumerate(lags, 1)), x * float(p))
    else:  # the rows of the window as one array
        rows = F.collect_list(x).over(b.over(p))
        total = F.aggregate(F.zip_with(rows, F.sequence(F.lit(1), F.lit(p)), lambda v, k: v * k), F.lit(0.0), lambda acc, v: acc + v)
    return b.warm(x, p, total / F.lit(p * (p + 1) / 2.0))


@register("hma", (), period=14, source="close")
def hma(b: Build, period: int = 14, source: Source = "close") -> Column:
    half, full = wma(b, max(1, _p(period) // 2), source), wma(b, period, source)
    return wma(b, max(1, math.isqrt(period)), b.let(half * 2.0 - full))


@register("ema", ("rolling_ema",), period=20, source="close")
def ema(b: Build, period: int = 20, source: Source = "close") -> Column:
    return b.scan(K.ema(period), source)[0]


@register("rma", ("rolling_rma",), period=14, source="close")
def rma(b: Build, period: int = 14, source: Source = "close") -> Column:
    return b.scan(K.rma(period), source)[0]


# element by element


@register("cumulative_sum", ("cumsum",), source="close")
def cumulative_sum(b: Build, source: Source = "close") -> Column:
    return b.let(F.sum(b.field(source)).over(b.so_far))


@register("diff", (), source="close")
def diff(b: Build, source: Source = "close") -> Column:
    x = b.field(source)
    return b.let(x - b.lag(x))


@register("shift", ("ago",), periods=1, source="close")
def shift(b: Build, periods: int = 1, source: Source = "close") -> Column:
    return b.lag(b.field(source), periods)


@register("shift_clamped", (), periods=1, source="close")
def shift_clamped(b: Build, periods: int = 1, source: Source = "close") -> Column:
    """Shifted, the edges held."""
    x = b.let(b.field(source))
    w = b.everything
    edge = F.first(x).over(w) if periods >= 0 else F.last(x).over(w)
    return b.let(F.when(b.rn > periods, b.lag(x, periods)).otherwise(edge) if periods >= 0 else F.coalesce(b.lag(x, periods), edge))


@register("change", (), periods=1, source="close")
def change(b: Build, periods: int = 1, source: Source = "close") -> Column:
    x = b.let(b.field(source))
    return b.let(x - b.lag(x, periods))


@register("change_pct", ("roc_pct",), periods=1, source="close")
def change_pct(b: Build, periods: int = 1, source: Source = "close") -> Column:
    x = b.let(b.field(source))
    y = b.lag(x, periods)
    return b.let(safe_div((x - y) * 100.0, y))


@register("abs", (), source="close")
def absolute(b: Build, source: Source = "close") -> Column:
    return F.abs(b.field(source))


@register("positive_values", ("positive", "pos"), source="close")
def positive_values(b: Build, source: Source = "close") -> Column:
    x = b.field(source)
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


@register("negative_values", ("negative", "neg"), source="close")
def negative_values(b: Build, source: Source = "close") -> Column:
    x = b.field(source)
    return F.when(x.isNotNull(), F.least(x, F.lit(0.0)))


@register("elementwise_max", (), a="close", b="open")
def elementwise_max(bld: Build, a: Source = "close", b: Source = "open") -> Column:
    x, y = bld.field(a), bld.field(b)
    return both(x, y, F.greatest(x, y))


@register("elementwise_min", (), a="close", b="open")
def elementwise_min(bld: Build, a: Source = "close", b: Source = "open") -> Column:
    x, y = bld.field(a), bld.field(b)
    return both(x, y, F.least(x, y))


@register("typical_price", ("hlc3",))
def typical_price(b: Build) -> Column:
    return b.field("hlc3")


@register("sign", (), source="close")
def sign(b: Build, source: Source = "close") -> Column:
    x = b.let(b.field(source))
    return b.let(F.signum(x - b.lag(x)))


@register("true_range", ("tr",))
def true_range(b: Build) -> Column:
    h, lw, c1 = b.field("high"), b.field("low"), b.lag(b.field("close"))
    return b.let(both(h, lw, F.greatest(h - lw, F.abs(h - c1), F.abs(lw - c1))))


# trend


@register("macd", (), outputs=("macd", "signal", "histogram"), fast_period=12, slow_period=26, signal_period=9, source="close")
def macd(b: Build, fast_period: int = 12, slow_period: int = 26, signal_period: int = 9, source: Source = "close") -> list[Column]:
    return b.scan(K.Macd(fast_period, slow_period, signal_period), source)


@register("bbands", ("bb", "bollinger"), outputs=("upper", "middle", "lower"), period=20, std_dev=2.0, source="close")
def bbands(b: Build, period: int = 20, std_dev: float = 2.0, source: Source = "close") -> list[Column]:
    mid, sd = rolling_mean(b, period, source), rolling_std(b, period, source)
    return [b.let(mid + sd * std_dev), mid, b.let(mid - sd * std_dev)]


@register("bb_upper", (), period=20, std_dev=2.0, source="close")
def bb_upper(b: Build, period: int = 20, std_dev: float = 2.0, source: Source = "close") -> Column:
    return bbands(b, period, std_dev, source)[0]


@register("bb_lower", (), period=20, std_dev=2.0, source="close")
def bb_lower(b: Build, period: int = 20, std_dev: float = 2.0, source: Source = "close") -> Column:
    return bbands(b, period, std_dev, source)[2]


def _middle(b: Build, p: int) -> Column:
    return b.let((rolling_max(b, p, "high") + rolling_min(b, p, "low")) / F.lit(2.0))


@register("ichimoku", (), outputs=("tenkan_sen", "kijun_sen", "senkou_span_a", "senkou_span_b", "chikou_span"), tenkan_period=9, kijun_period=26, senkou_period=52, displacement=26)
def ichimoku(b: Build, tenkan_period: int = 9, kijun_period: int = 26, senkou_period: int = 52, displacement: int = 26) -> list[Column]:
    """Both spans are displaced forward, the closing line back."""
    t, k, s = _middle(b, tenkan_period), _middle(b, kijun_period), _middle(b, senkou_period)
    return [t, k, b.lag(b.let((t + k) / F.lit(2.0)), displacement), b.lag(s, displacement), b.lag(b.field("close"), -displacement)]


@register("supertrend", (), outputs=("supertrend", "direction"), period=10, multiplier=3.0)
def supertrend(b: Build, period: int = 10, multiplier: float = 3.0) -> list[Column]:
    return b.scan(K.Supertrend(period, multiplier), "high", "low", "close")


@register("psar", ("parabolic_sar",), outputs=("sar", "direction"), af_start=0.02, af_increment=0.02, af_max=0.2)
def psar(b: Build, af_start: float = 0.02, af_increment: float = 0.02, af_max: float = 0.2) -> list[Column]:
    nxt = b.lag(b.field("close"), -1)
    return b.scan(K.Psar(af_start, af_increment, af_max), "high", "low", "close", nxt)


@register("elder_ray", (), outputs=("bull", "bear"), period=13)
def elder_ray(b: Build, period: int = 13) -> list[Column]:
    return b.scan(K.ElderRay(period), "high", "low", "close")


@register("fisher", ("fisher_transform",), outputs=("fisher", "signal"), period=9)
def fisher(b: Build, period: int = 9) -> list[Column]:
    mid = b.let(b.field("hl2"))
    return b.scan(K.Fisher(), mid, rolling_min(b, period, mid), rolling_max(b, period, mid))


@register("adx", (), outputs=("adx", "plus_di", "minus_di"), period=14)
def adx(b: Build, period: int = 14) -> list[Column]:
    return b.scan(K.Adx(period), "high", "low", "close")


# momentum


@register("rsi", (), period=14, source="close")
def rsi(b: Build, period: int = 14, source: Source = "close") -> Column:
    return b.scan(K.Rsi(period), source)[0]


@register("stochastic", ("stoch",), outputs=("k", "d"), k_period=14, d_period=3, smooth=1)
def stochastic(b: Build, k_period: int = 14, d_period: int = 3, smooth: int = 1) -> list[Column]:
    top, bottom, c = rolling_max(b, k_period, "high"), rolling_min(b, k_period, "low"), b.field("close")
    k = b.let(safe_div((c - bottom) * 100.0, top - bottom, 50.0))
    if smooth > 1:
        k = rolling_mean(b, smooth, k)
    return [k, rolling_mean(b, d_period, k)]


@register("stoch_k", (), k_period=14, d_period=3, smooth=1)
def stoch_k(b: Build, k_period: int = 14, d_period: int = 3, smooth: int = 1) -> Column:
    return stochastic(b, k_period, d_period, smooth)[0]


@register("stoch_d", (), k_period=14, d_period=3, smooth=1)
def stoch_d(b: Build, k_period: int = 14, d_period: int = 3, smooth: int = 1) -> Column:
    return stochastic(b, k_period, d_period, smooth)[1]


@register("cci", (), period=20)
def cci(b: Build, period: int = 20) -> Column:
    tp = b.let(b.field("hlc3"))
    mean = rolling_mean(b, period, tp)
    rows = b.let(F.collect_list(tp).over(b.over(_p(period))))
    dev = b.let(F.aggregate(rows, F.lit(0.0), lambda acc, x: acc + F.abs(x - mean)) / F.lit(float(period)))
    return b.let(F.when(mean.isNotNull(), safe_div(tp - mean, dev * 0.015, 0.0)))


@register("roc", (), period=12, source="close")
def roc(b: Build, period: int = 12, source: Source = "close") -> Column:
    return change_pct(b, _p(period), source)


@register("williams_r", ("willr",), period=14)
def williams_r(b: Build, period: int = 14) -> Column:
    top, bottom = rolling_max(b, period, "high"), rolling_min(b, period, "low")
    return b.let(safe_div((top - b.field("close")) * -100.0, top - bottom, 0.0))


def _moves(b: Build, x: Column) -> tuple[Column, Column]:
    """Gains and losses; the first row has neither."""
    d = b.let(F.when(b.rn == 1, F.when(x.isNotNull(), 0.0)).otherwise(x - b.lag(x)))
    return b.let(positive_values(b, d)), b.let(-negative_values(b, d))


@register("cmo", (), period=14, source="close")
def cmo(b: Build, period: int = 14, source: Source = "close") -> Column:
    up, down = _moves(b, b.let(b.field(source)))
    g, lo = rolling_sum(b, period, up), rolling_sum(b, period, down)
    return b.let(safe_div((g - lo) * 100.0, g + lo, 0.0))


@register("ao", ("awesome_oscillator",), fast_period=5, slow_period=34)
def ao(b: Build, fast_period: int = 5, slow_period: int = 34) -> Column:
    if fast_period >= slow_period:
        raise ValueError("the fast period must be below the slow one")
    mid = b.let(b.field("hl2"))
    return b.let(rolling_mean(b, fast_period, mid) - rolling_mean(b, slow_period, mid))


@register("coppock", (), fast_roc=11, slow_roc=14, wma_period=10, source="close")
def coppock(b: Build, wma_period: int = 10, fast_roc: int = 11, slow_roc: int = 14, source: Source = "close") -> Column:
    return wma(b, wma_period, b.let(roc(b, fast_roc, source) + roc(b, slow_roc, source)))


@register("mfi", (), period=14)
def mfi(b: Build, period: int = 14) -> Column:
    tp = b.let(b.field("hlc3"))
    before, flow = b.lag(tp), tp * b.field("volume")
    into = b.let(F.when(b.rn == 1, F.when(flow.isNotNull(), 0.0)).otherwise(F.when(tp > before, flow).when(tp <= before, 0.0)))
    out = b.let(F.when(b.rn == 1, F.when(flow.isNotNull(), 0.0)).otherwise(F.when(tp < before, flow).when(tp >= before, 0.0)))
    p, n = rolling_sum(b, period, into), rolling_sum(b, period, out)
    return b.let(F.when(n == 0, 100.0).otherwise(100.0 - F.lit(100.0) / (1.0 + p / F.nullif(n, F.lit(0.0)))))


@register("vortex", (), outputs=("plus", "minus"), period=14)
def vortex(b: Build, period: int = 14) -> list[Column]:
    """First values once ``period`` rows with a row before them are there."""
    h, lw, tr = b.field("high"), b.field("low"), true_range(b)
    tr = b.let(F.when(b.rn > 1, tr))
    total = rolling_sum(b, period, tr)
    up, down = b.let(F.abs(h - b.lag(lw))), b.let(F.abs(lw - b.lag(h)))
    return [b.let(safe_div(rolling_sum(b, period, x), total)) for x in (up, down)]


# volatility and volume


@register("atr", (), period=14)
def atr(b: Build, period: int = 14) -> Column:
    return b.scan(K.Atr(period), "high", "low", "close")[0]


@register("atr_from_tr", (), period=14, source="range")
def atr_from_tr(b: Build, period: int = 14, source: Source = "range") -> Column:
    return b.scan(K.Wilder(period), source)[0]


@register("donchian", (), outputs=("upper", "lower", "middle"), period=20)
def donchian(b: Build, period: int = 20) -> list[Column]:
    top, bottom = rolling_max(b, period, "high"), rolling_min(b, period, "low")
    return [top, bottom, b.let((top + bottom) / F.lit(2.0))]


@register("keltner", (), outputs=("upper", "middle", "lower"), ema_period=20, atr_period=10, multiplier=2.0)
def keltner(b: Build, ema_period: int = 20, atr_period: int = 10, multiplier: float = 2.0) -> list[Column]:
    return b.scan(K.Keltner(ema_period, atr_period, multiplier), "high", "low", "close")


@register("obv", ())
def obv(b: Build) -> Column:
    c, v = b.field("close"), b.field("volume")
    step = b.let(F.when(b.rn == 1, v).otherwise(F.signum(c - b.lag(c)) * v))
    return b.let(F.sum(step).over(b.so_far))


@register("vwap", ())
def vwap(b: Build) -> Column:
    tp, v = b.field("hlc3"), b.field("volume")
    pv, vv = b.let(F.sum(tp * v).over(b.so_far)), b.let(F.sum(F.when(tp.isNotNull(), v)).over(b.so_far))
    return b.let(safe_div(pv, vv, tp))


@register("cmf", (), period=20)
def cmf(b: Build, period: int = 20) -> Column:
    h, lw, c, v = (b.field(x) for x in ("high", "low", "close", "volume"))
    flow = b.let(safe_div((c - lw) - (h - c), h - lw, 0.0) * v)
    return b.let(safe_div(rolling_sum(b, period, flow), rolling_sum(b, period, v), 0.0))


@register("klinger_vf", ())
def klinger_vf(b: Build) -> Column:
    h, lw, tp = b.field("high"), b.field("low"), b.let(b.field("hlc3"))
    dm = h - lw
    d = tp - b.lag(tp)
    dm = F.when(dm <= 0, F.lit(1e-10)).otherwise(dm)
    force = b.field("volume") * F.abs(2.0 * (d / F.nullif(dm, F.lit(0.0))) - 1.0) * F.when(d > 0, 1.0).otherwise(-1.0) * 100.0
    return b.let(F.when(b.rn == 1, 0.0).otherwise(force))


@register("klinger", (), outputs=("klinger", "signal"), fast_period=34, slow_period=55, signal_period=13)
def klinger(b: Build, fast_period: int = 34, slow_period: int = 55, signal_period: int = 13) -> list[Column]:
    return b.scan(K.Klinger(fast_period, slow_period, signal_period), klinger_vf(b))


# events


def _pair(b: Build, x: Source | float, y: Source | float) -> tuple[Column, Column, Column, Column]:
    cols = [F.lit(float(v)) if isinstance(v, (int, float)) else b.let(b.field(v)) for v in (x, y)]
    before = [c if isinstance(v, (int, float)) else b.lag(c) for c, v in zip(cols, (x, y))]
    return *cols, *before


def _event(b: Build, cond: Column) -> Column:
    return b.let(F.coalesce(cond & (b.rn > 1), F.lit(False)))


@register("crossup", (), a="close", b="open")
def crossup(bld: Build, a: Source | float = "close", b: Source | float = "open") -> Column:
    x, y, x1, y1 = _pair(bld, a, b)
    return _event(bld, (x > y) & (x1 <= y1))


@register("crossdown", (), a="close", b="open")
def crossdown(bld: Build, a: Source | float = "close", b: Source | float = "open") -> Column:
    x, y, x1, y1 = _pair(bld, a, b)
    return _event(bld, (x < y) & (x1 >= y1))


@register("cross", (), a="close", b="open")
def cross(bld: Build, a: Source | float = "close", b: Source | float = "open") -> Column:
    x, y, x1, y1 = _pair(bld, a, b)
    return _event(bld, ((x > y) & (x1 <= y1)) | ((x < y) & (x1 >= y1)))


def _trend(name: str, cond):
    @register(name, (), a="close")
    def op(b: Build, a: Source = "close") -> Column:
        x = b.let(b.field(a))
        return _event(b, cond(x, b.lag(x)))

    return op


rising = _trend("rising", lambda x, y: x > y)
falling = _trend("falling", lambda x, y: x < y)


@register("rising_pct", (), a="close", pct=5.0)
def rising_pct(b: Build, a: Source = "close", pct: float = 5.0) -> Column:
    x = b.let(b.field(a))
    return _event(b, x >= b.lag(x) * (1 + pct / 100.0))


@register("falling_pct", (), a="close", pct=5.0)
def falling_pct(b: Build, a: Source = "close", pct: float = 5.0) -> Column:
    x = b.let(b.field(a))
    return _event(b, x <= b.lag(x) * (1 - pct / 100.0))


def _channel(b: Build, price, upper, lower) -> tuple[list[Column], list[Column]]:
    cols = [F.lit(float(v)) if isinstance(v, (int, float)) else b.let(b.field(v)) for v in (price, upper, lower)]
    return cols, [c if isinstance(v, (int, float)) else b.lag(c) for c, v in zip(cols, (price, upper, lower))]


def _inside(p: Column, u: Column, lw: Column) -> Column:
    return (p >= lw) & (p <= u)


def _outside(p: Column, u: Column, lw: Column) -> Column:
    return F.coalesce(p > u, F.lit(False)) | F.coalesce(p < lw, F.lit(False))


@register("in_channel", ("in",), price="close", upper="high", lower="low")
def in_channel(b: Build, price: Source = "close", upper: Source | float = "high", lower: Source | float = "low") -> Column:
    now, _ = _channel(b, price, upper, lower)
    return b.let(F.coalesce(_inside(*now), F.lit(False)))


@register("out_channel", ("out",), price="close", upper="high", lower="low")
def out_channel(b: Build, price: Source = "close", upper: Source | float = "high", lower: Source | float = "low") -> Column:
    now, _ = _channel(b, price, upper, lower)
    return b.let(_outside(*now))


@register("enter", ("enter_channel",), price="close", upper="high", lower="low")
def enter(b: Build, price: Source = "close", upper: Source | float = "high", lower: Source | float = "low") -> Column:
    now, before = _channel(b, price, upper, lower)
    return _event(b, _inside(*now) & _outside(*before))


@register("exit", ("exit_channel",), price="close", upper="high", lower="low")
def exit_(b: Build, price: Source = "close", upper: Source | float = "high", lower: Source | float = "low") -> Column:
    now, before = _channel(b, price, upper, lower)
    return _event(b, _outside(*now) & _inside(*before))


# patterns


def _pivot(b: Build, x: Column, left: int, right: int, high: bool, equal: bool) -> Column:
    """Raw pivots, at their own row."""
    best = F.max if high else F.min
    full = F.count(x).over(b.around(left, right)) == left + right + 1
    before, after = best(x).over(b.around(left, -1)), best(x).over(b.around(-1, right))
    beats = (lambda y: x >= y if equal else x > y) if high else (lambda y: x <= y if equal else x < y)
    return b.let(F.coalesce(full & beats(before) & beats(after), F.lit(False)))


def _swings(b: Build, left: int, right: int, allow_equal_extremes: bool, gate_lows: bool = True) -> tuple[Column, Column]:
    _p(left), _p(right)
    h, lw = _pivot(b, b.field("high"), left, right, True, allow_equal_extremes), _pivot(b, b.field("low"), left, right, False, allow_equal_extremes)
    if gate_lows:  # lows count from the first high on
        lw = b.let(lw & (F.max(h.cast("int")).over(b.so_far) == 1))
    return tuple(b.let(F.coalesce(b.lag(x, right), F.lit(False))) for x in (h, lw))


@register("swing_points", (), outputs=("swing_high", "swing_low"), left=2, right=2, return_mode="flags", allow_equal_extremes=False)
def swing_points(b: Build, left: int = 2, right: int = 2, return_mode: str = "flags", allow_equal_extremes: bool = False) -> list[Column]:
    """Pivots, given at the row that confirms them: as flags, or with ``levels`` as their prices."""
    if return_mode not in ("flags", "levels"):
        raise ValueError(f"unknown return_mode {return_mode!r}")
    h, lw = _swings(b, left, right, allow_equal_extremes)
    if return_mode == "flags":
        return [h, lw]
    return [b.let(F.when(h, b.lag(b.field("high"), right))), b.let(F.when(lw, b.lag(b.field("low"), right)))]


@register("swing_highs", (), left=2, right=2, return_mode="flags", allow_equal_extremes=False)
def swing_highs(b: Build, left: int = 2, right: int = 2, return_mode: str = "flags", allow_equal_extremes: bool = False) -> Column:
    return swing_points(b, left, right, return_mode, allow_equal_extremes)[0]


@register("swing_lows", (), left=2, right=2, return_mode="flags", allow_equal_extremes=False)
def swing_lows(b: Build, left: int = 2, right: int = 2, return_mode: str = "flags", allow_equal_extremes: bool = False) -> Column:
    return swing_points(b, left, right, return_mode, allow_equal_extremes)[1]


def _nth_level(b: Build, level: Column, index: int) -> Column:
    """The index-th latest level: the level at its number, held until the next; no list of all levels is kept."""
    n = b.let(F.count(level).over(b.so_far))
    if _p(index) == 1:
        return b.let(F.last(level, ignorenulls=True).over(b.so_far))
    # the confirming rows know the level some levels back; the others hold that
    w = b.whole_with(level.isNotNull()).orderBy(*b.order)
    back = b.let(F.when(level.isNotNull(), F.lag(level, index - 1).over(w)))
    held = F.last(F.when(level.isNotNull(), F.struct(back.alias("v"))), ignorenulls=True).over(b.so_far)
    return b.let(F.when(n >= index, held["v"]))


@register("swing_high_at", (), index=1, left=2, right=2, allow_equal_extremes=False)
def swing_high_at(b: Build, index: int = 1, left: int = 2, right: int = 2, allow_equal_extremes: bool = False) -> Column:
    return _nth_level(b, swing_points(b, left, right, "levels", allow_equal_extremes)[0], index)


@register("swing_low_at", (), index=1, left=2, right=2, allow_equal_extremes=False)
def swing_low_at(b: Build, index: int = 1, left: int = 2, right: int = 2, allow_equal_extremes: bool = False) -> Column:
    return _nth_level(b, swing_points(b, left, right, "levels", allow_equal_extremes)[1], index)
