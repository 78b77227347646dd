"""Queries of the operators over bars of the ``events`` table, and their SQL.

Every query gives (symbol, ts_us, the operator's outputs rounded to six places).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom import bars as B
from tickloom import registry
from tickloom.plans.compile import evaluate, evaluate_split, triggers
from tickloom.schema import bar_is_valid, derived, nan_to_null, to_instant
from tickloom.sources.records import from_json, points, to_json
from tickloom.streaming.expressions import ExpressionStream
from tickloom.streaming.stream import clock_bars
from tickloom.util import shared_folder

# -- Spark side


def result(df: DataFrame, *outputs: str) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select("symbol", F.unix_micros("ts").alias("ts_us"), *[F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in outputs])


def operator(name: str, params: dict, spark: SparkSession, d: str, timeframe: str = "1h") -> DataFrame:
    bars = B.bars_from_events(spark, d, timeframe)
    df = registry.apply(bars, name, **params)
    return result(df, *[c for c in df.columns if c not in bars.columns])


def expression(text: str, spark: SparkSession, d: str) -> DataFrame:
    return result(evaluate(B.bars_from_events(spark, d), text), "value")


# -- SQL side

BARS = """b0 AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts,
 arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS "close",
 sum(CAST(round(value * 100) AS BIGINT)) / 100.0 AS volume
 FROM events WHERE value IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, (high + low + "close") / 3.0 AS tp, (high + low) / 2.0 AS mid FROM b0)"""
W = "PARTITION BY symbol ORDER BY ts"
LONG_BARS = ("klinger_vf", "klinger")


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({W})" if n >= 0 else f"lead({x}, {-n}) OVER ({W})"


def roll(fn: str, x: str, p: int) -> str:
    over = f"OVER ({W} ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {over} = {p} THEN {fn.format(x) if '{' in fn else f'{fn}({x})'} {over} END"


def upto(x: str) -> str:
    return f"list({x}) OVER ({W} ROWS UNBOUNDED PRECEDING)"


def smooth(rows: str, alpha: float) -> str:
    return f"list_reduce({rows}, lambda acc, x: {alpha!r} * x + {1 - alpha!r} * acc)"


def wilder(rows: str, p: int) -> str:
    return f"CASE WHEN len({rows}) >= {p} THEN list_reduce(list_prepend(list_sum({rows}[1:{p}]) / {p}, {rows}[{p + 1}:]), lambda acc, x: (acc * {p - 1} + x) / {p}) END"


def sql(outputs: dict[str, str], *stages: dict[str, str]) -> str:
    """Stages add columns one after the other; the outputs come from the last, rounded unless they begin with ``!``."""
    ctes, last = [BARS], "b"
    for i, cols in enumerate(stages, 1):
        ctes.append(f"s{i} AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in cols.items())} FROM {last})")
        last = f"s{i}"
    outs = ", ".join(f"{e[1:]} AS {n}" if e.startswith("!") else f"round({e}, 6) AS {n}" for n, e in outputs.items())
    return f"WITH {', '.join(ctes)} SELECT symbol, epoch_us(ts) AS ts_us, {outs} FROM {last}"


def safe(a: str, b: str, zero: str = "NULL") -> str:
    return f"CASE WHEN ({b}) = 0 THEN {zero} ELSE ({a}) / nullif({b}, 0) END"


def wma_sql(x: str, p: int) -> str:
    terms = " + ".join([f"{p}.0 * {x}", *[f"{p - k}.0 * {lag(x, k)}" for k in range(1, p)]])
    return f"CASE WHEN count({x}) OVER ({W} ROWS {p - 1} PRECEDING) = {p} THEN ({terms}) / {p * (p + 1) / 2} END"


C, TR = '"close"', f'greatest(high - low, abs(high - coalesce({lag(chr(34) + "close" + chr(34))}, low)), abs(low - coalesce({lag(chr(34) + "close" + chr(34))}, high)))'
PREV = {"c1": lag(C), "o1": lag("open"), "h1": lag("high"), "l1": lag("low")}


def event(cond: str) -> str:
    return f"!coalesce(({cond}) AND rn > 1, false)"


def _oracles() -> dict[str, tuple[dict, str]]:
    """name -> (parameters, SQL)."""
    o: dict[str, tuple[dict, str]] = {}

    def put(name: str, outputs: dict[str, str], *stages: dict[str, str], **params) -> None:
        o[name] = (params, sql(outputs, *stages))

    one = lambda name, e, *stages, **params: put(name, {name: e}, *stages, **params)
    for name, fn in (("rolling_sum", "sum"), ("rolling_mean", "avg"), ("rolling_std", "stddev_pop"), ("rolling_max", "max"), ("rolling_min", "min")):
        one(name, roll(fn, C, 20), period=20)
    one("rolling_median", "list_sort(w)[11]", {"w": roll("list", C, 20)}, period=20)
    since = lambda sign: f"!CASE WHEN rn >= 20 THEN CAST(rn - arg_max(rn, row({sign}{C}, rn)) OVER ({W} ROWS 19 PRECEDING) AS DOUBLE) END"
    one("rolling_argmax", since(""), period=20)
    one("rolling_argmin", since("-"), period=20)
    one("wma", wma_sql(C, 14), period=14)
    one("hma", wma_sql("x", 3), {"a": wma_sql(C, 7), "z": wma_sql(C, 14)}, {"x": "2 * a - z"}, period=14)
    one("ema", smooth("l", 2 / 21), {"l": upto(C)}, period=20)
    one("rma", smooth("l", 1 / 14), {"l": upto(C)}, period=14)
    one("cumulative_sum", f"sum({C}) OVER ({W} ROWS UNBOUNDED PRECEDING)")
    one("diff", f"{C} - {lag(C)}")
    one("shift", lag(C, 3), periods=3)
    one("shift_clamped", f"coalesce({lag(C, 3)}, first({C}) OVER ({W}))", periods=3)
    one("change", f"{C} - {lag(C, 24)}", periods=24)
    one("change_pct", safe(f"({C} - x) * 100", "x"), {"x": lag(C, 24)}, periods=24)
    one("roc", safe(f"({C} - x) * 100", "x"), {"x": lag(C, 12)}, period=12)
    one("abs", f"abs({C})")
    one("positive_values", f"greatest({C}, 0)")
    one("negative_values", f"least({C}, 0)")
    one("elementwise_max", f"greatest({C}, open)")
    one("elementwise_min", f"least({C}, open)")
    one("typical_price", "tp")
    one("sign", f"sign({C} - {lag(C)})::DOUBLE")
    one("true_range", TR)
    put("macd", {"macd_macd": "m", "macd_signal": "g", "macd_histogram": "m - g"}, {"l": upto(C)}, {"m": f"{smooth('l', 2 / 13)} - {smooth('l', 2 / 27)}"}, {"lm": upto("m")}, {"g": smooth("lm", 2 / 10)})
    band = {"m": roll("avg", C, 20), "d": roll("stddev_pop", C, 20)}
    put("bbands", {"bbands_upper": "m + 2 * d", "bbands_middle": "m", "bbands_lower": "m - 2 * d"}, band)
    one("bb_upper", "m + 2 * d", band)
    one("bb_lower", "m - 2 * d", band)
    half = lambda p: f"({roll('max', 'high', p)} + {roll('min', 'low', p)}) / 2"
    put("ichimoku", {"ichimoku_tenkan_sen": "t", "ichimoku_kijun_sen": "k", "ichimoku_senkou_span_a": lag("(t + k) / 2", 26), "ichimoku_senkou_span_b": lag("s", 26), "ichimoku_chikou_span": lag(C, -26)}, {"t": half(9), "k": half(26), "s": half(52)})
    put("elder_ray", {"elder_ray_bull": f"high - {smooth('l', 2 / 14)}", "elder_ray_bear": f"low - {smooth('l', 2 / 14)}"}, {"l": upto(C)})
    place = "CASE WHEN hi > lo THEN (mid - lo) / (hi - lo) - 0.5 ELSE 0 END"
    put(
        "fisher",
        {"fisher_fisher": "f", "fisher_signal": f"CASE WHEN rn = 1 THEN 0.0 ELSE {lag('f')} END"},
        {"hi": roll("max", "mid", 9), "lo": roll("min", "mid", 9)},
        {"p": f"CASE WHEN hi IS NOT NULL THEN {place} END"},
        {"lp": f"CASE WHEN p IS NOT NULL THEN list_prepend(0.0, list_filter({upto('p')}, lambda x: x IS NOT NULL)) END"},
        {"v": "list_reduce(lp, lambda acc, x: greatest(-0.999, least(0.999, 0.66 * x + 0.67 * acc)))"},
        {"lv": f"CASE WHEN p IS NOT NULL THEN list_prepend(0.0, list_filter({upto('v')}, lambda x: x IS NOT NULL)) END"},
        {"f": "list_reduce(lv, lambda acc, x: 0.5 * ln((1 + x) / (1 - x)) + 0.5 * acc)"},
        period=9,
    )
    moved = {"up": "CASE WHEN rn = 1 THEN 0.0 ELSE high - h1 END", "dn": "CASE WHEN rn = 1 THEN 0.0 ELSE l1 - low END", "tr": f"CASE WHEN rn = 1 THEN 0.0 ELSE {TR} END"}
    total = lambda rows, p: f"CASE WHEN len({rows}) >= {p} THEN list_reduce(list_prepend(list_sum({rows}[1:{p}]), {rows}[{p + 1}:]), lambda acc, x: acc - acc / {p} + x) END"
    put(
        "adx",
        {"adx_adx": wilder("ld", 14), "adx_plus_di": "dp", "adx_minus_di": "dm"},
        PREV,
        moved,
        {"pu": "CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END", "pd": "CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END"},
        {"lt": upto("tr"), "lu": upto("pu"), "lo": upto("pd")},
        {"st": total("lt", 14), "su": total("lu", 14), "so": total("lo", 14)},
        {"dp": "CASE WHEN st > 0 THEN 100 * su / st END", "dm": "CASE WHEN st > 0 THEN 100 * so / st END"},
        {"dx": "CASE WHEN dp + dm > 0 THEN 100 * abs(dp - dm) / (dp + dm) WHEN dp IS NOT NULL THEN 0.0 END"},
        {"ld": f"list_filter({upto('dx')}, lambda x: x IS NOT NULL)"},
        period=14,
    )
    d = f"{C} - {lag(C)}"
    put("rsi", {"rsi": "CASE WHEN g IS NULL THEN NULL WHEN s = 0 THEN CASE WHEN g > 0 THEN 100.0 ELSE 50.0 END ELSE 100 - 100 / (1 + g / s) END"}, {"d": d}, {"lg": upto("CASE WHEN d IS NULL THEN NULL ELSE greatest(d, 0) END"), "ls": upto("CASE WHEN d IS NULL THEN NULL ELSE greatest(-d, 0) END")}, {"fg": "list_filter(lg, lambda x: x IS NOT NULL)", "fs": "list_filter(ls, lambda x: x IS NOT NULL)"}, {"g": wilder("fg", 14), "s": wilder("fs", 14)}, period=14)
    k = {"k": safe(f"({C} - lo) * 100", "hi - lo", "CASE WHEN hi IS NOT NULL THEN 50.0 END")}
    hl = lambda p: {"hi": roll("max", "high", p), "lo": roll("min", "low", p)}
    put("stochastic", {"stochastic_k": "k", "stochastic_d": roll("avg", "k", 3)}, hl(14), k)
    one("stoch_k", "k", hl(14), k)
    one("stoch_d", roll("avg", "k", 3), hl(14), k)
    one("cci", safe("tp - m", "dev * 0.015", "0.0"), {"m": roll("avg", "tp", 20), "w": roll("list", "tp", 20)}, {"dev": "list_sum(list_transform(w, lambda x: abs(x - m))) / 20"}, period=20)
    one("williams_r", safe(f"(hi - {C}) * -100", "hi - lo", "0.0"), hl(14), period=14)
    move = {"g": f"CASE WHEN rn = 1 THEN 0 ELSE greatest({d}, 0) END", "s": f"CASE WHEN rn = 1 THEN 0 ELSE greatest(-({d}), 0) END"}
    one("cmo", safe("(a - z) * 100", "a + z", "0.0"), move, {"a": roll("sum", "g", 14), "z": roll("sum", "s", 14)}, period=14)
    one("ao", f"({roll('avg', 'mid', 5)}) - ({roll('avg', 'mid', 34)})")
    change = lambda p: {"x": safe(f"({C} - {lag(C, p)}) * 100", lag(C, p))}
    one("coppock", wma_sql("y", 10), {"x": change(11)["x"], "z": change(14)["x"]}, {"y": "x + z"})
    flow = {"t1": lag("tp")}
    one("mfi", "CASE WHEN n = 0 THEN 100.0 ELSE 100 - 100 / (1 + p / nullif(n, 0)) END", flow, {"i": "CASE WHEN tp > t1 THEN tp * volume ELSE 0 END", "u": "CASE WHEN tp < t1 THEN tp * volume ELSE 0 END"}, {"p": roll("sum", "i", 14), "n": roll("sum", "u", 14)}, period=14)
    put("vortex", {"vortex_plus": safe("a", "t"), "vortex_minus": safe("z", "t")}, PREV, {"tr": f"CASE WHEN rn > 1 THEN {TR} END", "u": "abs(high - l1)", "v": "abs(low - h1)"}, {"t": roll("sum", "tr", 14), "a": roll("sum", "u", 14), "z": roll("sum", "v", 14)}, period=14)
    tr = {"tr": TR}
    one("atr", wilder("l", 14), tr, {"l": upto("tr")}, period=14)
    one("atr_from_tr", wilder("l", 14), {"l": upto("high - low")}, period=14)
    put("donchian", {"donchian_upper": "hi", "donchian_lower": "lo", "donchian_middle": "(hi + lo) / 2"}, hl(20), period=20)
    put("keltner", {"keltner_upper": "m + 2 * a", "keltner_middle": "m", "keltner_lower": "m - 2 * a"}, tr, {"l": upto("tr"), "lc": upto(C)}, {"a": wilder("l", 10), "m": smooth("lc", 2 / 21)})
    one("obv", f"sum(CASE WHEN rn = 1 THEN volume ELSE sign({C} - c1) * volume END) OVER ({W} ROWS UNBOUNDED PRECEDING)", PREV)
    cum = lambda x: f"sum({x}) OVER ({W} ROWS UNBOUNDED PRECEDING)"
    one("vwap", safe(cum("tp * volume"), cum("volume"), "tp"))
    one("cmf", safe("a", "z", "0.0"), {"f": safe(f"({C} - low) - (high - {C})", "high - low", "0.0")}, {"fv": "f * volume"}, {"a": roll("sum", "fv", 20), "z": roll("sum", "volume", 20)}, period=20)
    force = {"t1": lag("tp")}
    vf = {"vf": "CASE WHEN rn = 1 THEN 0.0 ELSE volume * abs(2 * ((tp - t1) / CASE WHEN high - low <= 0 THEN 1e-10 ELSE high - low END) - 1) * CASE WHEN tp > t1 THEN 1 ELSE -1 END * 100 END"}
    # over days: bars without any range would give numbers too large to compare to six places
    put("klinger_vf", {"klinger_vf": "vf"}, force, vf)
    put("klinger", {"klinger_klinger": "m", "klinger_signal": smooth("lm", 2 / 14)}, force, vf, {"l": upto("vf")}, {"m": f"{smooth('l', 2 / 35)} - {smooth('l', 2 / 56)}"}, {"lm": upto("m")})
    for name, cond in (("crossup", f"{C} > open AND c1 <= o1"), ("crossdown", f"{C} < open AND c1 >= o1"), ("cross", f"({C} > open AND c1 <= o1) OR ({C} < open AND c1 >= o1)"), ("rising", f"{C} > c1"), ("falling", f"{C} < c1"), ("rising_pct", f"{C} >= c1 * 1.05"), ("falling_pct", f"{C} <= c1 * 0.95")):
        one(name, event(cond), PREV)
    inside, was_in = "{0} >= lo AND {0} <= hi".format(C), "c1 >= lo1 AND c1 <= hi1"
    out, was_out = "{0} > hi OR {0} < lo".format(C), "c1 > hi1 OR c1 < lo1"
    chan = ({"hi": "mid + 10", "lo": "mid - 10"}, {"hi1": lag("hi"), "lo1": lag("lo"), "c1": lag(C)})
    o["in_channel"] = ({"upper": "__hi", "lower": "__lo"}, sql({"in_channel": f"!coalesce({inside}, false)"}, *chan))
    o["out_channel"] = ({"upper": "__hi", "lower": "__lo"}, sql({"out_channel": f"!coalesce({out}, false)"}, *chan))
    o["enter"] = ({"upper": "__hi", "lower": "__lo"}, sql({"enter": event(f"({inside}) AND ({was_out})")}, *chan))
    o["exit"] = ({"upper": "__hi", "lower": "__lo"}, sql({"exit": event(f"({out}) AND ({was_in})")}, *chan))
    around = f"({W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
    piv = {"wh": f"list(high) OVER {around}", "wl": f"list(low) OVER {around}"}
    raw = {"mh": "list_max(wh)", "ml": "list_min(wl)"}
    raw2 = {"ph": "len(wh) = 5 AND high = mh AND len(list_filter(wh, lambda x: x = mh)) = 1", "pl0": "len(wl) = 5 AND low = ml AND len(list_filter(wl, lambda x: x = ml)) = 1"}
    gate = {"pl": f"pl0 AND max(ph::INT) OVER ({W} ROWS UNBOUNDED PRECEDING) = 1"}
    conf = {"sh": f"coalesce({lag('ph', 2)}, false)", "sl": f"coalesce({lag('pl', 2)}, false)", "lh": f"CASE WHEN coalesce({lag('ph', 2)}, false) THEN {lag('high', 2)} END", "ll": f"CASE WHEN coalesce({lag('pl', 2)}, false) THEN {lag('low', 2)} END"}
    swings = (piv, raw, raw2, gate, conf)
    put("swing_points", {"swing_points_swing_high": "!sh", "swing_points_swing_low": "!sl"}, *swings)
    one("swing_highs", "lh", *swings, return_mode="levels")
    one("swing_lows", "ll", *swings, return_mode="levels")
    nth = lambda x, i: f"CASE WHEN len(l) >= {i} THEN l[-{i}] END"
    one("swing_high_at", nth("lh", 2), *swings, {"l": f"list_filter({upto('lh')}, lambda x: x IS NOT NULL)"}, index=2)
    one("swing_low_at", nth("ll", 1), *swings, {"l": f"list_filter({upto('ll')}, lambda x: x IS NOT NULL)"}, index=1)
    for name in LONG_BARS:
        o[name] = (o[name][0], o[name][1].replace("date_trunc('hour', ts)", "date_trunc('day', ts)"))
    return o


def channel(name: str, spark: SparkSession, d: str) -> DataFrame:
    bars = B.bars_from_events(spark, d).withColumns({"__hi": derived("hl2") + 10, "__lo": derived("hl2") - 10})
    return result(registry.apply(bars, name, upper="__hi", lower="__lo"), name)


def _stateful_sql() -> dict[str, str]:
    """The two state machines, row by row."""
    st = f"""WITH RECURSIVE {BARS}, t AS (SELECT *, {TR} AS tr FROM b), a0 AS (SELECT *, {upto('tr')} AS l FROM t), a AS MATERIALIZED (SELECT symbol, ts, rn, high, low, "close", {wilder('l', 10)} AS atr FROM a0),
r AS (SELECT symbol, ts, rn, "close" AS c, (high + low) / 2 + 3 * atr AS up, (high + low) / 2 - 3 * atr AS dn, -1 AS side, atr FROM a WHERE rn = 10
 UNION ALL SELECT symbol, ts, rn, c, up, dn, CASE WHEN side < 0 AND c > up THEN 1 WHEN side > 0 AND c < dn THEN -1 ELSE side END, atr FROM (
  SELECT a.symbol, a.ts, a.rn, a."close" AS c, r.side, a.atr,
   CASE WHEN (a.high + a.low) / 2 + 3 * a.atr < r.up OR r.c > r.up THEN (a.high + a.low) / 2 + 3 * a.atr ELSE r.up END AS up,
   CASE WHEN (a.high + a.low) / 2 - 3 * a.atr > r.dn OR r.c < r.dn THEN (a.high + a.low) / 2 - 3 * a.atr ELSE r.dn END AS dn
  FROM r JOIN a ON a.symbol = r.symbol AND a.rn = r.rn + 1))
SELECT a.symbol, epoch_us(a.ts) AS ts_us, round(CASE WHEN side > 0 THEN dn WHEN side < 0 THEN up END, 6) AS supertrend_supertrend, CAST(side AS DOUBLE) AS supertrend_direction FROM a LEFT JOIN r ON a.symbol = r.symbol AND a.rn = r.rn"""
    ps = f"""WITH RECURSIVE {BARS}, a AS MATERIALIZED (SELECT symbol, ts, rn, high, low, {lag('high')} AS h1, {lag('low')} AS l1, {lag('high', 2)} AS h2, {lag('low', 2)} AS l2, CASE WHEN {lag(C, -1)} < "close" THEN -1 ELSE 1 END AS s0 FROM b),
r AS (SELECT symbol, ts, rn, CASE WHEN s0 > 0 THEN low ELSE high END AS sar, CASE WHEN s0 > 0 THEN high ELSE low END AS ep, 0.02::DOUBLE AS af, s0 AS side FROM a WHERE rn = 1
 UNION ALL SELECT symbol, ts, rn, CASE WHEN flip THEN ep ELSE x END,
   CASE WHEN flip AND side > 0 THEN low WHEN flip THEN high WHEN side > 0 THEN greatest(ep, high) ELSE least(ep, low) END,
   CASE WHEN flip THEN 0.02 WHEN (side > 0 AND high > ep) OR (side < 0 AND low < ep) THEN least(af + 0.02, 0.2) ELSE af END,
   CASE WHEN flip THEN -side ELSE side END FROM (
  SELECT *, CASE WHEN side > 0 THEN low < x ELSE high > x END AS flip FROM (
   SELECT a.symbol, a.ts, a.rn, a.high, a.low, r.ep, r.af, r.side, CASE WHEN r.side > 0 THEN least(r.sar + r.af * (r.ep - r.sar), a.l1, coalesce(a.l2, a.l1)) ELSE greatest(r.sar + r.af * (r.ep - r.sar), a.h1, coalesce(a.h2, a.h1)) END AS x
   FROM r JOIN a ON a.symbol = r.symbol AND a.rn = r.rn + 1)))
SELECT symbol, epoch_us(ts) AS ts_us, round(sar, 6) AS psar_sar, CAST(side AS DOUBLE) AS psar_direction FROM r"""
    return {"supertrend": st, "psar": ps}


# -- time base, joins and expressions


def downsample(how: str, spark: SparkSession, d: str) -> DataFrame:
    return result(B.downsample(B.bars_from_events(spark, d), 5, how), "close")


def downsample_ohlcv(spark: SparkSession, d: str) -> DataFrame:
    return result(B.downsample_ohlcv(B.bars_from_events(spark, d), 4), "open", "high", "low", "close", "volume")


def resample(spark: SparkSession, d: str) -> DataFrame:
    return result(B.resample(B.bars_from_events(spark, d), "1h", "4h"), "open", "high", "low", "close", "volume")


def resample_clock(spark: SparkSession, d: str) -> DataFrame:
    return result(B.resample_clock(B.bars_from_events(spark, d), "1d"), "open", "high", "low", "close", "volume")


def upsample(spark: SparkSession, d: str) -> DataFrame:
    return result(B.upsample(B.bars_from_events(spark, d), 3), "close", "copy")


def trim(spark: SparkSession, d: str) -> DataFrame:
    return result(B.trim(B.bars_from_events(spark, d), 10), "close")


def _four_hours(spark: SparkSession, d: str) -> DataFrame:
    return B.resample(B.bars_from_events(spark, d), "1h", "4h").select("symbol", "ts", F.col("close").alias("value"))


def sync(how: str, spark: SparkSession, d: str) -> DataFrame:
    bars = B.bars_from_events(spark, d).select("symbol", "ts")
    return result(B.sync(_four_hours(spark, d), bars, "value", how), "value")


def align(how: str, fill: str, spark: SparkSession, d: str) -> DataFrame:
    bars = B.bars_from_events(spark, d)
    even = bars.where(F.hour("ts") % 2 == 0).select("symbol", "timeframe", "ts", F.col("close").alias("value"))
    low = bars.where(F.hour("ts") % 3 == 0).select("symbol", "timeframe", "ts", F.col("low").alias("value"))
    return result(B.align(even, low, how, fill), "left", "right")


def collapse(spark: SparkSession, d: str) -> DataFrame:
    """Whole series to one row per key."""
    return B.bars_from_events(spark, d).groupBy("symbol").agg(F.count("close").alias("n"), F.round(F.sum("close"), 6).alias("total"), F.round(F.avg("close"), 6).alias("mean"), F.max("close").alias("top"), F.min("close").alias("bottom"))


def trades_filter_sum(spark: SparkSession, d: str) -> DataFrame:
    t = B.trades_from_lineitem(spark, d).withColumnsRenamed({"amount": "trades_amount", "price": "trades_price"})
    t = evaluate(t, n="trades.filter(amount > 40).count(price)", total="trades.filter(amount > 40).sum(price)", top="trades.filter(amount > 40).max(price)")
    return t.groupBy("symbol").agg(F.max("n").cast("long").alias("n"), F.round(F.max("total"), 2).alias("total"), F.max("top").alias("top"))


def derived_fields(spark: SparkSession, d: str) -> DataFrame:
    names = ("hlc3", "ohlc4", "hl2", "range", "upper_wick", "lower_wick", "body_size")
    return result(B.bars_from_events(spark, d).withColumns({n: derived(n) for n in names}), *names)


def catalog(spark: SparkSession, d: str) -> DataFrame:
    return registry.catalog(spark)


def crossings(spark: SparkSession, d: str) -> DataFrame:
    """Hours in which the close crosses above its mean of 20 bars."""
    df = evaluate(B.bars_from_events(spark, d), hit="crossup(close, sma(close, 20))", mean="sma(close, 20)")
    return result(df.where("hit"), "close", "mean")


def ref(spark: SparkSession, d: str) -> DataFrame:
    """The close of the longer timeframe as of each bar, beside the bar's own."""
    bars = B.bars_from_events(spark, d)
    return result(B.ref(bars.unionByName(B.resample_clock(bars, "1d").withColumn("is_closed", F.lit(True))), "1d", "close", bars), "close", "value")


def slice_time(spark: SparkSession, d: str) -> DataFrame:
    at = lambda t: F.lit(t).cast("timestamp")
    return result(B.slice_time(B.bars_from_events(spark, d), at("2024-01-05 00:00:00"), at("2024-01-06 12:00:00")), "close")


def filter_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows on which a condition holds; the others are dropped."""
    return result(triggers(B.bars_from_events(spark, d), "close > open and volume > 500"), "close")


def dataset_info(spark: SparkSession, d: str) -> DataFrame:
    i = B.BarSet(B.bars_from_events(spark, d)).info()
    return i.select("symbol", "n", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"))


def append_rows(spark: SparkSession, d: str) -> DataFrame:
    """Two parts of the bars put together again, and what stands against it."""
    bars = B.bars_from_events(spark, d)
    early, late = bars.where(F.dayofmonth("ts") <= 10), bars.where(F.dayofmonth("ts") > 10)
    out = B.append(early, late).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    wrong = B.append_problems(late, early).groupBy("symbol").agg(F.sum("n").alias("too_early"))
    return out.join(wrong, "symbol", "left").select("symbol", "n", F.coalesce("too_early", F.lit(0)).cast("long").alias("too_early"))


def series_points(spark: SparkSession, d: str) -> DataFrame:
    """Points with a value as JSON."""
    df = registry.apply(B.bars_from_events(spark, d), "rolling_max", period=30)
    return points(df, "rolling_max").select("symbol", F.unix_micros("ts").alias("ts_us"), F.get_json_object("point", "$.value").cast("double").alias("value"), F.get_json_object("point", "$.time").alias("time"))


def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    bars = B.bars_from_events(spark, d)
    return result(from_json(to_json(bars), bars.schema), "open", "high", "low", "close", "volume")


def bar_checks(spark: SparkSession, d: str) -> DataFrame:
    """Bars that are as bars must be, and those that are not, per symbol of ``bars``."""
    b = spark.read.parquet(f"{d}/bars.parquet").select("symbol", "open", "high", "low", "close", "volume")
    return nan_to_null(b).groupBy("symbol").agg(F.count(F.when(bar_is_valid(), 1)).alias("valid"), F.count(F.when(~bar_is_valid(), 1)).alias("invalid"))


def loose_instants(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of any unit and ISO texts as instants."""
    li = spark.read.parquet(f"{d}/liquidations.parquet").where("timestamp is not null").select("liquidation_id", F.unix_micros("timestamp").alias("u"))
    n, u = F.pmod("liquidation_id", F.lit(5)), F.col("u")
    text = F.when(n == 0, F.call_function("div", u, F.lit(1_000_000)).cast("string")).when(n == 1, F.call_function("div", u, F.lit(1000)).cast("string")).when(n == 2, u.cast("string")).when(n == 3, F.concat(u.cast("string"), F.lit("123"))).otherwise(F.date_format(F.timestamp_micros("u"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return li.select("liquidation_id", F.unix_micros(to_instant(text)).alias("us"))


def _streamed(spark: SparkSession, df: DataFrame, parts: int) -> DataFrame:
    """A stream of a frame with ``ts``, one file after the other in order of time."""
    root = shared_folder(spark, "stream")
    df.write.parquet(f"{root}/all")
    df = spark.read.parquet(f"{root}/all")
    lo, hi = df.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    part = F.least(F.floor((F.unix_micros("ts") - (lo or 0)) * parts / F.lit(max(1, (hi or 0) - (lo or 0)))), F.lit(parts - 1))
    for i in range(parts):
        df.where(part == i).coalesce(1).write.mode("append").parquet(f"{root}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")


def stream_rsi(spark: SparkSession, d: str) -> DataFrame:
    """Expressions over a stream of bars, in several micro-batches that hand on their state."""
    s = ExpressionStream(spark, shared_folder(spark, "expressions")).register("rsi", "rsi(14)").register("ema", "ema(20)")
    bars = B.bars_from_events(spark, d)
    s.start(_streamed(spark, bars, 4), availableNow=True).awaitTermination()
    return result(s.results(), "rsi", "ema")


def stream_clock_bars(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars from a stream of single prices; those whose hour has passed by the delay."""
    ticks = spark.read.parquet(f"{d}/events.parquet").where("value is not null and ts is not null").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    root = shared_folder(spark, "clock")
    bars = clock_bars(_streamed(spark, ticks, 1), "event_type", "ts", "value", F.round(F.col("value") * 100).cast("long"), tie="event_id")
    bars.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    schema = "symbol string, ts timestamp, open double, high double, low double, close double, volume long"
    return result(spark.read.schema(schema).parquet(f"{root}/out").withColumn("volume", F.col("volume") / 100), "open", "high", "low", "close", "volume")


def two_sources(spark: SparkSession, d: str) -> DataFrame:
    """An expression over bars and trades of the same keys and hours."""
    events = spark.read.parquet(f"{d}/events.parquet").where("value is not null and ts is not null")
    trades = events.groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts")).agg(F.count(F.lit(1)).cast("double").alias("volume"))
    trades = trades.select("symbol", F.lit("1h").alias("timeframe"), F.lit("trades").alias("source"), "ts", "volume")
    return result(evaluate(B.BarSet(B.bars_from_events(spark, d), trades=trades), "sma(trades.volume, 5) + close"), "value")


def shift_4h(spark: SparkSession, d: str) -> DataFrame:
    """A day back on bars of four hours: six bars."""
    bars = B.resample_clock(B.bars_from_events(spark, d), "4h")
    return result(evaluate(bars, "close - close.ago('24h')", timeframe="4h"), "value")


def split_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows over keys that are cut into pieces, as for a key that is too large for one task."""
    return result(evaluate_split(B.bars_from_events(spark, d), 100, value="sma(close, 20) + hma(9) - close.ago('3h')"), "value")


def split_recurrences(spark: SparkSession, d: str) -> DataFrame:
    """A mean that forgets, over keys that are cut into pieces."""
    return result(evaluate_split(B.bars_from_events(spark, d), 400, value="ema(5)"), "value")


EXPRESSIONS: dict[str, tuple[str, str]] = {
    "expr_trend_and_momentum": ("(sma(20) > sma(50)) and (rsi(14) < 30)", sql({"value": "!coalesce(m > n, false) AND coalesce(CASE WHEN s = 0 THEN CASE WHEN g > 0 THEN 100.0 ELSE 50.0 END ELSE 100 - 100 / (1 + g / s) END < 30, false)"}, {"d": f"{C} - {lag(C)}", "m": roll("avg", C, 20), "n": roll("avg", C, 50)}, {"lg": upto("CASE WHEN d IS NULL THEN NULL ELSE greatest(d, 0) END"), "ls": upto("CASE WHEN d IS NULL THEN NULL ELSE greatest(-d, 0) END")}, {"fg": "list_filter(lg, lambda x: x IS NOT NULL)", "fs": "list_filter(ls, lambda x: x IS NOT NULL)"}, {"g": wilder("fg", 14), "s": wilder("fs", 14)})),
    "expr_money_flow": ("((close - low) - (high - close)) / (high - low) * volume", sql({"value": f"({safe(f'({C} - low) - (high - {C})', 'high - low', '0.0')}) * volume"})),
    "expr_band": ("sma(close, 20) + 2 * rolling_std(close, 20)", sql({"value": f"({roll('avg', C, 20)}) + 2 * ({roll('stddev_pop', C, 20)})"})),
    "expr_distance": ("(close - sma(close, 20)) / sma(close, 20) * 100", sql({"value": f"({safe(f'{C} - m', 'm', '0.0')}) * 100"}, {"m": roll("avg", C, 20)})),
    "expr_nested": ("sma(change(periods=1), 5)", sql({"value": roll("avg", "x", 5)}, {"x": f"{C} - {lag(C)}"})),
    "expr_filter_mask": ("ohlcv.filter(volume > 1000).sum(close)", sql({"value": f"sum(CASE WHEN volume > 1000 THEN {C} ELSE 0 END) OVER (PARTITION BY symbol)"})),
    "expr_count": ("ohlcv.filter(volume > 1000).count()", sql({"value": "!CAST(count(CASE WHEN volume > 1000 THEN 1 END) OVER (PARTITION BY symbol) AS DOUBLE)"})),
    "expr_change_24": ("close.change_pct_24h > 5", sql({"value": f"!coalesce({safe(f'({C} - x) * 100', 'x')} > 5, false)"}, {"x": lag(C, 24)})),
    "expr_ago": ("close - close.ago('24h')", sql({"value": f"{C} - {lag(C, 24)}"})),
    "expr_chained": ("low < open < high", sql({"value": "!coalesce(low < open, false) AND coalesce(open < high, false)"})),
    "expr_mod_pow": ("volume % 7 + close ** 2", sql({"value": f"volume % 7 + power({C}, 2)"})),
    "expr_logic": ("(close > open and not (volume > 300)) or low <= 5", sql({"value": f"!coalesce(({C} > open AND NOT coalesce(volume > 300, false)) OR low <= 5, false)"})),
    "expr_compare": ("(diff(close) >= 0) == (diff(open) < 0)", sql({"value": f"!coalesce({C} - {lag(C)} >= 0, false) = coalesce(open - {lag('open')} < 0, false)"})),
    "expr_not_equal": ("close.ago('1h') != open", sql({"value": f"!coalesce({lag(C)} <> open, true)"})),
    "expr_unary": ("-close + +open", sql({"value": f"-{C} + open"})),
    "expr_truth": ("not diff(close)", sql({"value": f"!NOT coalesce({C} - {lag(C)} <> 0, false)"})),
    "expr_sum": ("close.sum()", sql({"value": f"sum({C}) OVER (PARTITION BY symbol)"})),
    "expr_avg": ("close.filter(rising(close)).avg()", sql({"value": "avg(CASE WHEN r THEN \"close\" END) OVER (PARTITION BY symbol)"}, {"r": f"{C} > {lag(C)}"})),
    "expr_max_min": ("high.max() - low.min()", sql({"value": "max(high) OVER (PARTITION BY symbol) - min(low) OVER (PARTITION BY symbol)"})),
    "expr_divide_by_zero": ("volume / (close - close)", sql({"value": "0.0"})),
    "expr_literal": ("crossup(close, 50)", sql({"value": f"!coalesce({C} > 50 AND {lag(C)} <= 50 AND rn > 1, false)"})),
    "expr_fold": ("sma(close, 2 * 3 + 1) * (2 ** 3)", sql({"value": f"({roll('avg', C, 7)}) * 8"})),
    "expr_multi_output": ("bbands(close, 20).upper > close", sql({"value": f"!coalesce(u > {C}, false)"}, {"u": f"({roll('avg', C, 20)}) + 2 * ({roll('stddev_pop', C, 20)})"})),
}

OPERATORS = _oracles()
STATEFUL = _stateful_sql()
_CHANNELS = ("in_channel", "out_channel", "enter", "exit")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: partial(channel, n) if n in _CHANNELS else partial(operator, n, p, timeframe="1d" if n in LONG_BARS else "1h") for n, (p, _) in OPERATORS.items()}
QUERIES |= {n: partial(operator, n, {}) for n in STATEFUL}
QUERIES |= {n: partial(expression, t) for n, (t, _) in EXPRESSIONS.items()}
QUERIES |= {f"downsample_{h}": partial(downsample, h) for h in B.AGGREGATES}
QUERIES |= {f"sync_{h}": partial(sync, h) for h in ("ffill", "linear")}
QUERIES |= {"align_inner": partial(align, "inner", "none"), "align_outer_ffill": partial(align, "outer", "ffill"), "align_left": partial(align, "left", "none"), "align_right": partial(align, "right", "none")}
QUERIES |= {f.__name__: f for f in (downsample_ohlcv, resample, resample_clock, upsample, trim, collapse, trades_filter_sum, derived_fields, catalog, crossings, ref, slice_time, filter_rows, dataset_info, append_rows, series_points, json_round_trip, bar_checks, loose_instants, stream_rsi, stream_clock_bars, two_sources, shift_4h, split_recurrences, split_windows)}
QUERIES |= {n: partial(operator, n, p) for n, p in (("fib_retracement", {}), ("fib_anchor_high", {}), ("fib_anchor_low", {}), ("fib_level_down", {"level": 0.5}), ("fib_level_up", {"level": 0.5}))}

_DOWN = {"first": "arg_min({c}, rn)", "last": "arg_max({c}, rn)", "mean": "avg({c})", "sum": "sum({c})", "max": "max({c})", "min": "min({c})"}


def _down(factor: int) -> str:
    ohlcv = ", ".join(f"round({_DOWN[h].format(c=c)}, 6) AS {c}" for c, h in (("open", "first"), ("high", "max"), ("low", "min"), (C, "last"), ("volume", "sum")))
    return f"WITH {BARS} SELECT symbol, epoch_us(max(ts)) AS ts_us, {ohlcv} FROM b GROUP BY symbol, (rn - 1) // {factor}"


_FOUR = f"{BARS}, f AS (SELECT symbol, max(ts) AS ts, arg_max({C}, rn) AS value FROM b GROUP BY symbol, (rn - 1) // 4)"
_LR = f"{BARS}, l AS (SELECT symbol, ts, {C} AS v FROM b WHERE hour(ts) % 2 = 0), r AS (SELECT symbol, ts, low AS v FROM b WHERE hour(ts) % 3 = 0)"
_JOIN = "SELECT symbol, epoch_us(ts) AS ts_us, round(l.v, 6) AS \"left\", round(r.v, 6) AS \"right\" FROM l {} JOIN r USING (symbol, ts)"
ORACLES: dict[str, str] = {n: q for n, (_, q) in OPERATORS.items()} | STATEFUL | {n: q for n, (_, q) in EXPRESSIONS.items()}
ORACLES |= {f"downsample_{h}": f"WITH {BARS} SELECT symbol, epoch_us(max(ts)) AS ts_us, round({e.format(c=C)}, 6) AS {C} FROM b GROUP BY symbol, (rn - 1) // 5" for h, e in _DOWN.items()}
ORACLES |= {
    "downsample_ohlcv": _down(4),
    "resample": _down(4),
    "resample_clock": f"WITH {BARS} SELECT symbol, epoch_us(date_trunc('day', ts)) AS ts_us, " + ", ".join(f"round({e}, 6) AS {c}" for c, e in (("open", "arg_min(open, ts)"), ("high", "max(high)"), ("low", "min(low)"), (C, f"arg_max({C}, ts)"), ("volume", "sum(volume)"))) + " FROM b GROUP BY symbol, date_trunc('day', ts)",
    "upsample": f"WITH {BARS}, n AS (SELECT *, {lag('1', -1)} IS NULL AS z FROM b) SELECT symbol, epoch_us(ts) AS ts_us, round({C}, 6) AS {C}, CAST(copy AS INT) AS copy FROM n, unnest(range(CASE WHEN z THEN 1 ELSE 3 END)) AS u(copy)",
    "trim": f"WITH {BARS} SELECT symbol, epoch_us(ts) AS ts_us, round({C}, 6) AS {C} FROM b WHERE rn > 10",
    "collapse": f"WITH {BARS} SELECT symbol, count({C}) AS n, round(sum({C}), 6) AS total, round(avg({C}), 6) AS mean, max({C}) AS top, min({C}) AS bottom FROM b GROUP BY symbol",
    "trades_filter_sum": "SELECT l_returnflag AS symbol, count(CASE WHEN l_quantity > 40 THEN l_extendedprice END) AS n, round(sum(CASE WHEN l_quantity > 40 THEN l_extendedprice END), 2) AS total, max(CASE WHEN l_quantity > 40 THEN l_extendedprice END) AS top FROM lineitem GROUP BY 1",
    "derived_fields": sql({"hlc3": "tp", "ohlc4": f"(open + high + low + {C}) / 4", "hl2": "mid", "range": "high - low", "upper_wick": f"high - greatest(open, {C})", "lower_wick": f"least(open, {C}) - low", "body_size": f"abs({C} - open)"}),
    "crossings": f"WITH {BARS}, s AS (SELECT *, {roll('avg', C, 20)} AS m FROM b), t AS (SELECT *, {lag(C)} AS c1, {lag('m')} AS m1 FROM s) SELECT symbol, epoch_us(ts) AS ts_us, round({C}, 6) AS {C}, round(m, 6) AS mean FROM t WHERE {C} > m AND c1 <= m1",
    "ref": f"WITH {BARS}, f AS (SELECT symbol, date_trunc('day', ts) AS ts, arg_max({C}, ts) AS value FROM b GROUP BY 1, 2), z AS (SELECT symbol, arg_min(value, ts) AS v0 FROM f GROUP BY symbol) SELECT b.symbol, epoch_us(b.ts) AS ts_us, round(b.{C}, 6) AS {C}, round(coalesce(f.value, z.v0), 6) AS value FROM b ASOF LEFT JOIN f ON b.symbol = f.symbol AND b.ts >= f.ts JOIN z ON z.symbol = b.symbol",
    "slice_time": f"WITH {BARS} SELECT symbol, epoch_us(ts) AS ts_us, round({C}, 6) AS {C} FROM b WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-06 12:00:00'",
    "filter_rows": f"WITH {BARS} SELECT symbol, epoch_us(ts) AS ts_us, round({C}, 6) AS {C} FROM b WHERE {C} > open AND volume > 500",
    "dataset_info": f"WITH {BARS} SELECT symbol, count(*) AS n, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM b GROUP BY symbol",
    "append_rows": f"WITH {BARS}, l AS (SELECT symbol, max(ts) AS t FROM b WHERE day(ts) > 10 GROUP BY 1) SELECT b.symbol, count(*) AS n, CAST(count(CASE WHEN day(b.ts) <= 10 AND b.ts < l.t THEN 1 END) AS BIGINT) AS too_early FROM b LEFT JOIN l ON l.symbol = b.symbol GROUP BY b.symbol",
    "series_points": f"WITH {BARS}, s AS (SELECT *, {roll('max', C, 30)} AS v FROM b) SELECT symbol, epoch_us(ts) AS ts_us, v AS value, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS time FROM s WHERE v IS NOT NULL",
    "json_round_trip": sql({c: '"close"' if c == "close" else c for c in ("open", "high", "low", "close", "volume")}).replace("AS close", 'AS "close"'),
    "bar_checks": "WITH x AS (SELECT symbol, CASE WHEN isnan(open) THEN NULL ELSE open END AS o, high AS h, low AS l, \"close\" AS c, volume AS v FROM bars), y AS (SELECT symbol, h >= l AND h >= greatest(o, c) AND l <= least(o, c) AND v >= 0 AS ok FROM x) SELECT symbol, count(CASE WHEN ok THEN 1 END) AS valid, count(CASE WHEN NOT ok THEN 1 END) AS invalid FROM y GROUP BY symbol",
    "loose_instants": "SELECT liquidation_id, CASE liquidation_id % 5 WHEN 1 THEN u // 1000 * 1000 WHEN 2 THEN u WHEN 3 THEN u ELSE u // 1000000 * 1000000 END AS us FROM (SELECT liquidation_id, epoch_us(timestamp) AS u FROM liquidations WHERE timestamp IS NOT NULL)",
    "stream_rsi": sql({"rsi": "CASE WHEN g IS NULL THEN NULL WHEN s = 0 THEN CASE WHEN g > 0 THEN 100.0 ELSE 50.0 END ELSE 100 - 100 / (1 + g / s) END", "ema": smooth("l", 2 / 21)}, {"d": f"{C} - {lag(C)}", "l": upto(C)}, {"lg": upto("CASE WHEN d IS NULL THEN NULL ELSE greatest(d, 0) END"), "ls": upto("CASE WHEN d IS NULL THEN NULL ELSE greatest(-d, 0) END")}, {"fg": "list_filter(lg, lambda x: x IS NOT NULL)", "fs": "list_filter(ls, lambda x: x IS NOT NULL)"}, {"g": wilder("fg", 14), "s": wilder("fs", 14)}),
    "stream_clock_bars": f"WITH {BARS} SELECT symbol, epoch_us(ts) AS ts_us, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round({C}, 6) AS {C}, round(volume, 6) AS volume FROM b WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events WHERE value IS NOT NULL)",
    "two_sources": f"WITH {BARS}, t AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, CAST(count(*) AS DOUBLE) AS v FROM events WHERE value IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2), x AS (SELECT b.*, t.v FROM b LEFT JOIN t USING (symbol, ts)) SELECT symbol, epoch_us(ts) AS ts_us, round(CASE WHEN count(v) OVER w = 5 THEN avg(v) OVER w END + {C}, 6) AS value FROM x WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 4 PRECEDING)",
    "shift_4h": f"WITH {BARS}, f AS (SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts) AS ts, arg_max({C}, ts) AS v FROM b GROUP BY 1, 2) SELECT symbol, epoch_us(ts) AS ts_us, round(v - lag(v, 6) OVER (PARTITION BY symbol ORDER BY ts), 6) AS value FROM f",
    "split_recurrences": sql({"value": smooth("l", 2 / 6)}, {"l": upto(C)}),
    "split_windows": sql({"value": f"({roll('avg', C, 20)}) + ({wma_sql('x', 3)}) - {lag(C, 3)}"}, {"a": wma_sql(C, 4), "z": wma_sql(C, 9)}, {"x": "2 * a - z"}),
    "sync_ffill": f"WITH {_FOUR}, z AS (SELECT symbol, arg_min(value, ts) AS v0 FROM f GROUP BY symbol) SELECT b.symbol, epoch_us(b.ts) AS ts_us, round(coalesce(f.value, z.v0), 6) AS value FROM b ASOF LEFT JOIN f ON b.symbol = f.symbol AND b.ts >= f.ts JOIN z ON z.symbol = b.symbol",
    "sync_linear": f"WITH {_FOUR}, p AS (SELECT b.symbol, b.ts, f.ts AS t0, f.value AS v0 FROM b ASOF LEFT JOIN f ON b.symbol = f.symbol AND b.ts >= f.ts), q AS (SELECT p.*, f.ts AS t1, f.value AS v1 FROM p ASOF LEFT JOIN f ON p.symbol = f.symbol AND p.ts <= f.ts) SELECT symbol, epoch_us(ts) AS ts_us, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * ((epoch_us(ts) - epoch_us(t0)) / (epoch_us(t1) - epoch_us(t0))) END, 6) AS value FROM q",
    "align_inner": f"WITH {_LR} " + _JOIN.format(""),
    "align_left": f"WITH {_LR} " + _JOIN.format("LEFT"),
    "align_right": f"WITH {_LR} " + _JOIN.format("RIGHT"),
    "align_outer_ffill": f"WITH {_LR}, j AS (SELECT symbol, ts, l.v AS a, r.v AS z FROM l FULL JOIN r USING (symbol, ts)) SELECT symbol, epoch_us(ts) AS ts_us, round(last_value(a IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), 6) AS \"left\", round(last_value(z IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), 6) AS \"right\" FROM j",
}
