"""Trees to DataFrames."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom import registry
from tickloom.bars import BarSet, order
from tickloom.functions.build import Build
from tickloom.functions.indicators import safe_div
from tickloom.plans import ir
from tickloom.plans.parser import ExpressionError, bind, boolean
from tickloom.plans.planner import Plan, plan
from tickloom.schema import KEYS


def _lower(b: Build, root: ir.Node) -> Column:
    """Each distinct node once; windows and scans share the builder's stages."""
    done: dict[ir.Node, Column] = {}

    def number(n: ir.Node) -> Column:
        c = visit(n)
        return F.when(c, 1.0).otherwise(0.0) if boolean(n) else c

    def truth(n: ir.Node) -> Column:
        if isinstance(n, ir.Literal):
            return F.lit(bool(n.value))
        c = visit(n)
        return F.coalesce(c, F.lit(False)) if boolean(n) else F.coalesce(c != 0, F.lit(False))

    def visit(n: ir.Node) -> Column:
        if n not in done:
            done[n] = compute(n)
        return done[n]

    def compute(n: ir.Node) -> Column:
        if isinstance(n, ir.Literal):
            return F.lit(n.value)
        if isinstance(n, ir.SourceRef):
            return b.field(n.name if n.source == "ohlcv" else f"{n.source}_{n.name}")
        if isinstance(n, ir.Unary):
            if n.op == "not":
                return ~truth(n.operand)
            return -number(n.operand) if n.op == "neg" else number(n.operand)
        if isinstance(n, ir.Binary):
            if n.op in ("and", "or"):
                x, y = truth(n.left), truth(n.right)
                return x & y if n.op == "and" else x | y
            x, y = number(n.left), number(n.right)
            if n.op == "neq":
                return F.coalesce(x != y, F.lit(True))
            compare = {"gt": lambda: x > y, "gte": lambda: x >= y, "lt": lambda: x < y, "lte": lambda: x <= y, "eq": lambda: x == y}
            if n.op in compare:
                return F.coalesce(compare[n.op](), F.lit(False))
            return {"add": lambda: x + y, "sub": lambda: x - y, "mul": lambda: x * y, "div": lambda: safe_div(x, y, 0.0), "mod": lambda: F.try_mod(x, y), "pow": lambda: _finite(F.pow(x, y))}[n.op]()
        if isinstance(n, ir.Filter):
            return F.when(truth(n.condition), visit(n.series))
        if isinstance(n, ir.Aggregate):
            x = b.let(number(n.series))
            agg = {"count": F.count, "sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min}[n.op](x).over(b.whole)
            return b.let(F.coalesce(agg, F.lit(0.0)) if n.op == "sum" else agg.cast("double"))
        if isinstance(n, ir.TimeShift):
            x = b.let(number(n.series))
            y = b.lag(x, n.bars)
            return {"ago": lambda: y, "change": lambda: x - y, "change_pct": lambda: safe_div((x - y) * 100.0, y)}[n.op]()
        if isinstance(n, ir.Call):
            return call(n)
        raise ExpressionError(f"cannot compute {n}")

    def call(n: ir.Call) -> Column:
        op, params = registry.find(n.name), bind(n)
        inputs = {k: (v if isinstance(v, (int, float)) else b.let(number(v))) if isinstance(v, ir.Node) or isinstance(v, (int, float)) else v for k, v in params.items() if k in registry.INPUTS}
        key = ir.Call(n.name, n.args, n.kwargs)
        out = results.get(key)
        if out is None:
            out = results[key] = op.fn(b, **params | inputs)
        if isinstance(out, dict):
            return out[n.output] if n.output else next(iter(out.values()))
        if isinstance(out, (list, tuple)):
            return out[op.outputs.index(n.output) if n.output else 0]
        return out

    results: dict[ir.Call, Any] = {}
    return visit(root)


def numbered(df: DataFrame) -> DataFrame:
    """The frame with ``__rn``, each row's number in its key, without bringing a key into one task.

    Rows are numbered within a day; the counts of the days before are added.
    """
    day = df.withColumn("__day", F.unix_date(F.col("ts").cast("date")))
    counts = day.groupBy(*KEYS, "__day").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*KEYS).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*KEYS, "__day", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*KEYS, "__day").orderBy(*order(df))
    return day.join(counts, [*KEYS, "__day"]).withColumn("__rn", F.row_number().over(within) + F.col("__before")).select(*df.columns, "__rn")


def evaluate_split(df: DataFrame, piece_rows: int = 1_000_000, timeframe: str | None = None, **named: str) -> DataFrame:
    """As ``evaluate``, for keys too large for one task: they are cut into pieces of ``piece_rows`` rows.

    Each piece brings along as many rows of its neighbours as the expressions look
    back (or ahead). Means that forget (ema, rma, macd, rsi, atr, adx, keltner, klinger, elder_ray) bring along as many as they remember: what
    lies further back weighs less than 2^-60 of its value, so the results are those of the whole key but for the last bits. Rows whose inputs are
    null are no memory; a piece needs that many others. What is cumulative, or does not forget (psar, supertrend, Fibonacci legs), needs all of its past.
    """
    plans = {k: plan(t, timeframe) for k, t in named.items()}
    for k, p in plans.items():
        if p.memory is None:
            raise ExpressionError(f"{named[k]!r} needs all rows before")
    margin = max([1, *[p.memory for p in plans.values()], *[n for p in plans.values() for n in p.lookback.values()]])
    if piece_rows < margin:
        raise ValueError(f"a piece must have at least {margin} rows")
    rows = numbered(df)
    home = F.floor((F.col("__rn") - 1) / piece_rows)
    reach = F.array_distinct(F.array(home, F.floor((F.col("__rn") - 1 - margin) / piece_rows), F.floor((F.col("__rn") - 1 + margin) / piece_rows)))
    rows = rows.withColumns({"__home": home, "__piece": F.explode(reach)})
    b = Build(rows, [*KEYS, "__piece"], rn="__rn")
    columns = {k: _lower(b, p.root) for k, p in plans.items()}
    return b.done(**columns).where(F.col("__home") == F.col("__piece")).select(*df.columns, *named)


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def evaluate(data: DataFrame | BarSet, *expressions: str, timeframe: str | None = None, **named: str) -> DataFrame:
    """The frame with one column per expression (``value``, or ``value1 value2 ...``, or the names given).

    All expressions are lowered together: they share the exchange, the
    sort, equal parts, and the pass of their scans. With a ``timeframe``, that of the bars, durations such as ``24h`` are counted in it.
    """
    texts = named | ({"value": expressions[0]} if len(expressions) == 1 else {f"value{i}": t for i, t in enumerate(expressions, 1)})
    plans = {k: plan(t, timeframe) for k, t in texts.items()}
    df = data.wide() if isinstance(data, BarSet) else data
    b = Build(df)
    columns = {k: _lower(b, p.root) for k, p in plans.items()}
    return b.done(**columns)


def recent(df: DataFrame, p: Plan) -> DataFrame:
    """Only the rows that the last value of each key needs, if their number is bounded."""
    if not p.bounded or not p.lookback:
        return df
    w = Window.partitionBy(*KEYS).orderBy(*[F.desc(c) for c in order(df)])
    return df.withColumn("__back", F.row_number().over(w)).where(F.col("__back") <= max(p.lookback.values())).drop("__back")


def validate(text: str) -> list[str]:
    """What is wrong with an expression; nothing if it can run."""
    try:
        plan(text)
    except (ValueError, TypeError) as e:
        return [str(e)]
    return []


def analyze(text: str) -> dict[str, Any]:
    """Fields and rows of history that an expression needs."""
    p = plan(text)
    return {"hash": p.hash, "nodes": len(p.nodes), "bounded": p.bounded, "lookback": {f"{s}.{f}": n for (s, f), n in sorted(p.lookback.items())}}


def triggers(data: DataFrame | BarSet, text: str) -> DataFrame:
    """The rows on which a condition holds."""
    if not boolean(plan(text).root):
        raise ExpressionError(f"no condition: {text!r}")
    return evaluate(data, text).where("value").drop("value")


def all_of(*conditions: str) -> str:
    return reduce(lambda a, c: f"({a}) and ({c})", conditions)
