"""Operators over streams of bars, step by step, and saved states.

The kernels of the batch scan are the state of the stream: batch, stream
and replay give the same numbers. Bars of a micro-batch are taken in order of time; a bar that is
late (not after the last one of its key) or not closed changes no state and gives nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import kernels as K
from tickloom.schema import KEYS

SCHEMA_VERSION = 1
READY, WARMING_UP, MISSING_INPUT, ERROR = "ready", "warming_up", "missing_input", "error"
#: Operators that can run on a stream.
STREAMED: dict[str, Callable[..., K.Kernel]] = {
    "ema": K.ema, "rma": K.rma, "macd": K.Macd, "rsi": K.Rsi, "atr": K.Atr, "adx": K.Adx, "keltner": K.Keltner, "elder_ray": K.ElderRay,
    "supertrend": K.Supertrend, "vwap": K.Vwap, "stoch_k": K.StochasticK,
}


@dataclass(frozen=True)
class Node:
    """One operator of a stream, under a name of its own."""

    name: str
    operator: str
    params: tuple = ()

    def kernel(self) -> K.Kernel:
        if self.operator not in STREAMED:
            raise ValueError(f"{self.operator!r} cannot run on a stream; these can: {', '.join(STREAMED)}")
        return STREAMED[self.operator](*self.params)

    def columns(self) -> list[str]:
        outs = self.kernel().outputs
        return [self.name] if len(outs) == 1 else [f"{self.name}_{o}" for o in outs]


class Stepper:
    """Nodes stepped bar by bar, for one key; its state can be saved, restored and replayed."""

    def __init__(self, *nodes: Node, missing: str = "emit"):
        if missing not in ("emit", "hold", "fail"):
            raise ValueError(f"unknown policy {missing!r}")
        self.nodes, self.missing = nodes, missing
        self.kernels = [n.kernel() for n in nodes]
        self.initialize()

    def initialize(self) -> None:
        self.states = [k.start() for k in self.kernels]
        self.last: list[tuple] = [(None,) * len(k.outputs) for k in self.kernels]
        self.index = 0

    def step(self, bar: dict[str, Any]) -> dict[str, Any]:
        """(column -> value) after one bar; a missing input gives nulls, the last values (``hold``) or an error (``fail``)."""
        out: dict[str, Any] = {}
        self.index += 1
        for i, (n, k) in enumerate(zip(self.nodes, self.kernels)):
            x = [None if (v := bar.get(c)) is None or v != v else float(v) for c in k.inputs]
            if None in x and self.missing == "fail":
                raise ValueError(f"{n.name}: no {k.inputs[x.index(None)]} at event {self.index}")
            values = self.last[i] if None in x and self.missing == "hold" else k.advance(self.states[i], *x)
            self.last[i] = values
            out |= dict(zip(n.columns(), values))
        return out

    def availability(self, bar: dict[str, Any]) -> dict[str, str]:
        """State of each node after ``bar``."""
        return {n.name: MISSING_INPUT if any(bar.get(c) is None for c in k.inputs) else READY if all(v is not None for v in last) else WARMING_UP for n, k, last in zip(self.nodes, self.kernels, self.last)}

    def snapshot(self) -> str:
        return json.dumps({"schema_version": SCHEMA_VERSION, "last_event_index": self.index, "nodes": {n.name: {"state": s, "last": list(v)} for n, s, v in zip(self.nodes, self.states, self.last)}})

    def restore(self, saved: str) -> None:
        d = json.loads(saved)
        if d.get("schema_version") != SCHEMA_VERSION:
            raise ValueError(f"cannot read a snapshot of version {d.get('schema_version')!r}")
        self.index = d["last_event_index"]
        self.states = [d["nodes"][n.name]["state"] for n in self.nodes]
        self.last = [tuple(d["nodes"][n.name]["last"]) for n in self.nodes]

    def replay(self, saved: str, bars: list[dict[str, Any]]) -> list[dict[str, Any]]:
        """Go on from a snapshot."""
        self.restore(saved)
        return [self.step(b) for b in bars]


def indicators(bars: DataFrame, *nodes: Node) -> DataFrame:
    """A stream of bars to (keys, ts, outputs): one row for each closed bar in time."""
    out_columns = [c for n in nodes for c in n.columns()]
    needed = list(dict.fromkeys(c for n in nodes for c in n.kernel().inputs))
    schema = ", ".join([*[f"{k} string" for k in KEYS], "ts timestamp", *[f"`{c}` double" for c in out_columns]])

    def advance(key: tuple, parts: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        stepper = Stepper(*nodes)
        last = None
        if state.exists:
            saved, last = state.get
            stepper.restore(saved)
            last = pd.Timestamp(last) if last is not None else None
        pdf = pd.concat(list(parts)).sort_values("ts", kind="stable")
        rows = []
        for bar in pdf.to_dict("records"):
            if bar.get("is_closed") is False or (last is not None and bar["ts"] <= last):
                continue
            last = bar["ts"]
            rows.append((*key, last, *stepper.step(bar).values()))
        state.update((stepper.snapshot(), None if last is None else last.isoformat()))
        yield pd.DataFrame(rows, columns=[*KEYS, "ts", *out_columns])

    columns = [*KEYS, "ts", *needed, *[c for c in ("is_closed",) if c in bars.columns]]
    return bars.select(*dict.fromkeys(columns)).groupBy(*KEYS).applyInPandasWithState(advance, schema, "saved string, last string", "append", "NoTimeout")


def deduplicated(bars: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Without bars that came again, as far back as ``delay``."""
    return bars.withWatermark("ts", delay).dropDuplicatesWithinWatermark([*KEYS, "ts"])


def clock_bars(ticks: DataFrame, symbol: str, ts: str, price: str, size: Any, every: str = "1 hour", delay: str = "1 hour", tie: str | None = None) -> DataFrame:
    """Bars from a stream of single prices; a bar comes out when its time has passed by ``delay``. Prices of one instant go by ``tie``, else by price."""
    t = ticks.withWatermark(ts, delay)
    at = F.struct(F.col(ts), F.col(tie or price))
    g = t.groupBy(F.col(symbol).alias("symbol"), F.window(ts, every).alias("w")).agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.sum(size).alias("volume"))
    return g.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


class Stream:
    """Named nodes over bars that come one by one, with callbacks when one becomes ready."""

    def __init__(self) -> None:
        self._nodes: dict[str, Node] = {}
        self._calls: list[Callable[[str, tuple, dict], None]] = []
        self._steppers: dict[tuple, Stepper] = {}
        self._ready: dict[tuple, set[str]] = {}
        self._last: dict[tuple, Any] = {}

    def register(self, name: str, operator: str, *params: Any) -> None:
        if name in self._nodes:
            raise ValueError(f"{name!r} is registered already")
        node = Node(name, operator, params)
        node.kernel()
        self._nodes[name] = node
        self._steppers.clear()

    def on_transition(self, call: Callable[[str, tuple, dict], None]) -> None:
        """``call(name, key, bar)`` when a node of a key becomes ready."""
        self._calls.append(call)

    def update(self, bar: dict[str, Any]) -> dict[str, Any]:
        key = tuple(bar[k] for k in KEYS)
        if key in self._last and bar["ts"] < self._last[key]:
            raise ValueError(f"bar of {bar['ts']} comes after {self._last[key]}")
        self._last[key] = bar["ts"]
        stepper = self._steppers.setdefault(key, Stepper(*self._nodes.values()))
        out = stepper.step(bar)
        ready = {n for n, s in stepper.availability(bar).items() if s == READY}
        for name in sorted(ready - self._ready.get(key, set())):
            for call in self._calls:
                call(name, key, bar)
        self._ready[key] = ready
        return out


def each_transition(call: Callable[[DataFrame, int], None], column: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that passes on the rows on which ``column`` has a value."""
    return lambda df, epoch: call(df.where(F.col(column).isNotNull()), epoch)
