"""Recursive operators as kernels: a state and a step.

The same kernel drives the ordered scan of a batch plan and the state of a stream.
Linear recurrences (all means, and what is built of them) run over a batch as array scans of affine maps: ``y = a y + b`` composes with the map before
it, so that log2(n) passes over arrays give all rows. What is not linear steps row by row.
States are plain lists of numbers, so that they can be saved. A step whose inputs
hold a null gives nulls and leaves the state as it is.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

import numpy as np


def affine_scan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """y[i] = a[i] y[i - 1] + b[i], beginning from 0."""
    a, y = a.copy(), b.copy()
    d = 1
    while d < len(y):
        y[d:] += a[d:] * y[:-d]
        a[d:] = a[d:] * a[:-d]
        if not a.any():
            break
        d *= 2
    return y


class Rows:
    """The rows of a batch on which a kernel steps, in segments of one key; the first may go on from the batch before."""

    def __init__(self, at: np.ndarray, segment: np.ndarray, last: int, goes_on: bool):
        self.at, self.segment, self.last, self.goes_on = at, segment, last, goes_on
        n = len(at)
        self.first = np.ones(n, bool)
        self.first[1:] = segment[1:] != segment[:-1]
        self.carried = bool(goes_on and n and segment[0] == 0)  # whether row 0 has a state before it
        start = np.flatnonzero(self.first)
        self.rank = np.arange(1, n + 1) - np.repeat(start, np.diff(np.r_[start, n]))

    @classmethod
    def of(cls, n: int, fresh: Sequence[int], columns: Sequence[np.ndarray]) -> Rows:
        begins = np.zeros(n, bool)
        begins[list(fresh)] = True
        segment = np.cumsum(begins)
        ok = np.ones(n, bool)
        for c in columns:
            ok &= ~np.isnan(c)
        at = np.flatnonzero(ok)
        return cls(at, segment[at], int(segment[-1]), not (len(fresh) and fresh[0] == 0))

    def where(self, mask: np.ndarray) -> Rows:
        return Rows(self.at[mask], self.segment[mask], self.last, self.goes_on)

    def keep(self, before: Any, start: Any, after: Any) -> Any:
        """The state at the end of the batch: of the last key, if it has a row here; else what it had."""
        if len(self.at) and self.segment[-1] == self.last:
            return after
        return before if self.last == 0 and self.goes_on else start

    def previous(self, x: np.ndarray, before: float | None) -> np.ndarray:
        """The value on the row before of the same key; NaN if there is none."""
        out = np.empty(len(x))
        out[1:] = x[:-1]
        out[self.first] = np.nan
        if self.carried and before is not None:
            out[0] = before
        return out

    def scan(self, a: np.ndarray, b: np.ndarray, before: float) -> np.ndarray:
        b = b.copy()
        a = a.copy()
        if self.carried:
            b[0] += a[0] * before
        a[self.first] = 0.0
        return affine_scan(a, b)

    def spread(self, n: int, values: np.ndarray) -> np.ndarray:
        out = np.full(n, np.nan)
        out[self.at] = values
        return out


class Kernel:
    outputs: tuple[str, ...] = ("value",)
    inputs: tuple[str, ...] = ("close",)

    @property
    def types(self) -> tuple[str, ...]:
        return ("double",) * len(self.outputs)

    def start(self) -> list[Any]:
        raise NotImplementedError

    def step(self, s: list[Any], *x: float) -> tuple:
        """Change the state and give one value for each output."""
        raise NotImplementedError

    def advance(self, s: list[Any], *x: float | None) -> tuple:
        if any(v is None for v in x):
            return (None,) * len(self.outputs)
        return self.step(s, *x)

    def run(self, state: list[Any] | None, columns: Sequence[Sequence], n: int, fresh: Sequence[int]) -> tuple[list[Any], list[list]]:
        """All rows of a batch; ``fresh`` holds the positions where a new key begins. NaN is null."""
        s = self.start() if state is None else state
        columns = [[None if x != x else x for x in np.asarray(c, float).tolist()] for c in columns]
        out: list[list] = [[None] * n for _ in self.outputs]
        begin = set(fresh)
        for i in range(n):
            if i in begin:
                s = self.start()
            for o, v in zip(out, self.advance(s, *[c[i] for c in columns])):
                o[i] = v
        return s, out


class Linear(Kernel):
    """A kernel whose steps are affine in its state."""

    def arrays(self, s: list[Any], rows: Rows, *x: np.ndarray) -> tuple[tuple[np.ndarray, ...], list[Any]]:
        """The outputs on ``rows``, whose inputs are ``x``, and the state after them."""
        raise NotImplementedError

    def run(self, state, columns, n, fresh):
        columns = [np.asarray(c, float) for c in columns]
        rows = Rows.of(n, fresh, columns)
        values, after = self.arrays(self.start() if state is None else state, rows, *[c[rows.at] for c in columns])
        return after, [rows.spread(n, v) for v in values]


def period(p: int) -> int:
    if not isinstance(p, int) or p < 1:
        raise ValueError(f"a period is a whole number above 0, not {p!r}")
    return p


class Smooth(Linear):
    """y = y + alpha (x - y), beginning with the first x."""

    def arrays(self, s, rows, x):
        known = rows.carried and s[0] is not None
        b = self.alpha * x
        begins = rows.first.copy()
        if known:
            begins[0] = False
        b[begins] = x[begins]
        y = rows.scan(np.full(len(x), 1 - self.alpha), b, s[0] if known else 0.0)
        return (y,), rows.keep(s, self.start(), [float(y[-1])] if len(y) else s)

    def __init__(self, alpha: float):
        self.alpha = alpha

    def start(self):
        return [None]

    def step(self, s, x):
        s[0] = x if s[0] is None else self.alpha * x + (1 - self.alpha) * s[0]
        return (s[0],)


def ema(p: int) -> Smooth:
    return Smooth(2.0 / (period(p) + 1))


def rma(p: int) -> Smooth:
    return Smooth(1.0 / period(p))


class Macd(Linear):
    outputs = ("macd", "signal", "histogram")

    def arrays(self, s, rows, x):
        f, sl, sg = self.parts
        (a,), s0 = f.arrays(s[0], rows, x)
        (b,), s1 = sl.arrays(s[1], rows, x)
        m = a - b
        (g,), s2 = sg.arrays(s[2], rows, m)
        return (m, g, m - g), [s0, s1, s2]

    def __init__(self, fast: int = 12, slow: int = 26, signal: int = 9):
        if period(fast) >= period(slow):
            raise ValueError("the fast period must be below the slow one")
        self.parts = ema(fast), ema(slow), ema(signal)

    def start(self):
        return [k.start() for k in self.parts]

    def step(self, s, x):
        f, sl, sg = self.parts
        m = f.step(s[0], x)[0] - sl.step(s[1], x)[0]
        g = sg.step(s[2], m)[0]
        return m, g, m - g


class Wilder(Linear):
    """Mean of the first ``p`` values, then y = (y (p - 1) + x) / p."""

    def arrays(self, s, rows, x):
        p = self.p
        rank = rows.rank.copy()
        if rows.carried:
            rank[rows.segment == 0] += s[0]
        a = np.where(rank < p, 1.0, np.where(rank == p, 1.0 / p, (p - 1) / p))
        y = rows.scan(a, np.where(rank < p, x, x / p), s[1])
        return (np.where(rank >= p, y, np.nan),), rows.keep(s, self.start(), [int(rank[-1]), float(y[-1])] if len(y) else s)

    def __init__(self, p: int):
        self.p = period(p)

    def start(self):
        return [0, 0.0]

    def step(self, s, x):
        s[0] += 1
        if s[0] < self.p:
            s[1] += x
            return (None,)
        s[1] = (s[1] + x) / self.p if s[0] == self.p else (s[1] * (self.p - 1) + x) / self.p
        return (s[1],)


class Rsi(Linear):
    def arrays(self, s, rows, x):
        d = x - rows.previous(x, s[0])
        has = ~np.isnan(d)
        inner, d = rows.where(has), d[has]
        # a key whose first row is here has no state of means yet
        (gain,), s1 = self.mean.arrays(s[1], inner, np.maximum(d, 0.0))
        (loss,), s2 = self.mean.arrays(s[2], inner, np.maximum(-d, 0.0))
        with np.errstate(divide="ignore", invalid="ignore"):
            v = np.where(loss == 0, np.where(gain > 0, 100.0, 50.0), 100.0 - 100.0 / (1.0 + gain / loss))
        out = np.full(len(x), np.nan)
        out[has] = np.where(np.isnan(gain), np.nan, v)
        return (out,), [rows.keep(s[0], None, float(x[-1]) if len(x) else None), s1, s2]

    def __init__(self, p: int = 14):
        self.mean = Wilder(p)

    def start(self):
        return [None, self.mean.start(), self.mean.start()]

    def step(self, s, x):
        before, s[0] = s[0], x
        if before is None:
            return (None,)
        d = x - before
        gain, loss = self.mean.step(s[1], max(d, 0.0))[0], self.mean.step(s[2], max(-d, 0.0))[0]
        if gain is None:
            return (None,)
        if loss == 0:
            return (100.0 if gain > 0 else 50.0,)
        return (100.0 - 100.0 / (1.0 + gain / loss),)


def true_range(before: float | None, h: float, lw: float) -> float:
    return h - lw if before is None else max(h - lw, abs(h - before), abs(lw - before))


def true_ranges(rows: Rows, before: float | None, h: np.ndarray, lw: np.ndarray, c: np.ndarray) -> np.ndarray:
    prev = rows.previous(c, before)
    return np.where(np.isnan(prev), h - lw, np.maximum(h - lw, np.maximum(np.abs(h - prev), np.abs(lw - prev))))


class Atr(Linear):
    inputs = ("high", "low", "close")

    def arrays(self, s, rows, h, lw, c):
        (y,), s1 = self.mean.arrays(s[1], rows, true_ranges(rows, s[0], h, lw, c))
        return (y,), [rows.keep(s[0], None, float(c[-1]) if len(c) else None), s1]

    def __init__(self, p: int = 14):
        self.mean = Wilder(p)

    def start(self):
        return [None, self.mean.start()]

    def step(self, s, h, lw, c):
        tr = true_range(s[0], h, lw)
        s[0] = c
        return self.mean.step(s[1], tr)


class Adx(Linear):
    inputs = ("high", "low", "close")
    outputs = ("adx", "plus_di", "minus_di")

    def arrays(self, s, rows, h, lw, c):
        p, n = self.p, len(h)
        rank = rows.rank.copy()
        if rows.carried:
            rank[rows.segment == 0] += s[0]
        a, b = h - rows.previous(h, s[1]), rows.previous(lw, s[2]) - lw
        begin = np.isnan(a)
        tr = np.where(begin, 0.0, true_ranges(rows, s[3], h, lw, c))
        up, down = np.where((a > b) & (a > 0), a, 0.0), np.where((b > a) & (b > 0), b, 0.0)
        keep = np.where(rank <= p, 1.0, 1.0 - 1.0 / p)
        sums = [rows.scan(keep, v, before) for v, before in zip((tr, up, down), s[4:7])]
        known = (rank >= p) & (sums[0] > 0)
        plus, minus = (100.0 * v[known] / sums[0][known] for v in sums[1:])
        total = plus + minus
        dx = np.where(total > 0, 100.0 * np.abs(plus - minus) / np.where(total > 0, total, 1.0), 0.0)
        (mean,), s7 = Wilder(p).arrays(s[7], rows.where(known), dx)
        out = [np.full(n, np.nan) for _ in range(3)]
        for o, v in zip(out, (mean, plus, minus)):
            o[known] = v
        after = [int(rank[-1]), float(h[-1]), float(lw[-1]), float(c[-1]), *(float(v[-1]) for v in sums)] if n else s[:7]
        return tuple(out), [*rows.keep(s[:7], self.start()[:7], after), s7]

    def __init__(self, p: int = 14):
        self.p = period(p)

    def start(self):
        # rows, high, low, close, smoothed range, plus, minus, number and mean of DX
        return [0, None, None, None, 0.0, 0.0, 0.0, Wilder(self.p).start()]

    def step(self, s, h, lw, c):
        p = self.p
        if s[0] == 0:
            tr = up = down = 0.0
        else:
            tr = true_range(s[3], h, lw)
            a, b = h - s[1], s[2] - lw
            up, down = (a if a > b and a > 0 else 0.0), (b if b > a and b > 0 else 0.0)
        s[0] += 1
        s[1:4] = h, lw, c
        for i, v in ((4, tr), (5, up), (6, down)):
            s[i] = s[i] + v if s[0] <= p else s[i] - s[i] / p + v
        if s[0] < p:
            return None, None, None
        if s[4] <= 0:
            return None, None, None
        plus, minus = 100.0 * s[5] / s[4], 100.0 * s[6] / s[4]
        total = plus + minus
        dx = 100.0 * abs(plus - minus) / total if total > 0 else 0.0
        return Wilder(p).step(s[7], dx)[0], plus, minus


class Keltner(Linear):
    inputs = ("high", "low", "close")
    outputs = ("upper", "middle", "lower")

    def arrays(self, s, rows, h, lw, c):
        (mid,), s0 = self.ema.arrays(s[0], rows, c)
        (atr,), s1 = self.atr.arrays(s[1], rows, h, lw, c)
        return (mid + self.m * atr, mid, mid - self.m * atr), [s0, s1]

    def __init__(self, ema_period: int = 20, atr_period: int = 10, multiplier: float = 2.0):
        self.ema, self.atr, self.m = ema(ema_period), Atr(atr_period), multiplier

    def start(self):
        return [self.ema.start(), self.atr.start()]

    def step(self, s, h, lw, c):
        mid, atr = self.ema.step(s[0], c)[0], self.atr.step(s[1], h, lw, c)[0]
        return (None, mid, None) if atr is None else (mid + self.m * atr, mid, mid - self.m * atr)


class ElderRay(Linear):
    inputs = ("high", "low", "close")
    outputs = ("bull", "bear")

    def arrays(self, s, rows, h, lw, c):
        (m,), after = self.ema.arrays(s, rows, c)
        return (h - m, lw - m), after

    def __init__(self, p: int = 13):
        self.ema = ema(p)

    def start(self):
        return self.ema.start()

    def step(self, s, h, lw, c):
        m = self.ema.step(s, c)[0]
        return h - m, lw - m


class Fisher(Kernel):
    """Over the middle of the bar and the least and greatest middle of the window."""

    inputs = ("mid", "low", "high")
    outputs = ("fisher", "signal")

    def start(self):
        return [0.0, 0.0, None, False]

    def advance(self, s, mid, lo, hi):
        first, s[3] = not s[3], True
        before = s[2]
        if mid is None or lo is None or hi is None:
            s[2] = None
            return None, 0.0 if first else before
        place = (mid - lo) / (hi - lo) - 0.5 if hi > lo else 0.0
        v = min(max(0.66 * place + 0.67 * s[0], -0.999), 0.999)
        s[0] = v
        s[1] = 0.5 * math.log((1 + v) / (1 - v)) + 0.5 * s[1]
        s[2] = s[1]
        return s[1], 0.0 if first else before


class Klinger(Linear):
    inputs = ("vf",)
    outputs = ("klinger", "signal")

    def arrays(self, s, rows, x):
        out, after = self.macd.arrays(s, rows, x)
        return out[:2], after

    def __init__(self, fast: int = 34, slow: int = 55, signal: int = 13):
        self.macd = Macd(fast, slow, signal)

    def start(self):
        return self.macd.start()

    def step(self, s, x):
        return self.macd.step(s, x)[:2]


class Psar(Kernel):
    """The fourth input is the next close, which settles the first bar's side; where it is not known yet, the first bar counts as rising."""

    inputs = ("high", "low", "close", "next_close")
    outputs = ("sar", "direction")

    def __init__(self, start: float = 0.02, increment: float = 0.02, maximum: float = 0.2):
        self.a0, self.da, self.top = start, increment, maximum

    def start(self):
        return []

    def advance(self, s, h, lw, c, nxt=None):
        if h is None or lw is None or c is None:
            return None, None
        if not s:
            side = -1 if nxt is not None and nxt < c else 1
            # stop, extreme, acceleration, side, the highs and lows of the last two bars
            s[:] = [lw if side > 0 else h, h if side > 0 else lw, self.a0, side, [h], [lw]]
            return s[0], float(side)
        stop, extreme, speed, side, highs, lows = s
        stop += speed * (extreme - stop)
        stop = min(stop, *lows) if side > 0 else max(stop, *highs)
        crossed = lw < stop if side > 0 else h > stop
        if crossed:
            stop, side, speed = extreme, -side, self.a0
            extreme = h if side > 0 else lw
        else:
            reached = h if side > 0 else lw
            if (reached - extreme) * side > 0:
                extreme, speed = reached, min(speed + self.da, self.top)
        s[:] = [stop, extreme, speed, side, [highs[-1], h], [lows[-1], lw]]
        return stop, float(side)


class Supertrend(Kernel):
    inputs = ("high", "low", "close")
    outputs = ("supertrend", "direction")

    def __init__(self, p: int = 10, multiplier: float = 3.0):
        self.atr, self.m = Atr(p), multiplier

    def start(self):
        return [self.atr.start(), None, None, None, None]

    def step(self, s, h, lw, c):
        atr = self.atr.step(s[0], h, lw, c)[0]
        if atr is None:
            s[4] = c
            return None, None
        mid = (h + lw) / 2.0
        up, down = mid + self.m * atr, mid - self.m * atr
        before = s[4]
        if s[3] is None:
            s[1:5] = up, down, -1, c
            return up, -1.0
        up = up if up < s[1] or before > s[1] else s[1]
        down = down if down > s[2] or before < s[2] else s[2]
        side = s[3]
        side = 1 if side < 0 and c > up else -1 if side > 0 and c < down else side
        s[1:5] = up, down, side, c
        return (down if side > 0 else up), float(side)


class Vwap(Kernel):
    inputs = ("high", "low", "close", "volume")

    def start(self):
        return [0.0, 0.0]

    def step(self, s, h, lw, c, v):
        tp = (h + lw + c) / 3.0
        s[0] += tp * v
        s[1] += v
        return (s[0] / s[1] if s[1] else tp,)


class StochasticK(Kernel):
    inputs = ("high", "low", "close")

    def __init__(self, k_period: int = 14):
        self.p = period(k_period)

    def start(self):
        return [[], []]

    def step(self, s, h, lw, c):
        for q, v in zip(s, (h, lw)):
            q.append(v)
            del q[: -self.p]
        if len(s[0]) < self.p:
            return (None,)
        top, bottom = max(s[0]), min(s[1])
        return (100.0 * (c - bottom) / (top - bottom) if top > bottom else 50.0,)
