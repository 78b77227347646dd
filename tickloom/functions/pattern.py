"""Fibonacci retracements of the legs between confirmed pivots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.build import Build
from tickloom.functions.indicators import swing_points
from tickloom.functions.kernels import Kernel
from tickloom.registry import register

MODES, PAIRINGS = ("both", "down", "up"), ("strict_alternating", "latest_valid")
LEVELS = (0.382, 0.5, 0.618)


class Legs(Kernel):
    """The leg-th latest leg down (low to high, retraced down) and up, row by row.

    A new pivot only opens, betters or closes the leg at the end: of the closed legs
    no more than are asked for are kept, so each row costs the same.
    """

    inputs = ("level_high", "level_low")
    outputs = ("down_high", "down_low", "down_end", "up_high", "up_low", "up_end")

    def __init__(self, leg: int = 1, pairing: str = "strict_alternating", max_age: int | None = None, min_pct: float | None = None):
        if leg < 1 or pairing not in PAIRINGS or (max_age is not None and max_age < 0) or (min_pct is not None and min_pct < 0):
            raise ValueError("leg must be above 0, max_leg_age_bars and min_leg_size_pct not below, pairing_mode one of " + ", ".join(PAIRINGS))
        self.leg, self.strict, self.max_age, self.min_pct = leg, pairing == PAIRINGS[0], max_age, min_pct

    def start(self):
        # row; the pivot before the last and the last, as [row, is high, price]; closed legs and the open one of each direction
        return [-1, None, None, {"down": [], "up": []}, {"down": None, "up": None}]

    def _leg(self, first: list | None, last: list) -> list | None:
        """[high, low, end row] if it counts."""
        if first is None or first[1] == last[1] or last[0] <= first[0]:
            return None
        high, low = (last[2], first[2]) if last[1] else (first[2], last[2])
        if high <= low:
            return None
        start = first[2]
        if self.min_pct is not None and start != 0 and abs(last[2] - start) / abs(start) * 100.0 < self.min_pct:
            return None
        return [high, low, last[0]]

    def _close(self, s: list, way: str) -> None:
        if s[4][way] is not None:
            s[3][way] = [*s[3][way], s[4][way]][-self.leg :]
            s[4][way] = None

    def _pivot(self, s: list, pivot: list) -> None:
        way = "down" if pivot[1] else "up"
        if self.strict:
            last = s[2]
            if last is not None and last[1] == pivot[1]:
                better = pivot[2] >= last[2] if pivot[1] else pivot[2] <= last[2]
                if not better:
                    return
            else:
                s[1] = last
                self._close(s, "up" if pivot[1] else "down")
            s[2] = pivot
            s[4][way] = self._leg(s[1], pivot)
        else:
            # s[1] is the latest low, s[2] the latest high
            other = s[1] if pivot[1] else s[2]
            self._close(s, way)
            s[4][way] = self._leg(other, pivot)
            s[2 if pivot[1] else 1] = pivot

    def advance(self, s, high, low):
        s[0] += 1
        if high is not None:
            self._pivot(s, [s[0], True, high])
        if low is not None:
            self._pivot(s, [s[0], False, low])
        out: list = []
        for way in ("down", "up"):
            legs = s[3][way] + ([s[4][way]] if s[4][way] is not None else [])
            leg = legs[-self.leg] if len(legs) >= self.leg else None
            if leg is not None and self.max_age is not None and s[0] - leg[2] > self.max_age:
                leg = None
            out += [None, None, None] if leg is None else [leg[0], leg[1], float(leg[2])]
        return tuple(out)


_COMMON = {"left": 2, "right": 2, "leg": 1, "pairing_mode": "strict_alternating", "max_leg_age_bars": None, "min_leg_size_pct": None, "allow_equal_extremes": False, "freeze_until_new_leg": True}


def _name(level: float) -> str:
    return f"{level:g}".replace(".", "_")


@register("fib_retracement", ("fib",), outputs=("anchor_high", "anchor_low"), levels=None, mode="both", **_COMMON)
def fib_retracement(b: Build, levels: tuple[float, ...] | None = None, mode: str = "both", left: int = 2, right: int = 2, leg: int = 1, pairing_mode: str = "strict_alternating", max_leg_age_bars: int | None = None, min_leg_size_pct: float | None = None, allow_equal_extremes: bool = False, freeze_until_new_leg: bool = True) -> dict[str, Column]:
    """``anchor_high``, ``anchor_low``, and ``down_<level>``, ``up_<level>`` of each level.

    A leg only changes at a pivot, so ``freeze_until_new_leg`` makes no difference.
    """
    levels = tuple(float(x) for x in (levels or LEVELS))
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    if any(not 0 <= x <= 2 for x in levels):
        raise ValueError("levels lie between 0 and 2")
    high, low = swing_points(b, left, right, "levels", allow_equal_extremes)
    age = None if max_leg_age_bars is None else int(max_leg_age_bars)
    pct = None if min_leg_size_pct is None else float(min_leg_size_pct)
    dh, dl, de, uh, ul, ue = b.scan(Legs(leg, pairing_mode, age, pct), high, low)
    down = (de >= ue) | ue.isNull() if mode == "both" else F.lit(mode == "down")
    out = {"anchor_high": F.when(down, dh).otherwise(uh), "anchor_low": F.when(down, dl).otherwise(ul)}
    for x in levels:
        if mode in ("both", "down"):
            out[f"down_{_name(x)}"] = dh - (dh - dl) * x
        if mode in ("both", "up"):
            out[f"up_{_name(x)}"] = ul + (uh - ul) * x
    return out


def _single(name: str, aliases: tuple[str, ...], pick, mode: str, **extra):
    @register(name, aliases, **extra, **_COMMON)
    def op(b: Build, level: float = 0.618, **params) -> Column:
        return pick(fib_retracement(b, levels=(level,), mode=mode, **params), _name(float(level)))

    return op


fib_anchor_high = _single("fib_anchor_high", ("fib_high_anchor",), lambda out, _: out["anchor_high"], "both")
fib_anchor_low = _single("fib_anchor_low", ("fib_low_anchor",), lambda out, _: out["anchor_low"], "both")
fib_level_down = _single("fib_level_down", ("fib_down_level", "fib_down"), lambda out, n: out[f"down_{n}"], "down", level=0.618)
fib_level_up = _single("fib_level_up", ("fib_up_level", "fib_up"), lambda out, n: out[f"up_{n}"], "up", level=0.618)
