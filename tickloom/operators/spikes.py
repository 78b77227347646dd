"""Implausible readings of a measurement, relative to the normal behaviour of their source.

Each field of each source is read in time order by a hidden Markov model with the
states normal, spike, stuck and out-of-range. Emissions are taken from the source itself:

* normal: the residual from the local level, Gaussian with the local robust scale;
  a reading equal to the one before it is as likely as that value is common in the source;
* spike: a residual of any size, flat;
* stuck: the reading before it, again;
* out-of-range: exactly the readings that break a hard bound.

Forward-backward probabilities give each reading its most probable state. A spike is flagged; an
equal run is flagged if it has at least ``RUN`` readings and is stuck more likely than not; a hard
bound is flagged always.

A source is cut into pieces of ``PIECE`` rows in time order, each with ``MARGIN`` rows of its
neighbours, so that no task of the model holds a whole source however its rows lie in time: rows are
numbered within a day, and the counts of the days before are added. The model runs over fixed blocks of many pieces at once.

Defined results: a null or NaN reading is no reading and never flagged; repeated rows each count;
rows without an instant (null or -1) are placed by ``fallback_us``, and only hard bounds are
checked if that is null too (such rows are no neighbours of others); ties in time are ordered by record id; zeros of
a ``level`` are no spikes; a null source column is a value like any other; empty frames give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.util import DAY

PIECE, MARGIN = 2048, 256  # rows; the margin is at least WIDE
RUN = 6
NEAR, WIDE = 25, 51  # readings of the local level and of the local scale
BLOCK, CORE = 128, 96  # readings of one model block, and of it those that are kept
STEPS = 60_000  # rows handled at once
#: Chance to enter a state, and to stay stuck.
ENTER_SPIKE, ENTER_STUCK, STAY_STUCK = 1e-3, 1e-4, 0.9
SLACK = 1.3  # the normal scale is this much wider than measured
NORMAL, SPIKE, STUCK, RANGE = range(4)


@dataclass(frozen=True)
class Level:
    """A positive measurement that moves about a level; at least ``floor`` of relative scale; not negative, and below ``top``."""

    field: str
    floor: float = 0.3
    top: float = float("inf")


@dataclass(frozen=True)
class Wick:
    """The ``high`` or ``low`` of a bar, measured from its body in units of the usual range."""

    field: str
    open: str = "open"
    high: str = "high"
    low: str = "low"
    close: str = "close"


def windows(n: int, lo: np.ndarray, hi: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """Indices of the ``width`` readings around ``at`` within [lo, hi)."""
    start = np.minimum(np.maximum(at - width // 2, lo), np.maximum(lo, hi - width))
    return np.minimum(start[:, None] + np.arange(width), hi[:, None] - 1)


def rolling_median(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int) -> np.ndarray:
    """Centred median within segments; windows at an edge are moved inwards, short segments repeat their last reading."""
    out = np.empty(len(x))
    for a in range(0, len(x), 20_000):
        at = np.arange(a, min(a + 20_000, len(x)))
        w = x[windows(len(x), lo[at], hi[at], width, at)]
        w.partition(width // 2, axis=1)
        out[at] = w[:, width // 2]
    return out


def forward_backward(emit: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Posterior of the four states; ``emit`` (n, 4), ``lo`` the start of each reading's segment.

    All segments lie behind each other. The row is cut into blocks with overlapping
    margins that are run side by side; a new segment starts from the prior.
    """
    n = len(emit)
    prior = np.array([1 - ENTER_SPIKE - 2 * ENTER_STUCK, ENTER_SPIKE, ENTER_STUCK, ENTER_STUCK])
    move = np.tile(prior, (4, 1))
    move[STUCK] = prior * (1 - STAY_STUCK)
    move[STUCK, STUCK] += STAY_STUCK
    margin = (BLOCK - CORE) // 2
    starts = np.arange(0, n, CORE) - margin
    idx = starts[:, None] + np.arange(BLOCK)
    inside = (idx >= 0) & (idx < n)
    idx = idx.clip(0, n - 1)
    e = np.where(inside[:, :, None], emit[idx], 1.0)
    fresh = (lo[idx] == idx) | ~inside
    fw, bw = np.empty_like(e), np.empty_like(e)
    state = np.tile(prior, (len(starts), 1))
    for t in range(BLOCK):
        state = np.where(fresh[:, t, None], prior, state @ move) * e[:, t]
        state /= state.sum(1, keepdims=True)
        fw[:, t] = state
    state = np.ones((len(starts), 4))
    bw[:, -1] = state
    for t in range(BLOCK - 2, -1, -1):
        state = np.where(fresh[:, t + 1, None], 1.0, (state * e[:, t + 1]) @ move.T)
        state /= state.sum(1, keepdims=True)
        bw[:, t] = state
    post = fw * bw
    post /= post.sum(2, keepdims=True)
    keep = inside.copy()
    keep[:, :margin] = False
    keep[:, margin + CORE :] = False
    out = np.empty((n, 4))
    out[idx[keep]] = post[keep]
    return out


def run_lengths(x: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal to the one before; number of its run; length of its run."""
    same = np.zeros(len(x), bool)
    same[1:] = (x[1:] == x[:-1]) & (seg[1:] == seg[:-1])
    run = np.cumsum(~same) - 1
    return same, run, np.bincount(run)[run]


def judge(x: np.ndarray, residual: np.ndarray, scale: np.ndarray, bad: np.ndarray, seg: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """State of each reading of one field; ``seg`` numbers the segments."""
    same, run, length = run_lengths(x, seg)
    # how common the value is in its segment, besides its own run
    order = np.lexsort((x, seg))
    new = np.r_[True, (x[order][1:] != x[order][:-1]) | (seg[order][1:] != seg[order][:-1])]
    pair = np.empty(len(x), int)
    pair[order] = np.cumsum(new) - 1
    total = np.bincount(pair)[pair]
    size = np.bincount(seg)[seg]
    common = (total - length + 0.5) / np.maximum(size - length + 1, 1)
    sd = scale * SLACK
    emit = np.empty((len(x), 4))
    # densities of the residual; a repeated value has the mass of its value on top
    emit[:, NORMAL] = np.exp(-0.5 * np.minimum((residual / sd) ** 2, 1200)) / (sd * np.sqrt(2 * np.pi)) * np.where(same, common, 1.0)
    emit[:, SPIKE] = 1 / 24 * np.where(same, common, 1.0)
    emit[:, STUCK] = np.where(same, 1.0, 1e-12)
    emit[:, RANGE] = 1e-300
    emit[bad] = (1e-300, 1e-300, 1e-300, 1.0)
    post = forward_backward(np.maximum(emit, 1e-300), lo)
    state = post.argmax(1)
    # the first reading of a stuck run came before it was known to be stuck
    stuck = np.bincount(run, np.where(same, post[:, STUCK], 0.0))[run] / np.maximum(length - 1, 1)
    short = (state == STUCK) & (length < RUN)  # a reading that was sent again
    state[short] = post[short, :STUCK].argmax(1)
    state[(length >= RUN) & (stuck > 0.5) & (state != RANGE)] = STUCK
    return state


def _segments(gid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = np.r_[True, gid[1:] != gid[:-1]] if len(gid) else np.zeros(0, bool)
    seg = np.cumsum(first) - 1
    at = np.flatnonzero(first)
    end = np.r_[at[1:], len(gid)] if len(gid) else at
    return seg, at[seg], end[seg]


def _level(pdf: pd.DataFrame, m: Level) -> np.ndarray:
    v = pdf[m.field].to_numpy(float)
    out = np.full(len(v), NORMAL)
    ok = np.flatnonzero(~np.isnan(v))
    if not len(ok):
        return out
    x = v[ok]
    bad = (x < 0) | (x >= m.top)
    seg, lo, _ = _segments(pdf["__gid"].to_numpy()[ok])
    r, sd = np.zeros(len(x)), np.full(len(x), m.floor)
    pos = np.flatnonzero((x > 0) & ~bad)
    if len(pos):
        lx = np.log(x[pos])
        _, plo, phi = _segments(seg[pos])
        res = lx - rolling_median(lx, plo, phi, NEAR)
        r[pos] = res
        sd[pos] = np.maximum(1.4826 * rolling_median(np.abs(res), plo, phi, WIDE), m.floor)
    out[ok] = judge(x, r, sd, bad, seg, lo)
    return out


def _wick(pdf: pd.DataFrame, m: Wick) -> np.ndarray:
    o, h, lw, c = (pdf[k].to_numpy(float) for k in (m.open, m.high, m.low, m.close))
    v = h if m.field == m.high else lw
    out = np.full(len(v), NORMAL)
    ok = np.flatnonzero(~np.isnan(v))
    if not len(ok):
        return out
    x, gid = v[ok], pdf["__gid"].to_numpy()[ok]
    seg, lo, hi = _segments(gid)
    top, bottom = np.fmax(o, c)[ok], np.fmin(o, c)[ok]
    bad = ((x < top) if m.field == m.high else (x > bottom)) | (h < lw)[ok] | (np.fmin(np.fmin(o, c), np.fmin(h, lw)) <= 0)[ok]
    # without open and close the local middle of the field stands for the body
    near = rolling_median(x, lo, hi, NEAR)
    body = np.where(np.isnan(top), near, top if m.field == m.high else bottom)
    body = np.where(body > 0, body, near)
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.log(x / body) * (1 if m.field == m.high else -1)
        spread = np.log(h / lw)[ok]
    r = np.where(bad | ~np.isfinite(r), 0.0, r)
    use = np.flatnonzero(np.isfinite(spread) & (spread >= 0))
    sd = np.full(len(x), 1e-2)
    if len(use):
        _, ulo, uhi = _segments(gid[use])
        med = rolling_median(spread[use], ulo, uhi, WIDE)
        # readings without a range take the one of the reading before
        at = np.searchsorted(use, np.arange(len(x)), side="right") - 1
        sd = np.where(at >= 0, med[at.clip(0)], 1e-2)
    out[ok] = judge(x, r / np.maximum(sd, 1e-5), np.ones(len(x)), bad, seg, lo)
    return out


def _batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of whole groups, of about STEPS rows."""
    held: list[pd.DataFrame] = []
    n = 0
    for p in parts:
        held.append(p)
        n += len(p)
        if n < STEPS:
            continue
        df = pd.concat(held, ignore_index=True)
        g = df["__gid"].to_numpy()
        cut = int(np.argmax(g == g[-1]))
        if cut:
            yield df.iloc[:cut].reset_index(drop=True)
        held, n = [df.iloc[cut:]], len(df) - cut
    if n:
        yield pd.concat(held, ignore_index=True)


def cut_in_pieces(rows: DataFrame) -> DataFrame:
    """Each row of ``(__s, __t, __id, ...)`` in its ``__home`` piece and in those whose margin it is in (``__piece``).

    A row's number in its source is its number within the day plus the rows of the days before, so
    a source is not brought into one task.
    """
    rows = rows.withColumn("__day", F.floor(F.col("__t") / DAY))
    days = Window.partitionBy("__s")
    before = F.coalesce(F.sum("__n").over(days.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    counts = rows.groupBy("__s", "__day").agg(F.count(F.lit(1)).alias("__n")).select("__s", "__day", before.alias("__before"), F.sum("__n").over(days).alias("__all"))
    within = F.row_number().over(Window.partitionBy("__s", "__day").orderBy("__t", "__id"))
    rows = rows.withColumn("__rn", within - 1).join(counts, ["__s", "__day"]).withColumn("__rn", F.col("__rn") + F.col("__before"))
    margin = min(MARGIN, PIECE)
    piece = lambda n: F.floor(n / PIECE)
    rows = rows.withColumn("__home", piece(F.col("__rn")))
    first, last = piece(F.greatest(F.col("__rn") - margin, F.lit(0))), piece(F.least(F.col("__rn") + margin, F.col("__all") - 1))
    return rows.withColumn("__piece", F.explode(F.array_distinct(F.array("__home", first, last)))).drop("__day", "__rn", "__before", "__all")


def flag_implausible(df: DataFrame, keys: list[str], at_us: str, record_id: str, measures: list[Level | Wick], fallback_us: str) -> DataFrame:
    """(record_id, state per measured field) with the states ``normal spike stuck out_of_range`` for every row.

    ``fallback_us`` is never -1.
    """
    needed = list(dict.fromkeys(c for m in measures for c in ((m.field,) if isinstance(m, Level) else (m.open, m.high, m.low, m.close))))
    t = F.coalesce(F.when(F.col(at_us) != -1, F.col(at_us)), F.col(fallback_us))
    rows = df.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], t.alias("__t"), F.col(record_id).alias("__id"), *[F.col(c).cast("double").alias(c) for c in needed])
    timed = F.col("__t").isNotNull()
    rows = rows.select(F.xxhash64(*[c for i in range(len(keys)) for c in (F.col(f"__k{i}"), F.col(f"__k{i}").isNull())], timed).alias("__s"), timed.alias("__timed"), F.coalesce("__t", F.lit(0).cast("long")).alias("__t"), "__id", *needed)
    rows = cut_in_pieces(rows)
    rows = rows.select(F.xxhash64("__s", "__piece").alias("__gid"), "__t", "__id", (F.col("__home") == F.col("__piece")).alias("__own"), "__timed", *needed)
    rows = rows.repartition("__gid").sortWithinPartitions("__gid", "__t", "__id").drop("__t")
    names = np.array(["normal", "spike", "stuck", "out_of_range"], dtype=object)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _batches(parts):
            own = pdf["__own"].to_numpy(bool)
            timed = pdf["__timed"].to_numpy(bool)[own]
            states = {m.field: (_level if isinstance(m, Level) else _wick)(pdf, m)[own] for m in measures}
            states = {k: names[np.where(timed | (v == RANGE), v, NORMAL)] for k, v in states.items()}
            yield pd.DataFrame({record_id: pdf["__id"].to_numpy()[own], **states})

    id_type = df.schema[record_id].dataType.simpleString()
    return rows.mapInPandas(run, ", ".join([f"`{record_id}` {id_type}", *[f"`{m.field}` string" for m in measures]]))


def flagged(states: DataFrame, record_id: str) -> DataFrame:
    """The rows with a state other than normal in any field."""
    fields = [c for c in states.columns if c != record_id]
    return states.where(" or ".join(f"`{c}` <> 'normal'" for c in fields))
