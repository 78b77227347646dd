"""Array scans against the steps they stand for."""

import math
import random

import numpy as np
import pytest

from tickloom.functions import kernels as K

KERNELS = [K.ema(5), K.ema(1), K.rma(3), K.Macd(3, 6, 4), K.Wilder(4), K.Wilder(1), K.Rsi(4), K.Atr(3), K.Adx(3), K.Keltner(4, 3, 2.0), K.ElderRay(3), K.Klinger(3, 6, 4)]


def flat(x):
    return [y for z in x for y in flat(z)] if isinstance(x, list) else [x]


@pytest.mark.parametrize("kernel", KERNELS, ids=lambda k: type(k).__name__)
@pytest.mark.parametrize("seed", range(25))
def test_scans_are_steps(kernel, seed):
    """Keys interleaved with batches at any place, nulls, flat prices, and the state that is left."""
    rnd = random.Random(seed)
    n = rnd.randrange(1, 200)
    keys = sorted(rnd.randrange(4) for _ in range(n))
    base = [100 + rnd.gauss(0, 1) for _ in range(n)]
    level = seed % 5 == 0
    columns = {c: [math.nan if rnd.random() < 0.1 else 100.0 if level else b + side * abs(rnd.gauss(1, 1)) for b in base] for c, side in (("close", 0), ("high", 1), ("low", -1))}
    inputs = [columns.get(c, columns["close"]) for c in kernel.inputs]
    want: list[list] = [[] for _ in kernel.outputs]
    state = None
    for i in range(n):
        if i == 0 or keys[i] != keys[i - 1]:
            state = kernel.start()
        for w, v in zip(want, kernel.advance(state, *[None if c[i] != c[i] else c[i] for c in inputs])):
            w.append(math.nan if v is None else v)
    got: list[list] = [[] for _ in kernel.outputs]
    after, a = None, 0
    while a < n:
        z = min(n, a + rnd.randrange(1, 40))
        fresh = [i - a for i in range(a, z) if i == 0 or keys[i] != keys[i - 1]]
        after, values = kernel.run(after, [np.array(c[a:z]) for c in inputs], z - a, fresh)
        for g, v in zip(got, values):
            g += list(v)
        a = z
    for w, g in zip(want, got):
        assert np.allclose(w, g, rtol=1e-10, atol=1e-10, equal_nan=True)
    assert [x is None for x in flat(state)] == [x is None for x in flat(after)]
    assert [x for x in flat(after) if x is not None] == pytest.approx([x for x in flat(state) if x is not None], abs=1e-9)
