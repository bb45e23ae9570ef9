"""State machines for ``replay``: small per-row loops over one block of rows.

Each object is called as ``machine(columns, state)`` and returns the output columns and
the state after the last row (a list of floats).
"""

from __future__ import annotations

import numpy as np

NAN = float("nan")


class ParabolicSar:
    """State: trend (1/-1), sar, extreme, acceleration, low and high of the last two rows."""

    def __init__(self, name: str, af: float, limit: float = 0.2):
        self.name, self.af, self.limit = name, af, limit

    def __call__(self, cols, state):
        hi, lo = cols["high"], cols["low"]
        out = np.empty(len(hi))
        start = 0
        if state is None:
            trend, sar, ext, af = 1.0, lo[0], hi[0], self.af
            l1 = l2 = lo[0]
            h1 = h2 = hi[0]
            out[0], start = sar, 1
        else:
            trend, sar, ext, af, l1, l2, h1, h2 = state
        for i in range(start, len(hi)):
            sar += af * (ext - sar)
            sar = min(sar, l1, l2) if trend > 0 else max(sar, h1, h2)
            crossed = lo[i] < sar if trend > 0 else hi[i] > sar
            if crossed:
                sar, trend, af = ext, -trend, self.af
                ext = hi[i] if trend > 0 else lo[i]
            else:
                best = max(ext, hi[i]) if trend > 0 else min(ext, lo[i])
                if best != ext:
                    ext, af = best, min(af + self.af, self.limit)
            out[i] = sar
            l1, l2, h1, h2 = lo[i], l1, hi[i], h1
        return {self.name: out}, [trend, sar, ext, af, l1, l2, h1, h2]


class TwoSidedSar:
    """The second form: trend from the first two closes, value split by side."""

    def __init__(self, names, af: float, limit: float = 0.2):
        self.names, self.af, self.limit = names, af, limit

    def __call__(self, cols, state):
        hi, lo, close = cols["high"], cols["low"], cols["close"]
        n = len(hi)
        sar_out, up_out, down_out = (np.full(n, np.nan) for _ in range(3))
        seen = 0.0 if state is None else state[0]
        if state is None:
            trend = sar = ext = af = 0.0
            l1 = l2 = h1 = h2 = c1 = 0.0
        else:
            seen, trend, sar, ext, af, l1, l2, h1, h2, c1 = state
        for i in range(n):
            if seen >= 2:
                sar += af * (ext - sar)
                sar = min(sar, l1, l2) if trend > 0 else max(sar, h1, h2)
                if (lo[i] < sar) if trend > 0 else (hi[i] > sar):
                    trend, sar, af = -trend, ext, self.af
                    ext = hi[i] if trend > 0 else lo[i]
                else:
                    best = max(ext, hi[i]) if trend > 0 else min(ext, lo[i])
                    if best != ext:
                        ext, af = best, min(af + self.af, self.limit)
            elif seen == 1:
                trend = 1.0 if close[i] > c1 else -1.0
                sar, ext, af = (l1, hi[i], self.af) if trend > 0 else (h1, lo[i], self.af)
            if seen >= 1:
                sar_out[i] = sar
                (up_out if trend > 0 else down_out)[i] = sar
            l1, l2, h1, h2, c1 = lo[i], l1, hi[i], h1, close[i]
            seen = min(seen + 1, 2)
        values = [[None if np.isnan(v) else v for v in a] for a in (sar_out, up_out, down_out)]
        return dict(zip(self.names, values)), [seen, trend, sar, ext, af, l1, l2, h1, h2, c1]


class Supertrend:
    """First value at row n+1; before it the line is 0 and the direction 1."""

    def __init__(self, n, upper, lower, value, direction):
        self.n, self.upper, self.lower, self.value, self.direction = n, upper, lower, value, direction

    def __call__(self, cols, state):
        close, up, down, rn = cols["close"], cols[self.upper], cols[self.lower], cols["_rn"]
        line, side = np.zeros(len(close)), np.ones(len(close), dtype=int)
        last, last_close = (0.0, 0.0) if state is None else state
        for i in range(len(close)):
            if rn[i] == self.n + 1:
                line[i] = down[i] if close[i] > up[i] else up[i]
            elif rn[i] > self.n + 1:
                hi = up[i] if (up[i] < last or last_close > last) else last
                lo = down[i] if (down[i] > last or last_close < last) else last
                if last == hi:
                    rising = close[i] > hi
                else:
                    rising = not close[i] < lo
                line[i], side[i] = (lo, 1) if rising else (hi, -1)
            last, last_close = line[i], close[i]
        return {self.value: line, self.direction: side}, [last, last_close]


class VolumeBuckets:
    """Adds volume until the bucket is full, then emits its imbalance and starts over."""

    def __init__(self, change, value):
        self.change, self.value = change, value

    def __call__(self, cols, state):
        d, vol, size, rn = cols[self.change], cols["volume"], cols["bucket"], cols["_rn"]
        out = np.zeros(len(vol))
        net, seen = (0.0, 0.0) if state is None else state
        for i in range(len(vol)):
            if rn[i] == 1:
                continue
            net += vol[i] if d[i] > 0 else -vol[i] if d[i] < 0 else 0.0
            seen += vol[i]
            if seen >= size[i]:
                out[i] = abs(net) / seen if seen > 0 else 0.0
                net = seen = 0.0
        return {self.value: out}, [net, seen]
