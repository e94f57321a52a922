"""Tick-at-a-time forms of the metrics and the ledger, written from their definitions: the second oracle beside SQL."""

from __future__ import annotations

import math
from collections import deque

import numpy as np


class Window:
    """Samples [t, t + dt]; only the head leaves, in part or whole."""

    def __init__(self, lookback):
        self.lookback, self.samples = lookback, deque()

    def add(self, t, dt, x):
        dt = dt if dt > 0 else 1e-9
        self.samples.append([t, t + dt, x])
        cutoff = t - self.lookback
        while self.samples:
            start, end, _ = self.samples[0]
            if end <= cutoff + 1e-12:
                self.samples.popleft()
            else:
                self.samples[0][0] = max(start, cutoff)
                break
        w = np.array([e - s for s, e, _ in self.samples])
        v = np.array([x for *_, x in self.samples])
        mean = (w * v).sum() / w.sum()
        return mean, math.sqrt(max((w * (v - mean) ** 2).sum() / w.sum(), 0.0))


def moments(ts, x, lookback):
    w, out = Window(lookback), []
    for i, t in enumerate(ts):
        out.append(w.add(t, 0.0 if i == 0 else max(t - ts[i - 1], 1e-6), x[i]))
    return tuple(np.array(out).T)


def ewma(ts, x, tau):
    out = [x[0]]
    for i in range(1, len(x)):
        a = math.exp(-max(ts[i] - ts[i - 1], 1e-6) / tau)
        out.append(a * out[-1] + (1 - a) * x[i])
    return np.array(out)


def slope(ts, x, tau, window):
    y, out = ewma(ts, x, tau), []
    for i, t in enumerate(ts):
        k = next(j for j in range(i + 1) if ts[j] >= t - window)
        out.append(math.nan if k == i else (y[i] - y[k]) / max(t - ts[k], 1e-6))
    return np.array(out)


def vol(ts, mid, tau, horizon, bins, base, cap):
    top = (cap * base) ** 2
    width, events, y, seen = top / bins, [], 0.0, 0
    vols, ranks = [0.0], [math.nan]
    bin_of = lambda v: min(bins - 1, max(0, int(v / width)))
    for i in range(1, len(mid)):
        dt = ts[i] - ts[i - 1]
        r = math.log(mid[i] / mid[i - 1])
        if seen:
            a = math.exp(-max(dt, 1e-9) / tau)
            y = a * y + (1 - a) * r * r
        seen += 1
        events.append((ts[i] - max(dt, 1e-6), ts[i], bin_of(y)))
        cutoff = ts[i] - horizon
        live = [(max(s, cutoff), e, b) for s, e, b in events if e > cutoff]
        total = sum(e - s for s, e, _ in live)
        b = bin_of(y)
        lower = sum(e - s for s, e, k in live if k < b)
        same = sum(e - s for s, e, k in live if k == b)
        vols.append(y)
        ranks.append((lower + same * min(1.0, max(0.0, (y - b * width) / width))) / total)
    return np.array(vols), np.array(ranks)


def spread_rank(ts, pips, window):
    return np.array([np.mean([pips[j] <= pips[i] for j in range(i + 1) if ts[j] >= ts[i] - window]) for i in range(len(ts))])


def count(ts, window):
    return np.array([sum(1 for j in range(i + 1) if ts[j] > ts[i] - window) for i in range(len(ts))], float)


class Reversion:
    """The machine over the whole history: candidates are found by looking at every earlier tick."""

    def __init__(self, lookback, threshold, tp, sl, pip, recency=0.0):
        self.__dict__.update(lookback=lookback, threshold=threshold * pip, tp=tp * pip, sl=sl * pip, pip=pip, recency=recency, t=[], p=[], position=0, ref=None)

    def found(self, low):
        sign = 1 if low else -1
        now, price, best = self.t[-1], self.p[-1], None
        for j in range(len(self.t) - 2, -1, -1):
            if self.t[j] < now - self.lookback:
                break
            edge = all(sign * self.p[j] < sign * q for q in self.p[j + 1 :])
            if edge and sign * (price - self.p[j]) >= self.threshold and now - self.t[j] >= self.recency:
                best = (self.t[j], self.p[j])
                break
        return best

    def step(self, t, p):
        self.t.append(t)
        self.p.append(p)
        low, high = self.found(True), self.found(False)
        ref = low if low and (not high or low[0] >= high[0]) else high
        if self.position and abs(p - self.ref) <= self.pip:
            self.position, self.ref = 0, None
        if ref is None:
            self.position, self.ref = 0, None
            return 0
        if self.ref is not None and abs(ref[1] - self.ref) > self.pip / 10:
            self.position, self.ref = 0, None
        if self.position == 0:
            if p - ref[1] >= self.threshold:
                self.position, self.ref = -1, ref[1]
            elif p - ref[1] <= -self.threshold:
                self.position, self.ref = 1, ref[1]
        return self.position


def ledger(ts, mid, opens, direction, tp, sl, timeout, closes, pip, exit_name):
    """One position at a time, tick by tick."""
    out, trade, pending = [], None, False
    for i in range(len(ts)):
        filled = False
        if pending:
            trade["fill"], trade["entry"], pending, filled = ts[i], mid[i], False, True
        if trade and not filled and not pending:
            d = trade["d"]
            hit_tp, hit_sl = d * (mid[i] - trade["tp"]) >= 0, d * (mid[i] - trade["sl"]) <= 0
            why = None
            if closes[i]:
                why, price = exit_name, mid[i]
            elif hit_sl:
                why, price = "SL", trade["sl"]
            elif hit_tp:
                why, price = "TP", trade["tp"]
            elif trade["timeout"] > 0 and ts[i] - trade["fill"] >= trade["timeout"]:
                why, price = "TIMEOUT", mid[i]
            if why:
                out.append((trade["signal"], trade["fill"], ts[i], trade["entry"], price, why, (price - trade["entry"]) * d / pip))
                trade = None
        if opens[i] and trade is None:
            trade, pending = {"signal": i, "d": direction[i], "tp": tp[i], "sl": sl[i], "timeout": timeout[i]}, True
    if trade:
        if pending:
            trade["fill"], trade["entry"] = ts[-1], mid[-1]
        out.append((trade["signal"], trade["fill"], ts[-1], trade["entry"], mid[-1], "DATA_END", (mid[-1] - trade["entry"]) * trade["d"] / pip))
    return out
