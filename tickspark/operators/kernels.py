"""Numpy forms of the ordered computations; arrays hold one instrument's ticks in arrival order.

Times are whole microseconds. `first` says that the first element is the instrument's very first tick.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right

import numpy as np

#: Weight of the very first sample and least gap between samples, in seconds; least standard deviation.
FIRST_WEIGHT, LEAST_GAP, LEAST_STD = 1e-9, 1e-6, 1e-12


def gaps(ts_us: np.ndarray, lead_us: int = 0) -> np.ndarray:
    """Seconds since the previous tick, LEAST_GAP at least; lead_us: the time since the tick before the first one."""
    out = np.full(len(ts_us), max(lead_us / 1e6, LEAST_GAP))
    np.maximum(np.diff(ts_us) / 1e6, LEAST_GAP, out=out[1:])
    return out


def rolling_moments(ts_us: np.ndarray, x: np.ndarray, lookback_s: float, first: bool = True, lead_us: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Time-weighted mean and standard deviation over the lookback.

    Sample i weighs its gap and reaches forward from its time; the window drops samples from its head only, so a long
    sample shields the shorter ones behind it. The head is the first sample whose running latest end lies inside the
    lookback, and all sums are differences of prefix sums of values centred on the first one.
    """
    n = len(ts_us)
    if not n:
        return np.zeros(0), np.zeros(0)
    weight = gaps(ts_us, lead_us)
    reach = np.maximum(np.diff(ts_us, prepend=ts_us[0] - lead_us), 1)
    if first:
        weight[0], reach[0] = FIRST_WEIGHT, 0
    end = ts_us + reach
    cutoff = ts_us - int(round(lookback_s * 1e6))
    head = np.searchsorted(np.maximum.accumulate(end), cutoff, side="right")
    centre = x[0]
    d = x - centre
    part = np.where(ts_us[head] < cutoff, (end[head] - cutoff) / 1e6, weight[head])
    part = np.minimum(np.maximum(part, 0.0), weight[head])

    def windowed(v: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0.0], np.cumsum(weight * v)))
        return c[1:] - c[head + 1] + part * v[head]

    total = windowed(np.ones(n))
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = windowed(d) / total
        std = np.sqrt(np.maximum(windowed(d * d) / total - mean * mean, 0.0))
    mean[total <= 0] = np.nan
    alone = head == np.arange(n)  # one sample is its own mean, without rounding
    mean, std = np.where(alone, x, mean + centre), np.where(alone, 0.0, std)
    return mean, std


def zscore(ts_us, mid, lookback_s, first=True, lead_us=0) -> dict[str, np.ndarray]:
    mean, std = rolling_moments(ts_us, mid, lookback_s, first, lead_us)
    residual = np.where(np.isfinite(mean), mid - mean, np.nan)
    good = np.isfinite(std) & (std > LEAST_STD) & np.isfinite(mean)
    return {"z_score": np.where(good, residual / np.where(good, std, 1.0), 0.0), "rolling_residual": residual}


def drift(ts_us, mid, lookback_s, first=True, lead_us=0) -> dict[str, np.ndarray]:
    mean, _ = rolling_moments(ts_us, mid, lookback_s, first, lead_us)
    value = (mid - mean) / lookback_s
    return {"drift": value, "drift_sign": np.where(np.isfinite(value), np.sign(value), 0.0)}


def ewma(ts_us, x, tau_s, initial: float | None = None) -> np.ndarray:
    """y += (1 - exp(-gap / tau)) (x - y), from the first value.

    A configured start value decays over the seconds since the epoch before the first tick, so it leaves no trace in
    practice; that is the behaviour that results must match.
    """
    if not len(x):
        return np.zeros(0)
    keep = np.exp(-gaps(ts_us) / tau_s).tolist()
    out, y = [], float(x[0])
    if initial is not None:
        a = math.exp(-max(ts_us[0] / 1e6, LEAST_GAP) / tau_s)
        y = a * initial + (1 - a) * y
    out.append(y)
    for a, v in zip(keep[1:], x[1:].tolist(), strict=True):
        y = a * y + (1 - a) * v
        out.append(y)
    return np.array(out)


def slope_of(ts_us, y: np.ndarray, window_s: float) -> np.ndarray:
    """Slope per second of y against its oldest value in [t - window, t]; NaN where that is the value itself."""
    oldest = np.searchsorted(ts_us, ts_us - int(round(window_s * 1e6)), side="left")
    span = np.maximum((ts_us - ts_us[oldest]) / 1e6, LEAST_GAP)
    return np.where(oldest == np.arange(len(y)), np.nan, (y - y[oldest]) / span)


def smoother(ts_us, x, tau_s, start: int = 1) -> np.ndarray:
    """Exponential average of x that is 0 before `start`: the value there is the first to count, against 0."""
    keep = np.exp(-np.maximum(np.diff(ts_us, prepend=ts_us[:1]) / 1e6, FIRST_WEIGHT) / tau_s).tolist()
    out, y = [0.0] * min(start, len(x)), 0.0
    for a, v in zip(keep[start:], x[start:].tolist(), strict=True):
        y = a * y + (1 - a) * v
        out.append(y)
    return np.array(out)


def log_variance(ts_us, mid, tau_s, first=True) -> np.ndarray:
    """Smoothed squared log return: 0 at the first two ticks (the first return only starts the smoother)."""
    r = np.zeros(len(mid))
    with np.errstate(divide="ignore", invalid="ignore"):
        r[1:] = np.where((mid[1:] > 0) & (mid[:-1] > 0), np.log(mid[1:] / mid[:-1]), 0.0)
    return smoother(ts_us, r * r, tau_s, 2 if first else 1)


def bin_of(edges: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Index of [edge k, edge k+1) that holds x; values outside go to the end bins."""
    return np.clip(np.searchsorted(edges, x, side="right") - 1, 0, len(edges) - 2)


def percentile_ranks(ts_us, y, edges: np.ndarray, horizon_s: float, first=True, lead_us=0) -> np.ndarray:
    """Rank of each y among the time-weighted history of y within the horizon, linear inside its bin.

    The value of tick i weighs the gap before it. The very first tick has no gap and no rank.
    """
    n = len(y)
    out = np.full(n, np.nan)
    gap = gaps(ts_us, lead_us).tolist()
    bins = bin_of(edges, y)
    frac = np.clip((y - edges[bins]) / (edges[bins + 1] - edges[bins]), 0.0, 1.0).tolist()
    bins, weights = bins.tolist(), [0.0] * (len(edges) - 1)
    end = (ts_us / 1e6).tolist()
    left = [e - g for e, g in zip(end, gap, strict=True)]
    head = begin = 1 if first else 0
    # y moves little from tick to tick, so the weight below its bin is carried along; now and then it is summed anew
    total = lower = 0.0
    at = 0
    for i in range(begin, n):
        b, now = bins[i], end[i]
        w = now - left[i]
        weights[b] += w
        total += w
        if b < at:
            lower += w
        cutoff = now - horizon_s
        while head <= i and end[head] <= cutoff:
            k, w = bins[head], end[head] - left[head]
            weights[k] -= w
            total -= w
            if k < at:
                lower -= w
            head += 1
        if head <= i and left[head] < cutoff:
            k, w = bins[head], cutoff - left[head]
            weights[k] -= w
            total -= w
            if k < at:
                lower -= w
            left[head] = cutoff
        if b != at:
            lower += sum(weights[at:b]) if b > at else -sum(weights[b:at])
            at = b
        if not i & 1023:
            lower, total = sum(weights[:at]), sum(weights)
        if total > 0:
            out[i] = (lower + weights[b] * frac[i]) / total
    return out


def ewma_vol(ts_us, mid, tau_s, horizon_s, bins, base_vol, stddev_cap, first=True, lead_us=0) -> dict[str, np.ndarray]:
    y = log_variance(ts_us, mid, tau_s, first)
    edges = np.linspace(0.0, (stddev_cap * base_vol) ** 2, bins + 1)
    return {"vol_ewma": y, "vol_percentile": percentile_ranks(ts_us, y, edges, horizon_s, first, lead_us)}


def spread(ts_us, bid, ask, pip_size, window_s) -> dict[str, np.ndarray]:
    """Spread, in pips, and the share of ticks in [t - window, t], up to this one, that are not wider."""
    raw = np.maximum(ask - bid, 0.0)
    pips = raw / pip_size
    low = np.searchsorted(ts_us, ts_us - int(round(window_s * 1e6)), side="left")
    return {"spread": raw, "spread_pips": pips, "spread_percentile": rank_within(pips, low) / (np.arange(len(pips)) + 1 - low)}


def rank_within(x: np.ndarray, low: np.ndarray) -> np.ndarray:
    """How many of x[low[i] : i + 1] are not above x[i], for ascending low: the window is kept sorted."""
    values, window, out, begin = x.tolist(), [], [], 0
    for v, a in zip(values, low.tolist(), strict=True):
        while begin < a:
            del window[bisect_left(window, values[begin])]
            begin += 1
        at = bisect_right(window, v)
        window.insert(at, v)
        out.append(at + 1)
    return np.array(out, np.int64)


def tick_rate(ts_us, window_s) -> dict[str, np.ndarray]:
    """Ticks in (t - window, t], up to this one."""
    low = np.searchsorted(ts_us, ts_us - int(round(window_s * 1e6)), side="right")
    count = (np.arange(len(ts_us)) + 1 - low).astype(float)
    return {"tick_count": count, "tick_rate_per_sec": count / window_s, "tick_rate_per_min": count / window_s * 60.0}


def nearest(times: list, prices: list, head: int, sign: float, ts: int, price: float, threshold: float, least_age_us: float) -> int:
    """Place of the newest extreme before the last one that is `threshold` away and old enough; -1 if none.

    From `head` on, each price is a strict extreme of all later ones, so both distance and age grow towards the head and
    the newest is found by halving.
    """
    low, high = head, len(prices) - 1  # the last one is this tick
    if low >= high or sign * (prices[low] - price) < threshold:
        return -1
    while low < high:
        k = (low + high) // 2
        if sign * (prices[k] - price) >= threshold and ts - times[k] >= least_age_us:
            low = k + 1
        else:
            high = k
    return low - 1 if low > head else -1


class Reversion:
    """Threshold-reversion position of one instrument, tick by tick; holds its state between calls.

    highs and lows (times, prices, head) are the ticks within the lookback that are strict extremes of all later ticks,
    oldest first, from head on.
    """

    FIELDS = (
        "position", "reference_price", "distance_from_reference", "reference_age_seconds", "threshold", "tp_price", "sl_price",
        "trade_timeout_seconds", "position_open_age_seconds", "min_recency_seconds",
    )
    #: Places before the head after which they are given up.
    SLACK = 4096

    def __init__(self, lookback_seconds, threshold_pips, tp_pips, sl_pips, pip_size, min_recency_seconds=0.0, trade_timeout_seconds=None) -> None:
        self.lookback_us, self.pip = int(lookback_seconds * 1_000_000), pip_size
        self.threshold, self.tp, self.sl = threshold_pips * pip_size, tp_pips * pip_size, sl_pips * pip_size
        self.recency, self.timeout = float(min_recency_seconds), math.nan if trade_timeout_seconds is None else float(trade_timeout_seconds)
        self.highs, self.lows = ([], [], 0), ([], [], 0)
        #: position, reference price, its time, time of opening, price at opening
        self.state: tuple = (0, None, 0, 0, 0.0)

    def walk(self, ts_us: np.ndarray, mid: np.ndarray, every: bool) -> tuple[list[int], list[tuple]]:
        """(places, states after them) of the ticks at which a position is taken, or of every tick."""
        (high_t, high_p, high_at), (low_t, low_p, low_at) = self.highs, self.lows
        position, ref, ref_us, open_us, open_mid = self.state
        threshold, lookback, pip, near_us = self.threshold, self.lookback_us, self.pip, self.recency * 1e6
        places, states = [], []
        for place, (ts, price) in enumerate(zip(ts_us.tolist(), mid.tolist(), strict=True)):
            before, cutoff = position, ts - lookback
            while len(high_p) > high_at and high_p[-1] <= price:
                high_p.pop()
                high_t.pop()
            high_p.append(price)
            high_t.append(ts)
            while high_t[high_at] < cutoff:
                high_at += 1
            while len(low_p) > low_at and low_p[-1] >= price:
                low_p.pop()
                low_t.pop()
            low_p.append(price)
            low_t.append(ts)
            while low_t[low_at] < cutoff:
                low_at += 1
            # the reference: the later of the nearest low and the nearest high, a tie going to the low
            low = nearest(low_t, low_p, low_at, -1.0, ts, price, threshold, near_us) if price - low_p[low_at] >= threshold else -1
            high = nearest(high_t, high_p, high_at, 1.0, ts, price, threshold, near_us) if high_p[high_at] - price >= threshold else -1
            if position and abs(price - ref) <= pip:
                position, ref = 0, None
            if low < 0 and high < 0:
                position, ref = 0, None
            else:
                of_low = low >= 0 and (high < 0 or low_t[low] >= high_t[high])
                new_us, new = (low_t[low], low_p[low]) if of_low else (high_t[high], high_p[high])
                if ref is not None and abs(new - ref) > pip / 10.0:
                    position, ref = 0, None
                away = price - new
                if not position and abs(away) >= threshold:
                    position = -1 if away > 0 else 1
                    ref_us, ref, open_us, open_mid = new_us, new, ts, price
            if every or (position and position != before):
                places.append(place)
                states.append((position, ref, ref_us, open_us, open_mid))
            if high_at > self.SLACK:
                del high_t[:high_at], high_p[:high_at]
                high_at = 0
            if low_at > self.SLACK:
                del low_t[:low_at], low_p[:low_at]
                low_at = 0
        self.highs, self.lows = (high_t, high_p, high_at), (low_t, low_p, low_at)
        self.state = (position, ref, ref_us, open_us, open_mid)
        return places, states

    def fields(self, ts_us: np.ndarray, mid: np.ndarray, states: list[tuple]) -> dict[str, np.ndarray]:
        """FIELDS of states after the ticks at ts_us, mid."""
        rows = np.array([(p, math.nan if r is None else r, u, o, m) for p, r, u, o, m in states], float).reshape(-1, 5)
        position, ref, ref_us, open_us, open_mid = rows.T
        held = position != 0
        full = lambda v: np.full(len(rows), v)
        only = lambda ok, v: np.where(ok, v, np.nan)
        values = (
            position, ref, mid - ref, only(~np.isnan(ref), (ts_us - ref_us) / 1e6), full(self.threshold), only(held, open_mid + position * self.tp), only(held, open_mid - position * self.sl),
            full(self.timeout), only(held, (ts_us - open_us) / 1e6), full(self.recency),
        )
        return dict(zip(self.FIELDS, values, strict=True))

    def run(self, ts_us: np.ndarray, mid: np.ndarray) -> dict[str, np.ndarray]:
        """FIELDS after every tick."""
        return self.fields(ts_us, mid, self.walk(ts_us, mid, every=True)[1])

    def edges(self, ts_us: np.ndarray, mid: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """(places, FIELDS there) of the ticks at which a position is taken: it differs from the tick before and is not 0."""
        places, states = self.walk(ts_us, mid, every=False)
        at = np.array(places, np.int64)
        return at, self.fields(ts_us[at], mid[at], states)


class Ledger:
    """One position at a time over one instrument's ticks, fed in pieces; holds the open trade between them.

    A signal at one tick fills at the next. From the tick after the fill a trade closes by exit signal, then stop or
    target (both: stop), then timeout; the tick that closes may signal the next trade. Closing ticks are found by array
    searches of growing length, so the cost per trade does not depend on how many ticks it skips.
    """

    def __init__(self, pip_size: float, exit_name: str, tp_multiple: float | None, sl_multiple: float | None) -> None:
        self.pip, self.exit_name, self.tp_multiple, self.sl_multiple = pip_size, exit_name, tp_multiple, sl_multiple
        self.trade: dict | None = None
        self.last: tuple | None = None
        self.done: list[dict] = []

    def feed(self, seq, ts_us, mid, opens, direction, tp, sl, timeout, threshold, closes) -> list[dict]:
        """Trades closed within these ticks. opens and closes are the signals of live ticks."""
        n, at = len(seq), 0
        wanted = np.flatnonzero(opens)
        self.done = []
        if n:
            while True:
                if self.trade is None:
                    k = int(np.searchsorted(wanted, at))
                    if k == len(wanted):
                        break
                    i = int(wanted[k])
                    self.trade = {
                        "signal_seq": int(seq[i]),
                        "signal_us": int(ts_us[i]),
                        "signal_price": float(mid[i]),
                        "direction": int(direction[i]),
                        "tp": float(tp[i]),
                        "sl": float(sl[i]),
                        "timeout": float(timeout[i]),
                        "threshold": float(threshold[i]),
                        "fill_us": None,
                    }
                    at = i + 1
                if self.trade["fill_us"] is None:
                    if at >= n:
                        break
                    self.fill(int(ts_us[at]), float(mid[at]))
                    at += 1
                closed = self.search(at, ts_us, mid, closes)
                if closed is None:
                    break
                at = closed
            self.last = (int(seq[-1]), int(ts_us[-1]), float(mid[-1]))
        return self.done

    def fill(self, ts: int, price: float) -> None:
        t = self.trade
        t["fill_us"], t["entry_price"] = ts, price
        if math.isfinite(t["threshold"]) and t["threshold"] > 0 and self.tp_multiple is not None:
            t["tp"] = t["signal_price"] + t["direction"] * t["threshold"] * self.tp_multiple
            t["sl"] = t["signal_price"] - t["direction"] * t["threshold"] * self.sl_multiple

    def search(self, at: int, ts_us, mid, closes) -> int | None:
        """Close the trade at the first tick from `at` on that does so; its place, or None."""
        t, width = self.trade, 64
        up = t["direction"] == 1
        limit = t["fill_us"] + t["timeout"] * 1e6 if math.isfinite(t["timeout"]) and t["timeout"] > 0 else math.inf
        while at < len(mid):
            part = slice(at, at + width)
            m = mid[part]
            hit_tp, hit_sl = (m >= t["tp"], m <= t["sl"]) if up else (m <= t["tp"], m >= t["sl"])
            any_way = closes[part] | hit_tp | hit_sl | (ts_us[part] >= limit)
            k = int(any_way.argmax())
            if any_way[k]:
                if closes[at + k]:
                    self.close(int(ts_us[at + k]), float(m[k]), self.exit_name)
                elif hit_sl[k] or hit_tp[k]:
                    self.close(int(ts_us[at + k]), t["sl"] if hit_sl[k] else t["tp"], "SL" if hit_sl[k] else "TP")
                else:
                    self.close(int(ts_us[at + k]), float(m[k]), "TIMEOUT")
                return at + k
            at, width = at + width, min(2 * width, 1 << 16)
        return None

    def close(self, ts: int, price: float, label: str) -> None:
        t = self.trade
        self.done.append(t | {"exit_us": ts, "exit_price": price, "outcome_label": label, "pnl_pips": (price - t["entry_price"]) * t["direction"] / self.pip, "holding_seconds": (ts - t["fill_us"]) / 1e6})
        self.trade = None

    def finish(self) -> list[dict]:
        """Close what is still open at the last tick; an unfilled trade fills there first."""
        self.done = []
        if self.trade is not None and self.last is not None:
            if self.trade["fill_us"] is None:
                self.fill(*self.last[1:])
            self.close(*self.last[1:], "DATA_END")
        return self.done
