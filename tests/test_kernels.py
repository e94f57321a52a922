"""Kernels against tick-at-a-time forms, with repeated times and heavy-tailed gaps, and against known values."""

from __future__ import annotations

import math

import numpy as np
import pytest
import sequential as seq

from tickspark.operators import kernels as K


def series(seed: int, n: int = 120, scale: float = 1e-3, level: float = 1.2, heavy: bool = False):
    rng = np.random.default_rng(seed)
    gap = rng.pareto(1.2, n) if heavy else rng.uniform(0.05, 1.5, n)
    gap[rng.random(n) < 0.1] = 0.0
    us = 1_400_000_000_000_000 + np.cumsum((gap * 1e6).astype(np.int64))
    return us, (us - us[0]) / 1e6, level + np.cumsum(rng.normal(0, scale, n))


@pytest.mark.parametrize("seed", [7, 17, 123])
@pytest.mark.parametrize("heavy", [False, True])
def test_rolling_moments(seed, heavy):
    us, ts, x = series(seed, heavy=heavy)
    mean, std = K.rolling_moments(us, x, 12)
    m, s = seq.moments(ts, x, 12)
    np.testing.assert_allclose(mean, m, atol=1e-9)
    np.testing.assert_allclose(std, s, atol=1e-7)


def test_zscore_known_values():
    us = np.array([0, 1_000_000, 2_000_000])
    out = K.zscore(us, np.array([1.0001, 2.0001, 3.0001]), 1800)
    assert out["rolling_residual"][-1] == pytest.approx(0.5, abs=1e-3)
    assert out["z_score"][-1] == pytest.approx(1.0, abs=1e-3)
    assert out["z_score"][0] == 0.0


def test_drift():
    us, ts, x = series(17)
    out = K.drift(us, x, 30)
    np.testing.assert_allclose(out["drift"], (x - seq.moments(ts, x, 30)[0]) / 30, atol=1e-11)
    assert set(np.unique(out["drift_sign"])) <= {-1.0, 0.0, 1.0}


@pytest.mark.parametrize("seed", [321, 2024])
def test_ewma_and_slope(seed):
    us, ts, x = series(seed)
    np.testing.assert_allclose(K.ewma(us, x, 25), seq.ewma(ts, x, 25), rtol=1e-12)
    y = K.ewma(us, x, 18)
    out = {"ewma": y, "slope": K.slope_of(us, y, 12)}
    np.testing.assert_allclose(out["slope"], seq.slope(ts, x, 18, 12), rtol=1e-6, atol=1e-9)


def test_start_value_leaves_no_trace_unless_seeded():
    from tickspark.operators.metrics import make_metric

    us, _, x = series(1)
    ticks = {"ts_us": us, "mid": x, "bid": x, "ask": x}
    plain = make_metric("a", "ewma", {"tau_seconds": 60}).arrays(ticks, True)["ewma"]
    compiled = make_metric("a", "ewma", {"tau_seconds": 60, "initial_value": 9.0}).arrays(ticks, True)["ewma"]
    seeded = make_metric("a", "ewma", {"tau_seconds": 60, "initial_value": 9.0, "initial_value_mode": "seeded"}).arrays(ticks, True)["ewma"]
    np.testing.assert_allclose(plain, compiled, rtol=1e-12)
    assert seeded[0] == pytest.approx(9.0, abs=1e-5)


def test_vol_and_rank():
    us, ts, x = series(77, scale=5e-4)
    out = K.ewma_vol(us, x, 45, 90, 64, 1e-4, 3)
    v, p = seq.vol(ts, x, 45, 90, 64, 1e-4, 3)
    np.testing.assert_allclose(out["vol_ewma"], v, rtol=1e-9, atol=1e-18)
    np.testing.assert_allclose(out["vol_percentile"], p, rtol=1e-6, atol=1e-9)
    assert math.isnan(out["vol_percentile"][0]) and out["vol_ewma"][1] == 0.0


def test_smoother_drops_its_first_value():
    us, _, x = series(5)
    r = np.log(x[1:] / x[:-1])
    np.testing.assert_allclose(K.smoother(us[1:], r * r, 45), K.log_variance(us, x, 45)[1:], rtol=1e-12)
    assert K.smoother(us[:1], x[:1], 45).tolist() == [0.0]


def test_rank_known_values():
    us = np.array([0, 2_000_000, 4_000_000])
    ranks = K.percentile_ranks(us, np.array([0.0, 0.2, 1.6]), np.array([0.0, 1.0, 2.0]), 10)
    assert ranks[2] == pytest.approx(0.8)


def test_spread_and_rate():
    us, ts, x = series(99)
    width = np.random.default_rng(3).uniform(0.1, 3, len(x)) * 1e-4
    out = K.spread(us, x, x + width, 1e-4, 25)
    np.testing.assert_allclose(out["spread_percentile"], seq.spread_rank(ts, out["spread_pips"], 25))
    ties = np.round(width, 5)
    np.testing.assert_allclose(K.spread(us, 0 * x, ties, 1e-4, 25)["spread_percentile"], seq.spread_rank(ts, ties / 1e-4, 25))
    np.testing.assert_array_equal(K.tick_rate(us, 12)["tick_count"], seq.count(ts, 12))


def test_edges_of_windows():
    us = np.array([0, 10_000_000])
    assert K.tick_rate(us, 10)["tick_count"].tolist() == [1, 1]  # (t - w, t]
    assert K.spread(us, np.ones(2), np.array([1.2, 1.1]), 0.1, 10)["spread_percentile"].tolist() == [1.0, 0.5]  # [t - w, t]


def after(machine, ts, price):
    """The machine's fields after one more tick."""
    return {k: v[0] for k, v in machine.run(np.array([ts]), np.array([price])).items()}


def test_reversion_known_values():
    m = K.Reversion(1800, 10, 10, 12, 1e-4)
    for t, p in ((0, 1.2000), (5, 1.2003), (30, 1.2012)):
        v = after(m, t * 1_000_000, p)
    assert v["position"] == -1 and v["reference_price"] == 1.2
    assert v["tp_price"] == pytest.approx(1.2002) and v["sl_price"] == pytest.approx(1.2024)
    assert after(m, 35_000_000, 1.20005)["position"] == 1  # flat and reopened the other way on one tick


def test_reversion_waits_for_recency():
    m = K.Reversion(1800, 10, 10, 10, 1e-4, 30)
    assert [after(m, t * 1_000_000, p)["position"] for t, p in ((0, 1.2), (20, 1.2012), (40, 1.2013))] == [0, 0, -1]


@pytest.mark.parametrize("recency", [0.0, 5.0])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_reversion_random(seed, recency):
    us, ts, x = series(seed, 400, 4e-4)
    x = np.round(x, 4)
    m, o = K.Reversion(60, 10, 10, 10, 1e-4, recency), seq.Reversion(60, 10, 10, 10, 1e-4, recency)
    wanted = [o.step(t, p) for t, p in zip(ts.tolist(), x.tolist(), strict=True)]
    assert m.run(us, x)["position"].tolist() == wanted
    pieces, taken, before = K.Reversion(60, 10, 10, 10, 1e-4, recency), [], 0
    pieces.SLACK = 3
    for part in np.array_split(np.arange(len(x)), 9):
        at, fields = pieces.edges(us[part], x[part])
        taken += zip(part[at].tolist(), fields["position"].tolist(), strict=True)
    assert taken == [(i, p) for i, (q, p) in enumerate(zip([0, *wanted], wanted)) if p and p != q]


@pytest.mark.parametrize("pieces", [1, 7])
@pytest.mark.parametrize("seed", range(4))
def test_ledger_random(seed, pieces):
    us, ts, x = series(seed, 2000, 1e-3)
    rng = np.random.default_rng(seed)
    n = len(x)
    opens, closes = rng.random(n) < 0.05, rng.random(n) < 0.01
    d = rng.choice([-1, 1], n)
    tp, sl = x + d * rng.uniform(2e-3, 9e-3, n), x - d * rng.uniform(2e-3, 9e-3, n)
    timeout = np.where(rng.random(n) < 0.5, rng.uniform(1, 40, n), np.nan)
    book, done = K.Ledger(1e-4, "exit", None, None), []
    for part in np.array_split(np.arange(n), pieces):
        done += book.feed(part, us[part], x[part], opens[part], d[part], tp[part], sl[part], timeout[part], np.full(len(part), np.nan), closes[part])
    done += book.finish()
    wanted = seq.ledger(ts, x, opens, d, tp, sl, np.nan_to_num(timeout), closes, 1e-4, "exit")
    assert len(done) == len(wanted) > 20
    for a, b in zip(done, wanted, strict=True):
        assert (a["signal_seq"], a["outcome_label"]) == (b[0], b[5])
        assert [(a["fill_us"] - us[0]) / 1e6, (a["exit_us"] - us[0]) / 1e6, a["entry_price"], a["exit_price"], a["pnl_pips"]] == pytest.approx([b[1], b[2], b[3], b[4], b[6]], abs=1e-6)


def one(mid, *, opens, d=1, tp=math.nan, sl=math.nan, timeout=math.nan, closes=(), step=1_000_000, threshold=math.nan, multiples=(None, None)):
    n = len(mid)
    book = K.Ledger(1e-4, "exit", *multiples)
    full = lambda v: np.full(n, v, float)
    done = book.feed(np.arange(n), np.arange(n) * step, np.array(mid, float), np.isin(np.arange(n), opens), np.full(n, d), full(tp), full(sl), full(timeout), full(threshold), np.isin(np.arange(n), closes))
    return done + book.finish()


def test_stop_wins_over_target():
    (t,) = one([1.2, 1.2345, 1.2345], opens=[0], tp=1.2345, sl=1.2345)
    assert (t["exit_price"], t["outcome_label"]) == (1.2345, "SL")


def test_no_close_on_the_fill_tick_and_reopen_on_the_closing_tick():
    a, b = one([1.2, 1.3, 1.3, 1.3], opens=[0, 2], tp=1.25)
    assert (a["fill_us"], a["exit_us"], a["exit_price"], a["outcome_label"]) == (1_000_000, 2_000_000, 1.25, "TP")
    assert (b["signal_seq"], b["outcome_label"]) == (2, "DATA_END")


def test_timeout_and_data_end():
    (t,) = one([1.0] * 3, opens=[0], timeout=30, step=45_000_000)
    assert (t["outcome_label"], t["holding_seconds"]) == ("TIMEOUT", 45.0)
    (t,) = one([1.1], opens=[0])
    assert (t["entry_price"], t["exit_price"], t["outcome_label"], t["pnl_pips"]) == (1.1, 1.1, "DATA_END", 0.0)


def test_exit_signal_comes_first():
    (t,) = one([1.2, 1.2, 1.3], opens=[0], tp=1.25, closes=[2])
    assert (t["outcome_label"], t["exit_price"]) == ("exit", 1.3)


def test_levels_are_anchored_at_the_signal_price():
    (t,) = one([1.0, 1.01, 1.02], opens=[0], threshold=0.005, multiples=(2.0, 1.0))
    assert (t["tp"], t["sl"]) == pytest.approx((1.01, 0.995))
