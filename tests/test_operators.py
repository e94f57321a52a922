"""Validation, metrics, predicates, signals and the ledger as DataFrames."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tickspark.errors import ConfigError
from tickspark.operators import engines, simulate, validate
from tickspark.operators.metrics import REGISTRY, Metric, add_metrics, make_metric, register_metric
from tickspark.operators.predicates import Predicate, all_hold, distinct, holds

COLUMNS = "instrument string, seq long, ts_us long, bid double, ask double, mid double"


def frame(spark, rows, instrument="A"):
    """rows of (seconds, bid, ask)."""
    made = [(instrument, i, None if t is None else int(t * 1e6), b, a, None if a is None or b is None else (a + b) / 2) for i, (t, b, a) in enumerate(rows)]
    return spark.createDataFrame(made, COLUMNS)


def walk(spark, n=300, instruments=("A", "B"), seed=5):
    rng, rows = np.random.default_rng(seed), []
    for k in instruments:
        ts = np.cumsum((rng.uniform(0, 30, n) * 1e6).astype(int))
        mid = 100 + np.cumsum(rng.normal(0, 1, n))
        rows += [(k, i, int(t), float(m - 0.01), float(m + 0.01), float(m)) for i, (t, m) in enumerate(zip(ts, mid, strict=True))]
    return spark.createDataFrame(rows, COLUMNS)


def test_issues_in_order(spark):
    t = frame(spark, [(10, 1.0, 1.1), (None, 1.0, 1.1), (11, None, 1.1), (12, 1.0, math.inf), (13, 1.2, 1.1), (5, 1.0, 1.1), (10, 1.0, 1.1), (4, 1.2, 1.1), (20, 1.0, 1.1)])
    got = [r.issue for r in validate.audit(t).orderBy("seq").collect()]
    assert got == [None, "non_finite_field:timestamp", "missing_field:bid", "non_finite_field:ask", "negative_spread", "timestamp_regression", None, "negative_spread", None]
    row = validate.tally(validate.audit(t)).first()
    assert (row.total_ticks, row.accepted_ticks, row.skipped_ticks) == (9, 3, 6)
    assert row.issues["negative_spread"] == 2


def test_wrong_mid(spark):
    t = spark.createDataFrame([("A", 0, 0, 1.0, 1.1, 1.2), ("A", 1, 0, 1.0, 1.1, 1.05)], COLUMNS)
    assert [r.issue for r in validate.audit(t).orderBy("seq").collect()] == ["invalid_mid", None]


def test_regression_across_parts(spark):
    part = 1 << validate.PART_BITS
    t = spark.createDataFrame([("A", 5, 100, 1.0, 1.1, 1.05), ("A", part + 1, 90, 1.0, 1.1, 1.05), ("A", 3 * part, 100, 1.0, 1.1, 1.05)], COLUMNS)
    assert [r.issue for r in validate.audit(t).orderBy("seq").collect()] == [None, "timestamp_regression", None]


def test_empty_table(spark):
    t = spark.createDataFrame([], COLUMNS)
    assert validate.audit(t).count() == 0
    assert add_metrics(t, [make_metric("r", "tick_rate", {"window_seconds": 5})]).count() == 0


METRICS = [
    ("z", "zscore", {"lookback_seconds": 300}), ("d", "drift_sign", {"lookback_seconds": 300}), ("e", "ewma", {"tau_seconds": 20}), ("s", "ewma_slope", {"tau_seconds": 20, "window_seconds": 60}),
    ("v", "ewma_vol", {"tau_seconds": 20, "percentile_horizon_seconds": 100, "base_vol": 0.01}), ("sp", "spread", {"pip_size": 0.01, "window_seconds": 60}), ("t", "tick_rate", {"window_seconds": 60}), ("n", "session", {}),
]


def test_blocks_do_not_change_values(spark):
    t, ms = walk(spark), [make_metric(*m) for m in METRICS]
    whole, parts = (add_metrics(t, ms, b).toPandas().sort_values(["instrument", "seq"]).reset_index(drop=True) for b in (None, 600))
    assert len(whole) == len(parts) == 600
    for c in whole.columns:
        if whole[c].dtype == float:
            np.testing.assert_allclose(whole[c], parts[c], rtol=1e-9, atol=1e-9, err_msg=c)


def test_long_gaps_across_blocks(spark):
    """Samples after long gaps reach far: they shield later ticks across several blocks."""
    rng = np.random.default_rng(12)
    at = np.cumsum(np.where(rng.random(500) < 0.03, rng.uniform(300, 1500, 500), rng.uniform(0.5, 8, 500)))
    mid = 100 * np.exp(np.cumsum(rng.normal(0, 1e-4, 500)))
    t = frame(spark, [(float(s), float(m), float(m + w)) for s, m, w in zip(at, mid, rng.uniform(0.01, 0.1, 500), strict=True)])
    ms = [make_metric(*m) for m in METRICS]
    whole, parts = (add_metrics(validate.accepted(validate.audit(t)), ms, b).toPandas().sort_values("seq").reset_index(drop=True) for b in (10**7, 60))
    assert len(whole) == len(parts) == 500
    for c in whole.columns:
        if whole[c].dtype == float:
            np.testing.assert_allclose(whole[c], parts[c], rtol=1e-8, atol=1e-8, err_msg=c)


def test_endless_and_bounded_metrics_together(spark):
    t = walk(spark)
    machine = ("m", "threshold_reversion", {"lookback_seconds": 300, "threshold_pips": 2, "pip_size": 0.01, "tp_pips": 2, "sl_pips": 2})
    rate = ("t", "tick_rate", {"window_seconds": 60})
    both = add_metrics(t, [make_metric(*machine), make_metric(*rate)], 600)
    assert [c for c in both.columns if "." in c] == [*make_metric(*machine).columns(), *make_metric(*rate).columns()]
    alone = add_metrics(t, [make_metric(*machine)])
    key = lambda df, c: sorted((r.instrument, r.seq, r[c]) for r in df.collect())
    assert key(both, "m.position") == key(alone, "m.position") and any(x[2] for x in key(alone, "m.position"))
    assert key(both, "t.tick_count") == key(add_metrics(t, [make_metric(*rate)]), "t.tick_count")


def test_disabled_and_repeated_metrics(spark):
    t = frame(spark, [(0, 1.0, 1.1)])
    assert add_metrics(t, [make_metric("a", "tick_rate", {"window_seconds": 5}, enabled=False)]).columns == t.columns
    with pytest.raises(ConfigError):
        add_metrics(t, [make_metric("a", "session"), make_metric("a", "session")])


@pytest.mark.parametrize(
    ("kind", "params"),
    [("zscore", {"lookback_seconds": 1.5}), ("zscore", {"lookback_seconds": True}), ("zscore", {}), ("zscore", {"lookback_seconds": 5, "x": 1}), ("ewma", {"tau_seconds": math.nan}), ("ewma", {"tau_seconds": 1, "price_field": "last"}), ("ewma_vol", {"bins": 1}), ("ewma_vol", {"bins": 20000}), ("tick_rate", {"window_seconds": -1}), ("spread", {"pip_size": "a", "window_seconds": 1}), ("nothing", {})],
)
def test_parameters_are_checked(kind, params):
    with pytest.raises(ConfigError):
        make_metric("m", kind, params)


def test_own_metric(spark):
    @register_metric
    class Half(Metric):
        kind = "half"
        outputs = ("value",)

        def arrays(self, ticks, first):
            return {"value": ticks["mid"] / 2}

    try:
        out = add_metrics(frame(spark, [(0, 1.0, 3.0)]), [make_metric("h", "half")])
        assert out.first()["h.value"] == 1.0
    finally:
        del REGISTRY["half"]


def test_predicates(spark):
    df = spark.createDataFrame([(1.0, 2.0, "3", True), (float("nan"), 2.0, "x", True), (None, float("inf"), None, False), (-5.0, 1.0, "1", False)], "a double, b double, s string, f boolean")
    check = lambda p: [r[0] for r in df.select(holds(p, df.schema)).collect()]
    assert check(Predicate("a", "!=", 7)) == [True, False, False, True]
    assert check(Predicate("a", ">", 4, use_abs=True)) == [False, False, False, True]
    assert check(Predicate("a", "<", other_metric="b")) == [True, False, False, True]
    assert check(Predicate("s", ">=", 3)) == [True, False, False, False]
    assert check(Predicate("f", "!=", 3)) == [False] * 4
    assert check(Predicate("nowhere", "!=", 3)) == [False] * 4
    assert [r[0] for r in df.select(all_hold([], df.schema)).collect()] == [True] * 4


def test_predicate_configuration():
    for wrong in ({"operator": "~", "value": 1}, {"operator": "<"}, {"operator": "<", "value": 1, "other_metric": "b"}, {"operator": "<", "value": "x"}):
        with pytest.raises(ConfigError):
            Predicate("a", **wrong)
    with pytest.raises(ConfigError):
        distinct([Predicate("a", "<", 1), Predicate("a", "<", 1.0)], "entry")


def test_warm_up(spark):
    t = frame(spark, [(0, 1.0, 1.1), (20, 1.0, 1.1), (40, 1.0, 1.1), (40, 1.0, 1.1)])
    flags = lambda s: [r.live for r in simulate.live(t, s).orderBy("seq").collect()]
    assert flags(40) == [False, False, False, True]
    assert flags(0) == [False, True, True, True]


def crossing(spark, fast, slow, **params):
    rows = [("A", i, i * 1_000_000, 1.2, 1.2, 1.2, f, s) for i, (f, s) in enumerate(zip(fast, slow, strict=True))]
    df = spark.createDataFrame(rows, COLUMNS + ", `f.x` double, `s.x` double")
    p = engines.make_params("ewma_crossover", {"fast_metric": "f.x", "slow_metric": "s.x", **params})
    return p.apply(df, 1e-4).orderBy("seq").collect()


def test_crossover(spark):
    rows = crossing(spark, [1.0, 1.002, 1.002, 0.999], [1.001, 1.001, 1.0015, 1.001], short_on_cross=True, tp_pips=5, sl_pips=5)
    assert [r.sig_direction for r in rows] == [0, 1, 0, -1]
    assert (rows[1].sig_tp, rows[1].sig_sl) == pytest.approx((1.2005, 1.1995))
    assert (rows[3].sig_tp, rows[3].sig_sl) == pytest.approx((1.1995, 1.2005))


def test_crossover_touch_and_gap(spark):
    rows = crossing(spark, [0.0, 1.0, 2.0, float("nan"), 0.0, 2.0], [1.0] * 6)
    assert [r.sig_direction for r in rows] == [0, 1, 0, 0, 0, 1]  # a touch fires; after a gap the first value only starts anew
    assert math.isnan(rows[1].sig_tp)


def strategy(**more):
    p = engines.make_params("threshold_reversion", {"lookback_seconds": 1800, "threshold_pips": 2, "trade_timeout_seconds": 300})
    return simulate.Strategy(name="s", entry_name="entry", engine="threshold_reversion", params=p, **more)


def test_empty_exit_closes_at_once(spark):
    t = add_metrics(walk(spark), [make_metric("r", "tick_rate", {"window_seconds": 60})])
    rows = simulate.run_strategy(t, strategy(), 1.0, 0.0).collect()
    assert rows and {r.outcome_label for r in rows} <= {"default_exit", "DATA_END"}
    rows = simulate.run_strategy(t, strategy(empty_exit_closes=False), 1.0, 0.0).collect()
    assert {"TP", "SL"} & {r.outcome_label for r in rows}
    assert all(r["entry_metrics"]["r.tick_count"] == r["r.tick_count"] for r in rows)
    assert all(r.entry_metadata.threshold == 2.0 for r in rows)


def test_blocked_edges_are_used_up(spark):
    t = add_metrics(walk(spark), [make_metric("r", "tick_rate", {"window_seconds": 60})])
    s = simulate.signals(t, strategy(entry_predicates=(Predicate("r.tick_count", "<", 0),)), 1.0, 0.0)
    assert s.filter("should_open").count() == 0
    assert s.filter("sig_open AND reason = 'entry_predicate_blocked'").count() == s.filter("sig_open").count() > 0


def test_trades_do_not_depend_on_batches(spark):
    t = add_metrics(walk(spark), [make_metric("r", "tick_rate", {"window_seconds": 60})])
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        results = []
        for size in ("10000", "17"):
            spark.conf.set(key, size)
            results.append(sorted(map(str, simulate.run_strategy(t, strategy(empty_exit_closes=False), 1.0, 60.0).collect())))
        assert results[0] == results[1] and results[0]
    finally:
        spark.conf.set(key, before)


def test_stub_never_opens(spark):
    assert simulate.run_strategy(walk(spark), simulate.NO_STRATEGY, 1.0, 0.0).count() == 0


def test_close_label():
    assert [simulate.close_label(1.0, 1.0, 0.9), simulate.close_label(0.9, 1.0, 0.9), simulate.close_label(0.95, 1.0, None)] == ["TP", "SL", "EXIT"]
