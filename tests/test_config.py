from __future__ import annotations

import pytest
import yaml

from tickspark.config import SCHEMAS, Schema, backtest_config, metrics_config, strategy_config
from tickspark.errors import ConfigError
from tickspark.operators.metrics import EwmaVol

METRICS = {"schema_version": "1.0", "metrics": [{"name": "z", "type": "zscore", "params": {"lookback_seconds": 300.0}}, {"name": "v", "type": "ewma_vol", "enabled": False}]}
STRATEGY = {
    "schema_version": "1.0",
    "strategy": {
        "name": "s",
        "entry": {"name": "e", "engine": "threshold_reversion", "params": {"lookback_seconds": 60, "threshold_pips": 10}, "predicates": [{"metric": "z.z_score", "operator": ">", "value": "5e-07", "use_abs": True}]},
        "exit": {"name": "x", "predicates": []},
    },
}


def put(base, path, value):
    import copy

    out = copy.deepcopy(base)
    at = out
    for k in path[:-1]:
        at = at[k]
    if value is None:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return out


def test_metrics():
    z, v = metrics_config(METRICS)
    assert z.lookback_seconds == 300 and isinstance(v, EwmaVol) and not v.enabled and v.bins == 256
    assert metrics_config({"schema_version": "1.0"}) == ()


@pytest.mark.parametrize(
    ("path", "value"),
    [(("schema_version",), None), (("schema_version",), "2.0"), (("more",), 1), (("metrics",), {}), (("metrics", 0, "name"), " "), (("metrics", 0, "type"), "nothing"), (("metrics", 0, "params"), []), (("metrics", 0, "x"), 1), (("metrics", 1, "name"), "z"), (("metrics", 0, "enabled"), "yes")],
)
def test_metrics_rejected(path, value):
    with pytest.raises(ConfigError):
        metrics_config(put(METRICS, path, value))


def test_strategy():
    s = strategy_config(STRATEGY)
    assert s.params.tp_pips == s.params.sl_pips == 10 and s.params.multiples() == (1.0, 1.0)
    assert s.entry_predicates[0].value == 5e-07 and s.exit_predicates == () and s.empty_exit_closes


@pytest.mark.parametrize(
    ("path", "value"),
    [
        (("strategy", "name"), None), (("strategy", "x"), 1), (("strategy", "entry", "engine"), "nothing"), (("strategy", "entry", "params", "threshold_pips"), None), (("strategy", "entry", "params", "x"), 1), (("strategy", "entry", "params", "threshold_pips"), -1),
        (("strategy", "entry", "predicates"), {}), (("strategy", "entry", "predicates", 0, "operator"), "="), (("strategy", "entry", "predicates", 0, "other_metric"), "a"), (("strategy", "entry", "predicates", 0, "x"), 1), (("strategy", "exit", "name"), None), (("strategy", "entry", "predicates"), [{"metric": "a", "operator": "<", "value": 1}] * 2),
    ],
)
def test_strategy_rejected(path, value):
    with pytest.raises(ConfigError):
        strategy_config(put(STRATEGY, path, value))


def written(tmp_path, **more):
    (tmp_path / "data").mkdir(exist_ok=True)
    (tmp_path / "m.yaml").write_text(yaml.safe_dump(METRICS))
    (tmp_path / "s.yaml").write_text(yaml.safe_dump(STRATEGY))
    base = {"schema_version": "1.0", "pairs": [" eurusd "], "start": "2015-01", "end": "2015-02", "pip_size": 0.0001, "warmup_seconds": 0, "data_base_path": str(tmp_path / "data"), "output_base_path": str(tmp_path / "out"), "metrics_config_path": str(tmp_path / "m.yaml"), "strategy_config_path": str(tmp_path / "s.yaml")}
    path = tmp_path / "b.yaml"
    path.write_text(yaml.safe_dump({k: v for k, v in (base | more).items() if v is not None}))
    return path


def test_backtest(tmp_path):
    c = backtest_config(written(tmp_path))
    assert c.pairs == ("EURUSD",) and (c.start, c.end) == ((2015, 1), (2015, 2)) and (tmp_path / "out").is_dir()


@pytest.mark.parametrize("more", [{"pairs": []}, {"pairs": [1]}, {"start": "2015-13"}, {"start": "2016-01"}, {"pip_size": 0}, {"warmup_seconds": -1}, {"x": 1}, {"end": None}, {"schema_version": None}, {"data_base_path": "/nowhere/at/all"}, {"metrics_config_path": "/nowhere.yaml"}])
def test_backtest_rejected(tmp_path, more):
    with pytest.raises(ConfigError):
        backtest_config(written(tmp_path, **more))


def test_migration(monkeypatch):
    monkeypatch.setitem(SCHEMAS["metrics"], "0.9", Schema(migrate=lambda raw: {"metrics": raw["entries"]}))
    assert metrics_config({"schema_version": "0.9", "entries": METRICS["metrics"]})[0].name == "z"
