"""YAML configurations: strict keys, versioned schemas, frozen results."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from pathlib import Path
from typing import Any

import yaml

from tickspark.errors import ConfigError
from tickspark.operators.engines import make_params
from tickspark.operators.metrics import Metric, make_metric
from tickspark.operators.predicates import Predicate, distinct
from tickspark.operators.simulate import Strategy


@dataclass(frozen=True)
class Schema:
    """A supported schema version; migrate, if any, turns its mapping into the canonical one."""

    canonical: str = "1.0"
    migrate: Callable[[dict], dict] | None = None


SCHEMAS: dict[str, dict[str, Schema]] = {kind: {"1.0": Schema()} for kind in ("backtest", "metrics", "strategy")}


@dataclass(frozen=True)
class BacktestConfig:
    schema_version: str
    pairs: tuple[str, ...]
    start: tuple[int, int]
    end: tuple[int, int]
    pip_size: float
    warmup_seconds: int
    data_base_path: Path
    output_base_path: Path
    metrics_config_path: Path
    strategy_config_path: Path
    metrics: tuple[Metric, ...]
    strategy: Strategy


def _load(source: str | Path | Mapping, kind: str) -> dict:
    """Mapping of a YAML file (or the mapping itself) in its canonical schema."""
    if isinstance(source, Mapping):
        raw: Any = dict(source)
    else:
        try:
            raw = yaml.safe_load(Path(source).expanduser().read_text())
        except OSError as wrong:
            raise ConfigError(f"cannot read {kind} configuration: {wrong}") from wrong
        except yaml.YAMLError as wrong:
            raise ConfigError(f"{source} is not YAML: {wrong}") from wrong
    if not isinstance(raw, dict):
        raise ConfigError(f"{kind} configuration must be a mapping")
    version = raw.get("schema_version")
    known = SCHEMAS[kind]
    if version is None:
        raise ConfigError(f"{kind} configuration must declare 'schema_version' (supported: {sorted(known)})")
    if (schema := known.get(str(version))) is None:
        raise ConfigError(f"{kind} configuration has unsupported schema_version '{version}' (supported: {sorted(known)})")
    return (schema.migrate(raw) if schema.migrate else raw) | {"schema_version": schema.canonical}


def _keys(raw: Mapping, where: str, required: set[str], optional: set[str] = frozenset()) -> None:
    if not isinstance(raw, Mapping):
        raise ConfigError(f"{where} must be a mapping")
    if extra := sorted(set(raw) - required - optional):
        raise ConfigError(f"{where}: unexpected keys {extra}")
    if missing := sorted(required - set(raw)):
        raise ConfigError(f"{where}: missing keys {missing}")


def _text(value, where: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ConfigError(f"{where} must be a non-empty string")
    return value.strip()


def _params(value, where: str) -> dict:
    if value is None:
        return {}
    if not isinstance(value, dict):
        raise ConfigError(f"{where} must be a mapping")
    return value


def year_month(value, where: str) -> tuple[int, int]:
    found = re.fullmatch(r"(\d{1,4})-(\d{1,2})", _text(value, where))
    if not found or not 1 <= int(found[2]) <= 12:
        raise ConfigError(f"{where}: '{value}' is not YYYY-MM")
    return int(found[1]), int(found[2])


def metrics_config(source: str | Path | Mapping) -> tuple[Metric, ...]:
    """Metrics of a configuration, disabled ones included; repeated names and unknown types are errors."""
    raw = _load(source, "metrics")
    _keys(raw, "metrics configuration", {"schema_version"}, {"metrics"})
    entries = [] if raw.get("metrics") is None else raw["metrics"]
    if not isinstance(entries, list):
        raise ConfigError("'metrics' must be a list")
    out = []
    for i, entry in enumerate(entries, 1):
        _keys(entry, f"metric #{i}", {"name", "type"}, {"enabled", "params"})
        out.append(make_metric(_text(entry["name"], f"metric #{i} 'name'"), _text(entry["type"], f"metric #{i} 'type'"), _params(entry.get("params"), f"metric #{i} 'params'"), entry.get("enabled", True)))
    names = [m.name for m in out]
    if len(set(names)) != len(names):
        raise ConfigError(f"duplicate metric names {sorted({n for n in names if names.count(n) > 1})}")
    return tuple(out)


def _predicates(items, where: str) -> tuple[Predicate, ...]:
    if items is None:
        return ()
    if not isinstance(items, list):
        raise ConfigError(f"{where} 'predicates' must be a list")
    out = []
    for i, item in enumerate(items, 1):
        _keys(item, f"{where} predicate #{i}", {"metric", "operator"}, {"value", "other_metric", "use_abs"})
        out.append(Predicate(item["metric"], item["operator"], item.get("value"), item.get("other_metric"), bool(item.get("use_abs", False))))
    return distinct(out, where)


def strategy_config(source: str | Path | Mapping, empty_exit_closes: bool = True) -> Strategy:
    raw = _load(source, "strategy")
    _keys(raw, "strategy configuration", {"schema_version", "strategy"})
    s = raw["strategy"]
    _keys(s, "'strategy'", {"name", "entry", "exit"})
    _keys(s["entry"], "'entry'", {"name", "engine"}, {"params", "predicates"})
    _keys(s["exit"], "'exit'", {"name"}, {"predicates"})
    engine = _text(s["entry"]["engine"], "'entry.engine'")
    return Strategy(
        name=_text(s["name"], "'strategy.name'"), entry_name=_text(s["entry"]["name"], "'entry.name'"), engine=engine, params=make_params(engine, _params(s["entry"].get("params"), "'entry.params'")),
        entry_predicates=_predicates(s["entry"].get("predicates"), "entry"), exit_name=_text(s["exit"]["name"], "'exit.name'"), exit_predicates=_predicates(s["exit"].get("predicates"), "exit"), empty_exit_closes=empty_exit_closes,
    )


BACKTEST_KEYS = {"schema_version", "pairs", "start", "end", "pip_size", "warmup_seconds", "data_base_path", "output_base_path", "metrics_config_path", "strategy_config_path"}


def backtest_config(source: str | Path | Mapping, empty_exit_closes: bool = True, check_paths: bool = True) -> BacktestConfig:
    """A run's configuration with the metrics and the strategy that it names; the output folder is created."""
    raw = _load(source, "backtest")
    _keys(raw, "backtest configuration", BACKTEST_KEYS)
    pairs = raw["pairs"]
    if not isinstance(pairs, list) or not pairs:
        raise ConfigError("'pairs' must be a non-empty list")
    pairs = tuple(_text(p, "each pair").upper() for p in pairs)
    start, end = year_month(raw["start"], "'start'"), year_month(raw["end"], "'end'")
    if start > end:
        raise ConfigError("'start' lies after 'end'")
    try:
        pip, warmup = float(raw["pip_size"]), int(raw["warmup_seconds"])
    except (TypeError, ValueError) as wrong:
        raise ConfigError(f"'pip_size' and 'warmup_seconds' must be numbers: {wrong}") from wrong
    if not math.isfinite(pip) or pip <= 0:
        raise ConfigError("'pip_size' must be finite and positive")
    if warmup < 0:
        raise ConfigError("'warmup_seconds' must not be negative")
    paths = {k: Path(_text(str(raw[k]), f"'{k}'")).expanduser().resolve() for k in BACKTEST_KEYS if k.endswith("_path")}
    if check_paths:
        if not paths["data_base_path"].is_dir():
            raise ConfigError(f"'data_base_path' is not a folder: {paths['data_base_path']}")
        for k in ("metrics_config_path", "strategy_config_path"):
            if not paths[k].is_file():
                raise ConfigError(f"'{k}' is not a file: {paths[k]}")
        try:
            paths["output_base_path"].mkdir(parents=True, exist_ok=True)
        except OSError as wrong:
            raise ConfigError(f"cannot create 'output_base_path': {wrong}") from wrong
    return BacktestConfig(raw["schema_version"], pairs, start, end, pip, warmup, **paths, metrics=metrics_config(paths["metrics_config_path"]), strategy=strategy_config(paths["strategy_config_path"], empty_exit_closes))
