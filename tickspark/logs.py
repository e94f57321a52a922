"""Structured logs: one JSON object per line, with run and pair."""

from __future__ import annotations

import json
import logging
import subprocess
import uuid
from contextvars import ContextVar
from datetime import UTC, datetime
from pathlib import Path

run_id: ContextVar[str | None] = ContextVar("run_id", default=None)
pair: ContextVar[str | None] = ContextVar("pair", default=None)
_PLAIN = set(logging.makeLogRecord({}).__dict__) | {"message", "asctime", "taskName"}


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        out = {"timestamp": datetime.fromtimestamp(record.created, UTC).isoformat(), "level": record.levelname, "logger": record.name, "message": record.getMessage(), "run_id": run_id.get(), "pair": pair.get()}
        out |= {k: v for k, v in record.__dict__.items() if k not in _PLAIN}
        if record.exc_info:
            out["exception"] = self.formatException(record.exc_info)
        return json.dumps(out, default=str)


def new_run_id() -> str:
    return f"{datetime.now(UTC):%Y%m%dT%H%M%SZ}-{uuid.uuid4().hex[:8]}"


def setup(run: str, folder: Path | None = None, level: str | int = "INFO") -> logging.Logger:
    """The package's logger, to stderr and, with a folder, to {folder}/{run}.log."""
    run_id.set(run)
    log = logging.getLogger("tickspark")
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if folder is not None:
        folder.mkdir(parents=True, exist_ok=True)
        handlers.append(logging.FileHandler(folder / f"{run}.log"))
    for h in handlers:
        h.setFormatter(JsonLines())
        log.addHandler(h)
    log.setLevel(level)
    log.propagate = False
    return log


def git_hash(folder: Path | None = None) -> str | None:
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, check=True, cwd=folder).stdout.strip()
    except (OSError, subprocess.CalledProcessError):
        return None
