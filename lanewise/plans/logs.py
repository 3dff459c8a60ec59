"""Logs with the run's context, as text or JSON, audit records and metrics."""

from __future__ import annotations

import json
import logging
from datetime import datetime, timezone
from typing import Any

CONTEXT = ("run_id", "job", "env", "batch_date")


class JsonFormatter(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        line = {"timestamp": datetime.now(timezone.utc).isoformat(), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        line |= {k: getattr(record, k) for k in CONTEXT if hasattr(record, k)}
        if record.exc_info:
            line["exception"] = self.formatException(record.exc_info)
        return json.dumps(line)


class ContextLogger(logging.LoggerAdapter):
    def process(self, msg, kwargs):
        kwargs["extra"] = {**self.extra, **kwargs.get("extra", {})}
        return msg, kwargs


def configure_logging(level: str = "INFO", json_logs: bool = False) -> None:
    handler = logging.StreamHandler()
    handler.setFormatter(JsonFormatter() if json_logs else logging.Formatter("%(asctime)s %(levelname)s %(name)s - %(message)s"))
    own = logging.getLogger("lanewise")
    own.handlers[:] = [handler]
    own.setLevel(level.upper())


def get_logger(name: str = "lanewise", **context: Any) -> ContextLogger:
    return ContextLogger(logging.getLogger(name), context)


def build_audit_record(run_id: str, status: str, details: dict[str, Any] | None = None) -> dict[str, Any]:
    return {"run_id": run_id, "status": status, "details": details or {}}


def emit_batch_metrics(metrics: dict[str, Any]) -> None:
    """One log line with a run's figures as JSON, for whatever collects the logs."""
    get_logger("lanewise.metrics").info("%s", json.dumps(metrics, default=str, sort_keys=True))
