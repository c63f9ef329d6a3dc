"""Run audit: one row when a task starts, one when it ends."""

from __future__ import annotations

import contextlib
import json
import time
from collections.abc import Iterator
from datetime import datetime, timezone

from millrace.config import Settings
from millrace.store import Store

RUNS = "ops.pipeline_runs"
RUNS_SCHEMA = "run_id string, task_name string, env string, run_month string, status string, metrics string, error string, elapsed_seconds double, logged_at timestamp_ntz"
#: An error text is cut to so many characters.
ERROR_LENGTH = 4000


class AuditLog:
    """Appends rows to the run log."""

    def __init__(self, store: Store, settings: Settings):
        self.store, self.settings = store, settings

    def write(self, task: str, status: str, metrics: dict | None = None, error: str | None = None, elapsed: float | None = None) -> None:
        s = self.settings
        row = (s.run_id, task, s.env, s.run_month, status, json.dumps(metrics) if metrics is not None else None, error[:ERROR_LENGTH] if error else None,
               round(elapsed, 2) if elapsed is not None else None, datetime.now(timezone.utc).replace(tzinfo=None))
        self.store.append(RUNS, self.store.spark.createDataFrame([row], RUNS_SCHEMA))


@contextlib.contextmanager
def audited(log: AuditLog, task: str) -> Iterator[dict]:
    """Logs RUNNING, then SUCCESS with the metrics the block puts into the dict, or FAILED with the error, which is raised again."""
    log.write(task, "RUNNING")
    began, metrics = time.monotonic(), {}
    try:
        yield metrics
    except BaseException as e:
        log.write(task, "FAILED", metrics or None, f"{type(e).__name__}: {e}", time.monotonic() - began)
        raise
    log.write(task, "SUCCESS", metrics, None, time.monotonic() - began)
