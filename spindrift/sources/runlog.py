"""Recording a run: typed events collected on the driver, written as JSON lines, summarised by the run analytics."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from spindrift.operators.runs import EVENT_SCHEMA, summarize
from spindrift.sources import repo

FEEDBACK = 500


class RunLog:
    """Events of one run; the clock and the id can be given, for results that repeat."""

    def __init__(self, run_id: str | None = None, clock=time.monotonic):
        self.run_id = run_id or f"{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
        self.clock, self.begun = clock, clock()
        self.rows: list[tuple] = []

    def event(self, kind: str, **data) -> None:
        texts = {k: v if isinstance(v, str) else ",".join(v) if isinstance(v, (list, tuple)) else str(v) for k, v in data.items() if v is not None}
        self.rows.append((self.run_id, len(self.rows) + 1, round(float(self.clock() - self.begun), 6), kind, texts))

    def phase(self, name: str) -> None:
        self.event("phase", name=name)

    def context(self, tokens: int, budget: int, files: list[str]) -> None:
        self.event("context", tokens=tokens, budget=budget, files=files)

    def model_call(self, latency: float, purpose: str = "") -> None:
        self.event("model_call", latency=round(latency, 3), purpose=purpose)

    def action(self, tool: str, ok: bool) -> None:
        self.event("action", tool=tool, ok=ok)

    def check(self, ok: bool, signal: float, attempt: int = 0) -> None:
        self.event("check", ok=ok, signal=signal, attempt=attempt)

    def repair(self, feedback: str) -> None:
        self.event("repair", feedback=feedback[:FEEDBACK])

    def outcome(self, resolved: bool, won_by: str = "", attempts: int = 0, files: list[str] = ()) -> None:
        self.event("outcome", resolved=resolved, won_by=won_by, attempts=attempts, files=list(files))

    def note(self, text: str) -> None:
        self.event("note", text=text)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, EVENT_SCHEMA)

    def close(self, spark: SparkSession, folder: str) -> dict:
        """Appends the events to the log and returns the run's summary."""
        events = self.table(spark)
        repo.write_events(events.coalesce(1), folder)
        return repo.to_json_rows(summarize(events))[0]
