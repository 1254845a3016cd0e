"""Ingestion jobs: one at a time for each source, with a state that ends as completed, failed or cancelled."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class Job:
    source: str
    id: str = field(default_factory=lambda: uuid.uuid4().hex)
    state: str = "running"
    error: str = ""
    stop: threading.Event = field(default_factory=threading.Event)


class Jobs:
    def __init__(self) -> None:
        self._lock, self._jobs = threading.Lock(), {}

    def start(self, source: str, work: Callable[[threading.Event], None]) -> Job:
        with self._lock:
            if any(j.source == source and j.state == "running" for j in self._jobs.values()):
                raise RuntimeError(f"a job of {source} is running")
            job = self._jobs.setdefault((j := Job(source)).id, j)
        threading.Thread(target=self._run, args=(job, work), daemon=True).start()
        return job

    def _run(self, job: Job, work: Callable[[threading.Event], None]) -> None:
        try:
            work(job.stop)
            job.state = "cancelled" if job.stop.is_set() else "completed"
        except Exception as e:  # a job's failure is its result
            job.state, job.error = "failed", str(e)

    def cancel(self, job_id: str) -> None:
        self._jobs[job_id].stop.set()

    def get(self, job_id: str) -> Job:
        return self._jobs[job_id]

    def list(self) -> list[Job]:
        return [*self._jobs.values()]
