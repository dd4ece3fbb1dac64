"""Phases of a request by wall time, and progress lines."""

from __future__ import annotations

import json
import os
import platform
import sys
import time
from contextlib import contextmanager

from orrery.contracts import PHASES

PROGRESS_STEP = 256


def milliseconds(seconds: float) -> float:
    return seconds * 1000.0


class Timings:
    """Seconds and number of runs of each phase, in order of first use; nothing is measured where it is off."""

    def __init__(self, enabled: bool = True):
        self.enabled, self.phases, self.began, self.facts = enabled, {}, time.perf_counter(), {}

    @contextmanager
    def phase(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            if self.enabled:
                seconds, n = self.phases.get(name, (0.0, 0))
                self.phases[name] = seconds + time.perf_counter() - began, n + 1

    def add(self, name: str, milliseconds: float, n: int = 1) -> None:
        """Time that tasks measured, all of them together."""
        if self.enabled:
            seconds, before = self.phases.get(name, (0.0, 0))
            self.phases[name] = seconds + milliseconds / 1000.0, before + n

    def table(self, spark):
        """rows() as a table, for phase_rollup."""
        return spark.createDataFrame(self.rows(), PHASES)

    def note(self, **facts) -> None:
        """What the report says of the request: size of the corpus, state of the caches."""
        self.facts |= facts

    def rows(self) -> list[tuple[str, float, int]]:
        """phase, elapsed_ms, invocations."""
        return [(name, milliseconds(seconds), n) for name, (seconds, n) in self.phases.items()]

    def report(self) -> str:
        machine = {"os": platform.system().lower(), "architecture": platform.machine(), "logical_cpu_count": os.cpu_count(), "python": platform.python_version()}
        phases = [{"phase": name, "elapsed_ms": ms, "invocations": n} for name, ms, n in self.rows()]
        return json.dumps({"schema_version": 1, "environment": machine | self.facts, "phases": phases, "total_wall_ms": milliseconds(time.perf_counter() - self.began)}) + "\n"

    def write(self, where: str) -> None:
        """To a file, or to standard error for "-"."""
        if self.enabled and where == "-":
            sys.stderr.write(self.report())
        elif self.enabled:
            with open(where, "w") as f:
                f.write(self.report())


class Progress:
    """Lines for readers without a terminal: the total, and after every PROGRESS_STEP files how many are done."""

    def __init__(self, write=lambda line: print(line, file=sys.stderr)):
        self.write, self.total, self.done = write, 0, 0

    def started(self, total: int) -> None:
        self.total, self.done = total, 0
        self.write(f"Indexing {total} images...")

    def processed(self, n: int) -> None:
        for k in range(self.done // PROGRESS_STEP + 1, (self.done + n) // PROGRESS_STEP + 1):
            if k * PROGRESS_STEP < self.total:
                self.write(f"Indexed {k * PROGRESS_STEP}/{self.total} images")
        self.done += n

    def skipped(self, path: bytes, error: str) -> None:
        self.write(f"warning: {path.decode('utf-8', 'backslashreplace')}: {error}")
