"""How far a plan has come: callbacks, the log, and the time that is left."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

LOG = logging.getLogger("chronoweft")


class Progress:
    """Counts the units of a plan.  The time left is the mean time of the units done, for each one to come."""

    def __init__(self, units: int, report: Callable[[float, float, str], None] | None = None, event: Callable[[str], None] | None = None, clock=time.perf_counter):
        self.units, self.done, self.report, self.event, self.clock = max(1, units), 0, report, event, clock
        self.began = clock()

    def step(self, what: str, units: int = 1) -> tuple[float, float]:
        """(percent, seconds left) after ``units`` more; told to the callbacks and the log."""
        self.done = min(self.units, self.done + units)
        left = (self.units - self.done) * (self.clock() - self.began) / self.done if self.done else 0.0
        percent = 100.0 * self.done / self.units
        line = f"{percent:5.1f}% | {left:6.1f}s left | {what}"
        LOG.info(line)
        if self.event:
            self.event(line)
        if self.report:
            self.report(percent, left, what)
        return percent, left


def log_to(path: str | None = None, level: int = logging.INFO) -> logging.Logger:
    """Send the plans' log to standard error and, if a path is given, to a file; earlier handlers go."""
    for h in list(LOG.handlers):
        LOG.removeHandler(h)
        h.close()
    LOG.setLevel(level)
    for h in [logging.StreamHandler(), *([logging.FileHandler(path, encoding="utf-8")] if path else [])]:
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        LOG.addHandler(h)
    return LOG
