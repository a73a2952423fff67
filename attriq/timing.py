"""Wall-clock time of steps, and quiet loggers; on the driver."""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass


@dataclass
class Timer:
    """Used in a with statement; elapsed is null until it ends."""

    elapsed: float | None = None

    def __enter__(self) -> Timer:
        self._start = time.monotonic()
        return self

    def __exit__(self, *_: object) -> None:
        self.elapsed = time.monotonic() - self._start


def quiet(*loggers: str, level: int = logging.WARNING) -> None:
    """Only what is at least of that level from the named loggers."""
    for name in loggers:
        logging.getLogger(name).setLevel(level)
