"""Wall-clock timers of named phases."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from statistics import mean


class Timers:
    """Seconds of each run of each phase; the first runs can be left out of the mean as warm-up."""

    def __init__(self):
        self.seconds: dict[str, list[float]] = {}

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds.setdefault(name, []).append(time.perf_counter() - began)

    def means(self, warm_up: int = 1) -> dict[str, float]:
        return {n: mean(s[warm_up:] or s) for n, s in self.seconds.items()}
