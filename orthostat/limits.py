"""Driver-side limits for calls to an outside service: sliding windows, retries, saved state."""

from __future__ import annotations

import json
import os
import random
import re
import shutil
import time
from collections import deque
from collections.abc import Callable
from functools import wraps


class QuotaExceeded(RuntimeError):
    """The day's quota is used up for longer than an hour."""


class RateLimiter:
    """At most ``per_minute`` calls in 60 s and ``per_day`` in 24 h.

    ``clock`` and ``sleep`` can be replaced in tests. With a ``path`` the call times survive a
    restart; an unreadable file counts as none.
    """

    def __init__(self, per_minute: int = 15, per_day: int = 20, path: str | None = None, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep):
        self.per_minute, self.per_day, self.path, self.clock, self.sleep = per_minute, per_day, path, clock, sleep
        self.calls: deque[float] = deque()
        if path and os.path.exists(path):
            try:
                with open(path, encoding="utf-8") as file:
                    self.calls.extend(sorted(float(t) for t in json.load(file)["calls"]))
            except (ValueError, KeyError, TypeError):
                pass

    def _within(self, seconds: float) -> list[float]:
        now = self.clock()
        while self.calls and self.calls[0] <= now - 86_400:
            self.calls.popleft()
        return [t for t in self.calls if t > now - seconds]

    def wait_time(self) -> float:
        """Seconds until the next call is allowed; raises when only the day's quota lies in the way for over an hour."""
        now, minute, day = self.clock(), self._within(60), self._within(86_400)
        if len(minute) >= self.per_minute:
            return max(0.0, minute[-self.per_minute] + 60 - now)
        if len(day) >= self.per_day:
            wait = max(0.0, day[-self.per_day] + 86_400 - now)
            if wait > 3600:
                raise QuotaExceeded(f"{wait:.0f} s until the next call")
            return wait
        return 0.0

    def acquire(self) -> None:
        """Wait as long as needed, then count a call."""
        while (wait := self.wait_time()) > 0:
            self.sleep(wait)
        self.calls.append(self.clock())
        if self.path:
            with open(self.path, "w", encoding="utf-8") as file:
                json.dump({"calls": list(self.calls)}, file)

    def statistics(self) -> dict[str, int]:
        """Calls in both windows and what is left of both quotas."""
        minute, day = len(self._within(60)), len(self._within(86_400))
        return {"minute": minute, "day": day, "minute_left": max(0, self.per_minute - minute), "day_left": max(0, self.per_day - day)}

    def reset(self) -> str | None:
        """Forget all calls; a saved state is kept as a copy, whose path is returned."""
        self.calls.clear()
        if self.path and os.path.exists(self.path):
            backup = f"{self.path}.bak"
            shutil.move(self.path, backup)
            return backup
        return None


def retry_delay(message: str) -> float | None:
    """N17 on the driver: seconds to wait that an error message names."""
    if found := re.search(r"'retryDelay':\s*'([\d.]+)(ms|s)'", message):
        return float(found[1]) / (1000 if found[2] == "ms" else 1)
    found = re.search(r"Please retry in ([\d.]+)s", message)
    return float(found[1]) if found else None


def with_retry(retries: int = 5, base: float = 2.0, on: tuple[type[Exception], ...] = (Exception,), sleep: Callable[[float], None] = time.sleep) -> Callable:
    """L3, L4: repeat a failing call after the delay that its error names, else after min(base * 2^n, 60) s with jitter."""

    def decorate(call: Callable) -> Callable:
        @wraps(call)
        def repeated(*args, **kwargs):
            for attempt in range(retries + 1):
                try:
                    return call(*args, **kwargs)
                except on as error:
                    if attempt == retries or isinstance(error, QuotaExceeded):
                        raise
                    wait = retry_delay(str(error))
                    sleep(wait if wait is not None else min(base * 2**attempt, 60.0) * (1 + random.uniform(0, 0.5)))

        return repeated

    return decorate
