"""Calls to services that may refuse: keys, a pace, and repeats with growing pauses."""

from __future__ import annotations

import os
import re
import threading
import time
from collections.abc import Callable

# What marks an error that may pass, one that lasts for the day, and a pause that the service asks for.
PASSING = ["429", "500", "503", "DEADLINE", "INTERNAL", "RESOURCE_EXHAUSTED", "UNAVAILABLE", "timed out"]
FOR_TODAY = "PerDay"
ASKED_PAUSE = r"(?i)retry(?:delay)?\W{0,4}(\d+(?:\.\d+)?)\s*s"
ATTEMPTS, FIRST_PAUSE, LONGEST_PAUSE = 8, 4.0, 120.0


class MissingKeyError(RuntimeError):
    """The environment has no key for a service."""


class QuotaExhaustedError(RuntimeError):
    """The day's calls are used up, so repeating is no use."""


def require_key(name: str) -> str:
    key = os.environ.get(name, "")
    if not key:
        raise MissingKeyError(f"{name} is not set; set it or choose a component that works offline")
    return key


def may_pass(error: BaseException) -> bool:
    return any(mark in str(error) for mark in PASSING)


class Pace:
    """At most ``per_minute`` calls of ``wait`` come back in a minute, whatever the number of threads; 0 sets no limit."""

    def __init__(self, per_minute: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap = 60.0 / per_minute if per_minute > 0 else 0.0
        self.clock, self.sleep, self.lock, self.free_at = clock, sleep, threading.Lock(), float("-inf")

    def wait(self) -> None:
        with self.lock:
            turn = max(self.clock(), self.free_at)
            self.free_at = turn + self.gap
            pause = turn - self.clock()
        if pause > 0:
            self.sleep(pause)


def repeated(call: Callable, attempts: int = ATTEMPTS, first: float = FIRST_PAUSE, sleep: Callable[[float], None] = time.sleep):
    """What ``call`` returns, tried again while its errors may pass."""
    pause = first
    for left in reversed(range(attempts)):
        try:
            return call()
        except Exception as error:
            if FOR_TODAY in str(error):
                raise QuotaExhaustedError(str(error)) from error
            if not left or not may_pass(error):
                raise
            asked = re.search(ASKED_PAUSE, str(error))
        sleep(float(asked[1]) + 1 if asked else min(pause, LONGEST_PAUSE))
        pause *= 2
    raise ValueError("no attempts")
