"""Retry schedules as plain functions, and the wrapper that follows them."""

from __future__ import annotations

import time
from dataclasses import dataclass
from typing import Any, Callable


class Rejected(Exception):
    """The backend answered, but not with success."""

    def __init__(self, status: int, retry_after_ms: int | None = None):
        super().__init__(f"status {status}")
        self.status = status
        self.retry_after_ms = retry_after_ms


@dataclass(frozen=True)
class RetryPolicy:
    """``attempts`` tries in all; ``delay_ms(n, error)`` is the pause after the n-th try (from 0)."""

    attempts: int
    delay_ms: Callable[[int, Exception], int]


def otlp_policy(max_retries: int = 3) -> RetryPolicy:
    """At least one try; 200, 400, ... ms after exceptions, none after an unsuccessful answer."""

    def delay(n: int, error: Exception) -> int:
        return 0 if isinstance(error, Rejected) else 100 * 2 ** (n + 1)

    return RetryPolicy(max(1, max_retries), delay)


def analytics_policy(max_retries: int = 3) -> RetryPolicy:
    """One try plus ``max_retries``.

    429 waits as told, else 1000, 2000, ... ms; other 4xx and exceptions wait 100, 200, ... ms;
    5xx does not wait.
    """

    def delay(n: int, error: Exception) -> int:
        if isinstance(error, Rejected):
            if error.status == 429:
                return error.retry_after_ms if error.retry_after_ms is not None else 1000 * 2**n
            if error.status >= 500:
                return 0
        return 100 * 2**n

    return RetryPolicy(max_retries + 1, delay)


@dataclass(frozen=True)
class Attempted:
    ok: bool
    attempts: int
    error: str | None = None
    result: Any = None


def with_retry(write: Callable[[], Any], policy: RetryPolicy,
               sleep: Callable[[float], None] = time.sleep) -> Attempted:
    """Run ``write`` under a policy; the outcome is returned, never raised."""
    error: Exception | None = None
    for n in range(policy.attempts):
        try:
            return Attempted(True, n + 1, result=write())
        except Exception as exc:  # a sink may fail in any way; isolation is the point
            error = exc
            pause = policy.delay_ms(n, exc)
            if n + 1 < policy.attempts and pause > 0:
                sleep(pause / 1000)
    return Attempted(False, policy.attempts, f"{type(error).__name__}: {error}")
