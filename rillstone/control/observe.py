"""Metrics, alerts, rate limits and retries of the driver program."""

from __future__ import annotations

import json
import threading
import time
from collections import deque
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass

TIMERS_KEPT = 1000


class Metrics:
    """Counters, timers (of the last 1000 values) and gauges; safe to use from several threads."""

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._counters: dict[str, float] = {}
        self._gauges: dict[str, float] = {}
        self._timers: dict[str, deque[float]] = {}

    def count(self, name: str, by: float = 1) -> None:
        with self._lock:
            self._counters[name] = self._counters.get(name, 0) + by

    def gauge(self, name: str, value: float) -> None:
        with self._lock:
            self._gauges[name] = value

    def time(self, name: str, ms: float) -> None:
        with self._lock:
            self._timers.setdefault(name, deque(maxlen=TIMERS_KEPT)).append(ms)

    @contextmanager
    def timed(self, name: str):
        began = time.monotonic()
        try:
            yield
        finally:
            self.time(name, (time.monotonic() - began) * 1000)

    def summary(self) -> dict:
        with self._lock:
            timers = {}
            for k, values in self._timers.items():
                v = sorted(values)
                at = lambda p, v=v: v[min(len(v) - 1, int(p * len(v)))]
                timers[k] = {"count": len(v), "mean": sum(v) / len(v), "min": v[0], "max": v[-1], "p50": at(0.5), "p95": at(0.95), "p99": at(0.99)}
            return {"timers": timers, "gauges": {**self._gauges}, "counters": {**self._counters}}

    def export(self, format: str = "dict"):
        s = self.summary()
        if format == "dict":
            return s
        if format == "json":
            return json.dumps(s, sort_keys=True)
        if format == "prometheus":
            clean = lambda n: "".join(c if c.isalnum() else "_" for c in n)
            lines = [f"# TYPE {clean(k)} counter\n{clean(k)} {v}" for k, v in sorted(s["counters"].items())]
            lines += [f"# TYPE {clean(k)} gauge\n{clean(k)} {v}" for k, v in sorted(s["gauges"].items())]
            for k, t in sorted(s["timers"].items()):
                lines.append(f"# TYPE {clean(k)} summary\n" + "\n".join(f'{clean(k)}{{quantile="{q}"}} {t[p]}' for q, p in (("0.5", "p50"), ("0.95", "p95"), ("0.99", "p99"))) + f"\n{clean(k)}_count {t['count']}")
            return "\n".join(lines) + "\n"
        raise ValueError(f"no such format: {format}")

    def reset(self) -> None:
        with self._lock:
            self._counters.clear(), self._gauges.clear(), self._timers.clear()


@dataclass(frozen=True)
class AlertRule:
    """Fires where the measure is beyond the bound; without the measure it doesn't."""

    name: str
    measure: str
    way: str
    bound: float
    severity: str = "warning"

    def check(self, measures: dict[str, float]) -> dict | None:
        value = measures.get(self.measure)
        if value is None or not (value > self.bound if self.way == ">" else value < self.bound):
            return None
        return {"alert": self.name, "value": value, "bound": self.bound, "severity": self.severity}


BRONZE_ALERTS = (AlertRule("high error rate", "error_rate", ">", 0.05, "critical"), AlertRule("low throughput", "rows_per_second", "<", 100), AlertRule("slow batches", "batch_ms", ">", 60_000), AlertRule("many invalid rows", "invalid_rate", ">", 0.10), AlertRule("many dead letters", "dlq_rate", ">", 0.01))
SILVER_ALERTS = (AlertRule("high error rate", "error_rate", ">", 0.05, "critical"), AlertRule("slow batches", "batch_ms", ">", 300_000), AlertRule("low quality", "quality_score", "<", 0.7), AlertRule("many invalid rows", "invalid_rate", ">", 0.10))


def check_alerts(measures: dict[str, float], rules: tuple[AlertRule, ...] = BRONZE_ALERTS) -> list[dict]:
    return [a for r in rules if (a := r.check(measures))]


class RateLimiter:
    """Token buckets for a second and a minute; both must have room."""

    def __init__(self, per_second: int = 100, per_minute: int = 5000, clock: Callable[[], float] = time.monotonic):
        self._clock, self._lock = clock, threading.Lock()
        self._buckets = [[float(n), float(n), n / s, clock()] for n, s in ((per_second, 1), (per_minute, 60))]

    def acquire(self, tokens: int = 1) -> bool:
        with self._lock:
            now = self._clock()
            for b in self._buckets:
                b[0], b[3] = min(b[1], b[0] + (now - b[3]) * b[2]), now
            if any(b[0] < tokens for b in self._buckets):
                return False
            for b in self._buckets:
                b[0] -= tokens
            return True


def with_retries(job: Callable, retries: int = 3, delay: float = 1.0, growth: float = 1.0, on_failure: Callable[[Exception], None] | None = None, sleep: Callable[[float], None] = time.sleep):
    """The job's result; it is tried again after a failure, each time after ``growth`` times the delay. The last failure is handed on and raised."""
    for attempt in range(retries + 1):
        try:
            return job()
        except Exception as e:
            if attempt == retries:
                if on_failure:
                    on_failure(e)
                raise
            sleep(delay * growth**attempt)
