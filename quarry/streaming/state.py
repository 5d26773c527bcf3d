"""Keyed state: sliding rate limit, penalties after refusals. Batch by applyInPandas; the step functions serve streams."""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


class limiter:  # noqa: N801
    """Allows `limit` calls in any `window` seconds; rejected calls don't count. log: the times allowed so far."""

    def __init__(self, limit: int, window: float, log: Iterable[float] = ()):
        self.limit, self.window, self.log = limit, window, deque(log)

    def __call__(self, t: float) -> bool:
        while self.log and self.log[0] <= t - self.window:
            self.log.popleft()
        if len(self.log) >= self.limit:
            return False
        self.log.append(t)
        return True


class Limiters:
    """A limiter for each key, on one machine; sweep() forgets the keys that are idle."""

    def __init__(self, limit: int, window: float, clock: Callable[[], float]):
        self.limit, self.window, self.clock = limit, window, clock
        self.keys: dict[str, limiter] = {}
        self.lock = threading.Lock()

    def allow(self, key: str) -> bool:
        with self.lock:
            return self.keys.setdefault(key, limiter(self.limit, self.window))(self.clock())

    def sweep(self) -> int:
        with self.lock:
            now = self.clock()
            self.keys = {k: x for k, x in self.keys.items() if x.log and x.log[-1] > now - self.window}
            return len(self.keys)


def penalty(before: float, refused: bool, ok: bool, most: float = 30.0) -> tuple[float, bool]:
    """(delay, dropped) after a response: refusals double from 2, successes halve."""
    if refused:
        now = before * 2 if before else 2.0
        return (now, True) if now > most else (now, False)
    if ok and before:
        return (before / 2 if before / 2 >= 2 else 0.0), False
    return before, False


def _scanned(events: DataFrame, key: str, order: list[str], schema: str, step: Callable[[], Callable[[dict], tuple]]) -> DataFrame:
    """events with what step() says of each row, in order within its key. A partition is read as a stream in the order of
    key and time, so a key takes no more memory than its state, however many rows it has."""
    names = [c for c, _ in events.dtypes]
    new = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, first, of = None, True, step()
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                k = getattr(row, key)
                if first or k != last and not (pd.isna(k) and pd.isna(last)):
                    last, first, of = k, False, step()
                out.append(of(row))
            yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(out, columns=new)], axis=1)

    whole = ", ".join(f"{c} {t}" for c, t in events.dtypes) + ", " + schema
    return events.repartition(key).sortWithinPartitions(key, *order).select(*names).mapInPandas(run, whole)


def rate_limit(events: DataFrame, key: str, order: list[str], limit: int, window: float) -> DataFrame:
    """events with `allowed`; column t is the time in seconds."""

    def step() -> Callable:
        allow = limiter(limit, window)
        return lambda row: (allow(row.t),)

    return _scanned(events, key, ["t", *order], "allowed boolean", step)


def penalties(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """events (refused, ok) with the delay after each, and whether the server is dropped by then."""

    def step() -> Callable:
        state = [0.0, False]

        def of(row) -> tuple:
            if not state[1]:
                state[:] = penalty(state[0], row.refused, row.ok)
            return tuple(state)

        return of

    return _scanned(events, key, order, "delay double, dropped boolean", step)
