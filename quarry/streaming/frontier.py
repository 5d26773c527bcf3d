"""The polite scheduler: which URL may be asked for next, one request per server at a time.

Server holds the rules for one server, without a clock of its own. Frontier keeps servers in turn on one machine.
schedule() is the same over a stream of events, with the state of each server in Spark's state store.
"""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Callable, Collection, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarry.functions.urls import domain_key, domain_key_column
from quarry.streaming.state import limiter, penalty

#: Seconds between two requests to a server, at least; a server that wants more than MOST is left alone.
LEAST, MOST = 1.0, 30.0


class Server:
    """What is known of one server: the interval it declared, its penalty, and when the last request left."""

    def __init__(self, declared: float = LEAST, delay: float = 0.0, last: float | None = None, dropped: bool = False):
        self.declared, self.delay, self.last, self.dropped = declared, delay, last, dropped

    def declare(self, seconds: float | None) -> bool:
        """Intervals only grow. False: dropped, since the wish can't be met."""
        if seconds is not None and seconds > MOST:
            self.dropped, self.declared = True, LEAST
        else:
            self.declared = max(self.declared, seconds or 0.0)
        return not self.dropped

    def answered(self, refused: bool) -> bool:
        """A refusal doubles the penalty, from 2 seconds on; anything else halves it. False: dropped."""
        self.delay, out = penalty(self.delay, refused, not refused, MOST)
        if out:
            self.dropped, self.delay = True, 0.0
        return not self.dropped

    @property
    def interval(self) -> float:
        return max(self.declared, self.delay)

    def sent(self, at: float | None) -> None:
        """The clock starts when a request leaves, and never goes back."""
        if at is not None:
            self.last = at if self.last is None else max(self.last, at)

    def wait(self, now: float) -> float:
        return 0.0 if self.last is None else max(0.0, self.interval - (now - self.last))


class Frontier:
    """URLs to ask for, by server, in turn. scope: the only servers to ask, or None for all."""

    def __init__(self, clock: Callable[[], float], scope: Collection[str] | None = None):
        self.clock, self.scope = clock, scope
        self.servers: dict[str, Server] = {}
        self.waiting: OrderedDict[str, deque[str]] = OrderedDict()
        self.seen: set[str] = set()

    def server(self, name: str) -> Server:
        return self.servers.setdefault(name, Server())

    def _kept(self, name: str, alive: bool) -> bool:
        if not alive:
            self.waiting.pop(name, None)
        return alive

    def declare(self, name: str, seconds: float | None) -> bool:
        return self._kept(name, self.server(name).declare(seconds))

    def answered(self, name: str, refused: bool) -> bool:
        return self._kept(name, self.server(name).answered(refused))

    def add(self, urls: Iterable[str]) -> list[str]:
        """The URLs that were taken: new, of a server in scope that isn't dropped. Others aren't remembered."""
        taken = []
        for url in urls:
            name = domain_key(url)
            if url in self.seen or self.server(name).dropped or self.scope is not None and name not in self.scope:
                continue
            self.seen.add(url)
            self.waiting.setdefault(name, deque()).append(url)
            taken.append(url)
        return taken

    def next(self, busy: Collection[str] = ()) -> str | None:
        """A URL that may be asked for now, of a server without a request under way; its server goes to the end."""
        now = self.clock()
        for name, urls in self.waiting.items():
            if name not in busy and not self.server(name).wait(now):
                url = urls.popleft()
                self.waiting.move_to_end(name)
                if not urls:
                    del self.waiting[name]
                return url
        return None

    def wait(self, busy: Collection[str] = ()) -> float:
        """Seconds until some server is ready; 0 if none waits."""
        now = self.clock()
        return min((self.server(n).wait(now) for n in self.waiting if n not in busy), default=0.0)


#: add: a URL was found. answer: a request to url left at `at` with `status` (null: interrupted), and robots.txt asks for `delay`.
EVENTS = "server string, kind string, url string, at double, status int, delay double"
REQUESTS = "server string, url string, at double"


class _Scheduler(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getValueState("facts", "declared double, delay double, last double, dropped boolean, head long, tail long, busy boolean")
        self.queue = handle.getMapState("queue", "n long", "url string")
        self.seen = handle.getMapState("seen", "url string", "n long")

    def _next(self, key: tuple, server: Server, head: int, tail: int, busy: bool, now: float) -> Iterator[pd.DataFrame]:
        out = []
        if server.dropped and head < tail:
            self.queue.clear()
            head = tail
        if not busy and head < tail:
            wait = server.wait(now)
            if wait > 0:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(int((now + wait) * 1000) + 1)
            else:
                out = [(key[0], self.queue.getValue((head,))[0], now)]
                self.queue.removeKey((head,))
                head, busy = head + 1, True
        self.facts.update((server.declared, server.delay, server.last, server.dropped, head, tail, busy))
        yield pd.DataFrame(out, columns=["server", "url", "at"]).astype({"server": object, "url": object, "at": float})

    def _read(self) -> tuple[Server, int, int, bool]:
        if not self.facts.exists():
            return Server(), 0, 0, False
        declared, delay, last, dropped, head, tail, busy = self.facts.get()
        return Server(declared, delay, None if last is None or last != last else last, dropped), head, tail, busy

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        server, head, tail, busy = self._read()
        for part in rows:
            for e in part.itertuples(index=False):
                if e.kind == "add":
                    if not server.dropped and not self.seen.containsKey((e.url,)):
                        self.seen.updateValue((e.url,), (tail,))
                        self.queue.updateValue((tail,), (e.url,))
                        tail += 1
                    continue
                busy = False
                server.sent(None if pd.isna(e.at) else float(e.at))
                server.declare(None if pd.isna(e.delay) else float(e.delay))
                if not pd.isna(e.status) and not server.dropped:
                    server.answered(int(e.status) == 429)
        yield from self._next(key, server, head, tail, busy, timerValues.getCurrentProcessingTimeInMs() / 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._next(key, *self._read(), timerValues.getCurrentProcessingTimeInMs() / 1000)

    def close(self) -> None:
        pass


def schedule(events: DataFrame) -> DataFrame:
    """REQUESTS that may be sent, from a stream of EVENTS; needs the RocksDB state store. A server has one request under
    way until its answer comes back as an event, so a state holds for its server alone and servers spread over tasks."""
    return events.groupBy("server").transformWithStateInPandas(_Scheduler(), REQUESTS, "Append", "ProcessingTime")


def found(urls: DataFrame) -> DataFrame:
    """URLs (column url) as events."""
    none = F.lit(None)
    return urls.select(domain_key_column(F.col("url")).alias("server"), F.lit("add").alias("kind"), "url", none.cast("double").alias("at"), none.cast("int").alias("status"), none.cast("double").alias("delay"))


class _Limiter(StatefulProcessor):
    def __init__(self, limit: int, window: float):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.log = handle.getListState("log", "t double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        part = pd.concat(list(rows)).sort_values(["t", "event_id"])
        allow = limiter(self.limit, self.window, [t for (t,) in self.log.get()] if self.log.exists() else [])
        out = pd.DataFrame({"event_id": part["event_id"].to_numpy(), "allowed": [allow(float(t)) for t in part["t"]]})
        if allow.log:
            self.log.put([(t,) for t in allow.log])
        yield out

    def close(self) -> None:
        pass


def limited(events: DataFrame, key: str, limit: int, window: float) -> DataFrame:
    """event_id and allowed for a stream of events (event_id long, t in seconds): the state of a key is at most `limit` times."""
    return events.select(key, "event_id", "t").groupBy(key).transformWithStateInPandas(_Limiter(limit, window), "event_id long, allowed boolean", "Append", "None")
