"""Cached permissions: for requests on the driver, and replayed over a log of memberships, as batch and as stream."""

from __future__ import annotations

import threading
import time
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import AclResolutionError
from ..principals import Principal

#: A signal of this subject concerns everyone.
ALL = ("all", "")


class EpochCache:
    """Permissions that were resolved less than ``ttl`` seconds ago and not signalled since.

    Signals are numbered, and each subject (a principal, a group, all) has the
    number of its last one. What is kept has the number that was reached, and
    the time, when its fetch *began*; it is good while none of its subjects has
    a later one. So a signal during a fetch counts, and costs one addition
    however many permissions are held. If they can't be resolved, nobody is
    anything: the answer is the empty set. Without a signal, a revocation takes
    effect after the ttl; with a ttl of 0 nothing is kept. Over ``most``
    principals, those fetched first go. Threads may share a cache; fetches run side by side.
    """

    def __init__(self, fetch: Callable[[Principal], frozenset[str]], *, clock: Callable[[], float] = time.monotonic, ttl: float = 60.0, most: int = 10_000):
        if ttl < 0:
            raise AclResolutionError("the ttl must not be negative")
        self.fetch, self.clock, self.ttl, self.most = fetch, clock, ttl, most
        self.lock, self.number = threading.Lock(), 0
        self.last: dict[tuple[str, str], int] = {}
        self.held: dict[Principal, tuple[float, int, frozenset[str]]] = {}
        self.outcomes: Counter[str] = Counter()

    def _good(self, who: Principal) -> bool:
        began, number, found = self.held[who]
        subjects = (ALL, ("principal", who.id), *(("group", g) for g in who.groups | found))
        return self.clock() - began < self.ttl and all(self.last.get(s, 0) <= number for s in subjects)

    def __call__(self, who: Principal) -> frozenset[str]:
        with self.lock:
            if who in self.held and self._good(who):
                self.outcomes["hit"] += 1
                return self.held[who][2]
            self.outcomes["miss"] += 1
            self.held.pop(who, None)
            began, number = self.clock(), self.number
        try:
            found = self.fetch(who)
        except AclResolutionError:
            with self.lock:
                self.outcomes["error"] += 1
            return frozenset()
        with self.lock:
            if self.ttl:
                self.held[who] = began, number, found
            while len(self.held) > self.most:
                del self.held[next(iter(self.held))]
        return found

    def signal(self, kind: str = "all", name: str = "") -> None:
        """Something about a ``principal``, a ``group`` or ``all`` has changed."""
        with self.lock:
            self.number += 1
            self.last[kind, name] = self.number

    def narrow(self, principal: str, group: str) -> None:
        """A principal has left a group, as is known without another resolution."""
        with self.lock:
            for who in [w for w in self.held if w.id == principal and self._good(w)]:
                began, number, found = self.held[who]
                self.held[who] = began, number, found - {group}


#: The columns of a replay.
_OUT = "user_id long, event_id long, outcome string, cached_version long, true_version long"
#: Events that change a user's membership; the second kind is signalled.
GRANTED, REVOKED = "signup", "error"


class _Replay:
    """The state of one user's cache: when it was fetched (-1: not), the version then, and the version now."""

    __slots__ = ("cached", "fetched", "true", "ttl")

    def __init__(self, ttl_seconds: int, fetched: int = -1, cached: int = -1, true: int = 0):
        self.ttl, self.fetched, self.cached, self.true = ttl_seconds * 1_000_000, fetched, cached, true

    def take(self, at: int, kind: str) -> str | None:
        """The outcome of an event, None if it resolves nothing."""
        if kind == GRANTED or kind == REVOKED:
            self.true += 1
            if kind == REVOKED:
                self.fetched = -1
            return None
        if self.fetched >= 0 and at - self.fetched < self.ttl:
            return "hit"
        self.fetched, self.cached = at, self.true
        return "miss"


def _slim(events: DataFrame) -> DataFrame:
    return events.select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))


def replay_log(events: DataFrame, ttl_seconds: int = 3600) -> DataFrame:
    """Replay a membership log through the cache: user_id, event_id, outcome, cached_version, true_version of each resolution.

    events: event_id, ts, user_id, event_type. A signup grants and an error
    revokes; either makes a new version of the user's membership, and the
    revocation is signalled, so it empties the cache. Every other event
    resolves. A resolution hits if the last fetch since the last signal is
    younger than the ttl. As entries live from their fetch, whether an event
    hits hangs on the fetch before, which no window expresses; so events are
    dealt by user, sorted in their partitions, and stream past the state of one
    user. A user with any number of events takes no more memory than another.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, state = None, None
        for batch in batches:
            rows, outcomes, cached, true = [], [], [], []
            for n, (u, kind, at) in enumerate(zip(batch["user_id"].tolist(), batch["event_type"].tolist(), batch["at"].tolist(), strict=True)):
                if state is None or u != user:
                    user, state = u, _Replay(ttl_seconds)
                if outcome := state.take(at, kind):
                    rows.append(n)
                    outcomes.append(outcome)
                    cached.append(state.cached)
                    true.append(state.true)
            told = batch[["user_id", "event_id"]].iloc[np.array(rows, np.int64)]
            yield told.assign(outcome=outcomes, cached_version=cached, true_version=true)

    dealt = _slim(events.where("user_id IS NOT NULL AND event_id IS NOT NULL AND ts IS NOT NULL")).repartition("user_id").sortWithinPartitions("user_id", "at", "event_id")
    return dealt.mapInPandas(walk, _OUT)


def replay_stream(events: DataFrame, ttl_seconds: int = 3600) -> DataFrame:
    """The same cache over a stream: state per user, resolutions as they come in the order of each batch.

    Events of a user that arrive in a later batch count as later, whatever
    their time; so feed it in order.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        replay = _Replay(ttl_seconds, *(state.get if state.exists else ()))
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        out = []
        for at, event, kind in zip(rows["at"], rows["event_id"], rows["event_type"], strict=True):
            if outcome := replay.take(int(at), kind):
                out.append((key[0], event, outcome, replay.cached, replay.true))
        state.update((replay.fetched, replay.cached, replay.true))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "outcome", "cached_version", "true_version"])

    return _slim(events).groupBy("user_id").applyInPandasWithState(run, _OUT, "fetched long, cached long, true long", "append", GroupStateTimeout.NoTimeout)
